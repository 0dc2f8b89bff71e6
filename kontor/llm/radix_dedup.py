"""Suffix-array dedup by a depth-limited radix sort.

Two suffixes whose first WIDTH bytes agree belong to one group of the suffix
array cut at that depth. The sort runs most significant digit first and only
groups with two or more members go on, so the array is never built:

* digit 1: the 32-byte anchor that a window of WIDTH bytes selects by content
  (the smallest k-mer hash in it, leftmost). Neighbouring suffixes select the same
  anchor, so one row stands for a run of about 180 suffixes.
* digits 2..: the suffixes of a run as one block, then in blocks of 64, 8 and 1 by
  their distance to the anchor. The bytes common to all windows of a block (``core``) are the next
  digit, the bytes that the block covers (``cover``) the one after it. A core met
  once is dropped; equal covers are groups of equal windows, all found at once;
  what has a common core but different covers is split into smaller blocks. At
  block size 1 core and cover are the window itself: equal groups are exactly the
  repeated windows.

Only one member of a class of equal covers goes on to the next digit, so a third of
all rows being copies costs one row each. Survivors are handed to the next pass as
a bitmap of fixed size (a false hit costs rows, never a result)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm import textkit as K
from kontor.llm.frames import BITMAP_BITS, bitmap, id_and_text, in_bitmap, landed, small_batches

WIDTH, KMER, CHUNK = 400, 32, 1 << 20
LEVELS = (0, 64, 8, 1)          # suffixes in a block of each digit; 0: a whole run
U = np.uint64


def _chunks(data: np.ndarray, offsets: np.ndarray, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, row, byte position in the row) of groups of at most about ``most``
    window starts. A text longer than that is cut with ``width - 1`` bytes of overlap,
    so that every window start lies in exactly one chunk."""
    part: list[tuple[int, int, int]] = []
    size = 0

    def flush():
        bounds = np.cumsum([0, *(e - s for _, s, e in part)])
        return (np.concatenate([data[s:e] for _, s, e in part]), bounds,
                np.array([r for r, _, _ in part]), np.array([s - offsets[r] for r, s, _ in part]))

    for r in np.flatnonzero(np.diff(offsets) >= width):
        for s in range(offsets[r], offsets[r + 1] - width + 1, most):
            e = min(s + most + width - 1, offsets[r + 1])
            if part and size + e - s > most + width:
                yield flush()
                part, size = [], 0
            part.append((r, s, e))
            size += e - s
    if part:
        yield flush()


def _runs(data: np.ndarray, bounds: np.ndarray, width: int, kmer: int):
    """Runs of window starts that select the same anchor: hash function, anchor, first
    and last start, chunk of each run."""
    rh = K.WrappingHash(data)
    span = width - kmer + 1
    h = rh.fixed(kmer)
    key = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    n = len(data) - width + 1                       # window starts, those over a border too
    rows = -(-len(key) // span)
    padded = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:n], ahead[span - 1: span - 1 + n]) & U(0xFFFFFFFF)).astype(np.int64)
    ok = np.ones(n, bool)
    for b in bounds[1:-1]:
        ok[max(0, b - width + 1): b] = False
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    return rh, h, anchor[first], first, last, np.searchsorted(bounds, first, side="right") - 1


def _anchor_keys(width: int, kmer: int, most: int):
    def run(batches):
        for batch in batches:
            for data, bounds, _, _ in _chunks(*K.buffer_of(batch.column(1)), width, most):
                _, h, anchor, _, _, _ = _runs(data, bounds, width, kmer)
                yield pa.RecordBatch.from_arrays([pa.array(h[anchor].view(np.int64))], names=["anchor"])
    return run


def _block_key(row_key: np.ndarray, anchor_at: np.ndarray, block: np.ndarray, size: int) -> np.ndarray:
    return K.mix(K.mix(row_key + anchor_at.astype(np.uint64) * U(0x9E3779B97F4A7C15))
                 + block.astype(np.uint64) * U(256) + U(size))


def _blocks(width: int, kmer: int, most: int, size: int, alive: list[tuple[int | None, np.ndarray]]):
    """Rows of one digit: blocks of ``size`` suffixes (0: a whole run) whose ancestors have all
    survived. ``alive``: the bitmap of each earlier digit (None: anchors), coarsest first; testing
    all of them keeps false hits from adding up.

    ``place`` is the first suffix and the number of suffixes, in one number."""
    names = ["core", "cover", "check", "row_key", "place", "block_key"]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            for data, bounds, row, base in _chunks(*K.buffer_of(batch.column(1)), width, most):
                rh, h, anchor, first, last, chunk = _runs(data, bounds, width, kmer)
                key = ids[row[chunk]]
                at = anchor - bounds[chunk] + base[chunk]       # of the anchor, in the row
                for parent, bits in alive[:2]:                  # anchors, whole runs
                    own = h[anchor] if parent is None else _block_key(key, at, np.zeros_like(at), 0)
                    keep = in_bitmap(bits, own)
                    anchor, first, last, chunk, key, at = (x[keep] for x in (anchor, first, last, chunk, key, at))
                if not len(first):
                    continue
                near, far = anchor - last, anchor - first        # distances to the anchor
                if size:
                    blocks = far // size - near // size + 1
                    run_of = np.repeat(np.arange(len(first)), blocks)
                    j = np.arange(len(run_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks) + (near // size)[run_of]
                else:
                    run_of, j = np.arange(len(first)), np.zeros(len(first), np.int64)
                for parent, bits in alive[2:]:
                    keep = in_bitmap(bits, _block_key(key[run_of], at[run_of], j * size // parent, parent))
                    run_of, j = run_of[keep], j[keep]
                if not len(j):
                    continue
                a, lo, hi = anchor[run_of], near[run_of], far[run_of]
                if size:
                    lo, hi = np.maximum(j * size, lo), np.minimum(j * size + size - 1, hi)
                    core = rh(a - j * size, a - j * size - size + 1 + width)
                    core = K.mix(core + (j * 256 + size).astype(np.uint64))
                else:
                    core = h[a]
                cover = K.mix(K.RangeHash(data)(a - hi, a - lo + width) + (lo * 1024 + hi).astype(np.uint64))
                check = rh(a - hi, a - lo + width)
                start = a - hi - bounds[chunk[run_of]] + base[chunk[run_of]]
                out = (core, cover, check, key[run_of], start * 1024 + (hi - lo + 1), _block_key(key[run_of], at[run_of], j, size))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in out], names=names)
    return run


_BLOCKS = "core long, cover long, check long, row_key long, place long, block_key long"


def _only(bits: np.ndarray, column: int):
    def run(batches):
        for batch in batches:
            keep = in_bitmap(bits, batch.column(column).to_numpy().view(np.uint64))
            if keep.any():
                yield batch.filter(pa.array(keep))
    return run


def repeated_windows(docs: DataFrame, width: int = WIDTH, kmer: int = KMER, bits: int = BITMAP_BITS,
                     chunk: int = CHUNK) -> DataFrame:
    """(row_key, place): runs of window starts whose ``width`` bytes occur elsewhere too;
    place = start * 1024 + number of starts.

    ``docs`` has row_key (long, not NULL; equal keys mean equal rows) and text (not NULL)."""
    kmer = min(kmer, width)
    source = docs.select("row_key", "text")
    anchors = (source.mapInArrow(_anchor_keys(width, kmer, chunk), "anchor long")
               .groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    alive: list[tuple[int | None, np.ndarray]] = [(None, bitmap(anchors, "anchor", bits))]
    found = None
    for size in (s for s in LEVELS if s < 2 or 2 * s <= width):   # a core must not be empty
        rows = landed(source.mapInArrow(_blocks(width, kmer, chunk, size, alive), _BLOCKS))
        classes = landed(rows.groupBy("core", "cover", "check").agg(F.count("*").alias("times"), F.min("block_key").alias("block_key")))
        times = classes.filter("times > 1").select("cover", "check")
        repeated = bitmap(times, "cover", bits)
        places = rows.select("cover", "check", "row_key", "place")
        equal = (places.mapInArrow(_only(repeated, 0), places.schema).join(times, ["cover", "check"], "left_semi").select("row_key", "place"))
        found = equal if found is None else found.unionByName(equal)
        if size == 1:
            return found
        mixed = classes.groupBy("core").agg(F.count("*").alias("covers")).filter("covers > 1").select("core")
        alive = [*alive, (size, bitmap(classes.join(mixed, "core", "left_semi"), "block_key", bits))]
    return found


def _cut(width: int):
    def run(batches):
        for batch in batches:
            data, offsets = K.buffer_of(batch.column(1))
            places = batch.column(2).to_pylist()
            out = []
            for i, place in enumerate(places):
                own = data[offsets[i]: offsets[i + 1]]
                delta = np.zeros(len(own) + 1, np.int64)
                if place:
                    at, n = np.divmod(np.array(place), 1024)
                    np.add.at(delta, at, 1)
                    np.add.at(delta, np.minimum(at + n - 1 + width, len(own)), -1)
                gone = np.cumsum(delta[:-1]) > 0
                out.append((len(own), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()),
                            own[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[k] for x in out], pa.int64()) for k in range(3)),
                 pa.array([x[3] for x in out], pa.binary()),
                 pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
    return run


def spans_of(windows: DataFrame) -> DataFrame:
    """(row_key, places), each place once: wholly repeated rows share a key and send the same places."""
    return windows.groupBy("row_key").agg(F.collect_set("place").alias("places"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, kmer: int = KMER, bits: int = BITMAP_BITS,
                   chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the bytes
    that stay, binary), kept_sha256.

    A byte goes if it lies in a string of ``width`` bytes that also starts anywhere
    else (same text included). NULL text counts as empty; texts shorter than ``width``
    stay whole; a repeated row is a repetition; NULL ids are kept as they are; other
    columns are ignored; an empty table gives an empty table."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = id_and_text(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    spans = landed(spans_of(repeated_windows(base, width, kmer, bits, chunk)))
    hit = bitmap(spans, "row_key", bits)

    def maybe(batches):                       # rows whose key is in the bitmap: few besides those with spans
        for batch in batches:
            keep = in_bitmap(hit, batch.column(batch.schema.get_field_index("row_key")).to_numpy().view(np.uint64))
            if keep.any():
                yield batch.filter(pa.array(keep))

    def never(batches):
        for batch in batches:
            keep = in_bitmap(hit, batch.column(batch.schema.get_field_index("row_key")).to_numpy().view(np.uint64))
            if not keep.all():
                yield batch.filter(pa.array(~keep))

    touched = (base.mapInArrow(maybe, base.schema).join(spans, "row_key", "left")
               .select("doc_id", "text", "places")
               .mapInArrow(_cut(width), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"))
    whole = base.mapInArrow(never, base.schema).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return touched.unionByName(whole)
