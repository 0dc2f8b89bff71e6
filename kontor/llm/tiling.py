"""Benchmark decontamination by greedy string tiling.

Test items and documents that share a seed (five consecutive words; an item with fewer
words is one seed) are paired by a join on the seed. Each pair is tiled: Karp-Rabin
hashes find the longest common runs of words that are not marked yet, the longest are
marked first, and the search length falls until nothing of seed length is left. The
share of the item's words under tiles is its coverage. Tiles may come in any order, so a
passage whose sentences were moved is covered like one in its old order.

Every tile is made of seeds, so a document travels as the words under its shared seeds,
with breaks between them, and its text stays where it is; pairs whose shared seeds cannot
reach the coverage are dropped before any words are joined. The seeds of the items reach the scan
as two bitmaps of fixed size (together a false hit is rare, and the join on the seed
drops it)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm import textkit as K
from kontor.llm.frames import bitmap, id_and_text, in_bitmap, landed, small_batches, survivors

SEED_WORDS, COVERAGE = 5, 0.6
U = np.uint64
_SECOND = 0x2545F4914F6CDD1D


def _seeds(h: np.ndarray, first: np.ndarray, lengths: tuple[int, ...]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, hash, position, row) of the runs of each length."""
    out = []
    for n in lengths:
        s, at, row = K.sequence_hashes(h, first, n)
        out.append((n, s + U(n), at, row))
    return out


def _items(n: int):
    def run(batches):
        for batch in batches:
            for part in K.pieces(batch):
                h, first = K.word_hashes(*K.buffer_of(part.column(1)))
                count = np.diff(first)
                seeds: list[list[int]] = [[] for _ in count]
                for length, s, _, row in _seeds(h, first, tuple(range(1, n + 1))):
                    fit = (count[row] == length) if length < n else np.ones(len(row), bool)
                    for r, value in zip(row[fit], s[fit].view(np.int64).tolist(), strict=True):
                        seeds[r].append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.minimum(count, n).astype(np.int32)), pa.array(seeds, pa.list_(pa.int64())),
                     pa.array([h[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)], pa.list_(pa.int64()))],
                    names=["item_id", "shortest", "seeds", "item_words"])
    return run


def _hits(lengths: tuple[int, ...], one: np.ndarray, two: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in K.pieces(batch):
                h, first = K.word_hashes(*K.buffer_of(part.column(1)))
                under = np.zeros(len(h) + 1, np.int64)
                rows, found = [], []
                for n, s, at, row in _seeds(h, first, lengths):
                    hit = np.flatnonzero(in_bitmap(one, s))
                    hit = hit[in_bitmap(two, K.mix(s[hit] + U(_SECOND)))]
                    np.add.at(under, at[hit], 1)
                    np.add.at(under, at[hit] + n, -1)
                    rows.append(row[hit])
                    found.append(s[hit])
                row, seed = np.concatenate(rows), np.concatenate(found)
                covered = np.cumsum(under[:-1]) > 0
                keys, hits, words = [], [], []
                for r in np.unique(row):
                    own = np.flatnonzero(covered[first[r]: first[r + 1]]) + first[r]
                    gap = np.flatnonzero(np.diff(own) > 1) + 1
                    keys.append(part.column(0)[int(r)].as_py())
                    hits.append(np.unique(seed[row == r]).view(np.int64))
                    words.append(np.insert(h[own].view(np.int64), gap, 0))      # 0: a break
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hits, pa.list_(pa.int64())),
                                                      pa.array(words, pa.list_(pa.int64()))], names=["row_key", "seeds", "doc_words"])
    return run


class _Runs:
    """Karp-Rabin hashes of runs of words, modulo two primes by prefix sums."""

    def __init__(self, words: np.ndarray):
        self.parts = []
        for base, prime in zip(K.BASES, K.PRIMES, strict=True):
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words % U(prime) * K.powers(len(words) + 1, base, prime)[: len(words)] % U(prime), out=sums[1:])
            self.parts.append((sums, K.powers(len(words) + 1, pow(base, -1, prime), prime), U(prime)))

    def __call__(self, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every run of ``size`` free words."""
        taken = np.zeros(len(free) + 1, np.int64)
        np.cumsum(~free, out=taken[1:])
        start = np.flatnonzero(taken[size:] == taken[: max(0, len(taken) - size)])
        a, b = ((sums[start + size] - sums[start]) % prime * down[start] % prime for sums, down, prime in self.parts)
        return start, (a << U(32)) | b


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the tiles; words of value 0 match nothing.

    The longest common run of free words is found by bisection on its length (a run has common runs of every
    shorter length); then all runs of that length are marked, in the order of the item, each at the first free
    place of the document. A round passes over both texts some log(words) times however often a word repeats,
    and there are as many rounds as tiles have different lengths."""
    item, doc = np.asarray(item, np.int64).view(np.uint64), np.asarray(doc, np.int64).view(np.uint64)
    free_a, free_b = item != 0, doc != 0
    runs_a, runs_b = _Runs(item), _Runs(doc)
    out: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))
    while most >= least:
        low, high = least - 1, most
        guess = least               # most pairs end here or share runs far below their length
        while low < high:
            if len(np.intersect1d(runs_a(free_a, guess)[1], runs_b(free_b, guess)[1])):
                low = guess
            else:
                high = guess - 1
            guess = min(high, low * 2) if high == most else (low + high + 1) // 2
        if low < least:
            break
        start, h = runs_b(free_b, low)
        order = np.argsort(h, kind="stable")
        start, h = start[order], h[order]
        begin, own = runs_a(free_a, low)
        place = {}                  # of each hash: the next place of the document to try
        left, right = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
        for i in np.flatnonzero(right > left):
            a = int(begin[i])
            # marks of this round are as long as the run: one that overlaps it covers an end of it
            if not (free_a[a] and free_a[a + low - 1]):
                continue
            j = place.get(left[i], left[i])
            while j < right[i] and not (free_b[start[j]] and free_b[start[j] + low - 1]):
                j += 1
            place[left[i]] = j
            while j < right[i]:     # the words decide, not the hash
                b = int(start[j])
                if free_b[b] and free_b[b + low - 1] and np.array_equal(item[a: a + low], doc[b: b + low]):
                    free_a[a: a + low] = free_b[b: b + low] = False
                    out.append((a, b, low))
                    break
                j += 1
        most = low - 1
    return out


def _cover(n: int):
    def run(batches):
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            covered, longest, pieces = [], [], []
            for i in range(batch.num_rows):
                item, doc = (col[name][i].values.to_numpy() for name in ("item_words", "doc_words"))
                got = tiles(item, doc, min(n, len(item)))
                covered.append(sum(t[2] for t in got) / len(item))
                longest.append(max((t[2] for t in got), default=0))
                pieces.append(len(got))
            yield pa.RecordBatch.from_arrays([col["row_key"], col["item_id"], pa.array(covered, pa.float64()), pa.array(pieces, pa.int32()),
                                              pa.array(longest, pa.int32())], names=["row_key", "item_id", "coverage", "n_tiles", "longest_tile"])
    return run


def _pairs(keyed: DataFrame, items: DataFrame, seed_words: int, coverage: float) -> DataFrame:
    """(row_key, item_id, coverage, n_tiles, longest_tile) of pairs with enough coverage."""
    small_batches(keyed.sparkSession)
    kind = items.schema["item_id"].dataType.simpleString()
    prepared = landed(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _items(seed_words), f"item_id {kind}, shortest int, seeds array<long>, item_words array<long>")
        .filter("shortest > 0").withColumn("item_row", F.monotonically_increasing_id()))
    seeds = landed(prepared.select("item_row", F.size("item_words").alias("n_words"), F.explode("seeds").alias("seed"))
                   .groupBy("item_row", "n_words", "seed").agg(F.count("*").alias("places"))).withColumn("k", F.col("seed"))
    lengths = tuple(sorted(r[0] for r in prepared.select("shortest").distinct().collect()))      # at most seed_words numbers
    lengths = lengths or (seed_words,)
    one = bitmap(seeds, "k")
    # the second bitmap is over another hash of the same seed
    two = bitmap(seeds.select("k").mapInArrow(_again, "k long"), "k")
    hits = landed(keyed.select("row_key", "text").mapInArrow(
        _hits(lengths, one, two), "row_key long, seeds array<long>, doc_words array<long>"))
    # tiles lie under shared seeds: a pair whose seeds together are shorter than the coverage asks for cannot have it,
    # and goes before any list of words is joined. Equal rows have equal keys and count once.
    hits = hits.dropDuplicates(["row_key"])
    near = (hits.select("row_key", F.explode("seeds").alias("seed")).join(seeds.drop("k"), "seed")
            .groupBy("row_key", "item_row", "n_words").agg(F.sum("places").alias("shared"))
            .filter(F.col("shared") * F.least(F.lit(seed_words), "n_words") >= coverage * F.col("n_words")).select("row_key", "item_row"))
    work = (near.join(hits.select("row_key", "doc_words"), "row_key")
            .join(prepared.select("item_row", "item_id", "item_words"), "item_row")
            .select("row_key", "item_id", "doc_words", "item_words"))
    return work.mapInArrow(_cover(seed_words), f"row_key long, item_id {kind}, coverage double, n_tiles int, longest_tile int").filter(
        F.col("coverage") >= coverage)


def _again(batches):
    for batch in batches:
        k = batch.column(0).to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(K.mix(k + U(_SECOND)).view(np.int64))], names=["k"])


def _keyed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))


def contaminated(docs: DataFrame, items: DataFrame, seed_words: int = SEED_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile): the pairs of a document and a test
    item of which at least the share ``coverage`` of the words is found in the document.

    ``items`` has item_id and text. NULL and empty texts match nothing; equal items and
    repeated documents each give their own rows; NULL ids are kept as they are; other columns
    are ignored; an empty table on either side gives an empty table."""
    keyed = _keyed(docs)
    pairs = landed(_pairs(keyed, items, seed_words, coverage))
    return (keyed.select("row_key", "doc_id").join(pairs, "row_key")
            .select("doc_id", "item_id", "coverage", "n_tiles", "longest_tile"))


def clean(docs: DataFrame, items: DataFrame, seed_words: int = SEED_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that :func:`contaminated` reports. All columns stay, whatever their names."""
    bad = landed(_pairs(_keyed(docs), items, seed_words, coverage)
                 .select(F.col("row_key").alias("k0"), F.lit(False).alias("stays")).distinct())
    return survivors(docs, [F.xxhash64("doc_id", F.coalesce("text", F.lit("")))], bad)
