"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document is the set of its 5-word shingles. SuperMinHash gives every element a
random permutation of the signature slots; in step j it offers ``j + random`` to its
j-th slot. Slots keep the smallest offer. Steps stop as soon as j exceeds the largest
slot: for all but short texts after one or two of them.

Documents with the same set are one class from the start. Signatures are cut into
bands; equal bands are buckets of candidates. First every member is compared to the smallest
id of its bucket, which settles copies: a bucket whose members are now in one component is
done, however many pairs it has. In the others, the members outside the bucket's largest
component are held against all its members, in blocks of bounded size that a task compares
with numpy: signatures first, then the full sets of the members that have a near pair. A block
gives back at most one link for each component it meets, never a list of pairs. So no link
between two components is lost, no bucket is capped, no pair is checked in two buckets, and a
group of copies costs its size, not its square. Signatures only thin candidates (a true link
passes but for five standard deviations); links are confirmed on the full sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm import textkit as K
from kontor.llm.frames import bitmap, components, id_and_text, in_bitmap, landed, small_batches, survivors

WORDS, PERCENT = 5, 85
SLOTS = 128
MISSED = 1e-6                   # chance that no band of a link at the threshold is equal
DEVIATIONS = 5                  # standard deviations that a link at the threshold may lack in slots or sketch
BLOCK = 512                     # members on either side of a block
U = np.uint64


def band_of(percent: int, slots: int = SLOTS) -> int:
    """Slots a band: the most at which a link at the threshold is missed at most MISSED times; at
    0.85 25 bands of 5, at 0.80 32 bands of 4."""
    fits = [b for b in range(1, slots + 1) if (1 - (percent / 100) ** b) ** (slots // b) <= MISSED]
    return max(fits, default=1)


def sketch_most(percent: int, slots: int = SLOTS) -> int:
    """Most differing sketch bits of a link: 25 of 128 at 0.85 (9.6 expected), 30 at 0.80 (12.8)."""
    bits, p = min(slots, SLOTS), (1 - percent / 100) / 2
    return math.ceil(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def equal_least(percent: int, slots: int = SLOTS) -> int:
    """Least equal slots of a link: 88 of 128 at 0.85 (109 expected), 79 at 0.80 (102)."""
    p = percent / 100
    return max(0, math.floor(slots * p - DEVIATIONS * math.sqrt(slots * p * (1 - p))))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row, offsets). Fewer than ``n`` words: the
    whole sequence is the one shingle; no words: none."""
    h, first = K.word_hashes(data, offsets)
    hashes, _, row = K.sequence_hashes(h, first, n)
    count = np.diff(first)
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j in range(k):
                own = K.mix(own * U(0x9E3779B97F4A7C15) + h[first[short] + j])
            hashes, row = np.append(hashes, own + U(k)), np.append(row, short)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(offsets)))


def signatures(hashes: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each row's set: (rows, slots) of ``step << 32 | random``; rows
    without elements keep the largest value."""
    rows = len(offsets) - 1
    sig = np.full(rows * slots, np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    element = hashes
    perm: np.ndarray | None = None
    for j in range(slots):
        draw = K.mix(element + U((j * 0x9E3779B97F4A7C15 + 0x1F83D9ABFB41BD6B) % 2**64))
        k = j + ((draw >> U(32)) % U(slots - j)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            if perm is None:                # the first step of what goes on: replay step 0
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(element), 1))
                at = np.arange(len(element))
                perm[at, earlier], perm[:, 0] = 0, earlier
            at = np.arange(len(element))
            chosen = perm[at, k]
            perm[at, k] = perm[:, j]
            perm[:, j] = chosen
            slot = chosen.astype(np.int64)
        np.minimum.at(sig, row * slots + slot, (U(j) << U(32)) | (draw & U(0xFFFFFFFF)))
        # a row goes on while some slot may still fall below what step j + 1 can offer
        open_rows = (sig.reshape(rows, slots).max(axis=1, initial=0) >> U(32)) > U(j) if rows else np.empty(0, bool)
        go = open_rows[row]
        if not go.any():
            break
        if j == 0:
            earlier = k[go]
        else:
            perm = perm[go]
        element, row = element[go], row[go]
    return sig.reshape(rows, slots)


def _sign(n: int, slots: int, band: int):
    names = ["row_key", "n_shingles", "set_hash", "bands", "s1", "s2", "slots"]

    def run(batches):
        for batch in batches:
            for part in K.pieces(batch):
                hashes, offsets = shingle_sets(*K.buffer_of(part.column(1)), n)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(hashes + U(77)))))
                other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(hashes + U(99991)))))
                total = K.mix((sums[offsets[1:]] - sums[offsets[:-1]]) * U(31) + K.mix(other[offsets[1:]] - other[offsets[:-1]]))
                sig = signatures(hashes, offsets, slots)
                sig_bits = (K.mix(sig + U(5)) & U(1)).astype(np.uint8)
                sketch = np.packbits(sig_bits, axis=1).reshape(len(sig), -1)
                sketch = np.pad(sketch, ((0, 0), (0, 16 - sketch.shape[1]))) if sketch.shape[1] < 16 else sketch[:, :16]
                two = np.ascontiguousarray(sketch).view(np.int64).reshape(len(sig), 2)
                bands = np.zeros((len(sig), slots // band), np.uint64)
                for j in range(band):
                    bands = K.mix(bands * U(0x9E3779B97F4A7C15) + sig[:, : slots // band * band].reshape(len(sig), -1, band)[:, :, j])
                bands = bands + np.arange(slots // band, dtype=np.uint64) * U(0x632BE59BD9B4E019)
                width = slots // band
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) * width + 1, width, dtype=np.int32)),
                                                 pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(total.view(np.int64)), lists,
                     pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()),
                     pa.array([x.tobytes() for x in (K.mix(sig + U(9)) >> U(56)).astype(np.uint8)], pa.binary())], names=names)
    return run


def _sets_of(n: int, bits: np.ndarray):
    def run(batches):
        for batch in batches:
            keep = in_bitmap(bits, batch.column(0).to_numpy().view(np.uint64))
            for part in K.pieces(batch.filter(pa.array(keep))) if keep.any() else ():
                hashes, offsets = shingle_sets(*K.buffer_of(part.column(1)), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.LargeListArray.from_arrays(pa.array(offsets.astype(np.int64)), pa.array(hashes.view(np.int64))).cast(pa.list_(pa.int64()))],
                    names=["row_key", "elements"])
    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("set_a", "set_b"))
            keep = []
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _links(buckets: DataFrame, leaders: DataFrame, sets: DataFrame, percent: int, slots: int) -> DataFrame:
    """Confirmed links (a, b) between leaders and the members of their buckets."""
    lead = leaders.select("bucket", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s1").alias("t1"),
                          F.col("s2").alias("t2"), F.col("label").alias("lb"))
    sketch = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
    pairs = (buckets.join(lead, "bucket")
             .filter((F.col("label") != F.col("lb")) & (100 * F.least("n", "nb") >= percent * F.greatest("n", "nb"))
                     & (sketch <= sketch_most(percent, slots)))
             .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct())
    one = sets.select(F.col("id").alias("a"), F.col("elements").alias("set_a"))
    two = sets.select(F.col("id").alias("b"), F.col("elements").alias("set_b"))
    return landed(pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"))


# --- blocks: part of a bucket against part of it ----------------------------------------------

def _blocks(rows: DataFrame) -> DataFrame:
    """(block, query, main, ...rows): every bucket dealt into blocks. Queries are the members outside
    the bucket's largest component; each meets every member of its bucket in exactly one block."""
    by_label = rows.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    stats = by_label.groupBy("bucket").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top")).select(
        F.col("bucket").alias("of"), F.ceil(F.col("m") / BLOCK).alias("kt"),
        F.greatest(F.ceil((F.col("m") - F.col("top.c")) / BLOCK), F.lit(1)).alias("kq"), F.col("top.label").alias("main"))
    d = rows.join(stats, F.col("bucket") == F.col("of")).drop("of")
    i, j = F.pmod(F.xxhash64("id", F.lit(1)), F.col("kt")), F.pmod(F.xxhash64("id", F.lit(2)), F.col("kq"))
    last = F.lit(1)
    targets = d.withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kq") - last))).withColumn("query", F.lit(False))
    queries = (d.filter("label <> main").withColumn("j", j)
               .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kt") - last))).withColumn("query", F.lit(True)))
    dealt = targets.select(sorted(targets.columns)).unionByName(queries).withColumn("block", F.xxhash64("bucket", "i", "j"))
    return dealt.repartition("block").sortWithinPartitions("block").drop("i", "j", "kt", "kq")


def _each_block(batches):
    """Tables of one block each, from batches sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(batch.schema.get_field_index("block")).to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
            part = batch.slice(a, b - a)
            if held and held[0].column(part.schema.get_field_index("block"))[0].as_py() != key[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs_of(t: pa.Table, percent: int):
    """(query row, target rows that may be linked to it) of a block, by component, size and id."""
    label, n, ids = (t.column(c).to_numpy() for c in ("label", "n", "id"))
    query = t.column("query").to_numpy(zero_copy_only=False)
    main = t.column("main").to_numpy()
    targets = np.flatnonzero(~query)
    for q in np.flatnonzero(query):
        ok = (label[targets] != label[q]) & ((label[targets] == main[q]) | (ids[targets] > ids[q]))
        ok &= 100 * np.minimum(n[targets], n[q]) >= percent * np.maximum(n[targets], n[q])
        if ok.any():
            yield q, targets[ok]


def _first_shared(bands: np.ndarray, q: int, targets: np.ndarray, bucket: int) -> np.ndarray:
    """Which pairs have this bucket as their first common one."""
    same = bands[targets] == bands[q]
    return bands[q][same.argmax(axis=1)] == bucket


def _near(slots: int, percent: int):
    """Members of a bucket that have a pair whose signatures are near."""
    least = equal_least(percent, slots)

    def run(batches):
        for t in _each_block(batches):
            sig = np.frombuffer(b"".join(t.column("slots").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            bands = np.array(t.column("bands").to_pylist(), np.int64)
            bucket, ids = t.column("bucket")[0].as_py(), t.column("id").to_numpy()
            hit = np.zeros(t.num_rows, bool)
            for q, targets in _pairs_of(t, percent):
                near = targets[(sig[targets] == sig[q]).sum(axis=1) >= least]
                if len(near):
                    near = near[_first_shared(bands, q, near, bucket)]
                    hit[near] = True
                    hit[q] |= len(near) > 0
            if hit.any():
                found = np.unique(ids[hit])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), bucket)), pa.array(found)], names=["bucket", "id"])
    return run


def _links_of_blocks(percent: int):
    """At most one confirmed link for each component that a block can add to another."""
    def run(batches):
        for t in _each_block(batches):
            lists = t.column("elements").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            edges = lists.offsets.to_numpy().astype(np.int64)
            _, element = np.unique(lists.values.to_numpy()[edges[0]: edges[-1]], return_inverse=True)
            edges = edges - edges[0]
            bands = np.array(t.column("bands").to_pylist(), np.int64)
            label, n, ids, bucket = t.column("label").to_numpy().copy(), t.column("n").to_numpy(), t.column("id").to_numpy(), t.column("bucket")[0].as_py()
            flags = np.zeros(element.max(initial=0) + 1, bool)
            out = []
            for q, targets in _pairs_of(t, percent):
                targets = targets[label[targets] != label[q]]
                if not len(targets) or not len(targets := targets[_first_shared(bands, q, targets, bucket)]):
                    continue
                flags[element[edges[q]: edges[q + 1]]] = True
                size = edges[targets + 1] - edges[targets]
                first = np.cumsum(size) - size
                at = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(edges[targets], size)
                both = np.add.reduceat(flags[element[at]].astype(np.int64), first)
                flags[element[edges[q]: edges[q + 1]]] = False
                for x in targets[100 * both >= percent * (n[q] + n[targets] - both)]:
                    if label[x] != label[q]:
                        out.append((ids[q], ids[x]))
                        label[label == label[q]] = label[x]
            if out:
                a, b = (np.array(c, np.int64) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    return run


def linked(classes: DataFrame, sets: DataFrame, percent: int = PERCENT, slots: int = SLOTS) -> DataFrame:
    """Confirmed links (a, b) that join all classes which are linked at all.

    ``classes``: (id, n, bands, s1, s2, slots), one row per distinct set; ``sets``: (id, elements)."""
    members = classes.select("id", "n", "s1", "s2", F.explode("bands").alias("bucket"))
    busy = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("first")).filter("size > 1")
    state = landed(members.join(busy, "bucket").withColumn("label", F.col("id")))
    links = _links(state, state.filter("id = first"), sets, percent, slots)
    labels = components(links).withColumnRenamed("component", "label")
    state = landed(state.filter("size > 2").drop("label").join(labels, F.col("id") == F.col("node"), "left")
                   .select("bucket", "id", F.coalesce("label", "id").alias("label")))
    open_ = (state.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .filter("lo <> hi").select("bucket"))
    state = state.join(open_, "bucket", "left_semi").join(classes.select("id", "n", "bands", "slots"), "id")
    near = landed(_blocks(state).mapInArrow(_near(slots, percent), "bucket long, id long").distinct())
    rows = near.join(state.drop("slots"), ["bucket", "id"]).join(sets, "id")
    return landed(links.unionByName(_blocks(rows).mapInArrow(_links_of_blocks(percent), "a long, b long")))


def _placed(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, slots: int = SLOTS, band: int | None = None) -> DataFrame:
    """(row_key, doc_id, n_shingles, component) for every row of ``docs``; component is NULL without words."""
    small_batches(docs.sparkSession)
    base = id_and_text(docs).withColumn("row_key", F.xxhash64("doc_id", "text")).select("row_key", "text", "doc_id")
    signed = base.select("row_key", "text").mapInArrow(
        _sign(n, slots, band or band_of(percent, slots)), "row_key long, n_shingles long, set_hash long, bands array<long>, s1 long, s2 long, slots binary")
    signed = landed(signed)
    # one row per distinct set; its name is a row key of one of its members
    own = signed.filter("n_shingles > 0")
    classes = landed(own.groupBy("set_hash", F.col("n_shingles").alias("n")).agg(
        F.min("row_key").alias("id"), F.first("bands").alias("bands"), F.first("s1").alias("s1"), F.first("s2").alias("s2"),
        F.first("slots").alias("slots"))
        .filter("id is not null"))
    buckets = classes.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket")
    candidates = landed(buckets.join(shared, "bucket", "left_semi").select("id").distinct())
    bits = bitmap(candidates, "id")
    sets = landed(base.select("row_key", "text").mapInArrow(_sets_of(n, bits), "row_key long, elements array<long>")
                  .withColumnRenamed("row_key", "id").join(candidates, "id", "left_semi").dropDuplicates(["id"]))
    labels = components(linked(classes.join(candidates, "id", "left_semi"), sets, percent, slots))
    named = classes.join(labels, F.col("id") == F.col("node"), "left").select(
        F.col("set_hash").alias("of_set"), "n", F.coalesce("component", "id").alias("component"))
    ids = base.select("row_key", "doc_id")
    return landed(ids.join(signed.select("row_key", "n_shingles", "set_hash").dropDuplicates(["row_key"]), "row_key")
                  .join(named, (F.col("set_hash") == F.col("of_set")) & (F.col("n_shingles") == F.col("n")), "left")
                  .select("row_key", "doc_id", "n_shingles", "component"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two rows are linked if their shingle sets have a Jaccard similarity of at least
    ``percent`` / 100; component_id is the smallest doc_id reachable. Texts that are NULL or
    have no words are alone; rows with a NULL id are linked like others, but never name
    a component unless all its ids are NULL; kept is doc_id = component_id (rows that
    repeat a doc_id are all kept, false for NULL ids in a component with others). Other columns
    are ignored; an empty table gives an empty table."""
    placed = _placed(docs, **how)
    some = placed.filter("component is not null")
    first = some.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    rows = (some.join(first, "component").select("doc_id", "n_shingles", "component_id")
            .unionByName(placed.filter("component is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest doc_id (NULL
    last). All columns stay, whatever their names.

    Rows are told apart by (doc_id, text), so rows that share an id, or have none, each get their
    own decision; of wholly equal (id, text) rows one stays. Rows without words all stay."""
    some = _placed(docs, **how).filter("component is not null")
    keys = some.groupBy("component", "row_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    best = keys.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "row_key")).alias("best"))
    decided = landed(keys.join(best, "component")
                     .select(F.col("row_key").alias("k0"), "n", (F.col("row_key") == F.col("best.row_key")).alias("stays"))
                     .filter("not stays or n > 1").drop("n"))
    return survivors(docs, [F.xxhash64("doc_id", F.coalesce("text", F.lit("")))], decided)
