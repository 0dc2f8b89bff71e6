"""Source divergence audit: how far the term shares of the sources of a language are apart.

The counts of a group (language, source) over the kept terms of its language are the leaves
of a segment tree over term ids. Trees are hash-consed: equal subtrees of counts, in one
group or in several, are one node, so a stretch of terms that two sources do not use, or use
alike, is stored once. The distance of two groups is found by walking their two trees at the
same time; a pair of nodes that has been met is not priced again.

Term ids are cut into blocks by a hash of the term, one subtree each, and groups into tiles.
A task holds one block of one or two tiles, about ENTRIES counts and 2 * TILE groups, however
many terms and sources a language has; the upper levels of the trees are the sums over blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm import textkit as K
from kontor.llm.frames import landed, small_batches

MIN_DOCS, TOP = 30, 50
ENTRIES, TILE = 1 << 14, 64
PAIRS = 1 << 21                 # node pairs priced at once
SCALE, EXTRA = 1_000_000_000, 5
#: bytes of terms: letters, and all of the characters that take several bytes
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# --- counting --------------------------------------------------------------------------

def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(terms in order, the row of each) of UTF-8 texts; only A-Z is lower-cased."""
    inside = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1])) if len(data) else np.empty(0, np.int64)
    kept = K.LOWER[data[inside]]
    before = np.cumsum(inside) - inside if len(data) else inside
    bounds = np.append(before[start], len(kept)).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds.tobytes()), pa.py_buffer(kept.tobytes()))
    return terms.dictionary_encode(), np.searchsorted(offsets, start, side="right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of pieces of the table; a row without term for each group met."""
    for batch in batches:
        for part in K.pieces(batch, most=8 << 20):
            lang, source = (part.column(i).dictionary_encode() for i in (0, 1))
            width = len(source.dictionary)
            group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
            terms, row = terms_of(*K.buffer_of(part.column(2)))
            v = max(1, len(terms.dictionary))
            per_row, n = np.unique(row * v + terms.indices.to_numpy(), return_counts=True)
            keys, back = np.unique(group[per_row // v] * v + per_row % v, return_inverse=True)
            total = np.bincount(back, n, len(keys)).astype(np.int64)
            docs = np.bincount(back, minlength=len(keys)).astype(np.int64)
            met = np.unique(group)
            of = np.concatenate([met, keys // v])
            term = pa.concat_arrays([pa.nulls(len(met), pa.string()), terms.dictionary.take(pa.array(keys % v)).cast(pa.string())])
            none = np.zeros(len(met), np.int64)
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(of // width)), source.dictionary.take(pa.array(of % width)), term,
                 pa.array(np.concatenate([none, total])), pa.array(np.concatenate([none, docs]))],
                names=["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a
    row with a NULL term for every group. NULL text, lang and source count as ''."""
    small_batches(docs.sparkSession)
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = slim.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- trees -----------------------------------------------------------------------------

def share(count, size):
    """1 + floor(SCALE * (count + EXTRA) / size), exact in 64 bits: the digits of the quotient, three at a time."""
    out, left = np.divmod(count + EXTRA, size)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, size)
        out = out * 1000 + digit
    return out + 1


def hash_cons(leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Trees over the rows of ``leaves`` (a power of two wide): the distinct leaves, for each level
    upwards the (left, right) of its distinct nodes, and the root of each row."""
    values, nodes = np.unique(leaves, return_inverse=True)
    nodes, size, levels = nodes.reshape(leaves.shape), len(values), []
    while nodes.shape[1] > 1:
        both, back = np.unique(nodes[:, ::2] * size + nodes[:, 1::2], return_inverse=True)
        levels.append((both // size, both % size))
        nodes, size = back.reshape(len(nodes), -1), len(both)
    return values, levels, nodes[:, 0]


def distances(trees, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the leaves of |share in a - share in b| for pairs of rows of :func:`hash_cons`;
    ``size``: the denominator of each row. Leaves below 0 are padding.

    The pairs walk down level by level; a pair of nodes under one pair of denominators is kept
    once a level, and its price is handed back to all who met it."""
    values, levels, roots = trees
    sizes, kind = np.unique(size, return_inverse=True)
    widths = [len(values), *(len(left) for left, _ in levels)]
    w = widths[-1]
    keys, back = np.unique(((kind[a] * len(sizes) + kind[b]) * w + roots[a]) * w + roots[b], return_inverse=True)
    met = []
    for (left, right), below in zip(reversed(levels), reversed(widths[:-1]), strict=True):
        pair, x, y = keys // (w * w), keys // w % w, keys % w
        down = [(pair * below + side[x]) * below + side[y] for side in (left, right)]
        keys, at = np.unique(np.concatenate(down), return_inverse=True)
        met.append((at[: len(x)], at[len(x):]))
        w = below
    pair, x, y = keys // (w * w), values[keys // w % w], values[keys % w]
    price = np.abs(share(np.maximum(x, 0), sizes[pair // len(sizes)]) - share(np.maximum(y, 0), sizes[pair % len(sizes)]))
    price[x < 0] = 0
    for left, right in reversed(met):
        price = price[left] + price[right]
    return price[back]


def _price(table: pa.Table) -> pa.Table:
    """Distances (lang, a, b, value) within one block, between the groups of a tile or of two."""
    names = ("lang", "source", "term", "n", "size", "width", "tile", "first", "second")
    t = {c: table.column(c).combine_chunks() for c in names}
    is_group = t["term"].is_null().to_numpy(zero_copy_only=False)
    source = t["source"].dictionary_encode()
    code, groups = source.indices.to_numpy(), len(source.dictionary)
    size, tile = np.ones(groups, np.int64), np.zeros(groups, np.int64)
    size[code[is_group]] = t["size"].to_numpy()[is_group]
    tile[code[is_group]] = t["tile"].to_numpy()[is_group]
    first, second, width = (t[c].to_numpy()[is_group][0] for c in ("first", "second", "width"))
    term = t["term"].filter(pa.array(~is_group)).dictionary_encode()
    m, n = len(term.dictionary), t["n"].to_numpy()[~is_group]
    # frequent terms first, so that what few groups use lies together
    place = np.empty(m, np.int64)
    place[np.argsort(-np.bincount(term.indices.to_numpy(), n, m), kind="stable")] = np.arange(m)
    leaves = np.zeros((groups, 1 << max(0, m - 1).bit_length()), np.int64)
    leaves[:, m:] = -1
    leaves[code[~is_group], place[term.indices.to_numpy()]] = n
    trees = hash_cons(leaves)
    own, other = np.flatnonzero(tile == first), np.flatnonzero(tile == second)
    a, b = (x.ravel() for x in np.meshgrid(own, other, indexing="ij"))
    if first == second:
        a, b = a[a < b], b[a < b]
    value = np.zeros(len(a), np.int64)
    step = max(1, PAIRS // leaves.shape[1])
    for i in range(0, len(a), step):
        value[i: i + step] = distances(trees, size, a[i: i + step], b[i: i + step])
    if width > m:       # terms of the block that no group here uses
        value += (width - m) * np.abs(share(0, size[a]) - share(0, size[b]))
    return pa.table({"lang": pa.repeat(t["lang"][0], len(a)), "a": source.dictionary.take(pa.array(a)),
                     "b": source.dictionary.take(pa.array(b)), "value": pa.array(value)})


# --- the audit -------------------------------------------------------------------------

def _share_sql(count: str, size: str) -> str:
    """:func:`share` as SQL over two columns."""
    left, out = f"({count} + {EXTRA})", f"(({count} + {EXTRA}) div {size})"
    for _ in range(3):
        left = f"({left} % {size} * 1000)"
        out = f"({out} * 1000 + {left} div {size})"
    return f"({out} + 1)"


def _pairs(own: DataFrame, kept: DataFrame, groups: DataFrame, entries: int, tile: int) -> DataFrame:
    """(lang, a, b, value): the distance of each two groups of a language, once."""
    plan = (groups.groupBy("lang").agg(F.count("*").alias("g"), F.sum("entries").alias("e"))
            .select("lang", F.greatest(F.ceil(F.col("e") / entries), F.lit(1)).cast("long").alias("blocks"),
                    F.ceil(F.col("g") / tile).cast("long").alias("tiles")))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    width = kept.join(plan, "lang").groupBy("lang", block).agg(F.count("*").alias("width"))
    none = F.lit(0).cast("long")
    counted = own.join(plan, "lang").select("lang", block, "source", "term", "n", none.alias("size"), none.alias("width"), "tiles")
    sized = (groups.join(plan, "lang")
             .select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "size", "tiles")
             .join(width, ["lang", "block"], "left")
             .select("lang", "block", "source", F.lit(None).cast("string").alias("term"), none.alias("n"), "size",
                     F.coalesce("width", none).alias("width"), "tiles"))
    rows = counted.unionByName(sized).withColumn("tile", F.pmod(F.xxhash64("source", F.lit(3)), F.col("tiles")))
    rows = (rows.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
            .select("lang", "block", "source", "term", "n", "size", "width", "tile",
                    F.least("tile", "to").alias("first"), F.greatest("tile", "to").alias("second")))
    priced = rows.groupBy("lang", "block", "first", "second").applyInArrow(_price, "lang string, a string, b string, value long")
    # a tile pair that holds one tile of groups alone has no pairs; codes within a task order a and b
    return priced.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, entries: int = ENTRIES, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) of ``docs``.

    Part 'pair': each other source of the language and the distance to it, all ranks. Part 'term':
    the kept terms (in ``min_docs`` documents of the language or more) that the group uses more than its
    language does, ranks up to ``top``. Ranks start from 1 by falling value, then by item.

    NULL text, lang and source count as ''; a group without terms has distances too; repeated rows
    count each; a language with one source has no pairs; other columns are ignored; an empty table gives an
    empty table. Exact for up to 9 * 10^15 occurrences of kept terms a language."""
    found = landed(counts(docs))
    kept = landed(found.filter("term is not null").groupBy("lang", "term")
                  .agg(F.sum("docs").alias("d"), F.sum("n").alias("total")).filter(F.col("d") >= min_docs).drop("d"))
    own = landed(found.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    by_group = own.groupBy("lang", "source").agg(F.count("*").alias("entries"), F.sum("n").alias("n_group"))
    zero = F.lit(0).cast("long")
    groups = landed(
        found.filter("term is null").select("lang", "source")
        .join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("entries", zero).alias("entries"), F.coalesce("v", zero).alias("v"),
                (F.coalesce("n_group", zero) + F.lit(EXTRA) * F.coalesce("v", zero)).alias("size"),
                (F.coalesce("n_lang", zero) + F.lit(EXTRA) * F.coalesce("v", zero)).alias("lang_size")))
    pairs = landed(_pairs(own, kept, groups.withColumn("size", F.greatest("size", F.lit(1))), entries, tile))
    both = (pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
            .unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    far = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = (own.join(groups, ["lang", "source"])
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     F.expr(f"{_share_sql('n', 'size')} - {_share_sql('total', 'lang_size')}").alias("value"))
             .filter("value > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return far.unionByName(terms)
