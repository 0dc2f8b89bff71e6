"""Documents of payload files of any size: one payload may span many tasks (A1).

A file is read in pieces that end at a closing brace, so the text source can split it
anywhere, pretty-printed or on one line. Whether a piece starts inside a quoted text, and how
deep in brackets, follows from the quotes and brackets before it: counted within an
input split (for both cases of its start), then over the splits of a file, so no task holds a
payload. A document ends where the depth is back at that of its array, and the pieces of
one document meet in one row; from there on it is the parser of
:mod:`kontor.sources.ledger_json`.

Taken apart are top-level arrays and objects with ``data``, ``results`` or ``rows``; elements of
these arrays that are no objects are no documents here. A payload of another shape (columns, one document) is put
together again as a whole. A payload whose brackets or quotes do not close raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.session import landed
from kontor.sources.ledger_json import ENVELOPE_KEYS, documents

SPACE = " \t\r\n"
#: a key and the bracket that opens its value, once escapes are removed
OPENING = r'"([^"]*)"\s*:\s*([\[{])'


def _count(text: Column, chars: str) -> Column:
    """How often one of ``chars`` stands in ``text``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _plain(text: str) -> Column:
    return F.regexp_replace(text, r"(?s)\\.", "")


def _outside(text: Column) -> Column:
    """What stands outside of quoted texts, escapes being removed before."""
    return F.regexp_replace(text, r'"[^"]*+(?:"|\z)', "")


def _depth(outside: Column) -> Column:
    return _count(outside, "[{") - _count(outside, "]")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, block, line, text, plain): records that end at a brace, without it; ``plain`` is
    ``text`` without escape pairs, so that each of its quotes opens or closes a text."""
    text = spark.read.text(path, lineSep="}")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                       F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
                       F.col("value").alias("text"), _plain("value").alias("plain"))


def _placed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``inside`` (starts in a quoted text), ``depth`` at its start and ``after`` its brace,
    and for the file ``balanced``: everything closes, and ``tail``: the brace at its end, if any. The pieces are counted
    once and written with their counts; whatever follows reads the columns that it needs."""
    own = Window.partitionBy("file", "block").orderBy("line")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    p = pieces.withColumn("quotes", _count(F.col("plain"), '"'))
    p = p.withColumn("seen", F.coalesce(F.sum("quotes").over(before), zero))
    for start in (0, 1):        # the split starts outside or inside of a quoted text
        inside = (F.col("seen") + start) % 2 == 1
        # the brace at the end counts unless it is quoted
        step = (_depth(_outside(F.when(inside, F.concat(F.lit('"'), F.col("plain"))).otherwise(F.col("plain"))))
                - F.when((F.col("seen") + F.col("quotes") + start) % 2 == 1, 0).otherwise(1))
        p = p.withColumn(f"step{start}", step)
        p = p.withColumn(f"deep{start}", F.coalesce(F.sum(f"step{start}").over(before), zero))
    p = landed(p.drop("plain"), "pieces")
    blocks = p.groupBy("file", "block").agg(F.sum("quotes").alias("q"), F.sum("step0").alias("s0"), F.sum("step1").alias("s1"),
                                            F.sum(F.octet_length("text") + 1).alias("bytes"), F.max("size").alias("size"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    blocks = blocks.withColumn("odd", F.coalesce(F.sum("q").over(upto), zero) % 2)
    blocks = blocks.withColumn("s", F.when(F.col("odd") == 1, F.col("s1")).otherwise(F.col("s0")))
    # the last piece of a file has no brace unless the file ends with one
    open_end = F.when(F.sum("bytes").over(whole) > F.max("size").over(whole), 1).otherwise(0)
    blocks = blocks.select("file", "block", "odd", F.coalesce(F.sum("s").over(upto), zero).alias("base"),
                           ((F.sum("q").over(whole) % 2 == 0) & (F.sum("s").over(whole) + open_end == 0)).alias("balanced"),
                           F.when(open_end == 1, F.lit("")).otherwise(F.lit("}")).alias("tail"))
    p = p.join(landed(blocks, "blocks"), ["file", "block"])        # a row a split: the pieces stay where they are
    odd = F.col("odd") == 1
    depth = F.col("base") + F.when(odd, F.col("deep1")).otherwise(F.col("deep0"))
    return p.select("file", "block", "line", "text", "balanced", "tail", ((F.col("seen") + F.col("odd")) % 2 == 1).alias("inside"),
                    depth.alias("depth"), (depth + F.when(odd, F.col("step1")).otherwise(F.col("step0"))).alias("after"))


def _arrays(placed: DataFrame) -> DataFrame:
    """One row per file: its ``root`` bracket, and for an object the piece where the array of documents
    opens (``first``, ``key``, ``skip`` equal openings before it in that piece) and where the next
    member opens (``last``)."""
    at = F.struct("block", "line")
    root = placed.filter(F.trim("text", F.lit(SPACE)) != "").groupBy("file").agg(
        F.substring(F.min_by(F.ltrim("text", F.lit(SPACE)), at), 1, 1).alias("root"))
    # brackets open a member of the top-level object only where the depth comes down to 1
    near = placed.filter(F.col("depth") - _count(F.col("text"), "]") <= 1).withColumn("plain", _plain("text"))
    near = near.filter(F.col("depth") - _count(F.col("plain"), "]") <= 1)
    near = near.select("file", at.alias("at"), "depth", "inside", F.split("plain", OPENING).alias("parts"),
                       F.regexp_extract_all("plain", F.lit(OPENING), F.lit(1)).alias("keys"),
                       F.regexp_extract_all("plain", F.lit(OPENING), F.lit(2)).alias("kinds"))
    parts = F.transform("parts", lambda x, i: _depth(_outside(F.when((i == 0) & F.col("inside"), F.concat(F.lit('"'), x)).otherwise(x))))
    near = near.withColumn("steps", parts)

    def opened(key: Column, i: Column) -> Column:
        before = F.aggregate(F.slice("steps", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x)
        same = F.size(F.filter(F.slice("keys", F.lit(1), i), lambda k: k == key))
        return F.struct(key.alias("key"), F.get("kinds", i).alias("kind"), (F.col("depth") + before + i).alias("depth"),
                        i.alias("i"), same.alias("skip"))

    members = (near.select("file", "at", F.explode(F.transform("keys", opened)).alias("m")).filter("m.depth = 1")
               .select("file", F.struct("at", "m.i").alias("place"), "at", "m.key", "m.kind", "m.skip"))
    members = members.withColumn("next", F.lead("at").over(Window.partitionBy("file").orderBy("place")))
    order = F.array_position(F.array(*[F.lit(k) for k in ENVELOPE_KEYS]), F.col("key"))
    best = (members.filter((F.col("kind") == "[") & (order > 0)).groupBy("file")
            .agg(F.min(F.struct(order.alias("o"), "place", F.col("at").alias("first"), F.col("next").alias("last"), "key", "skip")).alias("b"))
            .select("file", "b.first", "b.last", "b.key", "b.skip"))
    return root.join(best, "file", "left")


def split_documents(spark: SparkSession, path: str) -> DataFrame:
    """(_source, api_row, document, from_entry) like :func:`kontor.sources.ledger_json.documents`, from
    files that hold one payload each. Blank files have none."""
    placed = _placed(_pieces(spark, path))
    p = placed.join(landed(_arrays(placed), "arrays"), "file").withColumn("at", F.struct("block", "line"))
    closes = F.raise_error(F.concat(F.lit("unreadable payload: "), F.col("file"))).cast("boolean")
    p = p.filter(F.when(F.col("balanced"), F.lit(True)).otherwise(closes))
    is_list, in_array = F.col("root") == "[", F.col("key").isNotNull()
    apart = is_list | in_array
    inner = F.when(is_list, 1).otherwise(2)
    # pieces of the array of documents; of other payloads, all
    p = p.filter(~apart | is_list | ((F.col("at") >= F.col("first")) & (F.col("last").isNull() | (F.col("at") < F.col("last")))))
    # what stands before the array goes; equal openings after it, inside of a document, are put back
    opening = F.concat(F.lit('"'), F.col("key"), F.lit('":['))
    spaced = F.concat(F.lit('"'), F.col("key"), F.lit(r'"\s*:\s*\['))
    parts = F.split("text", spaced)
    cut = F.aggregate(F.slice(parts, F.col("skip") + 3, F.size(parts)), F.get(parts, F.col("skip") + 1),
                      lambda a, x: F.concat(a, opening, x))
    p = p.withColumn("text", F.when(~is_list & in_array & (F.col("at") == F.col("first")), cut).otherwise(F.col("text")))
    end = apart & (F.col("after") == inner)
    p = p.withColumn("ends", F.when(end, 1).otherwise(0).cast("long"))
    own = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = landed(p.groupBy("file", "block").agg(F.sum("ends").alias("n")).select(
        "file", "block", F.coalesce(F.sum("n").over(upto), zero).alias("ended")), "ended")
    p = (p.withColumn("seen", F.coalesce(F.sum("ends").over(own), zero)).join(blocks, ["file", "block"])
         .withColumn("pos", F.col("ended") + F.col("seen")))
    texts = (p.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"),
                                          F.max(apart).alias("apart"), F.max("ends").alias("whole"), F.max("tail").alias("tail"))
             # after the last document there is only the end of the payload
             .filter("not apart or whole = 1"))
    joined = F.concat(F.array_join(F.col("t.text"), "}"), F.when(F.col("apart"), F.lit("}")).otherwise(F.col("tail")))
    place = F.struct(F.col("file").alias("payload"), zero.alias("block"), zero.alias("line"))
    texts = texts.select(F.col("file").alias("_source"), "pos", "apart", place.alias("_place"),
                         F.when(F.col("apart"), F.regexp_replace(joined, r"(?s)\A[^{]*+", "")).otherwise(joined).alias("payload"))
    return _documents_of(landed(texts, "documents"))


def _documents_of(texts: DataFrame) -> DataFrame:
    """Documents from texts of single documents (``apart``) and of whole payloads."""
    whole = documents(texts.filter("not apart").select("payload", "_source", "_place"))
    one = F.struct("payload", "pos")
    apart = texts.filter("apart").select("_source", "_place", one.alias("x"))
    unreadable = F.raise_error(F.concat(F.lit("unreadable payload: "), F.col("_source"))).cast("variant")
    v = F.try_parse_json("x.payload")
    apart = apart.select("_source", "_place", "x.pos", F.when(v.isNull(), unreadable).otherwise(v).alias("v"))
    entry = F.try_variant_get("v", "$.Entries", "variant")
    has = landed(apart.groupBy("_source").agg(F.bool_or(entry.isNotNull()).alias("from_entry")), "entries")
    listed = F.coalesce(F.try_variant_get("v", "$.Entries", "array<variant>"), F.array(entry))
    given = F.when(~F.col("from_entry"), F.array("v")).when(entry.isNotNull() & ~F.is_variant_null(entry), listed)
    apart = (apart.join(has, "_source").select("_source", "_place", "pos", "from_entry", F.posexplode(given).alias("entry", "document"))
             .select("_source", F.struct("_place.*", "pos", F.col("entry").cast("long").alias("entry")).alias("api_row"), "document", "from_entry"))
    return whole.unionByName(apart)
