"""Landed ledger documents as JSON (A1-A3), one parser for batch and stream.

Accepted payload shapes, first match wins: an object with a ``data``,
``results`` or ``rows`` array; an object of arrays (columns); a top-level array;
one document. If a document of a payload has ``Entries``, only these count in that
payload: object entries become rows, array entries are flattened into rows, NULL ones give none.
Nested objects become dotted columns (``a.b``) where there are entries.

A payload is parsed once, as VARIANT; :func:`documents` takes any frame of payload texts, streaming
or not, and needs no schema. The shape is found for each payload, not for the folder. With ``multi_line``
each file is one payload; without it each line is one, and files are splittable. A payload larger than
a task should hold is read by :mod:`kontor.sources.json_split`. ``api_row`` orders the documents by
payload name, place of the payload in its file, and position in the payload, whatever files
a task happens to read together; it is a struct, compared field by field. A payload that cannot be read
raises when its documents are used; :func:`rejected_payloads` lists such payloads.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE_KEYS = ["data", "results", "rows"]


def read_payloads(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(payload, _source, _place): one row per payload text; blank files and lines are none."""
    place = F.struct(F.col("_metadata.file_path").alias("payload"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))
    text = spark.read.text(path, wholetext=multi_line)
    return (text.select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("_source"), place.alias("_place"))
            .filter(F.trim("payload", F.lit(" \t\r\n")) != ""))


def rejected_payloads(raw: DataFrame) -> DataFrame:
    """(payload, text) of the payloads that cannot be read."""
    return raw.filter(F.try_parse_json("payload").isNull()).select(F.col("_source").alias("payload"), F.col("payload").alias("text"))


# --- A1, A2: documents of a payload --------------------------------------------------------

def _list(v: Column) -> Column:
    """A VARIANT array as an array; NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _columns_as_rows(v: Column) -> Column:
    """Documents of an object of arrays; shorter arrays end in NULLs."""
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    lists = F.transform(F.map_values(fields), _list)

    def rows(own: Column) -> Column:
        keys, values = own["keys"], own["lists"]
        longest = F.array_max(F.transform(values, F.size))
        place = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(place, lambda i: F.to_variant_object(
            F.map_from_arrays(keys, F.transform(values, lambda x: F.get(x, i)))))

    # bound as a lambda variable, so that the arrays are made once and not for each document
    made = F.transform(F.array(F.struct(F.map_keys(fields).alias("keys"), lists.alias("lists"))), rows)
    good = (F.size(F.map_keys(fields)) > 0) & ~F.exists(F.map_values(fields), lambda x: _list(x).isNull())
    return F.when(good, F.element_at(made, 1))


def _entries(rows: Column) -> Column:
    """(pos, entry, document) of the documents of a payload, of their entries if one has any."""
    def entry_of(x: Column) -> Column:
        return F.try_variant_get(x, "$.Entries", "variant")

    def of(pos: Column, entry: Column, document: Column) -> Column:
        return F.struct(pos.cast("long").alias("pos"), entry.cast("long").alias("entry"), document.alias("document"))

    def expanded(x: Column, i: Column) -> Column:
        e = entry_of(x)
        one = F.when(e.isNull() | F.is_variant_null(e), F.array().cast("array<variant>")).otherwise(F.coalesce(_list(e), F.array(e)))
        return F.transform(one, lambda d, j: of(i, j, d))

    plain = F.transform(rows, lambda x, i: of(i, F.lit(0), x))
    return F.when(F.exists(rows, lambda x: entry_of(x).isNotNull()), F.flatten(F.transform(rows, expanded))).otherwise(plain)


def documents(payloads: DataFrame, entries: bool = True) -> DataFrame:
    """(_source, api_row, document, from_entry): the documents of (payload, _source, _place) as VARIANT,
    from a stream as well as from a table. Without ``entries`` documents keep their ``Entries``."""
    parsed = payloads.select("_source", "_place", F.try_parse_json("payload").alias("v"))
    v = F.col("v")
    unreadable = F.raise_error(F.concat(F.lit("unreadable payload: "), F.col("_source"))).cast("array<variant>")
    rows = F.when(v.isNull(), unreadable).otherwise(F.coalesce(
        _list(v), *[F.try_variant_get(v, f"$.{key}", "array<variant>") for key in ENVELOPE_KEYS], _columns_as_rows(v), F.array(v)))
    found = parsed.select("_source", "_place", rows.alias("rows"))
    has = F.exists("rows", lambda x: F.try_variant_get(x, "$.Entries", "variant").isNotNull())
    each = _entries(F.col("rows")) if entries else F.transform("rows", lambda x, i: F.struct(
        i.cast("long").alias("pos"), F.lit(0).cast("long").alias("entry"), x.alias("document")))
    # before the documents are dealt out: behind them it would be asked again for each one
    found = found.withColumn("from_entry", has if entries else F.lit(False))
    return (found.select("_source", "_place", "from_entry", F.inline(each))
            .select("_source", F.struct("_place.*", "pos", "entry").alias("api_row"), "document", "from_entry"))


# --- columns -------------------------------------------------------------------------------

def field(document: Column, name: str, kind: str = "string") -> Column:
    """One field of a VARIANT document; NULL if it is absent or of another kind."""
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(document, f"$['{quoted}']", kind)


def _as_ddl(schema_of_variant: str) -> str:
    """The schema of VARIANT documents as a Spark type: numbers with a fraction are doubles, what is NULL
    everywhere or of several kinds is text."""
    quoted = re.split(r"(`(?:[^`]|``)*`)", schema_of_variant)      # names stay as they are
    for i in range(0, len(quoted), 2):
        part = re.sub(r"DECIMAL\(\d+,\d+\)|\bFLOAT\b", "DOUBLE", quoted[i])
        part = re.sub(r"(?<=[ <])(VOID|VARIANT)(?=[,>])", "STRING", part)
        quoted[i] = re.sub(r"OBJECT(?=<)", "STRUCT", part)
    return "".join(quoted)


def typed(docs: DataFrame, schema: T.StructType | None = None, flatten: bool | None = None) -> DataFrame:
    """(_source, api_row, ...fields) of :func:`documents`. Without ``schema`` (the fields of a document) one
    read finds it. Nested objects become dotted columns with ``flatten``; by default if there are entries.
    What is no object comes as its text in ``value``."""
    doc = F.col("document")
    if schema is not None:
        fields = [field(doc, f.name, f.dataType.simpleString()).alias(f.name) for f in schema.fields]
        out = docs.select("_source", "api_row", *fields)
        return flatten_structs(out, keep=("_source", "api_row")) if flatten else out
    docs = docs.select("*", F.schema_of_variant(doc).alias("_kind"))
    is_object = F.coalesce(F.col("_kind").startswith("OBJECT<"), F.lit(False))
    # documents are first grouped by their own schema, which is a text; merging schemas is slow, so that is done
    # for one document of each, kept in the same read
    shape = F.regexp_replace(F.when(is_object, F.col("_kind")), r"DECIMAL\(\d+,\d+\)", "DOUBLE")
    shapes = docs.groupBy(shape.alias("shape")).agg(F.first(F.when(is_object, doc)).alias("d"), F.bool_or("from_entry").alias("entries"),
                                                    F.count_if(~is_object & ~F.is_variant_null(doc)).alias("others"))
    found = shapes.agg(F.bool_or("entries").alias("entries"), F.sum("others").alias("others"), F.schema_of_variant_agg("d").alias("kind")).first()
    kind = found["kind"] or ""
    out = docs.select("_source", "api_row", "document")
    if found["others"]:
        is_object = F.try_variant_get(doc, "$", "struct<_:string>").isNotNull()       # NULL for any other kind
        out = out.withColumn("value", F.when(~is_object, doc.cast("string")))
    if kind.startswith("OBJECT<") and kind != "OBJECT<>":
        out = out.withColumn("_d", F.try_variant_get(doc, "$", _as_ddl(kind))).select("*", "_d.*").drop("_d")
    out = out.drop("document")
    return flatten_structs(out, keep=("_source", "api_row")) if (found["entries"] if flatten is None else flatten) else out


def _flat_exprs(dtype: T.DataType, path: list[str], sep: str) -> list:
    if isinstance(dtype, T.StructType):
        out = []
        for f in dtype.fields:
            out.extend(_flat_exprs(f.dataType, path + [f.name], sep))
        return out
    return [F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))]


def flatten_structs(df: DataFrame, keep: tuple[str, ...] = (), sep: str = ".") -> DataFrame:
    """A3: nested structs -> ``a.b`` columns at any depth; arrays stay arrays."""
    exprs = [F.col(k) for k in keep]
    for f in df.schema.fields:
        if f.name not in keep:
            exprs.extend(_flat_exprs(f.dataType, [f.name], sep))
    return df.select(*exprs)


def unwrap_envelope(raw: DataFrame) -> DataFrame:
    """A1: the document rows of :func:`read_payloads`, with ``_source`` and ``api_row``; entries stay inside."""
    return typed(documents(raw, entries=False), flatten=False)


def read_ledger_documents(spark: SparkSession, path: str, schema: T.StructType | None = None,
                          multi_line: bool = True, split: bool = False) -> DataFrame:
    """A1-A3 together: landed payloads -> document rows with ``api_row``.

    Without ``schema`` (the fields of a document) it is inferred by one more read of the files;
    pass it for large landings whose shape is known. ``split``: payload files may be larger than a
    task should hold (see :mod:`kontor.sources.json_split`)."""
    if split:
        from kontor.sources.json_split import split_documents
        docs = split_documents(spark, path)
    else:
        docs = documents(read_payloads(spark, path, multi_line))
    return typed(docs, schema).drop("_source")
