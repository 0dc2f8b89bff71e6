"""Incremental landing of ledger document payloads (A10 as a stream).

New payload files arriving in a folder are parsed (A1), typed and prepared
(B1-B9), and appended to the document table partitioned by landing day.
The file source and the parquet sink with a checkpoint location give
exactly-once landing across restarts; ``availableNow`` processes what is
there and stops, so the same job serves scheduled batch runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kontor.operators.prepare import prepare
from kontor.sources.ledger_json import documents, field

DOCUMENT_FIELDS = ["BELEGNR", "ORDER_ID", "KUNDENNR", "NAME1", "NAME2", "BELEGDAT", "LIEFERDAT", "ORIGIN",
                   "ISOA2_LAND", "BELEGART", "ZAHLART", "NETTO", "BRUTTO", "ERLOES"]


#: of payload files in one step of the stream; what a step costs besides its files does not add up with small ones
STEP_BYTES = 1 << 30


def document_stream(spark: SparkSession, inbox: str, max_files: int | None = None, multi_line: bool = True,
                    fields: tuple[str, ...] = ()) -> DataFrame:
    """Streaming documents from the payloads in ``inbox``: one payload per file (``multi_line``) or one
    per line, in every shape that the batch reader takes, by the same parser
    (:func:`kontor.sources.ledger_json.documents`); one that cannot be read stops the stream.

    Known fields and ``fields`` become columns, of nested objects by their dotted name; ``document`` keeps the whole JSON of each
    document, so a field that nobody has named is not lost. A step takes ``max_files`` files, by default STEP_BYTES of them. ``api_row`` orders the documents as the batch reader does."""
    # a file is one row also with one payload a line: a stream has no other order of lines
    payloads = F.array("value") if multi_line else F.split("value", "\r?\n")
    step = ("maxFilesPerTrigger", max_files) if max_files else ("maxBytesPerTrigger", STEP_BYTES)
    text = (spark.readStream.option(*step).text(inbox, wholetext=True)
            .select(F.col("_metadata.file_path").alias("_source"), F.posexplode(payloads).alias("line", "payload"))
            .filter(F.trim("payload", F.lit(" \t\r\n")) != "")
            .select("payload", "_source", F.struct(F.col("_source").alias("payload"), F.lit(0).cast("long").alias("block"),
                                                   F.col("line").cast("long").alias("line")).alias("_place")))
    wanted = [*DOCUMENT_FIELDS, *[f for f in fields if f not in DOCUMENT_FIELDS]]
    found = documents(text)
    doc = F.col("document")
    # a dotted name is a path unless the document has a field of that very name
    columns = [F.coalesce(field(doc, f), *([F.try_variant_get(doc, "$" + "".join(f"['{p}']" for p in f.split(".")), "string")] if "." in f else [])).alias(f)
               for f in wanted]
    docs = found.select(F.col("_source").alias("source"), F.col("api_row.pos").cast("int").alias("pos"), "api_row",
                        F.to_json(doc).alias("document"), *columns)
    return prepare(docs).withColumn("landed_day", F.current_date())


def land_documents(spark: SparkSession, inbox: str, table_path: str, checkpoint: str,
                   available_now: bool = True, multi_line: bool = True, fields: tuple[str, ...] = ()) -> StreamingQuery:
    w = (document_stream(spark, inbox, multi_line=multi_line, fields=fields).writeStream.format("parquet").option("path", table_path)
         .option("checkpointLocation", checkpoint).partitionBy("landed_day").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
