"""Queries of the llm operators: ``opN_<name>`` over their whole tables, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm import (
    exact,
    hpy_lm,
    license_index,
    mixing,
    ordinal_quality,
    radix_dedup,
    rendezvous,
    secret_cnn,
    segment_trees,
    superminhash,
    tiling,
    toxicity,
    whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy_lm.corpus_scores(table(spark, sf_dir, "documents"))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, from 2 on good and not toxic (by ``quality``). A good document of
    unknown toxicity has no grade. score: at least 1."""
    grade = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") != 0, 1).when(F.col("toxic") == 0, F.col("quality") + 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    return ordinal_quality.quality(table(spark, sf_dir, "documents"), labels)


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the contract asks for the digest of every text; the grouping does not use it
    digest = F.sha2(exact.normalised(F.col("text")).cast("binary"), 256)
    return (exact.groups(docs, carry={"text_sha256": digest})
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op8_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.licenses(table(spark, sf_dir, "documents"))


def op9_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_cnn.digest(secret_cnn.find_secrets(table(spark, sf_dir, "documents")))


def op10_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    white = whitening.whiten(vectors, whitening.fit_whitening(vectors))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.place(table(spark, sf_dir, "documents"))


def op13_segment_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_trees.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_ordinal_quality": op3_ordinal_quality,
    "op4_string_tiling": op4_string_tiling,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_superminhash": op6_superminhash,
    "op7_mix": op7_mix,
    "op8_license_index": op8_license_index,
    "op9_secret_cnn": op9_secret_cnn,
    "op10_radix_dedup": op10_radix_dedup,
    "op11_whitening": op11_whitening,
    "op12_rendezvous": op12_rendezvous,
    "op13_segment_trees": op13_segment_trees,
}

OP5_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER g = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST)
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
      FROM d GROUP BY source),
-- the sources that a cap has stopped, round by round
fill AS (
  SELECT 0 AS round, source, source_size, w, false AS capped FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w,
         capped OR w * level > 3.0 * source_size
  FROM (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(3.0 * source_size) FILTER (capped) OVER (), 0.0))
               / nullif(sum(w) FILTER (NOT capped) OVER (), 0) AS level FROM fill)
  WHERE round < (SELECT count(*) FROM s)),
done AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(3.0 * source_size) FILTER (capped) OVER (), 0.0))
               / nullif(sum(w) FILTER (NOT capped) OVER (), 0) AS level FROM fill WHERE round = (SELECT count(*) FROM s)),
goal AS (SELECT source, source_size, CAST(CASE WHEN capped THEN 3.0 * source_size ELSE w * level END AS DOUBLE) AS target FROM done),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM goal),
run AS (SELECT d.*, p.source_size, p.target, p.rounds, p.target - p.rounds * p.source_size AS budget,
               sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
               sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
        FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
-- hashes in order while they fit, and the first that does not if it comes nearer
cut AS (SELECT source, min(h) FILTER (upto > budget) AS edge FROM run GROUP BY source)
SELECT doc_id, run.source, size, source_size, target,
       CAST(size * (rounds + CASE WHEN edge IS NULL OR h < edge OR (h = edge AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run JOIN cut ON run.source IS NOT DISTINCT FROM cut.source
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n FROM kept GROUP BY lang),
own AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY ALL),
size AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM own GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c,
             1 + (1000000000 * (coalesce(o.c, 0) + 5)) // (coalesce(s.n, 0) + 5 * v.v) AS p,
             1 + (1000000000 * (k.total + 5)) // (v.n + 5 * v.v) AS q
      FROM g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang
      LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
      LEFT JOIN size s ON s.lang = g.lang AND s.source = g.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": OP5_SQL,
    "op7_mix": OP7_SQL,
    "op13_segment_trees": OP13_SQL,
}
