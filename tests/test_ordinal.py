"""The bucketed ordinal equals a plain row_number window."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from kontor.operators.ordinal import ordinal, ordinal_by_index


def test_ordinal_matches_row_number(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("abc"), rnd.randrange(1000), rnd.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, x double")
    got = ordinal(df, ["g"], [F.col("k"), F.col("x")], F.floor(F.col("k") / 37), out="n")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k", "x")))
    assert sorted(map(tuple, got.select("g", "k", "x", "n").collect())) == \
        sorted(map(tuple, want.select("g", "k", "x", "n").collect()))


def test_ordinal_by_sparse_index(spark):
    df = spark.createDataFrame([("f", i * 3) for i in range(500)] + [("g", 7)], "file_id string, idx long")
    got = ordinal_by_index(df, ["file_id"], "idx", out="n", start=5, bucket_rows=64)
    m = {(r.file_id, r.idx): r.n for r in got.collect()}
    assert m[("f", 0)] == 5 and m[("f", 3 * 499)] == 504 and m[("g", 7)] == 5
