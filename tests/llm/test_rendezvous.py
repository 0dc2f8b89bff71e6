import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kontor.llm import registry as R
from kontor.llm import rendezvous
from tests.conftest import SF_SMALL


def test_query_against_python(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    out = R.QUERIES["op12_rendezvous"](spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    for shard in {r.shard for r in out}:
        own = sorted(r.slot for r in out if r.shard == shard)
        assert own == list(range(len(own)))


def test_edges(spark):
    rows = [(None, "a", "x")] * 40 + [(1, None, "y"), (1, "", "y"), (2, "é", None), (2, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("slot", F.lit(7)).withColumn("__ord_n", F.lit(1))
    out = rendezvous.place(df.repartition(5)).collect()
    assert len(out) == len(rows)
    assert len({r.shard for r in out if r.doc_id is None}) == 1 and len({r.shard for r in out if r.doc_id == 1}) == 1
    assert {(r.size, r.text_crc32) for r in out if r.doc_id == 1} == {(8, 0)}
    assert {r.size for r in out if r.doc_id == 2} == {10}
    for shard in {r.shard for r in out}:
        own = sorted(r.slot for r in out if r.shard == shard)
        assert own == list(range(len(own)))
    assert rendezvous.place(df.limit(0)).collect() == []


def test_weights_and_moves(spark):
    df = spark.range(40_000).withColumnRenamed("id", "k")
    weights = [1.0, 2.0, 0.0, 5.0]
    got = rendezvous.assign(rendezvous.assign(df, ["k"], weights, "now"), ["k"], [*weights, 2.0], "more")
    got = rendezvous.assign(got, ["k"], [1.0, 0.0, 0.0, 5.0], "less").collect()
    share = Counter(r.now for r in got)
    for s, w in enumerate(weights):
        want = 40_000 * w / 8
        assert abs(share[s] - want) <= 5 * math.sqrt(want)
    assert all(r.more in (r.now, 4) for r in got)                    # one more takes rows only into itself
    assert abs(sum(r.more == 4 for r in got) - 8_000) < 400
    assert all(r.less == r.now for r in got if r.now != 1)           # without one, only its own rows move
    with pytest.raises(ValueError):
        rendezvous.assign(df, ["k"], [0.0, 0.0])
