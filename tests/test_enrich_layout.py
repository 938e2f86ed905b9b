"""Row-local encoder (U01 default) and input spreading."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftpool import fixtures as fx
from driftpool.functions.layout import spread
from driftpool.operators import enrich
from tests.conftest import SF001


def test_encoder_matches_brute_force(spark):
    """Every vector equals counts of md5 buckets of the text's tokens, L2
    normalised, computed in plain Python from the same token lists."""
    enc = enrich.encode_texts(fx.news(spark, SF001), "hash64", dim=64)
    rows = enc.select("input_text", enrich.tokens(F.col("input_text")).alias("toks"),
                      "embedding_vector", "embedding_size").collect()
    assert rows
    for r in rows:
        c = np.zeros(64)
        for t in r.toks:
            c[int(md5(t.encode()).hexdigest()[:6], 16) % 64] += 1
        n = np.sqrt((c * c).sum())
        want = (c / n if n else c).astype(np.float32)
        assert r.embedding_size == 64
        assert np.array_equal(np.array(r.embedding_vector, dtype=np.float32), want)


def test_encoder_hashes_once_under_pushdown(spark):
    """A filter Catalyst infers and pushes through the projection (explode's
    non-empty check) must not copy the token hashing per bucket: the bucket
    array is bound once, so md5 appears at most in the filter and the
    projection."""
    enc = enrich.encode_texts(fx.news(spark, SF001), "hash64", dim=64)
    q = enc.select("special_id", F.posexplode("embedding_vector").alias("i", "x")).where("x > 0")
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("md5(") <= 2
    assert q.count() > 0


def test_spread_is_the_callers_choice_and_runs_no_job(spark):
    sc = spark.sparkContext
    df = spark.range(0, 1000, numPartitions=1)
    sc.setJobGroup("spread-probe", "spread")
    try:
        wide = spread(df, 5)
        assert spread(df) is df
        assert sc.statusTracker().getJobIdsForGroup("spread-probe") == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.id for r in wide.collect()) == list(range(1000))
    assert wide.select(F.spark_partition_id()).distinct().count() == 5


@pytest.mark.parametrize("dim", [1, 7, 64, 1024])
def test_sparse_counts_and_dense_form(spark, dim):
    texts = ["", "  !! ", "a", "a a a", "a b c a b a", " ".join(f"w{i % 97}" for i in range(3000)), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", enrich.tokens(F.col("t")).alias("toks"),
                    enrich.hashed_token_counts(F.col("t"), dim).alias("s"),
                    enrich.hashed_token_vector(F.col("t"), dim).alias("v")).collect()
    for r in got:
        c = np.zeros(dim, int)
        for t in r.toks or []:
            c[int(md5(t.encode()).hexdigest()[:6], 16) % dim] += 1
        if r.toks is not None:
            assert [(x.bucket, x.n) for x in r.s] == [(int(b), int(c[b])) for b in np.flatnonzero(c)]
        n = np.sqrt((c * c).sum())
        assert np.array_equal(np.array(r.v, np.float32), (c / n if n else c).astype(np.float32))


def test_translate_into_nothing(spark, tmp_path):
    """An empty source, and a model that fails on every message, leave an empty table."""
    rows = spark.sql("SELECT 1L AS channel_id, id AS message_id, TIMESTAMP_NTZ '2020-01-01' AS date, "
                     "'text' AS text FROM range(5)")

    def broken():
        def fail(texts):
            raise ValueError("no model")
        return fail

    for source, model in ((rows.where("false"), None), (rows, broken)):
        got = enrich.translate_into(source, str(tmp_path / "none"), model)
        assert got.count() == 0 and got.columns == ["channel_id", "message_id", "date", "text"]
    assert enrich.translation_backlog(rows, str(tmp_path / "none")).count() == 5
    assert enrich.translate_into(rows, str(tmp_path / "none")).count() == 5
    assert enrich.translation_backlog(rows, str(tmp_path / "none")).count() == 0
