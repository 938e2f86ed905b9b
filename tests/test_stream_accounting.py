"""Every row a pool stream reads is pooled, late, open or undated."""

import pytest
from pyspark.sql import functions as F

from driftpool.streaming import streams

SCHEMA = "series string, ts timestamp_ntz, v array<double>"


def rows(spark, data):
    df = spark.createDataFrame([(s, t, [float(i), 1.0]) for i, (s, t) in enumerate(data)],
                               "series string, ts string, v array<double>")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select("series", "ts", "v")


def run(spark, tmp_path, data):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    rows(spark, data).coalesce(1).write.mode("append").parquet(src)
    streams.stream_daily_pool(spark, src, spark.read.parquet(src).schema, out, ckpt).awaitTermination()
    got = streams.pool_accounting(spark.read.parquet(src), streams.read_batches(spark, out)).collect()
    return {(r.series, str(r.day)): (r.n_source, r.n_pooled, r.n_late, r.n_open, r.n_undated) for r in got}


def test_late_open_and_undated_rows(spark, tmp_path):
    first = run(spark, tmp_path, [("a", "2020-01-01 10:00:00"), (None, "2020-01-01 11:00:00"),
                                  ("a", "2020-01-04 00:00:00"), ("a", None)])
    assert first == {("a", "2020-01-01"): (1, 1, 0, 0, 0), (None, "2020-01-01"): (1, 1, 0, 0, 0),
                     ("a", "2020-01-04"): (1, 0, 0, 1, 0), ("a", "None"): (1, 0, 0, 0, 1)}
    # a late row of a pooled day, one of a day never pooled, one of an open day
    second = run(spark, tmp_path, [("a", "2020-01-01 12:00:00"), ("b", "2020-01-02 12:00:00"),
                                   ("a", "2020-01-04 01:00:00")])
    assert second == {("a", "2020-01-01"): (2, 1, 1, 0, 0), (None, "2020-01-01"): (1, 1, 0, 0, 0),
                      ("b", "2020-01-02"): (1, 0, 1, 0, 0), ("a", "2020-01-04"): (2, 0, 0, 2, 0),
                      ("a", "None"): (1, 0, 0, 0, 1)}


@pytest.mark.parametrize("end, late", [("2020-01-03 00:00:00", 1), ("2020-01-02 23:59:59.999999", 0)])
def test_a_day_closes_when_the_watermark_reaches_its_end(spark, end, late):
    source = rows(spark, [("a", "2020-01-01 05:00:00"), ("a", end)])
    pooled = spark.createDataFrame([], "series string, day date, n_items long")
    got = {str(r.day): r for r in streams.pool_accounting(source, pooled).collect()}
    assert got["2020-01-01"].n_late == late and got["2020-01-01"].n_open == 1 - late
    assert streams.pool_accounting(source.limit(0), pooled).count() == 0
