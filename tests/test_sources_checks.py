
import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from driftpool import fixtures as fx
from driftpool.operators import features as W
from driftpool.operators import filters, joins, pooling
from driftpool.sources import io
from tests.conftest import SF001


def _dir(spark):
    return os.path.join(spark.sparkContext.getCheckpointDir(), f"t-{uuid.uuid4().hex}")


def test_news_intake_limit_counts_before_filter(spark):
    rows = [(1, 1, dt.datetime(2024, 1, 3), ""), (1, 2, dt.datetime(2024, 1, 2), "b"),
            (1, 3, dt.datetime(2024, 1, 1), "c"), (1, 4, None, "d")]
    df = spark.createDataFrame(rows, "channel_id long, message_id long, date timestamp_ntz, text string")
    got = [r.message_id for r in io.news_intake(df, limit=3).collect()]
    assert sorted(got) == [2, 4]  # newest 3 (NULL date first) = 4, 1, 2; then '' dropped


def test_sql_file_query(spark):
    path = _dir(spark) + ".sql"
    spark.createDataFrame([("   ",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(ValueError):
        io.sql_file_query(spark, path)
    p2 = _dir(spark) + ".sql"
    spark.createDataFrame([("CREATE OR REPLACE TEMP VIEW v1 AS SELECT 1 AS x",)], "value string") \
        .coalesce(1).write.text(p2)
    r = io.sql_file_query(spark, p2).first()
    assert r.statement == "create" and spark.table("v1").first().x == 1
    p3 = _dir(spark) + ".sql"
    spark.createDataFrame([("WITH t AS (SELECT 2 AS y) SELECT y FROM t;",)], "value string") \
        .coalesce(1).write.text(p3)
    assert io.sql_file_query(spark, p3).first().y == 2


def test_required_columns_missing(spark):
    df = spark.createDataFrame([(1, 2.0)], "Date int, Price double")
    with pytest.raises(ValueError, match="columns not found"):
        filters.require_columns(df, ["Date", "Price", "Change %"])
    rep = {r.column: r.present for r in filters.required_columns(df, ["Date", "Change %"]).collect()}
    assert rep == {"Date": True, "Change %": False}


def test_fanout_no_overlap_fails(spark):
    vecs = fx.vecs(spark, SF001)
    bars = fx.bars(spark, SF001).withColumn("day", F.date_add("day", 100000))
    with pytest.raises(ValueError, match="no item falls on a day"):
        joins.news_price_fanout_join(vecs, bars, check_overlap=True)


def test_feature_table_is_finite(spark):
    f = W.bar_feature_table(fx.bars(spark, SF001, multi=True))
    bad = f.select(*[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c)
                     for c in W.FEATURES]).first()
    assert all(v == 0 for v in bad) and f.count() > 0


def test_padded_requires_multi_item_day(spark):
    one = fx.vecs(spark, SF001).limit(1)
    with pytest.raises(ValueError):
        pooling.padded_daily_sequences(one, require_any=True)


def test_news_csv_round_trip_exact(spark):
    rows = [(1, 1, dt.datetime(2024, 1, 1), 'a "quoted", multi\nline\r\ntext '), (1, 2, None, ""),
            (2, 3, dt.datetime(2024, 1, 2), None)]
    df = spark.createDataFrame(rows, io.NEWS_SCHEMA)
    path = _dir(spark)
    io.write_csv(df, path)
    back = sorted(io.read_csv(spark, path, io.NEWS_SCHEMA).collect(), key=lambda r: r.message_id)
    assert [tuple(r) for r in back] == rows
