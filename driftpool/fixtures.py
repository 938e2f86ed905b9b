"""Derived inputs built by Spark from the given tables (see FIXTURES.md).

The reference reads news messages, stored vectors and daily price bars; none of
these ship with it, so they are derived from the driver's tables by fixed rules.
Each builder reads whole tables and returns a DataFrame; nothing is collected.
The DuckDB twins of these definitions live in ``driftpool.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the fixture rules (FIXTURES.md §2).
DAY_ZERO = "1995-01-01"
DAY_MOD_A = 23
DAY_MOD_B = 29
MINUTES_PER_DAY = 1440
LOADED_BEFORE = "1997-01-01"  # dup_target: rows of an earlier load (ship dates start 1995)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def day_from_id(id_col: Column) -> Column:
    offset = ((id_col % DAY_MOD_A) * (id_col % DAY_MOD_B)).cast("int")
    return F.date_add(F.lit(DAY_ZERO).cast("date"), offset)


def ts_from_id(id_col: Column) -> Column:
    minutes = (id_col % MINUTES_PER_DAY).cast("int")
    return F.timestamp_add("MINUTE", minutes, day_from_id(id_col).cast("timestamp_ntz"))


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, vec_id, ts, day, v array<float>, model_name)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.lit("all").alias("series"),
        F.col("vec_id"),
        ts_from_id(F.col("vec_id")).alias("ts"),
        day_from_id(F.col("vec_id")).alias("day"),
        F.col("embedding").alias("v"),
        F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model_name"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel_id, message_id, date, text) from documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.regexp_extract("source", r"(\d+)", 1).cast("bigint").alias("channel_id"),
        F.col("doc_id").alias("message_id"),
        ts_from_id(F.col("doc_id")).alias("date"),
        F.col("text"),
    )


def news_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages already processed (translated): the labelled documents."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id"))
    return news(spark, sf_dir).join(lab, "message_id", "left_semi")


DUP_KEY = ["l_orderkey", "l_linenumber"]
DUP_ORDINAL = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def dup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def dup_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target as an earlier load left it: first row per key of the rows
    shipped before LOADED_BEFORE."""
    from driftpool.sources.keyed import first_per_key

    old = dup_batch(spark, sf_dir).where(F.col("l_shipdate") < F.lit(LOADED_BEFORE).cast("timestamp_ntz"))
    return first_per_key(old, DUP_KEY, DUP_ORDINAL)


def bars(spark: SparkSession, sf_dir: str, multi: bool = False) -> DataFrame:
    """Daily bars from orders: (series, day, open, high, low, price, vol, change_pct)."""
    o = table(spark, sf_dir, "orders")
    series = F.col("o_orderpriority") if multi else F.lit("all")
    daily = (o.select(series.alias("series"), F.to_date("o_orderdate").alias("day"),
                      "o_orderkey", "o_totalprice")
             .groupBy("series", "day")
             .agg(F.min_by("o_totalprice", "o_orderkey").alias("open"),
                  F.max("o_totalprice").alias("high"),
                  F.min("o_totalprice").alias("low"),
                  F.max_by("o_totalprice", "o_orderkey").alias("price"),
                  F.count(F.lit(1)).cast("double").alias("vol")))
    w = Window.partitionBy("series").orderBy("day")
    return daily.withColumn(
        "change_pct", (F.try_divide(F.col("price"), F.lag("price").over(w)) - 1) * 100)


def _money(c: str) -> Column:
    return F.format_number(F.col(c), 2)


def bars_raw(spark: SparkSession, sf_dir: str, multi: bool = False) -> DataFrame:
    """``bars`` as the strings of a price CSV export."""
    b = bars(spark, sf_dir, multi)
    vol = F.col("vol").cast("bigint")
    vol_txt = (F.when(vol % 5 == 0, F.lit("-"))
               .when(vol % 5 == 1, F.concat(vol.cast("string"), F.lit("K")))
               .when(vol % 5 == 2, F.concat(vol.cast("string"), F.lit("M")))
               .when(vol % 5 == 3, F.concat(vol.cast("string"), F.lit("B")))
               .otherwise(F.lit("")))
    return b.select(
        "series",
        F.date_format("day", "MM/dd/yyyy").alias("date_str"),
        _money("price").alias("price_str"),
        _money("open").alias("open_str"),
        _money("high").alias("high_str"),
        _money("low").alias("low_str"),
        vol_txt.alias("vol_str"),
        F.when(F.col("change_pct").isNotNull(),
               F.format_string("%.2f%%", F.col("change_pct"))).alias("change_str"),
    )


def labels_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.col("quality").alias("y_true"),
                      (F.lit(1) - F.col("toxic")).alias("y_pred"))


def reg_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                 "l_quantity", "l_extendedprice")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return (li.join(p, li.l_partkey == p.p_partkey)
            .select("l_orderkey", "l_linenumber",
                    F.col("l_extendedprice").alias("y_true"),
                    (F.col("l_quantity") * F.col("p_retailprice")).alias("y_pred")))
