"""Parsers, projections, filters and sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpool import fixtures as fx
from driftpool.functions import clean as C
from driftpool.functions.vectors import explode_elements
from driftpool.operators import features, filters
from driftpool.plans.oracle import sql
from driftpool.plans.registry import register
from driftpool.session import shared_path
from driftpool.sources import io

R = 6
WS = "||".join(f"chr({ord(c)})" for c in C.PY_WHITESPACE)
PRICE_COLS = ("price", "open", "high", "low")


def _each(fn, cols=PRICE_COLS, suffix="_str"):
    return [fn(F.col(c + suffix)).alias(c) for c in cols]


def _duck_each(tmpl, cols=PRICE_COLS, suffix="_str"):
    return ", ".join(tmpl.format(x=c + suffix) + f" AS {c}" for c in cols)


# ---- P01, P02, P15, F01, S01: message text -------------------------------

@register("clean_text", sql(f"""
SELECT channel_id, message_id, trim(coalesce(text, ''), {WS}) AS text FROM news""", "news"))
def q_clean_text(spark, sf_dir):
    n = fx.news(spark, sf_dir)
    return n.select("channel_id", "message_id", C.clean_text("text").alias("text"))


@register("composite_key", sql("""
SELECT CAST(channel_id AS VARCHAR) || '_' || CAST(message_id AS VARCHAR) AS special_id, message_id
FROM news""", "news"))
def q_composite_key(spark, sf_dir):
    n = fx.news(spark, sf_dir)
    return n.select(C.composite_key("channel_id", "message_id").alias("special_id"), "message_id")


@register("headline_preview", sql("""
SELECT message_id, substring(text, 1, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END
       AS preview
FROM news""", "news"))
def q_headline_preview(spark, sf_dir):
    n = fx.news(spark, sf_dir)
    return n.select("message_id", C.headline_preview("text").alias("preview"))


@register("non_empty_text", sql(f"""
SELECT channel_id, message_id, trim(coalesce(text, ''), {WS}) AS text FROM news
WHERE length(trim(coalesce(text, ''), {WS})) > 0""", "news"))
def q_non_empty_text(spark, sf_dir):
    return filters.non_empty_text(fx.news(spark, sf_dir)).select(
        "channel_id", "message_id", "text")


@register("news_intake", sql("""
SELECT channel_id, message_id, date, text FROM news WHERE text IS NOT NULL AND text <> ''""",
                             "news"), timestamps="date")
def q_news_intake(spark, sf_dir):
    return io.news_intake(fx.news(spark, sf_dir))


# ---- P03-P10: price CSV strings --------------------------------------------

@register("price_strip_commas", sql(f"""
SELECT series, date_str, {_duck_each("TRY_CAST(replace({x}, ',', '') AS DOUBLE)")}
FROM bars_raw_multi""", "bars_raw_multi"))
def q_price_strip_commas(spark, sf_dir):
    r = fx.bars_raw(spark, sf_dir, multi=True)
    return r.select("series", "date_str", *_each(C.price_strip_commas))


@register("clean_numeric", sql(f"""
SELECT series, date_str,
  {_duck_each("CASE WHEN {x} IS NULL THEN 0.0 ELSE TRY_CAST(replace(replace({x}, ',', ''), '%', '') AS DOUBLE) END",
              PRICE_COLS + ("change",))}
FROM bars_raw_multi""", "bars_raw_multi"))
def q_clean_numeric(spark, sf_dir):
    r = fx.bars_raw(spark, sf_dir, multi=True)
    return r.select("series", "date_str", *_each(C.clean_numeric, PRICE_COLS + ("change",)))


@register("price_regex_coerce", sql(f"""
SELECT series, date_str, {_duck_each("TRY_CAST(regexp_replace({x}, '[^0-9.]', '', 'g') AS DOUBLE)")}
FROM bars_raw_multi""", "bars_raw_multi"))
def q_price_regex_coerce(spark, sf_dir):
    r = fx.bars_raw(spark, sf_dir, multi=True)
    return r.select("series", "date_str", *_each(C.price_regex_coerce))


@register("percent_parse", sql("""
SELECT series, date_str,
       TRY_CAST(rtrim(change_str, '%') AS DOUBLE) AS pct_rstrip,
       CASE WHEN replace(change_str, '%', '') = '' THEN 0.0
            ELSE TRY_CAST(replace(change_str, '%', '') AS DOUBLE) END AS pct_replace,
       TRY_CAST(regexp_replace(change_str, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS pct_regex
FROM bars_raw_multi""", "bars_raw_multi"))
def q_percent_parse(spark, sf_dir):
    r = fx.bars_raw(spark, sf_dir, multi=True)
    return r.select("series", "date_str",
                    C.percent_parse("change_str", "rstrip").alias("pct_rstrip"),
                    C.percent_parse("change_str", "replace").alias("pct_replace"),
                    C.percent_parse("change_str", "regex").alias("pct_regex"))


_U = f"upper(trim(vol_str, {WS}))"


@register("volume_kmb", sql(f"""
SELECT series, date_str, vol_str,
  CASE WHEN vol_str IS NULL THEN 0.0
       WHEN contains({_U}, 'K') THEN TRY_CAST(replace({_U}, 'K', '') AS DOUBLE) * CAST(1e3 AS DOUBLE)
       WHEN contains({_U}, 'M') THEN TRY_CAST(replace({_U}, 'M', '') AS DOUBLE) * CAST(1e6 AS DOUBLE)
       WHEN contains({_U}, 'B') THEN TRY_CAST(replace({_U}, 'B', '') AS DOUBLE) * CAST(1e9 AS DOUBLE)
       ELSE TRY_CAST({_U} AS DOUBLE) END AS vol
FROM bars_raw_multi""", "bars_raw_multi"))
def q_volume_kmb(spark, sf_dir):
    r = fx.bars_raw(spark, sf_dir, multi=True)
    return r.select("series", "date_str", "vol_str", C.volume_kmb("vol_str").alias("vol"))


_L = "replace(upper(vol_str), ',', '')"


@register("volume_km_lenient", sql(f"""
SELECT series, date_str, vol_str,
  CASE WHEN vol_str IS NULL OR vol_str = '-' THEN 0.0
       ELSE coalesce(CASE WHEN contains({_L}, 'K') THEN TRY_CAST(replace({_L}, 'K', '') AS DOUBLE) * CAST(1e3 AS DOUBLE)
                          WHEN contains({_L}, 'M') THEN TRY_CAST(replace({_L}, 'M', '') AS DOUBLE) * CAST(1e6 AS DOUBLE)
                          ELSE TRY_CAST({_L} AS DOUBLE) END, 0.0) END AS vol
FROM bars_raw_multi""", "bars_raw_multi"))
def q_volume_km_lenient(spark, sf_dir):
    r = fx.bars_raw(spark, sf_dir, multi=True)
    return r.select("series", "date_str", "vol_str", C.volume_km_lenient("vol_str").alias("vol"))


_S = "regexp_replace(coalesce(vol_str, ''), '[^0-9.KM]', '', 'g')"
_F = f"list_transform(string_split(replace(replace({_S}, 'K', '*1e3'), 'M', '*1e6'), '*'), lambda f: TRY_CAST(f AS DOUBLE))"


@register("volume_km_regex", sql(f"""
SELECT series, date_str, vol_str,
  CASE WHEN list_bool_and(list_transform({_F}, lambda v: v IS NOT NULL))
       THEN (CASE WHEN isnan(list_reduce(list_prepend(CAST(1 AS DOUBLE), {_F}), lambda a, b: a * b)) THEN 0.0
                  ELSE list_reduce(list_prepend(CAST(1 AS DOUBLE), {_F}), lambda a, b: a * b) END)
       ELSE 0.0 END AS vol
FROM bars_raw_multi""", "bars_raw_multi"))
def q_volume_km_regex(spark, sf_dir):
    r = fx.bars_raw(spark, sf_dir, multi=True)
    return r.select("series", "date_str", "vol_str", C.volume_km_regex("vol_str").alias("vol"))


@register("date_parse", sql("""
SELECT series, date_str, CAST(try_strptime(date_str, '%m/%d/%Y') AS DATE) AS day
FROM bars_raw_multi""", "bars_raw_multi"), dates="day")
def q_date_parse(spark, sf_dir):
    r = fx.bars_raw(spark, sf_dir, multi=True)
    return r.select("series", "date_str", C.date_parse("date_str").alias("day"))


@register("timestamp_to_day", sql("""
SELECT message_id, CAST(date AS DATE) AS day, date_trunc('day', date) AS midnight
FROM news""", "news"), dates="day", timestamps="midnight")
def q_timestamp_to_day(spark, sf_dir):
    n = fx.news(spark, sf_dir)
    return n.select("message_id", C.day_of("date").alias("day"),
                    C.midnight("date").cast("timestamp_ntz").alias("midnight"))


# ---- P11-P14 ----------------------------------------------------------------

@register("calendar_features", sql("""
SELECT series, day, CAST(isodow(day) - 1 AS INTEGER) AS day_of_week,
       CAST(month(day) AS INTEGER) AS month
FROM bars_multi""", "bars_multi"), dates="day")
def q_calendar_features(spark, sf_dir):
    b = fx.bars(spark, sf_dir, multi=True)
    return b.select("series", "day", C.day_of_week("day").alias("day_of_week"),
                    F.month("day").alias("month"))


@register("price_range", sql(f"""
SELECT series, day, round(CASE WHEN isfinite(r) THEN r ELSE 0.0 END, {R}) AS price_range
FROM (SELECT series, day,
             CASE WHEN price <> 0 THEN least(greatest((high - low) / price, -10.0), 10.0) END AS r
      FROM bars_multi)""", "bars_multi"), dates="day")
def q_price_range(spark, sf_dir):
    b = fx.bars(spark, sf_dir, multi=True)
    return b.select("series", "day",
                    F.round(C.price_range("high", "low", "price"), R).alias("price_range"))


def _dirty(b):
    v = F.col("vol") % 7
    return (F.when(v == 0, F.lit(float("inf"))).when(v == 1, F.lit(float("nan")))
            .when(v == 2, F.lit(float("-inf"))).otherwise(F.col("change_pct")))


@register("finite_or_zero", sql(f"""
SELECT series, day,
       round(CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.0 ELSE x END, {R}) AS feature
FROM (SELECT series, day,
             CASE WHEN vol % 7 = 0 THEN CAST('inf' AS DOUBLE) WHEN vol % 7 = 1 THEN CAST('nan' AS DOUBLE)
                  WHEN vol % 7 = 2 THEN CAST('-inf' AS DOUBLE) ELSE change_pct END AS x
      FROM bars_multi)""", "bars_multi"), dates="day")
def q_finite_or_zero(spark, sf_dir):
    """Volume-coded non-finite values (a stand-in for pct_change on zero
    volume) cleaned to 0."""
    b = fx.bars(spark, sf_dir, multi=True)
    return b.select("series", "day", F.round(C.finite_or_zero(_dirty(b)), R).alias("feature"))


@register("vector_dim", sql("""
SELECT vec_id, CAST(len(v) AS INTEGER) AS dim FROM vecs""", "vecs"))
def q_vector_dim(spark, sf_dir):
    return fx.vecs(spark, sf_dir).select("vec_id", C.vector_dim("v").alias("dim"))


# ---- F02-F05 ----------------------------------------------------------------

@register("news_in_price_range", sql("""
SELECT vec_id, day FROM vecs, (SELECT min(day) AS lo, max(day) AS hi FROM bars) b
WHERE day BETWEEN lo AND hi""", "vecs", "bars"), dates="day")
def q_news_in_price_range(spark, sf_dir):
    v = fx.vecs(spark, sf_dir).select("vec_id", "day")
    return filters.news_in_price_range(v, fx.bars(spark, sf_dir))


PREV_DAY_NOW = dt.datetime(1995, 1, 2, 20, 59)  # D = 1995-01-01 (UTC+3 day minus one)


@register("previous_day_news", sql("""
SELECT channel_id, message_id, date, text FROM news
WHERE date >= TIMESTAMP '1995-01-01 00:00:00' AND date < TIMESTAMP '1995-01-02 00:00:00'""",
                                   "news"), timestamps="date")
def q_previous_day_news(spark, sf_dir):
    return filters.previous_day_news(fx.news(spark, sf_dir), PREV_DAY_NOW)


# The price CSV columns the indicator job requires.
REQUIRED_PRICE_COLUMNS = ["Date", "Price", "Open", "High", "Low", "Change %"]


@register("required_columns", sql("""
SELECT 'Date' AS column_name, true AS present, count(date_str) AS n_values FROM bars_raw
UNION ALL SELECT 'Price', true, count(price_str) FROM bars_raw
UNION ALL SELECT 'Open', true, count(open_str) FROM bars_raw
UNION ALL SELECT 'High', true, count(high_str) FROM bars_raw
UNION ALL SELECT 'Low', true, count(low_str) FROM bars_raw
UNION ALL SELECT 'Change %', true, count(change_str) FROM bars_raw
UNION ALL SELECT 'Bid', false, 0""", "bars_raw"))
def q_required_columns(spark, sf_dir):
    """Over the exported price CSV; 'Bid' is a column it does not have."""
    path = shared_path(spark, "price-csv")
    io.write_price_csv(fx.bars_raw(spark, sf_dir), path)
    raw = spark.read.options(header="true").csv(path)  # names as exported, no inference
    return filters.required_columns(raw, [*REQUIRED_PRICE_COLUMNS, "Bid"]).withColumnRenamed(
        "column", "column_name")


@register("reject_infinite", sql(f"""
SELECT series, day, round(price, {R}) AS price, round(vol, {R}) AS vol FROM bars""", "bars"), dates="day")
def q_reject_infinite(spark, sf_dir):
    """Bars that passed the check for remaining NaN and Inf."""
    b = fx.bars(spark, sf_dir)
    return b.select("series", "day", *[F.round(C.finite_or_fail(c), R).alias(c)
                                       for c in ("price", "vol")])


@register("checked_vectors", sql("""
SELECT model_name, count(*) AS n_vectors, CAST(sum(len(v)) AS BIGINT) AS n_elements
FROM vecs GROUP BY model_name""", "vecs"))
def q_checked_vectors(spark, sf_dir):
    """Vectors stored with their size, read back and checked against it."""
    stored = fx.vecs(spark, sf_dir).select("model_name", "v", C.vector_dim("v").alias("size"))
    v = stored.select("model_name", C.checked_vector("v", "size").alias("v"))
    return v.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_vectors"),
                                       F.sum(F.size("v")).alias("n_elements"))


@register("drop_incomplete", sql(f"""
SELECT series, day, round(change_pct, {R}) AS change_pct, round(nc, {R}) AS next_change
FROM (SELECT series, day, change_pct,
             lead(change_pct) OVER (PARTITION BY series ORDER BY day) AS nc FROM bars_multi)
WHERE change_pct IS NOT NULL AND nc IS NOT NULL""", "bars_multi"), dates="day")
def q_drop_incomplete(spark, sf_dir):
    b = features.next_day_change(fx.bars(spark, sf_dir, multi=True))
    b = filters.drop_incomplete(b.select("series", "day", "change_pct", "next_change"))
    return b.select("series", "day", F.round("change_pct", R).alias("change_pct"),
                    F.round("next_change", R).alias("next_change"))


# ---- S03-S07, S09: sources and sinks ---------------------------------------

@register("price_csv_scan", sql("""
SELECT date_str, price_str, open_str, high_str, low_str, vol_str, change_str FROM bars_raw_multi""",
                                "bars_raw_multi"))
def q_price_csv_scan(spark, sf_dir):
    path = shared_path(spark, "price-csv")
    io.write_price_csv(fx.bars_raw(spark, sf_dir, multi=True), path)
    return io.read_price_csv(spark, path)


@register("news_csv_scan", sql("SELECT channel_id, message_id, date, text FROM news", "news"),
          timestamps="date")
def q_news_csv_scan(spark, sf_dir):
    path = shared_path(spark, "news-csv")
    io.write_csv(fx.news(spark, sf_dir), path)
    return io.read_csv(spark, path, io.NEWS_SCHEMA)


@register("csv_export", "SELECT * FROM orders", timestamps="o_orderdate")
def q_csv_export(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    path = shared_path(spark, "orders-csv")
    io.write_csv(orders, path)
    return io.read_csv(spark, path, orders.schema)


SQL_FILE_TEXT = """
SELECT o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY o_orderpriority
"""


@register("sql_file_query", SQL_FILE_TEXT)
def q_sql_file_query(spark, sf_dir):
    fx.table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    path = shared_path(spark, "query") + ".sql"
    spark.createDataFrame([(SQL_FILE_TEXT,)], "value string").coalesce(1).write.text(path)
    return io.sql_file_query(spark, path)


@register("vectors_for_model", sql(f"""
SELECT vec_id, ts, CAST(i AS INTEGER) AS i, round(CAST(x AS DOUBLE), {R}) AS x
FROM (SELECT vec_id, ts, unnest(range(len(v))) AS i, unnest(v) AS x FROM vecs
      WHERE model_name = 'm1')""", "vecs"), timestamps="ts")
def q_vectors_for_model(spark, sf_dir):
    v = io.vectors_for_model(fx.vecs(spark, sf_dir), "m1", columns=("vec_id", "ts", "v"),
                             ordered=True)
    return explode_elements(v, ["vec_id", "ts"])


@register("vector_text_parse", sql(f"""
SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(CAST(x AS FLOAT) AS DOUBLE), {R}) AS x
FROM (SELECT vec_id, unnest(range(len(p))) AS i, unnest(p) AS x
      FROM (SELECT vec_id, CAST(CAST(v AS VARCHAR) AS DOUBLE[]) AS p FROM vecs))""", "vecs"))
def q_vector_text_parse(spark, sf_dir):
    as_text = fx.vecs(spark, sf_dir).select("vec_id", F.to_json("v").alias("v_text"))
    parsed = as_text.select("vec_id", io.vector_text_parse("v_text").alias("p"))
    # compare as float32 (the source width): a shortest float text parsed as
    # double often ends in an exact ...5, where round() modes differ
    parsed = parsed.withColumn("p", F.col("p").cast("array<float>"))
    return explode_elements(parsed, ["vec_id"], "p")
