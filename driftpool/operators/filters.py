"""Row filters and validations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpool.functions.clean import clean_text


def non_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    """keep rows whose cleaned text is non-empty; the text is replaced by
    its cleaned form."""
    return df.withColumn(text, clean_text(text)).where(F.length(text) > 0)


def news_in_price_range(vecs: DataFrame, bars: DataFrame, day: str = "day") -> DataFrame:
    """rows with day in [min bar day, max bar day], both inclusive.

    The bounds are scalar subqueries (Spark merges them into one aggregate of
    the bars and runs it once); the range test is a plain filter.
    """
    lo = bars.select(F.min(day)).scalar()
    hi = bars.select(F.max(day)).scalar()
    return vecs.where(F.col(day).between(lo, hi))


def previous_day_news(news: DataFrame, now: dt.datetime, offset_hours: int = 3,
                      date: str = "date", ordered: bool = True) -> DataFrame:
    """with D = date(now + offset) - 1 day, messages with
    D 00:00 <= date < D+1 00:00, newest first (``ordered``; off under an
    aggregate, which needs no sort). ``now`` is UTC wall time."""
    d = (now + dt.timedelta(hours=offset_hours)).date() - dt.timedelta(days=1)
    lo = dt.datetime.combine(d, dt.time())
    hi = lo + dt.timedelta(days=1)
    day = news.where((F.col(date) >= F.lit(lo).cast("timestamp_ntz"))
                     & (F.col(date) < F.lit(hi).cast("timestamp_ntz")))
    return day.orderBy(F.desc_nulls_first(date), F.desc("message_id")) if ordered else day


def required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """one row per required column: whether it is present, and how many rows
    hold a value in it (0 for a column that is not there). One aggregate pass."""
    have = set(df.columns)
    n = df.agg(*[(F.count(F.col(f"`{c}`")) if c in have else F.lit(0).cast("long")).alias(f"_{i}")
                 for i, c in enumerate(required)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"),
                              F.col(f"_{i}").alias("n_values")) for i, c in enumerate(required)])
    return n.select(F.inline(rows))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """F04 as a check: raise on any missing column, else return ``df``."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """drop rows with a NULL in any column (or in ``subset``)."""
    return df.na.drop(how="any", subset=subset)
