"""Query registry: key -> (Spark builder, oracle SQL or None).

Builders take ``(spark, sf_dir)`` and return a DataFrame; they read the whole
given tables (or fixtures Spark derives from them). Oracle SQL runs in DuckDB
over the same tables, pre-registered as views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Comparable output: DATE and TIMESTAMP_NTZ columns as ISO text (their
    hash then does not depend on how a client library maps dates and time
    units)."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DateType, TimestampNTZType

    def show(f):
        if isinstance(f.dataType, DateType):
            return F.date_format(f.name, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, TimestampNTZType):
            return F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
        return F.col(f.name)

    return df.select(*[show(f) for f in df.schema.fields])


def register(key: str, oracle: str | None = None, dates: tuple[str, ...] | str = (),
             timestamps: tuple[str, ...] | str = ()):
    """Register a query; ``dates`` / ``timestamps`` name the DATE / TIMESTAMP
    columns of the oracle output, rendered as ISO text like ``present`` does on
    the Spark side."""
    if isinstance(dates, str):
        dates = (dates,)
    if isinstance(timestamps, str):
        timestamps = (timestamps,)

    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        def built(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))

        built.__name__ = fn.__name__
        built.__doc__ = fn.__doc__
        built.raw = fn
        QUERIES[key] = built
        if oracle is not None:
            if dates or timestamps:
                repl = ", ".join([f"strftime({d}, '%Y-%m-%d') AS {d}" for d in dates]
                                 + [f"strftime({t}, '%Y-%m-%d %H:%M:%S.%f') AS {t}"
                                    for t in timestamps])
                ORACLES[key] = f"SELECT * REPLACE ({repl}) FROM (\n{oracle}\n)"
            else:
                ORACLES[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from driftpool.plans import (  # noqa: F401
        q_clean,
        q_enrich,
        q_keyed,
        q_model_checks,
        q_models,
        q_pool,
        q_series,
        q_slice,
        q_streams,
    )
