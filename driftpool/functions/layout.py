"""Input layout helper."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` dealt round-robin over ``parts`` partitions, or as it is without
    ``parts``. For per-row heavy work on an input of a few big row groups, which
    Spark cannot split further; a large input already has many splits and needs no
    extra shuffle. The caller decides: nothing is probed, and results never depend
    on it."""
    return df.repartition(parts) if parts else df
