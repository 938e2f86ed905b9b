"""Joins on grouping keys, where a NULL key is a group like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on equal ``keys``; two NULLs are equal (an
    ordinary equality would lose the NULL group). Planned as a hash or merge join
    like any equality; the right side's key columns are dropped."""
    renamed = {k: f"_right_{k}" for k in keys}
    right = right.withColumnsRenamed(renamed)
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{r}`"))
                                       for k, r in renamed.items()])
    return left.join(right, same, how).drop(*renamed.values())
