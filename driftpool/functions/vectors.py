"""Vector helpers: vectors are ``array<float|double>`` columns; MLlib vectors
are used only inside aggregations and models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUND = 6


def mean_vector(v: Column, weight: Column | None = None) -> Column:
    """Element-wise (weighted) mean of an array column as an aggregate.

    Summarizer is a typed imperative aggregate: each task keeps one partial
    vector per group, so a day's vectors are never shipped element by element.
    """
    vec = array_to_vector(v)
    agg = Summarizer.mean(vec) if weight is None else Summarizer.mean(vec, weight)
    return vector_to_array(agg, "float64")


def zero_vector(dim: Column | int) -> Column:
    d = F.lit(dim) if isinstance(dim, int) else dim
    return F.array_repeat(F.lit(0.0), d.cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def squared_gap(a: Column, b: Column) -> Column:
    """Mean over elements of (a - b)^2."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                    lambda acc, x: acc + x)
    return s / F.size(a)


def parse_vector_text(c: Column) -> Column:
    """``'[0.1, 0.2]'`` -> array<double>; arrays pass through unchanged."""
    return F.from_json(c, "array<double>")


def explode_elements(df: DataFrame, keys: list[str], v: str = "v",
                     digits: int = ROUND) -> DataFrame:
    """One row per vector element (keys..., i, x rounded) - the comparable form
    of a vector result."""
    return (df.select(*keys, F.posexplode(v).alias("i", "x"))
            .withColumn("x", F.round(F.col("x").cast("double"), digits)))
