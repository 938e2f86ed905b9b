"""Ranking helpers that stay skew-safe.

A plain ``row_number().over(Window.partitionBy(g))`` sorts a whole group in one
task; a hot group (a third of all rows) would then be one task. The helpers
here split groups first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftpool.functions.nullsafe import join_groups


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    salt_buckets: int = 32, salt_cols: list[str] | None = None,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group by ``order`` (exact).

    Stage 1 ranks inside (group, salt) buckets and keeps k per bucket, so a
    hot group is spread over ``salt_buckets`` tasks; stage 2 ranks the at most
    k * salt_buckets survivors per group. ``order`` must be a total order (end
    it with a unique key) for a deterministic result.
    """
    salt_src = [F.col(c) for c in (salt_cols or df.columns)]
    salted = df.withColumn("_salt", F.pmod(F.hash(*salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return (stage1.drop("_r1", "_salt")
            .withColumn(rank_col, F.row_number().over(w2))
            .where(F.col(rank_col) <= k))


def row_number_in_group(df: DataFrame, group: list[str], order: list[str],
                        n_parts: int | None = None, rank_col: str = "rank") -> DataFrame:
    """Exact 1-based row number within ``group`` by ascending ``order`` (a total
    order), without sorting any group in a single task. NULL group values form a
    group; NULLs in ``order`` come first. Runs the numbering job at once.

    1. range-partition on (group, order): a hot group spans several bounded
       partitions;
    2. number rows inside each (partition, group) slice;
    3. add the count of rows of the same group in earlier partitions, from a
       small (partition, group) count table (partitions x groups rows at most,
       broadcast by the planner when small, shuffled otherwise).

    The number of partitions is ``n_parts``, or else follows the session's shuffle
    partitions and adaptive sizes, so slices stay bounded as the data grows.

    The numbered slices are written once with a reliable ``checkpoint()`` into
    the shared checkpoint folder: the row side and the count side must see the
    same range boundaries, and two range exchanges would each sample their own
    (and a recomputation after executor loss could sample again). Pass only the
    columns you need; join wide payloads back by key afterwards.
    """
    from driftpool.session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cols = list(group) + list(order)
    ranged = df.repartitionByRange(n_parts, *cols) if n_parts else df.repartitionByRange(*cols)
    ranged = ranged.withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid", *group).orderBy(*order)
    local = ranged.withColumn("_local", F.row_number().over(w)).checkpoint(eager=True)
    counts = local.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_cnt"))
    wo = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(wo), F.lit(0))).drop("_cnt")
    return (join_groups(local, offsets, ["_pid", *group])
            .withColumn(rank_col, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_pid", "_local", "_off"))
