"""Ordering, sampling, splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftpool.functions.nullsafe import join_groups


def seed_order(seed: int | str, id_col: str) -> Column:
    """A repeatable pseudo-random order: md5('<seed>:<id>') (same in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def seeded_sample(df: DataFrame, n: int, seed: int | str, id_col: str) -> DataFrame:
    """min(n, rows) rows, repeatable for a seed. A top-n by hash: each
    task keeps n rows, so only n * tasks rows reach the final merge."""
    return df.orderBy(seed_order(seed, id_col), F.col(id_col)).limit(n)


def chronological_order(df: DataFrame, order: list[str], group: list[str] | None = None,
                        rank_col: str = "rank", bounded_groups: bool = False) -> DataFrame:
    """1-based rank of every row by ``order`` (a total order), skew-safe
    (no single-task global sort window).

    ``bounded_groups`` declares that no group can grow with the data - a bar
    series is one row per trading day, bounded by the calendar - so a plain
    window per group ranks it, without the range exchange and checkpoint the
    skew-safe form needs for unbounded groups.
    """
    from driftpool.functions.ranking import row_number_in_group

    if bounded_groups and group:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(w).cast("long"))
    return row_number_in_group(df, list(group or []), order, rank_col=rank_col)


def _group_sizes(df: DataFrame, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))


def _attach_sizes(ranked: DataFrame, group: list[str]) -> DataFrame:
    if not group:
        return ranked.withColumn("_n", ranked.select(F.count(F.lit(1))).scalar())
    return join_groups(ranked, _group_sizes(ranked, group), group)


def chrono_split(ranked: DataFrame, test_size: float = 0.2, group: list[str] | None = None,
                 rank_col: str = "rank") -> DataFrame:
    """Time-ordered split of ranked rows. ``train_a``: all but the last
    ceil(test_size * n) rows; ``train_b``: the first floor((1 - test_size) * n)
    rows (both computed in double arithmetic, as the reference's libraries)."""
    g = list(group or [])
    r = _attach_sizes(ranked, g)
    n = F.col("_n").cast("double")
    n_test = F.ceil(F.lit(test_size) * n)
    n_train_b = F.floor(F.lit(1.0 - test_size) * n)
    return (r.withColumn("train_a", F.col(rank_col) <= F.col("_n") - n_test)
            .withColumn("train_b", F.col(rank_col) <= n_train_b).drop("_n"))


def stratified_split(df: DataFrame, label: str, seed: int | str, id_col: str,
                     test_size: float = 0.2) -> DataFrame:
    """Per class, the first ceil(test_size * n_class) rows by a seeded hash
    order are test (``is_test``); rows with a NULL label are a class. Ranking is
    skew-safe for a dominant class."""
    from driftpool.functions.ranking import row_number_in_group

    keyed = df.withColumn("_h", seed_order(seed, id_col))
    ranked = row_number_in_group(keyed, [label], ["_h", id_col], rank_col="_r")
    sized = join_groups(ranked, _group_sizes(df, [label]), [label])
    return (sized.withColumn("is_test", F.col("_r") <= F.ceil(
        F.lit(test_size) * F.col("_n").cast("double")))
            .drop("_h", "_r", "_n"))


def expanding_folds(ranked: DataFrame, n_splits: int = 5, rank_col: str = "rank",
                    group: list[str] | None = None) -> DataFrame:
    """Time-series folds. s = n // (n_splits + 1); fold k = 1..n_splits
    tests ranks (n - (n_splits + 1 - k) s, n - (n_splits - k) s] and trains on
    all earlier ranks. Output: one row per (row, fold) it takes part in, with
    role 'train' / 'test' (each row is repeated at most n_splits times by an
    explode of the fold numbers; no join)."""
    g = list(group or [])
    r = _attach_sizes(ranked, g).withColumn("_s", F.floor(F.col("_n") / (n_splits + 1)))
    j = r.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(1, n_splits + 1)])))
    start = F.col("_n") - (n_splits + 1 - F.col("fold")) * F.col("_s")  # 0-based test start
    end = start + F.col("_s")
    pos = F.col(rank_col) - 1
    role = F.when(pos < start, F.lit("train")).when(pos < end, F.lit("test"))
    return j.withColumn("role", role).where(F.col("role").isNotNull()).drop("_n", "_s")


def stratified_folds(df: DataFrame, label: str, n_splits: int = 5,
                     order=("rank",)) -> DataFrame:
    """Class-balanced folds in the row order of ``order`` (a total order; a
    rank, or the columns a rank would be made from), allocated like a non-shuffled
    stratified K-fold: labels sorted, position p of the sorted list counts for
    fold p mod n_splits; within a class the rows, in order, fill fold 0 first,
    then fold 1, ... by those counts. Adds ``fold`` (0-based). NULL labels are a
    class, sorted first. Rows are ranked once, within their class.

    The allocation is a (classes x folds) table computed from class sizes; rows
    find their fold by a range test against it (the planner broadcasts it while
    it is small, so a label that is no class only costs a shuffle).
    """
    from driftpool.functions.ranking import row_number_in_group

    sizes = _group_sizes(df, [label])
    cum = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(cum), F.lit(0)))
    a, b = F.col("_start"), F.col("_start") + F.col("_n")

    def upto(x):  # count of p in [0, x) with p mod n_splits == fold
        return F.floor((x - 1 - F.col("fold")) / n_splits) + 1

    alloc = (sizes.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(n_splits)])))
             .withColumn("_cnt", upto(b) - upto(a)))
    wf = Window.partitionBy(label).orderBy("fold")
    alloc = (alloc.withColumn("_hi", F.sum("_cnt").over(wf))
             .withColumn("_lo", F.col("_hi") - F.col("_cnt"))
             .select(label, "fold", "_lo", "_hi"))
    within = row_number_in_group(df, [label], list(order), rank_col="_j")
    j = join_groups(within, alloc, [label])
    return (j.where((F.col("_j") - 1 >= F.col("_lo")) & (F.col("_j") - 1 < F.col("_hi")))
            .drop("_lo", "_hi", "_j"))
