"""Aggregated reports: class counts, confusion matrix, classification and
regression metrics, profiles and digests (A05-A13).

All are grouped aggregates with partial aggregation; the small fixed tables
(class lists, grids) are the only broadcast sides - their size is the number of
classes, not the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftpool.functions.nullsafe import join_groups
from driftpool.functions.ranking import row_number_in_group


def _classes(spark, classes, name="label") -> DataFrame:
    return spark.createDataFrame([(int(c),) for c in classes], f"{name} int")


def _with_absent(counts: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of all listed cells (0 where absent) and of every other cell that
    occurs, NULL ones included."""
    absent = join_groups(listed, counts, keys, "left_anti").withColumn("n", F.lit(0).cast("long"))
    return counts.unionByName(absent)


def class_distribution(df: DataFrame, classes, label: str = "label") -> DataFrame:
    """Rows per class; absent classes reported as 0, labels outside the list
    (NULL too) with their own counts."""
    counts = df.groupBy(F.col(label).cast("int").alias(label)).agg(F.count(F.lit(1)).alias("n"))
    listed = _classes(df.sparkSession, classes, label)
    return _with_absent(counts, listed, [label]).orderBy(F.desc("n"), label)


def confusion_matrix(df: DataFrame, classes, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """True x predicted counts over the full class grid (zero cells kept);
    pairs outside the grid are added with their counts."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(int(a), int(b)) for a in classes for b in classes],
                                 f"{y_true} int, {y_pred} int")
    counts = (df.groupBy(F.col(y_true).cast("int").alias(y_true),
                         F.col(y_pred).cast("int").alias(y_pred))
              .agg(F.count(F.lit(1)).alias("n")))
    return _with_absent(counts, grid, [y_true, y_pred])


def _safe_div(a, b):
    return F.coalesce(F.try_divide(a, F.when(b != 0, b)), F.lit(0.0))


def classification_report(df: DataFrame, classes, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Per class precision, recall, F1, support; then accuracy, macro and
    support-weighted averages. A zero denominator gives 0. Labels outside the
    list are classes of the report too (as true or as predicted ones), so
    accuracy and totals are over all rows."""
    cm = confusion_matrix(df, classes, y_true, y_pred)
    per_true = cm.groupBy(F.col(y_true).alias("c")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col(y_true).eqNullSafe(F.col(y_pred)), F.col("n")).otherwise(0)).alias("tp"))
    per_pred = cm.groupBy(F.col(y_pred).alias("c")).agg(F.sum("n").alias("predicted"))
    zero = F.lit(0).cast("long")
    sides = per_true.select("c", "support", "tp", zero.alias("predicted")).unionByName(
        per_pred.select("c", zero.alias("support"), zero.alias("tp"), "predicted"))
    per = (sides.groupBy("c").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"),
                                  F.sum("predicted").alias("predicted"))
           .withColumn("precision", _safe_div(F.col("tp").cast("double"), F.col("predicted")))
           .withColumn("recall", _safe_div(F.col("tp").cast("double"), F.col("support")))
           .withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                       F.col("precision") + F.col("recall"))))
    rows = per.select(F.col("c").cast("string").alias("label"), "precision", "recall", "f1",
                      F.col("support").cast("long").alias("support"))
    tot = per.agg(F.sum("support").alias("total"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                  F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     _safe_div(F.col("tp").cast("double"), F.col("total")).alias("f1"),
                     F.col("total").cast("long").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                       F.col("total").cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"),
                          _safe_div(F.col("wp"), F.col("total")).alias("precision"),
                          _safe_div(F.col("wr"), F.col("total")).alias("recall"),
                          _safe_div(F.col("wf"), F.col("total")).alias("f1"),
                          F.col("total").cast("long").alias("support"))
    return reduce(DataFrame.unionByName, [rows, acc, macro, weighted])


def accuracy(df: DataFrame, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """Share of rows with y_pred = y_true."""
    return df.agg(F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("accuracy"))


def regression_metrics(df: DataFrame, order: list[str], y_true="y_true", y_pred="y_pred",
                       batch_size: int = 64, delta: float = 1.0) -> DataFrame:
    """MAE, RMSE, MSE, Huber(delta) and the batch loss = mean over
    consecutive batches of ``batch_size`` rows (in ``order``) of the batch MSE.

    Batch numbers come from a skew-safe global row number (range-partitioned,
    no single-task sort), whose written rows also give the point metrics, so the
    input is not evaluated again; the two-level mean is two grouped aggregates.
    Runs the numbering job at once.
    """
    e = F.col(y_pred) - F.col(y_true)
    rows = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], e.alias("_e"))
    numbered = row_number_in_group(rows, [], [f"_o{i}" for i in range(len(order))], rank_col="_rn")
    huber = F.when(F.abs("_e") <= delta, 0.5 * F.col("_e") * F.col("_e")).otherwise(
        delta * (F.abs("_e") - 0.5 * delta))
    point = numbered.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("_e")).alias("mae"),
                     F.avg(F.col("_e") * F.col("_e")).alias("mse"), F.avg(huber).alias("huber"))
    batches = (numbered.groupBy(F.floor((F.col("_rn") - 1) / batch_size).alias("_b"))
               .agg(F.avg(F.col("_e") * F.col("_e")).alias("_bl")))
    loss = batches.agg(F.avg("_bl").alias("loss"))
    return point.select("n", loss.select("loss").scalar().alias("loss"), "mae",
                        F.sqrt("mse").alias("rmse"), "mse", "huber")


def improvement_pct(base: DataFrame, other: DataFrame,
                    metrics=("loss", "mae", "rmse")) -> DataFrame:
    """A10: (base - other) / base * 100 per metric (one-row inputs)."""
    o = {m: other.select(m).scalar() for m in metrics}
    return base.select(*[
        (F.try_divide(F.col(m) - o[m], F.col(m)) * 100).alias(f"{m}_improvement_pct")
        for m in metrics])


def data_profile(df: DataFrame, date_col: str) -> DataFrame:
    """One row per column: null count, with the row count and the date
    range (one aggregate pass, then unpivoted)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(date_col).alias("_lo"),
            F.max(date_col).alias("_hi")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', _null_{i}" for i, c in enumerate(cols))
    return one.selectExpr("_n AS n_rows", "_lo AS min_date", "_hi AS max_date",
                          f"stack({len(cols)}, {pairs}) AS (column_name, n_nulls)")


def daily_digest(news: DataFrame, k: int = 10, day_of=None, text="text",
                 order_cols=("date", "message_id")) -> DataFrame:
    """Per day: message count and the k newest messages (messages without a
    date are a day). Spark keeps at most k
    rows per day and task before the shuffle, so a hot day is neither sorted whole
    nor gathered."""
    day = (day_of if day_of is not None else F.to_date(order_cols[0])).alias("day")
    n = news.withColumn("day", day)
    counts = n.groupBy("day").agg(F.count(F.lit(1)).alias("n_news"))
    order = [F.col(order_cols[0]).desc_nulls_first()] + [F.desc(c) for c in order_cols[1:]]
    w = Window.partitionBy("day").orderBy(*order, F.xxhash64(text), F.col(text))
    top = (n.select("day", *order_cols, text).withColumn("rank", F.row_number().over(w))
           .where(F.col("rank") <= k))
    gathered = top.groupBy("day").agg(F.sort_array(F.collect_list(
        F.struct("rank", *order_cols, text))).alias("top"))
    return join_groups(counts, gathered, ["day"])
