"""Vector pooling per day.

Vectors are the big side at scale. Every pooling here is a grouped aggregate
with partial (map-side) aggregation; no operator explodes vector elements
before a shuffle, and nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftpool.functions.nullsafe import join_groups
from driftpool.functions.ranking import row_number_in_group
from driftpool.functions.vectors import dot, mean_vector, squared_gap, zero_vector

#: width of the steps on the score axis in which attention_pool keeps its sums
SCALE = 64.0
#: positions of a chunk, and days of a batch, of the padded sequences
CHUNK, BATCH_DAYS = 64, 100


def daily_mean_vector(vecs: DataFrame, keys=("series", "day"), v: str = "v") -> DataFrame:
    """Element-wise mean vector and item count per (series, day). Items
    without a vector take no part; a day of such items alone has no row."""
    return (vecs.where(F.col(v).isNotNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_items"), mean_vector(F.col(v)).alias(v)))


def attention_pool(vecs: DataFrame, weights: DataFrame, keys=("series", "day"),
                   v: str = "v") -> DataFrame:
    """Softmax-weighted sum of a day's vectors.

    score = w . v (``weights``: one row, column ``w`` array<double>, bound as a scalar -
    its size is one vector). A single-item day passes through unchanged (weight 1).
    Items without a vector take no part; a NULL key is a day of its own.

    The softmax is computed online, in one pass and in states that merge: a state is
    a scale (a step of ``SCALE`` on the score axis), the number of items, the sum of
    the weights exp(score - scale) and their weighted mean. A task keeps a state for
    each day and step it sees, equal steps merge in the shuffle of these states, and
    a day's steps (one to three for ordinary scores) are merged by rescaling with
    exp(scale - largest scale). Weights of a step lie between 1 and exp(SCALE), so
    the largest step's sum neither underflows nor overflows, whatever the scores. Raw
    vectors are neither shuffled nor scored twice.
    """
    # the weights are one vector: bind them once (scalar subquery), then score
    w = weights.select(F.col("w").cast("array<double>")).scalar()
    scored = (vecs.where(F.col(v).isNotNull()).withColumn("_w", w)
              .select(*keys, v, dot(F.col(v).cast("array<double>"), F.col("_w")).alias("_score")))
    step = F.floor(F.col("_score") / SCALE)
    states = (scored.withColumn("_step", step).withColumn("_wt", F.exp(F.col("_score") - step * SCALE))
              .groupBy(*keys, "_step")
              .agg(F.count(F.lit(1)).alias("_n"), F.sum("_wt").alias("_sum"),
                   mean_vector(F.col(v), F.col("_wt")).alias(v)))
    largest = F.max("_step").over(Window.partitionBy(*keys))
    rescaled = states.withColumn("_sum", F.col("_sum") * F.exp((F.col("_step") - largest) * SCALE))
    return rescaled.groupBy(*keys).agg(F.sum("_n").alias("n_items"),
                                       mean_vector(F.col(v), F.col("_sum")).alias(v))


def first_vector_of_day(vecs: DataFrame, keys=("series", "day"), v: str = "v",
                        order=("ts", "vec_id")) -> DataFrame:
    """First vector per day by (ts, id) - an explicit order, not fetch order."""
    return (vecs.groupBy(*keys)
            .agg(F.min_by(F.col(v), F.struct(*order)).alias(v)))


def window_mean_or_zero(selected: DataFrame, dim: int, v: str = "v") -> DataFrame:
    """One mean vector over the selected rows; empty input -> zero vector.

    Grouped on a constant so an empty input yields no group (the vector mean
    has no value for zero rows), then left-joined from a one-row frame."""
    agg = (selected.groupBy(F.lit(1).alias("_k"))
           .agg(F.count(F.lit(1)).alias("n_items"), mean_vector(F.col(v)).alias(v)))
    one = selected.sparkSession.range(1).select(F.lit(1).alias("_k"))
    return one.join(agg, "_k", "left").select(
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.col(v), zero_vector(dim)).alias(v))


def padded_daily_sequences(vecs: DataFrame, keys=("series", "day"), v: str = "v",
                           order=("ts", "vec_id"), require_any: bool = False,
                           dim: int | None = None) -> DataFrame:
    """A14, wide view: days with >= 2 items: vectors in time order, zero-padded to the
    longest day, with length and mask.

    One row per day by definition, so a day's list is gathered and padded to the
    longest day's; ``padded_sequence_batches`` holds the same in rows that do not
    grow with a day. The longest length, and the width unless ``dim`` gives it, come
    from counts by day, not from the lists. ``require_any`` fails when no day has
    two items (one cheap ``isEmpty`` probe).
    """
    counts = vecs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    if require_any and counts.isEmpty():
        raise ValueError("no day with at least 2 items")
    seqs = (vecs.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct(*order, F.col(v).alias("_v")))).alias("_s"))
            .where(F.size("_s") >= 2)
            .select(*keys, F.transform("_s", lambda s: s["_v"]).alias("_seq"))
            .withColumn("length", F.size("_seq")))
    width = vecs.select(F.max(F.size(v))).scalar() if dim is None else F.lit(dim)
    padded = (seqs.withColumn("_L", counts.select(F.max("n").cast("int")).scalar())
              .withColumn("_dim", width))
    pad = F.array_repeat(zero_vector(F.col("_dim")).cast("array<float>"), F.col("_L") - F.col("length"))
    return padded.select(*keys, "length", F.concat("_seq", pad).alias("seq"),
                         _mask(F.col("length"), F.col("_L")).alias("mask"))


def _mask(ones, size):
    return F.concat(F.array_repeat(F.lit(1), ones), F.array_repeat(F.lit(0), size - ones))


def padded_sequence_batches(vecs: DataFrame, keys=("series", "day"), v: str = "v",
                            order=("ts", "vec_id"), chunk: int = CHUNK, batch_days: int = BATCH_DAYS,
                            dim: int | None = None, n_parts: int | None = None) -> DataFrame:
    """A14 as padded batches: days with >= 2 items, in batches of ``batch_days`` in
    order of the keys, every day padded to the longest of its batch. A day is cut
    into chunks of ``chunk`` positions: rows (keys, batch, chunk, length, padded_len,
    seq, mask), where seq has ``chunk`` vectors, zero ones where mask is 0. A day has
    as many rows as its batch's longest day fills, the last of them blank for shorter
    days, so a batch's rows in order are its tensor, and no row grows with a day.

    Positions come from the skew-safe row number, so a hot day is spread over tasks;
    ``dim`` saves the pass that finds the vectors' width.
    """
    lengths = (vecs.groupBy(*keys).agg(F.count(F.lit(1)).alias("length")).where("length >= 2"))
    days = row_number_in_group(lengths, [], list(keys), rank_col="_day")
    days = days.withColumn("batch", F.floor((F.col("_day") - 1) / batch_days))
    longest = days.groupBy("batch").agg(F.max("length").alias("_most"))
    days = days.join(longest, "batch").withColumn(
        "padded_len", F.ceil(F.col("_most") / chunk) * chunk).drop("_day", "_most")
    width = vecs.select(F.max(F.size(v))).scalar() if dim is None else F.lit(dim)
    placed = daily_sequence_positions(vecs, keys, v, order, n_parts)
    full = (placed.groupBy(*keys, F.floor(F.col("pos") / chunk).alias("chunk"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", F.col(v).alias("_v")))).alias("_s")))
    grid = days.select("*", F.explode(F.sequence(F.lit(0).cast("long"),
                                                 F.floor(F.col("padded_len") / chunk) - 1)).alias("chunk"))
    out = join_groups(grid, full, [*keys, "chunk"], "left").withColumn("_dim", width)
    held = F.coalesce(F.size("_s"), F.lit(0))
    own = F.coalesce(F.transform("_s", lambda s: s["_v"].cast("array<float>")),
                     F.expr("cast(array() as array<array<float>>)"))
    pad = F.array_repeat(zero_vector(F.col("_dim")).cast("array<float>"), chunk - held)
    return out.select(*keys, "batch", "chunk", "length", "padded_len", F.concat(own, pad).alias("seq"),
                      _mask(held, F.lit(chunk)).alias("mask"))


def daily_sequence_positions(vecs: DataFrame, keys=("series", "day"), v: str = "v",
                             order=("ts", "vec_id"), n_parts: int | None = None) -> DataFrame:
    """A14 in long form, for any day size: one row per item of a day with >= 2
    items - (keys, pos 0-based in time order, vector, length, padded_len); the
    padding rows and mask of the wide form are implied by pos < length.

    Positions come from the skew-safe row number (a hot day is spread over
    range partitions, never sorted or gathered in one task); length is a
    grouped count and padded_len a scalar subquery.
    """
    ids = vecs.select(*keys, *order)
    lengths = ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("length")).where(F.col("length") >= 2)
    several = join_groups(ids, lengths.select(*keys), list(keys), "left_semi")
    ranked = row_number_in_group(several, list(keys), list(order), n_parts=n_parts, rank_col="_r")
    out = join_groups(join_groups(ranked, lengths, list(keys)),
                      vecs.select(*keys, *order, v), [*keys, *order])
    out = out.withColumn("padded_len", lengths.select(F.max("length")).scalar())
    return out.select(*keys, (F.col("_r") - 1).alias("pos"), *order, v, "length", "padded_len")


def pooling_gap(pooled: DataFrame, mean: DataFrame, keys=("series", "day"),
                v: str = "v") -> DataFrame:
    """Mean squared difference between a pooled vector and the day mean,
    for days with >= 2 items."""
    a = pooled.select(*keys, F.col(v).alias("_a"))
    b = mean.where(F.col("n_items") >= 2).select(*keys, "n_items", F.col(v).alias("_b"))
    return a.join(b, list(keys)).select(*keys, "n_items",
                                        squared_gap(F.col("_a"), F.col("_b")).alias("gap"))
