"""Structured Streaming jobs.

Sources are file streams (parquet, explicit schema). Sinks are
``foreachBatch`` writes that are idempotent per batch id, so a batch re-run
after a failure (Structured Streaming's at-least-once replay) leaves the same
table - together with the checkpointed offsets this is exactly-once.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from driftpool.functions.vectors import mean_vector
from driftpool.sources.keyed import first_per_key, table_or_none

EPOCH_NTZ = "1970-01-01 00:00:00"
MICROS_PER_DAY = 86_400_000_000


def ntz_to_instant(c: str | Column) -> Column:
    """timestamp_ntz -> timestamp whose UTC wall time is the NTZ value
    (independent of the session zone); watermarks need a timestamp."""
    col = F.col(c) if isinstance(c, str) else c
    micros = F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), col)
    return F.timestamp_micros(micros)


def utc_day(ts: str | Column) -> Column:
    """Calendar day (UTC) of a timestamp, independent of the session zone."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.date_from_unix_date(F.floor(F.unix_micros(col) / MICROS_PER_DAY).cast("int"))


def _read(spark: SparkSession, path: str, schema, files_per_trigger: int | None):
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


_MARK = "batch_id long, mark timestamp, others boolean"


def stream_intake(spark: SparkSession, source: str, schema, target: str, checkpoint: str,
                  key=("channel_id", "message_id"), ordinal=("date",), event: str = "date",
                  delay: str = "1 day", files_per_trigger: int | None = None,
                  files_per_batch: int = 8) -> StreamingQuery:
    """Messages with text land in ``target`` once per key, across batches and
    restarts; of a key's rows in one batch the first by ``ordinal`` is kept, stored
    rows are never updated.

    Keys are deduplicated by state: ``dropDuplicatesWithinWatermark`` on the event
    time, so a replay of anything newer than the watermark (``delay`` behind the
    newest message) is absorbed without looking at the table. The state store drops
    what the watermark passes; rows at least that old (and rows without an event
    time), which the operator would lose, are taken from the batch itself and
    compared with the keys the table holds. A batch without such rows reads no
    history. A message must keep its event time when it is sent again. Rows with a
    NULL key part are distinct by definition and all land.

    A batch is one folder of ``files_per_batch`` files, named by the query and batch
    id: a replayed batch replaces its own rows. If the table held rows before the
    query began, every key is compared with those. One query writes a table at a
    time. Read it with ``read_intake``, which keeps the source's types.
    """
    key = list(key)
    full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    msgs = (_read(spark, source, schema, files_per_trigger)
            .where(F.col("text").isNotNull() & (F.col("text") != ""))
            .withColumn("_event", ntz_to_instant(event)))
    # one source for both branches: each batch has the rows, and the keys new to the state
    new_keys = (msgs.where(full & F.col("_event").isNotNull()).select(*key, "_event").withWatermark("_event", delay)
                .dropDuplicatesWithinWatermark(key).select(*key, F.lit(True).alias("_new")))
    both = msgs.withColumn("_new", F.lit(False)).unionByName(new_keys, allowMissingColumns=True)

    def sink(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        name = f"{run}-{batch_id}"
        before = _mark(spark, checkpoint, batch_id - 1)
        held = table_or_none(spark, target, _intake_schema(schema)) if before is None else None
        others = held is not None and held.where(~F.col("batch").startswith(run)).limit(1).count() > 0 \
            if before is None else before.others
        mark = before.mark if before else None
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            old = F.col("_event").isNull() | (F.lit(False) if mark is None else F.col("_event") <= F.lit(mark))
            rows = batch.where("not _new").drop("_new")
            seen = rows.agg(F.expr(f"max(_event) - interval '{delay}'").alias("mark"),
                            F.count_if(full & old).alias("n_old"),
                            F.count(F.lit(1)).alias("n")).first()
            keys = batch.where("_new").select(*key).distinct()
            land = first_per_key(rows.where(full).join(keys, key, "left_semi"), key, list(ordinal))
            if others or seen.n_old:
                held = table_or_none(spark, target, _intake_schema(schema))
                held = None if held is None else held.where(F.col("batch") != name)
            if others and held is not None:
                land = _not_held(land, held.where(~F.col("batch").startswith(run)), key)
            if seen.n_old:
                late = first_per_key(rows.where(full & old).join(keys, key, "left_anti"), key, list(ordinal))
                land = land.unionByName(late if held is None else _not_held(late, held, key))
            if seen.n:
                (land.unionByName(rows.where(~full)).drop("_event").repartition(files_per_batch)
                 .write.mode("overwrite").parquet(f"{target}/batch={name}"))
            marks = [m for m in (mark, seen.mark) if m is not None]
            _set_mark(spark, checkpoint, batch_id, max(marks) if marks else None, others)
        finally:
            batch.unpersist()

    return (both.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _not_held(rows: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(held.select(*key), key, "left_anti")


def _mark(spark: SparkSession, checkpoint: str, batch_id: int):
    """What batch ``batch_id`` left for the next: the event time up to which keys may
    have left the state, and whether the table holds rows of other writers. Two
    slots are enough, as only the last batch can be run again."""
    slot = table_or_none(spark, f"{checkpoint}/intake-marks/{batch_id % 2}",
                         T.StructType.fromDDL(_MARK))
    return None if slot is None else slot.where(F.col("batch_id") == batch_id).first()


def _set_mark(spark: SparkSession, checkpoint: str, batch_id: int, mark, others: bool) -> None:
    row = spark.createDataFrame([(batch_id, mark, others)], _MARK)
    row.coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/intake-marks/{batch_id % 2}")


def _intake_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.StringType())])


def read_intake(spark: SparkSession, target: str, schema) -> DataFrame:
    """The intake table with the source's columns and types."""
    return spark.read.schema(_intake_schema(schema)).parquet(target).drop("batch")


def daily_pool_stream(spark: SparkSession, source: str, schema, delay: str = "1 day",
                      files_per_trigger: int | None = None, keys=("series",)) -> DataFrame:
    """T02 plan: per (series, UTC day): item count and mean vector, on event
    time with a watermark; rows later than the watermark are dropped, a day is
    emitted once (append mode) when the watermark passes its end."""
    ev = (_read(spark, source, schema, files_per_trigger)
          .withColumn("event_ts", ntz_to_instant("ts"))
          .withWatermark("event_ts", delay))
    agg = ev.groupBy(F.window("event_ts", "1 day"), *keys).agg(
        F.count(F.lit(1)).alias("n_items"), mean_vector(F.col("v")).alias("v"))
    return agg.select(*keys, utc_day(F.col("window.start")).alias("day"), "n_items", "v")


def _batch_sink(out: str, transform=None):
    def sink(batch: DataFrame, batch_id: int) -> None:
        df = transform(batch) if transform else batch
        # one folder per batch id, overwritten on replay: idempotent
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return sink


def stream_daily_pool(spark: SparkSession, source: str, schema, out: str, checkpoint: str,
                      delay: str = "1 day", files_per_trigger: int | None = None) -> StreamingQuery:
    """Closed days of the daily pool appended to ``out``."""
    plan = daily_pool_stream(spark, source, schema, delay, files_per_trigger)
    return (plan.writeStream.outputMode("append").foreachBatch(_batch_sink(out))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_score(spark: SparkSession, source: str, schema, model, out: str, checkpoint: str,
                 delay: str = "1 day", files_per_trigger: int | None = None) -> StreamingQuery:
    """Each closed day's pooled vector scored by ``model`` (M08 columns)."""
    from pyspark.ml.functions import vector_to_array

    from driftpool.operators.models import as_features

    def score(batch: DataFrame) -> DataFrame:
        out = model.transform(as_features(batch, "v"))
        p = vector_to_array("probability")
        return out.select(
            "series", "day", "n_items",
            F.when(F.col("prediction") == 1, "Increase").otherwise("Decrease").alias("direction"),
            F.element_at(p, F.col("prediction").cast("int") + 1).alias("confidence"))

    plan = daily_pool_stream(spark, source, schema, delay, files_per_trigger)
    return (plan.writeStream.outputMode("append").foreachBatch(_batch_sink(out, score))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def pool_accounting(source: DataFrame, pooled: DataFrame, delay: str = "1 day", keys=("series",),
                    ts: str = "ts") -> DataFrame:
    """What became of the rows a pool or score stream (T02, T03) has read: per key and
    UTC day ``n_source`` = ``n_pooled`` + ``n_late`` + ``n_open`` + ``n_undated``.

    ``source`` is the stream's folder read as a table once the stream has run,
    ``pooled`` its sink (``read_batches``). A day is closed when the watermark
    (``delay`` behind the newest row) has passed its end: rows of it that no pool
    holds came late and were dropped (``n_late``). Days not closed yet wait in the
    state (``n_open``). Rows without a time belong to no day (``n_undated``). NULL
    keys are a group; with no rows there is nothing to account for.

    Both sides are counted in one aggregation, combined map-side.
    """
    keys = list(keys)
    zero = F.lit(0).cast("bigint")
    read = source.select(*keys, utc_day(ntz_to_instant(ts)).alias("day"), F.lit(1).cast("bigint").alias("n_source"),
                         zero.alias("n_pooled"))
    held = pooled.select(*keys, "day", zero.alias("n_source"), F.col("n_items").alias("n_pooled"))
    days = read.unionByName(held).groupBy(*keys, "day").agg(
        F.sum("n_source").alias("n_source"), F.sum("n_pooled").alias("n_pooled"))
    watermark = source.select(F.max(ntz_to_instant(ts)) - F.expr(f"interval '{delay}'")).scalar()
    day_end = F.timestamp_micros((F.unix_date("day").cast("bigint") + 1) * MICROS_PER_DAY)
    closed = day_end <= watermark
    return days.select(
        *keys, "day", "n_source", "n_pooled",
        F.when(closed, F.col("n_source") - F.col("n_pooled")).otherwise(zero).alias("n_late"),
        F.when(~closed, F.col("n_source")).otherwise(zero).alias("n_open"),
        F.when(F.col("day").isNull(), F.col("n_source")).otherwise(zero).alias("n_undated"))


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """The sink table without its batch-id folder column."""
    return spark.read.parquet(out).drop("batch_id")


def write_time_chunks(df: DataFrame, path: str, day_col: str, n_files: int) -> None:
    """Feed a file stream: ``df`` split into ``n_files`` day ranges, written in
    time order (one write per range, so file times follow event time); rows
    without a day go with the first range."""
    span = df.agg(F.min(F.unix_date(day_col)).alias("lo"), F.max(F.unix_date(day_col)).alias("hi"))
    lo, hi = span.first()
    lo, hi = lo or 0, hi or 0  # no row has a day
    width = max(1, (hi - lo + n_files) // n_files)
    for i in range(n_files):
        a, b = lo + i * width, lo + (i + 1) * width
        part = (F.unix_date(day_col) >= a) & (F.unix_date(day_col) < b)
        if i == 0:
            part = part | F.col(day_col).isNull()
        df.where(part).write.mode("append").parquet(path)
