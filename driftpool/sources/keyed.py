"""Keyed ingest: first row per key, and insert-if-absent against a target.

A UNIQUE key treats NULLs as distinct, so rows with a NULL key part are never
duplicates of anything: they are always kept.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: buckets of a keyed table: each is read, and written, by one task
BUCKETS = 64


def _null_key(key: list[str]):
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])


def table_or_none(spark: SparkSession, path: str, schema: T.StructType,
                  fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path`` under an explicit schema, or None where the path does
    not exist. Any other error - an unreadable file, no permission - is raised, now
    or when the rows are read: it must not pass for an empty table."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def first_per_key(batch: DataFrame, key: list[str], ordinal: list[str]) -> DataFrame:
    """Keep the first row (by ``ordinal``, then every other column as the final
    tie-break) of every key; rows with a NULL key part all pass.

    A grouped ``min`` over the columns as a struct, in that order: partial aggregation
    keeps one candidate per key per task before the shuffle, so a hot key (or a batch full
    of repeats) ships one row per task instead of sorting all its rows in one, and every
    column is shuffled once. A row with a NULL key part is a group of its own, by its
    number within the input, so the batch is read once.
    """
    loose = (T.FloatType, T.DoubleType, T.ArrayType, T.StructType)  # equal values may differ: 0.0, -0.0
    taken = [k for k in key if not isinstance(batch.schema[k].dataType, loose)]
    rest = [c for c in batch.columns if c not in key and c not in ordinal]
    rest += [k for k in key if k not in taken and k not in ordinal]
    own = F.when(_null_key(key), F.monotonically_increasing_id())
    kept = F.col("_first")
    return (batch.withColumn("_row", own).groupBy(*key, "_row")
            .agg(F.min(F.struct(*ordinal, *rest)).alias("_first"))
            .select(*[F.col(c) if c in taken else kept.getField(c).alias(c) for c in batch.columns]))


def insert_if_absent(batch: DataFrame, target: DataFrame, key: list[str],
                     ordinal: list[str]) -> DataFrame:
    """Rows of ``batch`` to append: first per key, and key not in ``target``.

    ``left_anti`` never matches a NULL key part, so NULL-keyed rows are kept,
    as a UNIQUE constraint would. Never updates existing rows.
    """
    first = first_per_key(batch, key, ordinal)
    # a join by name puts the key columns first
    return first.join(target.select(*key), key, "left_anti").select(*batch.columns)


def insert_counts(batch: DataFrame, to_insert: DataFrame) -> DataFrame:
    """(batch_rows, inserted, skipped) in one row; inserted + skipped = batch."""
    inserted = to_insert.select(F.count(F.lit(1))).scalar()
    b = batch.agg(F.count(F.lit(1)).alias("batch_rows"))
    return b.select("batch_rows", inserted.alias("inserted"),
                    (F.col("batch_rows") - inserted).alias("skipped"))


def append_if_absent(batch: DataFrame, target_path: str, key: list[str],
                     ordinal: list[str], fmt: str = "parquet") -> DataFrame:
    """Write the new rows of ``batch`` into the table at ``target_path``.

    The rows to write are materialised to the target in one append; a retried
    run finds its own keyed rows in the target and appends none of them. Rows with
    a NULL key part are distinct by definition and are appended on every call.
    """
    spark = batch.sparkSession
    target = table_or_none(spark, target_path, batch.schema, fmt)
    if target is None:  # no table yet: everything is new
        target = spark.createDataFrame([], batch.schema)
    new_rows = insert_if_absent(batch, target, key, ordinal)
    new_rows.write.mode("append").format(fmt).save(target_path)
    return spark.read.schema(batch.schema).format(fmt).load(target_path)


def bucketed_table(spark: SparkSession, path: str, schema: T.StructType, key: list[str],
                   buckets: int = BUCKETS) -> str:
    """The name under which the session knows the external table at ``path``, whose
    files are bucketed and sorted by ``key``; it is made known, and created empty
    where there is none. The layout is part of the table: every session must name
    the same key and number of buckets."""
    name = f"keyed_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        keys, place = ", ".join(f"`{k}`" for k in key), path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) "
                  f"SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return name


def append_bucketed(batch: DataFrame, target_path: str, key: list[str], ordinal: list[str],
                    buckets: int = BUCKETS) -> DataFrame:
    """As ``append_if_absent`` for a table that is kept bucketed by its key: the
    anti-join reads the stored keys where they lie, and only the batch is shuffled.
    New rows are written by bucket, one file for each. Returns the table."""
    spark = batch.sparkSession
    name = bucketed_table(spark, target_path, batch.schema, key, buckets)
    new_rows = insert_if_absent(batch, spark.table(name), key, ordinal)
    (new_rows.repartition(buckets, *key).write.mode("append").insertInto(name))
    spark.catalog.refreshTable(name)
    return spark.table(name)
