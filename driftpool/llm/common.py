"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpool.session import shared_path

#: the contract's white space; ``bytes.split()`` and ``\s`` without (?U) split
#: at exactly these
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: lineage ends
    in files that outlive any executor. Runs a job."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes the files of tables that ``cut`` wrote, once nothing that is still to run
    reads them."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Shared:
    """A broadcast object that travels with its class's code, as task functions do."""

    def __init__(self, spark: SparkSession, value: Any):
        self.raw, self.own = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    @property
    def value(self) -> Any:
        if self.own is None:
            self.own = pickle.loads(self.raw.value)
        return self.own


def crc_remainder(column: str, divisor: int, remainder: int):
    """True where crc32 of the column's text leaves ``remainder`` when divided by
    ``divisor``; false for null."""
    crc = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(divisor)) == remainder, F.lit(False))


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's text leaves 2 when divided by 4; a null id
    is not held out."""
    return crc_remainder(doc_id, 4, 2)


def duck_crc32(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of a non-empty ASCII text."""
    bits = "[" + ", ".join(["xor(crc, byte)"] + ["0"] * 8) + "]"
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform("
            f"string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))), "
            f"lambda crc, byte: list_reduce({bits}, lambda x, i: {step})), 4294967295)")


def drawn(key: str):
    """A number in [0, 1) that a row's key fixes: the order samples are taken in."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 53)).cast("double") / float(1 << 53)


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 of each text, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for x in column.cast(kind):
        yield x.as_py()


def add_columns(df: DataFrame, text_col: str, fields: list[T.StructField],
                make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
                keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) plus ``fields``, computed row by row from
    ``text_col`` in Arrow batches. ``make`` runs once per task and returns the
    function from a batch's texts to the new columns; a column of ``df`` that
    bears a new column's name is replaced. No shuffle; rows stay where they are."""
    names = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], *fields])

    def run(batches):
        fn = make()
        for b in batches:
            arrays = [b.column(i) for i in range(b.num_columns - 1)] + fn(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return src.mapInArrow(run, schema)
