"""Sources and sinks.

Every reader takes an explicit schema (no inference pass over the data), and
every writer is a partitioned Spark write - nothing goes through the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The header of a price CSV export and the safe names used here.
PRICE_CSV_COLUMNS = [("Date", "date_str"), ("Price", "price_str"), ("Open", "open_str"),
                     ("High", "high_str"), ("Low", "low_str"), ("Vol.", "vol_str"),
                     ("Change %", "change_str")]

NEWS_SCHEMA = T.StructType([
    T.StructField("channel_id", T.LongType()),
    T.StructField("message_id", T.LongType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("text", T.StringType()),
])

# Fields with separators, quotes or line breaks are quoted; NULL is written as an
# unquoted empty field and '' as "" - so reading with a nullValue that never
# occurs in data keeps the two apart (the default nullValue "" merges them).
_CSV_WRITE = {"header": "true", "escape": '"',
              "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_CSV_READ = {"header": "true", "escape": '"', "quote": '"',
             "nullValue": "\u0001", "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false"}


def news_intake(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest-``limit`` messages (limit counts before the text filter),
    then messages with non-empty text, projected to the news schema."""
    df = messages
    if limit is not None:
        df = df.orderBy(F.desc_nulls_first("date"), F.desc("message_id")).limit(limit)
    return (df.where(F.col("text").isNotNull() & (F.col("text") != ""))
            .select("channel_id", "message_id", "date", "text"))


def write_csv(df: DataFrame, path: str, header_names: list[str] | None = None) -> None:
    """DataFrame -> CSV folder with header; texts with commas, quotes and
    newlines round-trip, and NULL stays apart from ''."""
    if header_names:
        df = df.toDF(*header_names)
    df.write.mode("overwrite").options(**_CSV_WRITE).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             multi_line: bool = True) -> DataFrame:
    """CSV with header, explicit schema. ``multi_line`` is needed for
    quoted line breaks, and makes every file one task; write large tables as many
    files."""
    return (spark.read.options(**_CSV_READ).option("multiLine", str(multi_line).lower())
            .schema(schema).csv(path))


def write_price_csv(df: DataFrame, path: str) -> None:
    """Price bars as strings under the export's original header."""
    cols = [safe for _, safe in PRICE_CSV_COLUMNS]
    write_csv(df.select(*cols), path, [orig for orig, _ in PRICE_CSV_COLUMNS])


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Price CSV with header; every column read as text, then renamed to
    safe names ('Vol.' and 'Change %' cannot be referenced as plain columns)."""
    schema = T.StructType([T.StructField(orig, T.StringType()) for orig, _ in PRICE_CSV_COLUMNS])
    raw = read_csv(spark, path, schema, multi_line=False)  # no field holds a line break
    return raw.select(*[F.col(f"`{orig}`").alias(safe) for orig, safe in PRICE_CSV_COLUMNS])


def store_vectors(vecs: DataFrame, path: str) -> None:
    """Vectors stored partitioned by model so a model filter prunes folders."""
    vecs.write.mode("overwrite").partitionBy("model_name").parquet(path)


def vectors_for_model(vecs: DataFrame, model_name: str,
                      columns=("ts", "v"), ordered: bool = False) -> DataFrame:
    """The vectors of one model (equality filter, pushed to the scan /
    partition-pruned), projected; optionally ordered by time. Empty is legal."""
    df = vecs.where(F.col("model_name") == model_name).select(*columns)
    return df.orderBy("ts") if ordered else df


def sql_file_query(spark: SparkSession, path: str) -> DataFrame:
    """Run the one SQL statement in a text file over registered views.

    An empty file is an error. A statement with a result returns its rows,
    however it begins; one without (a command) returns a one-row (statement,
    status), the first word of it that is no comment.
    """
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    stmt = text.strip().rstrip(";").strip()
    if not stmt:
        raise ValueError(f"empty SQL file: {path}")
    result = spark.sql(stmt)
    if result.columns:
        return result
    words = re.sub(r"--[^\n]*|/\*.*?\*/", " ", stmt, flags=re.S).split()
    return spark.createDataFrame([(words[0].lower(), "ok")], "statement string, status string")


def vector_text_parse(c) -> "F.Column":
    """S09: '[0.1,0.2]' -> array<double>."""
    from driftpool.functions.vectors import parse_vector_text

    return parse_vector_text(F.col(c) if isinstance(c, str) else c)
