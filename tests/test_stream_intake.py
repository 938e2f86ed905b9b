"""The intake stream: types, replays and NULL keys."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from driftpool.sources import io
from driftpool.streaming import streams


def news(spark, rows):
    return spark.createDataFrame(rows, "channel_id long, message_id long, text string").select(
        "channel_id", "message_id", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("date"), "text")


def test_intake_types_keys_and_replays(spark, tmp_path):
    src, target, ckpt = (str(tmp_path / x) for x in ("src", "table", "ckpt"))
    news(spark, [(7, 1, "a"), (7, 1, "a again"), (None, 2, "n"), (7, 3, "")]).write.parquet(src)
    run = lambda: streams.stream_intake(spark, src, io.NEWS_SCHEMA, target, ckpt).awaitTermination()
    run()
    out = lambda: streams.read_intake(spark, target, io.NEWS_SCHEMA)
    assert out().schema == io.NEWS_SCHEMA
    assert sorted((str(r.channel_id), r.message_id) for r in out().collect()) == [("7", 1), ("None", 2)]
    news(spark, [(7, 1, "b"), (8, 1, "c")]).write.mode("append").parquet(src)
    run()
    run()  # nothing new
    assert sorted((str(r.channel_id), r.message_id) for r in out().collect()) == [
        ("7", 1), ("8", 1), ("None", 2)]


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    src, target, ckpt = (tmp_path / x for x in ("src", "table", "ckpt"))
    news(spark, [(7, 1, "a"), (None, 2, "n")]).write.parquet(str(src))
    run = lambda: streams.stream_intake(spark, str(src), io.NEWS_SCHEMA, str(target), str(ckpt)).awaitTermination()
    run()
    # the batch's commit mark is lost, as when the driver dies right after the write
    for f in (ckpt / "commits").iterdir():
        f.unlink()
    run()
    rows = streams.read_intake(spark, str(target), io.NEWS_SCHEMA).collect()
    assert sorted((str(r.channel_id), r.message_id) for r in rows) == [("7", 1), ("None", 2)]


def test_chunks_hold_rows_without_a_day(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (1, DATE '2020-01-01'), (2, DATE '2020-02-01'), (3, NULL) AS t(x, d)")
    streams.write_time_chunks(df, str(tmp_path / "c"), "d", 3)
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [1, 2, 3]


def dated(spark, rows):
    return spark.createDataFrame(rows, "channel_id long, message_id long, date string, text string").select(
        "channel_id", "message_id", F.col("date").cast("timestamp_ntz").alias("date"), "text")


def intake(spark, tmp_path, delay="1 day", **kw):
    src, target, ckpt = (str(tmp_path / x) for x in ("src", "table", "ckpt"))
    streams.stream_intake(spark, src, io.NEWS_SCHEMA, target, ckpt, delay=delay, **kw).awaitTermination()
    return sorted(r.text for r in streams.read_intake(spark, target, io.NEWS_SCHEMA).collect())


def add(spark, tmp_path, rows):
    dated(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))


def test_late_rows_land_once(spark, tmp_path):
    """Rows older than the watermark, and rows without a date, are compared with the
    table; newer replays are absorbed by state."""
    add(spark, tmp_path, [(1, 1, "2020-01-01 00:00:00", "a"), (1, 2, "2020-01-09 00:00:00", "b"),
                          (1, 3, None, "undated"), (None, 1, "2020-01-09 00:00:00", "null")])
    assert intake(spark, tmp_path) == ["a", "b", "null", "undated"]
    add(spark, tmp_path, [(1, 1, "2020-01-01 00:00:00", "a late again"), (1, 2, "2020-01-09 00:00:00", "b again"),
                          (1, 3, None, "undated again"), (1, 4, "2020-01-02 00:00:00", "late but new"),
                          (1, 5, "2020-01-08 12:00:00", "in time"), (1, 5, "2020-01-08 13:00:00", "second"),
                          (None, 1, "2020-01-01 00:00:00", "null late")])
    want = ["a", "b", "in time", "late but new", "null", "null late", "undated"]
    assert intake(spark, tmp_path) == want
    add(spark, tmp_path, [(1, 4, "2020-01-02 00:00:00", "late again"), (1, 5, "2020-01-08 12:00:00", "again")])
    assert intake(spark, tmp_path) == want


def test_history_is_read_for_old_rows_alone(spark, tmp_path):
    add(spark, tmp_path, [(1, 1, "2020-01-01 00:00:00", "a"), (1, 2, "2020-01-09 00:00:00", "b")])
    intake(spark, tmp_path)
    kept = {f: f.read_bytes() for f in (tmp_path / "table").glob("batch=*/*.parquet")}
    add(spark, tmp_path, [(1, 2, "2020-01-09 00:00:00", "b again"), (1, 3, "2020-01-09 01:00:00", "c")])
    for f in kept:
        f.write_bytes(b"unreadable")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    src, target, ckpt = (str(tmp_path / x) for x in ("src", "table", "ckpt"))
    streams.stream_intake(spark, src, io.NEWS_SCHEMA, target, ckpt).awaitTermination()
    for f, content in kept.items():
        f.write_bytes(content)
    assert sorted(r.text for r in streams.read_intake(spark, target, io.NEWS_SCHEMA).collect()) == ["a", "b", "c"]


def test_rows_of_an_earlier_writer_count(spark, tmp_path):
    dated(spark, [(1, 1, "2020-01-09 00:00:00", "stored")]).write.parquet(str(tmp_path / "table/batch=load"))
    add(spark, tmp_path, [(1, 1, "2020-01-09 00:00:00", "again"), (1, 2, "2020-01-09 00:00:00", "new")])
    assert intake(spark, tmp_path) == ["new", "stored"]
    add(spark, tmp_path, [(1, 1, "2020-01-20 00:00:00", "again"), (1, 3, "2020-01-20 00:00:00", "newer")])
    assert intake(spark, tmp_path) == ["new", "newer", "stored"]


def test_many_micro_batches(spark, tmp_path):
    """25 files, one a batch, each with a new row, a replay and an old row: one folder a batch."""
    for i in range(25):
        day = f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}"
        file = tmp_path / "src" / f"f{i:03d}.parquet"
        file.parent.mkdir(exist_ok=True)
        rows = [(1, i, day, f"new {i}"), (2, i // 2, "2019-01-01", f"old {i // 2}")]
        rows += [(1, i - 1, None, "x")] if i else []
        pq.write_table(pa.table({
            "channel_id": [r[0] for r in rows], "message_id": [r[1] for r in rows],
            "date": pa.array([r[2] and dt.datetime.fromisoformat(r[2]) for r in rows], pa.timestamp("us")),
            "text": [r[3] for r in rows]}), file)
        os.utime(file, (1_600_000_000 + i, 1_600_000_000 + i))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = intake(spark, tmp_path, files_per_trigger=1, files_per_batch=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted([f"new {i}" for i in range(25)] + [f"old {i}" for i in range(13)])
    folders = list((tmp_path / "table").glob("batch=*"))
    assert len(folders) == 25 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
