"""Removal of repeated word passages by fixed-block anchors (operator 7).

Method, for windows of ``window`` words and blocks of (window + 1) / 2:

1. Texts that are exact copies are found by digest; one of each goes on, the
   copies' windows are all repeated.
2. Anchors: every text is cut into non-overlapping blocks, which are indexed, and
   every rolling block-length window of every text probes the index. A repeated
   window holds a whole block of its own text, and that block's words occur twice
   at least, so only blocks hit by a second probe can lie in repeated windows.
3. Extension: around the hit blocks, all window-length windows are compared by
   128 bits of hash, and runs of repeated ones merge into maximal spans.

Probes and windows travel as packed, deduplicated arrays: a task sorts what it has
read, sends each different hash once, marked if it met it more often, and a bucket
of the hash range decides for all tasks. However often a passage occurs, a task
sends it once. Arrays and chunks are bounded; buckets follow the session's shuffle
partitions. Tables between steps are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpool.llm.common import add_columns, cut, table, text_bytes

QUERY_NAME = "op7_substring_dedup"
ORACLE_SQL = None  # too slow in SQL on whole tables; tests hold it against brute force
WINDOW = 35
#: words hashed before a task sends what it has
CHUNK_WORDS = 1 << 21
#: bytes of a text hashed at once; pieces end at white space
PIECE = 1 << 20
KEY_BYTES = 5  # of a probe, besides the bits that its bucket stands for
BROADCAST_BYTES = 32 * 1024 * 1024

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Lane:
    """One 64-bit hash of words and of word windows: a polynomial over random byte
    values, mixed, then a polynomial over words."""

    def __init__(self, seed: int):
        base = np.arange(1, 260, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)
        mixed = _mix(base) | U(1)
        self.values, self.byte_step = mixed[:256], int(mixed[256])
        self.word_step, self.last = int(mixed[257]), int(mixed[258])
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            back = pow(self.byte_step, -1, 1 << 64)
            for name, step in (("up", self.byte_step), ("down", back)):
                p = np.full(n, U(step))
                p[0] = U(1)
                setattr(self, name, np.multiply.accumulate(p))

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[:len(raw)], out=total[1:])
        return _mix((total[ends] - total[starts]) * self.down[starts])

    def windows(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hash of each run of n words, built from runs of powers of two."""
        if len(words) < n:
            return words[:0]
        out, length, run, size = None, 0, words, 1
        while n >= size:
            if n & size:
                part = run[length:] * U(pow(self.word_step, length, 1 << 64))
                out = part if out is None else out[:len(part)] + part[:len(out)]
                length += size
            run = run[:-size] + run[size:] * U(pow(self.word_step, size, 1 << 64)) \
                if len(run) > size else run[:0]
            size *= 2
        return _mix(out[:len(words) - n + 1] ^ U(self.last))


LANES = (Lane(1), Lane(2))


def word_hashes(text: bytes, lanes: int) -> list[np.ndarray]:
    """Per lane, the hashes of the text's words, in pieces of bounded size."""
    found: list[list[np.ndarray]] = [[] for _ in range(lanes)]
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > PIECE:  # up to the next white space
            gap = SPACE[np.frombuffer(text, np.uint8, offset=at + PIECE)]
            stop = at + PIECE + int(np.argmax(gap)) if gap.any() else stop
        raw = np.frombuffer(text, np.uint8, stop - at, at)
        edge = np.diff(np.concatenate(([True], SPACE[raw], [True])).view(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        for lane in range(lanes):
            found[lane].append(LANES[lane].words(raw, starts, ends))
        at = stop
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found]


def _pack(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    got = np.zeros((len(raw) // n, 8), np.uint8)
    got[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return got.view("<u8").ravel()


def _joined(column, n: int) -> np.ndarray:
    parts = [_unpack(x.as_py(), n) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _by_bucket(keys: np.ndarray, shift: int, buckets: int) -> Iterator[tuple[int, slice]]:
    """Runs of sorted ``keys`` that share the bits above ``shift``."""
    edges = np.append(np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << U(shift)),
                      len(keys))  # 2^64, the end of the last bucket, is no 64-bit number
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), slice(int(edges[b]), int(edges[b + 1]))


PROBES = "bucket int, once binary, many binary, block binary, text binary, place binary"


def _probes(block: int, bits: int):
    """Map side of the anchors: (rid, text) rows to packed probes and blocks."""
    low = 8 * KEY_BYTES

    def run(batches):
        rolling, firsts, tags, places, size = [], [], [], [], 0

        def send():
            keys, count = np.unique(np.concatenate(rolling), return_counts=True)
            own = np.concatenate(firsts)
            order = np.argsort(own, kind="stable")
            own, tag = own[order], np.concatenate(tags)[order]
            place = np.concatenate(places)[order]
            slices = dict(_by_bucket(own, low, 1 << bits))
            out = []
            for b, s in _by_bucket(keys, low, 1 << bits):
                k, twice, t = keys[s], count[s] > 1, slices.get(b, slice(0, 0))
                out.append((b, _pack(k[~twice], KEY_BYTES), _pack(k[twice], KEY_BYTES),
                            _pack(own[t], KEY_BYTES), _pack(tag[t], 8), _pack(place[t], 4)))
            rolling.clear(), firsts.clear(), tags.clear(), places.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32())]
                + [pa.array([r[i] for r in out], pa.binary()) for i in range(1, 6)],
                names=["bucket", "once", "many", "block", "text", "place"])

        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                words = word_hashes(text or b"", 1)[0]
                keys = LANES[0].windows(words, block) >> U(64 - low - bits)
                if len(keys):
                    own = keys[::block]
                    rolling.append(keys), firsts.append(own)
                    tags.append(np.full(len(own), rid, np.int64).view(np.uint64))
                    places.append(np.arange(len(own), dtype=np.uint64))
                    size += len(keys)
                if size >= CHUNK_WORDS:
                    yield send()
                    size = 0
        if size:
            yield send()
    return run


def _hit_blocks(rows: pa.Table) -> pa.Table:
    """Blocks of one bucket whose words two probes hold: (rid, place)."""
    many = _joined(rows["many"], KEY_BYTES)
    keys = np.sort(np.concatenate([_joined(rows["once"], KEY_BYTES), many, many]))
    twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
    blocks = _joined(rows["block"], KEY_BYTES)
    at = np.minimum(np.searchsorted(twice, blocks), max(len(twice) - 1, 0))
    hit = twice[at] == blocks if len(twice) else np.zeros(len(blocks), bool)
    return pa.table({"rid": pa.array(_joined(rows["text"], 8)[hit].view(np.int64)),
                     "place": pa.array(_joined(rows["place"], 4)[hit].astype(np.int32))})


CHUNKS = "chunk binary, bucket int, key binary, more binary, at binary, known binary, tags binary, sizes binary"


def _windows(window: int, block: int, bits: int):
    """Map side of the extension: (tag, text, places of hit blocks) rows to packed
    windows, in chunks of texts. A chunk also has one row of bucket -1 with its
    texts' tags and word counts, and the words already known to repeat."""

    def run(batches):
        tags, sizes, keys, more, at, base = [], [], [], [], [], 0

        def send():
            k, m, p = (np.concatenate(x) for x in (keys, more, at))
            order = np.lexsort((m, k))
            k, m, p = k[order], m[order], p[order]
            same = np.zeros(len(k) + 1, bool)
            same[1:-1] = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
            again = same[1:] | same[:-1]
            cover = np.packbits(_cover(p[again], base, window)).tobytes()
            first = ~same[:-1]
            # one of each; place 2^32 - 1 asks for no answer
            k, m, p = k[first], m[first], np.where(again, U(0xFFFFFFFF), p)[first]
            rows = [(b, _pack(k[s], 8), _pack(m[s], 8), _pack(p[s], 4), None, None, None)
                    for b, s in _by_bucket(k, 64 - bits, 1 << bits)]
            rows.append((-1, None, None, None, cover, b"".join(tags),
                         _pack(np.array(sizes, np.uint64), 4)))
            chunk = tags[0]
            for x in (tags, sizes, keys, more, at):
                x.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(rows), pa.binary()),
                 pa.array([r[0] for r in rows], pa.int32())]
                + [pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 7)],
                names=["chunk", "bucket", "key", "more", "at", "known", "tags", "sizes"])

        for b in batches:
            for tag, text, hits in zip(text_bytes(b.column(0)), text_bytes(b.column(1)),
                                       b.column(2)):
                lanes = word_hashes(text or b"", 2)
                n = len(lanes[0])
                if n < window:
                    continue
                k, m = (LANES[i].windows(lanes[i], window) for i in range(2))
                hit = np.zeros(n // block + 2, bool)
                hit[hits.values.to_numpy()] = True
                # the first whole block of the window that starts at p
                p = np.flatnonzero(hit[(np.arange(len(k)) + block - 1) // block])
                tags.append(tag), sizes.append(n)
                keys.append(k[p]), more.append(m[p]), at.append((p + base).astype(np.uint64))
                base += n
                if base >= CHUNK_WORDS:
                    yield send()
                    base = 0
        if base:
            yield send()
    return run


def _cover(places: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``places``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, places.astype(np.int64), 1)
    np.add.at(step, np.minimum(places.astype(np.int64) + window, n), -1)
    return np.cumsum(step[:-1]) > 0


def _repeated(rows: pa.Table) -> pa.Table:
    """Of one bucket, the places of each chunk's windows that another one equals."""
    key, more = _joined(rows["key"], 8), _joined(rows["more"], 8)
    parts = [_unpack(x.as_py(), 4) for x in rows["at"]]
    at, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    order = np.lexsort((more, key))
    key, more, at, row = key[order], more[order], at[order], row[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = (key[1:] == key[:-1]) & (more[1:] == more[:-1])
    found = (same[1:] | same[:-1]) & (at != U(0xFFFFFFFF))
    at, row = at[found], row[found]
    order = np.argsort(row, kind="stable")
    at, row = at[order], row[order]
    which = np.unique(row)
    chunks = rows["chunk"]
    edges = np.searchsorted(row, np.append(which, len(parts)))
    return pa.table({
        "chunk": pa.array([chunks[int(r)].as_py() for r in which], pa.binary()),
        "at": pa.array([_pack(at[a:b], 4) for a, b in zip(edges[:-1], edges[1:])], pa.binary())})


def _spans(window: int):
    """Answers and texts of one chunk to the texts' spans of repeated words."""

    def run(rows: pa.Table) -> pa.Table:
        own = next(i for i, x in enumerate(rows["tags"]) if x.as_py() is not None)
        sizes = _unpack(rows["sizes"][own].as_py(), 4).astype(np.int64)
        tags, n = rows["tags"][own].as_py(), int(sizes.sum())
        cover = np.unpackbits(np.frombuffer(rows["known"][own].as_py(), np.uint8), count=n).astype(bool)
        parts = [_unpack(x.as_py(), 4) for x in rows["at"] if x.as_py() is not None]
        if parts:
            cover |= _cover(np.concatenate(parts), n, window)
        names, spans, base = [], [], 0
        for i, size in enumerate(sizes.tolist()):
            own = cover[base:base + size]
            base += size
            if own.any():
                edge = np.diff(np.concatenate(([False], own, [False])).view(np.int8))
                names.append(tags[16 * i:16 * i + 16])
                spans.append(np.flatnonzero(edge).astype(np.int32))
        return pa.table({"tag": pa.array(names, pa.binary()),
                         "spans": pa.array(spans, pa.list_(pa.int32()))})
    return run


def _beside(small: DataFrame, size: int) -> DataFrame:
    return F.broadcast(small) if size <= BROADCAST_BYTES else small.hint("merge")


def repeated_spans(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """texts: (tag, text), one row for each different text; tag is its 16-byte
    digest. (tag, spans) for the texts that hold words covered by a window which
    occurs again in any of them; spans are the edges [first, end, first, end, ...]
    of the maximal runs of such words, numbered from 0. Runs jobs."""
    spark, block = texts.sparkSession, (window + 1) // 2
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, min(24, (4 * parts - 1).bit_length()))
    rid = F.xxhash64("tag").alias("rid")
    probes = texts.select(rid, "text").mapInArrow(_probes(block, bits), PROBES)
    hits = probes.groupBy("bucket").applyInArrow(_hit_blocks, "rid long, place int")
    hits = cut(hits.groupBy("rid").agg(F.collect_list("place").alias("places")), "hit-blocks")
    n, places = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    # a rid shared by two texts only adds windows to compare
    near = (texts.select("tag", "text", rid).join(_beside(hits, 64 * n + 4 * places), "rid")
            .select("tag", "text", "places"))
    chunks = cut(near.mapInArrow(_windows(window, block, bits), CHUNKS), "window-chunks")
    answers = (chunks.where("bucket >= 0").select("bucket", "chunk", "key", "more", "at")
               .groupBy("bucket").applyInArrow(_repeated, "chunk binary, at binary"))
    named = chunks.where("bucket < 0").select("chunk", F.lit(None).cast("binary").alias("at"),
                                              "known", "tags", "sizes")
    none = F.lit(None).cast("binary")
    every = named.union(answers.select("chunk", "at", none, none, none))
    return cut(every.groupBy("chunk").applyInArrow(_spans(window), "tag binary, spans array<int>"),
               "spans")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """One row per row of ``df``: its columns with ``text_col`` replaced by the
    kept words, joined by single spaces, and n_words, n_removed (columns of those
    names are replaced). A word goes if a window of ``window`` consecutive words
    that covers it has a word sequence which also starts anywhere else in the
    table, same text included, as the input stands.

    Null text has no words and stays null, empty text stays empty; texts shorter
    than the window lose nothing. Repeated rows are copies of one another: at
    ``window`` words or more they lose all. Ids are not looked at, so they may be
    null or repeated. Very long texts are hashed in pieces. An empty table gives an
    empty one. Runs jobs."""
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    tagged = df.select(F.col(f"`{text_col}`").alias("text"), digest.alias("tag"))
    copies = cut(tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                 .select("tag"), "copied-texts")
    n_copied = copies.count()
    copied = F.col("copied").isNotNull()
    mark = lambda rows: rows.join(_beside(
        copies.select(F.col("tag").alias("copied")), 64 * n_copied), F.col("tag") == F.col("copied"),
        "left")
    marked = mark(tagged)
    alone = marked.where(~copied).select("tag", "text")
    # of copies only one text goes on; they meet by digest, combined on the map side
    one = (marked.where(copied).groupBy("tag").agg(F.max("text").alias("text")))
    spans = repeated_spans(alone.union(one), window)
    n, edges = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    small = _beside(spans.select(F.col("tag").alias("__t"), F.col("spans").alias("__spans")),
                    64 * n + 4 * edges)
    rows = df.withColumn("__tag", digest)
    rows = rows.join(_beside(copies.select(F.col("tag").alias("__copied")), 64 * n_copied),
                     F.col("__tag") == F.col("__copied"), "left")
    rows = rows.join(small, F.col("__tag") == F.col("__t"), "left")
    own = [c for c in df.columns if c.lower() not in ("n_words", "n_removed")]
    fact = F.struct(F.col(f"`{text_col}`").alias("text"),
                    F.col("__copied").isNotNull().alias("copied"), F.col("__spans").alias("spans"))
    rows = rows.withColumn("__fact", fact)

    def make():
        def run(facts):
            texts, total, gone = [], [], []
            for text, copied, spans in zip(text_bytes(facts.field("text")), facts.field("copied"),
                                           facts.field("spans")):
                words = (text or b"").split()
                n, kept = len(words), words
                if copied.as_py() and n >= window:
                    kept = []
                elif spans.is_valid:
                    edges = [0, *spans.values.to_numpy().tolist(), n]
                    kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                texts.append(None if text is None else b" ".join(kept))
                total.append(n), gone.append(n - len(kept))
            return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()),
                    pa.array(gone, pa.int64())]
        return run

    return add_columns(rows, "__fact", [
        T.StructField(text_col, T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType())], make, [c for c in own if c != text_col])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(text, 256).alias("kept_sha256"))
