"""Benchmark decontamination (operator 9).

Method: seeds, word n-grams that a text shares with a test item, join passages of the
text to items; Smith-Waterman alignment of words then scores each passage, which
tolerates replaced, lost and added words. Hits of an item are binned by diagonal (text
place less item place), no wider than the alignment's slack; the rarest n-gram of a
bin is its seed, and the bin, widened by that slack, is the passage. Any n-gram may
become a seed, so a copy is looked at wherever it keeps ``NGRAM`` words in a row; of an
n-gram that an item repeats, only the first and the last place count, so the work is
linear in a text's places. An item's passages are aligned from the rarest seed on, and
a passage that holds too few of the item's words to reach the threshold in any
order, as those hit by common phrases alone, is not aligned.

While the items' texts have at most ``BROADCAST_BYTES``, which is measured, they are
broadcast with their n-grams, and texts are scanned where they lie, once. Beyond
that the n-grams of items and texts meet in a join on their hash, and so do, in
turn, passages with texts and with items: nothing whole passes the driver or a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftpool.llm.common import Shared, add_columns, cut, table

QUERY_NAME = "op9_benchmark_decontamination"
ORACLE_SQL = None  # alignment is no SQL; tests hold it against brute force
NGRAM = 3
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: a passage counts if its alignment reaches this share of a perfect copy's score
MIN_SCORE = 0.4
#: or that of this many words copied without a change, in items of which that is less
MIN_WORDS = 20
#: bound of the items' texts that are broadcast, with some ten times as much beside them
BROADCAST_BYTES = 8 << 20
#: ASCII that is neither letter nor digit separates words
SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(SPACED).split()


@dataclass
class Items:
    """Test items: words as numbers from 1, n-grams as sorted codes."""

    ids: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    number: dict[bytes, int] = field(default_factory=dict)
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: rows first[i] to first[i + 1] of ``seeds`` are the items that hold n-gram i
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    #: item, first and last place of an n-gram in it
    seeds: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    #: per item its distinct words and how often it has each
    bags: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def add(self, item_id, ws: list[bytes]) -> None:
        self.ids.append(item_id)
        self.words.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws],
                                   np.int64))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A code for each run of NGRAM words; 0 where one of them is in no item."""
        n = len(ids) - NGRAM + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(NGRAM):
            out = out * (len(self.number) + 1) + ids[i:i + n]
            known &= ids[i:i + n] > 0
        return np.where(known, out, 0)

    def close(self) -> Items:
        codes = [self.codes(w) for w in self.words]
        flat = np.concatenate(codes or [np.zeros(0, np.int64)])
        owners = np.repeat(np.arange(len(codes)), [len(c) for c in codes]).astype(np.int64)
        places = np.concatenate([np.arange(len(c)) for c in codes] or [np.zeros(0, np.int64)])
        order = np.lexsort((places, owners, flat))
        flat, owners, places = flat[order], owners[order], places[order]
        new = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (owners[1:] != owners[:-1]))[:len(flat)])
        last = np.append(new[1:], len(flat)) - 1
        self.seeds = np.column_stack([owners[new], places[new], places[last]]) if len(new) else self.seeds
        self.grams, first = np.unique(flat[new], return_index=True)
        self.first = np.append(first, len(new))
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        return self

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Rows (item, lowest and highest diagonal, items that hold the n-gram) of all
        item n-grams in a text."""
        codes = self.codes(ids)
        places = np.flatnonzero(codes)
        if not len(places) or not len(self.grams):
            return np.zeros((0, 4), np.int64)
        codes = codes[places]
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        hit = self.grams[at] == codes
        places, at = places[hit], at[hit]
        times = self.first[at + 1] - self.first[at]
        rows = np.repeat(self.first[at] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        places, own = np.repeat(places, times), self.seeds[rows]
        return np.column_stack([own[:, 0], places - own[:, 2], places - own[:, 1],
                                np.repeat(times, times)])


def most(bag: tuple[np.ndarray, np.ndarray], passage: np.ndarray) -> float:
    """No alignment of an item with the passage scores more: the words they share."""
    own, times = bag
    at = np.minimum(np.searchsorted(own, passage), len(own) - 1)
    held = np.bincount(at[own[at] == passage], minlength=len(own))
    return MATCH * float(np.minimum(held, times).sum())


def numbers(ws: list, number: dict) -> np.ndarray:
    get = number.get
    return np.array([get(w, 0) for w in ws], np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best Smith-Waterman score of the two word sequences, linear gaps, and the
    passage word at which that alignment ends. Words numbered 0 match nothing."""
    slope = -GAP * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1), 0.0, 0
    for w in item:
        step = np.where(passage == w, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0.0)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        row = np.maximum.accumulate(new + slope) - slope  # gaps along the passage
        at = int(np.argmax(row))
        if row[at] > best:
            best, end = float(row[at]), at
    return best, end


def binned(hits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (item, first word, end word, rarity): passages of a text, one for each bin
    of an item's diagonals, the end not cut to the text; bins that overlap are one.
    ``sizes``: words of each hit's item."""
    if not len(hits):
        return np.zeros((0, 4), np.int64)
    item, lo, hi, rarity = hits.T
    room = np.maximum(8, sizes // 3)
    order = np.lexsort((lo // room, item))
    item, lo, hi, rarity, room, sizes = (x[order] for x in (item, lo, hi, rarity, room, sizes))
    new = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (lo[1:] // room[1:] != lo[:-1] // room[:-1])))
    first = np.minimum.reduceat(lo, new) - room[new]
    end = np.maximum.reduceat(hi, new) + sizes[new] + room[new]
    rare, item = np.minimum.reduceat(rarity, new), item[new]
    out: list[list[int]] = []
    for row in np.column_stack([item, first, end, rare]).tolist():
        if out and out[-1][0] == row[0] and row[1] <= out[-1][2]:
            out[-1][2:] = max(out[-1][2], row[2]), min(out[-1][3], row[3])
        else:
            out.append(row)
    return np.array(out, np.int64)


def best_passage(own: np.ndarray, bag, parts: list[tuple[int, np.ndarray]], min_score: float,
                 min_words: int) -> tuple[float, int, int] | None:
    """(score, first word, end word) of an item's best passage among ``parts`` (first
    word, words), ties to the earlier part; None where none reaches ``min_score`` or
    the score of ``min_words`` words in a row."""
    best, least = None, min(min_score, min_words / len(own))
    for lo, passage in parts:
        if most(bag, passage) / (MATCH * len(own)) < max(least, best[0] if best else 0):
            continue
        score, end = align(own, passage)
        score /= MATCH * len(own)
        if score >= least and (best is None or score > best[0]):
            back, size = align(own[::-1], passage[:end][::-1])
            best = (score, lo + end - size, lo + end)
            if score >= 1:
                break
    return best


def passages(ids: np.ndarray, items: Items,
             min_score: float, min_words: int) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, end word) of each item's best passage in a text."""
    hits = items.hits(ids)
    sizes = np.array([len(items.words[i]) for i in hits[:, 0]], np.int64)
    own: dict[int, list[tuple[int, int, int]]] = {}
    for item, lo, hi, rare in binned(hits, sizes).tolist():
        own.setdefault(item, []).append((rare, max(0, lo), min(len(ids), hi)))
    for item, parts in own.items():  # the rarest seed first
        best = best_passage(items.words[item], items.bags[item],
                            [(lo, ids[lo:hi]) for _, lo, hi in sorted(parts)], min_score, min_words)
        if best is not None:
            yield item, *best


def _few(items: DataFrame, text_col: str) -> bool:
    """Whether the items' texts are small enough to be broadcast."""
    size = items.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    return size <= BROADCAST_BYTES


def _read(items: DataFrame, id_col: str, text_col: str) -> Items:
    out = Items()
    for item_id, text in items.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).collect():
        out.add(item_id, words_of(text))
    return out.close()


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_id: str = "item_id", item_text: str = "text",
            min_score: float = MIN_SCORE, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (id, item_id, score, first_word, end_word): the best passage of each
    text for each test item it leaks, where the alignment score is at least
    ``min_score`` of a perfect copy's, or at least that of ``min_words`` words copied
    without a change (an excerpt of a long item; its score is the share all the same).
    Of passages that score alike the one with the rarest seed counts, then the first.

    Null, empty and one- or two-word texts or items match nothing (a seed has three
    words). Items of the same text all match; repeated rows of ``docs`` give
    repeated rows; null ids stay null. Empty tables give none. Other columns are
    ignored. Measures the items (a job)."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([
        T.StructField(id_col, src.schema["id"].dataType),
        T.StructField("item_id", items.schema[item_id].dataType), T.StructField("score", T.DoubleType()),
        T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
    if not _few(items, item_text):
        src = src.withColumn("row", F.monotonically_increasing_id())
        found = _joined(src, items, item_id, item_text, min_score, min_words)
        return found.select(F.col("id").alias(id_col), "item_id", "score", "first_word", "end_word")
    shared = Shared(docs.sparkSession, _read(items, item_id, item_text))
    kinds = [b.type for b in _arrow(schema)]

    def scan(batches):
        own = shared.value
        for b in batches:
            rows = [(i, own.ids[item], score, first, end)
                    for i, t in zip(b.column(0).to_pylist(), b.column(1))
                    for item, score, first, end in
                    passages(numbers(words_of(t.as_py()), own.number), own, min_score, min_words)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    return src.mapInArrow(scan, schema)


def _joined(src: DataFrame, items: DataFrame, item_id: str, item_text: str, min_score: float,
            min_words: int) -> DataFrame:
    """``matches`` by joins, for items of any number: src has (id, text, row), rows
    numbered. Returns (row, id, item_id, score, first_word, end_word). Runs jobs.

    Words are written once for texts and items. Hits, a row for each place of a
    text's n-gram and item that holds it, are binned on the map side of one shuffle
    on (row, item); passages alone, not texts, travel on to the items."""
    texts = cut(_worded(src, "text", ["row", "id"]), "decontam-texts")
    own = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    tests = cut(_worded(own.withColumn("item", F.monotonically_increasing_id()), "text",
                        ["item", "item_id"]), "decontam-items")
    held = (_grams(tests.select("item", "words"), "item").groupBy("code", "item")
            .agg(F.min("place").alias("low"), F.max("place").alias("high")))
    rarity = F.count(F.lit(1))
    held = held.join(held.groupBy("code").agg(rarity.alias("rarity")), "code").join(
        tests.select("item", F.size("words").alias("size")), "item")
    held = cut(held, "decontam-seeds")
    room = F.greatest(F.lit(8), F.floor(F.col("size") / 3))
    low = F.col("place") - F.col("high")
    bins = (_grams(texts.select("row", "words"), "row").join(held, "code")
            .groupBy("row", "item", F.floor(low / room).alias("bin"))
            .agg((F.min(low) - F.first(room)).alias("lo"),
                 (F.max(F.col("place") - F.col("low")) + F.first("size") + F.first(room)).alias("hi"),
                 F.min("rarity").alias("rarity")))
    # bins that overlap are one passage
    before = Window.partitionBy("row", "item").orderBy("lo", "bin").rowsBetween(
        Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row", "item").orderBy("lo", "bin")
    spans = (bins.withColumn("new", F.coalesce((F.col("lo") > F.max("hi").over(before)).cast("int"), F.lit(1)))
             .withColumn("part", F.sum("new").over(upto)).groupBy("row", "item", "part")
             .agg(F.greatest(F.min("lo"), F.lit(0)).alias("lo"), F.max("hi").alias("hi"),
                  F.min("rarity").alias("rarity")))
    cut_out = spans.join(texts, "row").select(
        "row", "id", "item", "lo", "rarity",
        F.slice("words", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("passage"))
    pairs = cut_out.join(tests.select("item", "item_id", "words"), "item").groupBy("row", "item").agg(
        F.first("id").alias("id"), F.first("item_id").alias("item_id"), F.first("words").alias("words"),
        F.sort_array(F.collect_list(F.struct("rarity", "lo", "passage"))).alias("parts"))
    schema = T.StructType([pairs.schema["row"], pairs.schema["id"], pairs.schema["item_id"],
                           T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()),
                           T.StructField("end_word", T.LongType())])
    kinds = [b.type for b in _arrow(schema)]

    def score(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                number: dict[str, int] = {}
                own = np.array([number.setdefault(w, len(number) + 1) for w in row["words"]], np.int64)
                parts = [(p["lo"], numbers(p["passage"], number)) for p in row["parts"]]
                best = best_passage(own, np.unique(own, return_counts=True), parts, min_score, min_words)
                if best is not None:
                    out.append((row["row"], row["id"], row["item_id"], *best))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    return pairs.select("row", "id", "item_id", "words", "parts").mapInArrow(score, schema)


def _worded(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    def make():
        return lambda texts: [pa.array([[w.decode() for w in words_of(t.as_py())] for t in texts],
                                       pa.list_(pa.string()))]

    return add_columns(df, text_col, [T.StructField("words", T.ArrayType(T.StringType()))], make, keep)


def _grams(rows: DataFrame, key: str) -> DataFrame:
    """(key, code, place): the hash of every run of NGRAM words."""
    last = F.size("words") - NGRAM
    code = F.xxhash64(*[F.element_at("words", (F.col("place") + i + 1).cast("int")) for i in range(NGRAM)])
    return (rows.where(last >= 0).select(key, "words", F.explode(F.sequence(F.lit(0), last)).alias("place"))
            .select(key, code.alias("code"), F.col("place").cast("long").alias("place")))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", min_score: float = MIN_SCORE,
               min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text leaks no test item; columns unchanged. Row
    by row, so ids may be null or repeated. See ``matches``."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    if not _few(items, item_text):
        rows = cut(docs.select(*names, F.monotonically_increasing_id().alias("__row")), "decontam-rows")
        src = rows.select(F.col("__row").alias("row"), F.col("__row").alias("id"),
                          F.col(f"`{text_col}`").alias("text"))
        leaks = _joined(src, items, item_id, item_text, min_score, min_words)
        return rows.join(leaks.select(F.col("row").alias("__row")), "__row", "left_anti").select(*names)
    shared = Shared(docs.sparkSession, _read(items, item_id, item_text))

    def make():
        own = shared.value
        return lambda texts: [pa.array([any(True for _ in passages(
            numbers(words_of(t.as_py()), own.number), own, min_score, min_words)) for t in texts],
            pa.bool_())]

    marked = add_columns(docs, text_col, [T.StructField("__leaks", T.BooleanType())], make)
    return marked.where("not __leaks").select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
