"""Language identification by bit-sliced n-gram filters (operator 2).

Method: each language's n-grams form a Bloom filter, and the filters are sliced:
one table of slots whose bit l belongs to language l. An n-gram reads its slots
and ANDs them, which gives all languages that contain it at once. A text's bits
are counted per language, the counts are corrected for the filter's false
positives (its fill to the power of the hash count), and the largest corrected
share of known n-grams decides.

The filter has a fixed size (``SLOTS`` x 8 bytes for each 64 languages), whatever
the corpus; it is fitted on a bounded sample and broadcast. Texts are scored row
by row in Arrow batches, whole, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftpool.llm.common import Shared, add_columns, cut, drawn, held_out, table

QUERY_NAME = "op2_language_id"
ORACLE_SQL = None  # tests hold it against a set-based version and held-out accuracy
UNKNOWN = "und"
NGRAM, HASHES, SLOTS = 5, 3, 1 << 20
#: bound of the fitting sample: rows per language with the smallest hashed ids
FIT_ROWS = 500
#: an n-gram enters a language's filter if so many of its sample texts hold it, one
#: where the sample has fewer than FEW_TEXTS
MIN_TEXTS, FEW_TEXTS = 2, 10
#: the pipeline rejects texts of which fewer n-grams are known to their language
MIN_SCORE = 0.2
CHUNK = 1 << 20
MAX_BROADCAST_LANGS = 100_000

#: ASCII that is no letter reads as a space
SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (Unicode category L; digits, superscripts,
    fractions and number forms are none)."""
    return any(map(str.isalpha, text or ""))


def gram_chunks(text: str) -> Iterator[np.ndarray]:
    """The text's n-grams of bytes, repeats included, as integers, ``CHUNK`` at a time:
    lower case, runs of non-letters read as one space, a space at either end."""
    flat = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(SPACED).split()) + b" "
    raw = np.frombuffer(flat.ljust(NGRAM), np.uint8)
    for at in range(0, len(raw) - NGRAM + 1, CHUNK):
        part = raw[at:at + CHUNK + NGRAM - 1].astype(np.uint64)
        n = len(part) - NGRAM + 1
        out = np.zeros(n, np.uint64)
        for i in range(NGRAM):
            out |= part[i:i + n] << np.uint64(8 * i)
        yield out


def grams(text: str) -> np.ndarray:
    """All of a text's n-grams."""
    return np.concatenate(list(gram_chunks(text)))


def distinct_grams(text: str) -> np.ndarray:
    out = np.zeros(0, np.uint64)
    for part in gram_chunks(text):
        out = np.union1d(out, part)
    return out


def _slots(codes: np.ndarray, k: int) -> np.ndarray:
    shift = np.uint64(64 - (SLOTS.bit_length() - 1))
    return ((codes + np.uint64(k)) * MULTIPLIERS[k]) >> shift


@dataclass
class Filter:
    """langs: language of bit l, most frequent first; masks: a row of slots for
    each 64 languages; false: each language's false-positive rate."""

    langs: list[str]
    masks: np.ndarray
    false: np.ndarray

    @classmethod
    def build(cls, langs: list[str], codes: np.ndarray, lang_at: np.ndarray) -> Filter:
        masks = np.zeros((max(1, -(-len(langs) // 64)), SLOTS), np.uint64)
        for k in range(HASHES):
            at = _slots(codes, k)
            np.bitwise_or.at(masks, (lang_at // 64, at),
                             np.uint64(1) << (lang_at % 64).astype(np.uint64))
        fill = [np.count_nonzero(masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / SLOTS
                for i in range(len(langs))]
        return cls(langs, masks, np.array(fill) ** HASHES)

    def shares(self, text: str) -> np.ndarray:
        """Per language, the share of the text's n-grams that it contains, less
        what false positives explain."""
        n, hits = 0, np.zeros(len(self.langs), np.int64)
        for part in gram_chunks(text):
            n += len(part)
            slots = [_slots(part, k) for k in range(HASHES)]
            for plane in range(len(self.masks)):
                found = self.masks[plane][slots[0]]
                for s in slots[1:]:
                    found = found & self.masks[plane][s]
                for bit in range(min(64, len(self.langs) - plane * 64)):
                    hits[plane * 64 + bit] += np.count_nonzero(found & np.uint64(1 << bit))
        return np.clip((hits / n - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        shares = self.shares(text)
        best = int(np.argmax(shares))  # ties: the language more frequent in the sample
        return self.langs[best], float(shares[best])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_lang: int = FIT_ROWS) -> Filter:
    """The filter of a bounded sample: of each non-null language the
    ``rows_per_lang`` rows with the smallest hashed ids (ties: smaller id), a single
    one if there are no more. Rows with null text or language are not used. Runs jobs; what reaches the driver is
    bounded by the sample."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                      F.col(f"`{lang_col}`").alias("lang")).where(
        "lang is not null and text is not null and id is not null")
    # twice the share that is needed, so that ranking a language never sees more;
    # sizes, one row a language, are broadcast so that rows need not meet by language
    sizes = cut(src.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "language-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST_LANGS else sizes
    few = (src.select("id", "lang", drawn("id").alias("u")).join(sizes, "lang")
           .where(F.col("u") * F.col("size") < 2 * rows_per_lang))
    pick = Window.partitionBy("lang").orderBy("u", "id")
    ids = cut(few.withColumn("n", F.row_number().over(pick))
              .where(F.col("n") <= rows_per_lang).select("id", "lang").distinct(), "fit-rows")
    counts = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    langs, full = [r.lang for r in counts], sum(r["count"] >= FEW_TEXTS for r in counts)
    place = {x: i for i, x in enumerate(langs)}

    def run(batches):
        for b in batches:
            codes = [distinct_grams(t) for t in b.column(0).to_pylist()]
            if codes:
                at = [np.full(len(c), place[x], np.int32)
                      for c, x in zip(codes, b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(codes).view(np.int64)), pa.array(np.concatenate(at))],
                    names=["code", "lang"])

    rows = src.join(F.broadcast(ids), ["id", "lang"]).select("text", "lang")
    found = (rows.mapInArrow(run, "code long, lang int").groupBy("lang", "code")
             .agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= F.when(F.col("lang") < full, MIN_TEXTS).otherwise(1))
             .select("lang", "code").toArrow())
    return Filter.build(langs, found["code"].to_numpy().view(np.uint64), found["lang"].to_numpy())


def identify(df: DataFrame, learned: Filter, text_col: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with lang_pred and score, the corrected
    share of the text's n-grams known to that language (0 to 1).

    Null text and text without a letter: ``und``, score 0; so is all text where
    nothing was learned. No n-gram known to any language: the most frequent
    language, score 0. Row by row: repeated rows, null ids and other columns pass
    through; columns named lang_pred or score are replaced."""
    shared = Shared(df.sparkSession, learned)

    def make():
        model = shared.value

        def run(texts):
            found = [model.predict(t.as_py()) for t in texts]
            return [pa.array([x for x, _ in found], pa.string()),
                    pa.array([x for _, x in found], pa.float64())]
        return run

    return add_columns(df, text_col, [T.StructField("lang_pred", T.StringType()),
                                      T.StructField("score", T.DoubleType())], make, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = fit(docs.where(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, learned, keep=["doc_id", "held_out"])
