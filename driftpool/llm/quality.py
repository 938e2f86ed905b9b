"""Quality by a byte-level convolutional network in numpy (operator 12).

Method: a text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes, each of which
begins ``OVERLAP`` bytes before the last one ends, so that the chunks cover the whole
text and no pattern falls between two. Bytes are embedded, learned filters of
``WIDTH`` bytes slide over a chunk in steps of ``STRIDE``, and every filter's largest
response in the chunk is kept. A small hidden layer reads a chunk's pooled responses;
the mean and the maximum of its units over a text's chunks give one probability.
Chunks are short, so that a stretch of one word said again and again shows by the
filters that find nothing in it.

All layers, the embedding included, are learned by gradient descent on a bounded,
labelled sample: at most ``FIT_ROWS`` different texts of at most ``FIT_TEXT`` bytes
(longer ones are scored, but not learned from) and ``FIT_BYTES`` in all. Texts are
scored row by row in Arrow batches, whole, without a shuffle, ``AT_ONCE`` chunks at a
time however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpool.llm.common import Shared, add_columns, crc_remainder, cut, drawn, table, text_bytes

QUERY_NAME = "op12_quality"
ORACLE_SQL = None  # tests hold gradients against differences and scores against held-out labels
THRESHOLD = 0.3
CHUNK, OVERLAP, WIDTH, STRIDE = 512, 16, 8, 4
EMBED, FILTERS, HIDDEN = 8, 48, 16
#: bounds of the fitting sample
FIT_ROWS, FIT_TEXT, FIT_BYTES = 5000, 64 << 10, 24 << 20
#: passes over the sample at most, texts a step, step size, and the loss that is low enough
EPOCHS, BATCH, RATE, ENOUGH = 10, 32, 4e-3, 0.01
DROP = 0.15  # share of a text's filters that are left out of a step
AT_ONCE = 128
FOLDS, HELD = 5, 0


@dataclass
class Net:
    """byte: embedding of each byte (0, the padding, stays zero); near: the filters;
    mix: from a chunk's pooled responses to its hidden units; out: from their mean and
    maximum over a text to its logit; a bias for each."""

    byte: np.ndarray
    near: np.ndarray
    near_bias: np.ndarray
    mix: np.ndarray
    mix_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, seed: int = 42) -> Net:
        r = np.random.default_rng(seed)
        layer = lambda n, m: (r.standard_normal((n, m)) * np.sqrt(2.0 / n)).astype(np.float32)
        zero = lambda n: np.zeros(n, np.float32)
        byte = r.standard_normal((256, EMBED)).astype(np.float32) * 0.5
        byte[0] = 0
        return cls(byte, layer(WIDTH * EMBED, FILTERS), zero(FILTERS), layer(FILTERS, HIDDEN),
                   zero(HIDDEN), layer(2 * HIDDEN, 1)[:, 0], zero(1))

    def layers(self) -> list[np.ndarray]:
        return [self.byte, self.near, self.near_bias, self.mix, self.mix_bias, self.out, self.out_bias]

    def respond(self, chunks: np.ndarray) -> np.ndarray:
        """Every filter's response at every place of every chunk. A window is two
        steps wide, so the two halves of the filters are applied to steps."""
        steps = self.byte[chunks].reshape(len(chunks), CHUNK // STRIDE, STRIDE * EMBED)
        half = STRIDE * EMBED
        return steps[:, :-1] @ self.near[:half] + steps[:, 1:] @ self.near[half:]

    def hidden(self, chunks: np.ndarray) -> np.ndarray:
        """Hidden units of each chunk, from each filter's largest response, if positive."""
        pooled = np.maximum(self.respond(chunks).max(1) + self.near_bias, 0)
        return np.maximum(pooled @ self.mix + self.mix_bias, 0)

    def scores(self, texts: Iterable[bytes | None]) -> np.ndarray:
        """The probability of each text, ``AT_ONCE`` chunks in memory."""
        total, most, count = [], [], []
        chunks, owners = np.zeros((AT_ONCE, CHUNK), np.uint8), []

        def flush() -> None:
            for i, p in zip(owners, self.hidden(chunks[:len(owners)])):
                total[i] += p
                np.maximum(most[i], p, out=most[i])
            owners.clear()

        for i, text in enumerate(texts):
            total.append(np.zeros(HIDDEN)), most.append(np.zeros(HIDDEN, np.float32)), count.append(0)
            for part in cut_text(text):
                chunks[len(owners), :len(part)] = part
                chunks[len(owners), len(part):] = 0
                owners.append(i)
                count[i] += 1
                if len(owners) == AT_ONCE:
                    flush()
        if owners:
            flush()
        if not count:
            return np.zeros(0)
        units = np.column_stack([np.array(total) / np.array(count)[:, None], np.array(most)])
        return 1.0 / (1.0 + np.exp(-np.clip(units @ self.out + self.out_bias, -30, 30)))

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, y: np.ndarray,
                  weight: np.ndarray | float = 1.0, dropped: np.ndarray | None = None):
        """(mean loss, gradient of each layer) of some texts; owner: each chunk's text,
        ascending; weight: of each text; dropped: factors for each text's filters. Only
        the place where a filter responds most passes a gradient on."""
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = np.zeros((len(chunks), FILTERS), np.int64)
        pooled = np.zeros((len(chunks), FILTERS), self.near.dtype)
        for at in range(0, len(chunks), AT_ONCE):
            got = self.respond(chunks[at:at + AT_ONCE])
            best[at:at + AT_ONCE] = got.argmax(1)
            pooled[at:at + AT_ONCE] = got.max(1)
        factor = 1 if dropped is None else dropped[owner]
        pooled = np.maximum(pooled + self.near_bias, 0) * factor
        hidden = np.maximum(pooled @ self.mix + self.mix_bias, 0)
        size = np.diff(np.append(first, len(owner)))[:, None]
        most = np.maximum.reduceat(hidden, first)
        text = np.column_stack([np.add.reduceat(hidden, first) / size, most])
        logit = text @ self.out + self.out_bias
        p = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
        loss = float(np.mean(weight * (np.logaddexp(0, logit) - y * logit)))

        d_logit = (weight * (p - y) / len(y)).astype(self.out.dtype)
        d_text = d_logit[:, None] * self.out
        # the maximum over a text's chunks is the first chunk's that attains it
        top = hidden == most[owner]
        seen = np.cumsum(top, axis=0)
        top &= seen - (seen[first] - top[first])[owner] == 1
        d_hidden = ((d_text[:, :HIDDEN] / size)[owner] + d_text[:, HIDDEN:][owner] * top) * (hidden > 0)
        d_pool = d_hidden @ self.mix.T * (pooled > 0) * factor
        places = (best * STRIDE)[:, :, None] + np.arange(WIDTH)
        window = np.take_along_axis(chunks, places.reshape(len(chunks), -1), 1)
        window = window.reshape(len(chunks), FILTERS, WIDTH)
        inputs = self.byte[window].reshape(len(chunks), FILTERS, WIDTH * EMBED)
        back = (d_pool[:, :, None] * self.near.T).reshape(-1, EMBED)
        d_byte = np.column_stack([np.bincount(window.ravel(), back[:, k], 256) for k in range(EMBED)])
        d_byte[0] = 0
        return loss, [d_byte, np.einsum("nf,nfd->df", d_pool, inputs), d_pool.sum(0),
                      pooled.T @ d_hidden, d_hidden.sum(0), text.T @ d_logit, d_logit.sum(keepdims=True)]

    def learn(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> list[float]:
        """Mean loss of each pass over the texts (Adam, fixed order of batches)."""
        r = np.random.default_rng(7)
        means = [np.zeros_like(x) for x in self.layers()]
        squares = [np.zeros_like(x) for x in self.layers()]
        # the rarer label counts as much as the other
        weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        losses, step = [], 0
        total = max(1, epochs * -(-len(texts) // BATCH))
        for _ in range(epochs):
            order, seen = r.permutation(len(texts)), []
            for at in range(0, len(texts), BATCH):
                own = order[at:at + BATCH]
                # another grid of chunks and windows each time
                moved = [texts[i][r.integers(min(CHUNK, 1 + len(texts[i]) // 4)):] for i in own]
                parts = [(k, part) for k, text in enumerate(moved) for part in cut_text(text)]
                chunks = np.zeros((len(parts), CHUNK), np.uint8)
                for row, (_, part) in zip(chunks, parts):
                    row[:len(part)] = part
                dropped = (r.random((len(own), FILTERS), np.float32) >= DROP).astype(np.float32) / (1 - DROP)
                loss, grads = self.gradients(chunks, np.array([k for k, _ in parts]), labels[own],
                                             weight[own], dropped)
                seen.append(loss * len(own))
                rate = RATE * (1 - step / total)
                step += 1
                for x, g, m, s in zip(self.layers(), grads, means, squares):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
            losses.append(sum(seen) / len(texts))
            if losses[-1] < ENOUGH:
                break
        return losses


def cut_text(text: bytes | None) -> Iterable[np.ndarray]:
    """A text's chunks; an empty text has an empty one."""
    raw = np.frombuffer(text or b"", np.uint8)
    for at in range(0, max(1, len(raw) - OVERLAP), CHUNK - OVERLAP):
        yield raw[at:at + CHUNK]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, epochs: int = EPOCHS) -> Net:
    """The network learned from a bounded sample: labelled rows (``labels.quality`` of
    the same doc_id; the largest, if there are several) with the smallest hashed ids,
    each different text once. Rows with a null id, text or label are not used;
    without rows of both labels every text scores the share of good ones (0.5 where
    there are none). Runs jobs; what reaches the driver is bounded by the sample."""
    marks = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg(F.max("quality").alias("quality")))
    ids = cut(docs.select("doc_id").distinct().join(marks, "doc_id")
              .withColumn("u", drawn("doc_id")), "labelled-rows")
    # twice the share that is needed, so that sorting never sees more
    few = ids.where(F.col("u") * ids.count() < 2 * fit_rows)
    sample = cut(few.orderBy("u", "doc_id").limit(fit_rows), "fit-rows")
    texts = (docs.select("doc_id", "text").where(F.octet_length("text") <= FIT_TEXT)
             .join(F.broadcast(sample), "doc_id").groupBy(F.md5("text").alias("tag"))
             .agg(F.max("quality").alias("quality"), F.max("text").alias("text"), F.min("u").alias("u"))
             .orderBy("u", "tag").limit(fit_rows))
    texts = cut(texts, "fit-texts")
    sizes = texts.select("u", "tag", F.octet_length("text").alias("size")).toPandas().sort_values(["u", "tag"])
    within = sizes[sizes["size"].cumsum() <= FIT_BYTES]
    if not len(within):
        return _flat(0, 0)
    u, tag = float(within["u"].iloc[-1]), within["tag"].iloc[-1]
    got = texts.where((F.col("u") < u) | (F.col("u") == u) & (F.col("tag") <= tag)).orderBy("u", "tag")
    got = got.select("text", "quality").toArrow()
    y = got["quality"].to_numpy().astype(np.float32)
    good = int((y > 0).sum())
    if not 0 < good < len(y):
        return _flat(good, len(y))
    net = Net.start()
    net.learn([x for c in got["text"].chunks for x in text_bytes(c)], (y > 0).astype(np.float32), epochs)
    return net


def _flat(good: int, n: int) -> Net:
    net = Net.start()
    net.out[:] = 0
    net.out_bias[:] = np.log((good + 1e-9) / (n - good + 1e-9))
    return net


def score(df: DataFrame, net: Net, text_col: str = "text", threshold: float = THRESHOLD,
          keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with score (0 to 1) and predicted (1 if
    score >= threshold). Null text scores as an empty one, which is one blank chunk.
    Row by row: repeated rows, null ids and other columns pass through; columns named
    score or predicted are replaced."""
    shared = Shared(df.sparkSession, net)

    def make():
        own = shared.value

        def run(texts):
            s = own.scores(text_bytes(texts))
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
        return run

    return add_columns(df, text_col, [T.StructField("score", T.DoubleType()),
                                      T.StructField("predicted", T.IntegerType())], make, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_remainder("doc_id", FOLDS, HELD)
    net = fit(docs.where(~held).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), net,
                 keep=["doc_id", "held_out"])
