"""Batched text enrichment (U01-U03): encode, translate, score.

Model weights do not ship, so every step has a deterministic built-in default
written as Spark expressions (no Python worker, whole texts) and a pluggable
hook: a batch function run through ``mapInPandas`` - the model is loaded once
per task, texts go through it in fixed-size batches, and a failing batch is
isolated instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftpool.functions.clean import clean_text, composite_key
from driftpool.functions.layout import spread
from driftpool.session import write_shared
from driftpool.sources.keyed import append_bucketed, append_if_absent, table_or_none

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
WORD_SPLIT = r"[ \t\n\x0B\f\r]+"


def tokens(text: Column) -> Column:
    """Letter/digit runs of the whole text, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)


def token_bucket(tok: Column, dim: int) -> Column:
    """First 6 hex digits of md5(token) as a number, mod dim."""
    return (F.conv(F.substring(F.md5(tok), 1, 6), 16, 10).cast("bigint") % dim).cast("int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often ``body``
    uses it: the value is bound to a lambda variable. The expression then stays
    one expression even where Catalyst inlines it (filters pushed through a
    projection, e.g. the one inferred for an explode), so nothing is recomputed
    per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed_token_counts(text: Column, dim: int = 64) -> Column:
    """One text as a sparse vector: (bucket, n) of its hashed tokens, ascending.

    Row-local: a text's tokens are in its own row, so no explode, shuffle or join,
    whatever the corpus size. The buckets are sorted once and read off as runs: cost
    tokens x log tokens, whatever ``dim``. Each token is hashed once; the lambdas are
    interpreted, not compiled.
    """
    buckets = F.array_sort(F.transform(tokens(text), lambda t: token_bucket(t, dim)))

    def runs(b: Column) -> Column:
        changes = lambda x, i: (i == 0) | (b[i] != b[F.greatest(i - 1, F.lit(0))])
        starts = F.transform(F.filter(F.transform(b, lambda x, i: F.when(changes(x, i), i)),
                                      lambda i: i.isNotNull()), lambda i: i)
        return _let(starts, lambda s: F.transform(s, lambda at, k: F.struct(
            b[at].alias("bucket"),
            (F.coalesce(F.get(s, k + 1), F.size(b)) - at).cast("bigint").alias("n"))))

    return _let(buckets, runs)


def hashed_token_vector(text: Column, dim: int = 64) -> Column:
    """Default encoder for one text: L2-normalised counts of hashed tokens,
    array<float> of ``dim`` (zero vector for a text without tokens); the sparse form
    (``hashed_token_counts``) written out, gaps as runs of zeros."""
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))

    def dense(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x.n * x.n).cast("double"))

        def spread_out(n: Column) -> Column:
            def stretch(x: Column, k: Column) -> Column:
                before = F.coalesce(F.get(c, k - 1).bucket, F.lit(-1))
                return F.concat(zeros(x.bucket - before - 1), F.array((x.n / n).cast("float")))

            last = F.coalesce(F.get(c, F.size(c) - 1).bucket, F.lit(-1))
            return F.concat(F.flatten(F.transform(c, stretch)), zeros(F.lit(dim - 1) - last))

        return _let(norm, spread_out)

    # non-nullable: a NULL check Catalyst would infer (and push) folds away
    return F.coalesce(_let(hashed_token_counts(text, dim), dense), zeros(F.lit(dim)))


def prepare_messages(news: DataFrame) -> DataFrame:
    """U01 head: special_id = channel_message (P02), cleaned text (P01), empty
    texts dropped (F01)."""
    return (news.select(composite_key("channel_id", "message_id").alias("special_id"),
                        clean_text("text").alias("input_text"), "date")
            .where(F.length("input_text") > 0))


def batch_map(df: DataFrame, fn_factory: Callable[[], Callable[[list[str]], list]],
              text: str, out_col: str, out_type: str, batch_size: int,
              retries: int = 0) -> DataFrame:
    """Run a batch model over ``text`` with mapInPandas.

    ``fn_factory`` is called once per task (loads the model); its function maps
    a list of texts to a list of results of the same length. A batch that fails is
    tried again up to ``retries`` times, then text by text, each as often: only
    texts that fail on their own get ``out_col`` NULL and their error in
    ``_error``. Every row comes out once, from one evaluation, and what becomes of
    a text does not depend on the batch or partition it is in.
    """
    schema = f"{df.schema.simpleString()[7:-1]}, {out_col} {out_type}, _error string"

    def attempt(fn, texts: list[str]) -> tuple[list | None, str | None]:
        """(results, None), or (None, the last error) after all retries."""
        error = None
        for _ in range(retries + 1):
            try:
                res = list(fn(texts))
                if len(res) != len(texts):
                    raise ValueError(f"{len(res)} results for {len(texts)} texts")
                return res, None
            except Exception as e:  # whatever the model raises belongs to its texts
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = fn_factory()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size].copy()
                texts = chunk[text].tolist()
                res, error = attempt(fn, texts)
                if res is None and len(texts) > 1:
                    alone = [attempt(fn, [t]) for t in texts]
                    res = [r[0] if r else None for r, _ in alone]
                    errors = [e for _, e in alone]
                else:
                    res, errors = res or [None] * len(texts), [error] * len(texts)
                chunk[out_col] = pd.Series(res, index=chunk.index, dtype=object)
                chunk["_error"] = pd.Series(errors, index=chunk.index, dtype=object)
                yield chunk

    return df.mapInPandas(run, schema)


def encode_texts(news: DataFrame, model_name: str, dim: int = 64,
                 encoder_factory: Callable | None = None, batch_size: int = 192,
                 parts: int | None = None) -> DataFrame:
    """Messages -> rows for the vector table
    (special_id, model_name, input_text, embedding_vector, embedding_size, timestamp).
    With a hook, messages it fails on (alone) are dropped, and counted by
    ``encode_report``. ``parts``: see ``layout.spread``."""
    msgs = spread(prepare_messages(news), parts)
    if encoder_factory is None:
        enc = msgs.select("*", hashed_token_vector(F.col("input_text"), dim).alias("embedding"),
                          F.lit(dim).alias("embedding_size"))
    else:
        enc = batch_map(msgs, encoder_factory, "input_text", "embedding", "array<float>", batch_size)
        enc = (enc.where(F.col("_error").isNull()).drop("_error")
               .withColumn("embedding_size", F.size("embedding")))
    return enc.select("special_id", F.lit(model_name).alias("model_name"), "input_text",
                      F.col("embedding").alias("embedding_vector"), "embedding_size",
                      F.col("date").alias("timestamp"))


def store_vectors_if_absent(encoded: DataFrame, target_path: str) -> DataFrame:
    """U01 tail: the encoded rows appended to the vector table, one per
    (model_name, special_id) - the first by time and text; keys already stored are
    left alone. The table is kept bucketed by its key (``keyed.append_bucketed``), so
    stored vectors are not shuffled. Returns the table."""
    return append_bucketed(encoded, target_path, ["model_name", "special_id"],
                           ["timestamp", "input_text"])


def encode_report(total: DataFrame, encoded: DataFrame) -> DataFrame:
    """(processed, total) counts in one row."""
    return encoded.agg(F.count(F.lit(1)).alias("processed"),
                       total.select(F.count(F.lit(1))).scalar().alias("total"))


# The default word dictionary (English -> Russian) of the
# built-in translator; words not in it pass through unchanged.
EN_RU_WORDS = {
    "the": "этот", "of": "из", "and": "и", "to": "к", "a": "один", "in": "в", "is": "есть",
    "that": "что", "it": "оно", "for": "для", "was": "был", "on": "на", "with": "с",
    "be": "быть", "by": "по", "as": "как", "this": "это", "are": "являются", "at": "у",
    "from": "от",
}


def dictionary_translate(text: Column, words: dict[str, str] = EN_RU_WORDS) -> Column:
    """Default translator: each whitespace-separated word, lower-cased, looked
    up in a small literal map (no shuffle); unknown words pass through."""
    m = F.create_map(*[F.lit(x) for kv in sorted(words.items()) for x in kv])
    parts = F.split(text, WORD_SPLIT)
    return F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(m, F.lower(t)), t)), " ")


def translate_backlog(backlog: DataFrame, translator_factory: Callable | None = None,
                      batch_size: int = 32, max_retries: int = 2) -> DataFrame:
    """Every backlog message translated, same key and date, in one job.

    With a hook, a failed batch is retried up to ``max_retries`` times within its
    task, then text by text; messages that still fail keep text '' and their error
    in ``error`` instead of being stored silently as translated.
    """
    base = backlog.select("channel_id", "message_id", "date", clean_text("text").alias("src"))
    if translator_factory is None:
        return base.select("channel_id", "message_id", "date",
                           dictionary_translate(F.col("src")).alias("text"),
                           F.lit(None).cast("string").alias("error"))
    out = batch_map(base, translator_factory, "src", "text", "string", batch_size, max_retries)
    return out.select("channel_id", "message_id", "date",
                      F.coalesce("text", F.lit("")).alias("text"), F.col("_error").alias("error"))


def translate_into(source: DataFrame, target_path: str, translator_factory: Callable | None = None,
                   batch_size: int = 32, max_retries: int = 2, max_rounds: int = 10) -> DataFrame:
    """U02 end to end: the messages of ``source`` whose key the table at
    ``target_path`` does not hold are translated and inserted by key, in rounds
    until none is left. Messages that fail are not stored; when a round stores
    nothing, or after ``max_rounds``, those left are for a later call, and
    ``translation_backlog`` tells which they are. Returns the table (channel_id,
    message_id, date, text), an empty one where nothing was ever stored."""
    spark, key = source.sparkSession, ["channel_id", "message_id"]
    columns = [*key, "date", "text"]
    schema = source.select(*columns).schema
    for _ in range(max_rounds):
        backlog = translation_backlog(source, target_path)
        # written first, so that a model that answers differently is asked once
        done = write_shared(translate_backlog(backlog, translator_factory, batch_size, max_retries),
                            "translated")
        good = done.where(F.col("error").isNull()).select(*columns)
        # NULL keys are never found in the target: once is enough
        again = done.where(F.col("error").isNotNull() & F.col(key[0]).isNotNull()
                           & F.col(key[1]).isNotNull())
        stored = not good.isEmpty()
        if stored:
            append_if_absent(good, target_path, key, ["date", "text"])
        source = source.join(again.select(*key), key, "left_semi")
        if not stored or again.isEmpty():
            break
    return _table_or_empty(spark, target_path, schema)


def translation_backlog(source: DataFrame, target_path: str) -> DataFrame:
    """J03 against the stored table: the messages (channel_id, message_id, date, text)
    of ``source`` that it does not hold; all, where there is no table yet."""
    key = ["channel_id", "message_id"]
    rows = source.select(*key, "date", "text")
    target = _table_or_empty(source.sparkSession, target_path, rows.schema)
    return rows.join(target.select(*key), key, "left_anti")


def _table_or_empty(spark, path: str, schema) -> DataFrame:
    target = table_or_none(spark, path, schema)
    return spark.createDataFrame([], schema) if target is None else target


# The default sentiment lexicon (word -> polarity).
SENTIMENT_WORDS = {
    "good": 1, "great": 1, "gain": 1, "gains": 1, "growth": 1, "profit": 1, "rise": 1,
    "rises": 1, "strong": 1, "up": 1, "best": 1, "high": 1, "more": 1, "better": 1,
    "bad": -1, "loss": -1, "losses": -1, "decline": -1, "fall": -1, "falls": -1, "weak": -1,
    "down": -1, "worst": -1, "low": -1, "less": -1, "risk": -1, "crisis": -1, "worse": -1,
}


def lexicon_sentiment(text: Column, lexicon: dict[str, int] = SENTIMENT_WORDS) -> Column:
    """Default scorer: sum of word polarities -> label positive / negative /
    neutral; score = |sum| / lexicon hits (0 without hits). One struct
    (label, score); the hits and their sum are bound once, so a text is
    tokenised and looked up once."""
    m = F.create_map(*[F.lit(x) for kv in sorted(lexicon.items()) for x in kv])
    pol = F.transform(tokens(F.lower(text)), lambda t: F.try_element_at(m, t))
    hits = F.filter(pol, lambda p: p.isNotNull())

    def summarise(h: Column) -> Column:
        def result(s: Column) -> Column:
            label = (F.when(s > 0, F.lit("positive")).when(s < 0, F.lit("negative"))
                     .otherwise(F.lit("neutral")))
            score = F.when(F.size(h) > 0, F.abs(s).cast("double") / F.size(h)).otherwise(
                F.lit(0.0))
            return F.struct(label.alias("label"), score.alias("score"))
        return _let(F.aggregate(h, F.lit(0), lambda a, p: a + p), result)

    return _let(hits, summarise)


def score_sentiment(docs: DataFrame, text: str = "text", scorer_factory: Callable | None = None,
                    batch_size: int = 32, parts: int | None = None) -> DataFrame:
    """(text, label, score) per row; with a hook, a text it fails on (alone)
    gets label 'ERROR' and score 0.0. ``parts``: see ``layout.spread``."""
    docs = spread(docs, parts)
    if scorer_factory is None:
        return (docs.withColumn("_res", lexicon_sentiment(F.col(text)))
                .withColumn("label", F.col("_res.label"))
                .withColumn("score", F.col("_res.score")).drop("_res"))
    out = batch_map(docs, scorer_factory, text, "_res", "struct<label:string,score:double>",
                    batch_size)
    return (out.withColumn("label", F.when(F.col("_error").isNull(), F.col("_res.label"))
                           .otherwise(F.lit("ERROR")))
            .withColumn("score", F.when(F.col("_error").isNull(), F.col("_res.score"))
                        .otherwise(F.lit(0.0)))
            .drop("_res", "_error"))


def label_counts(scored: DataFrame) -> DataFrame:
    """A05 on the sentiment labels: rows per label."""
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
