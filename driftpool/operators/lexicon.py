"""Word tables for the enrichment jobs (U02, U03): learned from data, joined to texts.

The built-in word lists of ``enrich`` are literals and stay small. Here the words are a
table of any size: learned by counting (one aggregation, combined map-side), measured,
and joined to the words of whole texts - broadcast up to ``MAX_BROADCAST_WORDS`` rows, a
merge join beyond that, where AQE splits the tasks of frequent words. A text's
words come together again by the row's kept columns and a digest of its text, so equal
rows are one group that counts its copies, and nothing depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftpool.functions.clean import clean_text
from driftpool.operators.enrich import WORD_SPLIT, _let, tokens
from driftpool.operators.joins import measured

#: words that are broadcast at most (some 50 bytes each)
MAX_BROADCAST_WORDS = 200_000


def learn_lexicon(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text",
                  label: str = "label", min_texts: int = 5, min_z: float = 3.0,
                  max_broadcast: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """Words that tell label 1 from label 0: (word, polarity 1 or -1, z, n_pos, n_neg).

    ``z`` is the log odds ratio of a word's texts under the two labels (half a text added
    to each of the four counts) over its standard error; a word is taken from
    ``min_texts`` texts on if ``|z| >= min_z``. A text counts a word once, in lower case.
    Rows without a text or label, and labels other than 0 and 1, teach nothing; where
    only one label occurs, or no rows are, the table is empty.

    The label is a column of ``docs``, or of ``labels`` (key, label), a text counting
    once for each row of its key: measured, and broadcast up to ``max_broadcast`` rows, so
    that texts stay where they are; beyond that the texts' distinct words are shuffled.
    """
    has_text = docs.where(F.col(text).isNotNull())
    words = F.array_distinct(tokens(F.lower(F.col(text)))).alias("_words")
    if labels is None:
        docs = has_text.select(F.col(label).cast("bigint").alias("_y"), words)
    else:
        known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).cast("bigint").alias("_y"))
        docs = (has_text.select(F.col(key).alias("_k"), words).join(measured(known, max_broadcast), "_k")
                .select("_y", "_words"))
    docs = docs.where(F.col("_y").isin(0, 1))
    sizes = docs.agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("pos"), F.count(F.lit(1)).alias("all"))
    seen = (docs.select("_y", F.explode("_words").alias("word")).groupBy("word")
            .agg(F.sum("_y").alias("n_pos"), F.sum(1 - F.col("_y")).alias("n_neg")))
    rows = seen.where(F.col("n_pos") + F.col("n_neg") >= min_texts).crossJoin(F.broadcast(sizes))
    pos, neg = F.col("pos"), F.col("all") - F.col("pos")
    cells = [F.col("n_pos") + 0.5, pos - F.col("n_pos") + 0.5, F.col("n_neg") + 0.5, neg - F.col("n_neg") + 0.5]
    odds = F.ln(cells[0] / cells[1]) - F.ln(cells[2] / cells[3])
    error = F.sqrt(sum((F.lit(1.0) / c for c in cells[1:]), F.lit(1.0) / cells[0]))
    return (rows.where((pos > 0) & (neg > 0)).withColumn("z", odds / error)
            .where(F.abs("z") >= min_z)
            .select("word", F.signum("z").cast("int").alias("polarity"), "z", "n_pos", "n_neg"))


def score_with_lexicon(docs: DataFrame, lexicon: DataFrame, text: str = "text", keep=("message_id",),
                       max_broadcast: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """U03 by a word table (word, polarity): (keep..., label, score) for each row of
    ``docs``; label and score as ``enrich.lexicon_sentiment`` gives them, over all words
    of the whole text. A row without a text or without hits is neutral with score 0.
    A word must be in the table once; words with a NULL polarity are no hits."""
    keep = list(keep)
    words = (_digested(docs, F.lower(F.col(text)), keep, tokens)
             .join(measured(lexicon.select(F.col("word").alias("_word"), "polarity"), max_broadcast),
                   "_word", "left"))
    sums = words.groupBy(*keep, "_digest").agg(
        F.coalesce(F.sum("polarity"), F.lit(0)).alias("_sum"), F.count("polarity").alias("_hits"),
        F.count_if(F.coalesce("_pos", F.lit(0)) == 0).alias("_copies"))  # a row has one first word, or none
    label = (F.when(F.col("_sum") > 0, "positive").when(F.col("_sum") < 0, "negative").otherwise("neutral"))
    score = F.when(F.col("_hits") > 0, F.abs("_sum") / F.col("_hits")).otherwise(F.lit(0.0))
    return _per_copy(sums.select(*keep, label.alias("label"), score.alias("score"), "_copies"))


def learn_dictionary(pairs: DataFrame, source: str = "src", target: str = "text") -> DataFrame:
    """Word translations read off translated texts: (word, translation, n).

    Cleaned texts with as many words on either side are read place by place. A word
    (in lower case) takes its most frequent translation, the smallest of ties; a word that
    mostly stays as it is needs no entry. Pairs with a NULL side or unequal lengths
    teach nothing. Counted in two aggregations, both combined map-side, so a frequent
    word costs a row a task.
    """
    split = lambda c: _words(clean_text(c))
    texts = (pairs.where(F.col(source).isNotNull() & F.col(target).isNotNull())
             .select(split(source).alias("a"), split(target).alias("b")).where(F.size("a") == F.size("b")))
    places = texts.select(F.explode(F.arrays_zip("a", "b")).alias("p")).select(
        F.lower("p.a").alias("word"), F.when(F.col("p.a") != F.col("p.b"), F.col("p.b")).alias("translation"))
    counts = (places.where("word <> ''").groupBy("word", "translation").agg(F.count(F.lit(1)).alias("n")))
    # no translation (the word as it is) sorts before any other of the same count
    best = counts.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("n"), "translation")).alias("best"))
    return (best.where("best.translation IS NOT NULL")
            .select("word", "best.translation", (-F.col("best.n")).alias("n")))


def translate_with_dictionary(backlog: DataFrame, dictionary: DataFrame, keep=("channel_id", "message_id", "date"),
                              text: str = "text", max_broadcast: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """U02 by a word table (word in lower case, translation): (keep..., text) for each
    row, every word of the whole cleaned text looked up, unknown words as they are, one
    space between. A NULL or blank text becomes ''. A word must be in the table once; a
    NULL translation is none. Texts are shuffled once, and of their words the known ones
    alone, which are put into their places by runs: cost in proportion to the text."""
    keep = list(keep)
    table = measured(dictionary.where("translation IS NOT NULL")
                     .select(F.col("word").alias("_lower"), "translation"), max_broadcast)
    known = (_digested(backlog, clean_text(text), keep, _words).withColumn("_lower", F.lower("_word"))
             .join(table, "_lower").select(*keep, "_digest", "_pos", "translation"))
    whole = _with_digest(backlog, clean_text(text), keep).withColumn("_copy", F.lit(1))
    texts = whole.unionByName(known, allowMissingColumns=True).groupBy(*keep, "_digest").agg(
        F.max("_text").alias("_text"), F.count("_copy").alias("_copies"),
        F.array_sort(F.collect_set(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "translation")))).alias("_known"))
    place = lambda k: F.coalesce(F.get("_known", k)["_pos"], F.lit(-1))

    def replaced(words: Column) -> Column:
        up_to = lambda x, k: F.concat(
            F.slice(words, place(k - 1) + 2, x["_pos"] - place(k - 1) - 1), F.array(x.translation))
        last = place(F.size("_known") - 1)
        return F.array_join(F.concat(F.flatten(F.transform("_known", up_to)),
                                     F.slice(words, last + 2, F.size(words) - last - 1)), " ")

    return _per_copy(texts.select(*keep, _let(_words(F.col("_text")), replaced).alias("text"), "_copies"))


def _words(text: Column) -> Column:
    return F.split(text, WORD_SPLIT)


def _with_digest(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """(keep..., _text, _digest); no text is an empty one."""
    return (docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text"))
            .withColumn("_digest", F.unhex(F.md5("_text"))))


def _digested(docs: DataFrame, text: Column, keep: list[str], split) -> DataFrame:
    """(keep..., _digest, _pos, _word): the words of every text with their places; a text
    without words gives one row with neither."""
    return (_with_digest(docs, text, keep).select(*keep, "_digest", split(F.col("_text")).alias("_words"))
            .select(*keep, "_digest", F.posexplode_outer("_words").alias("_pos", "_word")))


def _per_copy(groups: DataFrame) -> DataFrame:
    """One row for each copy again."""
    out = [c for c in groups.columns if c != "_copies"]
    return (groups.select(*out, F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")).alias("_copy"))
            .select(*out))
