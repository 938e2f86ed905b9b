"""Enrichment jobs on their built-in defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpool import fixtures as fx
from driftpool.functions.clean import clean_text
from driftpool.operators import enrich, joins, lexicon
from driftpool.plans.oracle import sql
from driftpool.plans.q_clean import WS
from driftpool.plans.registry import register
from driftpool.session import shared_path

R = 6
TOKEN = r"'[\p{L}\p{N}]+'"


def _duck_map(d: dict) -> str:
    def lit(x):
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in sorted(d.items())) + "}"


_ENC = [
    ("m", f"""SELECT CAST(channel_id AS VARCHAR) || '_' || CAST(message_id AS VARCHAR) AS special_id,
                     trim(coalesce(text, ''), {WS}) AS input_text FROM news"""),
    ("toks", f"""SELECT special_id, unnest(regexp_extract_all(input_text, {TOKEN})) AS tok
                 FROM m WHERE length(input_text) > 0"""),
    ("b", """SELECT special_id, CAST('0x' || substr(md5(tok), 1, 6) AS BIGINT) % 64 AS i, count(*) AS c
             FROM toks GROUP BY special_id, i"""),
    ("n", "SELECT special_id, sqrt(sum(c * c)) AS norm FROM b GROUP BY special_id"),
]


def _parts(spark) -> int:
    """The given tables are single row groups: per-text work is dealt over the
    session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@register("encode_texts", sql(f"""
SELECT special_id, CAST(i AS INTEGER) AS i, round(CAST(CAST(c / norm AS FLOAT) AS DOUBLE), {R}) AS x
FROM b JOIN n USING (special_id)""", "news", extra=_ENC))
def q_encode_texts(spark, sf_dir):
    """Default encoder; the non-zero elements of each message vector."""
    e = enrich.encode_texts(fx.news(spark, sf_dir), "hash64", dim=64, parts=_parts(spark))
    x = e.select("special_id", F.posexplode_outer("embedding_vector").alias("i", "x"))
    return (x.where(F.col("x") != 0)
            .select("special_id", "i", F.round(F.col("x").cast("double"), R).alias("x")))


@register("translate_backlog", sql(f"""
SELECT channel_id, message_id, date,
       array_to_string(list_transform(string_split_regex(trim(coalesce(text, ''), {WS}),
                                                         '[ \\t\\n\\x0B\\f\\r]+'),
                                      lambda t: coalesce({_duck_map(enrich.EN_RU_WORDS)}[lower(t)], t)), ' ')
       AS text, CAST(NULL AS VARCHAR) AS error
FROM news n WHERE NOT EXISTS (SELECT 1 FROM news_done d
                              WHERE d.channel_id = n.channel_id AND d.message_id = n.message_id)""",
                                     "news_done"), timestamps="date")
def q_translate_backlog(spark, sf_dir):
    """The whole backlog (J03) translated in one job, ready for the keyed
    insert into the translated table."""
    backlog = joins.untranslated_backlog(fx.news(spark, sf_dir), fx.news_done(spark, sf_dir))
    return enrich.translate_backlog(backlog).select("channel_id", "message_id", "date", "text", "error")


@register("encode_store", sql(f"""
SELECT m.special_id, 'hash64' AS model_name, m.input_text, 64 AS embedding_size, m.date AS timestamp,
       coalesce(e.n_nonzero, 0) AS n_nonzero, coalesce(e.checksum, 0.0) AS checksum
FROM (SELECT CAST(channel_id AS VARCHAR) || '_' || CAST(message_id AS VARCHAR) AS special_id,
             trim(coalesce(text, ''), {WS}) AS input_text, date FROM news) m
LEFT JOIN (SELECT special_id, CAST(count(*) AS INTEGER) AS n_nonzero,
                  round(sum((i + 1) * (i + 1) * CAST(CAST(c / norm AS FLOAT) AS DOUBLE)), 4) AS checksum
           FROM b JOIN n USING (special_id) GROUP BY special_id) e ON m.special_id = e.special_id
WHERE length(m.input_text) > 0""", "news", extra=_ENC), timestamps="timestamp")
def q_encode_store(spark, sf_dir):
    """U01 end to end: the encoded messages in the vector table, stored twice (the
    second run finds every key and adds nothing); the checksum weighs every element of
    a stored vector by its place."""
    path = shared_path(spark, "vector-table")
    encoded = enrich.encode_texts(fx.news(spark, sf_dir), "hash64", dim=64, parts=_parts(spark))
    enrich.store_vectors_if_absent(encoded, path)
    stored = enrich.store_vectors_if_absent(encoded, path)
    v = F.col("embedding_vector")
    weighed = F.transform(v, lambda x, i: x.cast("double") * (i + 1) * (i + 1))
    return stored.select("special_id", "model_name", "input_text", "embedding_size", "timestamp",
                         F.size(F.filter(v, lambda x: x != 0)).alias("n_nonzero"),
                         F.round(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x), 4).alias("checksum"))


@register("encode_report", sql(f"""
SELECT count(*) FILTER (length(trim(coalesce(text, ''), {WS})) > 0) AS processed, count(*) AS total
FROM news""", "news"))
def q_encode_report(spark, sf_dir):
    """Messages encoded, of all."""
    news = fx.news(spark, sf_dir)
    return enrich.encode_report(news, enrich.encode_texts(news, "hash64", dim=64, parts=_parts(spark)))


@register("translate_into", sql(f"""
SELECT channel_id, message_id, date, text FROM news_done
UNION ALL
SELECT channel_id, message_id, date,
       array_to_string(list_transform(string_split_regex(trim(coalesce(text, ''), {WS}),
                                                         '[ \\t\\n\\x0B\\f\\r]+'),
                                      lambda t: coalesce({_duck_map(enrich.EN_RU_WORDS)}[lower(t)], t)), ' ')
FROM news n WHERE NOT EXISTS (SELECT 1 FROM news_done d
                              WHERE d.channel_id = n.channel_id AND d.message_id = n.message_id)""",
                              "news_done"), timestamps="date")
def q_translate_into(spark, sf_dir):
    """U02 end to end: the table of translated messages after the whole backlog
    was translated and inserted by key."""
    path = shared_path(spark, "translated-table")
    columns = ["channel_id", "message_id", "date", "text"]
    fx.news_done(spark, sf_dir).select(*columns).write.parquet(path)
    return enrich.translate_into(fx.news(spark, sf_dir).select(*columns), path)


_SENT = f"""
SELECT message_id, list_filter(list_transform(regexp_extract_all(lower(text), {TOKEN}),
                                              lambda w: {_duck_map(enrich.SENTIMENT_WORDS)}[w]),
                               lambda p: p IS NOT NULL) AS hits
FROM news"""


@register("score_sentiment", sql(f"""
SELECT message_id,
       CASE WHEN list_sum(hits) > 0 THEN 'positive' WHEN list_sum(hits) < 0 THEN 'negative'
            ELSE 'neutral' END AS label,
       CASE WHEN len(hits) > 0 THEN round(abs(list_sum(hits)) / len(hits), {R}) ELSE 0.0 END AS score
FROM hits_t""", "news", extra=[("hits_t", _SENT)]))
def q_score_sentiment(spark, sf_dir):
    s = enrich.score_sentiment(fx.news(spark, sf_dir), parts=_parts(spark))
    return s.select("message_id", "label", F.round("score", R).alias("score"))


@register("sentiment_distribution", sql("""
SELECT label, count(*) AS n FROM (
  SELECT CASE WHEN list_sum(hits) > 0 THEN 'positive' WHEN list_sum(hits) < 0 THEN 'negative'
              ELSE 'neutral' END AS label FROM hits_t)
GROUP BY label""", "news", extra=[("hits_t", _SENT)]))
def q_sentiment_distribution(spark, sf_dir):
    return enrich.label_counts(enrich.score_sentiment(fx.news(spark, sf_dir), parts=_parts(spark)))


_LEXICON = [
    ("lab", f"""SELECT CAST(quality AS BIGINT) AS y, list_distinct(regexp_extract_all(lower(text), {TOKEN})) AS words
                FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IN (0, 1)"""),
    ("tot", "SELECT sum(y) + 0.0 AS p, count(*) - sum(y) + 0.0 AS m FROM lab"),
    ("seen", """SELECT word, sum(y) AS n_pos, sum(1 - y) AS n_neg FROM (SELECT y, unnest(words) AS word FROM lab)
                GROUP BY word HAVING count(*) >= 5"""),
    ("lex", """SELECT word, n_pos, n_neg,
                      (ln((n_pos + 0.5) / (p - n_pos + 0.5)) - ln((n_neg + 0.5) / (m - n_neg + 0.5)))
                      / sqrt(1 / (n_pos + 0.5) + 1 / (p - n_pos + 0.5) + 1 / (n_neg + 0.5) + 1 / (m - n_neg + 0.5)) AS z
               FROM seen, tot"""),
    ("learned", """SELECT word, CASE WHEN z > 0 THEN 1 ELSE -1 END AS polarity, z, CAST(n_pos AS BIGINT) AS n_pos,
                          CAST(n_neg AS BIGINT) AS n_neg FROM lex WHERE abs(z) >= 3.0"""),
]


def _learned_lexicon(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexicon.learn_lexicon(docs, labels, label="quality")


@register("learn_lexicon", sql(f"""
SELECT word, polarity, round(z, {R}) AS z, n_pos, n_neg FROM learned""", extra=_LEXICON))
def q_learn_lexicon(spark, sf_dir):
    """The words that tell good documents from bad ones."""
    return _learned_lexicon(spark, sf_dir).withColumn("z", F.round("z", R))


@register("score_sentiment_learned", sql(f"""
SELECT message_id, CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS label,
       CASE WHEN h > 0 THEN round(abs(s) / h, {R}) ELSE 0.0 END AS score
FROM news LEFT JOIN (
  SELECT message_id, sum(polarity) AS s, count(*) AS h
  FROM (SELECT message_id, unnest(regexp_extract_all(lower(text), {TOKEN})) AS word FROM news)
  JOIN learned USING (word) GROUP BY message_id) USING (message_id)""", "news", extra=_LEXICON))
def q_score_sentiment_learned(spark, sf_dir):
    """U03 with the learned lexicon, over every message."""
    s = lexicon.score_with_lexicon(fx.news(spark, sf_dir), _learned_lexicon(spark, sf_dir))
    return s.withColumn("score", F.round("score", R))


_TRANSLATED = f"""
SELECT channel_id, message_id, date, src,
       list_transform(src, lambda t: coalesce({_duck_map(enrich.EN_RU_WORDS)}[lower(t)], t)) AS text
FROM (SELECT channel_id, message_id, date,
             string_split_regex(trim(coalesce(text, ''), {WS}), '[ \\t\\n\\x0B\\f\\r]+') AS src FROM news_done)"""
_DICTIONARY = [
    ("pairs", _TRANSLATED),
    ("counts", """SELECT lower(a) AS word, CASE WHEN a <> b THEN b END AS translation, count(*) AS n
                  FROM (SELECT unnest(src) AS a, unnest(text) AS b FROM pairs) WHERE a <> '' GROUP BY ALL"""),
    ("learned", """SELECT word, translation, n FROM counts
                   QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, translation NULLS FIRST) = 1"""),
]


def _done_keys(spark, sf_dir):
    """Keys of the messages translated so far, measured: few enough are broadcast, so
    that texts stay where they are."""
    return joins.measured(fx.news_done(spark, sf_dir).select("channel_id", "message_id"),
                          lexicon.MAX_BROADCAST_WORDS)


def _learned_dictionary(news, done_keys):
    done = news.join(done_keys, ["channel_id", "message_id"], "left_semi")
    return lexicon.learn_dictionary(done.select(F.col("text").alias("src"),
                                                enrich.dictionary_translate(clean_text("text")).alias("text")))


@register("learn_dictionary", sql("""
SELECT word, translation, n FROM learned WHERE translation IS NOT NULL""", "news_done", extra=_DICTIONARY))
def q_learn_dictionary(spark, sf_dir):
    """The word translations that the messages translated so far show."""
    return _learned_dictionary(fx.news(spark, sf_dir), _done_keys(spark, sf_dir))


@register("translate_backlog_learned", sql(f"""
SELECT channel_id, message_id, date, string_agg(coalesce(translation, w), ' ' ORDER BY pos) AS text
FROM (SELECT channel_id, message_id, date, unnest(src) AS w, generate_subscripts(src, 1) AS pos
      FROM (SELECT channel_id, message_id, date,
                   string_split_regex(trim(coalesce(text, ''), {WS}), '[ \\t\\n\\x0B\\f\\r]+') AS src
            FROM news n WHERE NOT EXISTS (SELECT 1 FROM news_done d WHERE d.channel_id = n.channel_id
                                                                      AND d.message_id = n.message_id)))
LEFT JOIN (SELECT word, translation FROM learned) ON word = lower(w)
GROUP BY channel_id, message_id, date""", "news_done", extra=_DICTIONARY), timestamps="date")
def q_translate_backlog_learned(spark, sf_dir):
    """The whole backlog translated by the dictionary learned from what is done."""
    news, done_keys = fx.news(spark, sf_dir), _done_keys(spark, sf_dir)
    backlog = joins.untranslated_backlog(news, done_keys)
    return lexicon.translate_with_dictionary(backlog, _learned_dictionary(news, done_keys))
