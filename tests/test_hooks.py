"""Model hooks of U01-U03 (mapInPandas batches): a failing batch is isolated,
"""

from pyspark.sql import functions as F

from driftpool import fixtures as fx
from driftpool.operators import enrich
from tests.conftest import SF001


def _bad(text: str) -> bool:
    return len(text) % 5 == 0


def _encoder():
    def encode(texts):
        if any(_bad(t) for t in texts):
            raise RuntimeError("encoder failed")
        return [[float(len(t)), 1.0, 0.0] for t in texts]
    return encode


def _scorer():
    def score(texts):
        if any(_bad(t) for t in texts):
            raise RuntimeError("scorer failed")
        return [{"label": "positive", "score": 1.0} for _ in texts]
    return score


def _translator():
    def translate(texts):
        if any(_bad(t) for t in texts):
            raise RuntimeError("translator failed")
        return [t.upper() for t in texts]
    return translate


def test_encoder_hook_drops_only_failed_batches(spark):
    news = fx.news(spark, SF001)
    msgs = enrich.prepare_messages(news).select("special_id", "input_text").collect()
    good = {r.special_id: len(r.input_text) for r in msgs if not _bad(r.input_text)}
    assert good and len(good) < len(msgs)  # both kinds present
    enc = enrich.encode_texts(news, "hook", encoder_factory=_encoder, batch_size=1)
    got = {r.special_id: r for r in enc.collect()}
    assert set(got) == set(good)
    for k, r in got.items():
        assert r.embedding_size == 3 and r.embedding_vector[0] == float(good[k])
        assert r.model_name == "hook"


def test_hooks_do_not_depend_on_batches_or_partitions(spark):
    news = fx.news(spark, SF001)
    want = {r.special_id for r in enrich.prepare_messages(news).collect() if not _bad(r.input_text)}
    for parts, batch in ((1, 64), (7, 4), (3, 1)):
        enc = enrich.encode_texts(news, "hook", encoder_factory=_encoder, batch_size=batch, parts=parts)
        assert {r.special_id for r in enc.collect()} == want
    report = enrich.encode_report(news, enc).first()
    assert (report.processed, report.total) == (len(want), news.count())


def test_one_bad_text_gives_one_error(spark):
    texts = [f"good {i}x" for i in range(63)] + ["bad!!"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)

    def factory():
        def score(batch):
            if "bad!!" in batch:
                raise RuntimeError("x" * 2000)
            return [{"label": "neutral", "score": 0.0} for _ in batch]
        return score

    out = enrich.score_sentiment(df, scorer_factory=factory, batch_size=64).collect()
    assert [r.text for r in out if r.label == "ERROR"] == ["bad!!"] and len(out) == 64
    backlog = df.selectExpr("1L as channel_id", "cast(hash(text) as long) as message_id",
                            "cast(null as timestamp_ntz) as date", "text")
    words = lambda: lambda batch: [r["label"] for r in factory()(batch)]
    failed = [r for r in enrich.translate_backlog(backlog, words, 64).collect() if r.error]
    assert len(failed) == 1 and failed[0].error.endswith("x" * 2000)  # not cut


def _flaky():
    import random

    def translate(texts):
        if random.random() < 0.5:
            raise RuntimeError("not now")
        return [t.upper() for t in texts]
    return translate


def test_randomly_failing_translator_returns_each_key_once(spark):
    backlog = fx.news(spark, SF001)
    out = enrich.translate_backlog(backlog, _flaky, batch_size=8, max_retries=2).collect()
    keys = [(r.channel_id, r.message_id) for r in out]
    assert len(keys) == len(set(keys)) == backlog.count()
    src = {(r.channel_id, r.message_id): (r.text or "").strip() for r in backlog.collect()}
    for r in out:
        if r.error is None:
            assert r.text == src[r.channel_id, r.message_id].upper()
        else:
            assert r.text == "" and r.error == "RuntimeError: not now"


def test_translate_into_empties_the_backlog(spark, tmp_path):
    news = fx.news(spark, SF001).where("text is not null").select("channel_id", "message_id", "date", "text")
    path = str(tmp_path / "translated")
    news.limit(20).write.parquet(path)
    table = enrich.translate_into(news, path, _flaky, batch_size=4, max_retries=1, max_rounds=30)
    keys = [(r.channel_id, r.message_id) for r in table.collect()]
    assert len(keys) == len(set(keys)) == news.count()
    # a translator that never works stores nothing and ends
    other = str(tmp_path / "broken")
    news.limit(5).write.parquet(other)
    assert enrich.translate_into(news, other, _broken, max_retries=0).count() == 5


def _broken():
    def translate(texts):
        raise RuntimeError("never")
    return translate


def test_scorer_hook_marks_failed_rows(spark):
    docs = fx.news(spark, SF001).where(F.length("text") > 0)
    out = enrich.score_sentiment(docs, scorer_factory=_scorer, batch_size=1).collect()
    assert out
    for r in out:
        if _bad(r.text):
            assert (r.label, r.score) == ("ERROR", 0.0)
        else:
            assert (r.label, r.score) == ("positive", 1.0)


def test_translator_hook_keeps_every_row_and_reports_failures(spark):
    backlog = fx.news(spark, SF001)
    out = enrich.translate_backlog(backlog, translator_factory=_translator, batch_size=1,
                                   max_retries=1)
    src = {(r.channel_id, r.message_id): r.text for r in backlog.collect()}
    got = out.collect()
    assert len(got) == len(src)  # nothing lost, nothing doubled
    for r in got:
        cleaned = (src[(r.channel_id, r.message_id)] or "").strip()
        if _bad(cleaned):
            assert r.text == "" and r.error and "translator failed" in r.error
        else:
            assert r.text == cleaned.upper() and r.error is None
