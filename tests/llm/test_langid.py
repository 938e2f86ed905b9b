import zlib

import numpy as np
from pyspark.sql import functions as F

from driftpool.llm import langid
from driftpool.llm.common import held_out
from tests.llm.helpers import docs, odd_rows

TEXTS = {"en": "the quick brown fox jumps over the lazy dog and runs away from here",
         "de": "der schnelle braune fuchs springt über den faulen hund und läuft davon",
         "fr": "le renard brun saute par dessus le chien paresseux et s'en va très vite"}


def training(spark, copies=4):
    return docs(spark, [(10 * i + j, f"{t} {i}", lang, "a") for i in range(copies)
                        for j, (lang, t) in enumerate(TEXTS.items())])


def test_shares_equal_exact_sets_but_for_false_positives(spark):
    learned = langid.fit(training(spark))
    assert sorted(learned.langs) == sorted(TEXTS)
    known = {lang: {int(g) for g in langid.grams(t + " 1")} for lang, t in TEXTS.items()}
    for text in [*TEXTS.values(), "the dog und der hund", "a", "fox", "zzzz qqqq"]:
        codes = langid.grams(text).tolist()
        want = [sum(c in known[x] for c in codes) / len(codes) for x in learned.langs]
        assert np.allclose(learned.shares(text), want, atol=0.01)


def test_bits_of_many_languages_are_independent():
    r = np.random.default_rng(1)
    langs = [f"l{i}" for i in range(70)]  # two rows of masks
    codes = r.integers(0, 2**40, (70, 30)).astype(np.uint64)
    model = langid.Filter.build(langs, codes.ravel(), np.repeat(np.arange(70), 30))
    assert model.masks.shape[0] == 2
    for i in (0, 5, 63, 64, 69):
        for plane, bit in ((x // 64, x % 64) for x in range(70)):
            hit = np.ones(30, bool)
            for k in range(langid.HASHES):
                hit &= (model.masks[plane][langid._slots(codes[i], k)] >> np.uint64(bit) & np.uint64(1)) > 0
            assert hit.all() if plane * 64 + bit == i else hit.mean() < 0.2


def test_odd_rows(spark):
    learned = langid.fit(training(spark))
    rows = odd_rows()
    df = docs(spark, rows).withColumnRenamed("fp", "lang_pred")
    out = langid.identify(df, learned)
    assert out.columns == [c for c in df.columns if c != "lang_pred"] + ["lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    nothing = langid.fit(docs(spark, odd_rows()[:1]))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(docs(spark, []), learned).count() == 0


def test_held_out_is_crc32_mod_4(spark):
    got = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
    assert spark.sql("select cast(null as long) as id").select(held_out("id")).first()[0] is False


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.query(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out and lang_pred <> 'und'")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.99


def test_what_is_no_letter(spark):
    learned = langid.fit(training(spark))
    for text in ("²³ ½", "Ⅷ", "٣ 3", "_", "123", "", None):
        assert learned.predict(text) == ("und", 0.0)
    assert learned.predict("ª")[0] != "und" and learned.predict("中")[0] != "und"


def test_a_language_of_one_row(spark):
    rows = training(spark, 20).collect()
    rare = "egy gyors barna róka átugrik a lusta kutya fölött"
    df = docs(spark, [(r.doc_id, r.text, r.lang, "a") for r in rows] + [(9999, rare, "hu", "a")])
    learned = langid.fit(df)
    assert learned.langs[-1] == "hu" and learned.predict(rare) == ("hu", learned.predict(rare)[1])
    assert learned.predict(rare)[1] > 0.9 and learned.predict(TEXTS["de"])[0] == "de"


def test_chunks_of_a_long_text_change_nothing(monkeypatch):
    text = " ".join(f"word{i % 37}é" for i in range(500))
    whole, some = langid.grams(text), langid.distinct_grams(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.array_equal(langid.grams(text), whole)
    assert np.array_equal(langid.distinct_grams(text), some) and np.array_equal(some, np.unique(whole))
    assert len(langid.grams("")) == 1 and len(langid.grams("a")) == 1
