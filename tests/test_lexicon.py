"""Word tables of U02 and U03 against plain Python: learning, both joins, odd rows."""

import math
from collections import Counter

import pytest

from driftpool import fixtures as fx
from driftpool.operators import enrich, lexicon
from tests.conftest import SF001


def labelled(spark, rows):
    return spark.createDataFrame(rows, "text string, label int")


def test_learned_words_equal_plain_counting(spark):
    rows = [("Good fine day", 1)] * 8 + [("bad day day", 0)] * 7 + [("good bad", 1), (None, 1), ("good", None),
                                                                    ("good", 2), ("", 0)]
    got = {r.word: r for r in lexicon.learn_lexicon(labelled(spark, rows), min_texts=5, min_z=1.0).collect()}
    pos = [set(t.lower().split()) for t, y in rows if t is not None and y == 1]
    neg = [set(t.lower().split()) for t, y in rows if t is not None and y == 0]
    want = {}
    for w in {w for d in pos + neg for w in d}:
        a, b = sum(w in d for d in pos), sum(w in d for d in neg)
        cells = [a + 0.5, len(pos) - a + 0.5, b + 0.5, len(neg) - b + 0.5]
        z = (math.log(cells[0] / cells[1]) - math.log(cells[2] / cells[3])) / math.sqrt(sum(1 / c for c in cells))
        if a + b >= 5 and abs(z) >= 1.0:
            want[w] = (1 if z > 0 else -1, z, a, b)
    assert set(got) == set(want) and {"good", "bad", "fine"} <= set(got)
    for w, (polarity, z, a, b) in want.items():
        r = got[w]
        assert (r.polarity, r.n_pos, r.n_neg) == (polarity, a, b) and r.z == pytest.approx(z)


@pytest.mark.parametrize("most", [lexicon.MAX_BROADCAST_WORDS, 0])
def test_labels_of_another_table(spark, most):
    """Broadcast or merged, as if the label stood beside the text, once a label row."""
    docs = spark.createDataFrame([(i, "good day" if i % 3 else "bad day") for i in range(30)] + [(None, "good")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(25)] + [(1, 1), (0, None), (3, 2), (None, 1)],
                                   "doc_id long, label int")
    one = docs.join(labels, "doc_id")
    want = sorted(lexicon.learn_lexicon(one, min_z=0.5).collect())
    got = sorted(lexicon.learn_lexicon(docs, labels, min_z=0.5, max_broadcast=most).collect())
    assert got == want and {r.word for r in got} >= {"good", "bad"}


@pytest.mark.parametrize("rows", [[], [("good good", 1)] * 9, [(None, 0), (None, 1)]])
def test_nothing_to_learn(spark, rows):
    assert lexicon.learn_lexicon(labelled(spark, rows), min_texts=1, min_z=0.0).count() == 0


@pytest.mark.parametrize("most", [lexicon.MAX_BROADCAST_WORDS, 0])
def test_scores_equal_the_literal_lexicon(spark, most):
    """Broadcast or merged, every row has the label and score of the built-in scorer;
    copies, blank texts and rows without a text stay as many rows as they were."""
    words = spark.createDataFrame(list(enrich.SENTIMENT_WORDS.items()), "word string, polarity int")
    news = fx.news(spark, SF001).select("message_id", "text")
    odd = spark.createDataFrame([(None, "good"), (None, "good"), (1, "bad, BAD good"), (1, ""), (1, None),
                                 (2, None), (3, "good " * 30000)], "message_id long, text string")
    docs = news.unionByName(odd).unionByName(news.limit(0))
    got = lexicon.score_with_lexicon(docs, words, max_broadcast=most)
    want = enrich.score_sentiment(docs).select("message_id", "label", "score")
    key = lambda r: (str(r.message_id), r.label, round(r.score, 9))
    assert Counter(map(key, got.collect())) == Counter(map(key, want.collect()))
    assert lexicon.score_with_lexicon(docs.limit(0), words, max_broadcast=most).count() == 0
    assert {r.label for r in lexicon.score_with_lexicon(odd, words.limit(0), max_broadcast=most).collect()} == {"neutral"}


def test_dictionary_takes_the_most_frequent_translation(spark):
    pairs = spark.createDataFrame([
        ("The cat", "этот кот"), ("the dog", "тот dog"), ("the", "этот"), ("cat", "кошка"),  # tie of cat
        ("dog Dog", "dog Dog"), ("dog", "пёс"),  # mostly as it is
        ("one two", "один"), (None, "x"), ("y", None), ("", ""), ("  ", "")], "src string, text string")
    got = {r.word: (r.translation, r.n) for r in lexicon.learn_dictionary(pairs).collect()}
    assert got == {"the": ("этот", 2), "cat": ("кот", 1)}
    assert lexicon.learn_dictionary(pairs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [lexicon.MAX_BROADCAST_WORDS, 0])
def test_translations_equal_the_literal_dictionary(spark, most):
    words = spark.createDataFrame(list(enrich.EN_RU_WORDS.items()), "word string, translation string")
    odd = spark.createDataFrame([(None, 1, None, "the the"), (None, 1, None, "the the"), (1, 1, None, None),
                                 (1, 1, None, " \t"), (1, 2, None, "The\ncat  is In"),
                                 (1, 3, None, "of cat " * 5000)],
                                "channel_id long, message_id long, date timestamp_ntz, text string")
    docs = fx.news(spark, SF001).unionByName(odd)
    got = lexicon.translate_with_dictionary(docs, words, max_broadcast=most).collect()
    want = enrich.translate_backlog(docs).drop("error").collect()
    key = lambda r: (str(r.channel_id), str(r.message_id), str(r.date), r.text)
    assert Counter(map(key, got)) == Counter(map(key, want))
    assert lexicon.translate_with_dictionary(docs.limit(0), words, max_broadcast=most).count() == 0


def test_texts_are_shuffled_once(spark):
    """Below the bound the words meet the table where they lie: the one exchange of
    the plan is that of the sums."""
    words = spark.createDataFrame([("good", 1)], "word string, polarity int")
    plan = lexicon.score_with_lexicon(fx.news(spark, SF001), words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
