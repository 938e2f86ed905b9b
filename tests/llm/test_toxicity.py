import random

from pyspark.sql import functions as F

from driftpool.llm import toxicity
from tests.llm.helpers import docs, odd_rows, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_brute_force():
    r = random.Random(4)
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randrange(3, 8))) for _ in range(60)})
    trie = toxicity.FuzzyTrie(terms)
    for _ in range(3000):
        w = "".join(r.choice("abcd") for _ in range(r.randrange(1, 9)))
        near = [(distance(w, t), t) for t in terms]
        near = [(d, t) for d, t in near if d == 0 or d == 1 and len(t) >= toxicity.FUZZY_LETTERS]
        assert trie.match(w) == (min(near) if near else None), w


def test_usual_words_are_no_misspellings():
    lex = toxicity.Lexicon({"idiot": 5.0}, {"worth": 4.0}, frozenset({"idiom"}))
    assert lex.find("Idiot!".lower())[0] == 1 and lex.find("id1ot")[0] == 2
    assert lex.find("idiom") == (0, 0.0) and lex.find("worthless")[0] == 3


def test_context_separates_quotation_from_abuse():
    lex = toxicity.Lexicon({"idiot": 5.0, "scum": 5.0})
    total = lambda t: lex.features(t)[0]
    plain = total("some words and idiot in a row")
    assert total('the word "idiot" in a row') < plain
    assert total("they said idiot in a row") < plain < total("are you an idiot in a row")
    assert total("some idiot and scum") > 1.3 * plain
    assert lex.features("nothing here") == [0.0] * toxicity.N_FEATURES


def sample(spark, n=400):
    r = random.Random(7)
    rows, marks = [], []
    for i in range(n):
        text, bad = words(i, 40, 3000), i % 5 == 0
        if bad:
            text += " " + " ".join(r.choice(["idiot", "scumbag", "moronic"]) for _ in range(3))
        rows.append((i, text, "en", "a"))
        marks.append((i, int(bad)))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_learns_terms_and_catches_misspelled_ones(spark):
    df, marks = sample(spark)
    model = toxicity.fit(df, marks)
    assert {"idiot", "scumbag", "moronic"} <= set(model.lexicon.words)
    assert model.score("w1 w2 you idiot w3") >= toxicity.THRESHOLD
    assert model.score("w1 w2 scumbags w3 id1ot and m0ronic w4") >= toxicity.THRESHOLD
    assert model.score(words(9999, 50)) < toxicity.THRESHOLD


def test_odd_rows(spark):
    model = toxicity.fit(*sample(spark, 100))
    rows = odd_rows()
    df = docs(spark, rows).withColumnRenamed("n", "score")
    got = toxicity.score(df, model)
    assert got.columns == [c for c in df.columns if c != "score"] + ["score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert toxicity.score(docs(spark, []), model).count() == 0
    # odd labels: null, repeated, of unknown documents; then none at all
    marks = spark.createDataFrame([(None, 1), (6, None), (6, 1), (6, 0), (99, 1), (5, 0)],
                                  "doc_id long, toxic int")
    assert 0 <= toxicity.fit(docs(spark, rows), marks).score("x") <= 1
    assert toxicity.fit(docs(spark, rows), marks.where("false")).score(None) < 0.3


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in rows.where("held_out and toxic is not null").groupBy(
        "toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0]
    assert rows.where(F.col("score").isNull()).count() == 0
