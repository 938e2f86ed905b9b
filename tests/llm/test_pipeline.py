import corpus_pipeline
from driftpool.llm import langid, linededup
from tests.llm.helpers import docs, odd_rows
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import brute_fp, brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_take_odd_rows_and_keep_columns(spark):
    for rows in (odd_rows(), []):
        df = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= len(rows)
        assert corpus_pipeline.mix(spark, df, SF).columns == [*df.columns, "shard", "pass"]


def test_every_decision_holds_on_the_tables(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, raw, SF).collect()
    assert {r.doc_id for r in one} == {r.doc_id for r in raw.collect()
                                       if langid.has_letter(r.text)}
    two = stages["line_dedup"](spark, spark.createDataFrame(one, raw.schema), SF).collect()
    want = brute_lines([(r.doc_id, r.text, r.lang, r.source) for r in one],
                       linededup.RATIO, linededup.MIN_PAGES)
    assert sorted((r.doc_id, r.text) for r in two) == sorted(x[:2] for x in want)
    assert all(r.n_chars == len(r.text) for r in two)
    three = stages["near_dedup"](spark, spark.createDataFrame(two, raw.schema), SF).collect()
    groups, low = brute_groups([brute_fp(r.text) for r in two]), {}
    for r in two:
        g = groups[brute_fp(r.text)]
        low[g] = min(low.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in three) == sorted(low.values())
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    four = stages["decontaminate"](spark, spark.createDataFrame(three, raw.schema), SF).collect()
    leaks = {r.doc_id for r in three if any(b in r.text for b in bench)}
    assert {r.doc_id for r in three} - {r.doc_id for r in four} == leaks


def test_run_ends_in_the_mix(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "pass"]
    assert out.count() > 100
