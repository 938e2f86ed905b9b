from collections import Counter

from driftpool.llm import linededup
from tests.harness import compare, duck
from tests.llm.helpers import docs, odd_rows


def brute(rows, ratio, min_pages):
    count, pages = Counter(), Counter()
    for _, text, _, host in rows:
        pages[host] += 1
        count.update((host, x) for x in {y.strip(" ") for y in (text or "").split("\n")} if x)
    out = []
    for i, text, _, host in rows:
        lines = text.split("\n") if text is not None else []
        gone = {x for x in lines if x.strip(" ") and count[host, x.strip(" ")] >= min_pages
                and count[host, x.strip(" ")] > ratio * pages[host]}
        kept = [x for x in lines if x not in gone]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(df, ratio, min_pages):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.drop_boilerplate(
        df, "source", ratio=ratio, min_pages=min_pages).collect()), key=str)


def test_equals_brute_force(spark):
    rows = [(i, f"menu\n\n line {i}\n  menu  \nfooter {i % 2}" + "\nmenu" * (i % 3), "en", f"s{i % 3}")
            for i in range(30)]
    rows += [(100 + i, "menu\nother", "en", "rare") for i in range(2)]
    for ratio, least in ((0.1, 3), (0.5, 2), (0.99, 1), (0.49, 5)):
        assert run(docs(spark, rows), ratio, least) == brute(rows, ratio, least)


def test_odd_rows(spark):
    rows = odd_rows() + [(20, "\n", "en", None), (21, "word\n", "en", None), (22, "word", "en", None)]
    df = docs(spark, rows).withColumnRenamed("n", "n_lines")
    assert run(df, 0.3, 2) == brute(rows, 0.3, 2)
    out = linededup.drop_boilerplate(df, "source")
    assert out.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped"]


def test_merge_join_path_gives_the_same(spark, monkeypatch):
    rows = [(i, f"menu\nline {i}", "en", f"s{i % 2}") for i in range(40)]
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", 0)
    assert run(docs(spark, rows), 0.1, 3) == brute(rows, 0.1, 3)


def test_empty_table(spark):
    assert linededup.drop_boilerplate(docs(spark, []), "source").count() == 0


def test_the_ratio_decides_on_small_hosts(spark):
    rows = [(i, f"own {i}\nCopyright" if i < 3 else f"own {i}", "en", "four") for i in range(4)]
    rows += [(10 + i, f"own {i}\nCopyright" if i < 4 else f"own {i}", "en", "fifteen") for i in range(15)]
    rows += [(50 + i, f"own {i}\nCopyright", "en", "two") for i in range(2)]
    rows += [(60 + i, f"own {i}\nCopyright" if i < 3 else f"own {i}", "en", "thirty") for i in range(30)]
    out = linededup.drop_boilerplate(docs(spark, rows), "source").collect()
    assert {r.doc_id for r in out if r.n_dropped} == {0, 1, 2, 10, 11, 12, 13}
    assert all("Copyright" not in r.text for r in out if r.n_dropped)


def test_host_and_lines(spark):
    df = spark.createDataFrame([("http://A.example/x?y", "<p>a<br> b</p><script>x<1</script>c"),
                                ("no host", "<!-- gone -->"), (None, None)], "url string, html string")
    got = df.select(linededup.host_of(df.url).alias("h"), linededup.page_lines(df.html).alias("t")).collect()
    assert [tuple(r) for r in got] == [("a.example", "\na\nb\nc"), ("", "\n"), (None, None)]


def test_query_drops_lines_at_the_oracle_size(spark):
    got = linededup.query(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_dropped for r in got) > 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(linededup.query(spark, sf).toPandas(), duck(sf).sql(linededup.ORACLE_SQL).df()) is None


def test_names_that_clash_in_another_case(spark):
    df = spark.createDataFrame([("s", "a\nb", 1, "x")] * 4, "source string, text string, N_LINES int, N_Dropped string")
    out = linededup.drop_boilerplate(df, "source")
    assert out.columns == ["source", "text", "n_lines", "n_dropped"]
    assert {tuple(r) for r in out.collect()} == {("s", "", 2, 2)}
