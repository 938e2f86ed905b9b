"""Parsers against literal edge tables and against plain-Python models of the
reference's parsing rules (FIXTURES.md §3)."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftpool.functions import clean as C


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", fn(F.col("s")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def _float(s):
    try:
        return float(s)
    except (ValueError, TypeError):
        return None


def py_kmb(val):
    if val is None:
        return 0.0
    v = str(val).strip().upper()
    for suf, mult in (("K", 1e3), ("M", 1e6), ("B", 1e9)):
        if suf in v:
            x = _float(v.replace(suf, ""))
            return None if x is None else x * mult
    return _float(v)


def py_lenient(val):
    if val is None or val == "-":
        return 0.0
    v = str(val).upper().replace(",", "")
    if "K" in v:
        x = _float(v.replace("K", ""))
        return 0.0 if x is None else x * 1e3
    if "M" in v:
        x = _float(v.replace("M", ""))
        return 0.0 if x is None else x * 1e6
    x = _float(v)
    return 0.0 if x is None else x


def py_regex(val):
    s = re.sub(r"[^0-9.KM]", "", "" if val is None else str(val))
    expr = s.replace("K", "*1e3").replace("M", "*1e6")
    out = 1.0
    for f in expr.split("*"):
        x = _float(f) if re.fullmatch(r"[0-9.]*(e[0-9.]+)?", f) else None
        if x is None:
            return 0.0
        out *= x
    return 0.0 if math.isnan(out) else out  # the reference fills NaN with 0


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    if math.isinf(a) or math.isinf(b):
        return a == b
    return math.isclose(a, b, rel_tol=1e-12, abs_tol=0.0)


EDGE_VOL = [None, "", "-", "12.5K", "1.2m", "3B", " 7k ", "1,234", "KM", "1KM", "K5", "."]


def test_volume_edges(spark):
    for fn, model in ((C.volume_kmb, py_kmb), (C.volume_km_lenient, py_lenient),
                      (C.volume_km_regex, py_regex)):
        got = run(spark, EDGE_VOL, fn)
        want = [model(v) for v in EDGE_VOL]
        assert all(same(g, w) for g, w in zip(got, want)), (fn.__name__, got, want)


ALPHABET = "0123456789.,KMBkmb -%+"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=7), min_size=1, max_size=40))
def test_volume_properties(spark, values):
    for fn, model in ((C.volume_kmb, py_kmb), (C.volume_km_lenient, py_lenient),
                      (C.volume_km_regex, py_regex)):
        got = run(spark, values, fn)
        for v, g in zip(values, got):
            assert same(g, model(v)), (fn.__name__, v, g, model(v))


def test_price_parsers(spark):
    vals = [None, "", "1,234.50", "-12.5", "$1.2", "abc", "1.2.3"]
    assert run(spark, vals, C.price_strip_commas) == [None, None, 1234.5, -12.5, None, None, None]
    assert run(spark, vals, C.price_regex_coerce) == [None, None, 1234.5, 12.5, 1.2, None, None]
    assert run(spark, vals, C.clean_numeric) == [0.0, None, 1234.5, -12.5, None, None, None]


def test_percent_modes(spark):
    vals = [None, "", "1.23%", "-0.50%", "+2%", "%"]
    assert run(spark, vals, lambda c: C.percent_parse(c, "rstrip")) == [None, None, 1.23, -0.5, 2.0, None]
    assert run(spark, vals, lambda c: C.percent_parse(c, "replace")) == [None, 0.0, 1.23, -0.5, 2.0, 0.0]
    assert run(spark, vals, lambda c: C.percent_parse(c, "regex")) == [None, None, 1.23, -0.5, 2.0, None]


def test_clean_text_matches_python_strip(spark):
    vals = [None, "", "  a ", "\t a \n", " a", "　x ", "a b"]
    got = run(spark, vals, C.clean_text)
    assert got == [("" if v is None else v.strip()) for v in vals]


def test_date_parse(spark):
    import datetime as dt
    vals = ["01/31/2024", "13/01/2024", "2024-01-31", None]
    assert run(spark, vals, C.date_parse) == [dt.date(2024, 1, 31), None, None, None]


def test_headline_preview(spark):
    vals = ["x" * 99, "x" * 100, "x" * 101]
    got = run(spark, vals, C.headline_preview)
    assert got == ["x" * 99, "x" * 100, "x" * 100 + "..."]


def test_price_range_and_finite(spark):
    df = spark.createDataFrame(
        [(10.0, 5.0, 0.0), (10.0, 5.0, 1.0), (10.0, 5.0, 0.1), (None, 5.0, 1.0)], "h double, l double, p double")
    got = [r.o for r in df.select(C.price_range("h", "l", "p").alias("o")).collect()]
    assert got == [0.0, 5.0, 10.0, 0.0]
    d2 = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (2.5,)], "x double")
    assert [r.o for r in d2.select(C.finite_or_zero("x").alias("o")).collect()] == [0.0, 0.0, 0.0, 2.5]


def test_day_of_week_monday_zero(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),)], "d date")
    assert [r.o for r in df.select(C.day_of_week("d").alias("o")).collect()] == [0, 6]
