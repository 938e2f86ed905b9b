"""Scalar cleaning and parsing functions (P01-P15) as Column -> Column.

All are built-in expressions (codegen, no Python workers). Malformed input
becomes NULL (or 0 where the reference maps it to 0) instead of failing the
job: every cast is a ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes, derived by rule (str.isspace());
# Java's regex \s and Spark's one-argument trim() cover only part of this set.
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_double(c) -> Column:
    return _c(c).try_cast("double")


def clean_text(c) -> Column:
    """NULL -> '', else strip leading/trailing whitespace (Python's set)."""
    return F.trim(F.coalesce(_c(c), F.lit("")), F.lit(PY_WHITESPACE))


def composite_key(a, b, sep: str = "_") -> Column:
    """P02: '<a>_<b>'."""
    return F.concat_ws(sep, _c(a).cast("string"), _c(b).cast("string"))


def price_strip_commas(c) -> Column:
    """Drop ',' -> double; malformed -> NULL."""
    return F.replace(_c(c), F.lit(","), F.lit("")).try_cast("double")


def clean_numeric(c) -> Column:
    """NULL -> 0.0; drop ',' and '%' -> double; malformed -> NULL."""
    parsed = F.translate(_c(c), ",%", "").try_cast("double")
    return F.when(_c(c).isNull(), F.lit(0.0)).otherwise(parsed)


def price_regex_coerce(c) -> Column:
    """Keep digits and '.', unparsable -> NULL (a minus sign is lost)."""
    return F.regexp_replace(_c(c), r"[^0-9.]", "").try_cast("double")


def percent_parse(c, mode: str = "rstrip") -> Column:
    """P06: '1.23%' -> 1.23.

    rstrip: strip trailing '%' then parse; replace: drop every '%', '' -> 0;
    regex: keep digits, '.', '-' then parse (unparsable -> NULL).
    """
    c = _c(c)
    if mode == "rstrip":
        return F.rtrim(c, F.lit("%")).try_cast("double")
    if mode == "replace":
        s = F.replace(c, F.lit("%"), F.lit(""))
        return F.when(s == "", F.lit(0.0)).otherwise(s.try_cast("double"))
    if mode == "regex":
        return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")
    raise ValueError(mode)


def volume_kmb(c) -> Column:
    """NULL -> 0; strip+upper; the first of K, M, B contained scales the
    rest (x 1e3, 1e6, 1e9); otherwise a plain number; malformed -> NULL."""
    s = F.upper(F.trim(_c(c), F.lit(PY_WHITESPACE)))
    out = F.when(_c(c).isNull(), F.lit(0.0))
    for suffix, mult in (("K", 1e3), ("M", 1e6), ("B", 1e9)):
        out = out.when(s.contains(suffix),
                       F.replace(s, F.lit(suffix), F.lit("")).try_cast("double") * mult)
    return out.otherwise(s.try_cast("double"))


def volume_km_lenient(c) -> Column:
    """NULL or '-' -> 0; upper, drop ','; K / M suffix; anything
    unparsable (including 'B') -> 0."""
    s = F.replace(F.upper(_c(c)), F.lit(","), F.lit(""))
    val = (F.when(s.contains("K"), F.replace(s, F.lit("K"), F.lit("")).try_cast("double") * 1e3)
           .when(s.contains("M"), F.replace(s, F.lit("M"), F.lit("")).try_cast("double") * 1e6)
           .otherwise(s.try_cast("double")))
    return F.when(_c(c).isNull() | (_c(c) == "-"), F.lit(0.0)).otherwise(F.coalesce(val, F.lit(0.0)))


def volume_km_regex(c) -> Column:
    """Keep digits, '.', 'K', 'M'; every K / M stands for a factor 1e3 /
    1e6 written after the digits before it ('12.5K' -> 12.5*1e3, '1KM' ->
    1*1e3*1e6); the product of the factors, or 0 when any factor is not a
    number (empty text, '.', a leading K/M ...) or the product is NaN
    (0 x Inf). Lower-case k/m and 'B' are stripped, so '1.2B' -> 1.2."""
    s = F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[^0-9.KM]", "")
    expr = F.replace(F.replace(s, F.lit("K"), F.lit("*1e3")), F.lit("M"), F.lit("*1e6"))
    vals = F.transform(F.split(expr, r"\*"), lambda f: f.try_cast("double"))
    ok = F.forall(vals, lambda v: v.isNotNull())
    prod = F.aggregate(vals, F.lit(1.0), lambda acc, v: acc * v)
    return F.when(ok, F.nanvl(prod, F.lit(0.0))).otherwise(F.lit(0.0))


def date_parse(c, fmt: str = "MM/dd/yyyy") -> Column:
    """P10: text in ``fmt`` -> date; unparsable -> NULL."""
    return F.try_to_timestamp(_c(c), F.lit(fmt)).cast("date")


def day_of(ts) -> Column:
    """P10: timestamp -> calendar day."""
    return F.to_date(_c(ts))


def midnight(ts) -> Column:
    """P10: timestamp -> midnight of its day."""
    return F.date_trunc("day", _c(ts))


def day_of_week(d) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(d))


def finite_or_null(c) -> Column:
    """NaN, +Inf, -Inf -> NULL."""
    x = _c(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def finite_or_zero(c) -> Column:
    """NaN / Inf / NULL -> 0."""
    return F.coalesce(finite_or_null(c), F.lit(0.0))


def finite_or_fail(c) -> Column:
    """P13's last check before training: the value, or a run-time error where it is
    still NaN or infinite (NULL passes; it is dropped or filled elsewhere)."""
    x = _c(c)
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("value is not finite")).cast("double")).otherwise(x)


def clip(c, lo: float, hi: float) -> Column:
    """Clip keeping NULL (greatest/least skip NULLs, so guard first)."""
    x = _c(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def price_range(high, low, price) -> Column:
    """(high - low) / price; zero price -> NULL; clip [-10, 10]; NULL -> 0."""
    r = F.try_divide(_c(high) - _c(low), F.when(_c(price) != 0, _c(price)))
    return finite_or_zero(clip(r, -10.0, 10.0))


def vector_dim(v) -> Column:
    """Vector width."""
    return F.size(_c(v))


def checked_vector(v, size) -> Column:
    """P14 as a check: the vector, or a run-time error where its width is not the
    stored ``size`` (a NULL vector passes)."""
    x = _c(v)
    wrong = x.isNotNull() & ~F.size(x).eqNullSafe(_c(size))
    return F.when(~wrong, x).otherwise(F.raise_error(F.lit("vector width is not its stored size")))


def headline_preview(c, n: int = 100) -> Column:
    """First n characters, '...' appended only when longer."""
    return F.concat(F.substring(_c(c), 1, n),
                    F.when(F.length(_c(c)) > n, F.lit("...")).otherwise(F.lit("")))
