"""DuckDB twins of the fixtures, used to build the oracle SQL of every query.

``sql(body, 'vecs', 'bars')`` prepends ``WITH`` definitions for the named
fixtures (and what they depend on) to an oracle statement.
"""

from __future__ import annotations

_DAY = "(DATE '1995-01-01' + CAST(({c} % 23) * ({c} % 29) AS INTEGER))"
_TS = "(CAST({day} AS TIMESTAMP) + to_minutes(CAST({c} % 1440 AS BIGINT)))"


def day_of(c: str) -> str:
    return _DAY.format(c=c)


def ts_of(c: str) -> str:
    return _TS.format(day=day_of(c), c=c)


_BARS = """
SELECT series, day, open, high, low, price, vol,
       (price / lag(price) OVER (PARTITION BY series ORDER BY day) - 1) * 100 AS change_pct
FROM (SELECT {series} AS series, CAST(o_orderdate AS DATE) AS day,
             arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
             min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS price,
             CAST(count(*) AS DOUBLE) AS vol
      FROM orders GROUP BY 1, 2)
"""

_BARS_RAW = """
SELECT series, strftime(day, '%m/%d/%Y') AS date_str,
       format('{{:,.2f}}', price) AS price_str, format('{{:,.2f}}', open) AS open_str,
       format('{{:,.2f}}', high) AS high_str, format('{{:,.2f}}', low) AS low_str,
       CASE CAST(vol AS BIGINT) % 5 WHEN 0 THEN '-'
            WHEN 1 THEN CAST(CAST(vol AS BIGINT) AS VARCHAR) || 'K'
            WHEN 2 THEN CAST(CAST(vol AS BIGINT) AS VARCHAR) || 'M'
            WHEN 3 THEN CAST(CAST(vol AS BIGINT) AS VARCHAR) || 'B'
            ELSE '' END AS vol_str,
       CASE WHEN change_pct IS NOT NULL THEN printf('%.2f%%', change_pct) END AS change_str
FROM {src}
"""

DUP_ORDER = ("l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, "
             "l_discount, l_tax, l_returnflag, l_linestatus")

FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "vecs": ((), f"""
SELECT 'all' AS series, vec_id, {ts_of('vec_id')} AS ts, {day_of('vec_id')} AS day,
       embedding AS v, 'm' || CAST(label % 2 AS VARCHAR) AS model_name
FROM embeddings"""),
    "news": ((), f"""
SELECT CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS channel_id, doc_id AS message_id,
       {ts_of('doc_id')} AS date, text
FROM documents"""),
    "news_done": (("news",), """
SELECT * FROM news WHERE message_id IN (SELECT doc_id FROM labels)"""),
    "dup_target": ((), f"""
SELECT * EXCLUDE (rn_) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {DUP_ORDER}) AS rn_
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')
WHERE rn_ = 1 OR l_orderkey IS NULL OR l_linenumber IS NULL"""),
    "bars": ((), _BARS.format(series="'all'")),
    "bars_multi": ((), _BARS.format(series="o_orderpriority")),
    "bars_raw": (("bars",), _BARS_RAW.format(src="bars")),
    "bars_raw_multi": (("bars_multi",), _BARS_RAW.format(src="bars_multi")),
    "labels_pred": ((), """
SELECT doc_id, quality AS y_true, 1 - toxic AS y_pred FROM labels"""),
    "reg_pred": ((), """
SELECT l_orderkey, l_linenumber, l_extendedprice AS y_true, l_quantity * p_retailprice AS y_pred
FROM lineitem JOIN part ON l_partkey = p_partkey"""),
}


def _resolve(names, out):
    for n in names:
        if n in out:
            continue
        deps, _ = FIXTURES[n]
        _resolve(deps, out)
        out.append(n)
    return out


def sql(body: str, *fixtures: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Oracle statement: fixture CTEs, then ``extra`` (name, sql) CTEs, then body."""
    order = _resolve(fixtures, [])
    ctes = [f"{n} AS ({FIXTURES[n][1].strip()})" for n in order]
    ctes += [f"{n} AS ({s.strip()})" for n, s in (extra or [])]
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
