"""Time-series windows, splits and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpool import fixtures as fx
from driftpool.operators import features as W
from driftpool.operators import metrics, splits
from driftpool.plans.oracle import sql
from driftpool.plans.registry import register

R = 6
BIG = 4  # decimals kept for price-scale values (their float noise is ~1e-10)


def _r(c, d=R):
    return F.round(F.col(c), d).alias(c)


def fz(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE ({x}) END)"


def _ieee(num, den):
    return (f"CASE WHEN {den} = 0 THEN (CASE WHEN {num} > 0 THEN 'inf' WHEN {num} < 0 THEN '-inf' "
            f"ELSE 'nan' END)::DOUBLE ELSE {num} / {den} - 1 END")


def feature_ctes(src: str = "bars_multi"):
    w = "PARTITION BY series ORDER BY day"
    return [
        ("feat_base", f"""
SELECT series, day, price, open, high, low, vol, change_pct,
       lead(change_pct) OVER ({w}) AS next_change, price - lag(price) OVER ({w}) AS delta,
       lag(vol) OVER ({w}) AS vol_prev, lag(price, 5) OVER ({w}) AS price_prev5
FROM {src}"""),
        ("feat_g", f"""
SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0.0) END AS gain,
          CASE WHEN delta IS NOT NULL THEN -least(delta, 0.0) END AS loss,
          greatest(high - low, abs(high - price), abs(low - price)) AS tr,
          abs(change_pct) AS achg, {_ieee('vol', 'vol_prev')} AS vc_raw,
          {_ieee('price', 'price_prev5')} AS mo_raw
FROM feat_base"""),
        ("feat_w", f"""
SELECT *, avg(price) OVER w20 AS ma20, count(price) OVER w20 AS n20,
       stddev_samp(achg) OVER w3 AS sd3, count(achg) OVER w3 AS n3,
       avg(gain) OVER w14 AS ag, avg(loss) OVER w14 AS al, count(gain) OVER w14 AS ng,
       avg(tr) OVER w14 AS atr, count(tr) OVER w14 AS ntr
FROM feat_g
WINDOW w20 AS ({w} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
       w3 AS ({w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
       w14 AS ({w} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"""),
        ("feat_all", f"""
SELECT series, day, price, open, high, low, vol, change_pct, next_change,
  {fz("CASE WHEN price <> 0 THEN least(greatest((high - low) / price, -10.0), 10.0) END")} AS price_range,
  CAST(isodow(day) - 1 AS INTEGER) AS day_of_week, CAST(month(day) AS INTEGER) AS month,
  {fz("CASE WHEN n3 = 3 THEN least(greatest(sd3, 0.0), 100.0) END")} AS volatility_3day,
  {fz("vc_raw")} AS volume_change,
  {fz("CASE WHEN mo_raw IS NULL THEN NULL WHEN isnan(mo_raw) THEN mo_raw ELSE least(greatest(mo_raw, -5.0), 5.0) END")} AS momentum_5,
  CASE WHEN n20 = 20 AND ma20 <> 0 THEN price / ma20 END AS price_ma_ratio,
  CASE WHEN ng = 14 AND al = 0 AND ag > 0 THEN CAST(100 AS DOUBLE)
       WHEN ng = 14 AND al <> 0 THEN 100.0 - 100.0 / (1.0 + ag / al) END AS rsi_14,
  CASE WHEN ntr = 14 THEN atr END AS atr_14,
  CASE WHEN next_change < -1.5 THEN 0 WHEN next_change > 1.5 THEN 2 ELSE 1 END AS target
FROM feat_w"""),
        ("feat", """
SELECT * FROM feat_all
WHERE price IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL
  AND vol IS NOT NULL AND change_pct IS NOT NULL AND price_ma_ratio IS NOT NULL
  AND rsi_14 IS NOT NULL AND atr_14 IS NOT NULL"""),
    ]


def _fsql(body, src="bars_multi", fixture="bars_multi", extra=()):
    return sql(body, fixture, extra=feature_ctes(src) + list(extra))


def _bars(spark, sf_dir):
    return fx.bars(spark, sf_dir, multi=True)


# ---- W03-W08 ---------------------------------------------------------------

@register("ternary_label", _fsql("SELECT series, day, target FROM feat_all"), dates="day")
def q_ternary_label(spark, sf_dir):
    return W.ternary_label(W.next_day_change(_bars(spark, sf_dir))).select("series", "day", "target")


@register("price_ma_ratio", _fsql(f"SELECT series, day, round(price_ma_ratio, {R}) AS price_ma_ratio FROM feat_all"),
          dates="day")
def q_price_ma_ratio(spark, sf_dir):
    return _bars(spark, sf_dir).select("series", "day",
                                       F.round(W.price_ma_ratio(), R).alias("price_ma_ratio"))


@register("volatility_3day", _fsql(f"SELECT series, day, round(volatility_3day, {R}) AS volatility_3day FROM feat_all"),
          dates="day")
def q_volatility_3day(spark, sf_dir):
    return _bars(spark, sf_dir).select("series", "day",
                                       F.round(W.volatility_3day(), R).alias("volatility_3day"))


@register("rsi", _fsql(f"SELECT series, day, round(rsi_14, {R}) AS rsi_14 FROM feat_all"), dates="day")
def q_rsi(spark, sf_dir):
    return _bars(spark, sf_dir).select("series", "day", F.round(W.rsi(), R).alias("rsi_14"))


@register("atr", _fsql(f"SELECT series, day, round(atr_14, {BIG}) AS atr_14 FROM feat_all"), dates="day")
def q_atr(spark, sf_dir):
    return _bars(spark, sf_dir).select("series", "day", F.round(W.atr(), BIG).alias("atr_14"))


@register("pct_change", _fsql(f"""
SELECT series, day, round(volume_change, {R}) AS volume_change, round(momentum_5, {R}) AS momentum_5
FROM feat_all"""), dates="day")
def q_pct_change(spark, sf_dir):
    return _bars(spark, sf_dir).select("series", "day",
                                       F.round(W.volume_change(), R).alias("volume_change"),
                                       F.round(W.momentum(), R).alias("momentum_5"))


_FEAT_OUT = (f"series, day, round(price_range, {R}) AS price_range, day_of_week, month, "
             f"round(volatility_3day, {R}) AS volatility_3day, round(volume_change, {R}) AS volume_change, "
             f"round(momentum_5, {R}) AS momentum_5, round(price_ma_ratio, {R}) AS price_ma_ratio, "
             f"round(rsi_14, {R}) AS rsi_14, round(atr_14, {BIG}) AS atr_14, target")


def _feat_out(df):
    return df.select("series", "day", _r("price_range"), "day_of_week", "month",
                     _r("volatility_3day"), _r("volume_change"), _r("momentum_5"),
                     _r("price_ma_ratio"), _r("rsi_14"), _r("atr_14", BIG), "target")


@register("bar_feature_table", _fsql(f"SELECT {_FEAT_OUT} FROM feat"), dates="day")
def q_bar_feature_table(spark, sf_dir):
    return _feat_out(W.bar_feature_table(_bars(spark, sf_dir)))


# ---- W10 -------------------------------------------------------------------

def _seq_digest(df, *more):
    s = F.col("seq")
    out = [F.size(s).alias("seq_len"), s[0]["price"].alias("first_price"),
           F.element_at(s, -1)["price"].alias("last_price")]
    def add(c):
        return lambda acc, x: acc + F.coalesce(x[c], F.lit(0.0))

    for c in W.SEQ_FEATURES:
        total = F.aggregate(s, F.lit(0.0), add(c))
        out.append(F.round(total, BIG if c != "change_pct" else R).alias(f"sum_{c}"))
    return df.select("series", "day", "target", *out, *more)


def _duck_seq(src):
    w = "PARTITION BY series ORDER BY day"
    frame = f"({w} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
    sums = ", ".join(
        f"round(coalesce(sum({c}) OVER {frame}, 0), {BIG if c != 'change_pct' else R}) AS sum_{c}"
        for c in W.SEQ_FEATURES)
    return f"""
SELECT series, day, target, seq_len, first_price, last_price, {', '.join('sum_' + c for c in W.SEQ_FEATURES)}
FROM (SELECT series, day, price AS target, CAST(count(*) OVER {frame} AS INTEGER) AS seq_len,
             lag(price, 30) OVER ({w}) AS first_price, lag(price, 1) OVER ({w}) AS last_price, {sums},
             row_number() OVER ({w}) AS rn
      FROM {src})
WHERE rn > 30"""


@register("lookback_sequences", sql(_duck_seq("bars_multi"), "bars_multi"), dates="day")
def q_lookback_sequences(spark, sf_dir):
    return _seq_digest(W.lookback_sequences(_bars(spark, sf_dir), 30))


@register("lookback_sequences_news", sql(f"""
SELECT s.*, m.n_items, round(m.v0, {R}) AS v_first
FROM ({_duck_seq('bars')}) s
JOIN (SELECT series, day, count(*) AS n_items, avg(CAST(v[1] AS DOUBLE)) AS v0 FROM vecs GROUP BY 1, 2) m
  ON s.series = m.series AND s.day = m.day""", "bars", "vecs"), dates="day")
def q_lookback_sequences_news(spark, sf_dir):
    """J06 policy: windows cut over all bars, then bars without news drop."""
    seqs = W.lookback_sequences(fx.bars(spark, sf_dir), 30, vecs=fx.vecs(spark, sf_dir),
                                news_policy="same_day_mean_required")
    return _seq_digest(seqs, "n_items", F.round(F.col("v")[0], R).alias("v_first"))


def _duck_policy(day: str) -> str:
    """The windows with the first vector of ``day`` (a bar's own day, or the one
    before), 0 where there is none."""
    return f"""
SELECT s.*, f.v IS NOT NULL AS has_news, round(coalesce(CAST(f.v[1] AS DOUBLE), 0), {R}) AS v_first,
       round(coalesce(CAST(f.v[64] AS DOUBLE), 0), {R}) AS v_last
FROM ({_duck_seq('bars')}) s
JOIN (SELECT series, day, {day} AS news_day FROM bars) b ON s.series = b.series AND s.day = b.day
LEFT JOIN (SELECT series, day, arg_min(v, (ts, vec_id)) AS v FROM vecs GROUP BY 1, 2) f
  ON b.series = f.series AND b.news_day = f.day"""


def _policy(spark, sf_dir, policy):
    seqs = W.lookback_sequences(fx.bars(spark, sf_dir), 30, vecs=fx.vecs(spark, sf_dir),
                                news_policy=policy)
    return _seq_digest(seqs, "has_news", F.round(F.col("v")[0], R).alias("v_first"),
                       F.round(F.element_at("v", -1), R).alias("v_last"))


@register("lookback_sequences_same_day", sql(_duck_policy("day"), "bars", "vecs"), dates="day")
def q_lookback_sequences_same_day(spark, sf_dir):
    """J04 policy: every window, with its own day's first vector or zeros."""
    return _policy(spark, sf_dir, "same_day_or_zero")


@register("lookback_sequences_prev_bar", sql(_duck_policy(
    "lag(day) OVER (PARTITION BY series ORDER BY day)"), "bars", "vecs"), dates="day")
def q_lookback_sequences_prev_bar(spark, sf_dir):
    """J05 policy: every window, with the previous bar's first vector or zeros."""
    return _policy(spark, sf_dir, "prev_bar_or_zero")


# ---- W11-W13 ----------------------------------------------------------------

_SCALE_COLS = W.SEQ_FEATURES


@register("minmax_scale", sql(f"""
SELECT b.series, b.day, {', '.join(
    f"round(CASE WHEN s.mx_{c} = s.mn_{c} THEN 0.0 ELSE (b.{c} - s.mn_{c}) / (s.mx_{c} - s.mn_{c}) END, {R}) AS {c}"
    for c in _SCALE_COLS)}
FROM bars_multi b JOIN (SELECT series, {', '.join(f'min({c}) AS mn_{c}, max({c}) AS mx_{c}' for c in _SCALE_COLS)}
                        FROM bars_multi GROUP BY series) s ON b.series = s.series""", "bars_multi"),
          dates="day")
def q_minmax_scale(spark, sf_dir):
    s = W.minmax_scale(_bars(spark, sf_dir), _SCALE_COLS)
    return s.select("series", "day", *[_r(c) for c in _SCALE_COLS])


@register("minmax_inverse", sql(f"""
SELECT series, day, round(price, {BIG}) AS price, round(price, {BIG}) AS price_back FROM bars_multi""",
                                "bars_multi"), dates="day")
def q_minmax_inverse(spark, sf_dir):
    b = _bars(spark, sf_dir)
    scaled = W.minmax_scale(b.withColumn("price_orig", F.col("price")), _SCALE_COLS, keep_stats=True)
    back = W.minmax_inverse(scaled, _SCALE_COLS)
    return back.select("series", "day", F.round("price_orig", BIG).alias("price"),
                       F.round("price", BIG).alias("price_back"))


_STD_COLS = W.FEATURES


@register("standard_scale", sql(f"""
SELECT f.series, f.day, f.is_train, {', '.join(
    f"round(CASE WHEN s.sd_{c} = 0 THEN 0.0 ELSE (f.{c} - s.mu_{c}) / s.sd_{c} END, {R}) AS {c}"
    for c in _STD_COLS)}
FROM ft f JOIN (SELECT series, {', '.join(f'avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}' for c in _STD_COLS)}
                FROM ft WHERE is_train GROUP BY series) s ON f.series = s.series""", "bars_multi",
                                extra=feature_ctes("bars_multi") + [("ft", """
SELECT *, row_number() OVER (PARTITION BY series ORDER BY day)
          <= floor(CAST(0.8 AS DOUBLE) * count(*) OVER (PARTITION BY series)) AS is_train
FROM feat""")]), dates="day")
def q_standard_scale(spark, sf_dir):
    feats = W.bar_feature_table(_bars(spark, sf_dir))
    ranked = splits.chronological_order(feats, ["day"], group=["series"],
                                        bounded_groups=True)
    split = splits.chrono_split(ranked, 0.2, group=["series"]).withColumnRenamed("train_b", "is_train")
    scaled = W.standard_scale(split, _STD_COLS, train_col="is_train")
    return scaled.select("series", "day", "is_train", *[_r(c) for c in _STD_COLS])


# ---- L03-L07 ----------------------------------------------------------------

_RANK = "row_number() OVER (ORDER BY day, ts, vec_id)"


def _ranked_vecs(spark, sf_dir):
    v = fx.vecs(spark, sf_dir).select("vec_id", "day", "ts")
    return splits.chronological_order(v, ["day", "ts", "vec_id"])


@register("chronological_order", sql(f"SELECT vec_id, {_RANK} AS rank FROM vecs", "vecs"))
def q_chronological_order(spark, sf_dir):
    return _ranked_vecs(spark, sf_dir).select("vec_id", "rank")


@register("chrono_split", sql(f"""
SELECT vec_id, rank, rank <= n - ceil(CAST(0.2 AS DOUBLE) * n) AS train_a,
       rank <= floor(CAST(0.8 AS DOUBLE) * n) AS train_b
FROM (SELECT vec_id, {_RANK} AS rank, count(*) OVER () AS n FROM vecs)""", "vecs"))
def q_chrono_split(spark, sf_dir):
    return splits.chrono_split(_ranked_vecs(spark, sf_dir)).select("vec_id", "rank", "train_a",
                                                                   "train_b")


@register("stratified_split", sql("""
SELECT doc_id, y_true, r <= ceil(CAST(0.2 AS DOUBLE) * n) AS is_test FROM (
  SELECT doc_id, y_true,
         row_number() OVER (PARTITION BY y_true ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r,
         count(*) OVER (PARTITION BY y_true) AS n
  FROM labels_pred)""", "labels_pred"))
def q_stratified_split(spark, sf_dir):
    lp = fx.labels_pred(spark, sf_dir).select("doc_id", "y_true")
    return splits.stratified_split(lp, "y_true", 42, "doc_id").select("doc_id", "y_true", "is_test")


@register("expanding_folds", sql(f"""
SELECT vec_id, fold, role FROM (
  SELECT vec_id, CAST(fold AS INTEGER) AS fold,
         CASE WHEN rank - 1 < n - (6 - fold) * s THEN 'train'
              WHEN rank - 1 < n - (5 - fold) * s THEN 'test' END AS role
  FROM (SELECT vec_id, {_RANK} AS rank, count(*) OVER () AS n, count(*) OVER () // 6 AS s FROM vecs),
       range(1, 6) t(fold))
WHERE role IS NOT NULL""", "vecs"))
def q_expanding_folds(spark, sf_dir):
    return splits.expanding_folds(_ranked_vecs(spark, sf_dir)).select("vec_id", "fold", "role")


@register("stratified_folds", sql("""
SELECT s.doc_id, s.y_true, CAST(pj.fold AS INTEGER) AS fold
FROM (SELECT doc_id, y_true, row_number() OVER (PARTITION BY y_true ORDER BY doc_id) AS j
      FROM labels_pred) s
JOIN (SELECT y_true, p % 5 AS fold, row_number() OVER (PARTITION BY y_true ORDER BY p % 5, p) AS j
      FROM (SELECT y_true, unnest(range(start, start + n)) AS p
            FROM (SELECT y_true, n, CAST(coalesce(sum(n) OVER (ORDER BY y_true ROWS BETWEEN UNBOUNDED
                                                          PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
                  FROM (SELECT y_true, count(*) AS n FROM labels_pred GROUP BY y_true)))) pj
  ON s.y_true = pj.y_true AND s.j = pj.j""", "labels_pred"))
def q_stratified_folds(spark, sf_dir):
    lp = fx.labels_pred(spark, sf_dir).select("doc_id", "y_true")
    return splits.stratified_folds(lp, "y_true", order=["doc_id"]).select("doc_id", "y_true", "fold")


# ---- A05-A10 -----------------------------------------------------------------

@register("class_distribution", _fsql("""
SELECT c.label, coalesce(t.n, 0) AS n FROM (VALUES (0), (1), (2)) c(label)
LEFT JOIN (SELECT target AS label, count(*) AS n FROM feat GROUP BY target) t ON c.label = t.label"""))
def q_class_distribution(spark, sf_dir):
    f = W.bar_feature_table(_bars(spark, sf_dir))
    return metrics.class_distribution(f, [0, 1, 2], label="target").withColumnRenamed("target", "label")


@register("confusion_matrix", sql("""
SELECT t.y_true, p.y_pred, count(l.doc_id) AS n
FROM (VALUES (0), (1)) t(y_true) CROSS JOIN (VALUES (0), (1)) p(y_pred)
LEFT JOIN labels_pred l ON l.y_true = t.y_true AND l.y_pred = p.y_pred
GROUP BY t.y_true, p.y_pred""", "labels_pred"))
def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(fx.labels_pred(spark, sf_dir), [0, 1])


def _report_sql():
    return """
WITH cm AS (SELECT t.y_true, p.y_pred, count(l.doc_id) AS n
            FROM (VALUES (0), (1)) t(y_true) CROSS JOIN (VALUES (0), (1)) p(y_pred)
            LEFT JOIN labels_pred l ON l.y_true = t.y_true AND l.y_pred = p.y_pred
            GROUP BY t.y_true, p.y_pred),
per AS (SELECT c, support, tp, predicted,
               CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall
        FROM (SELECT y_true AS c, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp
              FROM cm GROUP BY y_true) a
        JOIN (SELECT y_pred AS c2, sum(n) AS predicted FROM cm GROUP BY y_pred) b ON a.c = b.c2),
per2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                        ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM per),
tot AS (SELECT sum(support) AS total, sum(tp) AS tp FROM per2)
SELECT CAST(c AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, round(tp / total, 6), CAST(total AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM per2"""


@register("classification_report", sql(_report_sql().replace("WITH cm AS", "SELECT * FROM (WITH cm AS", 1) + ")",
                                       "labels_pred"))
def q_classification_report(spark, sf_dir):
    rep = metrics.classification_report(fx.labels_pred(spark, sf_dir), [0, 1])
    return rep.select("label", _r("precision"), _r("recall"), _r("f1"), "support")


@register("accuracy", sql(f"""
SELECT round(avg(CAST(y_true = y_pred AS DOUBLE)), {R}) AS accuracy FROM labels_pred""", "labels_pred"))
def q_accuracy(spark, sf_dir):
    return metrics.accuracy(fx.labels_pred(spark, sf_dir)).select(_r("accuracy"))


def _reg_sql(src):
    return f"""
SELECT count(*) AS n,
       round((SELECT avg(bl) FROM (SELECT avg(e * e) AS bl FROM (
          SELECT e, (row_number() OVER (ORDER BY {_ORDER}) - 1) // 64 AS b FROM {src})
          GROUP BY b)), 2) AS loss,
       round(avg(abs(e)), {BIG}) AS mae, round(sqrt(avg(e * e)), {BIG}) AS rmse,
       round(avg(e * e), 2) AS mse,
       round(avg(CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END), {BIG}) AS huber
FROM {src}"""


# rows in batch order: the line key repeats in this data, so the order is
# completed by the values (a total order; equal rows have equal errors)
_ORDER = "l_orderkey, l_linenumber, y_true, y_pred"
ORDER = ["l_orderkey", "l_linenumber", "y_true", "y_pred"]
_ERR = "SELECT l_orderkey, l_linenumber, y_true, y_pred, y_pred - y_true AS e FROM reg_pred"
_ERR2 = ("SELECT l_orderkey, l_linenumber, y_true, y_pred, y_pred - y_true AS e FROM ("
         "SELECT l_orderkey, l_linenumber, l_extendedprice AS y_true, "
         "l_quantity * p_retailprice * (1 - l_discount) AS y_pred "
         "FROM lineitem JOIN part ON l_partkey = p_partkey)")


def _reg_out(df):
    return df.select("n", F.round("loss", 2).alias("loss"), _r("mae", BIG), _r("rmse", BIG),
                     F.round("mse", 2).alias("mse"), _r("huber", BIG))


@register("regression_metrics", sql(_reg_sql("err"), "reg_pred", extra=[("err", _ERR)]))
def q_regression_metrics(spark, sf_dir):
    m = metrics.regression_metrics(fx.reg_pred(spark, sf_dir), ORDER)
    return _reg_out(m)


def _discounted_pred(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    p = fx.table(spark, sf_dir, "part")
    return (li.join(p, li.l_partkey == p.p_partkey)
            .select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y_true"),
                    (F.col("l_quantity") * F.col("p_retailprice") * (1 - F.col("l_discount")))
                    .alias("y_pred")))


def _unrounded(src):
    return f"""
SELECT (SELECT avg(bl) FROM (SELECT avg(e * e) AS bl FROM (
          SELECT e, (row_number() OVER (ORDER BY {_ORDER}) - 1) // 64 AS b FROM {src})
          GROUP BY b)) AS loss, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM {src}"""


@register("improvement_pct", sql(f"""
SELECT {', '.join(f"round((b.{m} - o.{m}) / b.{m} * 100, {R}) AS {m}_improvement_pct"
                  for m in ('loss', 'mae', 'rmse'))}
FROM ({_unrounded('err')}) b, ({_unrounded('err2')}) o""", "reg_pred",
                                 extra=[("err", _ERR), ("err2", _ERR2)]))
def q_improvement_pct(spark, sf_dir):
    base = metrics.regression_metrics(fx.reg_pred(spark, sf_dir), ORDER)
    other = metrics.regression_metrics(_discounted_pred(spark, sf_dir), ORDER)
    imp = metrics.improvement_pct(base, other)
    return imp.select(*[_r(c) for c in imp.columns])
