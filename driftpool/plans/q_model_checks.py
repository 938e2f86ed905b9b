"""What SQL can check next to a fitted model: which rows it scores, their true
values, and that every output is a legal one."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpool.operators import models
from driftpool.plans import q_models, q_streams
from driftpool.plans.oracle import sql
from driftpool.plans.q_keyed import _LBARS
from driftpool.plans.q_series import feature_ctes
from driftpool.plans.registry import ORACLES, register

R = 6

_DAYS = """
SELECT m.series, m.day, strftime(m.day, '%Y%m%d') AS day_id, CAST(b.nc > 0 AS INTEGER) AS label
FROM (SELECT DISTINCT series, day FROM vecs) m
JOIN (SELECT series, day, lead(change_pct) OVER (PARTITION BY series ORDER BY day) AS nc
      FROM bars) b ON m.series = b.series AND m.day = b.day
WHERE b.nc IS NOT NULL"""
_SPLIT = f"""
SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{q_models.SEED}:' || day_id), day_id)
          <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY label)) AS is_test FROM days"""
_CTES = [("days", _DAYS), ("day_split", _SPLIT)]

ORACLES["model_save_load"] = sql("SELECT count(*) AS n_rows, count(*) AS n_equal FROM days",
                                 "vecs", "bars", extra=_CTES[:1])


def _valid():
    return (F.col("y_pred").isin(0, 1) & F.col("confidence").between(0.5, 1.0)).alias("valid")


@register("direction_forest_rows", sql("""
SELECT series, day, label AS y_true, true AS valid FROM day_split WHERE is_test""",
                                       "vecs", "bars", extra=_CTES), dates="day")
def q_direction_forest_rows(spark, sf_dir):
    """The test days of the seeded split, each with a class and a confidence."""
    return q_models.q_direction_forest(spark, sf_dir).select("series", "day", "y_true", _valid())


@register("projection_2d_rows", sql(f"""
SELECT day, label, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split,
       is_test AND row_number() OVER (PARTITION BY is_test
                                      ORDER BY md5('{q_models.SEED}:' || day_id), day_id) <= 100 AS predicted,
       true AS placed
FROM day_split""", "vecs", "bars", extra=_CTES), dates="day")
def q_projection_2d_rows(spark, sf_dir):
    """Every labelled day on the map, and which test days carry a prediction."""
    p = q_models.q_projection_2d(spark, sf_dir)
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return p.select("day", "label", "split", F.col("predicted").isin(0, 1).alias("predicted"),
                    (finite("x") & finite("y")).alias("placed"))


@register("pca_means", sql("""
SELECT CAST(i AS INTEGER) AS component, (SELECT count(*) FROM vecs) AS n_rows, true AS centred
FROM range(32) t(i)""", "vecs"))
def q_pca_means(spark, sf_dir):
    """32 components of every vector, each with mean 0."""
    p = q_models.q_pca_features(spark, sf_dir)
    one = p.agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(f"emb_pca_{i}").alias(f"m{i}")
                                                     for i in range(32)])
    means = F.array(*[F.col(f"m{i}") for i in range(32)])
    return (one.select("n_rows", F.posexplode(means).alias("component", "m"))
            .select("component", "n_rows", (F.abs("m") < 1e-6).alias("centred")))


@register("lookback_regressor_rows", sql(f"""
SELECT series, day, round((price - lo) / (hi - lo), {R}) AS y_true, true AS valid
FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) - 30 AS rank,
             count(*) OVER (PARTITION BY series) - 30 AS n,
             min(price) OVER (PARTITION BY series) AS lo, max(price) OVER (PARTITION BY series) AS hi
      FROM bars)
WHERE rank > n - ceil(CAST(0.2 AS DOUBLE) * n) AND rank >= 1""", "bars"), dates="day")
def q_lookback_regressor_rows(spark, sf_dir):
    """The last fifth of the lookback windows with their scaled targets."""
    p = q_models.q_lookback_regressor(spark, sf_dir)
    finite = ~F.isnan("y_pred") & (F.abs("y_pred") < float("inf"))
    return p.select("series", "day", F.round("y_true", R).alias("y_true"), finite.alias("valid"))


@register("stream_score_rows", sql("""
SELECT series, day, count(*) AS n_items, true AS valid FROM vecs
WHERE CAST(day AS TIMESTAMP) + INTERVAL 2 DAY <= (SELECT max(ts) FROM vecs)
GROUP BY series, day""", "vecs"), dates="day")
def q_stream_score_rows(spark, sf_dir):
    """The days the watermark closed, each scored once."""
    s = q_streams.q_stream_score(spark, sf_dir)
    return s.select("series", "day", "n_items", (F.col("direction").isin("Increase", "Decrease")
                                                 & F.col("confidence").between(0.5, 1.0)).alias("valid"))


@register("direction_gbt_rows", sql("""
SELECT vec_id, day, label AS y_true, true AS valid
FROM (SELECT v.vec_id, v.day, b.label, row_number() OVER (ORDER BY v.day, v.ts, v.vec_id) AS rank,
             count(*) OVER () AS n
      FROM vecs v JOIN lbars b ON v.series = b.series AND v.day = b.day)
WHERE rank > floor(CAST(0.8 AS DOUBLE) * n)""", "vecs", "bars", extra=[("lbars", _LBARS)]), dates="day")
def q_direction_gbt_rows(spark, sf_dir):
    """The last fifth of the news rows, each with a class and a confidence."""
    return q_models.q_direction_gbt(spark, sf_dir).select("vec_id", "day", "y_true", _valid())


_TERNARY = """
SELECT series, day, target FROM (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS rank,
         count(*) OVER (PARTITION BY series) AS n FROM feat)
WHERE rank > floor(CAST(0.8 AS DOUBLE) * n)"""


@register("ternary_boost_rows", sql(f"""
SELECT series, day, CAST(target AS INTEGER) AS y_true, true AS valid, 300 AS rounds, true AS loss_falls
FROM ({_TERNARY})""", "bars", extra=feature_ctes("bars")), dates="day")
def q_ternary_boost_rows(spark, sf_dir):
    """The last fifth of the bars with probabilities of three classes that sum
    to one, of which the predicted one is the largest; 300 rounds were fitted, and
    the training loss fell from each tenth round to the next tenth."""
    model, data = q_models.last_or("ternary_boost", spark, sf_dir, q_models.ternary_model)
    loss = model.history[::10, 0, 0, 1]
    out = model.transform(data.where(~F.col("is_train")))
    p = F.col("probability")
    valid = ((F.size(p) == 3) & (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9)
             & (F.element_at(p, F.col("prediction").cast("int") + 1) == F.array_max(p)))
    return out.select("series", "day", F.col("target").cast("int").alias("y_true"), valid.alias("valid"),
                      F.lit(len(model.rounds)).alias("rounds"),
                      F.lit(bool((loss[1:] < loss[:-1]).all())).alias("loss_falls"))


_TRIALS = ", ".join(
    f"({i}, {t['max_depth']}, CAST({t['step']!r} AS DOUBLE), {t['max_iter']})"
    for i, t in enumerate(models.draw_staged_trials(30, seed=q_models.SEED)))


@register("param_search_gbt", f"""
SELECT CAST(trial AS INTEGER) AS trial, CAST(max_depth AS INTEGER) AS max_depth, round(step, {R}) AS step,
       CAST(max_iter AS INTEGER) AS max_iter, 5 AS n_folds, true AS scored, CAST(1 AS BIGINT) AS best_trials
FROM (VALUES {_TRIALS}) t(trial, max_depth, step, max_iter)""")
def q_param_search_gbt(spark, sf_dir):
    """M06, boosting: 30 trials from the full ranges, each with a mean accuracy of 5
    folds; exactly one is the best, and none scores more."""
    t = q_models.gbt_search(spark, sf_dir)
    best = t.agg(F.count_if("is_best").alias("best_trials"),
                 F.max(F.when(F.col("is_best"), F.col("mean_score"))).alias("top"))
    scored = F.col("mean_score").between(0, 1) & (F.col("mean_score") <= F.col("top"))
    return t.crossJoin(F.broadcast(best)).select(
        "trial", "max_depth", F.round("step", R).alias("step"), "max_iter", "n_folds",
        scored.alias("scored"), "best_trials")


@register("best_by_validation_history", f"""
SELECT CAST(c AS INTEGER) AS candidate, CAST(i AS INTEGER) AS iteration, true AS finite,
       CAST(1 AS BIGINT) AS best_rows, true AS best_is_lowest, true AS training_falls
FROM range({len(q_models.BOOST_CANDIDATES)}) a(c), range({q_models.ITERATIONS + 1}) b(i)""")
def q_best_by_validation_history(spark, sf_dir):
    """Losses of every candidate after every iteration, all finite; one row is the
    best, and it has the lowest validation loss; every candidate's training loss
    fell over its iterations."""
    t = q_models.boost_candidates(spark, sf_dir).history_table(spark)
    best = t.agg(F.count_if("is_best").alias("best_rows"), F.min("valid_loss").alias("low"),
                 F.min(F.when(F.col("is_best"), F.col("valid_loss"))).alias("own"))
    ends = t.groupBy("candidate").agg(F.max_by("train_loss", "iteration").alias("last"),
                                      F.min_by("train_loss", "iteration").alias("first"))
    falls = ends.agg(F.every(F.col("last") < F.col("first")).alias("training_falls"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return t.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(falls)).select(
        "candidate", "iteration", (finite("train_loss") & finite("valid_loss")).alias("finite"),
        "best_rows", (F.col("low") == F.col("own")).alias("best_is_lowest"), "training_falls")


@register("best_by_validation_rows", f"""
SELECT reg_param, true AS finite, CAST(1 AS BIGINT) AS best_rows
FROM (VALUES {", ".join(f"(CAST({r!r} AS DOUBLE))" for r in q_models.REGS)}) t(reg_param)""")
def q_best_by_validation_rows(spark, sf_dir):
    """Every regularisation with a finite loss, one of them the best."""
    t = q_models.last_or("best_by_validation", spark, sf_dir, q_models.q_best_by_validation)
    best = t.agg(F.count_if("is_best").alias("best_rows"))
    finite = ~F.isnan("val_mse") & (F.abs("val_mse") < float("inf"))
    return t.crossJoin(F.broadcast(best)).select("reg_param", finite.alias("finite"), "best_rows")


@register("feature_importance_ranks", """
SELECT CAST(i AS INTEGER) AS rank, true AS descends, true AS named FROM range(1, 21) t(i)""")
def q_feature_importance_ranks(spark, sf_dir):
    """Twenty features of the vector's 64, importances descending."""
    from pyspark.sql.window import Window

    t = q_models.q_feature_importance_topk(spark, sf_dir)  # twenty rows
    w = Window.orderBy(F.desc("importance"), "feature")
    number = F.regexp_extract("feature", r"^Feature (\d+)$", 1)
    return t.select(F.row_number().over(w).alias("rank"),
                    F.coalesce(F.col("importance") <= F.lag("importance").over(w),
                               F.col("importance") <= 1).alias("descends"),
                    (number.cast("int").between(0, 63)).alias("named"))


@register("predict_direction_rows", sql(f"""
SELECT (SELECT count(*) FROM vecs WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1995-01-02')
         AS n_items, 64 AS embedding_dim, CAST(min(date) AS DATE) AS day, count(*) AS n_news,
       CAST(least(count(*), 10) AS INTEGER) AS n_top, true AS valid
FROM news WHERE date >= TIMESTAMP '1995-01-01' AND date < TIMESTAMP '1995-01-02'""", "vecs", "news"),
          dates="day")
def q_predict_direction_rows(spark, sf_dir):
    """The previous day's item, news and headline counts beside a legal prediction."""
    p = q_models.q_predict_direction(spark, sf_dir)
    valid = F.col("direction").isin("Increase", "Decrease") & F.col("confidence").between(0.5, 1.0)
    return p.select("n_items", "embedding_dim", "day", "n_news", "n_top", valid.alias("valid"))


@register("combined_regressor_rows", sql("""
SELECT model, (SELECT count(*) FROM (
         SELECT *, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM (
           SELECT b.day FROM (SELECT day, row_number() OVER (ORDER BY day) AS i FROM bars) b
           WHERE b.i > 30 AND b.day IN (SELECT day FROM vecs)))
       WHERE r > n - ceil(CAST(0.2 AS DOUBLE) * n)) AS n, true AS valid
FROM (VALUES ('lags'), ('lags_news')) t(model)""", "bars", "vecs"))
def q_combined_regressor_rows(spark, sf_dir):
    """Both models' metrics over the same test rows: finite, rmse^2 = mse, and the
    improvements those of the two rows."""
    t = q_models.last_or("combined_regressor", spark, sf_dir, q_models.q_combined_regressor)
    mse = {m: F.max(F.when(F.col("model") == m, F.col("mae"))) for m in ("lags", "lags_news")}
    both = t.agg(mse["lags"].alias("base"), mse["lags_news"].alias("other"))
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b))
    valid = (near(F.col("rmse") * F.col("rmse"), F.col("mse")) & (F.col("mae") <= F.col("rmse") + 1e-12)
             & (F.abs("huber") < float("inf"))
             & near(F.col("mae_improvement_pct"), (F.col("base") - F.col("other")) / F.col("base") * 100))
    return t.crossJoin(F.broadcast(both)).select("model", "n", valid.alias("valid"))


@register("cv_score_rows", "SELECT CAST(5 AS BIGINT) AS n_folds, true AS valid")
def q_cv_score_rows(spark, sf_dir):
    """Five folds, a mean accuracy and a spread that five numbers in [0, 1] can have."""
    c = q_models.last_or("cv_score", spark, sf_dir, q_models.q_cv_score)
    return c.select("n_folds", (F.col("mean_score").between(0, 1)
                                & F.col("std_score").between(0, 0.5)).alias("valid"))


@register("param_search_rows", """
SELECT CAST(i AS INTEGER) AS trial, true AS scored, CAST(1 AS BIGINT) AS best_trials FROM range(10) t(i)""")
def q_param_search_rows(spark, sf_dir):
    """M06, forests: ten trials with a legal score, one of them the best."""
    t = q_models.last_or("param_search", spark, sf_dir, q_models.q_param_search)
    best = t.agg(F.count_if("is_best").alias("best_trials"))
    return t.crossJoin(F.broadcast(best)).select("trial", F.col("mean_score").between(0, 1).alias("scored"),
                                                 "best_trials")
