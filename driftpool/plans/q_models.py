"""Model queries (M01-M12, S08). Checked by rows and invariants (tests), not
by values: fitted models have no SQL twin."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from driftpool import fixtures as fx
from driftpool.operators import features as W
from driftpool.operators import metrics, models, pooling, splits
from driftpool.plans import q_slice
from driftpool.plans.q_clean import PREV_DAY_NOW
from driftpool.plans.registry import register
from driftpool.session import shared_path, write_shared
from driftpool.operators import filters

SEED = 42

#: what a session's slow queries found last: the companions that check it (q_model_checks)
#: read it instead of fitting again
_LAST: dict[tuple, object] = {}


def keep_last(name: str, spark, sf_dir, value):
    _LAST[name, spark.sparkContext.applicationId, sf_dir] = value
    return value


def last_or(name: str, spark, sf_dir, make):
    """What query ``name`` kept in this session, or what ``make`` gives now."""
    got = _LAST.get((name, spark.sparkContext.applicationId, sf_dir))
    return make(spark, sf_dir) if got is None else got


def day_table(spark, sf_dir):
    """Pooled day vectors with the next-day direction label."""
    return q_slice.daily_vectors_with_direction(spark, sf_dir)


def day_split(spark, sf_dir):
    """Stratified 80/20 split of the labelled days (seeded)."""
    d = day_table(spark, sf_dir).withColumn("day_id", F.date_format("day", "yyyyMMdd"))
    s = splits.stratified_split(d.select("day_id", "label"), "label", SEED, "day_id")
    return d.join(s.select("day_id", "is_test"), "day_id")


def forest_model(spark, sf_dir):
    sp = models.as_features(day_split(spark, sf_dir), "v")
    model = models.random_forest(sp.where(~F.col("is_test")), seed=SEED, stable_key="day")
    return model, sp


@register("direction_forest")
def q_direction_forest(spark, sf_dir):
    model, sp = forest_model(spark, sf_dir)
    return models.predictions(model, sp.where(F.col("is_test")), ["series", "day"])


@register("feature_importance_topk")
def q_feature_importance_topk(spark, sf_dir):
    model, _ = forest_model(spark, sf_dir)
    return models.feature_importance_topk(model, spark, 20)


@register("model_save_load")
def q_model_save_load(spark, sf_dir):
    """Predictions of the saved-and-loaded forest equal the fitted one's."""
    model, sp = forest_model(spark, sf_dir)
    path = shared_path(spark, "direction-forest")
    models.save_model(model, path)
    loaded = RandomForestClassificationModel.load(path)
    a = models.predictions(model, sp, ["day"]).withColumnRenamed("y_pred", "a")
    b = models.predictions(loaded, sp, ["day"]).select("day", F.col("y_pred").alias("b"))
    j = a.join(b, "day")
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col("a") == F.col("b")).alias("n_equal"))


@register("pca_features")
def q_pca_features(spark, sf_dir):
    out, _ = models.pca_features(fx.vecs(spark, sf_dir).select("vec_id", "day", "v"), "v", 32)
    return out


@register("projection_2d")
def q_projection_2d(spark, sf_dir):
    """Every labelled day on a 2-D map with its true label; test days also
    carry the forest's prediction (at most 100 of them, seeded)."""
    model, sp = forest_model(spark, sf_dir)
    proj, _ = models.projection_2d(sp.select("day", "label", "is_test", "v"), "v")
    test = splits.seeded_sample(sp.where(F.col("is_test")).withColumn(
        "day_id", F.date_format("day", "yyyyMMdd")), 100, SEED, "day_id")
    pred = models.predictions(model, test, ["day"]).select("day", "y_pred")
    return proj.join(pred, "day", "left").select(
        "day", "x", "y", "label", F.when(F.col("is_test"), "test").otherwise("train").alias("split"),
        F.coalesce("y_pred", F.lit(-1)).alias("predicted"))


def _news_rows(spark, sf_dir):
    """J02 rows with label, PCA components, ranked by time."""
    from driftpool.plans.q_keyed import _fanout

    rows = _fanout(spark, sf_dir).select("vec_id", "day", "ts", "v", "label")
    pcs, _ = models.pca_features(rows, "v", 32)
    ranked = splits.chronological_order(pcs.select("vec_id", "day", "ts"), ["day", "ts", "vec_id"])
    return pcs.join(splits.chrono_split(ranked).select("vec_id", "train_b"), "vec_id")


@register("direction_gbt")
def q_direction_gbt(spark, sf_dir):
    """Boosting on the 32 components of news rows, time-ordered 80/20."""
    rows = _news_rows(spark, sf_dir)
    feats = models.as_features(rows, [f"emb_pca_{i}" for i in range(32)])
    model = models.gbt(feats.where(F.col("train_b")), max_iter=100, step=0.1, max_depth=3,
                       stable_key="vec_id")
    return models.predictions(model, feats.where(~F.col("train_b")), ["vec_id", "day"])


def _feature_split(spark, sf_dir):
    f = W.bar_feature_table(fx.bars(spark, sf_dir))
    ranked = splits.chronological_order(f, ["day"], group=["series"],
                                        bounded_groups=True)
    sp = splits.chrono_split(ranked, 0.2, group=["series"]).withColumnRenamed("train_b", "is_train")
    scaled = W.standard_scale(sp, W.FEATURES, train_col="is_train")
    return models.as_features(scaled, W.FEATURES)


def ternary_model(spark, sf_dir):
    """(3-class boosting: 300 rounds, depth 4, rate 0.05, chronological 80/20; its data)."""
    data = _feature_split(spark, sf_dir)
    model = models.ternary_boost(data, stable_key=["series", "day"])
    return keep_last("ternary_boost", spark, sf_dir, (model, data))


@register("ternary_boost")
def q_ternary_boost(spark, sf_dir):
    """M05 on the scaled nine features: the test rows with their class probabilities."""
    model, data = ternary_model(spark, sf_dir)
    out = model.transform(data.where(~F.col("is_train")))
    cls = F.col("prediction").cast("int")
    return out.select("series", "day", F.col("target").alias("y_true"), cls.alias("y_pred"),
                      F.element_at("probability", cls + 1).alias("confidence"), "probability")


@register("param_search")
def q_param_search(spark, sf_dir):
    """Forest search - 10 seeded trials x 5 stratified folds, weighted F1."""
    d = day_table(spark, sf_dir)
    folds = splits.stratified_folds(d.select("day", "label"), "label", order=["day"]).select("day", "fold")
    data = models.as_features(d.join(folds, "day"), "v")
    found = models.param_search(data, "fold", n_trials=10, seed=SEED, stable_key="day")
    return keep_last("param_search", spark, sf_dir, found)


def _fold_rows(spark, sf_dir):
    """News rows with their 32 components as an array and their roles in the 5
    expanding time-series folds (L06)."""
    rows = write_shared(_news_rows(spark, sf_dir), "news-rows")
    ranked = splits.chronological_order(rows.select("vec_id", "day", "ts"), ["day", "ts", "vec_id"])
    roles = models.fold_roles(splits.expanding_folds(ranked), ["vec_id"])
    x = F.array(*[f"emb_pca_{i}" for i in range(32)])
    return rows.select("vec_id", "label", x.alias("features")).join(roles, "vec_id")


def gbt_search(spark, sf_dir):
    """Boosting search on news rows - 30 trials x 5 expanding folds, accuracy."""
    return models.param_search_gbt(_fold_rows(spark, sf_dir), 5, models.draw_staged_trials(30, seed=SEED),
                                   stable_key="vec_id")


@register("cv_score")
def q_cv_score(spark, sf_dir):
    """Boosting on the 32 components of news rows, scored by accuracy
    over 5 expanding time-series folds (L06): mean and population std."""
    scores = models.boosted_cv(_fold_rows(spark, sf_dir), 5, stable_key="vec_id")
    return keep_last("cv_score", spark, sf_dir, models.cv_score(spark, scores))


@register("predict_direction")
def q_predict_direction(spark, sf_dir):
    """The forest (saved and loaded) scores the mean vector of the
    previous day's items; the row carries the day's news digest."""
    model, _ = forest_model(spark, sf_dir)
    path = shared_path(spark, "serving-forest")
    models.save_model(model, path)
    served = RandomForestClassificationModel.load(path)
    v = fx.vecs(spark, sf_dir).withColumnRenamed("vec_id", "message_id")
    window = filters.previous_day_news(v, PREV_DAY_NOW, date="ts", ordered=False)
    mean = pooling.window_mean_or_zero(window, dim=64)
    out = served.transform(models.as_features(mean, "v"))
    from pyspark.ml.functions import vector_to_array
    p = vector_to_array("probability")
    pred = out.select(
        "n_items", F.size("v").alias("embedding_dim"),
        F.when(F.col("prediction") == 1, "Increase").otherwise("Decrease").alias("direction"),
        F.element_at(p, F.col("prediction").cast("int") + 1).alias("confidence"))
    news = filters.previous_day_news(fx.news(spark, sf_dir), PREV_DAY_NOW, ordered=False)
    digest = metrics.daily_digest(news, k=10).select("day", "n_news", F.size("top").alias("n_top"))
    # one row each (the digest none, if there is no news): planned once, both sides tiny
    return pred.withColumn("_k", F.lit(1)).join(
        F.broadcast(digest.withColumn("_k", F.lit(1))), "_k", "left").drop("_k")


def _lookback_frame(spark, sf_dir, with_news: bool):
    b = fx.bars(spark, sf_dir)
    scaled = W.minmax_scale(b, W.SEQ_FEATURES)
    vecs = fx.vecs(spark, sf_dir) if with_news else None
    seqs = W.lookback_sequences(scaled, 30, vecs=vecs,
                                news_policy="same_day_mean_required" if with_news else "none")
    lags = F.flatten(F.transform("seq", lambda s: F.array(*[s[c] for c in W.SEQ_FEATURES])))
    seqs = seqs.withColumn("lags", F.transform(lags, lambda x: F.coalesce(x, F.lit(0.0))))
    ranked = splits.chronological_order(seqs.select("series", "day"), ["day"], group=["series"],
                                        bounded_groups=True)
    sp = splits.chrono_split(ranked, 0.2, group=["series"]).select("series", "day", "train_a")
    return seqs.join(sp, ["series", "day"])


@register("lookback_regressor")
def q_lookback_regressor(spark, sf_dir):
    """Next scaled price from 30 x 6 lagged values (linear model)."""
    data = models.as_features(_lookback_frame(spark, sf_dir, False), "lags")
    m = models.linear_regressor(data.where(F.col("train_a")))
    return (m.transform(data.where(~F.col("train_a")))
            .select("series", "day", F.col("target").alias("y_true"),
                    F.col("prediction").alias("y_pred")))


@register("combined_regressor")
def q_combined_regressor(spark, sf_dir):
    """Lags-only vs lags + that day's mean news vector, on the same rows
    (days with news), reported with A09 metrics and A10 improvement."""
    base = write_shared(_lookback_frame(spark, sf_dir, True), "lookback")  # for both models
    res = {}
    for name, cols in (("lags", ["lags"]), ("lags_news", ["lags", "v"])):
        data = models.as_features(base, cols)
        m = models.linear_regressor(data.where(F.col("train_a")), reg=0.01)
        pred = (m.transform(data.where(~F.col("train_a")))
                .select("day", F.col("target").alias("y_true"), F.col("prediction").alias("y_pred")))
        res[name] = write_shared(metrics.regression_metrics(pred, ["day"]), "metrics")
    imp = metrics.improvement_pct(res["lags"], res["lags_news"])
    table = (res["lags"].withColumn("model", F.lit("lags"))
             .unionByName(res["lags_news"].withColumn("model", F.lit("lags_news"))))
    out = table.select("*", *[imp.select(c).scalar().alias(c) for c in imp.columns])
    return keep_last("combined_regressor", spark, sf_dir, out)


def _fit_rows(spark, sf_dir):
    """M09's training rows, the last 20 % of which validate (fit_part is false)."""
    data = models.as_features(_lookback_frame(spark, sf_dir, False), "lags").where(F.col("train_a"))
    ranked = splits.chronological_order(data.select("series", "day"), ["day"], group=["series"],
                                        bounded_groups=True)
    sp = splits.chrono_split(ranked, 0.2, group=["series"]).select("series", "day",
                                                                   F.col("train_a").alias("fit_part"))
    d = data.join(sp, ["series", "day"]).select("series", "day", "fit_part", "features", "target")
    return write_shared(d, "fit-rows")  # read by every candidate's fit and validation


@register("best_by_validation")
def q_best_by_validation(spark, sf_dir):
    """regParam candidates for M09, validated on the last 20 % of the
    training rows; the loss table with the winner marked."""
    d = _fit_rows(spark, sf_dir)
    found = models.best_by_validation(d.where(F.col("fit_part")), d.where(~F.col("fit_part")), list(REGS))
    return keep_last("best_by_validation", spark, sf_dir, found)


# parameters of M11's candidates: regularisation; (step size, depth) and iterations
REGS = (0.0, 0.001, 0.01, 0.1, 1.0)
BOOST_CANDIDATES, ITERATIONS = ((0.05, 3), (0.1, 3), (0.1, 5), (0.3, 3)), 100


def boost_candidates(spark, sf_dir):
    """M11 for an iterative learner: candidates side by side, losses of 100 iterations."""
    return models.boost_history(_fit_rows(spark, sf_dir), list(BOOST_CANDIDATES), ITERATIONS,
                                stable_key=["series", "day"])
