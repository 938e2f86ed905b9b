"""Model training and scoring on MLlib.

Vectors stay ``array<float>`` in tables and become MLlib vectors only at the
model boundary (``array_to_vector``). Fitting is distributed by MLlib (tree
statistics and covariance are aggregated across tasks); the driver only holds
fitted parameters and small metric tables.
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassificationModel, GBTClassificationModel, GBTClassifier,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, LinearRegression
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpool.operators.boosting import ROWS_PER_BLOCK, SKIP, TEST, TRAIN, Boosted, Plan, fit_boosters


# PySpark lists a new model's params by reading its attributes, and ``trees`` is one: every
# fit wraps every tree, param by param, in calls to the JVM that hold up fits of other
# threads. A plain property is left out of that list, and wraps the trees when asked.
class _ForestModel(RandomForestClassificationModel):
    @property
    def trees(self):
        return [DecisionTreeClassificationModel(m) for m in self._call_java("trees")]


class _Forest(RandomForestClassifier):
    def _create_model(self, java_model):
        return _ForestModel(java_model)


class _BoostedModel(GBTClassificationModel):
    @property
    def trees(self):
        return [DecisionTreeRegressionModel(m) for m in self._call_java("trees")]


class _Booster(GBTClassifier):
    def _create_model(self, java_model):
        return _BoostedModel(java_model)


def fit_cached(estimator, train: DataFrame):
    """Fit with the training input persisted for the fit's passes (learners
    scan it several times: split finding, label metadata, tree points or
    iterations) and released afterwards. Lost cached blocks are recomputed from
    lineage, which is deterministic here (``stable_layout``)."""
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(train)
    finally:
        train.unpersist()


def as_features(df: DataFrame, cols, out: str = "features") -> DataFrame:
    """Array column(s) and/or numeric columns -> one MLlib vector column."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    parts, tmp = [], []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType.simpleString()
        if dt.startswith("array"):
            name = f"_fv{i}"
            df = df.withColumn(name, array_to_vector(F.col(c).cast("array<double>")))
            parts.append(name)
            tmp.append(name)
        else:
            parts.append(c)
    if len(parts) == 1 and tmp:
        return df.withColumnRenamed(parts[0], out)
    df = VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="error").transform(df)
    return df.drop(*tmp)


def pca_features(df: DataFrame, v: str = "v", k: int = 32, prefix: str = "emb_pca_"):
    """Centre (StandardScaler withMean, no scaling - MLlib PCA does not
    centre) then PCA(k); returns (rows with prefix0..k-1, fitted model)."""
    x = as_features(df, v, "_x")
    pipe = Pipeline(stages=[StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False),
                            PCA(k=k, inputCol="_c", outputCol="_p")])
    model = fit_cached(pipe, x)
    arr = vector_to_array(F.col("_p"))
    keep = [c for c in df.columns if c != v]
    out = model.transform(x).select(*keep, *[arr[i].alias(f"{prefix}{i}") for i in range(k)])
    return out, model


def projection_2d(pooled: DataFrame, v: str = "v"):
    """2-D PCA map of pooled vectors (x, y) and the fitted model."""
    out, model = pca_features(pooled, v, k=2, prefix="_pc")
    return out.withColumnRenamed("_pc0", "x").withColumnRenamed("_pc1", "y"), model


def stable_layout(df: DataFrame, key, n_parts: int | None = None) -> DataFrame:
    """Deterministic partitions and row order (hash on ``key``, sorted within
    partitions): seeded learners that draw per partition (bagging) then give
    the same model on every run, whatever order shuffles delivered rows in and
    however many cores there are. The partition count is part of the model:
    ``n_parts``, or the session's shuffle partitions."""
    if not key:
        return df
    key = [key] if isinstance(key, str) else list(key)
    n = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *key).sortWithinPartitions(*key)


#: partitions that even few rows are dealt over, if the session has as many
LEAST_PARTS = 8


def row_parts(df: DataFrame) -> int:
    """Partitions for a learner with jobs by the hundred, each of which has a task, a
    result and a set of sums for every partition: the session's shuffle partitions, but
    beyond ``LEAST_PARTS`` no more than one for each ``ROWS_PER_BLOCK`` rows. Counts the rows."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(LEAST_PARTS, -(-df.count() // ROWS_PER_BLOCK)))


def random_forest(train: DataFrame, features: str = "features", label: str = "label",
                  num_trees: int = 100, max_depth: int = 10, min_instances: int = 1,
                  subset: str = "sqrt", seed: int = 42, stable_key=None):
    """Random forest classifier (min_samples_split has no MLlib twin). MLlib
    refuses depths over 30.
    Pass ``stable_key`` (a unique row key) for run-to-run identical models."""
    rf = _Forest(featuresCol=features, labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                 minInstancesPerNode=min_instances, featureSubsetStrategy=subset, seed=seed)
    return fit_cached(rf, stable_layout(train, stable_key)
                      .withColumn(label, F.col(label).cast("double")))


def gbt(train: DataFrame, features: str = "features", label: str = "label", max_iter: int = 100,
        step: float = 0.1, max_depth: int = 3, seed: int = 42, stable_key=None):
    """Gradient-boosted trees (binary). Nothing is drawn by partition here, so with
    ``stable_key`` the rows are dealt over as many as they need (``row_parts``)."""
    g = _Booster(featuresCol=features, labelCol=label, maxIter=max_iter, stepSize=step,
                 maxDepth=max_depth, seed=seed)
    train = train.withColumn(label, F.col(label).cast("double"))
    if not stable_key:
        return fit_cached(g, train)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)  # counted, then dealt
    try:
        return fit_cached(g, stable_layout(train, stable_key, row_parts(train)))
    finally:
        train.unpersist()


def ternary_boost(data: DataFrame, train_col: str = "is_train", features: str = "features",
                  label: str = "target", max_iter: int = 300, step: float = 0.05, max_depth: int = 4,
                  stable_key=None) -> Boosted:
    """3-class boosting with one soft-max loss: each round adds a regression tree
    for every class, on the gradient of the joint loss. Rows where ``train_col`` is
    false are scored after each round (``history``)."""
    roles = F.array(F.when(F.col(train_col), TRAIN).otherwise(TEST))
    return fit_boosters(data.withColumn("_roles", roles), [Plan(max_iter, step, max_depth)], "softmax",
                        features, label, "_roles", classes=3, key=stable_key)


def predictions(model, df: DataFrame, keep, label: str = "label") -> DataFrame:
    """Scored rows: keys, true label, prediction (int) and, when the model has
    one, the probability of the predicted class as ``confidence``."""
    out = model.transform(df)
    cols = [*keep, F.col(label).cast("int").alias("y_true"),
            F.col("prediction").cast("int").alias("y_pred")]
    if "probability" in out.columns:
        p = vector_to_array(F.col("probability"))
        cols.append(F.element_at(p, F.col("prediction").cast("int") + 1).alias("confidence"))
    return out.select(*cols)


def feature_importance_topk(model, spark, k: int = 20, names=None) -> DataFrame:
    """Importances, descending, top k, named 'Feature i' by default."""
    imp = model.featureImportances.toArray().tolist()
    names = names or [f"Feature {i}" for i in range(len(imp))]
    df = spark.createDataFrame([(n, float(x)) for n, x in zip(names, imp)],
                               "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(k)


def weighted_f1(pred: DataFrame, label="y_true", prediction="y_pred") -> float:
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction,
                                           metricName="f1")
    return ev.evaluate(pred.select(F.col(label).cast("double").alias(label),
                                   F.col(prediction).cast("double").alias(prediction)))


def accuracy_of(pred: DataFrame, label="y_true", prediction="y_pred") -> float:
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction,
                                           metricName="accuracy")
    return ev.evaluate(pred.select(F.col(label).cast("double").alias(label),
                                   F.col(prediction).cast("double").alias(prediction)))


def cv_scores(data: DataFrame, fold_col: str, fit, score, keep, label="label", pool=None) -> list[float]:
    """Score of ``fit`` on each fold: train on the other folds, test on it; the folds run
    side by side in ``pool``, if given."""
    folds = sorted(r[0] for r in data.select(fold_col).distinct().collect())

    def one(f) -> float:
        tr = data.where(F.col(fold_col) != f)
        te = data.where(F.col(fold_col) == f)
        return score(predictions(fit(tr), te, keep, label))

    return list((pool.map if pool else map)(one, folds))


def cv_scores_expanding(rows: DataFrame, fit, score, keep, label="label",
                        fold_col: str = "fold", role_col: str = "role") -> list[float]:
    """Scores over time-series folds given as (row, fold, role) rows (L06):
    fit on the fold's 'train' rows (everything before its test block), score
    on its 'test' rows."""
    folds = sorted(r[0] for r in rows.select(fold_col).distinct().collect())
    scores = []
    for f in folds:
        part = rows.where(F.col(fold_col) == f)
        model = fit(part.where(F.col(role_col) == "train"))
        scores.append(score(predictions(model, part.where(F.col(role_col) == "test"), keep, label)))
    return scores


def fold_roles(folds: DataFrame, keys, n_folds: int = 5, fold_col: str = "fold",
               role_col: str = "role") -> DataFrame:
    """(keys, roles): (row, fold, role) rows of L06, folds from 1, as one row with an
    array of what the row is to each fold."""
    role = lambda k: F.coalesce(F.max(F.when(F.col(fold_col) == k, F.when(
        F.col(role_col) == "train", TRAIN).otherwise(TEST))), F.lit(SKIP))
    return folds.groupBy(*keys).agg(F.array(*[role(k) for k in range(1, n_folds + 1)]).alias("roles"))


def boosted_cv(data: DataFrame, n_folds: int = 5, features: str = "features", label: str = "label",
               max_iter: int = 100, step: float = 0.1, max_depth: int = 3, stable_key=None) -> list[float]:
    """Accuracy of binary boosting on each fold of ``roles`` (see ``fold_roles``);
    the folds' ensembles grow side by side."""
    plans = [Plan(max_iter, step, max_depth, k) for k in range(n_folds)]
    got = fit_boosters(data, plans, "logistic", features, label, key=stable_key)
    return [float(got.history[max_iter, k, 1, 2]) for k in range(n_folds)]


def cv_score(spark, scores: list[float]) -> DataFrame:
    """Mean and population std of fold scores."""
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "fold int, score double")
    return df.agg(F.count(F.lit(1)).alias("n_folds"), F.avg("score").alias("mean_score"),
                  F.stddev_pop("score").alias("std_score"))


# The search ranges of the two parameter searches.
RF_SPACE = {"num_trees": (100, 300), "max_depth": (5, 20), "min_instances": (1, 10),
            "subset": ("sqrt", "log2", "all")}
GBT_SPACE = {"max_iter": (100, 500), "step": (0.01, 0.2), "max_depth": (3, 7)}


def draw_trials(space: dict, n: int, seed: int = 42) -> list[dict]:
    """Seeded random search draws (integers uniform, 'step' log-uniform)."""
    rng = random.Random(seed)
    trials = []
    for _ in range(n):
        t = {}
        for k, rngv in space.items():
            if isinstance(rngv[0], str):
                t[k] = rng.choice(rngv)
            elif k == "step":
                import math
                t[k] = math.exp(rng.uniform(math.log(rngv[0]), math.log(rngv[1])))
            else:
                t[k] = rng.randint(rngv[0], rngv[1])
        trials.append(t)
    return trials


def param_search(data: DataFrame, fold_col: str, n_trials: int = 10, seed: int = 42,
                 keep=("day",), label: str = "label", max_workers: int = 4,
                 stable_key=None) -> DataFrame:
    """M06, forests: best of n seeded trials by mean weighted F1; ``fold_col`` assigns
    each row one fold (L07), train on the others. Returns the trial table with
    ``is_best``.

    MLlib sums every open node of a level in every partition, rows or not, so rows are
    dealt once, for all fits, over as many partitions as they need (``row_parts``); with
    ``stable_key`` those are part of the model. Fits of all trials and folds, each a distributed MLlib job, run
    side by side: as many as there are cores for, and ``max_workers`` at least."""
    trials = draw_trials(RF_SPACE, n_trials, seed)
    spark = data.sparkSession
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    dealt = None
    try:
        parts = row_parts(data)
        dealt = (stable_layout(data, stable_key, parts) if stable_key else data.coalesce(parts)).persist(
            StorageLevel.MEMORY_AND_DISK)
        workers = max(max_workers, spark.sparkContext.defaultParallelism // parts)

        def run(t):
            fit = lambda tr: random_forest(tr, label=label, seed=seed, **t)
            sc = cv_scores(dealt, fold_col, fit, weighted_f1, list(keep), label, fits)
            return sum(sc) / len(sc)

        # a trial's thread only waits for its fits
        with ThreadPoolExecutor(workers) as fits, ThreadPoolExecutor(max(1, n_trials)) as pool:
            scores = list(pool.map(run, trials))
    finally:
        data.unpersist()
        if dealt is not None:
            dealt.unpersist()
    best = max(range(len(trials)), key=lambda i: (scores[i], -i))
    rows = [(i, str(sorted(t.items())), float(scores[i]), i == best) for i, t in enumerate(trials)]
    return spark.createDataFrame(
        rows, "trial int, params string, mean_score double, is_best boolean")


def draw_staged_trials(n_trials: int = 30, per_fit: int = 5, seed: int = 42) -> list[dict]:
    """Seeded draws from the whole ``GBT_SPACE``, in groups of ``per_fit`` trials that
    share depth and step size and differ in their rounds."""
    trials = []
    for i in range(-(-n_trials // per_fit)):
        shape = draw_trials({k: GBT_SPACE[k] for k in ("step", "max_depth")}, 1, f"{seed}:{i}")[0]
        rounds = draw_trials({"max_iter": GBT_SPACE["max_iter"]}, per_fit, f"{seed}:{i}:rounds")
        trials += [{**shape, **r} for r in rounds]
    return trials[:n_trials]


def param_search_gbt(data: DataFrame, n_folds: int = 5, trials: list[dict] | None = None,
                     features: str = "features", label: str = "label", stable_key=None) -> DataFrame:
    """M06, boosting: the trial table (trial, max_depth, step, max_iter, n_folds,
    mean_score, is_best) over time-series folds given as ``roles`` (``fold_roles``);
    the score is mean accuracy, ties go to the earlier trial.

    Evaluation is staged: a depth and step size is fitted once on each fold, to the
    largest number of rounds any of its trials asks for, and every round is scored,
    so trials that differ in their rounds cost nothing more; all fits grow side by
    side. A fold without test rows does not count."""
    trials = draw_staged_trials() if trials is None else trials
    most: dict[tuple, int] = {}
    for t in trials:
        shape = (t["max_depth"], t["step"])
        most[shape] = max(most.get(shape, 0), t["max_iter"])
    plans = [Plan(rounds, step, depth, k) for (depth, step), rounds in most.items() for k in range(n_folds)]
    got = fit_boosters(data, plans, "logistic", features, label, key=stable_key)
    at = {shape: i * n_folds for i, shape in enumerate(most)}
    scores = []
    for t in trials:
        first = at[t["max_depth"], t["step"]]
        scores.append(float(np.nanmean(got.history[t["max_iter"], first:first + n_folds, 1, 2])))
    best = max(range(len(trials)), key=lambda i: (scores[i], -i))
    rows = [(i, t["max_depth"], float(t["step"]), t["max_iter"], n_folds, scores[i], i == best)
            for i, t in enumerate(trials)]
    return data.sparkSession.createDataFrame(
        rows, "trial int, max_depth int, step double, max_iter int, n_folds int, "
              "mean_score double, is_best boolean")


def save_model(model, path: str) -> None:
    """Persist a fitted model (overwrite)."""
    model.write().overwrite().save(path)


def linear_regressor(train: DataFrame, features: str = "features", label: str = "target",
                     reg: float = 0.0):
    """Least-squares regression on flattened lookback windows."""
    return LinearRegression(featuresCol=features, labelCol=label, regParam=reg,
                            elasticNetParam=0.0).fit(train)


def best_by_validation(train: DataFrame, valid: DataFrame, regs, features="features",
                       label="target") -> DataFrame:
    """Fit one candidate per regParam, validation MSE each; keep the
    lowest (the loss history is the table)."""
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="mse")
    rows = []
    for r in regs:
        m = linear_regressor(train, features, label, r)
        rows.append((float(r), float(ev.evaluate(m.transform(valid)))))
    best = min(rows, key=lambda x: (x[1], x[0]))[0]
    df = train.sparkSession.createDataFrame(rows, "reg_param double, val_mse double")
    return df.withColumn("is_best", F.col("reg_param") == F.lit(best))


def boost_history(data: DataFrame, candidates: list[tuple[float, int]], iterations: int = 100,
                  train_col: str = "fit_part", features: str = "features", label: str = "target",
                  stable_key=None) -> Boosted:
    """M11 for an iterative learner: boosted regressors (step size, depth), each with its
    training and validation loss after every iteration (``history_table``). The best
    iteration of the best candidate is restored with ``restore_best``."""
    roles = F.array(F.when(F.col(train_col), TRAIN).otherwise(TEST))
    plans = [Plan(iterations, rate, depth) for rate, depth in candidates]
    return fit_boosters(data.withColumn("_roles", roles), plans, "squared", features, label, "_roles",
                        key=stable_key)


def restore_best(fitted: Boosted, df: DataFrame, features: str = "features") -> DataFrame:
    """``df`` scored by the candidate and iteration with the lowest validation loss."""
    best = min(range(len(fitted.plans)), key=lambda i: (fitted.history[fitted.best_round(i), i, 1, 1], i))
    return fitted.transform(df, features, best, fitted.best_round(best))
