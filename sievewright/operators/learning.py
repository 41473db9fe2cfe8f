"""Models: leave-one-out linear classifiers, label permutations, forests, boosted trees, k-means.

Leave-one-out and label permutations fit a model for each row or replicate. They are for sets of a
few thousand rows at most: those rows are sent to every task (their number is checked), and the fits
are spread over tasks. Forests, boosted trees and k-means are Spark's and take any number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..determinism import uniform

MOST_ROWS = 20_000


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (intercept last) of an L2 logistic regression by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(a.shape[1]), np.diag([*np.ones(x.shape[1]) / c, 1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights (intercept last, penalised like the others) of an L2 linear SVM with squared hinge loss,
    by Newton's method with step halving."""
    a, t = np.column_stack([x, np.ones(len(x))]), 2 * y - 1
    w = np.zeros(a.shape[1])
    loss = lambda v: 0.5 * v @ v + c * (np.maximum(0, 1 - t * (a @ v)) ** 2).sum()
    for _ in range(rounds):
        inside = t * (a @ w) < 1
        b = a[inside]
        slope = w + 2 * c * b.T @ (b @ w - t[inside])
        step = np.linalg.solve(np.eye(len(w)) + 2 * c * b.T @ b, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


MODELS = {"logreg": logistic, "svm": svm}


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = x.std(0)
    return x.mean(0), np.where(s == 0, 1.0, s)


def predict_one(x: np.ndarray, y: np.ndarray, out: int, model: str = "logreg") -> int:
    """The label predicted for row `out` by a model of all others; the majority where they have one label."""
    keep = np.arange(len(y)) != out
    rest = y[keep]
    if len(rest) == 0 or rest.min() == rest.max():
        return int(round(rest.mean())) if len(rest) else 0
    m, s = scaled(x[keep])
    w = MODELS[model]((x[keep] - m) / s, rest)
    return int(np.append((x[out] - m) / s, 1.0) @ w > 0)


def _gathered(df: DataFrame, key: str, features: str, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = df.select(key, features, label).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    rows.sort(key=lambda r: r[0])
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)


def loocv(df: DataFrame, key: str, features: str, label: str, model: str = "logreg") -> DataFrame:
    """key, y, pred: each row predicted by a model (of MODELS) of all the others."""
    if model not in MODELS:
        raise ValueError(f"no model {model!r}")
    ids, x, y = _gathered(df, key, features, label)

    def run(batches):
        for batch in batches:
            at = batch["i"].to_numpy()
            yield pd.DataFrame({key: ids[at], "y": y[at].astype(int), "pred": [predict_one(x, y, i, model) for i in at]})

    spark = df.sparkSession
    return spark.range(len(ids)).select(F.col("id").alias("i")).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, f"{key} long, y int, pred int")


def balanced_accuracy(y: np.ndarray, pred: np.ndarray) -> float:
    return float(np.mean([np.mean(pred[y == c] == c) for c in np.unique(y)])) if len(y) else 0.0


def permutation_test(df: DataFrame, key: str, features: str, label: str, replicates: int, folds: int, seed: int) -> DataFrame:
    """One row: balanced accuracy in folds, and (1 + replicates at least as good) / (replicates + 1),
    where a replicate has its labels in the order of a draw and all models fitted again."""
    ids, x, y = _gathered(df, key, features, label)
    fold = np.arange(len(ids)) % folds

    def score(labels: np.ndarray) -> float:
        pred = np.zeros(len(labels))
        for f in range(folds):
            keep = fold != f
            if labels[keep].min() == labels[keep].max():
                pred[~keep] = labels[keep][0]
                continue
            m, s = scaled(x[keep])
            w = logistic((x[keep] - m) / s, labels[keep])
            pred[~keep] = np.column_stack([(x[~keep] - m) / s, np.ones((~keep).sum())]) @ w > 0
        return balanced_accuracy(labels, pred)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"rep": batch["rep"], "score": [score(y if r == 0 else y[np.argsort(u, kind="stable")]) for r, u in zip(batch["rep"], batch["draws"])]})

    spark = df.sparkSession
    draws = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(ids)))), lambda i: uniform(seed, F.col("rep"), i))
    reps = spark.range(replicates + 1).select(F.col("id").alias("rep")).repartition(spark.sparkContext.defaultParallelism).select("rep", draws.alias("draws"))
    scores = reps.mapInPandas(run, "rep long, score double")
    real = scores.where("rep = 0").select(F.col("score").alias("real"))
    return scores.crossJoin(F.broadcast(real)).agg(F.round(F.first("real"), 6).alias("score"), F.round((1 + F.count_if((F.col("rep") > 0) & (F.col("score") >= F.col("real") - 1e-12))) / (replicates + 1), 6).alias("p"))


def accuracy(preds: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """n, accuracy and balanced accuracy (the mean over labels) of predictions."""
    each = preds.groupBy(y).agg(F.count("*").alias("n"), F.avg((F.col(y) == F.col(pred)).cast("double")).alias("hit"))
    return each.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("hit")) / F.sum("n"), 6).alias("accuracy"), F.round(F.avg("hit"), 6).alias("balanced"))


def _labelled(train: DataFrame, held: DataFrame, features: str, label: str, model) -> DataFrame:
    """held with `prediction`, the label that a model fitted on train gives; labels are those of train."""
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector

    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(train)
    vector = lambda df: df.withColumn("__x", array_to_vector(F.col(features).cast("array<double>")))
    fitted = model.setLabelCol("__y").setFeaturesCol("__x").setPredictionCol("__p").fit(vector(index.transform(train)))
    told = fitted.transform(vector(held))
    return IndexToString(inputCol="__p", outputCol="prediction", labels=index.labels).transform(told).select(*held.columns, "prediction")


def forest(trees: int = 100, depth: int = 20, seed: int = 0):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=trees, maxDepth=min(depth, 30), seed=seed, maxMemoryInMB=512)


def boosted(rounds: int = 20, depth: int = 4, seed: int = 0):
    """Histogram-boosted trees, one model for each label against the others."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, maxBins=32))


def best_of_grid(train: DataFrame, val: DataFrame, features: str, label: str, models: dict) -> tuple[str, DataFrame]:
    """The name of the model that is right on most validation rows (the first of equals), and those rows
    with its predictions. models: name -> a function that makes one."""
    best = None
    for name, make in models.items():
        told = _labelled(train, val, features, label, make())
        hit = told.agg(F.avg((F.col("prediction") == F.col(label).cast("string")).cast("double"))).first()[0] or 0.0
        if best is None or hit > best[0]:
            best = (hit, name, told)
    return best[1], best[2]


def evaluate_folds(rows: DataFrame, fold: str, folds: int, features: str, label: str, make) -> DataFrame:
    """fold, n, pct, coverage_pct, given_seen_pct: a model of the other folds scored on each fold; which
    part of its labels the others have; how often it is right on that part."""
    out = None
    for k in range(folds):
        train, held = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
        told = _labelled(train, held, features, label, make())
        seen = train.select(F.col(label).alias("__l")).distinct().withColumn("__seen", F.lit(True))
        told = told.join(seen, F.col(label) == F.col("__l"), "left").withColumn("ok", (F.col("prediction") == F.col(label).cast("string")).cast("double"))
        known = F.col("__seen").isNotNull()
        one = told.agg(F.lit(k).alias("fold"), F.count("*").alias("n"), F.round(100 * F.avg("ok"), 6).alias("pct"), F.round(100 * F.avg(known.cast("double")), 6).alias("coverage_pct"), F.round(100 * F.avg(F.when(known, F.col("ok"))), 6).alias("given_seen_pct"))
        out = one if out is None else out.unionByName(one)
    return out


def freeze(df: DataFrame, key: str, features: str, label: str) -> dict:
    """A router fitted once, as parameters and their digest: a linear score for each of some labels,
    one against the others, on standardised features. For sets of MOST_ROWS at most."""
    from .models import model_digest

    _, x, y = _gathered(df, key, features, label)
    mean, scale = scaled(x)
    z = (x - mean) / scale
    classes = sorted(set(y.tolist()))
    fits = [logistic(z, (y == c).astype(float)) for c in classes] if len(classes) > 1 else [np.zeros(z.shape[1] + 1)] * len(classes)
    model = {"classes": [str(int(c)) for c in classes], "mean": mean.tolist(), "scale": scale.tolist(), "coef": [w[:-1].tolist() for w in fits], "intercept": [float(w[-1]) for w in fits]}
    return {**model, "sha256": model_digest(model)}


def forest_by_cell(train: DataFrame, test: DataFrame, cell: str, features: list[str], label: str, cells: list[str], trees: int = 20, depth: int = 8, seed: int = 0) -> DataFrame:
    """cell, n, pct: a random forest for each of a few cells, scored on test rows; a label that training
    lacks is never right."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    out = None
    for c in cells:
        part, held = train.where(F.col(cell) == c), test.where(F.col(cell) == c)
        steps = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="__y", handleInvalid="keep"), VectorAssembler(inputCols=features, outputCol="__x"), RandomForestClassifier(labelCol="__y", featuresCol="__x", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=512)])
        done = steps.fit(part).transform(held)
        one = done.agg(F.lit(c).alias("cell"), F.count("*").alias("n"), F.round(100 * F.avg((F.col("prediction") == F.col("__y")).cast("double")), 6).alias("pct"))
        out = one if out is None else out.unionByName(one)
    return out


def kmeans_agreement(df: DataFrame, features: list[str], label: str, seed: int = 0) -> DataFrame:
    """Two clusters found without labels against two labels, in the better of both namings, and against
    a linear model of the labels: agreement, boundary_agreement, and the cosine of the model's weights
    to the line between the clusters' centres."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="__x").transform(df).withColumn("__y", F.col(label).cast("double"))
    model = KMeans(k=2, seed=seed, featuresCol="__x", predictionCol="__c").fit(x)
    linear = LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__p", probabilityCol="__pr", rawPredictionCol="__r", maxIter=50).fit(x)
    centres = model.clusterCenters()
    line = centres[1] - centres[0] if len(centres) > 1 else np.zeros(len(features))
    w = np.array(linear.coefficients)
    cosine = float(abs(w @ line) / (np.linalg.norm(w) * np.linalg.norm(line) + 1e-12))
    done = linear.transform(model.transform(x))
    same, edge = (F.avg((F.col("__c") == F.col(c)).cast("double")) for c in ("__y", "__p"))
    return done.agg(F.count("*").alias("n"), F.round(F.greatest(same, 1 - same), 6).alias("agreement"), F.round(F.greatest(edge, 1 - edge), 6).alias("boundary_agreement"), F.lit(round(cosine, 6)).alias("cosine"))
