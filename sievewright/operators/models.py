"""Features, frozen linear scorers, routing, and how predictions are scored."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0. Two passes, one small row."""
    stats = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    wide = df.crossJoin(F.broadcast(stats))
    return wide.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}).select(*df.columns)


def dot(a: Column, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def linear_scores(x: Column, model: dict) -> list[Column]:
    """A logit for each class of a frozen model: {mean, scale, coef, intercept, classes}."""
    z = F.zip_with(F.zip_with(x, F.array(*map(F.lit, model["mean"])), lambda v, m: v - m), F.array(*map(F.lit, model["scale"])), lambda v, s: v / s)
    return [dot(z, F.array(*map(F.lit, row))) + F.lit(b) for row, b in zip(model["coef"], model["intercept"])]


def apply_frozen(x: Column, model: dict) -> Column:
    """The class with the highest logit, the first of equals."""
    scores = F.array(*(F.round(s, 9) for s in linear_scores(x, model)))
    return F.element_at(F.array(*map(F.lit, model["classes"])), F.array_position(scores, F.array_max(scores)).cast("int"))


def model_digest(model: dict) -> str:
    """SHA-256 of a model's content; a changed parameter changes it."""
    return hashlib.sha256(json.dumps({k: v for k, v in model.items() if k != "sha256"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def checked(model: dict) -> dict:
    """The model, if its stored digest is that of its content."""
    if model.get("sha256") != model_digest(model):
        raise ValueError("the model's content doesn't match its digest")
    return model


def route(df: DataFrame, a: str, b: str, choose_a: Column) -> DataFrame:
    """One row: mean errors of a, b, of choosing, of the better and of the worse; the accuracy at which
    choosing breaks even with the best fixed one, and the share of the possible gain it gets."""
    chosen = F.when(choose_a, F.col(a)).otherwise(F.col(b))
    m = df.agg(F.avg(a).alias("mae_a"), F.avg(b).alias("mae_b"), F.avg(chosen).alias("routed"), F.avg(F.least(a, b)).alias("oracle"), F.avg(F.greatest(a, b)).alias("worst"))
    best = F.least("mae_a", "mae_b")
    return m.select(*(F.round(c, 6).alias(c) for c in ("mae_a", "mae_b", "routed", "oracle", "worst")), F.round(F.try_divide(F.col("worst") - best, F.col("worst") - F.col("oracle")), 6).alias("break_even"), F.round(F.try_divide(best - F.col("routed"), best - F.col("oracle")), 6).alias("captured"))


def joint_label(a: Column, b: Column) -> Column:
    """Two labels in one; a missing one is written None."""
    return F.concat(F.coalesce(a, F.lit("None")), F.lit("\u001f"), F.coalesce(b, F.lit("None")))


def normalized(x: Column) -> Column:
    return F.lower(F.replace(F.trim(x), F.lit(" "), F.lit("")))


def field_accuracy(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Of each field of two maps: in gold, in prediction, equal, missing, hallucinated."""
    keys = F.explode(F.array_distinct(F.concat(F.map_keys(gold), F.map_keys(predicted)))).alias("field")
    rows = df.select(gold, predicted, keys).select("field", F.col(gold)[F.col("field")].alias("g"), F.col(predicted)[F.col("field")].alias("p"))
    g, p = F.col("g"), F.col("p")
    return rows.groupBy("field").agg(F.count_if(g.isNotNull()).alias("gold_has"), F.count_if(p.isNotNull()).alias("pred_has"), F.count_if(g == p).alias("n_match"), F.count_if(g.isNotNull() & p.isNull()).alias("n_missing"), F.count_if(g.isNull() & p.isNotNull()).alias("n_hallucinated"))
