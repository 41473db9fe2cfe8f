"""Corpus statistics: concentration, coverage, agreement and errors, as plain aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count and share of each value in its group; null is a value."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    if not by:
        return counted.crossJoin(F.broadcast(df.agg(F.count("*").alias("__total")))).withColumn("p", F.col("n") / F.col("__total")).drop("__total")
    return counted.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def concentration(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, distinct, entropy in bits and the effective number of classes (inverse Simpson).

    From counts alone: H = log2(N) - sum(n log2 n) / N and 1 / sum((n / N)^2), so one pass of sums.
    """
    c = df.groupBy(*by, value).agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    return c.groupBy(*by).agg(total.cast("long").alias("n"), F.count("*").alias("n_distinct"), F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 6).alias("entropy_bits"), F.round(total * total / F.sum(F.col("n") * F.col("n")), 6).alias("effective_number"))


def top_values(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group with their counts, ties by value."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc_nulls_last(value))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def long_fields(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row for each record and field, values as text."""
    return df.select(*keys, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))))


def field_stats(df: DataFrame, fields: list[str]) -> DataFrame:
    """Of each field: recorded count, share of the most frequent value, effective number, that value."""
    rows = long_fields(df, [], fields).where("value is not null")
    c = rows.groupBy("field", "value").agg(F.count("*").cast("double").alias("n"))
    return c.groupBy("field").agg(F.sum("n").cast("long").alias("recorded"), F.round(F.max("n") / F.sum("n"), 6).alias("modal_share"), F.round(F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n")), 6).alias("effective_number"), F.min(F.struct((-F.col("n")).alias("k"), "value"))["value"].alias("top_value"))


def is_filled(col: Column, kind: str = "string") -> Column:
    """Neither null nor empty nor zero."""
    if kind == "array":
        return F.coalesce(F.size(col) > 0, F.lit(False))
    return F.coalesce(~col.cast("string").isin("", "0", "0.0"), F.lit(False))


def coverage(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Share of rows in which each field is filled; one pass for all of them."""
    wide = df.agg(*(F.avg(is_filled(F.col(f), kind).cast("int")).alias(f) for f, kind in fields.items()))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.round(F.col(f), 6).alias("share")) for f in fields))))


def percent(cond: Column) -> Column:
    """Share of rows for which a condition holds, in percent; a null condition does not hold."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double")) * 100


def errors(value: str, reference: str) -> list[Column]:
    """n, MAE, RMSE over rows in which both are finite."""
    e = F.col(value) - F.col(reference)
    e = F.when(e.isNotNull() & ~F.isnan(e), e)
    return [F.count(e).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse")]


def fixed_oracle_worst(columns: list[str]) -> list[Column]:
    """Mean of each column and of the row-wise least and greatest."""
    return [*(F.round(F.avg(c), 6).alias(f"fixed_{c}") for c in columns), F.round(F.avg(F.least(*columns)), 6).alias("oracle"), F.round(F.avg(F.greatest(*columns)), 6).alias("worst")]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def histogram(name: str, count: str, k: int | None = None) -> Column:
    """Values with their counts as text, the most frequent first, ties by value; of a group's counted rows."""
    order = F.array_sort(F.collect_list(F.struct((-F.col(count)).alias("k"), F.col(name).alias("v"))))
    order = order if k is None else F.slice(order, 1, k)
    return F.array_join(F.transform(order, lambda x: F.concat(F.coalesce(x["v"].cast("string"), F.lit("")), F.lit(":"), (-x["k"]).cast("string"))), ",")


def label_report(df: DataFrame, by: list[str], label: str, k: int) -> DataFrame:
    """Of each group: n, distinct labels, entropy in bits, and the k most frequent labels with counts."""
    c = df.groupBy(*by, label).agg(F.count("*").alias("__n"))
    top = top_values(df, by, label, k).groupBy(*by).agg(histogram(label, "n").alias("top"))
    n = F.col("__n").cast("double")
    entropy = F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)
    return c.groupBy(*by).agg(F.sum("__n").alias("n"), F.count("*").alias("n_distinct"), F.round(entropy, 6).alias("entropy_bits")).join(top, by)


def slices(df: DataFrame, slice_col: str, predicted: str, right: Column) -> DataFrame:
    """Of each slice: n, percent right, and the histogram of what was predicted (few values)."""
    c = df.groupBy(slice_col, predicted).agg(F.count("*").alias("__n"), F.count_if(right).alias("__ok"))
    return c.groupBy(slice_col).agg(F.sum("__n").alias("n"), F.round(100.0 * F.sum("__ok") / F.sum("__n"), 6).alias("pct"), histogram(predicted, "__n").alias("predicted"))


def ablation(df: DataFrame, by: list[str], passed: str, chem: str, tokens: str) -> DataFrame:
    """Of each arm: runs, those that pass each kind of check, both rates, mean tokens of runs with any."""
    ok, right = F.count_if(passed), F.count_if(chem)
    used = F.when(F.col(tokens) != 0, F.col(tokens))
    return df.groupBy(*by).agg(F.count("*").alias("runs"), ok.alias("passed"), right.alias("chem_passed"), F.round(100.0 * ok / F.count("*"), 6).alias("pass_pct"), F.round(100.0 * right / F.count("*"), 6).alias("chem_pct"), F.round(F.avg(used), 6).alias("mean_tokens"))
