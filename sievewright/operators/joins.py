"""Joins by key, with what each does about missing and repeated keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join; raises if a row of left has no match."""
    lost = left.join(right, on, "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"no match for {[tuple(r[c] for c in on) for r in lost]}")
    return left.join(right, on)


def override(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Right's rows with these columns taken from left."""
    mine = left.select(*on, *(F.col(c).alias(f"__{c}") for c in columns))
    return right.join(mine, on).withColumns({c: F.col(f"__{c}") for c in columns}).drop(*(f"__{c}" for c in columns))


def seen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """status: seen, unseen, or no_key where the key is null."""
    marks = known.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__seen", F.lit(True))
    return rows.join(marks, key, "left").withColumn("status", F.when(F.col(key).isNull(), "no_key").when(F.col("__seen"), "seen").otherwise("unseen")).drop("__seen")


def weighted_sums(terms: DataFrame, values: DataFrame, on: str, by: list[str], weight: str, value: str) -> DataFrame:
    """Sum of weight times value in each group, null if any value is missing; and the terms."""
    total = F.round(F.sum(F.col(weight) * F.col(value)), 4)
    return terms.join(values, on, "left").groupBy(*by).agg(F.when(F.count_if(F.col(value).isNull()) == 0, total).alias("value"), F.count("*").alias("terms"))


def paired(long: DataFrame, on: list[str], policy: str, error: str, least: int) -> DataFrame:
    """Two policies at a time on the rows both have: n, mean difference, strict wins."""
    one, two = (long.select(*on, F.col(policy).alias(p), F.col(error).alias(e)) for p, e in (("one", "__a"), ("two", "__b")))
    a, b = F.col("__a"), F.col("__b")
    both = one.join(two, on).where(F.col("one") < F.col("two"))
    return both.groupBy("one", "two").agg(F.count("*").alias("n"), F.round(F.avg(a - b), 6).alias("mean_diff"), F.count_if(a < b).alias("one_wins"), F.count_if(b < a).alias("two_wins")).where(F.col("n") >= least)


def overlay(old: DataFrame, new: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """All keys of both; new values win where they are not null."""
    n = new.select(*on, *(F.col(c).alias(f"__{c}") for c in columns))
    return old.join(n, on, "full").select(*on, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))


def close_pairs(df: DataFrame, by: list[str], at: str, width: int, key: str, distance: Column | None = None) -> DataFrame:
    """Pairs (a, b) of keys, a < b, of one group, whose integer positions differ by width at most."""
    cut = F.floor(F.col(at) / width)
    left = df.select(*by, F.col(key).alias("__k"), F.col(at).alias("__t"), F.explode(F.array(cut, cut + 1)).alias("__c"))
    right = df.select(*by, F.col(key).alias("__l"), F.col(at).alias("__u"), cut.alias("__c"))
    # a pair in two neighbouring buckets meets in the later one; one in the same bucket, there
    met = left.join(right, [*by, "__c"])
    own = F.floor(F.col("__t") / width) == F.col("__c")
    near = (F.abs(F.col("__t") - F.col("__u")) <= width) & F.when(own, F.col("__k") < F.col("__l")).otherwise(F.lit(True))
    return met.where(near).select(F.least("__k", "__l").alias("a"), F.greatest("__k", "__l").alias("b"))


def merge_sources(first: DataFrame, second: DataFrame, on: str, trusted: dict[str, str]) -> DataFrame:
    """One row for each key of either table: each field of `trusted` from the source it names ("first" or
    "second") and, where that has none, from the other; `source` tells which have the key. Null keys
    don't meet."""
    side = lambda df, name: df.select(F.col(on), *(F.col(c).alias(f"__{name}_{c}") for c in trusted), F.lit(True).alias(f"__{name}"))
    both = side(first, "first").join(side(second, "second"), on, "full")
    other = {"first": "second", "second": "first"}
    values = [F.coalesce(f"__{t}_{c}", f"__{other[t]}_{c}").alias(c) for c, t in trusted.items()]
    source = F.when(F.col("__first") & F.col("__second"), "both").when(F.col("__first"), "first").otherwise("second")
    return both.select(on, *values, source.alias("source"))


def key_differences(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """Keys that only one table has, with the one that has them: missing (from second) or extra."""
    lost = first.select(*on).distinct().join(second.select(*on).distinct(), on, "left_anti").withColumn("difference", F.lit("missing"))
    more = second.select(*on).distinct().join(first.select(*on).distinct(), on, "left_anti").withColumn("difference", F.lit("extra"))
    return lost.unionByName(more)
