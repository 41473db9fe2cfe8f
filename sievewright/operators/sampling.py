"""Caps, samples and splits by ranks of hash draws (see determinism)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..determinism import mode, ranked, uniform
from .resample import positions


def cap(df: DataFrame, by: list[str], key: str, most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows of each group, the ones with the least draw; a null group is a group."""
    out = ranked(df.withColumn("__u", uniform(seed, key)), by, [F.col("__u"), F.col(key)], "__rank")
    return out.where(F.col("__rank") <= most).drop("__u", "__rank")


def reservoir(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """A uniform sample of k rows: those with the least draws, found by partial top-k of each task."""
    return df.withColumn("__u", uniform(seed, key)).orderBy("__u", key).limit(k).drop("__u")


def sample_metal(df: DataFrame, bucket: list[str], element_set: str, upload: str, key: str, upload_cap: int, element_cap: int, target: int, seed: int = 0) -> DataFrame:
    """Three caps, one in the other: uploads of an element set, the element set, the bucket."""
    one = cap(df, [*bucket, element_set, upload], key, upload_cap, seed)
    two = cap(one, [*bucket, element_set], key, element_cap, seed + 1)
    return cap(two, bucket, key, target, seed + 2)


def sample_organic(df: DataFrame, bucket: list[str], upload: str, key: str, upload_cap: int, target: int, seed: int = 0) -> DataFrame:
    return cap(cap(df, [*bucket, upload], key, upload_cap, seed), bucket, key, target, seed + 2)


def group_strata(df: DataFrame, group: str, strata: list[str]) -> DataFrame:
    """Each group with its size and, for each stratum column, its most frequent value (of ties the least)."""
    out = df.groupBy(group).agg(F.count("*").alias("size"))
    for s in strata:
        counted = df.groupBy(group, s).agg(F.count("*").alias("__n"))
        best = counted.groupBy(group).agg(F.min(F.struct((-F.col("__n")).alias("k"), F.col(s).isNull().alias("z"), F.col(s).alias("v")))["v"].alias(s))
        out = out.join(best, group)
    return out


def split_by_group(df: DataFrame, group: str, strata: list[str], fraction: float, seed: int = 0) -> DataFrame:
    """Groups with their split: of each stratum max(1, round(fraction * n)) groups are "val", but never
    all; a stratum of one group is "train"."""
    groups = group_strata(df, group, strata).withColumn("__u", uniform(seed, group))
    part = Window.partitionBy(*strata)
    n = F.count("*").over(part)
    rank = F.row_number().over(part.orderBy("__u", group))
    quota = F.least(F.greatest(F.lit(1), F.bround(F.lit(fraction) * n, 0).cast("int")), n - 1)
    return groups.select(group, "size", *strata, F.when((n >= 2) & (rank <= quota), "val").otherwise("train").alias("split"))


def split_by_fill(df: DataFrame, group: str, strata: list[str], fraction: float, seed: int = 0) -> DataFrame:
    """Groups with their split: each stratum's groups, in order of their draw, fill "val" up to a share
    of its records. It stops once the share is reached, or where the next group would overshoot by
    more than leaving it out falls short; the first group always goes in, the last never.
    """
    groups = group_strata(df, group, strata).withColumn("__u", uniform(seed, group))
    part = Window.partitionBy(*strata)
    order = part.orderBy("__u", group)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumns({"__before": before, "__target": F.lit(fraction) * F.sum("size").over(part), "__k": F.row_number().over(order), "__n": F.count("*").over(part)})
    stop = (F.col("__k") > 1) & ((F.col("__before") >= F.col("__target")) | (F.abs(F.col("__before") + F.col("size") - F.col("__target")) > F.abs(F.col("__before") - F.col("__target"))))
    stopped = F.max(stop.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return groups.withColumn("__stopped", stopped).select(group, "size", *strata, F.when((F.col("__stopped") == 0) & (F.col("__k") < F.col("__n")), "val").otherwise("train").alias("split"))


def downsample(df: DataFrame, condition: Column, key: str, keep: float, seed: int = 0) -> DataFrame:
    """Rows for which the condition holds stay with a probability; all others stay."""
    return df.where(~F.coalesce(condition, F.lit(False)) | (uniform(seed, key) < keep))


def turns(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """Where groups go that each go to the lightest fold so far (of equals the first), largest first.

    sizes: (size, number of groups) from the largest on. For each size a list of (first, turn): from
    number `first` of its groups on (from 0), they go to the folds of `turn` one after another, again
    and again. Folds less than one group apart take turns for as long as no heavier one is reached, so
    a size has a turn for each fold at most, however many its groups.
    """
    load, out = [0] * folds, []
    for size, n in sizes:
        done, plan = 0, []
        while done < n:
            order = sorted(range(folds), key=lambda f: (load[f], f))
            turn = [f for f in order if load[f] < load[order[0]] + size]
            take = n - done
            if len(turn) < folds:
                gap = load[order[len(turn)]] - load[turn[-1]]
                take = min(take, -(-gap // size) * len(turn))
            plan.append((done, turn))
            for i, f in enumerate(turn):
                load[f] += size * (take // len(turn) + (i < take % len(turn)))
            done += take
        out.append((size, plan))
    return out


#: Sizes whose turns are broadcast.
BROADCAST_SIZES = 20_000


def group_kfold(df: DataFrame, group: str, folds: int) -> DataFrame:
    """group, size, fold: groups by size, largest first, each to the lightest fold so far.

    Groups of one size are in an arbitrary order, the same on any number of partitions; a null group
    is a group. The greedy order is worked out on the histogram of sizes alone, of which n rows have
    at most sqrt(2n); groups stay distributed, whatever their number.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    plan = turns([tuple(r) for r in sizes.groupBy("size").count().orderBy(F.desc("size")).collect()], folds)
    plan_df = df.sparkSession.createDataFrame(plan, "size long, plan array<struct<first: long, turn: array<int>>>")
    at = F.col("pos") - 1
    now = F.element_at(F.filter("plan", lambda p: p["first"] <= at), -1)
    fold = F.get(now["turn"], ((at - now["first"]) % F.size(now["turn"])).cast("int"))
    placed = positions(sizes, ["size"], [group]).join(F.broadcast(plan_df) if len(plan) <= BROADCAST_SIZES else plan_df, "size")
    return placed.select(group, "size", fold.alias("fold"))


def subsample_sources(df: DataFrame, source: str, key: str, target: int, seed: int = 0) -> DataFrame:
    """max(1, round(share * target)) rows of each source, and of all those `target` at most."""
    total = df.groupBy(source).agg(F.count("*").alias("__n"))
    all_rows = df.agg(F.count("*").alias("__all"))
    quota = total.crossJoin(F.broadcast(all_rows)).select(source, F.greatest(F.lit(1), F.bround(F.col("__n") / F.col("__all") * target, 0).cast("int")).alias("__quota"))
    rows = ranked(df.withColumn("__u", uniform(seed, key)), [source], [F.col("__u"), F.col(key)], "__rank").join(quota, source).where(F.col("__rank") <= F.col("__quota"))
    return rows.orderBy("__u", key).limit(target).drop("__u", "__rank", "__quota")


def majority(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return mode(df, by, [value])
