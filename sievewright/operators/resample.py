"""Bootstrap and permutation tests by hash draws, for groups of any size.

A replicate is a number in each row, so replicates and rows spread over tasks together and partial
sums leave a task, never a group's values. A row's draws follow from its own key or position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..determinism import uniform

#: Parts that a group is numbered in; a part is sorted in one task, the group never.
PARTS = 256


def positions(df: DataFrame, by: list[str], order: list[str], name: str = "pos", parts: int = PARTS) -> DataFrame:
    """df with a number from 1 to n in each group, and the group's size as `<name>_n`.

    Rows are numbered within hashed parts of their group, and parts follow one another; so the order
    is arbitrary but the same on any number of partitions. Rows with equal `order` must be equal.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(parts))
    rows = df.withColumn("__part", part)
    sizes = rows.groupBy(*by, "__part").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__size")  # `parts` rows a group
    sizes = sizes.select(*by, "__part", before.alias("__before"), F.sum("__size").over(Window.partitionBy(*by)).alias(f"{name}_n"))
    here = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    same = reduce(lambda a, b: a & b, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "__part")))
    numbered = rows.withColumn("__here", here).alias("l").join(sizes.alias("r"), same)
    return numbered.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("__before") + F.col("__here")).alias(name), f"{name}_n")


def _replicates(n: int):
    return F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rep")


def bootstrap(df: DataFrame, by: list[str], key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """n, mean and the 2.5 and 97.5 percentiles (linear) of the means of resamples, of each group.

    Row i of replicate r draws row floor(u(r, i) n) + 1. How often a row is drawn is counted first
    (partial counts), then each row meets its counts; a replicate's mean is a sum over rows.
    """
    v = positions(df.select(*by, key, value), by, [key])
    drawn = v.select(*by, "pos", "pos_n", _replicates(replicates)).withColumn("pos", (F.floor(uniform(seed, "rep", "pos") * F.col("pos_n")) + 1).cast("long"))
    times = drawn.groupBy(*by, "pos", "rep").agg(F.count("*").alias("times"))
    means = times.join(v, [*by, "pos"]).groupBy(*by, "rep").agg((F.sum(F.col("times") * F.col(value)) / F.max("pos_n")).alias("mean"))
    whole = df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("whole"))
    bounds = means.groupBy(*by).agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))
    return whole.join(bounds, by).select(*by, "n", F.col("whole").alias("mean"), "low", "high")


def sign_flip(df: DataFrame, by: list[str], key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Two-sided p of the mean under random signs: the share of replicates at least as far from 0.
    A row's sign in a replicate is a draw of its key."""
    rows = df.select(*by, key, value, _replicates(replicates))
    flipped = F.when(uniform(seed, "rep", key) < 0.5, -F.col(value)).otherwise(F.col(value))
    null = rows.groupBy(*by, "rep").agg(F.avg(flipped).alias("null"))
    real = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("real"))
    # rounding keeps replicates that equal the observed mean on the same side in any order of adding
    far = F.round(F.abs("null"), 9) >= F.round(F.abs("real"), 9)
    return null.join(real, by).groupBy(*by).agg(F.first("n").alias("n"), F.round(F.avg(far.cast("double")), 6).alias("p"))


def permuted_gain(df: DataFrame, key: str, fixed: str, options: list[str], choice: str, replicates: int, seed: int) -> DataFrame:
    """Mean gain of choosing by `choice` (index into options) over `fixed`, and the one-sided share of
    shuffled choices that gain as much.

    A shuffle deals the choices out anew: only how many rows choose each option matters for it, so the
    rows in the order of a draw get the first option, the second and so on, as many as chose it. Where
    a draw falls among all is found by its hash part, as for positions.
    """
    rows = df.select(key, F.col(fixed).alias("f"), F.array(*options).alias("e"), F.col(choice).cast("int").alias("c"))
    counts = rows.groupBy("c").count().collect()  # one row for each option
    n = sum(r["count"] for r in counts)
    if not n:
        return df.sparkSession.createDataFrame([(0, None, None)], "n long, gain double, p double")
    ends, seen = [], 0
    for c, k in sorted((r["c"], r["count"]) for r in counts):
        seen += k
        ends.append((c, seen))
    gain = lambda c: F.col("f") - F.element_at("e", c + 1)
    drawn = rows.select("*", _replicates(replicates)).withColumn("u", uniform(seed, "rep", key))
    # parts by the draw itself, so that one part's draws are all below the next one's
    drawn = drawn.withColumn("__part", F.floor(F.col("u") * PARTS))
    sizes = drawn.groupBy("rep", "__part").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy("rep").orderBy("__part")) - F.col("__size")
    sizes = sizes.select("rep", "__part", before.alias("__before"))
    here = F.row_number().over(Window.partitionBy("rep", "__part").orderBy("u", key))
    placed = drawn.withColumn("__here", here).join(sizes, ["rep", "__part"]).withColumn("k", F.col("__before") + F.col("__here"))
    dealt = F.lit(ends[-1][0])
    for c, end in reversed(ends[:-1]):
        dealt = F.when(F.col("k") <= end, c).otherwise(dealt)
    null = placed.groupBy("rep").agg(F.avg(gain(dealt)).alias("null"))
    real = rows.agg(F.count("*").alias("n"), F.avg(gain(F.col("c"))).alias("real"))
    as_much = (F.round("null", 9) >= F.round("real", 9)).cast("double")
    return null.crossJoin(F.broadcast(real)).agg(F.first("n").alias("n"), F.round(F.first("real"), 6).alias("gain"), F.round(F.avg(as_much), 6).alias("p"))
