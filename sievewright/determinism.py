"""Draws, modes and roundings that any engine can repeat.

There is no random generator anywhere: a draw is a hash of a seed and an id, so samples are the same
on any number of partitions and can be written in SQL. Distributions and invariants of sampled
results hold; drawn rows follow from the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *cols: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5("seed|id|...")."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed: int, *cols: str) -> str:
    """The same number in DuckDB."""
    parts = " || '|' || ".join([f"'{seed}'", *(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)])
    return f"(CAST(('0x' || substr(md5({parts}), 1, 8)) AS BIGINT) / 4294967296.0)"


def mode(df: DataFrame, by: list[str], values: list[str], skip_null: bool = True) -> DataFrame:
    """Most frequent combination of values in each group, of ties the least. One row a group."""
    rows = df
    if skip_null:
        for v in values:
            rows = rows.where(F.col(v).isNotNull())
    counted = rows.groupBy(*by, *values).agg(F.count("*").alias("__n"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("__n")).alias("neg"), *values)).alias("__b"))
    return best.select(*by, *(F.col(f"__b.{v}").alias(v) for v in values), (-F.col("__b.neg")).alias("n"))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Position in each group. `rank <= k` on it is pruned before the shuffle (window group limit)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def sha1_bucket(col: Column, n: int) -> Column:
    """The 160-bit SHA-1 of a text modulo n: hex digits folded from the left, as n * 16 stays small."""
    digits = F.split(F.sha1(F.coalesce(col, F.lit("")).cast("binary")), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: F.when(d == "", acc).otherwise((acc * 16 + F.conv(d, 16, 10).cast("long")) % n))
