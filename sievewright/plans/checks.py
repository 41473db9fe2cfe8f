"""Checks of plans as set operations on a table of nodes (plan, pos, id, kind, tool, input_id, output_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def structure(nodes: DataFrame, tools: DataFrame) -> DataFrame:
    """plan and its checks: nodes have ids and kinds, tools are known, inputs are produced somewhere.

    tools: a table of few names (tool).
    """
    known = tools.select("tool", F.lit(True).alias("__known"))
    made = nodes.where("output_id <> ''").select("plan", F.col("output_id").alias("input_id"), F.lit(True).alias("__made")).distinct()
    rows = nodes.join(F.broadcast(known), "tool", "left").join(made, ["plan", "input_id"], "left")
    is_tool = F.col("kind") == "tool"
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return rows.groupBy("plan").agg(F.count("*").alias("n_nodes"), F.bool_and(filled("id")).alias("nodes_have_id"), F.bool_and(filled("kind")).alias("nodes_have_kind"), F.bool_and(~is_tool | F.col("__known").isNotNull()).alias("tools_valid"), F.bool_and(~is_tool | ~filled("input_id") | F.col("__made").isNotNull()).alias("dep_graph_valid"), (F.count_distinct("id") == F.count("id")).alias("ids_unique"))


def arguments(used: DataFrame, schema: DataFrame) -> DataFrame:
    """(plan, tool, arg, problem): arguments a tool doesn't have, and required ones that are missing.

    used: plan, tool, arg; schema: tool, arg, required.
    """
    unknown = used.join(schema.select("tool", "arg"), ["tool", "arg"], "left_anti").select("plan", "tool", "arg", F.lit("unknown").alias("problem"))
    calls = used.select("plan", "tool").distinct()
    missing = calls.join(schema.where("required"), "tool").join(used.select("plan", "tool", "arg"), ["plan", "tool", "arg"], "left_anti").select("plan", "tool", "arg", F.lit("missing").alias("problem"))
    return unknown.unionByName(missing)


def comes_after(rows: DataFrame, by: list[str], name: str, pos: str, first: str, then: str) -> DataFrame:
    """Whether the first `then` of a group comes after its first `first`; false if either is missing."""
    at = lambda v: F.min(F.when(F.col(name) == v, F.col(pos)))
    return rows.groupBy(*by).agg(F.coalesce(at(then) > at(first), F.lit(False)).alias("in_order"))


def all_covered(needed: DataFrame, given: DataFrame, by: list[str], key: str) -> DataFrame:
    """by and whether every needed key is among the given ones, with how many are not."""
    lost = needed.join(given.select(*by, key, F.lit(True).alias("__has")).distinct(), [*by, key], "left")
    return lost.groupBy(*by).agg(F.bool_and(F.col("__has").isNotNull()).alias("covered"), F.count_if(F.col("__has").isNull()).alias("n_missing"))
