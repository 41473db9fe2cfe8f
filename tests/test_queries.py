"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import sievewright.queries  # noqa: F401
from sievewright.registry import ORACLE_SQL, QUERIES

from .oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    compare(spark, sf, name, QUERIES[name], ORACLE_SQL[name])


def test_nearest_heavy_to_the_last_digit(spark):
    """At sf0.01 two atoms are 0.85376949986 apart, which is 0.853769 to six digits."""
    name, folder = "q_nearest_heavy", "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = QUERIES[name](spark, folder).select("geom_id", "idx", "other", "d").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT geom_id, idx, other, d FROM ({ORACLE_SQL[name]})").fetchall())


def test_group_kfold_is_balanced_and_whole(spark, sf):
    rows = QUERIES["q_group_kfold"](spark, sf).collect()
    events = {r.user_id: r["count"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().collect()}
    assert {r.user_id: r.size for r in rows} == events
    load = [sum(r.size for r in rows if r.fold == f) for f in range(5)]
    assert max(load) - min(load) <= max(events.values())
