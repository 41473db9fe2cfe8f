"""Caps, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..determinism import sha1_bucket, uniform_sql
from ..functions import classify as C
from ..operators import sampling as S
from ..registry import query, table
from .classification import METAL_SQL, SCALE_SQL, listed, E
from .records import records, sql


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {uniform_sql(7, 'doc_id')}, doc_id) <= 20")
def q_cap_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return S.cap(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", 20, 7)


@query(f"SELECT o_orderkey FROM orders ORDER BY {uniform_sql(42, 'o_orderkey')}, o_orderkey LIMIT 100")
def q_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    return S.reservoir(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100, 42)


GROUP_SQL = f"array_to_string(list_sort(list_distinct(list_intersect({E}, {listed([*C.TM, *C.HEAVY])}))), '+')"


def buckets(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    metal = C.is_metal(F.col("elements"))
    return r.select("entry_id", "upload_id", "elements", metal.alias("metal"), F.when(metal, "metal_general").otherwise(F.coalesce("specialist_cell", F.lit("unclassified"))).alias("cell"), F.coalesce("method_family", F.lit("unknown")).alias("family"), C.scale_bucket(C.atoms(F.col("n_atoms"), F.col("n_sites_index"))).alias("scale"), F.array_join(C.metal_group(F.col("elements")), "+").alias("metals"))


BUCKET_SQL = f"""b AS (SELECT entry_id, upload_id, elements, {METAL_SQL} AS metal, CASE WHEN {METAL_SQL} THEN 'metal_general' ELSE coalesce(specialist_cell, 'unclassified') END AS cell, coalesce(method_family, 'unknown') AS family, {SCALE_SQL} AS scale, {GROUP_SQL} AS metals FROM r),
  m1 AS (SELECT * FROM b WHERE metal QUALIFY row_number() OVER (PARTITION BY cell, family, scale, metals, upload_id ORDER BY {uniform_sql(1, 'entry_id')}, entry_id) <= 4),
  m2 AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY cell, family, scale, metals ORDER BY {uniform_sql(2, 'entry_id')}, entry_id) <= 12),
  m3 AS (SELECT * FROM m2 QUALIFY row_number() OVER (PARTITION BY cell, family, scale ORDER BY {uniform_sql(3, 'entry_id')}, entry_id) <= 30),
  o1 AS (SELECT * FROM b WHERE NOT metal QUALIFY row_number() OVER (PARTITION BY cell, family, scale, upload_id ORDER BY {uniform_sql(1, 'entry_id')}, entry_id) <= 4),
  o2 AS (SELECT * FROM o1 QUALIFY row_number() OVER (PARTITION BY cell, family, scale ORDER BY {uniform_sql(3, 'entry_id')}, entry_id) <= 30),
  chosen AS (SELECT * FROM m3 UNION ALL SELECT * FROM o2)"""
BUCKET = ["cell", "family", "scale"]


def chosen(spark: SparkSession, sf: str) -> DataFrame:
    b = buckets(spark, sf)
    metal = S.sample_metal(b.where("metal"), BUCKET, "metals", "upload_id", "entry_id", 4, 12, 30, 1)
    return metal.unionByName(S.sample_organic(b.where("not metal"), BUCKET, "upload_id", "entry_id", 4, 30, 1))


@query(sql("SELECT entry_id, cell, family, scale FROM chosen").replace("WITH r AS", "WITH r AS", 1).replace(") SELECT entry_id, cell", f"), {BUCKET_SQL} SELECT entry_id, cell", 1))
def q_sample_all(spark: SparkSession, sf: str) -> DataFrame:
    """All buckets: metals capped by upload, element set and bucket, the others by upload and bucket."""
    return chosen(spark, sf).select("entry_id", *BUCKET)


@query(sql("SELECT entry_id, metals, upload_id FROM m3").replace(") SELECT entry_id, metals", f"), {BUCKET_SQL} SELECT entry_id, metals", 1))
def q_metal_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.sample_metal(buckets(spark, sf).where("metal"), BUCKET, "metals", "upload_id", "entry_id", 4, 12, 30, 1).select("entry_id", "metals", "upload_id")


@query(sql("SELECT b.cell, b.family, b.scale, count(*) AS n_input, count(c.entry_id) AS n_output, count(c.entry_id) >= 30 AS saturated, count(DISTINCT c.upload_id) AS uploads FROM b LEFT JOIN chosen c USING (entry_id) GROUP BY 1, 2, 3").replace(") SELECT b.cell", f"), {BUCKET_SQL} SELECT b.cell", 1))
def q_bucket_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Input, output, saturation and diversity of each bucket."""
    c = chosen(spark, sf).select("entry_id", F.lit(True).alias("taken"))
    rows = buckets(spark, sf).join(c, "entry_id", "left")
    return rows.groupBy(*BUCKET).agg(F.count("*").alias("n_input"), F.count("taken").alias("n_output"), (F.count("taken") >= 30).alias("saturated"), F.count_distinct(F.when(F.col("taken"), F.col("upload_id"))).alias("uploads"))


TARGETS = ["Fe", "Cu", "Zn", "Ni", "Pt"]


@query(sql(f"SELECT count(*) AS n, count(DISTINCT cell || family || scale) AS buckets, array_to_string(list_sort(list_intersect({listed(TARGETS)}, list_distinct(flatten(list(elements) FILTER (elements IS NOT NULL))))), ',') AS present, array_to_string(list_sort(list_filter({listed(TARGETS)}, lambda x: NOT list_contains(list_distinct(flatten(list(elements) FILTER (elements IS NOT NULL))), x))), ',') AS missing FROM chosen").replace(") SELECT count(*) AS n, count(D", f"), {BUCKET_SQL} SELECT count(*) AS n, count(D", 1))
def q_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Totals over buckets and which target elements are present or missing."""
    c = chosen(spark, sf)
    kinds = c.select(F.explode(F.array_intersect("elements", C.literals(TARGETS))).alias("e")).agg(F.collect_set("e").alias("have"))  # five at most
    totals = c.agg(F.count("*").alias("n"), F.count_distinct(F.concat(*BUCKET)).alias("buckets"))
    return totals.crossJoin(F.broadcast(kinds)).select("n", "buckets", F.array_join(F.array_sort("have"), ",").alias("present"), F.array_join(F.array_sort(F.array_except(C.literals(TARGETS), F.col("have"))), ",").alias("missing"))


@query("SELECT doc_id, CAST(list_reduce(list_transform(split(sha1(lang || source || doc_id), ''), lambda d: CAST(('0x' || d) AS BIGINT)), lambda a, d: (a * 16 + d) % 50) AS BIGINT) AS bucket FROM documents")
def q_sha1_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """A group id for rows that share one: 160 bits modulo 50, folded digit by digit."""
    key = F.concat("lang", "source", F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", sha1_bucket(key, 50).alias("bucket"))


STRATA_SQL = "g AS (SELECT user_id, count(*) AS size FROM events GROUP BY 1), s AS (SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1), gs AS (SELECT user_id, size, event_type FROM g JOIN s USING (user_id))"


@query(f"""WITH {STRATA_SQL} SELECT user_id, size, event_type, CASE WHEN n >= 2 AND k <= least(greatest(1, CAST(round_even(0.1 * n, 0) AS INT)), n - 1) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY {uniform_sql(42, 'user_id')}, user_id) AS k FROM gs)""")
def q_group_split(spark: SparkSession, sf: str) -> DataFrame:
    """Groups are never cut; strata by a group's most frequent label."""
    return S.split_by_group(table(spark, sf, "events"), "user_id", ["event_type"], 0.1, 42)


@query(f"""WITH {STRATA_SQL}, f AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY event_type ORDER BY u, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, 0.1 * sum(size) OVER (PARTITION BY event_type) AS target, row_number() OVER (PARTITION BY event_type ORDER BY u, user_id) AS k, count(*) OVER (PARTITION BY event_type) AS n
  FROM (SELECT *, {uniform_sql(42, 'user_id')} AS u FROM gs)), w AS (SELECT *, max(CASE WHEN k > 1 AND (before >= target OR abs(before + size - target) > abs(before - target)) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY u, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM f)
  SELECT user_id, size, event_type, CASE WHEN stopped = 0 AND k < n THEN 'val' ELSE 'train' END AS split FROM w""")
def q_split_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Validation filled up to a share of records, by running sums instead of a loop."""
    return S.split_by_fill(table(spark, sf, "events"), "user_id", ["event_type"], 0.1, 42)


@query(f"SELECT event_id FROM events WHERE NOT (event_type = 'view') OR {uniform_sql(9, 'event_id')} < 0.25")
def q_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return S.downsample(table(spark, sf, "events"), F.col("event_type") == "view", "event_id", 0.25, 9).select("event_id")


@query()
def q_group_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return S.group_kfold(table(spark, sf, "events").select("user_id"), "user_id", 5)


@query(f"""WITH q AS (SELECT lang, greatest(1, CAST(round_even(count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE) * 200, 0) AS INT)) AS quota FROM documents GROUP BY 1)
  SELECT doc_id, lang FROM (SELECT doc_id, lang, {uniform_sql(5, 'doc_id')} AS u FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY u, doc_id) <= (SELECT quota FROM q WHERE q.lang = documents.lang)) ORDER BY u, doc_id LIMIT 200""")
def q_subsample_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A sample that keeps each source's share."""
    return S.subsample_sources(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 200, 5)


@query("SELECT doc_id, CASE WHEN text IS NOT NULL AND text <> '' THEN 'smiles:' || md5(text) ELSE 'record:' || doc_id END AS group_key FROM documents")
def q_molecule_key(spark: SparkSession, sf: str) -> DataFrame:
    """A canonical key, or else a key of the record alone."""
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.concat(F.lit("smiles:"), F.md5(F.nullif("text", F.lit("")).cast("binary"))), F.concat(F.lit("record:"), F.col("doc_id").cast("string"))).alias("group_key"))
