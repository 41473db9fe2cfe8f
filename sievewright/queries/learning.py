"""Models that SQL can't express; tests hold them against brute force or known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as V
from ..operators import learning as L
from ..operators import models as M
from ..operators import retrieval as R
from ..registry import query, table
from .records import records


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """All orders, summed by nation and priority (125 reactions at any size), with four features and the
    better of two policies as label."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal"), "o_custkey")
    a, b = F.abs(F.col("o_totalprice") - 150000), F.abs(F.col("o_totalprice") - 110000)
    rows = o.groupBy("c_nationkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("p"), F.stddev_pop("o_totalprice").alias("s"), F.avg("c_acctbal").alias("bal"), F.count("*").alias("n"), (F.avg(a) < F.avg(b)).cast("int").alias("y"))
    rid = F.col("c_nationkey") * 10 + F.substring("o_orderpriority", 1, 1).cast("long")
    return rows.select(rid.alias("rid"), F.array(F.round(F.col("p") / 1e5, 9), F.round(F.col("s") / 1e5, 9), F.round(F.col("bal") / 1e3, 9), F.log("n")).alias("x"), "y")


@query()
def q_loocv(spark: SparkSession, sf: str) -> DataFrame:
    """Each row predicted by a linear model of all others."""
    return L.loocv(labelled(spark, sf), "rid", "x", "y")


@query()
def q_loocv_svm(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and balanced accuracy of a linear SVM, left out one by one."""
    return L.accuracy(L.loocv(labelled(spark, sf), "rid", "x", "y", "svm"))


@query()
def q_permutation_test(spark: SparkSession, sf: str) -> DataFrame:
    """Whether labels can be told from features, against shuffled labels."""
    return L.permutation_test(labelled(spark, sf), "rid", "x", "y", 50, 5, 3)


@query()
def q_freeze_router(spark: SparkSession, sf: str) -> DataFrame:
    """A router fitted once, frozen with its digest, checked and applied to the same rows."""
    rows = labelled(spark, sf)
    model = M.checked(L.freeze(rows, "rid", "x", "y"))
    return rows.select("rid", "y", M.apply_frozen(F.col("x"), model).alias("choice"), F.lit(model["sha256"]).alias("digest"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", F.unix_date(F.col("l_shipdate").cast("date")).cast("double").alias("day"), (F.col("l_orderkey") % 5).alias("fold"))
    return p


@query()
def q_rf_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    """A forest for each cell, scored on the rows of the groups held out."""
    p = parts(spark, sf)
    return L.forest_by_cell(p.where("fold <> 0"), p.where("fold = 0"), "l_linestatus", ["l_quantity", "l_extendedprice", "l_discount", "day"], "l_returnflag", ["F", "O"])


@query()
def q_kmeans_anchor(spark: SparkSession, sf: str) -> DataFrame:
    p = parts(spark, sf).withColumn("label", (F.col("l_linestatus") == "O").cast("int"))
    return L.kmeans_agreement(p, ["day"], "label")


_D = "list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))))"


@query(f"""WITH f AS (SELECT *, vec_id % 5 AS fold FROM embeddings), seen AS (SELECT k.fold, label FROM f, (SELECT DISTINCT fold FROM f) k WHERE f.fold <> k.fold GROUP BY 1, 2),
  n AS (SELECT a.vec_id, a.fold, a.label, arg_min(b.label, struct_pack(d := round({_D}, 9), v := b.vec_id)) AS p FROM f a JOIN f b ON a.fold <> b.fold GROUP BY 1, 2, 3)
  SELECT n.fold, count(*) AS n, round(100 * avg(CASE WHEN n.label = n.p THEN 1.0 ELSE 0 END), 6) AS nn_pct, round(100 * avg(CASE WHEN seen.label IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS coverage_pct,
    round(100 * avg(CASE WHEN n.label = n.p THEN 1.0 ELSE 0 END) FILTER (seen.label IS NOT NULL), 6) AS given_seen_pct FROM n LEFT JOIN seen ON seen.fold = n.fold AND seen.label = n.label GROUP BY 1""")
def q_evaluate_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector by its nearest neighbour in the other folds, the share of its fold's labels that the
    others have, and how often it is right on these."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", (F.col("vec_id") % 5).alias("fold"), F.col("embedding").cast("array<double>").alias("v"))
    near = R.nearest(e.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "fold"), e.select(F.col("vec_id").alias("point_id"), F.col("v").alias("p"), "fold"), 1, group="fold")
    own = e.groupBy("fold", "label").agg(F.count("*").alias("own"))
    seen = own.join(e.groupBy("label").agg(F.count("*").alias("all")), "label").select("fold", "label", (F.col("all") > F.col("own")).alias("seen"))
    rows = e.select(F.col("vec_id").alias("query_id"), "fold", "label").join(near, "query_id").join(e.select(F.col("vec_id").alias("point_id"), F.col("label").alias("p")), "point_id").join(seen, ["fold", "label"])
    ok = (F.col("label") == F.col("p")).cast("double")
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.round(100 * F.avg(ok), 6).alias("nn_pct"), F.round(100 * F.avg(F.col("seen").cast("double")), 6).alias("coverage_pct"), F.round(100 * F.avg(F.when(F.col("seen"), ok)), 6).alias("given_seen_pct"))


def featured(spark: SparkSession, sf: str, scale: bool = True) -> DataFrame:
    """Records with their features and a label, a fifth of the uploads held out."""
    r = records(spark, sf).withColumn("fold", F.coalesce(F.pmod(F.xxhash64("upload_id"), F.lit(5)), F.lit(0)))
    v = V.fit(r.where("fold <> 0"))
    return V.transform(r.withColumn("label", F.coalesce("method_family", F.lit("none"))), v, ["entry_id", "fold", "label"], scale)


@query()
def q_rf_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The forest of a small grid that is best on held-out records."""
    rows = featured(spark, sf, False)
    grid = {f"{n} trees, depth {d}": (lambda n=n, d=d: L.forest(n, d)) for n in (10, 20) for d in (5, 10)}
    name, told = L.best_of_grid(rows.where("fold <> 0"), rows.where("fold = 0"), "features", "label", grid)
    return told.agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.round(100 * F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("pct"))


@query()
def q_hgb(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees, one against the rest, on held-out records."""
    rows = featured(spark, sf)
    name, told = L.best_of_grid(rows.where("fold <> 0"), rows.where("fold = 0"), "features", "label", {"depth 3": lambda: L.boosted(5, 3)})
    return told.groupBy("label").agg(F.count("*").alias("n"), F.round(100 * F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("pct"))


@query()
def q_forest_cv(spark: SparkSession, sf: str) -> DataFrame:
    """A forest of the other folds on each fold of grouped records."""
    return L.evaluate_folds(featured(spark, sf), "fold", 3, "features", "label", lambda: L.forest(10, 8))
