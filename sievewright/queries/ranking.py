"""Retrieval: full-text ranking, set similarity, tiers, neighbours and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import retrieval as R
from ..registry import query, table
from .classification import SCALE_SQL, E
from .records import records, sql


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", R.text_tokens(F.col("text")).alias("tokens"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), R.text_tokens(F.col("text")).alias("tokens"))


TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}]+'), lambda w: w <> '')"
BM25 = f"""d AS (SELECT doc_id, lang, source, {TOKENS} AS tokens FROM documents), p AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d),
  tf AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM p GROUP BY 1, 2), df AS (SELECT term, ln((SELECT count(*) FROM d) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY 1),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
  q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
  scored AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(tokens)) FROM d)))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)"""


@query(f"WITH {BM25} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5 AND score >= 0.5")
def q_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: the 5 best documents for each benchmark item, then the score floor."""
    hits = R.bm25_top(corpus(spark, sf), asked(spark, sf), 5).where(F.col("score") >= R.MIN_SCORE)
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {BM25}, ok AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE score >= 3) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ok WHERE rank <= 20")
def q_bm25_pool_floor(spark: SparkSession, sf: str) -> DataFrame:
    """The floor first, then the first max(20, k); as both go by the score, the order of the two is the same."""
    hits = R.bm25_top(corpus(spark, sf), asked(spark, sf), R.POOL).where(F.col("score") >= 3.0)
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT term, round(idf, 6) AS idf, n, total FROM idf JOIN (SELECT term, count(*) AS n, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY 1) USING (term)")
def q_build_index(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the index with their weight, documents and occurrences."""
    postings, terms = R.build_index(corpus(spark, sf), "tokens")
    return terms.join(postings.groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("total")), "term").select("term", F.round("idf", 6).alias("idf"), "n", "total")


@query("""WITH q AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'it' ELSE 'es' END AS lang, 'src' || (item_id % 20) AS source FROM benchmark),
  c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), few AS (SELECT q.*, coalesce(c.n, 0) < 120 AS few FROM q LEFT JOIN c USING (lang))
  SELECT query_id, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT query_id, doc_id FROM few JOIN documents USING (lang) UNION SELECT query_id, doc_id FROM few JOIN documents USING (source) WHERE few) GROUP BY 1""")
def q_cell_widen(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates in a query's cell; a cell that is too small is joined by the wider group."""
    i = F.col("item_id")
    q = table(spark, sf, "benchmark").select(i.alias("query_id"), F.when(i % 4 == 0, "en").when(i % 4 == 1, "fr").when(i % 4 == 2, "it").otherwise("es").alias("lang"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("source"))
    pairs = R.widened(q, table(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", "source", 120)
    return pairs.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


SETS = f"a AS (SELECT item_id AS query_id, list_distinct({TOKENS}) AS s FROM benchmark), b AS (SELECT doc_id, list_distinct({TOKENS}) AS s FROM documents), x AS (SELECT query_id, len(s) AS nl, unnest(s) AS m FROM a), y AS (SELECT doc_id, len(s) AS nr, unnest(s) AS m FROM b), pairs AS (SELECT query_id, doc_id, count(*) / (any_value(nl) + any_value(nr) - count(*)) AS similarity FROM x JOIN y USING (m) GROUP BY 1, 2)"


def similar(spark: SparkSession, sf: str, floor: float) -> DataFrame:
    return R.similar_sets(asked(spark, sf).withColumnRenamed("tokens", "members"), corpus(spark, sf).select("doc_id", F.col("tokens").alias("members")), floor)


@query(f"WITH {SETS} SELECT query_id, doc_id, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.17")
def q_tanimoto_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similar(spark, sf, 0.17).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {BM25}, {SETS}, pool AS (SELECT query_id, doc_id, rank, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.doc_id) THEN coalesce(similarity, 0) END AS similarity FROM (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 20 AND score >= 0.5) r LEFT JOIN pairs USING (query_id, doc_id)),
  t AS (SELECT *, CASE WHEN similarity IS NULL THEN 2 WHEN similarity >= 0.17 THEN 1 ELSE 3 END AS tier FROM pool)
  SELECT query_id, doc_id, CAST(tier AS BIGINT) AS tier, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 1 THEN -round(similarity, 9) END NULLS FIRST, rank) AS place FROM t) WHERE place <= 5""")
def q_tiered_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Similar ones first, then those without a structure (here: unlabelled), then the unlike ones.

    Only the ranked pool goes to the similarity.
    """
    pool = R.bm25_top(corpus(spark, sf), asked(spark, sf), R.POOL).where(F.col("score") >= R.MIN_SCORE).select("query_id", "doc_id", "rank")
    known = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("known"))
    sets = corpus(spark, sf).select("doc_id", F.array_distinct("tokens").alias("s"))
    wanted = asked(spark, sf).select("query_id", F.array_distinct("tokens").alias("q"))
    rows = pool.join(wanted, "query_id").join(sets, "doc_id").join(known, "doc_id", "left").withColumn("similarity", R.tanimoto("q", "s")).drop("q", "s")
    rows = rows.withColumn("similarity", F.when(F.col("known"), F.coalesce("similarity", F.lit(0.0))))
    return R.tiers(rows).where("place <= 5").select("query_id", "doc_id", F.col("tier").cast("long").alias("tier"), F.col("place").cast("long").alias("place"))


DIST = "list_sum(list_transform(list_zip(q, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
KNN = f"n AS (SELECT query_id, point_id, label, true_label, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), point_id) AS rank, distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS point_id, b.label, a.label AS true_label, list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id))"


def neighbours(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Every vector whose id 20 divides asks all vectors but itself."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return R.nearest(q, e.select(F.col("vec_id").alias("point_id"), F.col("v").alias("p")), k)


@query(f"WITH {KNN} SELECT query_id, point_id, rank, round(distance, 6) AS distance FROM n WHERE rank <= 5")
def q_knn(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours(spark, sf, 5).select("query_id", "point_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(f"""WITH {KNN}, h AS (SELECT query_id, any_value(true_label) AS t, max(label) FILTER (rank = 1) AS top1, bool_or(label = true_label) AS any5 FROM n WHERE rank <= 5 GROUP BY 1),
  m AS (SELECT query_id, label AS majority FROM (SELECT query_id, label, count(*) AS c FROM n WHERE rank <= 5 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, label) = 1),
  b AS (SELECT label AS blind FROM (SELECT label, count(*) AS c FROM embeddings GROUP BY 1) ORDER BY c DESC, label LIMIT 1)
  SELECT count(*) AS n, round(100 * avg(CASE WHEN top1 = t THEN 1.0 ELSE 0 END), 6) AS top1_pct, round(100 * avg(CASE WHEN any5 THEN 1.0 ELSE 0 END), 6) AS any5_pct, round(100 * avg(CASE WHEN majority = t THEN 1.0 ELSE 0 END), 6) AS majority_pct, round(100 * avg(CASE WHEN blind = t THEN 1.0 ELSE 0 END), 6) AS blind_pct FROM h JOIN m USING (query_id), b""")
def q_retrieval_eval(spark: SparkSession, sf: str) -> DataFrame:
    """First, any and most frequent of the retrieved against the truth, and the blind majority."""
    from ..determinism import mode

    e = table(spark, sf, "embeddings").select("vec_id", "label")
    hits = neighbours(spark, sf, 5).join(e.select(F.col("vec_id").alias("point_id"), "label"), "point_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("t")), "query_id")
    best = hits.groupBy("query_id").agg(F.first("t").alias("t"), F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("top1"), F.bool_or(F.col("label").eqNullSafe(F.col("t"))).alias("any5"))
    rows = best.join(mode(hits, ["query_id"], ["label"]).select("query_id", F.col("label").alias("majority")), "query_id")
    blind = mode(e.withColumn("all", F.lit(1)), ["all"], ["label"]).select(F.col("label").alias("blind"))
    t = F.col("t")
    same = {"top1_pct": F.col("top1").eqNullSafe(t), "any5_pct": F.col("any5"), "majority_pct": F.col("majority").eqNullSafe(t), "blind_pct": F.col("blind").eqNullSafe(t)}
    return rows.crossJoin(F.broadcast(blind)).agg(F.count("*").alias("n"), *(F.round(A.percent(c), 6).alias(k) for k, c in same.items()))


FORMULA = f"coalesce(array_to_string(list_sort(list_distinct({E})), ''), '')"


@query(sql(f"""SELECT scale, '# Retrieved examples (similar systems)' || chr(10) || chr(10) || string_agg('## Example ' || k || chr(10) || 'System: ' || formula || ', charge ' || charge || ', ' || task_type || chr(10) || 'Method chosen: ' || coalesce(functional, method_family) || '/' || coalesce(basis, 'None') || CASE WHEN extras <> '' THEN ', ' || extras ELSE '' END, chr(10) || chr(10) ORDER BY k) AS block
  FROM (SELECT *, row_number() OVER (PARTITION BY scale ORDER BY entry_id) AS k FROM (SELECT entry_id, charge, task_type, nullif(functional, '') AS functional, method_family, basis, {FORMULA} AS formula, concat_ws(', ', ri_approx, dispersion, nullif(solvent, '')) AS extras, {SCALE_SQL} AS scale FROM r)) WHERE k <= 3 GROUP BY 1"""))
def q_format_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieved records as a block of text."""
    from ..functions import classify as C

    r = records(spark, sf).withColumn("scale", C.scale_bucket(C.atoms(F.col("n_atoms"), F.col("n_sites_index")))).withColumn("k", F.row_number().over(Window.partitionBy("scale").orderBy("entry_id"))).where("k <= 3")
    formula = F.array_join(F.array_sort(F.array_distinct(C.elements_or_none(F.col("elements")))), "")
    extras = F.concat_ws(", ", "ri_approx", "dispersion", F.nullif("solvent", F.lit("")))
    text = F.concat(F.lit("## Example "), F.col("k").cast("string"), F.lit("\nSystem: "), formula, F.lit(", charge "), F.col("charge").cast("string"), F.lit(", "), F.col("task_type"), F.lit("\nMethod chosen: "), F.coalesce(F.nullif("functional", F.lit("")), F.col("method_family")), F.lit("/"), F.coalesce("basis", F.lit("None")), F.when(extras != "", F.concat(F.lit(", "), extras)).otherwise(F.lit("")))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"])
    return r.groupBy("scale").agg(F.concat(F.lit("# Retrieved examples (similar systems)\n\n"), F.array_join(blocks, "\n\n")).alias("block"))
