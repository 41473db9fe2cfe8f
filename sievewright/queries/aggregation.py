"""Aggregations, statistics, joins and set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..determinism import mode
from ..functions import classify as C
from ..operators import aggregates as A
from ..operators import joins as J
from ..registry import query, table
from .classification import METAL_SQL, E
from .records import records, sql


@query("""SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""")
def q_blind_majority(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent class of each group."""
    return mode(table(spark, sf, "events"), ["user_id"], ["event_type"])


@query(sql("""SELECT specialist_cell, functional, basis, n FROM (SELECT specialist_cell, functional, basis, count(*) AS n FROM r WHERE functional IS NOT NULL AND basis IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY specialist_cell ORDER BY n DESC, functional, basis) = 1"""))
def q_majority_pair(spark: SparkSession, sf: str) -> DataFrame:
    return mode(records(spark, sf), ["specialist_cell"], ["functional", "basis"])


@query(sql("SELECT specialist_cell, string_agg(p, ',' ORDER BY p) AS vocabulary, count(*) AS n FROM (SELECT DISTINCT specialist_cell, functional || '/' || basis AS p FROM r WHERE functional || basis IS NOT NULL AND NOT contains(basis, '=')) GROUP BY 1"))
def q_vocab_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct pairs of each cell, in order; artifacts with an equals sign are left out."""
    r = records(spark, sf).where("functional is not null and basis is not null and not contains(basis, '=')")
    pairs = r.select("specialist_cell", F.concat("functional", F.lit("/"), "basis").alias("p"))
    return pairs.groupBy("specialist_cell").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("vocabulary"), F.count_distinct("p").alias("n"))


@query("""SELECT o_orderpriority, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_distinct, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy_bits, round(sum(n) * sum(n) / sum(n * n), 6) AS effective_number
  FROM (SELECT o_orderpriority, o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def q_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy and effective number of classes, by group."""
    return A.concentration(table(spark, sf, "orders"), ["o_orderpriority"], "o_custkey")


@query("""SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS n_distinct, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy_bits, round(sum(n) * sum(n) / sum(n * n), 6) AS effective_number
  FROM (SELECT event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1)""")
def q_inverse_simpson(spark: SparkSession, sf: str) -> DataFrame:
    return A.concentration(table(spark, sf, "events"), [], "event_type")


FIELDS = ["functional", "basis", "solvent", "dispersion", "ri_approx", "aux_basis"]


@query(sql(f"""SELECT field, CAST(sum(n) AS BIGINT) AS recorded, round(max(n) / sum(n), 6) AS modal_share, round(sum(n) * sum(n) / sum(n * n), 6) AS effective_number, arg_min(value, struct_pack(k := -n, v := value)) AS top_value
  FROM (SELECT field, value, CAST(count(*) AS DOUBLE) AS n FROM ({" UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value FROM r" for f in FIELDS)}) WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""))
def q_field_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.field_stats(records(spark, sf), FIELDS)


@query(sql(" UNION ALL ".join(f"SELECT '{f}' AS field, round(avg(CASE WHEN {c} THEN 1 ELSE 0 END), 6) AS share FROM r" for f, c in {**{f: f"coalesce({f}, '') NOT IN ('', '0')" for f in FIELDS}, "n_atoms": "coalesce(n_atoms, 0) <> 0", "elements": "len(coalesce(elements, [])) > 0"}.items())))
def q_field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return A.coverage(records(spark, sf), {**dict.fromkeys(FIELDS, "string"), "n_atoms": "string", "elements": "array"})


@query("""SELECT key, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM events WHERE json_valid(props)), 6) AS share FROM (SELECT unnest(json_keys(props)) AS key FROM events WHERE json_valid(props)) GROUP BY 1""")
def q_emit_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Share of JSON objects that contain each key; texts that are not JSON are dropped."""
    rows = table(spark, sf, "events").select(F.json_object_keys("props").alias("k")).where("k is not null")
    total = rows.agg(F.count("*").alias("total"))
    return rows.select(F.explode("k").alias("key")).groupBy("key").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("key", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(sql(f"""SELECT e AS element, count(*) AS n FROM (SELECT unnest(list_distinct({E})) AS e FROM r) GROUP BY 1"""))
def q_element_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Records that contain each element, once a record."""
    return records(spark, sf).select(F.explode(F.array_distinct(C.elements_or_none(F.col("elements")))).alias("element")).groupBy("element").agg(F.count("*").alias("n"))


@query(sql(f"""SELECT count(*) AS n, count(*) FILTER (specialist_cell = 'metal_general') AS in_cell, count(*) FILTER (coalesce(functional, '') = '') AS blank, count(*) FILTER (upper(functional) = 'LDA') AS dropped, count(*) FILTER ({METAL_SQL}) AS metal FROM r"""))
def q_filter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("specialist_cell") == "metal_general").alias("in_cell"), F.count_if(F.coalesce("functional", F.lit("")) == "").alias("blank"), F.count_if(F.upper("functional") == "LDA").alias("dropped"), F.count_if(C.is_metal(F.col("elements"))).alias("metal"))


@query("""SELECT l_returnflag, count(*) AS n, round(100 * avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END), 6) AS pct_f, round(100 * avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END), 6) AS pct_high,
  round(100 * avg(CASE WHEN l_linestatus = 'F' AND l_discount > 0.05 THEN 1.0 ELSE 0 END), 6) AS pct_both FROM lineitem GROUP BY 1 ORDER BY n DESC""")
def q_breakdown_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """Match rates by true class."""
    f, d = F.col("l_linestatus") == "F", F.col("l_discount") > 0.05
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(A.percent(f), 6).alias("pct_f"), F.round(A.percent(d), 6).alias("pct_high"), F.round(A.percent(f & d), 6).alias("pct_both"))


@query("""WITH s AS (SELECT CASE WHEN l_linenumber = 1 THEN 'class' ELSE 'rest' END AS slice, l_returnflag AS p FROM lineitem), c AS (SELECT slice, p, count(*) AS k FROM s GROUP BY 1, 2)
  SELECT slice, CAST(sum(k) AS BIGINT) AS n, round(100.0 * sum(k) FILTER (p = 'R') / sum(k), 6) AS pct, string_agg(p || ':' || k, ',' ORDER BY k DESC, p) AS predicted FROM c GROUP BY 1""")
def q_class_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    """One class against all others: how often it is right, and what is predicted instead."""
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 1, "class").otherwise("rest").alias("slice"), "l_returnflag")
    return A.slices(rows, "slice", "l_returnflag", F.col("l_returnflag") == "R")


@query("SELECT lang, quality, toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def q_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT coalesce(o_orderstatus, '-') AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (coalesce(o_orderstatus, '-'), o_orderpriority)")
def q_rollup_tab(spark: SparkSession, sf: str) -> DataFrame:
    """Table with totals by group and a grand total."""
    return table(spark, sf, "orders").withColumn("status", F.coalesce("o_orderstatus", F.lit("-"))).rollup("status", F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT user_id % 3 AS arm, user_id % 2 = 0 AS skills, count(*) AS runs, count(*) FILTER (event_id % 4 <> 0) AS passed, count(*) FILTER (event_id % 7 <> 0) AS chem_passed, round(100.0 * count(*) FILTER (event_id % 4 <> 0) / count(*), 6) AS pass_pct,
  round(100.0 * count(*) FILTER (event_id % 7 <> 0) / count(*), 6) AS chem_pct, round(avg(nullif(value, 0)), 6) AS mean_tokens FROM events GROUP BY 1, 2""")
def q_ablation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Of each arm with and without skills: runs, passes of both kinds, mean tokens of those that used any."""
    e = table(spark, sf, "events").select((F.col("user_id") % 3).alias("arm"), (F.col("user_id") % 2 == 0).alias("skills"), (F.col("event_id") % 4 != 0).alias("ok"), (F.col("event_id") % 7 != 0).alias("chem"), "value")
    return A.ablation(e, ["arm", "skills"], "ok", "chem", "value")


@query("""SELECT user_id, coalesce(max(n) FILTER (event_type = 'click'), 0) AS click, coalesce(max(n) FILTER (event_type = 'purchase'), 0) AS purchase, coalesce(max(n) FILTER (event_type = 'view'), 0) AS view FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def q_pivot_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Features as columns, a missing one is 0."""
    kinds = ["click", "purchase", "view"]
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).count().na.fill(0, kinds)


@query("""SELECT k AS key, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events) GROUP BY 1""")
def q_token_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Values of maps added up by key."""
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, sf, "events").select(F.explode(m).alias("key", "v")).groupBy("key").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


@query("""SELECT 'has_text' AS check_name, count(*) FILTER (n_chars > 0) AS passed, count(*) AS runs, round(avg(CASE WHEN n_chars > 0 THEN 1.0 ELSE 0 END), 6) AS rate FROM documents
  UNION ALL SELECT 'is_long', count(*) FILTER (n_chars > 1000), count(*), round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0 END), 6) FROM documents UNION ALL SELECT 'is_en', count(*) FILTER (lang = 'en'), count(*), round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END), 6) FROM documents""")
def q_pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Checks by name over runs."""
    checks = F.create_map(F.lit("has_text"), F.col("n_chars") > 0, F.lit("is_long"), F.col("n_chars") > 1000, F.lit("is_en"), F.col("lang") == "en")
    return table(spark, sf, "documents").select(F.explode(checks).alias("check_name", "ok")).groupBy("check_name").agg(F.count_if("ok").alias("passed"), F.count("*").alias("runs"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("rate"))


_split = "SELECT CASE WHEN user_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, event_type FROM events"


@query(f"""WITH c AS (SELECT split, event_type, count(*) AS n FROM ({_split}) GROUP BY 1, 2),
  t AS (SELECT split, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS top FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY split ORDER BY n DESC, event_type) <= 3) GROUP BY 1)
  SELECT split, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_distinct, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy_bits, any_value(top) AS top FROM c JOIN t USING (split) GROUP BY 1""")
def q_label_report(spark: SparkSession, sf: str) -> DataFrame:
    """Of each split: records, distinct labels, their entropy and the three most frequent."""
    e = table(spark, sf, "events").withColumn("split", F.when(F.col("user_id") % 5 == 0, "val").otherwise("train"))
    return A.label_report(e, ["split"], "event_type", 3)


@query(sql("SELECT basis, functional, n, aux FROM (SELECT functional, basis, aux_basis AS aux, count(*) AS n FROM r WHERE functional <> '' AND basis <> '' AND aux_basis <> '' GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY functional, basis ORDER BY n DESC, aux) = 1"))
def q_aux_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent auxiliary basis of each pair."""
    whole = records(spark, sf).where("functional <> '' and basis <> '' and aux_basis <> ''")
    return mode(whole, ["functional", "basis"], ["aux_basis"]).withColumnRenamed("aux_basis", "aux").select("basis", "functional", "n", "aux")


@query(sql("SELECT specialist_cell, functional, basis, count(*) AS n FROM r WHERE functional <> '' AND basis <> '' GROUP BY 1, 2, 3"))
def q_pair_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).where("functional <> '' and basis <> ''").groupBy("specialist_cell", "functional", "basis").agg(F.count("*").alias("n"))


# joins ----------------------------------------------------------------------------------------------


@query("SELECT l.doc_id, l.quality, d.lang, d.source FROM labels l JOIN documents d USING (doc_id)")
def q_join_by_id_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Inner join that first makes sure that every key on the left has a match."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return J.strict(table(spark, sf, "labels"), docs, ["doc_id"]).select("doc_id", "quality", "lang", "source")


@query("SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'good' ELSE 'poor' END, d.lang) AS lang FROM documents d JOIN labels l USING (doc_id)")
def q_join_by_id_override(spark: SparkSession, sf: str) -> DataFrame:
    """A column of the right side replaced by the left's."""
    left = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("lang"))
    return J.override(left, table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], ["lang"])


@query("""SELECT v.doc_id, CASE WHEN v.text IS NULL OR v.text = '' THEN 'no_key' WHEN EXISTS (SELECT 1 FROM documents t WHERE t.doc_id % 5 <> 0 AND t.text = v.text) THEN 'seen' ELSE 'unseen' END AS status FROM documents v WHERE v.doc_id % 5 = 0""")
def q_semi_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a validation row's key occurs in training; keys are hashed for the shuffle."""
    d = table(spark, sf, "documents")
    key = F.sha2(F.nullif("text", F.lit("")).cast("binary"), 256)
    return J.seen(d.where("doc_id % 5 = 0").select("doc_id", key.alias("key")), d.where("doc_id % 5 <> 0").select(key.alias("key")), "key").select("doc_id", "status")


@query("SELECT count(DISTINCT text) AS leaked FROM documents WHERE doc_id % 5 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 5 <> 0)")
def q_leak_check(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    return d.where("doc_id % 5 = 0").join(d.where("doc_id % 5 <> 0"), "key", "left_semi").agg(F.count_distinct("key").alias("leaked"))


ENERGY = "CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_retailprice END"


@query(f"""SELECT o_orderkey, CASE WHEN bool_and(e IS NOT NULL) THEN round(sum(c * e), 4) END AS value, count(*) AS terms FROM (SELECT l_orderkey AS o_orderkey, l_quantity AS c, e FROM lineitem LEFT JOIN (SELECT p_partkey, {ENERGY} AS e FROM part) ON p_partkey = l_partkey) GROUP BY 1""")
def q_join_species(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of coefficient times energy; a reaction with a missing one has none."""
    terms = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_quantity").alias("c"))
    energies = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr(ENERGY).alias("e"))
    return J.weighted_sums(terms, energies, "l_partkey", ["o_orderkey"], "c", "e")


@query(f"""SELECT o_orderpriority, count(err) AS n, round(avg(abs(err)), 6) AS mae, round(sqrt(avg(err * err)), 6) AS rmse FROM (SELECT o_orderpriority, v / 20 - o_totalprice AS err FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN bool_and(e IS NOT NULL) THEN round(sum(l_quantity * e), 4) END AS v
  FROM lineitem LEFT JOIN (SELECT p_partkey, {ENERGY} AS e FROM part) ON p_partkey = l_partkey GROUP BY 1) ON l_orderkey = o_orderkey) GROUP BY 1""")
def q_reaction_energy(spark: SparkSession, sf: str) -> DataFrame:
    """MAE and RMSE of summed energies against the reference, by condition."""
    values = q_join_species(spark, sf).select("o_orderkey", (F.col("value") / 20).alias("v"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").join(values, "o_orderkey", "left")
    return rows.groupBy("o_orderpriority").agg(*A.errors("v", "o_totalprice"))


@query(f"""SELECT p.p_partkey, coalesce(a.e, b.e) AS energy, CASE WHEN a.e IS NOT NULL THEN 'own' WHEN b.e IS NOT NULL THEN 'substitute' ELSE 'missing' END AS status FROM part p LEFT JOIN (SELECT p_partkey, {ENERGY} AS e FROM part WHERE p_size < 30) a USING (p_partkey)
  LEFT JOIN (SELECT p_brand, min(p_retailprice) AS e FROM part WHERE p_size > 45 GROUP BY 1) b USING (p_brand)""")
def q_join_meta_energy(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest with energies, else with a substitute, else missing."""
    p = table(spark, sf, "part")
    own = p.where("p_size < 30").select("p_partkey", F.expr(ENERGY).alias("own"))
    other = p.where("p_size > 45").groupBy("p_brand").agg(F.min("p_retailprice").alias("other"))
    rows = p.select("p_partkey", "p_brand").join(own, "p_partkey", "left").join(other, "p_brand", "left")
    return rows.select("p_partkey", F.coalesce("own", "other").alias("energy"), F.when(F.col("own").isNotNull(), "own").when(F.col("other").isNotNull(), "substitute").otherwise("missing").alias("status"))


CONDITIONS = "SELECT o_orderkey, 'a' AS condition, abs(o_totalprice - 1000) AS err FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'b', abs(o_totalprice - 2000) FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 'c', CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE abs(o_totalprice - 150000) END FROM orders"


@query(f"""WITH c AS ({CONDITIONS}) SELECT x.condition AS one, y.condition AS two, count(*) AS n, round(avg(x.err - y.err), 6) AS mean_diff, count(*) FILTER (x.err < y.err) AS one_wins, count(*) FILTER (y.err < x.err) AS two_wins
  FROM c x JOIN c y ON x.o_orderkey = y.o_orderkey AND x.condition < y.condition WHERE x.err IS NOT NULL AND y.err IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5""")
def q_paired_support(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair of policies on the reactions both have, five at least."""
    c = spark.sql(CONDITIONS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))
    return J.paired(c.where("err is not null"), ["o_orderkey"], "condition", "err", 5)


@query("""SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.v, o.v) AS v FROM (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT o_orderkey, -o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0) n ON o.o_orderkey = n.o_orderkey""")
def q_join_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Later results overwrite earlier ones by key."""
    o = table(spark, sf, "orders")
    return J.overlay(o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_totalprice").alias("v")), o.where("o_orderkey % 2 = 0").select("o_orderkey", (-F.col("o_totalprice")).alias("v")), ["o_orderkey"], ["v"])


@query("SELECT (l_quantity > 25) AS a, (l_discount > 0.05) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def q_join_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy((F.col("l_quantity") > 25).alias("a"), (F.col("l_discount") > 0.05).alias("b")).agg(F.count("*").alias("n"))


@query(sql("SELECT DISTINCT s AS species, functional, basis FROM (SELECT unnest(list_distinct(coalesce(elements, []))) AS s, functional, basis FROM r WHERE functional <> '' AND basis <> '')"))
def q_dedup_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct jobs over reactions and conditions."""
    r = records(spark, sf).where("functional <> '' and basis <> ''")
    return r.select(F.explode(F.array_distinct(C.elements_or_none(F.col("elements")))).alias("species"), "functional", "basis").distinct()


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch(b.ts) - epoch(a.ts)) <= 600")
def q_pair_join(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs in a group no further apart than a limit, by buckets of the limit's width.

    A row meets its own and the next bucket only, so the work follows the number of close pairs.
    """
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return J.close_pairs(e, ["user_id"], "t", 600_000_000, "event_id")


@query("""SELECT a.user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') a JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') b USING (user_id) GROUP BY 1""")
def q_intersect(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id")).select("user_id", F.lit(1).cast("long").alias("n"))


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'refund')")
def q_except(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.where("event_type = 'view'").select("user_id").subtract(e.where("event_type = 'refund'").select("user_id"))
