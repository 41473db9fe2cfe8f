"""Scores of predictions and policies, routing, and resampled statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..determinism import mode, uniform_sql
from ..operators import aggregates as A
from ..operators import features as V
from ..operators import models as M
from ..operators import resample as P
from ..registry import query, table
from .classification import SYSTEM_SQL
from .records import records, sql

#: Reactions with errors of three policies, and ties: one for each order.
ERRORS = "SELECT o_orderkey AS rid, o_orderpriority AS subset, abs(o_totalprice - 150000) / 1000 AS err_a, abs(o_totalprice - 100000 - 100 * (o_custkey % 997)) / 1000 AS err_b, CASE WHEN o_custkey % 9 = 0 THEN abs(o_totalprice - 150000) / 1000 ELSE abs(o_totalprice - 200000) / 1000 END AS err_c, CAST(o_custkey % 2 AS INT) AS pred FROM orders"


def errors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(ERRORS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))


STATUS = "CASE WHEN rid % 7 = 0 THEN 'error' ELSE 'ok' END"


@query(f"""WITH e AS ({ERRORS}) SELECT condition, count(*) AS attempted, count(*) FILTER (ok) AS evaluable, count(*) FILTER (ok AND tie) AS tied, count(*) FILTER (NOT ok) AS not_evaluable, round(avg(err) FILTER (ok), 6) AS mae_all, round(avg(err) FILTER (ok AND NOT tie), 6) AS mae_without_ties
  FROM (SELECT 'a' AS condition, err_a AS err, rid % 7 <> 0 AS ok, err_a = err_c AS tie FROM e UNION ALL SELECT 'c', err_c, rid % 5 <> 0, err_a = err_c FROM e) GROUP BY 1""")
def q_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """What was attempted, could be scored, tied, and could not; errors with and without ties."""
    e = errors(spark, sf)
    tie = F.col("err_a") == F.col("err_c")
    rows = e.select(F.lit("a").alias("condition"), F.col("err_a").alias("err"), (F.col("rid") % 7 != 0).alias("ok"), tie.alias("tie")).unionByName(e.select(F.lit("c").alias("condition"), F.col("err_c").alias("err"), (F.col("rid") % 5 != 0).alias("ok"), tie.alias("tie")))
    ok, t = F.col("ok"), F.col("tie")
    return rows.groupBy("condition").agg(F.count("*").alias("attempted"), F.count_if(ok).alias("evaluable"), F.count_if(ok & t).alias("tied"), F.count_if(~ok).alias("not_evaluable"), F.round(F.avg(F.when(ok, F.col("err"))), 6).alias("mae_all"), F.round(F.avg(F.when(ok & ~t, F.col("err"))), 6).alias("mae_without_ties"))


@query(f"WITH e AS ({ERRORS}) SELECT count(*) FILTER (err_a < err_c) AS a_wins, count(*) FILTER (err_c < err_a) AS c_wins, round(avg(err_a), 6) AS mae_a, round(avg(err_c), 6) AS mae_c, count(*) AS n FROM e")
def q_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Strict wins; a tie is no one's."""
    a, c = F.col("err_a"), F.col("err_c")
    return errors(spark, sf).agg(F.count_if(a < c).alias("a_wins"), F.count_if(c < a).alias("c_wins"), F.round(F.avg(a), 6).alias("mae_a"), F.round(F.avg(c), 6).alias("mae_c"), F.count("*").alias("n"))


@query(f"WITH e AS (SELECT subset, err_b - least(err_a, err_b, err_c) AS regret, err_b - err_a AS d FROM ({ERRORS})) SELECT subset, count(*) FILTER (d <= 0) AS better, count(*) FILTER (d > 0) AS worse, count(*) FILTER (d > 5) AS much_worse, round(avg(regret), 6) AS regret FROM e GROUP BY 1")
def q_regret(spark: SparkSession, sf: str) -> DataFrame:
    e = errors(spark, sf).withColumns({"d": F.col("err_b") - F.col("err_a"), "regret": F.col("err_b") - F.least("err_a", "err_b", "err_c")})
    return e.groupBy("subset").agg(F.count_if(F.col("d") <= 0).alias("better"), F.count_if(F.col("d") > 0).alias("worse"), F.count_if(F.col("d") > 5).alias("much_worse"), F.round(F.avg("regret"), 6).alias("regret"))


@query(f"WITH e AS ({ERRORS}) SELECT subset, round(avg(err_a), 6) AS fixed_err_a, round(avg(err_b), 6) AS fixed_err_b, round(avg(err_c), 6) AS fixed_err_c, round(avg(least(err_a, err_b, err_c)), 6) AS oracle, round(avg(greatest(err_a, err_b, err_c)), 6) AS worst FROM e GROUP BY 1")
def q_fixed_oracle_worst(spark: SparkSession, sf: str) -> DataFrame:
    return errors(spark, sf).groupBy("subset").agg(*A.fixed_oracle_worst(["err_a", "err_b", "err_c"]))


ROUTE = "round(avg(CASE WHEN pred = 1 THEN err_a ELSE err_b END), 6)"


@query(f"""WITH m AS (SELECT avg(err_a) AS a, avg(err_b) AS b, avg(CASE WHEN pred = 1 THEN err_a ELSE err_b END) AS r, avg(least(err_a, err_b)) AS o, avg(greatest(err_a, err_b)) AS w FROM ({ERRORS}))
  SELECT round(a, 6) AS mae_a, round(b, 6) AS mae_b, round(r, 6) AS routed, round(o, 6) AS oracle, round(w, 6) AS worst, round((w - least(a, b)) / (w - o), 6) AS break_even, round((least(a, b) - r) / (least(a, b) - o), 6) AS captured FROM m""")
def q_route_value(spark: SparkSession, sf: str) -> DataFrame:
    return M.route(errors(spark, sf), "err_a", "err_b", F.col("pred") == 1)


@query(f"WITH e AS ({ERRORS}) SELECT rid, CASE WHEN err_a < err_c THEN 1 ELSE 0 END AS y FROM e WHERE err_a <> err_c")
def q_pair_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Ties have no label; 1 where the first policy errs less."""
    return errors(spark, sf).where("err_a <> err_c").select("rid", (F.col("err_a") < F.col("err_c")).cast("int").alias("y"))


FROZEN = {"classes": ["A", "B", "C"], "mean": [0.01 * (i % 5) for i in range(64)], "scale": [1 + 0.25 * (i % 3) for i in range(64)], "coef": [[((i * (c + 2) + 3 * c) % 11 - 5) / 10 for i in range(64)] for c in range(3)], "intercept": [0.1, -0.2, 0.05]}
FROZEN["sha256"] = M.model_digest(FROZEN)
_logits = [" + ".join(f"((CAST(embedding[{i + 1}] AS DOUBLE) - {m}) / {s}) * {w}" for i, (m, s, w) in enumerate(zip(FROZEN["mean"], FROZEN["scale"], row))) + f" + {b}" for row, b in zip(FROZEN["coef"], FROZEN["intercept"])]
_z = ", ".join(f"round({x}, 9) AS z{i}" for i, x in enumerate(_logits))


@query(f"SELECT vec_id, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 'A' WHEN z1 >= z2 THEN 'B' ELSE 'C' END AS choice FROM (SELECT vec_id, {_z} FROM embeddings)")
def q_frozen_router(spark: SparkSession, sf: str) -> DataFrame:
    """A stored linear model scored without fitting anything; its digest is checked first."""
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", M.apply_frozen(x, M.checked(FROZEN)).alias("choice"))


@query("SELECT l_linestatus, round(avg(q), 6) AS mean_q, round(avg(p * p), 6) AS square_p, round(max(q), 6) AS max_q FROM (SELECT l_linestatus, (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) AS q, (l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem) AS p FROM lineitem) GROUP BY 1")
def q_standardize(spark: SparkSession, sf: str) -> DataFrame:
    z = M.standardize(table(spark, sf, "lineitem").select("l_linestatus", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return z.groupBy("l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("mean_q"), F.round(F.avg(F.col("l_extendedprice") * F.col("l_extendedprice")), 6).alias("square_p"), F.round(F.max("l_quantity"), 6).alias("max_q"))


@query(sql("""SELECT round_even(100 * avg(CASE WHEN functional IS NOT DISTINCT FROM p THEN 1.0 ELSE 0 END), 1) AS functional_pct, round_even(100 * avg(CASE WHEN basis IS NOT DISTINCT FROM b THEN 1.0 ELSE 0 END), 1) AS basis_pct, round_even(100 * avg(CASE WHEN functional IS NOT DISTINCT FROM p AND basis IS NOT DISTINCT FROM b THEN 1.0 ELSE 0 END), 1) AS both_pct, count(*) AS n
  FROM (SELECT functional, basis, CASE WHEN charge > 0 THEN functional ELSE 'PBE' END AS p, CASE WHEN charge < 2 THEN basis ELSE 'GEN' END AS b FROM r)"""))
def q_score_match(spark: SparkSession, sf: str) -> DataFrame:
    """Match rates; two missing values match."""
    r = records(spark, sf).withColumns({"p": F.when(F.col("charge") > 0, F.col("functional")).otherwise("PBE"), "b": F.when(F.col("charge") < 2, F.col("basis")).otherwise("GEN")})
    f, b = F.col("functional").eqNullSafe(F.col("p")), F.col("basis").eqNullSafe(F.col("b"))
    return r.agg(*(F.bround(A.percent(c), 1).alias(k) for k, c in (("functional_pct", f), ("basis_pct", b), ("both_pct", f & b))), F.count("*").alias("n"))


@query(sql("SELECT count(*) AS n, round(avg(CASE WHEN lower(replace(trim(basis), ' ', '')) = 'def2-svp' THEN 1.0 ELSE 0 END), 6) AS basis_rate, round(avg(CASE WHEN lower(replace(trim(functional), ' ', '')) = 'lda' THEN 1.0 ELSE 0 END), 6) AS functional_rate FROM r"))
def q_single_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Rates after case and spaces are taken out."""
    return records(spark, sf).agg(F.count("*").alias("n"), F.round(A.percent(M.normalized(F.col("basis")) == "def2-svp") / 100, 6).alias("basis_rate"), F.round(A.percent(M.normalized(F.col("functional")) == "lda") / 100, 6).alias("functional_rate"))


GOLD = {"functional": "nullif(functional, '')", "basis": "basis", "solvent": "nullif(solvent, '')", "dispersion": "dispersion"}
PRED = {"functional": "CASE WHEN charge > 0 THEN nullif(functional, '') ELSE 'PBE' END", "basis": "CASE WHEN charge < 0 THEN NULL ELSE basis END", "solvent": "'water'", "dispersion": "CASE WHEN charge = 1 THEN 'D4' ELSE dispersion END"}


@query(sql(" UNION ALL ".join(f"SELECT * FROM (SELECT '{f}' AS field, count(*) FILTER (g IS NOT NULL) AS gold_has, count(*) FILTER (p IS NOT NULL) AS pred_has, count(*) FILTER (g = p) AS n_match, count(*) FILTER (g IS NOT NULL AND p IS NULL) AS n_missing, count(*) FILTER (g IS NULL AND p IS NOT NULL) AS n_hallucinated FROM (SELECT {GOLD[f]} AS g, {PRED[f]} AS p FROM r)) WHERE gold_has + pred_has > 0" for f in GOLD)))
def q_field_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Of each field: right, missing and invented."""
    to_map = lambda fields: F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), F.expr(v)))), lambda k, v: v.isNotNull())
    return M.field_accuracy(records(spark, sf).select(to_map(GOLD).alias("gold"), to_map(PRED).alias("pred")), "gold", "pred")


@query(sql("SELECT entry_id, coalesce(functional, 'None') || chr(31) || coalesce(basis, 'None') AS label FROM r"))
def q_joint_label(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("entry_id", M.joint_label(F.col("functional"), F.col("basis")).alias("label"))


@query("""WITH f AS (SELECT user_id, event_type, user_id % 5 AS fold FROM events), m AS (SELECT k.fold, f.event_type, count(*) AS n FROM f, (SELECT DISTINCT fold FROM f) k WHERE f.fold <> k.fold GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k.fold ORDER BY count(*) DESC, f.event_type) = 1)
  SELECT f.fold, count(*) AS n, round(100 * avg(CASE WHEN f.event_type = m.event_type THEN 1.0 ELSE 0 END), 6) AS pct FROM f JOIN m ON f.fold = m.fold GROUP BY 1""")
def q_constant_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Each fold scored with the most frequent label of the others.

    Counts by fold and label are enough: what a fold trains on is all less its own.
    """
    c = table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("fold"), "event_type").agg(F.count("*").alias("n"))
    folds = c.select("fold").distinct()  # five
    train = c.withColumnRenamed("fold", "other").crossJoin(F.broadcast(folds)).where("other <> fold").groupBy("fold", "event_type").agg(F.sum("n").alias("n"))
    best = train.groupBy("fold").agg(F.min(F.struct((-F.col("n")).alias("k"), "event_type"))["event_type"].alias("constant"))
    hit = F.sum(F.when(F.col("event_type") == F.col("constant"), F.col("n")).otherwise(0))
    return c.join(best, "fold").groupBy("fold").agg(F.sum("n").alias("n"), F.round(100.0 * hit / F.sum("n"), 6).alias("pct"))


WITH_R = sql("").rstrip()
_E = "coalesce(elements, [])"
TRAIN = "t AS (SELECT * FROM r WHERE substr(entry_id, 2)::BIGINT % 5 <> 0), w AS (SELECT list_sort(list(DISTINCT x)) AS es FROM (SELECT unnest(elements) AS x FROM t)), k AS (SELECT list_sort(list(DISTINCT coalesce(nullif(task_type, ''), 'UNKNOWN'))) AS ts FROM t)"
ROW = f"""list_concat([ln(1 + greatest(coalesce(n_atoms, 0), 0)), CAST(coalesce(charge, 0) AS DOUBLE), CASE WHEN coalesce(nullif(multiplicity, 0), 1) <> 1 THEN 1.0 ELSE 0.0 END, CASE WHEN trim(coalesce(solvent, '')) <> '' THEN 1.0 ELSE 0.0 END],
  list_transform(es, lambda x: CASE WHEN list_contains({_E}, x) THEN 1.0 ELSE 0.0 END), list_transform(ts, lambda x: CASE WHEN coalesce(nullif(task_type, ''), 'UNKNOWN') = x THEN 1.0 ELSE 0.0 END){{0}})"""
SCALE_ROW = ", list_transform(['S', 'M', 'L', 'XL', 'unknown'], lambda x: CASE WHEN CASE WHEN n_atoms IS NULL OR n_atoms = 0 THEN 'unknown' WHEN n_atoms <= 10 THEN 'S' WHEN n_atoms <= 30 THEN 'M' WHEN n_atoms <= 100 THEN 'L' ELSE 'XL' END = x THEN 1.0 ELSE 0.0 END)"


def _text(x):
    return F.array_join(F.transform(x, lambda v: F.format_string("%.4f", v)), " ")


@query(WITH_R + f", {TRAIN} SELECT entry_id, array_to_string(list_transform({ROW.format(SCALE_ROW)}, lambda v: printf('%.4f', CAST(v AS DOUBLE))), ' ') AS features FROM r, w, k")
def q_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows of all records; the vocabularies are those of four fifths of them."""
    r = records(spark, sf)
    v = V.fit(r.where("CAST(substr(entry_id, 2) AS BIGINT) % 5 <> 0"))
    return V.transform(r, v, ["entry_id"]).withColumn("features", _text("features"))


@query(WITH_R + f", {TRAIN} SELECT entry_id, array_to_string(list_transform({ROW.format('')}, lambda v: printf('%.4f', CAST(v AS DOUBLE))), ' ') AS features FROM r, w, k")
def q_features_rf(spark: SparkSession, sf: str) -> DataFrame:
    """The same without size classes."""
    r = records(spark, sf)
    v = V.fit(r.where("CAST(substr(entry_id, 2) AS BIGINT) % 5 <> 0"))
    return V.transform(r, v, ["entry_id"], False).withColumn("features", _text("features"))


_folds = " UNION ALL ".join(f"SELECT {k} AS split_fold, x AS word FROM (SELECT DISTINCT unnest(elements) AS x FROM r WHERE substr(entry_id, 2)::BIGINT % 3 <> {k})" for k in range(3))


@query(WITH_R + f""", v AS ({_folds}), c AS (SELECT split_fold, count(*) AS n FROM v GROUP BY 1),
  h AS (SELECT split_fold, entry_id, count(*) AS hits FROM r JOIN v ON list_contains({_E}, word) GROUP BY 1, 2)
  SELECT c.split_fold, entry_id, substr(entry_id, 2)::BIGINT % 3 = c.split_fold AS is_test, CAST(n AS BIGINT) AS n_elements, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM r CROSS JOIN c LEFT JOIN h USING (split_fold, entry_id)""")
def q_features_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Features of every fold with the vocabulary of the others: how many elements it has and a record shows."""
    r = records(spark, sf).withColumn("fold", F.expr("CAST(substr(entry_id, 2) AS BIGINT) % 3"))
    rows, tasks = V.cross_validated(r, "fold", 3, ["entry_id"]), len(V.fit(r).tasks)
    elements = F.slice("features", 5, F.size("features") - 4 - tasks - len(V.SCALES))
    return rows.select("split_fold", "entry_id", "is_test", F.size(elements).cast("long").alias("n_elements"), F.aggregate(elements, F.lit(0.0), lambda a, x: a + x).cast("long").alias("hits"))


@query("SELECT o_orderkey, l_partkey, p_size AS n_atoms FROM (SELECT l_orderkey AS o_orderkey, l_partkey, p_size, row_number() OVER (PARTITION BY l_orderkey ORDER BY p_size DESC, l_linenumber, l_partkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE k = 1")
def q_representative(spark: SparkSession, sf: str) -> DataFrame:
    """The largest part of each order, the first of equals."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("n_atoms")), "l_partkey")
    rows = rows.withColumn("pos", F.struct("l_linenumber", "l_partkey"))
    return V.representative(rows, ["o_orderkey"], "n_atoms", "pos").select("o_orderkey", "l_partkey", "n_atoms")


@query(sql(f"""SELECT upload_id, entry_id, n_atoms, charge, multiplicity, 'SP' AS task_type, {SYSTEM_SQL} AS system_type, 'bench' AS specialist_cell FROM r WHERE upload_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY upload_id ORDER BY coalesce(n_atoms, -1) DESC, entry_id) = 1"""))
def q_reaction_profile(spark: SparkSession, sf: str) -> DataFrame:
    """What a method is asked for each upload: the profile of its largest record."""
    best = V.representative(records(spark, sf).where("upload_id is not null"), ["upload_id"], "n_atoms", "entry_id")
    return V.profile(best, F.lit("bench"), ["upload_id", "entry_id"]).drop("elements")


@query("""WITH x AS (SELECT p_partkey, p_size % 7 AS c, p_size % 11 AS h, p_size % 2 AS f FROM part)
  SELECT p_partkey, CAST(c AS INT) AS n_c, (2 * c + 2 - h - f) / 2.0 AS unsaturation, CASE WHEN p_partkey % 2 = 0 THEN 'has_Fe' ELSE '' END AS others FROM x""")
def q_unsaturation(spark: SparkSession, sf: str) -> DataFrame:
    """Elements counted in XYZ texts, the degree of unsaturation, and elements beyond the usual ones."""
    line = lambda symbol, n: F.repeat(F.lit(f"{symbol}  0.0 1.0 2.0\n"), n)
    k = F.col("p_size")
    xyz = F.concat(line("C", (k % 7).cast("int")), line("H", (k % 11).cast("int")), line("F", (k % 2).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "  Fe 0 0 0").otherwise(""))
    rows = table(spark, sf, "part").select("p_partkey", V.xyz_elements(xyz).alias("m"))
    others = F.array_join(F.map_keys(V.other_elements(F.col("m"))), ",")
    return rows.select("p_partkey", F.coalesce(F.try_element_at("m", F.lit("C")), F.lit(0)).alias("n_c"), V.unsaturation(F.col("m")).alias("unsaturation"), others.alias("others"))


@query(sql("SELECT field, array_to_string(list_sort(list(DISTINCT v)), '|') AS words FROM (SELECT 'functional' AS field, functional AS v FROM r UNION ALL SELECT 'basis', basis FROM r) WHERE v <> '' AND NOT contains(v, '=') GROUP BY 1"))
def q_vocab_clean(spark: SparkSession, sf: str) -> DataFrame:
    return V.clean_vocabulary(records(spark, sf), ["functional", "basis"]).select("field", F.array_join("values", "|").alias("words"))


@query(sql("SELECT entry_id, CASE functional WHEN 'M062X' THEN 'M06-2X' WHEN 'LDA' THEN 'SVWN' ELSE functional END AS functional, basis FROM r WHERE functional <> '' AND functional <> 'MP2' AND coalesce(basis, '') <> ''"))
def q_canon_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions respelled; excluded ones and those without a basis go."""
    from ..functions import classify as C

    respelled = lambda f: C.canonical(f, {"M062X": "M06-2X"}, ("MP2",), {"LDA": "SVWN"})
    return V.canonical_predictions(records(spark, sf), ["entry_id"], "functional", "basis", respelled)


@query(f"SELECT subset, round(greatest(avg(agree), 1 - avg(agree)), 6) AS agreement FROM (SELECT subset, CASE WHEN (err_a < err_b) = (pred = 1) THEN 1.0 ELSE 0 END AS agree FROM ({ERRORS})) GROUP BY 1")
def q_best_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of two clusters with two labels, in the better of both namings."""
    same = F.avg(((F.col("err_a") < F.col("err_b")) == (F.col("pred") == 1)).cast("double"))
    return errors(spark, sf).groupBy("subset").agg(F.round(F.greatest(same, 1 - same), 6).alias("agreement"))


@query(f"SELECT round(sum(share * cost), 6) AS expected_cost, round(max(share) FILTER (pred = 1), 6) AS routed FROM (SELECT pred, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM ({ERRORS})) AS share, CASE pred WHEN 1 THEN 41.5 ELSE 1.0 END AS cost FROM ({ERRORS}) GROUP BY pred)")
def q_holdout_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Share routed to each method and what it costs."""
    cost = F.when(F.col("pred") == 1, 41.5).otherwise(1.0)
    return errors(spark, sf).agg(F.round(F.avg(cost), 6).alias("expected_cost"), F.round(F.avg(F.col("pred").cast("double")), 6).alias("routed"))


REPS = 50


def differences(spark: SparkSession, sf: str) -> DataFrame:
    return errors(spark, sf).withColumn("d", F.col("err_a") - F.col("err_b"))


@query()
def q_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile interval of a mean difference, by subset. Rows are numbered by a hash that SQL lacks;
    tests repeat it by brute force."""
    return P.bootstrap(differences(spark, sf), ["subset"], "rid", "d", REPS, 11)


@query(f"""WITH e AS ({ERRORS}), v AS (SELECT rid, subset, err_a - err_b AS d FROM e), flips AS (SELECT subset, rep, avg(CASE WHEN {uniform_sql(12, 'rep', 'rid')} < 0.5 THEN -d ELSE d END) AS m FROM v, (SELECT unnest(range(1, {REPS + 1})) AS rep) GROUP BY 1, 2)
  SELECT flips.subset, any_value(n) AS n, round(avg(CASE WHEN round(abs(m), 9) >= round(abs(real), 9) THEN 1.0 ELSE 0 END), 6) AS p FROM flips JOIN (SELECT subset, count(*) AS n, avg(d) AS real FROM v GROUP BY 1) USING (subset) GROUP BY 1""")
def q_signflip(spark: SparkSession, sf: str) -> DataFrame:
    return P.sign_flip(differences(spark, sf), ["subset"], "rid", "d", REPS, 12)


@query(f"""WITH e AS ({ERRORS}), s AS (SELECT rep, e.*, row_number() OVER (PARTITION BY rep ORDER BY {uniform_sql(13, 'rep', 'rid')}, rid) AS k FROM e, (SELECT unnest(range(1, 31)) AS rep)),
  g AS (SELECT rep, avg(err_c - CASE WHEN k <= (SELECT count(*) FROM e WHERE pred = 0) THEN err_a ELSE err_b END) AS gain FROM s GROUP BY 1), real AS (SELECT count(*) AS n, avg(err_c - CASE pred WHEN 0 THEN err_a ELSE err_b END) AS gain FROM e)
  SELECT any_value(real.n) AS n, round(any_value(real.gain), 6) AS gain, round(avg(CASE WHEN round(g.gain, 9) >= round(real.gain, 9) THEN 1.0 ELSE 0 END), 6) AS p FROM g, real""")
def q_perm_gain(spark: SparkSession, sf: str) -> DataFrame:
    """Gain of routing against shuffled routing."""
    return P.permuted_gain(errors(spark, sf), "rid", "err_c", ["err_a", "err_b"], "pred", 30, 13)


@query("SELECT cell, label, round(avg(CASE WHEN label = top THEN 1.0 ELSE 0 END), 6) AS rate, count(*) AS n FROM (SELECT d.lang AS cell, l.quality AS label, m.quality AS top FROM documents d JOIN labels l USING (doc_id) JOIN (SELECT lang, quality FROM (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, quality) = 1) m ON m.lang = d.lang) GROUP BY 1, 2")
def q_summarize_hits(spark: SparkSession, sf: str) -> DataFrame:
    """A cell's majority label scored on its rows."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("cell")).join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    best = mode(rows, ["cell"], ["label"]).select("cell", F.col("label").alias("top"))
    return rows.join(best, "cell").groupBy("cell", "label").agg(F.round(A.percent(F.col("label") == F.col("top")) / 100, 6).alias("rate"), F.count("*").alias("n"))
