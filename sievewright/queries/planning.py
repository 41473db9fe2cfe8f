"""Plans, expressions, templates and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import geometry as G
from ..functions import names as N
from ..plans import checkers, checks, references
from ..plans.expressions import to_column
from ..registry import query, table
from .records import choose

EXPR = "abs(l_extendedprice - 2 ** 3 * l_quantity) / sqrt(l_quantity + 1) + log(l_extendedprice) % 3 - -l_tax"


@query("SELECT l_returnflag, round(sum(abs(l_extendedprice - 8 * l_quantity) / sqrt(l_quantity + 1) + (ln(l_extendedprice) - 3 * floor(ln(l_extendedprice) / 3)) + l_tax), 2) AS total FROM lineitem GROUP BY 1")
def q_expr(spark: SparkSession, sf: str) -> DataFrame:
    """An expression given as text, as a column."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(to_column(EXPR)), 2).alias("total"))


@query("SELECT n_nationkey, 'run ' || n_name || ' at 298.15 K in water, $(node.x)' AS args, 'node.x' AS unknown FROM nation")
def q_refs(spark: SparkSession, sf: str) -> DataFrame:
    """References expanded in a text; one of no known kind stays and is told."""
    text = F.concat(F.lit("run "), "n_name", F.lit(" at $(settings.T) K in $(artifacts.solvent), $(node.x)"))
    done = references.expand_column(references.expand_column(text, "settings", {"T": "298.15"}), "artifacts", {"solvent": "water"})
    return table(spark, sf, "nation").select("n_nationkey", done.alias("args"), F.array_join(references.unknown_references(done), ",").alias("unknown"))


TEMPLATE = [(0, "build_{C}", "build", "", "{C}_raw", "all"), (1, "opt_{C}", "opt", "{C}_raw", "{C}_opt", "all"), (2, "ref_{C}", "freq", "{C}_opt", "{C}_ref", "references_only"), (3, "pka_{C}", "calc", "{C}_opt", "{C}_pka", "targets_only"), (4, "report", "report", "", "", "all")]


@query("""WITH c AS (SELECT n_name AS name, CASE WHEN n_regionkey = 0 THEN 'reference' ELSE 'target' END AS role FROM nation)
  SELECT 'build_' || name AS id, 'build' AS tool, '' AS input_id, name || '_raw' AS output_id FROM c UNION ALL SELECT 'opt_' || name, 'opt', name || '_raw', name || '_opt' FROM c UNION ALL SELECT 'ref_' || name, 'freq', name || '_opt', name || '_ref' FROM c WHERE role = 'reference'
  UNION ALL SELECT 'pka_' || name, 'calc', name || '_opt', name || '_pka' FROM c WHERE role <> 'reference' UNION ALL SELECT 'report', 'report', '', ''""")
def q_template(spark: SparkSession, sf: str) -> DataFrame:
    """A template's nodes for each compound."""
    t = spark.createDataFrame(TEMPLATE, "pos int, id string, tool string, input_id string, output_id string, applies_to string")
    c = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, "reference").otherwise("target").alias("role"))
    return references.expand_nodes(t, c)


NODES = "SELECT l_orderkey AS plan, l_linenumber AS pos, CASE WHEN l_tax > 0.07 THEN '' ELSE 'n' || l_linenumber END AS id, CASE WHEN l_linenumber % 3 = 0 THEN 'llm' ELSE 'tool' END AS kind, CASE WHEN l_discount > 0.09 THEN 'nope' ELSE l_returnflag END AS tool, CASE WHEN l_linenumber > 1 THEN 'g' || (l_linenumber - 1) ELSE '' END AS input_id, 'g' || l_linenumber AS output_id FROM lineitem"


@query(f"""WITH n AS ({NODES}) SELECT plan, count(*) AS n_nodes, bool_and(id <> '') AS nodes_have_id, true AS nodes_have_kind, bool_and(kind <> 'tool' OR tool IN ('A', 'N', 'R')) AS tools_valid,
  bool_and(kind <> 'tool' OR input_id = '' OR EXISTS (SELECT 1 FROM n m WHERE m.plan = n.plan AND m.output_id = n.input_id)) AS dep_graph_valid, count(DISTINCT id) = count(id) AS ids_unique FROM n GROUP BY 1""")
def q_plan_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Structure of many plans at once."""
    nodes = spark.sql(NODES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))
    return checks.structure(nodes, spark.createDataFrame([("A",), ("N",), ("R",)], "tool string"))


SCHEMA = [("A", "x", True), ("A", "y", False), ("N", "x", True), ("R", "z", True)]
USED = "SELECT DISTINCT l_orderkey AS plan, l_returnflag AS tool, CASE WHEN l_linenumber % 2 = 0 THEN 'x' WHEN l_linenumber % 3 = 0 THEN 'y' ELSE 'z' END AS arg FROM lineitem"


@query(f"""WITH u AS ({USED}), s(tool, arg, required) AS (VALUES ('A', 'x', true), ('A', 'y', false), ('N', 'x', true), ('R', 'z', true))
  SELECT plan, tool, arg, 'unknown' AS problem FROM u WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.tool = u.tool AND s.arg = u.arg)
  UNION ALL SELECT DISTINCT u.plan, s.tool, s.arg, 'missing' FROM u JOIN s ON s.tool = u.tool AND s.required WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.plan = u.plan AND v.tool = s.tool AND v.arg = s.arg)""")
def q_check_args(spark: SparkSession, sf: str) -> DataFrame:
    used = spark.sql(USED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))
    return checks.arguments(used, spark.createDataFrame(SCHEMA, "tool string, arg string, required boolean"))


@query("SELECT user_id, coalesce(min(event_id) FILTER (event_type = 'purchase') > min(event_id) FILTER (event_type = 'click'), false) AS in_order FROM events GROUP BY 1")
def q_order_checks(spark: SparkSession, sf: str) -> DataFrame:
    return checks.comes_after(table(spark, sf, "events"), ["user_id"], "event_type", "event_id", "click", "purchase")


@query("""WITH b AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber < 3), o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber >= 3 OR l_quantity > 20)
  SELECT b.l_orderkey, bool_and(o.l_suppkey IS NOT NULL) AS covered, count(*) FILTER (o.l_suppkey IS NULL) AS n_missing FROM b LEFT JOIN o ON b.l_orderkey = o.l_orderkey AND b.l_suppkey = o.l_suppkey GROUP BY 1""")
def q_subset_check(spark: SparkSession, sf: str) -> DataFrame:
    """Everything built is optimised later."""
    l = table(spark, sf, "lineitem")
    return checks.all_covered(l.where("l_linenumber < 3").select("l_orderkey", "l_suppkey").distinct(), l.where("l_linenumber >= 3 or l_quantity > 20"), ["l_orderkey"], "l_suppkey")


@query("SELECT w AS token, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(html), '[a-z]+='))) AS w FROM pages) WHERE w NOT IN ('lang=', 'charset=', 'href=') GROUP BY 1")
def q_prose_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Names used in prose that a schema doesn't have."""
    tokens = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit("[a-z]+="), F.lit(0)))).alias("token")
    return table(spark, sf, "pages").select(tokens).where(~F.col("token").isin("lang=", "charset=", "href=")).groupBy("token").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), 'none') AS name, CASE WHEN length(s_name) > 8 THEN substr(s_name, 1, 8) || '...' ELSE s_name END AS short FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN ' ' WHEN s_suppkey % 3 = 1 THEN NULL ELSE s_name END AS a, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'alias' END AS b FROM supplier)""")
def q_normalize_payload(spark: SparkSession, sf: str) -> DataFrame:
    """The first filled of alias keys, and values cut for logs."""
    k = F.col("s_suppkey")
    a = F.when(k % 3 == 0, " ").when(k % 3 == 2, F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", F.coalesce(references.first_filled(a, F.when(k % 2 == 0, "").otherwise("alias")), F.lit("none")).alias("name"), references.truncated(F.col("s_name"), 8).alias("short"))


IONS = ["Fe3+", "Cl-", "Na+", "O2-", "Fe", "water", "", "H+"]
ION_SQL = "CASE CAST(p_partkey AS BIGINT) % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(IONS)) + " END"


@query(f"SELECT p_partkey, CASE CAST(p_partkey AS BIGINT) % 8 WHEN 0 THEN 'Fe' WHEN 1 THEN 'Cl' WHEN 2 THEN 'Na' WHEN 3 THEN 'O' WHEN 4 THEN 'Fe' WHEN 7 THEN 'H' END AS symbol, CASE CAST(p_partkey AS BIGINT) % 8 WHEN 0 THEN 3 WHEN 1 THEN -1 WHEN 2 THEN 1 WHEN 3 THEN -2 WHEN 4 THEN 0 WHEN 7 THEN 1 END AS charge FROM part")
def q_parse_ion(spark: SparkSession, sf: str) -> DataFrame:
    ion = X.ion(F.expr(ION_SQL))
    return table(spark, sf, "part").select("p_partkey", ion["symbol"].alias("symbol"), ion["charge"].alias("charge"))


NAMES = ["Fe3+", "Cl-", "chloride", "Iron(III)", "iron atom", "Pd atom", "Fe2+ atom", "C=O", "CC(=O)[O-]", "[Fe+2][Cl-]", "NO2+", "benzene", "", "H2+", "Xx", "H+", "N#N ", "C/C=C a", "OH-"]
NAME_SQL = "CASE CAST(p_partkey AS BIGINT) % 20 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(NAMES)) + " END"


def _signed_sql(sign: str, size: str) -> str:
    return f"(CASE {sign} WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END * CAST(coalesce(nullif({size}, ''), '1') AS INT))"


def _charge_sql(text: str) -> str:
    return _signed_sql(f"regexp_extract({text}, '{N.SUFFIX}', 1)", f"regexp_extract({text}, '{N.SUFFIX}', 2)")


def _bare_sql(text: str, name: str) -> str:
    group = lambda i: f"regexp_extract({text}, '{N.BARE}', {i})"
    return f"{group(1)} AS {name}_symbol, {_signed_sql(group(3), group(2))} AS {name}_charge, coalesce(list_position({N.ELEMENTS}, {group(1)}), 0) AS {name}_z"


@query(rf"""WITH t AS (SELECT p_partkey, trim(coalesce({NAME_SQL}, '')) AS s FROM part),
  known(name, name_symbol, name_charge) AS (VALUES {', '.join(f"('{k}', '{a}', {c})" for k, (a, c) in N.ION_NAMES.items())}),
  f AS (SELECT p_partkey, s, {_bare_sql("s", "ion")}, {_bare_sql("CASE WHEN lower(s) LIKE '% atom' THEN trim(left(s, len(s) - 5)) ELSE '' END", "atom")}, name_symbol, name_charge, coalesce(list_position({N.ELEMENTS}, name_symbol), 0) AS name_z,
    {_charge_sql("s")} AS ending, coalesce(list_sum(list_transform(regexp_extract_all(s, '\[([^\]]+)\]', 1), lambda b: {_charge_sql("b")})), 0) AS brackets FROM t LEFT JOIN known ON lower(s) = name),
  r AS (SELECT *, CASE WHEN s = '' THEN 'empty' WHEN regexp_matches(s, '[=#\[\]/\\@]') AND NOT contains(s, ' ') THEN 'structure' WHEN ion_z > 0 AND ion_z >= ion_charge THEN 'ion' WHEN name_z > 0 THEN 'name' WHEN atom_z > 0 AND atom_z >= atom_charge THEN 'atom' ELSE 'lookup' END AS route FROM f)
  SELECT p_partkey, route, CASE route WHEN 'ion' THEN ion_symbol WHEN 'name' THEN name_symbol WHEN 'atom' THEN atom_symbol END AS symbol,
  CASE route WHEN 'empty' THEN 0 WHEN 'ion' THEN ion_charge WHEN 'name' THEN name_charge WHEN 'atom' THEN atom_charge WHEN 'lookup' THEN ending ELSE CASE WHEN ending = 0 THEN brackets ELSE ending END END AS charge,
  CASE route WHEN 'ion' THEN (ion_z - ion_charge) % 2 + 1 WHEN 'name' THEN (name_z - name_charge) % 2 + 1 WHEN 'atom' THEN (atom_z - atom_charge) % 2 + 1 ELSE 1 END AS multiplicity FROM r""")
def q_resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    """Each name by the first route that knows it."""
    return table(spark, sf, "part").select("p_partkey", N.resolved(F.expr(NAME_SQL)).alias("r")).select("p_partkey", "r.*")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, coalesce(b.bal, a.bal) AS bal, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'first' ELSE 'second' END AS source
  FROM (SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier) a FULL JOIN (SELECT c_custkey + 40 AS k, c_name AS name, c_acctbal AS bal FROM customer) b ON a.k = b.k""")
def q_merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources whose keys overlap in part, each field from the one it is trusted in."""
    from ..operators.joins import merge_sources

    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    b = table(spark, sf, "customer").select((F.col("c_custkey") + 40).alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return merge_sources(a, b, "k", {"name": "first", "bal": "second"})


@query("SELECT s_suppkey AS k, 'missing' AS difference FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey + 40 FROM customer) UNION ALL SELECT c_custkey + 40, 'extra' FROM customer WHERE c_custkey + 40 NOT IN (SELECT s_suppkey FROM supplier)")
def q_key_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that only one of two tables has, both ways."""
    from ..operators.joins import key_differences

    return key_differences(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), table(spark, sf, "customer").select((F.col("c_custkey") + 40).alias("k")), ["k"])


# spectra and energies --------------------------------------------------------------------------------


@query("SELECT user_id % 10 AS compound, x, round(sum(value * 225.0 / ((x - k) * (x - k) + 225.0)), 4) AS y FROM (SELECT user_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 40 AS k FROM events WHERE event_type = 'click'), (SELECT CAST(40.0 AS DOUBLE) * unnest(range(0, 101)) AS x) GROUP BY 1, 2")
def q_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks broadened on a grid."""
    peaks = table(spark, sf, "events").where("event_type = 'click'").select((F.col("user_id") % 10).alias("compound"), (F.get_json_object("props", "$.k").cast("double") * 40).alias("at"), "value")
    return G.spectrum(peaks, ["compound"], "at", "value", 0.0, 4000.0, 101, 15.0).select("compound", "x", F.round("y", 4).alias("y"))


@query("WITH ref AS (SELECT avg(value / 1.3642 - 4) AS err FROM events WHERE event_type = 'view') SELECT event_id, round(value / (0.0019872041 * 298.15 * ln(10)) - (SELECT err FROM ref), 4) AS pka FROM events WHERE event_type = 'click'")
def q_pka(spark: SparkSession, sf: str) -> DataFrame:
    """A formula less the mean error over references."""
    e = table(spark, sf, "events")
    err = e.where("event_type = 'view'").agg(F.avg(F.col("value") / 1.3642 - 4).alias("err"))
    return e.where("event_type = 'click'").crossJoin(F.broadcast(err)).select("event_id", F.round(G.pka(F.col("value")) - F.col("err"), 4).alias("pka"))


@query("SELECT user_id, max_by(event_id, struct_pack(v := value, k := -event_id)) AS brightest, min_by(event_id, struct_pack(d := round(abs(value - 50), 9), k := event_id)) AS nearest FROM events GROUP BY 1")
def q_nearest_target(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest state and the one closest to a target."""
    k = F.col("event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by(k, F.struct(F.col("value"), -k)).alias("brightest"), F.min_by(k, F.struct(F.round(F.abs(F.col("value") - 50), 9), k)).alias("nearest"))


@query("SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND abs(CAST(round(a.c_acctbal * 100) AS BIGINT) - CAST(round(b.c_acctbal * 100) AS BIGINT)) <= 500")
def q_inputs_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Values meant to differ that hardly do."""
    from ..operators.joins import close_pairs

    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    return close_pairs(c, ["c_nationkey"], "cents", 500, "c_custkey")


@query("SELECT event_type, event_id, n FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def q_tail_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The last rows of each log."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 20").select("event_type", "event_id", F.col("n").cast("long").alias("n"))


# more of plans and molecules ------------------------------------------------------------------------


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE 'any' END AS code, CASE WHEN p_size % 4 = 0 THEN p_size ELSE 2 END AS max_attempts FROM part")
def q_normalize_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Three spellings of a rule in JSON brought to one."""
    k = F.col("p_partkey") % 3
    attempts = F.when(F.col("p_size") % 4 == 0, F.col("p_size"))
    spelled = F.when(k == 0, F.to_json(F.struct(F.col("p_brand").alias("code"), attempts.alias("max_attempts")))).when(k == 1, F.to_json(F.struct(F.struct(F.col("p_type").alias("error_code")).alias("match"), attempts.alias("retries")))).otherwise(F.to_json(F.struct(attempts.alias("max_attempts"))))
    return table(spark, sf, "part").select("p_partkey", references.rule(spelled).alias("r")).select("p_partkey", "r.code", "r.max_attempts")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value * 2 AS b FROM events")
def q_set_path(spark: SparkSession, sf: str) -> DataFrame:
    """A nested field replaced in a copy; the others stay."""
    s = F.struct(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.lit(0.0).alias("b")).alias("a"))
    return table(spark, sf, "events").select("event_id", references.with_value(s, "a.b", F.col("value") * 2).alias("s")).select("event_id", F.col("s.a.k").alias("k"), F.col("s.a.b").alias("b"))


@query(f"WITH n AS ({NODES}) SELECT plan, 'flowchart TD' || chr(10) || string_agg('  ' || pos || '[' || tool || ']', chr(10) ORDER BY pos, tool, id, kind) AS chart, count(*) FILTER (kind = 'tool') AS n_tool, count(DISTINCT tool) AS n_tools FROM n GROUP BY 1")
def q_mermaid(spark: SparkSession, sf: str) -> DataFrame:
    """A plan as flowchart text, and counts by kind."""
    nodes = spark.sql(NODES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))
    line = lambda x: F.concat(F.lit("  "), x["pos"].cast("string"), F.lit("["), x["tool"], F.lit("]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tool", "id", "kind"))), line)
    return nodes.groupBy("plan").agg(F.concat(F.lit("flowchart TD\n"), F.array_join(lines, "\n")).alias("chart"), F.count_if(F.col("kind") == "tool").alias("n_tool"), F.count_distinct("tool").alias("n_tools"))


METALS, STATES, SHAPES, LIGANDS = ["Fe", "Co", "Ni", "Cu", "Mn", "Zn", "Cr", "X"], ["II", "3", "I", "2", "?"], ["oct", "sqp", "THD"], ["cn", "water cl", "en foo", "Cl", "nh3 h2o"]
SPIN_INPUT = f"{choose('p_partkey', METALS)} AS metal, {choose('p_size', STATES)} AS ox, {choose('p_partkey + p_size', SHAPES)} AS shape, split({choose('p_partkey * 3 + p_size', LIGANDS)}, ' ') AS ligands"


@query(f"""SELECT p_partkey, CAST(CASE WHEN d = 10 THEN 1 WHEN d = 9 THEN 2 WHEN d = 8 AND shape = 'sqp' THEN 1 WHEN d = 8 AND shape = 'THD' THEN 3 WHEN shape <> 'oct' THEN NULL WHEN d = 3 THEN 4
  WHEN d = 4 THEN CASE WHEN strong THEN 3 ELSE 5 END WHEN d = 5 THEN CASE WHEN strong THEN 2 ELSE 6 END WHEN d = 6 THEN CASE WHEN strong THEN 1 ELSE 5 END WHEN d = 7 THEN CASE WHEN strong THEN 2 ELSE 4 END WHEN d = 8 THEN CASE WHEN strong THEN 1 ELSE 3 END END AS INT) AS multiplicity
  FROM (SELECT p_partkey, shape, CASE metal WHEN 'Fe' THEN 8 WHEN 'Co' THEN 9 WHEN 'Ni' THEN 10 WHEN 'Cu' THEN 11 WHEN 'Mn' THEN 7 WHEN 'Zn' THEN 12 WHEN 'Cr' THEN 6 END - CASE ox WHEN 'II' THEN 2 WHEN '3' THEN 3 WHEN 'I' THEN 1 WHEN '2' THEN 2 END AS d,
    ligands[1] IN ('cn', 'en', 'nh3') AS strong FROM (SELECT p_partkey, {SPIN_INPUT} FROM part))""")
def q_auto_spin(spark: SparkSession, sf: str) -> DataFrame:
    """Spin multiplicity from metal, oxidation state, geometry and ligands."""
    from ..functions.spin import multiplicity

    rows = spark.sql(f"SELECT p_partkey, {SPIN_INPUT} FROM {{part}}", part=table(spark, sf, "part"))
    return rows.select("p_partkey", multiplicity(F.col("metal"), F.col("ox"), F.col("shape"), F.col("ligands")).alias("multiplicity"))


TOOLS = ["run_opt_job", "run_freq_job", "run_sp_energy", "run_spectrum_job", "run_scan_job", "run_ts_opt_job"]
_tools = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TOOLS))
PLAN = f"""SELECT l_orderkey AS plan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos, CASE WHEN l_quantity > 45 THEN 'llm' ELSE 'tool' END AS kind, CASE CAST(l_partkey AS BIGINT) % 6 {_tools} END AS tool,
  CASE WHEN l_discount > 0.05 THEN 'E_total_eh' WHEN l_tax > 0.05 THEN 'ir_spectrum' ELSE 'Scan_Results' END AS product, CASE WHEN l_discount < 0.02 THEN 'B3LYP SMD(water)' ELSE 'B3LYP' END AS method FROM lineitem"""


def plans(spark: SparkSession, sf: str) -> DataFrame:
    """A plan for each order, a node for each of its lines."""
    rows = spark.sql(PLAN.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))
    none = F.lit(None).cast("string")
    return rows.select("plan", "pos", F.concat(F.lit("n"), F.col("pos").cast("string")).alias("id"), "kind", "tool", none.alias("input_id"), none.alias("output_id"), F.create_map(F.lit("method"), F.col("method")).alias("args"), F.array("product").alias("products"))


def _has(tool: str) -> str:
    return f"coalesce(bool_or(kind = 'tool' AND tool = '{tool}'), false)"


def _first(tool: str) -> str:
    return f"min(pos) FILTER (kind = 'tool' AND tool = '{tool}')"


_checks = {
    "sp": {"has_sp_node": _has("run_sp_energy"), "no_freq_job": f"NOT {_has('run_freq_job')}", "has_energy_art": "bool_or(product = 'E_total_eh')"},
    "spectrum": {"has_spectrum_node": _has("run_spectrum_job"), "no_plain_freq": f"NOT {_has('run_freq_job')}", "has_opt_node": _has("run_opt_job"), "spectrum_after_opt": f"coalesce({_first('run_spectrum_job')} > {_first('run_opt_job')}, false)", "ir_spectrum_art": "bool_or(product = 'ir_spectrum')", "no_llm_node": "NOT bool_or(kind = 'llm')"},
    "ts": {"has_scan_node": _has("run_scan_job"), "has_ts_opt_node": _has("run_ts_opt_job"), "has_freq_node": f"{_has('run_freq_job')} OR {_has('run_spectrum_job')}", "ts_opt_after_scan": f"coalesce({_first('run_ts_opt_job')} > {_first('run_scan_job')}, false)", "freq_after_ts_opt": f"coalesce(least({_first('run_freq_job')}, {_first('run_spectrum_job')}) > {_first('run_ts_opt_job')}, false)", "no_llm_node": "NOT bool_or(kind = 'llm')"},
}
_rows = " UNION ALL ".join(f"SELECT plan, '{t}' AS task, '{c}' AS check_name, {sql} AS ok FROM n GROUP BY 1" for t, cs in _checks.items() for c, sql in cs.items())


@query(f"WITH n AS ({PLAN}) SELECT task, check_name, count(*) AS n, count(*) FILTER (ok) AS passed FROM ({_rows}) GROUP BY 1, 2")
def q_task_checks(spark: SparkSession, sf: str) -> DataFrame:
    """How many plans pass each check of three tasks."""
    out = None
    for task in _checks:
        one = checkers.check(plans(spark, sf), task).select(F.lit(task).alias("task"), F.col("check").alias("check_name"), "ok")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("task", "check_name").agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"))


@query(f"""WITH n AS ({PLAN}), a AS (SELECT plan, bool_or(method LIKE '%SMD%') AS wet, {_has('run_freq_job')} AS freq, {_has('run_sp_energy')} AS sp, {_has('run_opt_job')} AS opt, count(*) FILTER (tool = 'run_sp_energy') AS n_sp FROM n WHERE kind = 'tool' GROUP BY 1)
  SELECT plan, 'pka' AS task, wet AS first_ok, freq AND NOT sp AS second_ok FROM a UNION ALL SELECT plan, 'sp', NOT freq, n_sp >= 3 FROM a""")
def q_audit_chemistry(spark: SparkSession, sf: str) -> DataFrame:
    """Whether plans compute the right thing: a solvent and frequencies for a pKa, enough single points."""
    out = None
    for task, one, two in (("pka", "solvation_in_method", "freq_not_sp"), ("sp", "no_needless_freq", "single_sp_per_compound")):
        told = checkers.audit(plans(spark, sf), task).groupBy("plan").agg(*(F.bool_or(F.when(F.col("check") == c, F.col("ok"))).alias(n) for c, n in ((one, "first_ok"), (two, "second_ok"))))
        told = told.select("plan", F.lit(task).alias("task"), "first_ok", "second_ok")
        out = told if out is None else out.unionByName(told)
    return out


@query("""WITH a AS (SELECT user_id AS run, CASE event_type WHEN 'click' THEN 'pka_acid' WHEN 'view' THEN 'G_acid_eh' ELSE 'E_total' END AS name, CASE WHEN event_type = 'click' THEN value - 20 ELSE -value END AS number FROM events)
  SELECT run, count(*) FILTER (name = 'pka_acid') > 0 AS pka_present, coalesce(bool_or(name = 'pka_acid' AND number > -20 AND number < 60), false) AS pka_reasonable, count(*) FILTER (name = 'G_acid_eh') >= 2 AS G_eh_present, count(*) FILTER (name = 'G_acid_eh' AND NOT number < 0) = 0 AS G_negative, count(*) FILTER (name = 'E_total') > 0 AS energy_present FROM a GROUP BY 1""")
def q_result_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of what runs left, one column each."""
    t = F.col("event_type")
    name = F.when(t == "click", "pka_acid").when(t == "view", "G_acid_eh").otherwise("E_total")
    a = table(spark, sf, "events").select(F.col("user_id").alias("run"), name.alias("name"), F.when(t == "click", F.col("value") - 20).otherwise(-F.col("value")).alias("number"), F.lit(None).cast("array<map<string,string>>").alias("items"))
    told = checkers.check_results(a, "pka").unionByName(checkers.check_results(a, "sp").where("check = 'energy_present'"))
    names = ["pka_present", "pka_reasonable", "G_eh_present", "G_negative", "energy_present"]
    return told.groupBy("run").agg(*(F.bool_or(F.when(F.col("check") == n, F.col("ok"))).alias(n) for n in names))


@query("SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{task}'" for task, words in checkers.KEYWORDS.items()) + " ELSE 'struct' END AS task FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def q_detect_checker(spark: SparkSession, sf: str) -> DataFrame:
    """The first task whose words a text has."""
    return table(spark, sf, "documents").select("doc_id", checkers.detect(F.col("text")).alias("task"))


@query("""WITH res AS (SELECT user_id AS run, event_id AS pos, event_type AS field, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS value FROM events), w AS (SELECT DISTINCT user_id AS run, f AS field FROM events, (VALUES ('click'), ('view'), ('never')) v(f))
  SELECT w.run, w.field, arg_min(value, pos) FILTER (value IS NOT NULL) AS value FROM w LEFT JOIN res ON res.run = w.run AND res.field = w.field GROUP BY 1, 2""")
def q_final_report(spark: SparkSession, sf: str) -> DataFrame:
    """Each field asked for, from the first result of the run that has it."""
    from ..plans import artifacts

    e = table(spark, sf, "events")
    results = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), F.col("event_type").alias("field"), F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).alias("value"))
    wanted = e.select(F.col("user_id").alias("run")).distinct().withColumn("field", F.explode(F.array(*map(F.lit, ("click", "view", "never")))))
    return artifacts.collected(results, wanted)


@query(f"WITH n AS (SELECT plan, pos, 'g' || pos % 2 AS id FROM ({PLAN})) SELECT plan, pos, CASE WHEN k > 1 THEN id || '_' || k ELSE id END AS id FROM (SELECT *, row_number() OVER (PARTITION BY plan, id ORDER BY pos) AS k FROM n)")
def q_dup_fix(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that a plan has more than once, made different."""
    nodes = plans(spark, sf).withColumn("id", F.concat(F.lit("g"), (F.col("pos") % 2).cast("string")))
    return checkers.duplicates_fixed(nodes).select("plan", "pos", "id")


@query("SELECT user_id, event_id, ts, lead(event_id) OVER w AS next_event, event_id - lag(event_id) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def q_lead_lag(spark: SparkSession, sf: str) -> DataFrame:
    """The next row of a group, and the distance from the one before."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("user_id", "event_id", "ts", F.lead("event_id").over(w).alias("next_event"), (F.col("event_id") - F.lag("event_id").over(w)).alias("gap"))
