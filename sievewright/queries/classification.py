"""Filters, predicates and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..registry import query, table
from .records import records, sql


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def listed(values) -> str:
    return f"[{quoted(values)}]"


E = "coalesce(elements, [])"
HEAVY_SQL, TM_SQL, OPEN_SQL = f"list_has_any({E}, {listed(C.HEAVY)})", f"list_has_any({E}, {listed(C.TM)})", f"list_has_any({E}, {listed(C.OPEN_SHELL_TM)})"
SYSTEM_SQL = f"CASE WHEN {HEAVY_SQL} THEN 'heavy_elem' WHEN {TM_SQL} AND (multiplicity > 1 OR {OPEN_SQL}) THEN 'TM_open' WHEN {TM_SQL} THEN 'TM_closed' ELSE 'organic' END"
CELL_SQL = f"CASE WHEN method_family = 'CASSCF' THEN 'rag_casscf' WHEN task_type IN ({quoted(C.PROTOCOL_TASKS)}) THEN 'rag_protocol' WHEN {SYSTEM_SQL} <> 'organic' THEN 'metal_general' WHEN task_type = 'TDDFT' THEN 'organic_TDDFT' ELSE 'organic_general' END"
ATOMS_SQL = "coalesce(nullif(n_atoms, 0), nullif(n_sites_index, 0))"
SCALE_SQL = f"CASE WHEN {ATOMS_SQL} IS NULL THEN 'unknown' WHEN {ATOMS_SQL} <= 10 THEN 'S' WHEN {ATOMS_SQL} <= 30 THEN 'M' WHEN {ATOMS_SQL} <= 100 THEN 'L' ELSE 'XL' END"


@query(sql("SELECT entry_id, functional FROM r WHERE functional IS NULL OR functional NOT IN ('LDA')"))
def q_filter_functional(spark: SparkSession, sf: str) -> DataFrame:
    """Exact case; a null functional is kept."""
    return records(spark, sf).where(F.coalesce(~F.col("functional").isin("LDA"), F.lit(True))).select("entry_id", "functional")


@query(sql("SELECT entry_id, basis FROM r WHERE upper(trim(coalesce(basis, ''))) NOT IN ('GEN', 'GENECP', 'CHKBAS', 'CHECKPOINT')"))
def q_filter_basis_token(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).where(~F.upper(F.trim(F.coalesce("basis", F.lit("")))).isin("GEN", "GENECP", "CHKBAS", "CHECKPOINT")).select("entry_id", "basis")


@query(sql(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {CELL_SQL} IN ('rag_casscf', 'rag_protocol') THEN 'rag_only' WHEN functional = 'LDA' THEN 'excluded'
  WHEN functional <> '' AND functional NOT IN ('B3LYP', 'PBE', 'BP86', 'MP2') THEN 'vocabulary' WHEN basis IS NULL THEN 'quality' ELSE 'kept' END AS reason FROM r) GROUP BY 1"""))
def q_filter_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """What drops each record, first rule that holds, counted in one pass."""
    r = records(spark, sf)
    cell = C.cell(C.system_type(F.col("elements"), F.col("multiplicity")), F.col("task_type"), F.col("method_family"))
    f = F.col("functional")
    reason = C.first_match([(cell.isin("rag_casscf", "rag_protocol"), "rag_only"), (f == "LDA", "excluded"), ((f != "") & ~f.isin("B3LYP", "PBE", "BP86", "MP2"), "vocabulary"), (F.col("basis").isNull(), "quality")], "kept")
    return r.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(sql("SELECT entry_id, functional FROM r WHERE upper(functional) IS NULL OR upper(functional) NOT IN (SELECT upper(functional) FROM r WHERE functional IS NOT NULL GROUP BY 1 HAVING count(*) < (SELECT count(*) / 15.0 FROM r))"))
def q_filter_rare(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of rare classes go, before any split; spellings that differ by case are one class."""
    r = records(spark, sf)
    total = r.count()
    rare = r.where("functional is not null").groupBy(F.upper("functional").alias("rare")).count().where(F.col("count") < total / 15.0).select("rare")
    return r.join(rare, F.upper("functional") == F.col("rare"), "left_anti").select("entry_id", "functional")


CHEAP_SQL = f"coalesce(functional, '') <> '' AND coalesce(basis, '') <> '' AND NOT regexp_matches(functional, '{C.COSTLY_METHOD}') AND NOT regexp_matches(basis, '{C.COSTLY_BASIS}')"


@query(sql(f"SELECT entry_id, coalesce({CHEAP_SQL}, false) AS is_cheap FROM r"))
def q_partition_cheap(spark: SparkSession, sf: str) -> DataFrame:
    """Cheap and costly jobs in one pass."""
    return records(spark, sf).select("entry_id", C.is_cheap(F.col("functional"), F.col("basis")).alias("is_cheap"))


@query(sql("SELECT entry_id, array_to_string(CASE WHEN method_family = 'CCSD' THEN list_filter(split(note, ' '), lambda x: x <> 'red') ELSE split(note, ' ') END, '|') AS warnings FROM r"))
def q_fix_warning(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split("note", " ")
    return records(spark, sf).select("entry_id", F.array_join(F.when(F.col("method_family") == "CCSD", F.array_remove(w, "red")).otherwise(w), "|").alias("warnings"))


@query(sql(f"SELECT entry_id, {TM_SQL} AS has_tm, multiplicity > 1 AS is_open_shell, {SYSTEM_SQL} AS system_type, {CELL_SQL} AS cell, list_has_any({E}, {listed([*C.TM, *C.HEAVY])}) AS is_metal FROM r"))
def q_classify_system(spark: SparkSession, sf: str) -> DataFrame:
    e, m = F.col("elements"), F.col("multiplicity")
    system = C.system_type(e, m)
    return records(spark, sf).select("entry_id", C.has_tm(e).alias("has_tm"), (m > 1).alias("is_open_shell"), system.alias("system_type"), C.cell(system, F.col("task_type"), F.col("method_family")).alias("cell"), C.is_metal(e).alias("is_metal"))


@query(sql(f"SELECT specialist_cell AS old_cell, {CELL_SQL} AS new_cell, count(*) AS n FROM r GROUP BY 1, 2"))
def q_reclassify(spark: SparkSession, sf: str) -> DataFrame:
    """Old labels against labels worked out again."""
    cell = C.cell(C.system_type(F.col("elements"), F.col("multiplicity")), F.col("task_type"), F.col("method_family"))
    return records(spark, sf).groupBy(F.col("specialist_cell").alias("old_cell"), cell.alias("new_cell")).agg(F.count("*").alias("n"))


@query(sql(f"SELECT {SCALE_SQL} AS scale, count(*) AS n, CAST(sum({ATOMS_SQL}) AS BIGINT) AS atoms FROM r GROUP BY 1"))
def q_scale_bucket(spark: SparkSession, sf: str) -> DataFrame:
    n = C.atoms(F.col("n_atoms"), F.col("n_sites_index"))
    return records(spark, sf).withColumn("n", n).groupBy(C.scale_bucket(F.col("n")).alias("scale")).agg(F.count("*").alias("n"), F.sum("n").cast("long").alias("atoms"))


@query(sql("""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN c IS NULL THEN NULL WHEN c <= -2 THEN '<= -2' WHEN c = -1 THEN '-1' WHEN c = 0 THEN '0 (neutral)' WHEN c = 1 THEN '+1' ELSE '>= +2' END AS bucket
  FROM (SELECT TRY_CAST(regexp_extract(t, 'charge=(-?\\d+)', 1) AS INT) AS c FROM (SELECT CASE WHEN entry_id LIKE '%7' THEN 'none' ELSE 'atoms=3, charge=' || charge || ', mult=1' END AS t FROM r))) GROUP BY 1"""))
def q_charge_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """The charge is read out of a prompt's text."""
    text = F.when(F.col("entry_id").like("%7"), "none").otherwise(F.concat(F.lit("atoms=3, charge="), F.col("charge").cast("string"), F.lit(", mult=1")))
    return records(spark, sf).groupBy(C.charge_bucket(text).alias("bucket")).agg(F.count("*").alias("n"))


FAMILY = {"PBE0": "PBE0-family", "B3LYP": "B3-family"}
_spell = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in C.SPELLING.items())
_family = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FAMILY.items())


@query(sql(f"""SELECT entry_id, CASE WHEN fixed IN ('LDA') THEN NULL ELSE CASE fixed {_family} ELSE fixed END END AS canonical FROM (SELECT entry_id, CASE functional {_spell} ELSE functional END AS fixed FROM r)"""))
def q_canon_map(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("entry_id", C.canonical(F.col("functional"), C.SPELLING, ["LDA"], FAMILY).alias("canonical"))


@query(sql(f"""SELECT entry_id, canonical FROM (SELECT entry_id, functional, CASE WHEN fixed IN ('LDA') THEN NULL ELSE fixed END AS canonical FROM (SELECT entry_id, functional, CASE functional {_spell} ELSE functional END AS fixed FROM r))
  WHERE canonical IS NOT NULL OR functional IS NULL OR functional = ''"""))
def q_canon_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Excluded functionals go, records without one stay."""
    c = records(spark, sf).withColumn("canonical", C.canonical(F.col("functional"), C.SPELLING, ["LDA"], {"": ""}))
    return c.where(F.col("canonical").isNotNull() | F.col("functional").isNull() | (F.col("functional") == "")).select("entry_id", "canonical")


@query(sql("SELECT entry_id, regexp_replace(trim(basis), '(?i)def2([A-Z])', 'def2-\\1', 'g') AS basis FROM r"))
def q_normalize_basis(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("entry_id", C.normalize_basis(F.col("basis")).alias("basis"))


@query(sql("""SELECT entry_id, coalesce(string_agg(x || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END, '' ORDER BY CASE x WHEN 'C' THEN 0 WHEN 'H' THEN 1 ELSE 2 END, x), '') AS formula
  FROM (SELECT entry_id, x, count(x) AS n FROM (SELECT entry_id, unnest(CASE WHEN elements IS NULL THEN [NULL] ELSE elements END) AS x FROM r) GROUP BY 1, 2) GROUP BY 1"""))
def q_hill_formula(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("entry_id", C.hill_formula(F.col("elements")).alias("formula"))


LABEL_SQL = f"""CASE WHEN basis IS NULL OR trim(basis) = '' THEN 'null' WHEN upper(replace(trim(basis), ' ', '')) IN ({quoted(C.PLACEHOLDERS)}) THEN 'placeholder' WHEN upper(replace(trim(basis), ' ', '')) IN ({quoted(C.FUNCTIONAL_TOKENS)}) THEN 'functional'
  WHEN regexp_matches(trim(basis), '{C.BASIS_PATTERN}') THEN 'ok' WHEN regexp_matches(trim(basis), '{C.ARTIFACT_PATTERN}') THEN 'artifact' ELSE 'unknown' END"""


@query(sql(f"""SELECT cell, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY cell), 6) AS pct FROM (SELECT coalesce(specialist_cell, '-') AS cell, {LABEL_SQL} AS label, count(*) AS n FROM r GROUP BY 1, 2)"""))
def q_audit_report(spark: SparkSession, sf: str) -> DataFrame:
    """Validity of basis labels by cell, with shares."""
    from pyspark.sql import Window

    n = records(spark, sf).groupBy(F.coalesce("specialist_cell", F.lit("-")).alias("cell"), C.label_class(F.col("basis")).alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("cell")), 6))


@query(sql(f"SELECT entry_id, {LABEL_SQL} AS label FROM r"))
def q_classify_label(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("entry_id", C.label_class(F.col("basis")).alias("label"))


@query(sql(f"""SELECT entry_id, CASE WHEN n <= 30 THEN 'mechanism_1_rare_precedent (n=' || n || ')' WHEN functional IN ({quoted(C.WAVEFUNCTION)}) THEN 'mechanism_2_popular_suboptimal_wf' WHEN functional IN ({quoted(C.PURE_GGA)}) THEN 'mechanism_3_common_gga_bias' ELSE 'unclassified_worse' END AS mechanism
  FROM (SELECT r.*, coalesce(f.n, 0) AS n FROM r LEFT JOIN (SELECT specialist_cell, functional, basis, count(*) AS n FROM r WHERE functional <> '' AND basis <> '' GROUP BY ALL) f USING (specialist_cell, functional, basis)) WHERE functional IS NOT NULL"""))
def q_classify_failure(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    freq = r.where("functional <> '' and basis <> ''").groupBy("specialist_cell", "functional", "basis").agg(F.count("*").cast("int").alias("n"))
    return r.where("functional is not null").join(freq, ["specialist_cell", "functional", "basis"], "left").select("entry_id", C.failure_class(F.col("n"), F.col("functional"), 30).alias("mechanism"))


@query(sql(f"""SELECT entry_id, CASE WHEN NOT regexp_matches(functional, '{C.CORRELATED}') THEN 'not_applicable' WHEN coalesce(m.aux, '') <> '' THEN 'precedent' ELSE 'autoaux_fallback' END AS aux_plan
  FROM r LEFT JOIN (SELECT functional, basis, aux_basis AS aux FROM (SELECT functional, basis, aux_basis, count(*) AS n FROM r WHERE functional <> '' AND basis <> '' AND aux_basis <> '' AND charge > 0 GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY functional, basis ORDER BY n DESC, aux_basis) = 1) m USING (functional, basis) WHERE functional IS NOT NULL"""))
def q_classify_aux(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent auxiliary basis of a pair as precedent."""
    from ..determinism import mode

    r = records(spark, sf)
    seen = mode(r.where("functional <> '' and basis <> '' and aux_basis <> '' and charge > 0"), ["functional", "basis"], ["aux_basis"]).select("functional", "basis", F.col("aux_basis").alias("aux"))
    return r.where("functional is not null").join(seen, ["functional", "basis"], "left").select("entry_id", C.aux_plan(F.col("functional"), F.col("aux")).alias("aux_plan"))


PLAN_SQL = "CASE charge WHEN -2 THEN 'not_applicable' WHEN -1 THEN 'precedent' ELSE 'autoaux_fallback' END"
STATUS_SQL = "CASE multiplicity WHEN 1 THEN 'ok' ELSE 'error' END"
ERROR_SQL = "CASE WHEN multiplicity = 2 THEN 'Error: Please provide an AuxC basis' WHEN multiplicity = 3 AND charge > 0 THEN 'Error (MAIN): aborting' END"


@query(sql(f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p = 'not_applicable' THEN p WHEN s = 'ok' THEN p || '_ok' WHEN regexp_matches(coalesce(e, ''), '{C.AUX_ERROR}') THEN p || '_failed' ELSE p || '_unrelated_error' END AS outcome
  FROM (SELECT {PLAN_SQL} AS p, {STATUS_SQL} AS s, {ERROR_SQL} AS e FROM r)) GROUP BY 1"""))
def q_outcome_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = records(spark, sf).selectExpr(f"{PLAN_SQL} AS p", f"{STATUS_SQL} AS s", f"{ERROR_SQL} AS e")
    return c.groupBy(C.outcome(F.col("p"), F.col("s"), F.col("e")).alias("outcome")).agg(F.count("*").alias("n"))


LOGS = ["INPUT ERROR: scf not converged", "the SCF NOT CONVERGED after 125 cycles", "failed to converge", "***imaginary mode*** -45", "CASSCF step 3 not converged", "the CAS procedure has not converged", "ok", ""]
LOG_SQL = "CASE CAST(p_partkey AS BIGINT) % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(LOGS)) + " END"


@query(f"""SELECT p_partkey, CASE WHEN u LIKE '%INPUT ERROR%' THEN 'INPUT_ERROR' WHEN u LIKE '%SCF NOT CONVERGED%' OR u LIKE '%FAILED TO CONVERGE%' THEN 'SCF_NOT_CONVERGED' WHEN u LIKE '%***IMAGINARY MODE***%' THEN 'IMAG_FREQ'
  WHEN u LIKE '%THE CAS PROCEDURE HAS NOT CONVERGED%' OR u LIKE '%CASSCF%' AND u LIKE '%NOT CONVERGED%' THEN 'CASSCF_NOT_CONVERGED' END AS code FROM (SELECT p_partkey, upper({LOG_SQL}) AS u FROM part)""")
def q_classify_error(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", C.error_code(F.expr(LOG_SQL)).alias("code"))


PAYLOADS = ["INPUT ERROR", "imaginary freq at -20", "casscf is not converged", "bad geometry", "time limit reached", "resource", "scf not converged", "nothing"]
PAYLOAD_SQL = "CASE CAST(p_partkey AS BIGINT) % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(PAYLOADS)) + " END"


@query(f"""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'SERVER_CODE' WHEN p_size % 10 = 1 THEN 'RESOURCE_LIMIT' WHEN u LIKE '%INPUT ERROR%' THEN 'INPUT_ERROR' WHEN u LIKE '%SCF NOT CONVERGED%' THEN 'SCF_NOT_CONVERGED'
  WHEN u LIKE '%IMAGINARY%' AND (u LIKE '%MODE%' OR u LIKE '%FREQ%') THEN 'IMAG_FREQ' WHEN u LIKE '%CASSCF%' AND u LIKE '%NOT CONVERGED%' THEN 'CASSCF_NOT_CONVERGED' WHEN u LIKE '%GEOM%' AND (u LIKE '%INVALID%' OR u LIKE '%FAILED%' OR u LIKE '%BAD%') THEN 'GEOM_INVALID'
  WHEN u LIKE '%RESOURCE%' OR u LIKE '%TIME LIMIT%' THEN 'RESOURCE_LIMIT' WHEN p_size > 40 THEN 'IMAG_FREQ' END AS code FROM (SELECT p_partkey, p_size, upper({PAYLOAD_SQL}) AS u FROM part)""")
def q_infer_error(spark: SparkSession, sf: str) -> DataFrame:
    """Code, status, texts, then the modes of a result; a mode below -10 stands for p_size > 40 here."""
    size = F.col("p_size")
    modes = F.when(size > 40, F.array(F.lit(5.0), -size.cast("double"))).otherwise(F.array(F.lit(-3.0)))
    code = C.payload_error_code(F.when(size % 10 == 0, "SERVER_CODE"), F.when(size % 10 == 1, "timeout").otherwise("error"), F.expr(PAYLOAD_SQL), F.exists(modes, lambda x: x < -10))
    return table(spark, sf, "part").select("p_partkey", code.alias("code"))


TEXTS = ["UV-Vis of water", "find the transition state", "a ts search", "relaxed scan", "wiberg index", "nmr shifts aqueous", "pka of acid", "optimise", "optimize it", "energy"]
TEXT_SQL = "CASE CAST(p_partkey AS BIGINT) % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEXTS)) + " END"
_tasks = " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{task}'" for task, words in C.TASK_KEYWORDS)


@query(f"SELECT p_partkey, CASE {_tasks} ELSE 'SP' END AS task, CASE WHEN contains(t, 'water') OR contains(t, 'aqueous') THEN 'water' END AS solvent FROM (SELECT p_partkey, ' ' || lower({TEXT_SQL}) || ' ' AS t FROM part)")
def q_query_from_text(spark: SparkSession, sf: str) -> DataFrame:
    """Task and solvent guessed from a request."""
    t = F.expr(TEXT_SQL)
    return table(spark, sf, "part").select("p_partkey", C.guess_task(t).alias("task"), C.guess_solvent(t).alias("solvent"))


HINTS = {"red": "colour", "blue": "colour2", "part": "thing", "large": "size"}


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(p_name), '\\b{k}\\b') THEN '{v}'" for k, v in HINTS.items()) + " END AS hint FROM part")
def q_extract_hints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", C.first_keyword(F.col("p_name"), HINTS).alias("hint"))


RULES = [(30, "open", "multiplicity > 1"), (10, "metal", "list:metal"), (20, "charged", "charge <> 0"), (90, "default", "1 = 1")]
METAL_SQL = f"list_has_any({E}, {listed([*C.TM, *C.HEAVY])})"


@query(sql(f"SELECT entry_id, CASE WHEN {METAL_SQL} THEN 'metal ' || entry_id WHEN charge <> 0 THEN 'charged ' || entry_id WHEN multiplicity > 1 THEN 'open ' || entry_id ELSE 'default ' || entry_id END AS rendered, array_to_string(list_filter([CASE WHEN {METAL_SQL} THEN 'metal' END, CASE WHEN charge <> 0 THEN 'charged' END, CASE WHEN multiplicity > 1 THEN 'open' END, 'default'], lambda x: x IS NOT NULL), ',') AS skills FROM r"))
def q_template_match(spark: SparkSession, sf: str) -> DataFrame:
    """Rules by priority: the first that matches renders a text, and the names of all that match."""
    conditions = [(p, name, C.is_metal(F.col("elements")) if rule.startswith("list:") else F.expr(rule)) for p, name, rule in sorted(RULES)]
    rendered = C.first_match([(c, F.concat(F.lit(name + " "), F.col("entry_id"))) for _, name, c in conditions])
    skills = F.array_join(F.array_compact(F.array(*(F.when(c, name) for _, name, c in conditions))), ",")
    return records(spark, sf).select("entry_id", rendered.alias("rendered"), skills.alias("skills"))


@query(sql(f"""SELECT entry_id, 'System: ' || coalesce(array_to_string(list_sort(list_distinct(elements)), ''), '?') || ', ' || coalesce(CAST(n_atoms AS VARCHAR), 'None') || ' atoms, charge ' || charge || ', ' || task_type AS prompt,
  coalesce(array_to_string(list_filter(['functional=' || nullif(functional, ''), 'basis=' || nullif(trim(basis), ''), 'solvent=' || nullif(solvent, ''), 'dispersion=' || dispersion], lambda x: x IS NOT NULL), ';'), '') AS gold,
  array_to_string(list_concat(list_transform(list_sort(list_distinct({E})), lambda x: 'elem_' || x), ['task_' || coalesce(task_type, 'unknown'), 'scale_' || {SCALE_SQL}, 'charge_' || charge, 'mult_' || multiplicity, 'solvent_' || coalesce(nullif(solvent, ''), 'none')]), ' ') AS tokens FROM r"""))
def q_user_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt, the parameters that are set, and the tokens a record is indexed by."""
    from ..operators.retrieval import record_tokens

    kinds = F.array_sort(F.array_distinct("elements"))
    prompt = F.concat(F.lit("System: "), F.coalesce(F.array_join(kinds, ""), F.lit("?")), F.lit(", "), F.coalesce(F.col("n_atoms").cast("string"), F.lit("None")), F.lit(" atoms, charge "), F.col("charge").cast("string"), F.lit(", "), F.col("task_type"))
    fields = {"functional": F.nullif("functional", F.lit("")), "basis": F.nullif(F.trim("basis"), F.lit("")), "solvent": F.nullif("solvent", F.lit("")), "dispersion": F.col("dispersion")}
    gold = F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    shown = F.array_join(F.transform(F.map_entries(gold), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return records(spark, sf).select("entry_id", prompt.alias("prompt"), shown.alias("gold"), F.array_join(record_tokens(), " ").alias("tokens"))
