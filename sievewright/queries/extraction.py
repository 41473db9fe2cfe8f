"""Records out of logs. Logs are made from tables, so what is read back can be told from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..registry import query, table


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """A log for each user, a line for each of its events, in order."""
    v = F.format_string("%.6f", F.col("value"))
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("FINAL SINGLE POINT ENERGY     -"), v)).when(F.col("event_type") == "view", F.concat(F.lit("Total Enthalpy      ...   -"), v, F.lit(" Eh"))).when(F.col("event_type") == "purchase", F.concat(F.lit("Magnitude (Debye)      :      "), v)).otherwise(F.concat(F.lit("E[SA-CASSCF] ROOT  "), (F.col("event_id") % 3).cast("string"), F.lit(" :  -"), v, F.lit(" Eh")))
    rows = table(spark, sf, "events").select("user_id", "event_id", line.alias("line"))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("log"))


TEXT = "CAST(printf('%.6f', value) AS DOUBLE)"


@query(f"""SELECT user_id, max_by(-{TEXT}, event_id) FILTER (event_type = 'click') AS energy, min_by(-{TEXT}, event_id) FILTER (event_type = 'click') AS first_energy, max_by(-{TEXT}, event_id) FILTER (event_type = 'view') AS enthalpy,
  max_by({TEXT}, event_id) FILTER (event_type = 'purchase') AS dipole, min_by({TEXT}, event_id) FILTER (event_type = 'purchase') AS first_dipole FROM events GROUP BY 1""")
def q_extract_last(spark: SparkSession, sf: str) -> DataFrame:
    """Last and first occurrences in a log."""
    t = F.col("log")
    return logs(spark, sf).select("user_id", X.total_energy(t).alias("energy"), X.first_energy(t).alias("first_energy"), X.enthalpy(t).alias("enthalpy"), X.dipole(t).alias("dipole"), X.dipole(t, True).alias("first_dipole"))


@query(f"""SELECT user_id, count(*) AS n, round(sum(e), 4) AS total, round(min_by(e, root), 6) AS lowest FROM (SELECT user_id, event_id % 3 AS root, max_by(-{TEXT}, event_id) AS e FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1, 2) GROUP BY 1""")
def q_extract_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Energies by root, the last one told for each."""
    r = X.root_energies(F.col("log"))
    return logs(spark, sf).select("user_id", r.alias("r")).where(F.size("r") > 0).select("user_id", F.size("r").cast("long").alias("n"), F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.col("r")[0], 6).alias("lowest"))


def orders_log(spark: SparkSession, sf: str) -> DataFrame:
    """For each order a log with two charge blocks, two orbital blocks, modes and states."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_extendedprice")
    lines = F.array_sort(F.collect_list(F.struct("l_partkey", "l_quantity", "l_discount", "l_extendedprice")))
    o = l.groupBy("l_orderkey").agg(lines.alias("p"))
    q = lambda x: F.format_string("%.2f", x)
    charges = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("   "), i.cast("string"), F.lit(" C  :   -"), q(x["l_discount"]))), "\n")
    orbitals = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("   "), i.cast("string"), F.lit("   "), F.when(i < 2, "2.0000").otherwise("0.0000"), F.lit("   -1.0   "), q(x["l_quantity"] * (i + 1)))), "\n")
    modes = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("  "), i.cast("string"), F.lit(":   "), q(x["l_quantity"] * 3), F.lit("   0.1   "), q(x["l_discount"]), F.lit("  x"))), "\n")
    states = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("  0-1A  ->  "), (i + 1).cast("string"), F.lit("-1A    4.07   32889.5   "), q(x["l_quantity"] * 10), F.lit("   "), q(x["l_discount"]), F.lit("   0.1"))), "\n")
    text = F.concat(F.lit("MULLIKEN ATOMIC CHARGES\n------\n   9 X  :  9.9\n\nORBITAL ENERGIES\n----\n   0   2.0000   1.0   1.0\n   1   0.0000   1.0   77.0\n***\nMULLIKEN ATOMIC CHARGES\n------\n"), charges, F.lit("\nSum of atomic charges: 0\n\nORBITAL ENERGIES\n----------------\n  NO   OCC   E(Eh)   E(eV)\n"), orbitals, F.lit("\n\n   1:      -205.12 cm**-1 ***imaginary mode***\nIR SPECTRUM\n------\n"), modes, F.lit("\n\nABSORPTION SPECTRUM VIA TRANSITION ELECTRIC DIPOLE MOMENTS\n-----\n"), states, F.lit("\n----------\n****ORCA TERMINATED NORMALLY****\n"))
    return o.select("l_orderkey", text.alias("log"))


NUMBERED = "p AS (SELECT l_orderkey, l_quantity AS q, l_discount AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity, l_discount, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


@query(f"""WITH {NUMBERED} SELECT l_orderkey, CAST(any_value(n) AS BIGINT) AS n_atoms, round(-sum(d), 4) AS charge, CASE WHEN any_value(n) > 2 THEN round(max(q * 3) FILTER (i = 2) - max(q * 2) FILTER (i = 1), 6) END AS gap,
  count(*) FILTER (q * 3 > 10 AND i <> 1) + 1 AS n_modes, CAST(count(*) AS BIGINT) AS n_states, round(arg_max(q * 10, struct_pack(d := d, k := -i)), 2) AS brightest, 'ok' AS status FROM p GROUP BY 1""")
def q_extract_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Charges, orbital gap, modes and states out of the last blocks of a log."""
    t = F.col("log")
    rows = orders_log(spark, sf).select("l_orderkey", X.charges(t).alias("c"), X.gap(t).alias("gap"), X.vibrations(t).alias("v"), X.excited_states(t).alias("s"), X.status(t)["status"].alias("status"))
    bright = F.array_max(F.transform("s", lambda s: F.struct(s["fosc"].alias("f"), (-s["state"]).alias("k"), s["nm"].alias("nm"))))["nm"]
    return rows.select("l_orderkey", F.size("c").cast("long").alias("n_atoms"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x["charge"]), 4).alias("charge"), "gap", F.size("v").cast("long").alias("n_modes"), F.size("s").cast("long").alias("n_states"), F.round(bright, 2).alias("brightest"), "status")


@query("SELECT user_id, min_by(event_id, struct_pack(v := value, k := event_id)) AS argmin, max_by(event_id, struct_pack(v := value, k := -event_id)) AS argmax, round(max(value) - min(value), 6) AS span FROM events GROUP BY 1")
def q_argminmax(spark: SparkSession, sf: str) -> DataFrame:
    """Least and greatest step, the first of equals."""
    k = F.col("event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by(k, F.struct("value", k)).alias("argmin"), F.max_by(k, F.struct(F.col("value"), -k)).alias("argmax"), F.round(F.max("value") - F.min("value"), 6).alias("span"))


@query("SELECT event_id, user_id, round((value - min(value) OVER (PARTITION BY user_id)) * 627.509474, 3) AS relative FROM events")
def q_relative_min(spark: SparkSession, sf: str) -> DataFrame:
    """Energies relative to the group's least."""
    return table(spark, sf, "events").select("event_id", "user_id", F.round((F.col("value") - F.min("value").over(Window.partitionBy("user_id"))) * 627.509474, 3).alias("relative"))


@query("""SELECT conv_id, session, count(*) AS turns, min(turn) AS first_turn FROM (SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS session FROM conversations) GROUP BY 1, 2""")
def q_sessionise_marker(spark: SparkSession, sf: str) -> DataFrame:
    """Rows between markers get the marker's number."""
    n = F.sum((F.col("role") == "user").cast("long")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").withColumn("session", n).groupBy("conv_id", "session").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, nullif(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '') AS heading FROM pages""")
def q_extract_regex(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.nullif(F.regexp_extract(h, "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.size(X.matches(h, "<p>")).cast("long").alias("paragraphs"), F.regexp_extract(h, 'lang="([a-z]+)"', 1).alias("lang"), F.nullif(F.regexp_extract(h, "(?s)<h1>(.*?)</h1>", 1), F.lit("")).alias("heading"))


@query(r"SELECT url, CASE WHEN clean = '' THEN 'job' ELSE clean END AS label FROM (SELECT url, trim(regexp_replace(regexp_replace(replace(trim(url), ' ', '_'), '[^A-Za-z0-9_.-]+', '_', 'g'), '_+', '_', 'g'), '_') AS clean FROM pages)")
def q_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("url", X.sanitized(F.col("url")).alias("label"))


@query("SELECT doc_id, CASE WHEN k = 1 THEN name ELSE name || '__dup' || (k - 1) END AS stem FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE upper(source) END AS name, row_number() OVER (PARTITION BY lower(source), doc_id % 50 ORDER BY doc_id) AS k FROM documents)")
def q_dedup_stem(spark: SparkSession, sf: str) -> DataFrame:
    """Names that differ by case only get numbers; here within 50 batches."""
    name = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.upper("source"))
    k = F.row_number().over(Window.partitionBy(F.lower("source"), F.col("doc_id") % 50).orderBy("doc_id"))
    return table(spark, sf, "documents").withColumn("k", k).select("doc_id", F.when(F.col("k") == 1, name).otherwise(F.concat(name, F.lit("__dup"), (F.col("k") - 1).cast("string"))).alias("stem"))


@query("SELECT l_orderkey, l_partkey, l_quantity, rank FROM (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_extendedprice) AS rank FROM lineitem WHERE l_returnflag <> 'A') WHERE rank <= 3")
def q_eas_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Sites by charge, bad rows left out, the first three."""
    w = Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_partkey", "l_extendedprice")
    rows = table(spark, sf, "lineitem").where("l_returnflag <> 'A'").withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return rows.select("l_orderkey", "l_partkey", "l_quantity", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(substr(noisy, strpos(noisy, '{'), strpos(noisy, '}') - strpos(noisy, '{') + 1)) AS ok FROM (SELECT event_id, props, 'text ' || props || ' end' AS noisy FROM events)")
def q_get_path(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON block in noise, and a value by its path."""
    b = X.json_block(F.concat(F.lit("text "), F.col("props"), F.lit(" end")))
    return table(spark, sf, "events").select("event_id", F.get_json_object(b, "$.k").cast("long").alias("k"), b.isNotNull().alias("ok"))


def step_logs(spark: SparkSession, sf: str) -> DataFrame:
    """For each user a log of scan steps, an orbital block by spin, a Raman table and an end, from its events."""
    v = F.format_string("%.6f", F.col("value"))
    e = table(spark, sf, "events").select("user_id", "event_id", v.alias("v"))
    items = F.array_sort(F.collect_list(F.struct("event_id", "v")))
    rows = e.groupBy("user_id").agg(items.alias("p"))
    steps = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("RELAXED SURFACE SCAN STEP "), (i + 1).cast("string"), F.lit("\nCARTESIAN COORDINATES (ANGSTROEM)\n------\nC 0.0 0.0 9.9\n\nCARTESIAN COORDINATES (ANGSTROEM)\n------\nC 0.0 0.0 "), x["v"], F.lit("\n\nFINAL SINGLE POINT ENERGY  -"), x["v"])), "\n")
    levels = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("  "), i.cast("string"), F.when(i < 2, "  1.0000  -").otherwise("  0.0000  "), x["v"], F.lit("  1.0"))), "\n")
    raman = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("  "), i.cast("string"), F.lit(":  "), x["v"], F.lit("  2.5  0.7"))), "\n")
    head = F.lit("NO   OCC  E(Eh)  E(eV)\n")
    text = F.concat(steps, F.lit("\nORBITAL ENERGIES\n------\nSPIN UP ORBITALS\n"), head, levels, F.lit("\n\nRAMAN SPECTRUM\n-----\n Mode  freq  Activity  Depolarization\n-----\n"), raman, F.lit("\nThe end of it\n 99:  500.0  1.0  1.0\n"), F.when(F.col("user_id") % 3 == 0, "THE OPTIMIZATION HAS CONVERGED\n").otherwise(""), F.when(F.col("user_id") % 5 == 0, "SCF not converged").when(F.col("user_id") % 2 == 0, "****ORCA TERMINATED NORMALLY****").otherwise("ORCA TERMINATED NORMALLY"))
    return rows.select("user_id", text.alias("log"))


_NUMBERED = "p AS (SELECT user_id, CAST(printf('%.6f', value) AS DOUBLE) AS v, printf('%.6f', value) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"


@query(f"""WITH {_NUMBERED} SELECT user_id, count(*) AS n_steps, round(sum(v), 4) AS total, max(t) FILTER (i = 1) AS first_z, round(max(-v) FILTER (i <= 2), 6) AS homo, round(min(v) FILTER (i > 2), 6) AS lumo, true AS open_shell, count(*) FILTER (v > 10) AS n_raman FROM p GROUP BY 1""")
def q_extract_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Energies and geometries by step, orbitals by spin, and a Raman table out of one log."""
    t = F.col("log")
    rows = step_logs(spark, sf).select("user_id", X.scan_steps(t).alias("s"), X.scan_geometries(t).alias("g"), X.orbitals(t).alias("o"), X.raman(t).alias("r"))
    z = F.element_at(F.split(F.col("g")[0], " "), -1)
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a - x["energy"])
    return rows.select("user_id", F.size("g").cast("long").alias("n_steps"), F.round(total, 4).alias("total"), z.alias("first_z"), F.round("o.homo_eh", 6).alias("homo"), F.round("o.lumo_eh", 6).alias("lumo"), F.col("o.open_shell").alias("open_shell"), F.size("r").cast("long").alias("n_raman"))


@query("""WITH u AS (SELECT DISTINCT user_id, user_id % 5 = 0 AS failed, user_id % 2 = 0 AS even, user_id % 3 = 0 AS conv FROM events)
  SELECT user_id, CASE WHEN failed THEN 'error' WHEN conv THEN 'ok' ELSE 'not_converged' END AS status, NOT failed AS ok, NOT failed AND even AS strict_ok, failed OR even AS ok_agree, CASE WHEN failed THEN 'SCF_NOT_CONVERGED' END AS code, failed AS scf_agree FROM u""")
def q_status_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Two detectors of a normal end on the same logs."""
    rows = step_logs(spark, sf).select("user_id", X.convergence(F.col("log")).alias("status"), X.detectors(F.col("log")).alias("d"))
    return rows.select("user_id", "status", "d.ok", "d.strict_ok", "d.ok_agree", "d.code", "d.scf_agree")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL ELSE '{"a": "x}' || CAST(p_size AS VARCHAR) || '", "b": {"c": 1}}' END AS found FROM part""")
def q_json_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON object in thoughts, fences and chatter; braces in its strings don't close it."""
    obj = F.concat(F.lit('{"a": "x}'), F.col("p_size").cast("string"), F.lit('", "b": {"c": 1}}'))
    k = F.col("p_size") % 4
    text = F.when(k == 0, obj).when(k == 1, F.concat(F.lit("<think>{no}</think> ```json\n"), obj, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure: "), obj, F.lit(" and {more}"))).otherwise(F.concat(F.lit("cut "), F.substring(obj, 1, 12)))
    return table(spark, sf, "part").select("p_partkey", X.json_balanced(text).alias("found"))


@query("SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 150 WHEN user_id % 3 = 1 THEN 800 ELSE 200 END AS n_lines, CASE WHEN user_id % 3 = 0 THEN 'Summary of Natural Population Analysis' WHEN user_id % 3 = 1 THEN 'NBO analysis' ELSE 'line 1802' END AS head FROM (SELECT DISTINCT user_id FROM events)")
def q_extract_nbo(spark: SparkSession, sf: str) -> DataFrame:
    """The section of a population analysis, by its summary, its heading or the end of the log."""
    users = table(spark, sf, "events").select("user_id").distinct()
    k = F.col("user_id") % 3
    lines = F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.when((i == 300) & (k != 2), "NBO analysis").when((i == 700) & (k == 0), "Summary of Natural Population Analysis").otherwise(F.concat(F.lit("line "), (i + 1).cast("string"))))
    rows = users.select("user_id", X.population(F.array_join(lines, "\n")).alias("t"))
    return rows.select("user_id", F.size(F.split("t", "\n")).alias("n_lines"), F.split("t", "\n")[0].alias("head"))
