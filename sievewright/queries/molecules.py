"""Geometry: bonds, checks, hazards, sites and rigid placements of molecules made from `embeddings`.

A molecule has ten atoms: places from three components of a vector, elements by its id, among them a
metal (Fe) and an element that no table knows (Xx).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import sites as S
from ..registry import query, table

SYMBOLS = ["C", "H", "N", "O", "S", "Fe", "Xx"]
_symbol = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SYMBOLS))
ATOMS = f"""SELECT CAST(vec_id AS BIGINT) DIV 10 AS geom_id, CAST(vec_id AS BIGINT) % 10 AS idx, CASE CAST(vec_id AS BIGINT) % 7 {_symbol} END AS symbol,
  CAST(embedding[{{0}}] AS DOUBLE) * 12 AS x, CAST(embedding[{{1}}] AS DOUBLE) * 12 AS y, CAST(embedding[{{2}}] AS DOUBLE) * 12 AS z FROM embeddings"""


def _cases(values: dict, column: str, unknown: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{s}' THEN {values[s]}" for s in SYMBOLS if s in values) + f" ELSE {unknown} END"


RADII, VDW = (lambda c: _cases(G.COVALENT, c, G.UNKNOWN_COVALENT)), (lambda c: _cases(G.VAN_DER_WAALS, c, G.UNKNOWN_VDW))
DISTANCE = "sqrt(0.0 + pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
ATOMS_SQL = f"""atoms AS ({ATOMS.replace(' DIV ', ' // ').format(1, 2, 3)}),
  pr AS (SELECT a.geom_id, a.idx AS aidx, b.idx AS bidx, a.symbol AS asymbol, b.symbol AS bsymbol, {DISTANCE} AS d, {RADII('a.symbol')} + {RADII('b.symbol')} AS rc, {VDW('a.symbol')} + {VDW('b.symbol')} AS rv
    FROM atoms a JOIN atoms b ON a.geom_id = b.geom_id AND a.idx < b.idx),
  bd AS (SELECT * FROM pr WHERE d <= CASE WHEN asymbol = 'Fe' OR bsymbol = 'Fe' THEN 1.3 ELSE 1.2 END * rc),
  nb AS (SELECT geom_id, aidx AS centre, bidx AS other, bsymbol AS os FROM bd UNION ALL SELECT geom_id, bidx, aidx, asymbol FROM bd),
  dg AS (SELECT a.geom_id, a.idx, a.symbol, count(nb.other) AS degree FROM atoms a LEFT JOIN nb ON nb.geom_id = a.geom_id AND nb.centre = a.idx GROUP BY 1, 2, 3)"""
U, V = (f"sqrt(pow({s}.x-c.x,2)+pow({s}.y-c.y,2)+pow({s}.z-c.z,2))" for s in "ab")
ANGLE = f"degrees(acos(greatest(-1, least(1, ((a.x-c.x)*(b.x-c.x) + (a.y-c.y)*(b.y-c.y) + (a.z-c.z)*(b.z-c.z)) / {U} / {V}))))"
ANGLES_SQL = f"""{ATOMS_SQL}, an AS (SELECT p.geom_id, p.centre, p.other AS aidx, q.other AS bidx, {ANGLE} AS angle FROM nb p JOIN nb q ON p.geom_id = q.geom_id AND p.centre = q.centre AND p.other < q.other
  JOIN atoms a ON a.geom_id = p.geom_id AND a.idx = p.other JOIN atoms b ON b.geom_id = p.geom_id AND b.idx = q.other JOIN atoms c ON c.geom_id = p.geom_id AND c.idx = p.centre)"""


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(ATOMS.format(0, 1, 2).replace("FROM embeddings", "FROM {embeddings}"), embeddings=table(spark, sf, "embeddings"))


@query(f"WITH {ATOMS_SQL} SELECT geom_id, aidx, bidx, round(d, 6) AS d FROM bd")
def q_bonds(spark: SparkSession, sf: str) -> DataFrame:
    """Atom pairs within reach of their radii."""
    return G.bonds(atoms(spark, sf)).select("geom_id", "aidx", "bidx", F.round("d", 6).alias("d"))


@query(f"""WITH {ATOMS_SQL}, two AS (SELECT p.geom_id, p.other AS aidx, q.other AS bidx FROM nb p JOIN nb q ON p.geom_id = q.geom_id AND p.centre = q.centre AND p.other < q.other)
  SELECT geom_id, aidx, bidx, round(d, 6) AS d FROM pr WHERE d < 0.7 * rv AND (geom_id, aidx, bidx) NOT IN (SELECT geom_id, aidx, bidx FROM bd) AND (geom_id, aidx, bidx) NOT IN (SELECT geom_id, aidx, bidx FROM two)""")
def q_clash(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that are too near and neither one nor two bonds apart."""
    a = atoms(spark, sf)
    return G.clashes(a, G.bonds(a)).select("geom_id", "aidx", "bidx", F.round("d", 6).alias("d"))


@query(f"WITH {ANGLES_SQL} SELECT geom_id, centre, aidx, bidx, round(angle, 4) AS angle FROM an")
def q_angles(spark: SparkSession, sf: str) -> DataFrame:
    a = atoms(spark, sf)
    return G.angles(a, G.bonds(a)).withColumn("angle", F.round("angle", 4))


LIMITS = "CASE WHEN symbol = 'Fe' THEN {0} WHEN symbol = 'C' AND degree >= 4 THEN {1} WHEN symbol = 'C' AND degree = 3 THEN {2} WHEN symbol = 'C' AND degree = 2 THEN {3} WHEN symbol = 'N' AND degree >= 3 THEN {4} WHEN symbol = 'N' AND degree = 2 THEN {5} WHEN symbol IN ('O', 'S') THEN {6} ELSE {7} END"


@query(f"""WITH {ANGLES_SQL}, l AS (SELECT geom_id, idx AS centre, {LIMITS.format(60, 85, 100, 155, 85, 100, 85, 80)} AS low, {LIMITS.format(180, 135, 140, 180, 135, 140, 135, 145)} AS high FROM dg)
  SELECT geom_id, centre, aidx, bidx, round(angle, 4) AS angle, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM an JOIN l USING (geom_id, centre) WHERE angle < low OR angle > high""")
def q_angle_check(spark: SparkSession, sf: str) -> DataFrame:
    """Angles that are unusual for their centre's element and number of bonds."""
    a = atoms(spark, sf)
    rows = G.angle_check(a, G.bonds(a)).withColumn("angle", F.round("angle", 4))
    return rows.select("geom_id", "centre", "aidx", "bidx", "angle", "low", "high")


def _vector(name: str, a: str, b: str) -> str:
    return ", ".join(f"{b}.{k} - {a}.{k} AS {name}{k}" for k in "xyz")


def _cross(name: str, u: str, v: str) -> str:
    x, y, z = "xyz"
    return ", ".join(f"{u}{p} * {v}{q} - {u}{q} * {v}{p} AS {name}{r}" for p, q, r in ((y, z, x), (z, x, y), (x, y, z)))


def _dot(u: str, v: str) -> str:
    return "(" + " + ".join(f"{u}{k} * {v}{k}" for k in "xyz") + ")"


FIRST = "(SELECT min_by(other, struct_pack(h := os = 'H', o := other)) FROM nb WHERE nb.geom_id = bd.geom_id AND centre = {0} AND other <> {1})"


@query(f"""WITH {ATOMS_SQL}, ends AS (SELECT geom_id, {FIRST.format('aidx', 'bidx')} AS i, aidx AS j, bidx AS k, {FIRST.format('bidx', 'aidx')} AS l FROM bd WHERE asymbol <> 'Fe' AND bsymbol <> 'Fe'),
  v AS (SELECT ends.*, {_vector('p', 'ai', 'aj')}, {_vector('q', 'aj', 'ak')}, {_vector('r', 'ak', 'al')} FROM ends {' '.join(f'JOIN atoms a{c} ON a{c}.geom_id = ends.geom_id AND a{c}.idx = ends.{c}' for c in 'ijkl')}),
  n AS (SELECT *, {_cross('n', 'p', 'q')}, {_cross('m', 'q', 'r')} FROM v), t AS (SELECT *, {_cross('w', 'n', 'm')} FROM n),
  d AS (SELECT geom_id, i, j, k, l, abs(degrees(atan2({_dot('w', 'q')} / sqrt({_dot('q', 'q')}), {_dot('n', 'm')}))) AS dihedral FROM t)
  SELECT geom_id, i, j, k, l, round(dihedral, 4) AS dihedral FROM d WHERE dihedral < 25""")
def q_torsions(spark: SparkSession, sf: str) -> DataFrame:
    """Bonds whose ends nearly eclipse each other; here within 25 degrees."""
    a = atoms(spark, sf)
    return G.torsions(a, G.bonds(a), 25.0).withColumn("dihedral", F.round("dihedral", 4))


@query(f"""WITH RECURSIVE {ANGLES_SQL}, reach(geom_id, target) AS (SELECT geom_id, min(idx) FROM atoms GROUP BY 1 UNION SELECT r.geom_id, nb.other FROM reach r JOIN nb ON nb.geom_id = r.geom_id AND nb.centre = r.target),
  h AS (SELECT geom_id, 'F1' AS code, [aidx, centre, bidx] AS ids FROM an WHERE angle > 175 UNION ALL SELECT geom_id, 'F2', [aidx, bidx] FROM pr WHERE d < 0.01
    UNION ALL SELECT geom_id, 'F4', [idx] FROM dg WHERE degree < CASE symbol WHEN 'C' THEN 4 WHEN 'N' THEN 3 WHEN 'O' THEN 2 WHEN 'S' THEN 2 END - 1 UNION ALL SELECT geom_id, 'F5', [idx] FROM dg WHERE symbol = 'Fe' AND (degree < 4 OR degree > 6)
    UNION ALL SELECT geom_id, 'F6', list(idx ORDER BY idx) FROM atoms WHERE (geom_id, idx) NOT IN (SELECT geom_id, target FROM reach) GROUP BY 1)
  SELECT geom_id, code, array_to_string(ids, ',') AS idxs FROM h""")
def q_hazards(spark: SparkSession, sf: str) -> DataFrame:
    """What makes a calculation fail: straight angles, atoms in one place, missing bonds, loose parts."""
    a = atoms(spark, sf)
    return G.hazards(a, G.bonds(a)).withColumn("idxs", F.array_join("idxs", ","))


@query(f"""WITH {ATOMS_SQL}, bo AS (SELECT geom_id, aidx AS idx, bidx AS other, bsymbol AS s, d FROM pr UNION ALL SELECT geom_id, bidx, aidx, asymbol, d FROM pr)
  SELECT geom_id, idx, other, round(d, 6) AS d FROM bo WHERE s <> 'H' AND d <= 3 QUALIFY row_number() OVER (PARTITION BY geom_id, idx ORDER BY round(d, 9), other) = 1""")
def q_nearest_heavy(spark: SparkSession, sf: str) -> DataFrame:
    return G.nearest_heavy(atoms(spark, sf), 3.0).withColumn("d", F.round("d", 6))


@query(f"""WITH RECURSIVE {ATOMS_SQL}, reach(geom_id, idx, target) AS (SELECT geom_id, idx, idx FROM atoms UNION SELECT r.geom_id, r.idx, nb.other FROM reach r JOIN nb ON nb.geom_id = r.geom_id AND nb.centre = r.target)
  SELECT geom_id, count(DISTINCT part) AS n_parts FROM (SELECT geom_id, idx, min(target) AS part FROM reach GROUP BY 1, 2) GROUP BY 1""")
def q_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Connected parts of each molecule."""
    a = atoms(spark, sf)
    return G.fragments(a, G.bonds(a))


_pair = "CASE WHEN asymbol < bsymbol THEN asymbol || '-' || bsymbol ELSE bsymbol || '-' || asymbol END"
_refs = " ".join(f"WHEN '{'-'.join(sorted(k))}' THEN {v}" for k, v in G.BOND_LENGTHS.items())


@query(f"""WITH {ATOMS_SQL}, k AS (SELECT *, CASE {_pair} {_refs} END AS ref, asymbol = 'Fe' OR bsymbol = 'Fe' AS metal FROM bd)
  SELECT verdict, metal, count(*) AS n, round(avg(ratio), 6) AS ratio FROM (SELECT metal, d / ref AS ratio, CASE WHEN d / ref < CASE WHEN metal THEN 0.8 ELSE 0.85 END THEN 'short' WHEN d / ref > CASE WHEN metal THEN 1.25 ELSE 1.2 END THEN 'long' ELSE 'ok' END AS verdict FROM k WHERE ref IS NOT NULL) GROUP BY 1, 2""")
def q_bond_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.bond_check(G.bonds(atoms(spark, sf))).withColumn("metal", G.is_metal("asymbol") | G.is_metal("bsymbol"))
    return rows.groupBy("verdict", "metal").agg(F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("ratio"))


_protons = "sum(CASE symbol WHEN 'H' THEN 1 WHEN 'C' THEN 6 WHEN 'N' THEN 7 WHEN 'O' THEN 8 WHEN 'S' THEN 16 WHEN 'Fe' THEN 26 ELSE 0 END)"


@query(f"""WITH {ATOMS_SQL}, e AS (SELECT geom_id, CAST({_protons} AS BIGINT) - geom_id % 3 AS electrons, 1 + geom_id % 2 AS m FROM atoms GROUP BY 1)
  SELECT geom_id, electrons, CASE WHEN electrons <= 0 THEN 'no electrons' WHEN electrons % 2 = 1 AND m % 2 <> 0 THEN 'needs even multiplicity' WHEN electrons % 2 <> 1 AND m % 2 = 0 THEN 'needs odd multiplicity' END AS problem FROM e""")
def q_parity_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a molecule's charge and multiplicity go with its electrons."""
    a = atoms(spark, sf)
    charges = a.select("geom_id").distinct().select("geom_id", (F.col("geom_id") % 3).alias("charge"), (1 + F.col("geom_id") % 2).alias("multiplicity"))
    return G.parity_check(a, charges)


# sites and protons -----------------------------------------------------------------------------------

LOOSE = f"""{ATOMS_SQL}, lb AS (SELECT * FROM pr WHERE d <= 1.25 * rc), ln AS (SELECT geom_id, aidx AS idx, asymbol AS s, bidx AS other, bsymbol AS os, d FROM lb UNION ALL SELECT geom_id, bidx, bsymbol, aidx, asymbol, d FROM lb)"""
HEAVY = """(SELECT geom_id, h AS idx, other, os FROM (SELECT geom_id, aidx AS h, asymbol AS hs, bidx AS other, bsymbol AS os, d FROM pr UNION ALL SELECT geom_id, bidx, bsymbol, aidx, asymbol, d FROM pr)
  WHERE hs = 'H' AND os <> 'H' AND d <= {0} QUALIFY row_number() OVER (PARTITION BY geom_id, h ORDER BY round(d, 9), other) = 1)"""
DEPROT = f"""dp AS (SELECT geom_id, idx, other, score FROM (SELECT geom_id, idx, other, CASE os WHEN 'O' THEN 3.0 WHEN 'S' THEN 2.0 WHEN 'N' THEN 1.0 END AS score FROM {HEAVY.format(1.3)} WHERE os IN ('O', 'S', 'N')
  UNION ALL SELECT geom_id, idx, other, 0.0 FROM {HEAVY.format(1.35)} WHERE os IN ('C', 'N', 'O', 'S')) QUALIFY row_number() OVER (PARTITION BY geom_id ORDER BY score DESC, idx DESC) = 1)"""


@query(f"WITH {LOOSE}, {DEPROT} SELECT geom_id, idx, other, CAST(score AS DOUBLE) AS score FROM dp")
def q_deprot_site(spark: SparkSession, sf: str) -> DataFrame:
    """The hydrogen that goes first."""
    return S.deprotonation(atoms(spark, sf))


PROT = """pt AS (SELECT a.geom_id, a.idx, CASE a.symbol WHEN 'O' THEN 30.0 WHEN 'N' THEN 20.0 ELSE 10.0 END - (SELECT count(*) FROM ln WHERE ln.geom_id = a.geom_id AND ln.idx = a.idx) AS score FROM atoms a WHERE a.symbol IN ('O', 'N', 'S')
  QUALIFY row_number() OVER (PARTITION BY a.geom_id ORDER BY score DESC, a.idx DESC) = 1)"""


@query(f"WITH {LOOSE}, {PROT} SELECT geom_id, idx, CAST(score AS DOUBLE) AS score FROM pt")
def q_prot_site(spark: SparkSession, sf: str) -> DataFrame:
    """The atom that takes a proton: by element, then the fewest bonds, of equals the larger index."""
    return S.protonation(atoms(spark, sf))


_wet = "(a.geom_id, a.idx) IN (SELECT geom_id, idx FROM ln WHERE os = 'H')"


@query(f"""WITH {LOOSE}, dry AS (SELECT geom_id, idx FROM atoms a WHERE symbol = 'O' AND NOT {_wet}), co AS (SELECT DISTINCT geom_id, idx FROM ln WHERE s = 'C' AND (geom_id, other) IN (SELECT geom_id, idx FROM dry)),
  be AS (SELECT DISTINCT geom_id, idx FROM ln WHERE s = 'C' AND (geom_id, other) IN (SELECT geom_id, idx FROM co)), al AS (SELECT DISTINCT geom_id, idx FROM ln WHERE s = 'H' AND (geom_id, other) IN (SELECT geom_id, idx FROM be)),
  f AS (SELECT 'oh' AS selector, geom_id, idx FROM atoms a WHERE symbol = 'O' AND {_wet} UNION ALL SELECT 'o_terminal', geom_id, idx FROM dry UNION ALL SELECT 'alpha_c', geom_id, idx FROM al UNION ALL SELECT 'line:4', geom_id, idx FROM atoms WHERE idx = 3 UNION ALL SELECT '@T3', geom_id, idx FROM atoms WHERE idx % 4 = 3)
  SELECT selector, geom_id, min(idx) AS idx FROM f GROUP BY 1, 2 UNION ALL SELECT 'N', geom_id, idx FROM atoms WHERE symbol = 'N' QUALIFY row_number() OVER (PARTITION BY geom_id ORDER BY idx) = 2""")
def q_site_select(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms by line, tag and meaning; of nitrogens the second."""
    a = atoms(spark, sf).withColumn("tag", F.concat(F.lit("t"), (F.col("idx") % 4).cast("string")))
    out = None
    for selector in ("oh", "o_terminal", "alpha_c", "line:4", "@T3", "N"):
        one = S.select(a, selector, int(selector == "N")).select(F.lit(selector).alias("selector"), "geom_id", "idx")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {LOOSE}, {DEPROT} SELECT a.geom_id, a.idx - CASE WHEN a.idx > dp.idx THEN 1 ELSE 0 END AS idx, a.symbol FROM atoms a JOIN dp ON dp.geom_id = a.geom_id WHERE a.idx <> dp.idx")
def q_proton_remove(spark: SparkSession, sf: str) -> DataFrame:
    return S.without_proton(atoms(spark, sf)).select("geom_id", "idx", "symbol")


_pull = ", ".join(f"sum(({k}2 - {k}1) / d0) AS s{k}" for k in "xyz")
_new = ", ".join(f"round({k}1 + len * CASE WHEN sx IS NULL THEN {z} WHEN size < 1e-12 THEN {z} ELSE -s{k} / size END, 6) AS {k}" for k, z in (("x", 0), ("y", 0), ("z", 1)))


@query(f"""WITH {LOOSE}, {PROT}, ce AS (SELECT a.*, CASE symbol WHEN 'O' THEN 0.97 WHEN 'N' THEN 1.01 ELSE 1.34 END AS len FROM atoms a JOIN pt USING (geom_id, idx)),
  pu AS (SELECT geom_id, {_pull} FROM (SELECT ce.geom_id, {', '.join(f'ce.{k} AS {k}1, b.{k} AS {k}2' for k in 'xyz')}, ln.d AS d0 FROM ce JOIN ln ON ln.geom_id = ce.geom_id AND ln.idx = ce.idx JOIN atoms b ON b.geom_id = ce.geom_id AND b.idx = ln.other) GROUP BY 1),
  pl AS (SELECT ce.geom_id, len, {', '.join(f'ce.{k} AS {k}1' for k in 'xyz')}, sx, sy, sz, sqrt(sx * sx + sy * sy + sz * sz) AS size FROM ce LEFT JOIN pu USING (geom_id))
  SELECT geom_id, (SELECT max(idx) + 1 FROM atoms a WHERE a.geom_id = pl.geom_id) AS idx, {_new} FROM pl""")
def q_proton_add(spark: SparkSession, sf: str) -> DataFrame:
    """The hydrogen that is put on, away from what its atom is bonded to."""
    a = atoms(spark, sf)
    last = a.groupBy("geom_id").agg(F.max("idx").alias("n"))
    rows = S.with_proton(a).join(last, "geom_id").where(F.col("idx") > F.col("n"))
    return rows.select("geom_id", "idx", *(F.round(k, 6).alias(k) for k in "xyz"))


# rigid placements ------------------------------------------------------------------------------------

CENTRED = f"WITH {ATOMS_SQL}, c AS (SELECT geom_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, max(idx) + 1 AS n FROM atoms GROUP BY 1)"


@query(f"{CENTRED} SELECT geom_id, idx + part * n AS idx, part, symbol, round(x - cx + part * 2.1, 6) AS x, round(y - cy + part * 2.8, 6) AS y, round(z - cz, 6) AS z FROM atoms JOIN c USING (geom_id), (VALUES (0), (1)) p(part)")
def q_dimer(spark: SparkSession, sf: str) -> DataFrame:
    """A molecule about its centroid and its copy moved along an axis."""
    d = G.dimer(atoms(spark, sf), 3.5, (3.0, 4.0, 0.0))
    return d.select("geom_id", "idx", "part", "symbol", *(F.round(k, 6).alias(k) for k in "xyz"))


@query(f"{CENTRED} SELECT geom_id, step, idx, symbol, round(4.0 - step * 0.5, 6) AS distance, round(x - cx, 6) AS x, round(y - cy, 6) AS y, round(z - cz + 4.0 - step * 0.5, 6) AS z FROM atoms JOIN c USING (geom_id), (SELECT unnest(range(0, 5)) AS step)")
def q_approach(spark: SparkSession, sf: str) -> DataFrame:
    """Every molecule at five places along a path."""
    a = G.approach(atoms(spark, sf), 4.0, 2.0, 5)
    return a.select("geom_id", "step", "idx", "symbol", *(F.round(k, 6).alias(k) for k in ("distance", *"xyz")))


_axes = ", ".join(f"({a}, {', '.join(map(str, axis))}, {', '.join(map(str, axis[2:] + axis[:2]))})" for a, axis in enumerate(G.AXES))
_ligand = [("N", 0.0, 0.0), ("H", 0.35, 0.95)]
_place = ", ".join(f"round({k} * (2 + n_regionkey * 0.1 + along) + s{k} * off, 6) AS {k}" for k in "xyz")


@query(f"""SELECT n_nationkey AS geom_id, 0 AS idx, 'Fe' AS symbol, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z FROM nation UNION ALL
  SELECT n_nationkey, 1 + a * 2 + n, symbol, {_place} FROM nation, (VALUES {_axes}) v(a, x, y, z, sx, sy, sz), (VALUES (0, 'N', CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE)), (1, 'H', CAST(0.35 AS DOUBLE), CAST(0.95 AS DOUBLE))) l(n, symbol, along, off)""")
def q_octahedron(spark: SparkSession, sf: str) -> DataFrame:
    """A metal with a ligand of two atoms on each of six axes."""
    centres = table(spark, sf, "nation").select(F.col("n_nationkey").alias("geom_id"), F.lit("Fe").alias("symbol"), "n_regionkey")
    rows = G.octahedron(centres, _ligand, 2 + F.col("n_regionkey") * 0.1)
    return rows.select("geom_id", "idx", "symbol", *(F.round(k, 6).alias(k) for k in "xyz"))


LIGANDS = {"en": 2, "water": 1, "terpy": 3, "edta": 6}


@query("SELECT l_orderkey, CAST(sum(CASE l_partkey % 7 WHEN 0 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 6 ELSE 1 END) AS BIGINT) AS denticity FROM lineitem GROUP BY 1")
def q_denticity(spark: SparkSession, sf: str) -> DataFrame:
    """Donor atoms of all ligands; one for what no table knows."""
    k = F.col("l_partkey") % 7
    name = F.when(k == 0, " EN ").when(k == 1, "water").when(k == 2, "terpy").when(k == 3, "Edta").otherwise("none")
    return G.denticity(table(spark, sf, "lineitem").select("l_orderkey", name.alias("ligand")), ["l_orderkey"], "ligand", LIGANDS)


@query("SELECT user_id, round((c - v) * 627.509474, 3) AS gap, CASE WHEN c > v THEN 'view' WHEN c <= v THEN 'click' END AS ground FROM (SELECT user_id, max(value) FILTER (event_type = 'click') AS c, max(value) FILTER (event_type = 'view') AS v FROM events GROUP BY 1)")
def q_spin_gap(spark: SparkSession, sf: str) -> DataFrame:
    return G.spin_gap(table(spark, sf, "events"), ["user_id"], "event_type", "value", "view", "click").withColumn("gap", F.round("gap", 3))
