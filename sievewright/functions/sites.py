"""Sites of molecules (geom_id, idx, symbol, x, y, z and perhaps tag), and protons taken off and put on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import geometry as G

# How far a hydrogen's heavy neighbour may be, the scale of bonds here, lengths of new bonds,
# elements by preference, and the names of selectors by meaning.
REACH, LAST_REACH, SCALE = 1.3, 1.35, 1.25
NEW_BOND = {"O": 0.97, "N": 1.01, "S": 1.34, "Cl": 1.27, "F": 0.92}
ACIDIC = {"O": 3.0, "S": 2.0, "N": 1.0}
BASIC = {"O": 3.0, "N": 2.0, "S": 1.0}
NONMETALS = ["H", "C", "N", "O", "F", "P", "S", "Cl", "Br", "I"]
SELECTORS = {
    "terminal": ("oxygen_terminal", "oxygen_terminal_not_hydroxyl", "o_terminal", "o_nonhydroxyl"),
    "hydroxyl": ("oxygen_hydroxyl", "o_hydroxyl", "oh"),
    "nitrogen": ("nitrogen", "n_atom", "n"),
    "alpha": ("alpha_carbon", "alpha_to_carbonyl", "alpha_h", "alpha_ch", "carbonyl_alpha", "alpha_c"),
}


def loose_bonds(atoms: DataFrame) -> DataFrame:
    """Bonds by one scale for all elements, in both directions: geom_id, idx, symbol, other, other_symbol."""
    b = G.bonds(atoms, SCALE, SCALE)
    one = b.select("geom_id", F.col("aidx").alias("idx"), F.col("asymbol").alias("symbol"), F.col("bidx").alias("other"), F.col("bsymbol").alias("other_symbol"))
    return one.unionByName(one.select("geom_id", F.col("other").alias("idx"), F.col("other_symbol").alias("symbol"), F.col("idx").alias("other"), F.col("symbol").alias("other_symbol")))


def heavy_neighbours(atoms: DataFrame, cutoff: float) -> DataFrame:
    """geom_id, idx, other, other_symbol: each hydrogen with its nearest other element, if near enough."""
    symbols = atoms.select("geom_id", "idx", "symbol")
    near = G.nearest_heavy(atoms, cutoff).join(symbols.where("symbol = 'H'"), ["geom_id", "idx"]).drop("symbol")
    return near.join(symbols.withColumnRenamed("idx", "other").withColumnRenamed("symbol", "other_symbol"), ["geom_id", "other"]).select("geom_id", "idx", "other", "other_symbol")


def deprotonation(atoms: DataFrame) -> DataFrame:
    """geom_id, idx, other, score: the hydrogen that goes, off O before S before N; of equals the larger
    index. Where none is on these, one on any nonmetal, with score 0. Molecules without one have no row."""
    score = G.by_key(ACIDIC, F.col("other_symbol"))
    best = heavy_neighbours(atoms, REACH).withColumn("score", score).where("score is not null")
    rest = heavy_neighbours(atoms, LAST_REACH).where(F.col("other_symbol").isin(NONMETALS)).withColumn("score", F.lit(0.0))
    return G.ranked_site(best.unionByName(rest), ["geom_id"], F.col("score"), "idx").select("geom_id", "idx", "other", "score")


def protonation(atoms: DataFrame) -> DataFrame:
    """geom_id, idx, score: the atom that takes a proton, ten times the element's rank less its number of
    bonds; of equals the larger index."""
    degree = loose_bonds(atoms).groupBy("geom_id", "idx").agg(F.count("*").alias("degree"))
    rows = atoms.select("geom_id", "idx", "symbol").where(F.col("symbol").isin(list(BASIC))).join(degree, ["geom_id", "idx"], "left")
    rows = rows.withColumn("score", G.by_key(BASIC, F.col("symbol")) * 10 - F.coalesce("degree", F.lit(0)))
    return G.ranked_site(rows, ["geom_id"], F.col("score"), "idx").select("geom_id", "idx", "score")


def select(atoms: DataFrame, selector: str, variant: int = 0) -> DataFrame:
    """geom_id, idx, symbol: the atom that a selector means, the variant-th of several by index.

    "line:N" is the N-th atom; names of SELECTORS go by bonds; any other text is an atom's tag (without
    case or a leading @), "*" any tag. Molecules without such an atom have no row.
    """
    if selector.lower().startswith("line:"):
        number = selector.split(":", 1)[1].strip()
        if not number.lstrip("+-").isdigit():
            raise ValueError(f"line:N needs a number, not {number!r}")
        return atoms.where(F.col("idx") == int(number) - 1).select("geom_id", "idx", "symbol")
    name = selector.lower().strip()
    kind = next((k for k, names in SELECTORS.items() if name in names), None)
    if kind is None:
        tag = selector.lstrip("@").strip()
        if "tag" not in atoms.columns:
            raise ValueError("the atoms have no tags")
        found = atoms.where(F.col("tag").isNotNull() if tag == "*" else F.lower("tag") == tag.lower())
    elif kind == "nitrogen":
        found = atoms.where("symbol = 'N'")
    else:
        b = loose_bonds(atoms)
        wet = b.where("symbol = 'O' and other_symbol = 'H'").select("geom_id", "idx").distinct()
        dry = atoms.where("symbol = 'O'").join(wet, ["geom_id", "idx"], "left_anti").select("geom_id", "idx")
        if kind == "hydroxyl":
            found = atoms.join(wet, ["geom_id", "idx"], "left_semi")
        elif kind == "terminal":
            found = atoms.join(dry, ["geom_id", "idx"], "left_semi")
        else:
            carbon = b.where("symbol = 'C'").join(dry.withColumnRenamed("idx", "other"), ["geom_id", "other"], "left_semi").select("geom_id", "idx").distinct()
            beside = b.where("symbol = 'C'").join(carbon.withColumnRenamed("idx", "other"), ["geom_id", "other"], "left_semi").select("geom_id", "idx").distinct()
            on = b.where("symbol = 'H'").join(beside.withColumnRenamed("idx", "other"), ["geom_id", "other"], "left_semi").select("geom_id", "idx").distinct()
            found = atoms.join(on, ["geom_id", "idx"], "left_semi")
    place = F.row_number().over(Window.partitionBy("geom_id").orderBy("idx"))
    return found.withColumn("__k", place).where(F.col("__k") == variant + 1).select("geom_id", "idx", "symbol")


def without_proton(atoms: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Atoms less one hydrogen: that of sites (geom_id, idx), or for a heavy site its first one; by
    default that of `deprotonation`. Atoms are numbered anew; molecules without such a site are left out."""
    if sites is None:
        gone = deprotonation(atoms).select("geom_id", F.col("idx").alias("__h"))
    else:
        at = sites.select("geom_id", "idx").join(atoms.select("geom_id", "idx", "symbol"), ["geom_id", "idx"])
        on = at.where("symbol <> 'H'").join(loose_bonds(atoms).where("other_symbol = 'H'").select("geom_id", "idx", "other"), ["geom_id", "idx"])
        gone = at.where("symbol = 'H'").select("geom_id", F.col("idx").alias("__h")).unionByName(on.groupBy("geom_id").agg(F.min("other").alias("__h")))
    rows = atoms.join(gone, "geom_id").where(F.col("idx") != F.col("__h"))
    return rows.withColumn("idx", F.col("idx") - (F.col("idx") > F.col("__h")).cast("int")).drop("__h").select(*atoms.columns)


def with_proton(atoms: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Atoms and one more hydrogen on the site (by default that of `protonation`), away from what the
    site is bonded to, and along z for a lone atom. Sites that are hydrogens are left out."""
    sites = protonation(atoms) if sites is None else sites
    xyz = [F.col(k) for k in "xyz"]
    centre = atoms.join(sites.select("geom_id", "idx"), ["geom_id", "idx"]).where("symbol <> 'H'").select("geom_id", "idx", "symbol", *(F.col(k).alias(f"c{k}") for k in "xyz"))
    other = atoms.select("geom_id", F.col("idx").alias("other"), *xyz)
    near = loose_bonds(atoms).select("geom_id", "idx", "other").join(centre, ["geom_id", "idx"]).join(other, ["geom_id", "other"])
    step = G.unit([F.col(k) - F.col(f"c{k}") for k in "xyz"])
    pulls = near.groupBy("geom_id").agg(*(F.sum(v).alias(f"s{k}") for v, k in zip(step, "xyz")))
    rows = centre.join(pulls, "geom_id", "left")
    away = G.unit([-F.col(f"s{k}") for k in "xyz"])
    length = F.coalesce(G.by_key(NEW_BOND, F.col("symbol")), F.lit(1.0))
    lone = F.col("sx").isNull()
    place = [(F.col(f"c{k}") + length * F.when(lone, F.lit(z)).otherwise(v)).alias(k) for k, v, z in zip("xyz", away, (0.0, 0.0, 1.0))]
    count = atoms.groupBy("geom_id").agg((F.max("idx") + 1).alias("__n"))
    new = rows.select("geom_id", F.lit("H").alias("symbol"), *place).join(count, "geom_id").withColumnRenamed("__n", "idx")
    kept = atoms.join(centre.select("geom_id"), "geom_id", "left_semi")
    return kept.unionByName(new, allowMissingColumns=True).select(*atoms.columns)
