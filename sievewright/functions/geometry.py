"""Geometry of tables of atoms (geom_id, idx, symbol, x, y, z): pairs within a molecule, angles, spectra.

Pairs are joined within a molecule; a molecule is small, the number of molecules is not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Covalent and van der Waals radii in angstrom, and reference bond lengths.
COVALENT = {"H": 0.31, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "P": 1.07, "S": 1.05, "Cl": 1.02, "Br": 1.20, "I": 1.39, "Cu": 1.32, "Fe": 1.32, "Ru": 1.46, "Ni": 1.24, "Pt": 1.36, "Zn": 1.22, "Co": 1.26, "Mn": 1.29, "Cr": 1.27, "Pd": 1.39, "Rh": 1.42, "Ir": 1.41}
VAN_DER_WAALS = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.80, "S": 1.80, "Cl": 1.75, "Br": 1.85, "I": 1.98, "Cu": 1.40, "Fe": 1.40, "Ni": 1.63, "Zn": 1.39, "Co": 1.40, "Ru": 1.46, "Pt": 1.72, "Pd": 1.63}
BOND_LENGTHS = {
    ("C", "C"): 1.54, ("C", "N"): 1.47, ("C", "O"): 1.43, ("C", "H"): 1.09, ("C", "S"): 1.82, ("C", "Cl"): 1.77, ("C", "Br"): 1.94, ("C", "F"): 1.35,
    ("H", "N"): 1.01, ("H", "O"): 0.96, ("H", "S"): 1.34, ("N", "N"): 1.45, ("N", "O"): 1.40, ("S", "S"): 2.05,
    ("Cu", "N"): 2.05, ("Cu", "O"): 2.00, ("Cl", "Cu"): 2.28, ("Cu", "S"): 2.31, ("Fe", "N"): 2.00, ("Fe", "O"): 2.05, ("Cl", "Fe"): 2.32, ("C", "Fe"): 1.85,
    ("N", "Ru"): 2.10, ("C", "Ru"): 1.86, ("N", "Ni"): 1.95, ("Ni", "O"): 2.05, ("N", "Pt"): 2.02, ("Cl", "Pt"): 2.33, ("N", "Zn"): 2.05, ("O", "Zn"): 2.00,
    ("Co", "N"): 1.97, ("Co", "O"): 1.90,
}
METALS = ["Cu", "Fe", "Ru", "Ni", "Pt", "Zn", "Co", "Mn", "Cr", "Pd", "Rh", "Ir", "Ti", "V", "Mo", "W", "Re", "Os", "Au", "Ag"]
UNKNOWN_COVALENT, UNKNOWN_VDW = 0.77, 1.70
#: Scale of the radii's sum within which two atoms are bonded, without and with a metal.
ORGANIC_SCALE, METAL_SCALE = 1.20, 1.30
ATOMIC_NUMBERS = {
    "H": 1, "He": 2, "Li": 3, "Be": 4, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "Ne": 10, "Na": 11, "Mg": 12, "Al": 13, "Si": 14, "P": 15, "S": 16, "Cl": 17,
    "Ar": 18, "K": 19, "Ca": 20, "Mn": 25, "Fe": 26, "Co": 27, "Ni": 28, "Cu": 29, "Zn": 30, "Ru": 44, "Rh": 45, "Pd": 46, "Ag": 47, "Ir": 77, "Pt": 78, "Au": 79,
}
#: Bonds an atom usually has, and the coordination numbers expected of metals.
VALENCES = {"C": 4, "N": 3, "O": 2, "S": 2, "F": 1, "Cl": 1, "Br": 1, "I": 1}
COORDINATION = {"Cu": (4, 6), "Fe": (4, 6), "Ni": (4, 6), "Pt": (4, 4), "Zn": (4, 6), "Co": (4, 6), "Ru": (4, 6), "Pd": (4, 4)}
HARTREE_KCAL, HARTREE_KJ = 627.509474, 2625.499638


def by_key(values: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def distance(a: str, b: str) -> Column:
    return F.sqrt(sum((F.pow(F.col(f"{a}{k}") - F.col(f"{b}{k}"), 2.0) for k in "xyz"), F.lit(0.0)))


def side(atoms: DataFrame, name: str) -> DataFrame:
    return atoms.select("geom_id", *(F.col(c).alias(f"{name}{c}") for c in ("idx", "symbol", "x", "y", "z")))


def pairs(atoms: DataFrame) -> DataFrame:
    """Each two atoms of a molecule once, with their distance."""
    return side(atoms, "a").join(side(atoms, "b"), "geom_id").where("aidx < bidx").withColumn("d", distance("a", "b"))


def is_metal(symbol: str) -> Column:
    return F.col(symbol).isin(METALS)


def radii(values: dict[str, float], unknown: float, a: str = "asymbol", b: str = "bsymbol") -> Column:
    """Sum of two atoms' radii; elements without one have `unknown`."""
    return sum((F.coalesce(by_key(values, F.col(c)), F.lit(unknown)) for c in (a, b)), F.lit(0.0))


def bonds(atoms: DataFrame, scale: float = ORGANIC_SCALE, metal_scale: float = METAL_SCALE) -> DataFrame:
    """Pairs within a scale of their radii's sum; a pair with a metal has a scale of its own."""
    wide = F.when(is_metal("asymbol") | is_metal("bsymbol"), metal_scale).otherwise(scale)
    near = F.col("d") <= wide * radii(COVALENT, UNKNOWN_COVALENT)
    return pairs(atoms).where(near).select("geom_id", "aidx", "bidx", "asymbol", "bsymbol", "d")


def neighbours(bonds_of: DataFrame) -> DataFrame:
    """Bonds in both directions: geom_id, centre, other."""
    both = bonds_of.select("geom_id", F.col("aidx").alias("centre"), F.col("bidx").alias("other"))
    return both.unionByName(bonds_of.select("geom_id", F.col("bidx").alias("centre"), F.col("aidx").alias("other")))


def angles(atoms: DataFrame, bonds_of: DataFrame) -> DataFrame:
    """geom_id, centre, a, b and the angle in degrees, a < b."""
    n = neighbours(bonds_of)
    two = n.select("geom_id", "centre", F.col("other").alias("aidx")).join(n.select("geom_id", "centre", F.col("other").alias("bidx")), ["geom_id", "centre"]).where("aidx < bidx")
    at = two.join(side(atoms, "a"), ["geom_id", "aidx"]).join(side(atoms, "b"), ["geom_id", "bidx"]).join(side(atoms, "c").withColumnRenamed("cidx", "centre"), ["geom_id", "centre"])
    u, v = ([F.col(f"{s}{k}") - F.col(f"c{k}") for k in "xyz"] for s in "ab")
    cosine = sum((p * q for p, q in zip(u, v)), F.lit(0.0)) / F.sqrt(sum((p * p for p in u), F.lit(0.0))) / F.sqrt(sum((q * q for q in v), F.lit(0.0)))
    return at.select("geom_id", "centre", "aidx", "bidx", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).alias("angle"))


def clashes(atoms: DataFrame, bonds_of: DataFrame, factor: float = 0.7) -> DataFrame:
    """Pairs nearer than a share of their radii that are not one or two bonds apart."""
    near = pairs(atoms).where(F.col("d") < factor * radii(VAN_DER_WAALS, UNKNOWN_VDW)).select("geom_id", "aidx", "bidx", "d")
    n = neighbours(bonds_of)
    two = n.select("geom_id", "centre", F.col("other").alias("aidx")).join(n.select("geom_id", "centre", F.col("other").alias("bidx")), ["geom_id", "centre"]).where("aidx < bidx").select("geom_id", "aidx", "bidx")
    return near.join(bonds_of, ["geom_id", "aidx", "bidx"], "left_anti").join(two, ["geom_id", "aidx", "bidx"], "left_anti")


def nearest_heavy(atoms: DataFrame, cutoff: float) -> DataFrame:
    """Of each atom the nearest other that is no hydrogen, within a cutoff, and their distance; of equals to
    9 digits the smaller index."""
    p = pairs(atoms).where(F.col("d") <= cutoff)
    both = p.select("geom_id", F.col("aidx").alias("idx"), F.col("bidx").alias("other"), F.col("bsymbol").alias("s"), "d").unionByName(p.select("geom_id", F.col("bidx").alias("idx"), F.col("aidx").alias("other"), F.col("asymbol").alias("s"), "d"))
    return both.where("s <> 'H'").groupBy("geom_id", "idx").agg(F.min(F.struct(F.round("d", 9).alias("near"), "other", "d")).alias("m")).select("geom_id", "idx", "m.other", "m.d")


def dihedral(p: list[list[Column]]) -> Column:
    """Signed angle of four points in degrees."""
    sub = lambda a, b: [x - y for x, y in zip(a, b)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    b1, b2, b3 = sub(p[1], p[0]), sub(p[2], p[1]), sub(p[3], p[2])
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.degrees(F.atan2(dot(cross(n1, n2), b2) / F.sqrt(dot(b2, b2)), dot(n1, n2)))


def bond_check(bonds_of: DataFrame, short: float = 0.85, long: float = 1.20, metal_short: float = 0.80, metal_long: float = 1.25) -> DataFrame:
    """Bonds with a reference length: the ratio to it, and whether it is short, long or ok. Bonds of
    metals have wider limits."""
    key = F.concat_ws("-", F.array_sort(F.array("asymbol", "bsymbol")))
    known = {"-".join(sorted(k)): v for k, v in BOND_LENGTHS.items()}
    metal = is_metal("asymbol") | is_metal("bsymbol")
    low, high = F.when(metal, metal_short).otherwise(short), F.when(metal, metal_long).otherwise(long)
    rows = bonds_of.withColumn("ratio", F.col("d") / by_key(known, key)).where("ratio is not null")
    return rows.withColumn("verdict", F.when(F.col("ratio") < low, "short").when(F.col("ratio") > high, "long").otherwise("ok"))


def degrees_of(atoms: DataFrame, bonds_of: DataFrame) -> DataFrame:
    """geom_id, idx, symbol and the atom's number of bonds, 0 included."""
    n = neighbours(bonds_of).groupBy("geom_id", F.col("centre").alias("idx")).agg(F.count("*").alias("degree"))
    return atoms.select("geom_id", "idx", "symbol").join(n, ["geom_id", "idx"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def angle_limits(symbol: Column, degree: Column) -> tuple[Column, Column]:
    """Least and greatest angle expected at an atom with so many bonds."""
    rules = [
        (symbol.isin(METALS), 60.0, 180.0),
        ((symbol == "C") & (degree >= 4), 85.0, 135.0),
        ((symbol == "C") & (degree == 3), 100.0, 140.0),
        ((symbol == "C") & (degree == 2), 155.0, 180.0),
        ((symbol == "N") & (degree >= 3), 85.0, 135.0),
        ((symbol == "N") & (degree == 2), 100.0, 140.0),
        (symbol.isin("O", "S", "P"), 85.0, 135.0),
    ]
    low, high = F.lit(80.0), F.lit(145.0)
    for cond, a, b in reversed(rules):
        low, high = F.when(cond, a).otherwise(low), F.when(cond, b).otherwise(high)
    return low, high


def angle_check(atoms: DataFrame, bonds_of: DataFrame) -> DataFrame:
    """Angles outside the limits of their centre: geom_id, centre, aidx, bidx, angle, low, high."""
    centres = degrees_of(atoms, bonds_of).withColumnRenamed("idx", "centre")
    low, high = angle_limits(F.col("symbol"), F.col("degree"))
    rows = angles(atoms, bonds_of).join(centres, ["geom_id", "centre"]).withColumns({"low": low, "high": high})
    return rows.where((F.col("angle") < F.col("low")) | (F.col("angle") > F.col("high"))).drop("symbol", "degree")


def torsions(atoms: DataFrame, bonds_of: DataFrame, most: float = 10.0) -> DataFrame:
    """Eclipsed bonds without a metal: geom_id, i, j, k, l and the dihedral's size, below `most` degrees.

    Each end of a bond (j, k) is looked at from its first other neighbour that is no hydrogen, or its
    first one if all are.
    """
    symbols = atoms.select("geom_id", F.col("idx").alias("other"), F.col("symbol").alias("other_symbol"))
    beside = neighbours(bonds_of).join(symbols, ["geom_id", "other"])
    plain = bonds_of.where(~is_metal("asymbol") & ~is_metal("bsymbol")).select("geom_id", F.col("aidx").alias("j"), F.col("bidx").alias("k"))
    first = F.min(F.struct((F.col("other_symbol") == "H").alias("light"), F.col("other").alias("at")))["at"]

    def end(rows: DataFrame, centre: str, exclude: str, name: str) -> DataFrame:
        near = beside.select("geom_id", F.col("centre").alias(centre), "other", "other_symbol")
        picked = rows.select("geom_id", "j", "k").join(near, ["geom_id", centre]).where(F.col("other") != F.col(exclude))
        return rows.join(picked.groupBy("geom_id", "j", "k").agg(first.alias(name)), ["geom_id", "j", "k"])

    rows = end(end(plain, "j", "k", "i"), "k", "j", "l")
    points = []
    for name in "ijkl":
        place = atoms.select("geom_id", F.col("idx").alias(name), *(F.col(c).alias(name + c) for c in "xyz"))
        rows = rows.join(place, ["geom_id", name])
        points.append([F.col(name + c) for c in "xyz"])
    rows = rows.withColumn("dihedral", F.abs(dihedral(points)))
    return rows.where(F.col("dihedral") < most).select("geom_id", *"ijkl", "dihedral")


def parity_check(atoms: DataFrame, charges: DataFrame) -> DataFrame:
    """geom_id, electrons, problem (null if none): whether charge and multiplicity (of charges) go with
    the number of electrons. Elements without a number count as 0."""
    numbers = {k: float(v) for k, v in ATOMIC_NUMBERS.items()}
    n = atoms.groupBy("geom_id").agg(F.sum(F.coalesce(by_key(numbers, F.col("symbol")), F.lit(0.0))).cast("long").alias("protons"))
    rows = n.join(charges, "geom_id").withColumn("electrons", F.col("protons") - F.col("charge"))
    odd = F.col("electrons") % 2 == 1
    problem = F.when(F.col("electrons") <= 0, "no electrons").when(odd & (F.col("multiplicity") % 2 != 0), "needs even multiplicity").when(~odd & (F.col("multiplicity") % 2 == 0), "needs odd multiplicity")
    return rows.select("geom_id", "electrons", problem.alias("problem"))


def labelled_parts(atoms: DataFrame, bonds_of: DataFrame) -> DataFrame:
    """geom_id, idxs (sorted), parts: the least index of each atom's connected part.

    A molecule's bonds are folded into its labels one after another; each joins two labels, so one
    pass is exact whatever the shape. Only a molecule's own atoms meet in a row.
    """
    own = atoms.groupBy("geom_id").agg(F.array_sort(F.collect_list("idx")).alias("idxs"))
    held = bonds_of.groupBy("geom_id").agg(F.collect_list(F.struct("aidx", "bidx")).alias("bonds"))
    rows = own.join(held, "geom_id", "left")
    rows = rows.withColumn("bonds", F.coalesce("bonds", F.array().cast(rows.schema["bonds"].dataType)))

    def joined(parts: Column, bond: Column) -> Column:
        a, b = (parts[F.array_position("idxs", bond[c]).cast("int") - 1] for c in ("aidx", "bidx"))
        return F.transform(parts, lambda p: F.when(p == F.greatest(a, b), F.least(a, b)).otherwise(p))

    return rows.select("geom_id", "idxs", F.aggregate("bonds", F.col("idxs"), joined).alias("parts"))


def fragments(atoms: DataFrame, bonds_of: DataFrame) -> DataFrame:
    """geom_id and its number of connected parts."""
    return labelled_parts(atoms, bonds_of).select("geom_id", F.size(F.array_distinct("parts")).cast("long").alias("n_parts"))


def hazards(atoms: DataFrame, bonds_of: DataFrame) -> DataFrame:
    """geom_id, code, idxs (the atoms in question) of what makes a calculation fail.

    F1 an angle above 175 degrees, F2 two atoms in one place, F4 an atom that lacks more than one
    bond, F5 a metal with an unusual number of neighbours, F6 atoms apart from the first one's part.
    """
    row = lambda code, *idx: ["geom_id", F.lit(code).alias("code"), F.array(*(F.col(c).cast("long") for c in idx)).alias("idxs")]
    linear = angles(atoms, bonds_of).where("angle > 175").select(*row("F1", "aidx", "centre", "bidx"))
    same = pairs(atoms).where("d < 0.01").select(*row("F2", "aidx", "bidx"))
    n = degrees_of(atoms, bonds_of)
    few = n.where(F.col("degree") < by_key({k: float(v) for k, v in VALENCES.items()}, F.col("symbol")) - 1).select(*row("F4", "idx"))
    low, high = (by_key({k: float(v[side]) for k, v in COORDINATION.items()}, F.col("symbol")) for side in (0, 1))
    odd = n.where((F.col("degree") < low) | (F.col("degree") > high)).select(*row("F5", "idx"))
    parts = labelled_parts(atoms, bonds_of)
    apart = F.transform(F.filter(F.arrays_zip("idxs", "parts"), lambda x: x["parts"] != F.col("parts")[0]), lambda x: x["idxs"].cast("long"))
    apart = parts.select("geom_id", F.lit("F6").alias("code"), apart.alias("idxs")).where(F.size("idxs") > 0)
    return linear.unionByName(same).unionByName(few).unionByName(odd).unionByName(apart)


def spectrum(peaks: DataFrame, by: list[str], at: str, height: str, low: float, high: float, points: int, width: float, shape: str = "lorentz") -> DataFrame:
    """Broadened peaks on a grid: by, x, y. Each peak meets every grid point, of which there are `points`."""
    step = (high - low) / (points - 1)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * step)).alias("x")
    rows = peaks.select(*by, F.col(at).alias("__at"), F.col(height).alias("__h"), grid)
    gap = F.col("x") - F.col("__at")
    y = F.col("__h") * (width**2 / (gap * gap + width**2) if shape == "lorentz" else F.exp(-gap * gap / (2 * width**2)))
    return rows.groupBy(*by, "x").agg(F.sum(y).alias("y"))


def pka(dg: Column, temperature: float = 298.15) -> Column:
    """From a free energy in kcal/mol: dG / (R T ln 10)."""
    return dg / (0.0019872041 * temperature * math.log(10))


def ranked_site(df: DataFrame, by: list[str], score: Column, index: str) -> DataFrame:
    """The best site of each group: highest score, of equals the larger index."""
    w = Window.partitionBy(*by).orderBy(score.desc(), F.col(index).desc())
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


# vectors of three columns ---------------------------------------------------------------------------


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a, b)), F.lit(0.0))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: list[Column]) -> list[Column]:
    """The direction of a vector; that of z for one without length."""
    size = F.sqrt(dot(a, a))
    return [F.when(size < 1e-12, F.lit(z)).otherwise(x / size) for x, z in zip(a, (0.0, 0.0, 1.0))]


# rigid placements -----------------------------------------------------------------------------------

AXES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def octahedron(centres: DataFrame, ligand: list[tuple[str, float, float]], radius: Column) -> DataFrame:
    """A metal (symbol) at the origin and a ligand on each of six axes: geom_id, idx, symbol, x, y, z.

    ligand: its atoms as (symbol, distance beyond the donor along the axis, offset across it); the
    donor comes first with 0. centres: geom_id, symbol and what radius needs.
    """
    across = [axis[2:] + axis[:2] for axis in AXES]  # a direction at a right angle to each axis
    atom = lambda symbol, xyz, at: F.struct(F.lit(at).cast("long").alias("idx"), symbol.alias("symbol"), *(v.alias(k) for v, k in zip(xyz, "xyz")))
    rows = [atom(F.col("symbol"), [F.lit(0.0)] * 3, 0)]
    for a, (axis, side) in enumerate(zip(AXES, across)):
        for n, (symbol, along, off) in enumerate(ligand):
            place = [float(v) * (radius + F.lit(float(along))) + F.lit(float(w) * float(off)) for v, w in zip(axis, side)]
            rows.append(atom(F.lit(symbol), place, 1 + a * len(ligand) + n))
    return centres.select("geom_id", F.inline(F.array(*rows)))


def centred(atoms: DataFrame) -> DataFrame:
    """Atoms about their molecule's centroid."""
    middle = atoms.groupBy("geom_id").agg(*(F.avg(k).alias(f"__{k}") for k in "xyz"))
    return atoms.join(middle, "geom_id").select("geom_id", "idx", "symbol", *((F.col(k) - F.col(f"__{k}")).alias(k) for k in "xyz"))


def dimer(atoms: DataFrame, distance: float, axis: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> DataFrame:
    """A molecule about its centroid (part 0) and its copy moved along an axis (part 1), whose atoms
    are numbered on. The axis is taken at length 1."""
    size = math.sqrt(sum(v * v for v in axis)) or 1.0
    n = atoms.groupBy("geom_id").agg((F.max("idx") + 1).alias("__n"))
    both = centred(atoms).join(n, "geom_id").withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    moved = [(F.col(k) + F.col("part") * F.lit(distance * v / size)).alias(k) for k, v in zip("xyz", axis)]
    return both.select("geom_id", (F.col("idx") + F.col("part") * F.col("__n")).alias("idx"), "part", "symbol", *moved)


def approach(atoms: DataFrame, start: float, end: float, steps: int, axis: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """A molecule moved as a whole along an axis in equal steps: geom_id, step, distance and its atoms."""
    size = math.sqrt(sum(v * v for v in axis)) or 1.0
    gap = (end - start) / (steps - 1) if steps > 1 else 0.0
    rows = centred(atoms).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    rows = rows.withColumn("distance", F.lit(start) + F.col("step") * F.lit(gap))
    return rows.select("geom_id", "step", "distance", "idx", "symbol", *((F.col(k) + F.col("distance") * F.lit(v / size)).alias(k) for k, v in zip("xyz", axis)))


def denticity(ligands: DataFrame, by: list[str], ligand: str, known: dict[str, int]) -> DataFrame:
    """Donor atoms of all ligands of a complex; a ligand that is not known has one."""
    n = F.coalesce(by_key({k: float(v) for k, v in known.items()}, F.lower(F.trim(F.col(ligand)))), F.lit(1.0))
    return ligands.groupBy(*by).agg(F.sum(n).cast("long").alias("denticity"))


def spin_gap(energies: DataFrame, by: list[str], spin: str, energy: str, low: str, high: str) -> DataFrame:
    """Energy of the high-spin state above the low-spin one in kcal/mol, and which is the ground state."""
    of = lambda v: F.max(F.when(F.col(spin) == v, F.col(energy)))
    rows = energies.groupBy(*by).agg(of(low).alias("__low"), of(high).alias("__high"))
    gap = (F.col("__high") - F.col("__low")) * HARTREE_KCAL
    return rows.select(*by, gap.alias("gap"), F.when(gap > 0, low).when(gap <= 0, high).alias("ground"))
