"""Names of compounds resolved as far as that goes without a toolkit or a network."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import literals

# The elements in order of their atomic number, and names of ions and atoms.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd "
    "In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn"
).split()
ION_NAMES = {
    "chloride": ("Cl", -1), "chloride ion": ("Cl", -1), "chloride anion": ("Cl", -1), "fluoride": ("F", -1), "fluoride ion": ("F", -1), "fluoride anion": ("F", -1),
    "bromide": ("Br", -1), "bromide ion": ("Br", -1), "bromide anion": ("Br", -1), "iodide": ("I", -1), "iodide ion": ("I", -1), "iodide anion": ("I", -1),
    "oxide": ("O", -2), "sulfide": ("S", -2), "ferrous": ("Fe", 2), "ferric": ("Fe", 3), "ferrous ion": ("Fe", 2), "ferric ion": ("Fe", 3),
    "iron(ii)": ("Fe", 2), "iron(iii)": ("Fe", 3), "cobalt(ii)": ("Co", 2), "cobalt(iii)": ("Co", 3), "nickel(ii)": ("Ni", 2), "copper(ii)": ("Cu", 2), "zinc(ii)": ("Zn", 2),
    "manganese(ii)": ("Mn", 2), "manganese(iii)": ("Mn", 3), "iron atom": ("Fe", 0), "iron": ("Fe", 0), "cobalt atom": ("Co", 0), "nickel atom": ("Ni", 0),
    "copper atom": ("Cu", 0), "zinc atom": ("Zn", 0), "chlorine atom": ("Cl", 0), "bromine atom": ("Br", 0), "sodium ion": ("Na", 1), "potassium ion": ("K", 1),
    "lithium ion": ("Li", 1), "magnesium ion": ("Mg", 2), "calcium ion": ("Ca", 2),
}

BARE = r"^([A-Z][a-z]?)(?:(\d*)([+-]))?$"
SUFFIX = r"([+-])(\d*)$"


def signed(sign: Column, size: Column) -> Column:
    """0 without a sign, 1 where a sign has no number; null for numbers beyond an int."""
    return F.when(sign == "", F.lit(0)).otherwise(F.when(sign == "+", 1).otherwise(-1) * F.coalesce(F.nullif(size, F.lit("")), F.lit("1")).try_cast("int"))


def suffix_charge(text: Column) -> Column:
    return signed(F.regexp_extract(text, SUFFIX, 1), F.regexp_extract(text, SUFFIX, 2))


def single_atom(route: str, symbol: Column, charge: Column) -> Column:
    """The resolution to one atom or ion; null for unknown elements and charges beyond the electrons."""
    number = F.array_position(literals(ELEMENTS), symbol).cast("int")
    multiplicity = (number - charge) % 2 + 1
    return F.when((number > 0) & (number >= charge), F.struct(F.lit(route).alias("route"), symbol.alias("symbol"), charge.alias("charge"), multiplicity.alias("multiplicity")))


def bare(route: str, text: Column) -> Column:
    """Of Fe, Fe3+, Cl-."""
    return F.when(F.rlike(text, F.lit(BARE)), single_atom(route, F.regexp_extract(text, BARE, 1), signed(F.regexp_extract(text, BARE, 3), F.regexp_extract(text, BARE, 2))))


def resolved(name: Column) -> Column:
    """(route, symbol, charge, multiplicity) of a name, by the first of these that knows it:

    "structure" (a line notation: no space, one of =#[]/\\@; charge from its end or, if that has none,
    its brackets), "ion" (Fe3+), "name" (ferric ion), "atom" (Fe atom), and else "lookup": to be found
    in a table of compounds, with the charge the name ends in. Multiplicities are the least that the
    number of electrons allows, 1 where that is unknown. Empty and null names are "empty".
    """
    text = F.trim(F.coalesce(name, F.lit("")))
    lower = F.lower(text)
    row = lambda route, charge: F.struct(F.lit(route).alias("route"), F.lit(None).cast("string").alias("symbol"), charge.cast("int").alias("charge"), F.lit(1).alias("multiplicity"))
    ending = suffix_charge(text)
    brackets = F.aggregate(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1)), F.lit(0), lambda total, part: total + suffix_charge(part))
    structure = F.rlike(text, F.lit(r"[=#\[\]/\\@]")) & ~F.contains(text, F.lit(" "))
    known = F.element_at(F.create_map(*(x for k, (s, c) in ION_NAMES.items() for x in (F.lit(k), F.struct(F.lit(s).alias("symbol"), F.lit(c).alias("charge"))))), lower)
    found = F.coalesce(
        bare("ion", text),
        F.when(known.isNotNull(), single_atom("name", known["symbol"], known["charge"])),
        F.when(F.endswith(lower, F.lit(" atom")), bare("atom", F.trim(F.left(text, F.length(text) - 5)))),
        row("lookup", ending),
    )
    return F.when(text == "", row("empty", F.lit(0))).when(structure, row("structure", F.when(ending == 0, brackets).otherwise(ending))).otherwise(found)
