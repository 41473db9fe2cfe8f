"""Spin multiplicities of transition-metal centres from d-electron counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import first_match, literals
from .geometry import by_key

# Groups of metals, and ligands by the strength of their field.
GROUPS = {"cr": 6, "mn": 7, "fe": 8, "co": 9, "ni": 10, "cu": 11, "zn": 12, "mo": 6, "tc": 7, "ru": 8, "rh": 9, "pd": 10, "ag": 11, "cd": 12, "w": 6, "re": 7, "os": 8, "ir": 9, "pt": 10, "au": 11, "hg": 12}
STRONG = "cn cyanide co carbonyl no bipy phen terpy en edta cyclam cyclen acac acetylacetone nh3 ammonia dppe dmpe dmf dmi".split()
WEAK = "cl chloride br bromide f fluoride i iodide water h2o oh hydroxide ncs thiocyanate acetate formate ox oxalate no2 nitrite azide".split()
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6}


def strong_field(ligands: Column) -> Column:
    """At least as many ligands of a strong field as of a weak one; unknown ones don't count."""
    among = lambda names: F.size(F.filter(ligands, lambda x: F.array_contains(literals(names), F.lower(x))))
    return F.coalesce(among(STRONG) >= among(WEAK), F.lit(True))


def multiplicity(metal: Column, oxidation: Column, geometry: Column, ligands: Column) -> Column:
    """Unpaired d electrons and one; null where geometry and field don't settle it.

    In an octahedron a weak field leaves as many electrons unpaired as five orbitals allow, a strong
    one fills three orbitals first (and pairs the last two of eight).
    """
    state = F.upper(F.trim(oxidation))
    ox = F.coalesce(by_key(ROMAN, state), state.try_cast("int"))
    d = by_key(GROUPS, F.lower(metal)) - ox
    shape = F.lower(geometry)
    weak = F.when(d <= 5, d).otherwise(10 - d)
    strong = F.when(d <= 6, 6 - d).when(d == 7, 1).otherwise(0)
    settled = first_match([(d == 10, 0), (d == 9, 1), ((d == 8) & (shape == "sqp"), 0), ((d == 8) & (shape == "thd"), 2), ((d == 3) & (shape == "oct"), 3), ((shape == "oct") & d.between(4, 8), F.when(strong_field(ligands), strong).otherwise(weak))])
    return (settled + 1).cast("int")
