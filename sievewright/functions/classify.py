"""Rules that label records: element sets, cells, size bins, spellings, outcomes and error codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element sets.
TM = "Sc Ti V Cr Mn Fe Co Ni Cu Zn Y Zr Nb Mo Tc Ru Rh Pd Ag Cd Hf Ta W Re Os Ir Pt Au Hg La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu".split()
OPEN_SHELL_TM = "Ti V Cr Mn Fe Co Ni Cu Mo Tc Ru Rh Re Os Ir Pt".split()
HEAVY = "Br Kr Rb Sr In Sn Sb Te I Xe Cs Ba Tl Pb Bi Po At Rn".split()
METAL_SYSTEMS = ("TM_open", "TM_closed", "heavy_elem")
PROTOCOL_TASKS = ("SCAN", "TS_OPT", "IRC", "NBO", "NMR")

# Spellings of functionals that differ from the canonical one.
SPELLING = {
    "PBE1PBE": "PBE0", "PBEPBE": "PBE", "SVWN": "LDA", "SVWN5": "LDA", "SVWN3": "LDA", "WB97XD": "WB97X-D", "M062X": "M06-2X", "M06HF": "M06-HF", "M06L": "M06-L", "M11L": "M11-L",
    "MN15L": "MN15-L", "MN12L": "MN12-L", "CAMB3LYP": "CAM-B3LYP", "LCWPBE": "LC-WPBE", "B97D": "B97-D", "B97D3": "B97-D3", "UBLYP": "BLYP", "UBP86": "BP86", "UBPW91": "BPW91", "PW91PW91": "PW91",
    "PBEH": "PBE0", "UPBEPBE": "PBE", "HCTH93": "HCTH", "HCTH147": "HCTH", "HCTH407": "HCTH", "UB3P86": "B3P86", "UB3LYP": "B3LYP", "UB3PW91": "B3PW91", "HSE": "HSE06", "TPSSh": "TPSSH",
    "B2PLYPD3": "B2PLYP", "UB97D": "B97-D", "UB97D3": "B97-D3", "UWB97XD": "WB97X-D", "UWB97X-D": "WB97X-D", "TPSSTPSS": "TPSS", "HSEH1PBE": "HSE06", "M062": "M06-2X",
}

# Task keywords, the first list with a hit wins.
TASK_KEYWORDS = (
    ("TDDFT", ("uv-vis", "uv/vis", "absorption", "excited state", "tddft", "spectrum")),
    ("TS_OPT", ("transition state", " ts ", "activation energy", "barrier")),
    ("SCAN", ("scan", "dihedral", "rotational barrier", "torsion")),
    ("IRC", ("irc", "reaction path", "intrinsic reaction coordinate")),
    ("NBO", ("nbo", "natural bond", "wiberg")),
    ("NMR", ("nmr", "chemical shift")),
    ("FREQ", ("pka", "acidity", "deprotonation", "gibbs", "free energy", "enthalpy", "freq")),
    ("OPT", ("optimi",)),
)


def literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def contains_any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def first_match(rules, default=None) -> Column:
    """The value of the first (condition, value) that holds; a null condition does not hold."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def elements_or_none(elements: Column) -> Column:
    return F.coalesce(elements, F.array().cast("array<string>"))


def has_tm(elements: Column) -> Column:
    return F.arrays_overlap(elements_or_none(elements), literals(TM))


def is_metal(elements: Column) -> Column:
    return F.arrays_overlap(elements_or_none(elements), literals([*TM, *HEAVY]))


def metal_group(elements: Column) -> Column:
    """The metals of a record as a set: sorted, without repeats."""
    return F.array_sort(F.array_distinct(F.array_intersect(elements_or_none(elements), literals([*TM, *HEAVY]))))


def system_type(elements: Column, multiplicity: Column) -> Column:
    e = elements_or_none(elements)
    is_open = F.coalesce(multiplicity > 1, F.lit(False)) | F.arrays_overlap(e, literals(OPEN_SHELL_TM))
    return first_match([(F.arrays_overlap(e, literals(HEAVY)), "heavy_elem"), (has_tm(e) & is_open, "TM_open"), (has_tm(e), "TM_closed")], "organic")


def cell(system: Column, task: Column, family: Column) -> Column:
    return first_match([(family == "CASSCF", "rag_casscf"), (task.isin(*PROTOCOL_TASKS), "rag_protocol"), (system.isin(*METAL_SYSTEMS), "metal_general"), (task == "TDDFT", "organic_TDDFT")], "organic_general")


def in_cell(target: Column, own_cell: Column, system: Column) -> Column:
    """Label match; the metal cell goes by system type, as some labels are older than the cell."""
    return F.coalesce(F.when(target == "metal_general", system.isin(*METAL_SYSTEMS)).otherwise(own_cell == target), F.lit(False))


def atoms(n_atoms: Column, n_sites: Column) -> Column:
    """The first of the two that is neither null nor 0."""
    return F.coalesce(F.nullif(n_atoms, F.lit(0)), F.nullif(n_sites, F.lit(0)))


def scale_bucket(n: Column) -> Column:
    return first_match([(n.isNull() | (n == 0), "unknown"), (n <= 10, "S"), (n <= 30, "M"), (n <= 100, "L")], "XL")


def charge_bucket(text: Column) -> Column:
    """Bins of the charge named in a prompt ("charge=-1"); null if there is none."""
    c = F.regexp_extract(text, r"charge=(-?\d+)", 1).try_cast("int")
    return F.when(c.isNotNull(), first_match([(c <= -2, "<= -2"), (c == -1, "-1"), (c == 0, "0 (neutral)"), (c == 1, "+1")], ">= +2"))


def normalize_basis(basis: Column) -> Column:
    return F.regexp_replace(F.trim(basis), "(?i)def2([A-Z])", "def2-$1")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """The mapped value, or null; the table is a literal."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), key)


def canonical(name: Column, spelling: dict[str, str], excluded, family: dict[str, str]) -> Column:
    """Spelling corrected, then null if excluded, then mapped to its family. An empty name stays."""
    fixed = F.coalesce(lookup(spelling, name), name)
    return F.when(fixed.isin(*excluded), F.lit(None).cast("string")).otherwise(F.coalesce(lookup(family, fixed), fixed))


def hill_formula(elements: Column) -> Column:
    """C and H first, the others by symbol, each with its count if above 1."""
    e = elements_or_none(elements)
    kinds = F.array_sort(F.array_distinct(e))
    order = F.concat(F.filter(literals(["C", "H"]), lambda x: F.array_contains(kinds, x)), F.filter(kinds, lambda x: ~x.isin("C", "H")))

    def one(x):
        n = F.size(F.filter(e, lambda y: y == x))
        return F.concat(x, F.when(n > 1, n.cast("string")).otherwise(F.lit("")))

    return F.array_join(F.transform(order, one), "")


def error_code(log: Column) -> Column:
    """What a failed job's log says, in order of precedence; null if nothing known."""
    u = F.upper(log)
    says = lambda *parts: contains_any(u, parts)
    return first_match([
        (says("INPUT ERROR"), "INPUT_ERROR"),
        (says("SCF NOT CONVERGED", "FAILED TO CONVERGE"), "SCF_NOT_CONVERGED"),
        (says("***IMAGINARY MODE***"), "IMAG_FREQ"),
        (says("THE CAS PROCEDURE HAS NOT CONVERGED", "CASSCF ORBITAL OPTIMIZATION DID NOT CONVERGE", "CAS PROCEDURE DID NOT CONVERGE") | (says("CASSCF") & says("NOT CONVERGED")), "CASSCF_NOT_CONVERGED"),
    ])


def payload_error_code(code: Column, status: Column, text: Column, has_low_mode: Column) -> Column:
    """The code of a tool's result: its own, else by status, else by its texts, else by its modes."""
    u = F.upper(F.coalesce(text, F.lit("")))
    says = lambda *parts: contains_any(u, parts)
    return first_match([
        (F.coalesce(code, F.lit("")) != "", code),
        (status == "timeout", "RESOURCE_LIMIT"),
        (says("INPUT ERROR"), "INPUT_ERROR"),
        (says("SCF NOT CONVERGED"), "SCF_NOT_CONVERGED"),
        (says("IMAGINARY") & says("MODE", "FREQ"), "IMAG_FREQ"),
        (says("CASSCF") & says("NOT CONVERGED"), "CASSCF_NOT_CONVERGED"),
        (says("GEOM") & says("INVALID", "FAILED", "BAD"), "GEOM_INVALID"),
        (says("RESOURCE", "TIME LIMIT"), "RESOURCE_LIMIT"),
        (F.coalesce(has_low_mode, F.lit(False)), "IMAG_FREQ"),
    ])


def guess_task(text: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return first_match([(contains_any(padded, words), task) for task, words in TASK_KEYWORDS], "SP")


def guess_solvent(text: Column) -> Column:
    return F.when(contains_any(F.lower(text), ("water", "aqueous")), "water")


# Labels that are no basis sets, and the shapes of those that are.
PLACEHOLDERS = ("GEN", "GENECP", "CHKBASIS", "READ")
FUNCTIONAL_TOKENS = (
    "B3LYP", "PBE", "PBE0", "PBE1PBE", "PBEPBE", "BLYP", "BP86", "B3PW91", "BEPBE", "TPSS", "TPSSH", "M06", "M06L", "M06-L", "M062X", "M06-2X", "M11L", "MN15L", "MN12L", "CAM-B3LYP", "WB97X", "WB97XD",
    "WB97X-D", "WB97X-D3", "WB97", "WB97M-V", "B2PLYP", "SVWN", "SVWN5", "SVWN3", "LDA", "HF", "RHF", "UHF", "MP2", "CCSD", "CCSDT", "CCSD(T)", "QCISD", "CISD", "CI", "CISDT", "FCI", "CASSCF", "CASPT2",
    "NEVPT2", "MRMP2", "MRCI", "DLPNO-CCSD(T)", "PM6", "PM7", "AM1", "PM3", "QCISD(T)", "LC-WPBE", "LC-WPBE-D3", "PBEH-3C", "B97-D3", "B3LYP-D3", "HSE06", "TPSSH-D3BJ",
)
BASIS_SHAPES = (
    r"(ma-)?def2-?(SV|SVP|SVPD|TZVP|TZVPP|TZVPD|QZVP|QZVPP|TZV|mTZVPP)(-?J|/J|/C)?", r"(aug-)?cc-?pV[DTQ5-6]Z(-PP|-DK|-F12)?", r"(aug-)?cc-?pwCV[DTQ5]Z(-PP)?", r"6-31\+{0,2}G(\(\d*[dfp,+]*\)|\*{1,2})?",
    r"6-311\+{0,2}G(\([0-9dfpsg,+]*\)|\*{1,2})?", r"6-31\+{0,2}G(\([0-9dfpsg,+]*\))", r"CEP-(31|121)G\*?", r"def2-QZVPPD", r"def2-TZVP\(-f\)", r"3-21G\*?", r"STO-?3G", r"4-31G", r"LANL2DZ", r"LANL08",
    r"SDD(All)?", r"SARC-?.*", r"ZORA-?def2-?.*", r"DKH-?def2-?.*", r"(aug-)?pc(seg)?-?[0-4]", r"(TZVP|SVP|QZVP|TZV|DZ|TZ|QZ|DZP|TZP)", r"EPR-?(II|III)", r"IGLO-?(II|III)", r"W1-?mtsmall", r"(aug-)?ANO-?.*",
    r"x2c-.*", r"old-?def2-?.*", r"Wachters\+f",
)
BASIS_PATTERN = "(?i)^(?:" + "|".join(BASIS_SHAPES) + ")$"
ARTIFACT_PATTERN = r"[=;{}]|^\d+$|^\)|\([^)]*$"
#: Methods by cost.
CORRELATED = r"(?i)(CCSD|MP[234]|QCISD|CISD|CEPA|CASPT2|NEVPT2|DLPNO)"
COSTLY_METHOD = r"(?i)(CCSD|MP[234]|QCISD|CISD|CEPA|CASSCF|CASPT2|NEVPT2|\bHF\b|\bRHF\b|\bUHF\b|\bROHF\b)"
COSTLY_BASIS = r"(?i)(pV5Z|pCV5Z|pCVQZ|pVQZ|QZVPP|QZVP\b|aug-cc-pV[Q56]Z)"
WAVEFUNCTION = ("CCSD", "CCSD(T)", "DLPNO-CCSD(T)", "MP2", "QCISD")
PURE_GGA = ("PBE", "BP86")
AUX_ERROR = r"(?i)please provide an AuxC basis|need at least one auxiliary basis set|not an appropriate auxiliary basis set for correlated methods"


def label_class(basis: Column) -> Column:
    """Validity of a basis label, first rule that holds."""
    b = F.trim(basis)
    u = F.replace(F.upper(b), F.lit(" "), F.lit(""))
    return first_match([(basis.isNull() | (b == ""), "null"), (u.isin(*PLACEHOLDERS), "placeholder"), (u.isin(*FUNCTIONAL_TOKENS), "functional"), (F.rlike(b, F.lit(BASIS_PATTERN)), "ok"), (F.rlike(b, F.lit(ARTIFACT_PATTERN)), "artifact")], "unknown")


def is_cheap(functional: Column, basis: Column) -> Column:
    """Neither is missing and neither is on the lists of costly ones."""
    f, b = F.coalesce(functional, F.lit("")), F.coalesce(basis, F.lit(""))
    return (f != "") & (b != "") & ~F.rlike(f, F.lit(COSTLY_METHOD)) & ~F.rlike(b, F.lit(COSTLY_BASIS))


def aux_plan(functional: Column, precedent: Column) -> Column:
    return first_match([(~F.rlike(functional, F.lit(CORRELATED)), "not_applicable"), (F.coalesce(precedent, F.lit("")) != "", "precedent")], "autoaux_fallback")


def failure_class(frequency: Column, functional: Column, rare: int = 5) -> Column:
    n = F.coalesce(frequency, F.lit(0))
    return first_match([(n <= rare, F.concat(F.lit("mechanism_1_rare_precedent (n="), n.cast("string"), F.lit(")"))), (functional.isin(*WAVEFUNCTION), "mechanism_2_popular_suboptimal_wf"), (functional.isin(*PURE_GGA), "mechanism_3_common_gga_bias")], "unclassified_worse")


def outcome(plan: Column, status: Column, error: Column) -> Column:
    """How a run with this plan for its auxiliary basis ended."""
    aux = F.rlike(F.coalesce(error, F.lit("")), F.lit(AUX_ERROR))
    return first_match([(plan == "not_applicable", "not_applicable"), (status == "ok", F.concat(plan, F.lit("_ok"))), (aux, F.concat(plan, F.lit("_failed")))], F.concat(plan, F.lit("_unrelated_error")))


def first_keyword(text: Column, values: dict[str, str]) -> Column:
    """The value of the first key that the text has as whole words."""
    lower = F.lower(text)
    return first_match([(F.rlike(lower, F.lit(rf"\b{key}\b")), value) for key, value in values.items()])
