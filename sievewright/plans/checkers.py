"""Checks of plans and results by task, as rules over tables of many plans.

A plan is rows of nodes (plan, pos, id, kind, tool, input_id, output_id, args, products): args is a map
of text, products an array of artifact names. A row of kind "save" has the artifacts to save as its
products, one of kind "settings" the plan's settings as its args.
Each rule is a column over a plan's aggregated row, so all checks of a task are one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words by which a message is given a task, in order.
KEYWORDS = {
    "pka": ["pka", "acidity", "deprotonation", "acid dissociation", "ka "],
    "protonation": ["protonation", "protonization", "protonation site", "protonation sites"],
    "sp": ["single-point", "single point", "sp energy", "run_sp"],
    "nbo": ["nbo", "natural bond", "wiberg"],
    "solvation": ["solvat", "aqueous", "microsolvat", "nsolv", "in water"],
    "spectrum": ["ir spectrum", "infrared", "raman", "vibrational spectrum", "absorption band", "ir band", "spectroscop"],
    "tddft": ["tddft", "td-dft", "excited state", "excitation energy", "uv-vis", "uv/vis", "absorption spectrum", "electronic transition", "oscillator strength", "vertical excitation"],
    "scan": ["scan", "pes scan", "potential energy surface", "reaction coordinate", "bond scan", "angle scan", "dihedral scan", "surface scan", "energy profile", "dissociation curve", "torsion scan"],
    "ts": ["transition state", "ts search", "ts opt", "saddle point", "activation barrier", "activation energy", "optts", "ts structure", "find ts", "locate ts", "reaction barrier"],
    "casscf": ["casscf", "cas(", "active space", "multireference", "multi-reference", "sa-casscf", "state-averaged", "complete active space", "mcscf"],
    "interaction_scan": ["interaction scan", "interaction energy", "binding energy scan", "approach curve", "dissociation curve", "intermolecular scan", "pi stacking", "π stacking", "cation pi", "cation-pi", "dimer scan", "complex scan"],
    "coordination_sp": ["coordination compound", "build_coordination_complex", "metal complex", "coordination complex", "hexacyanide", "ethylenediamine", "edta", "dimethylglyoxim"],
    "eas": ["eas", "electrophilic aromatic", "aromatic substitution", "site selectivity", "site reactivity", "ortho para", "o/p director", "meta director", "fukui f", "npa charge", "natural charge", "aromatic reactivity", "most reactive site", "preferred site"],
}
#: The tools that checks ask for.
SP, OPT, FREQ, NBO, SPECTRUM, TDDFT, SCAN, TS, CASSCF = (f"run_{x}" for x in ("sp_energy", "opt_job", "freq_job", "nbo_job", "spectrum_job", "tddft_job", "scan_job", "ts_opt_job", "casscf_job"))
PROTON_TOOLS = ("structure_add_remove_proton", "structure_add_proton", "structure_remove_proton")
PKA = "compute_pka_calibrated"
SOLVATOR, SOLVATOR_THERMO, BUILD, DIMER, RANK_EAS = "run_solvator_cluster", "run_solvator_cluster_thermo", "build_coordination_complex", "build_dimer_xyz", "rank_eas_sites"


def detect(message: Column) -> Column:
    """The first task that a message has a word of; "struct" if none."""
    lower = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("struct")
    for task, words in reversed(KEYWORDS.items()):
        out = F.when(reduce(lambda a, b: a | b, (F.contains(lower, F.lit(w)) for w in words)), task).otherwise(out)
    return out


def summary(nodes: DataFrame) -> DataFrame:
    """A row for each plan: its nodes in order, the tools of its tool nodes, names of products (in lower
    case), what is saved, its settings' names, and what its pKa is calculated from."""
    none = F.array().cast("array<string>")
    calc = ((F.col("kind") == "tool") & (F.col("tool") == PKA)) | ((F.col("kind") == "llm") & F.exists(F.coalesce("products", none), lambda p: F.contains(F.lower(p), F.lit("pka"))))
    needs = F.when(F.col("kind") == "llm", F.split(F.coalesce(F.col("args")["needs_artifacts"], F.lit("")), ",")).otherwise(F.regexp_extract_all(F.to_json("args"), F.lit(r"\$\(artifacts\.([^)]+)\)"), F.lit(1)))
    lacks = lambda key: F.count_if((F.col("tool") == CASSCF) & (F.coalesce(F.col("args")[key], F.lit("")) == ""))
    gathered = lambda which, value: F.array_distinct(F.flatten(F.collect_list(F.when(which, value))))
    rows = nodes.groupBy("plan").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "kind", "tool", "input_id", "output_id"))).alias("nodes"),
        gathered(F.lit(True), F.coalesce("products", none)).alias("raw_names"),
        gathered(F.col("kind") == "save", F.coalesce("products", none)).alias("saved"),
        gathered(F.col("kind") == "settings", F.map_keys("args")).alias("settings"),
        gathered(calc, needs).alias("calculated_from"),
        F.count_if(calc).alias("n_calc"),
        F.count_if(F.array_contains(F.map_keys("args"), "nsolv")).alias("n_nsolv"),
        lacks("nel").alias("no_nel"),
        lacks("norb").alias("no_norb"),
    )
    tools = F.transform(F.filter("nodes", lambda n: n["kind"] == "tool"), lambda n: F.coalesce(n["tool"], F.lit("")))
    return rows.withColumns({"tools": tools, "names": F.transform("raw_names", lambda x: F.lower(x))})


def uses(*tools: str) -> Column:
    return F.arrays_overlap("tools", F.array(*map(F.lit, tools)))


def first(*tools: str) -> Column:
    """Place of the first node with one of these tools, from 1; 0 if there is none."""
    return F.array_position(F.transform("tools", lambda t: t.isin(*tools)), True)


def after(then: tuple[str, ...], before: tuple[str, ...]) -> Column:
    """Whether the first of `then` comes after the first of `before`, and both are there."""
    return (first(*before) > 0) & (first(*then) > first(*before))


def named(*words: str) -> Column:
    """Whether a product's name has one of these words."""
    return F.exists("names", lambda n: reduce(lambda a, b: a | b, (F.contains(n, F.lit(w)) for w in words)))


def count_kind(kind: str) -> Column:
    return F.size(F.filter("nodes", lambda n: n["kind"] == kind))


def count_tool(tool: str) -> Column:
    return F.size(F.filter("tools", lambda t: t == tool))


def _energy(n: Column) -> Column:
    return (F.startswith(n, F.lit("e_")) | F.endswith(n, F.lit("_eh")) | F.contains(n, F.lit("energy"))) & ~F.startswith(n, F.lit("g_"))


def _built_are_optimised() -> Column:
    ids = lambda tool, c: F.filter(F.transform(F.filter("nodes", lambda n: n["tool"] == tool), lambda n: n[c]), lambda x: F.coalesce(x, F.lit("")) != "")
    built = ids(BUILD, "output_id")
    return (F.size(built) > 0) & (F.size(F.array_except(built, ids(OPT, "input_id"))) == 0)


def _energy_strict(n: Column) -> Column:
    return (F.contains(n, F.lit("energy")) & F.contains(n, F.lit("_eh"))) | (F.endswith(n, F.lit("_eh")) & (F.startswith(n, F.lit("e_")) | F.startswith(n, F.lit("energy_"))))


no_llm = lambda: count_kind("llm") == 0


def _pka(reference: Column) -> dict[str, Column]:
    gibbs = lambda a: F.startswith(a, F.lit("G_")) & F.endswith(a, F.lit("_eh"))
    return {
        "uses_freq_not_sp": uses(FREQ) & ~uses(SP),
        "has_h_plus_ref": reference,
        "artifacts_G_eh": F.exists("saved", gibbs),
        "pka_in_artifacts": F.exists("saved", lambda a: F.contains(F.lower(a), F.lit("pka"))),
        "calc_node_exists": F.col("n_calc") >= 1,
        "freq_arts_in_needs": F.exists("calculated_from", lambda a: F.contains(a, F.lit("G_")) & F.contains(a, F.lit("_eh"))),
    }


#: The checks of each task, by name. A registry: callers may add tasks of their own.
CHECKERS: dict[str, Callable[[], dict[str, Column]]] = {
    "pka": lambda: _pka(F.array_contains("settings", "G_H_plus_ref_eh") | (count_tool(PKA) > 0)),
    "pka_relaxed": lambda: _pka(F.array_contains("settings", "G_H_plus_ref_eh") | (count_tool(PKA) > 0) | F.exists("nodes", lambda n: n["kind"].isin("llm", "tool") & F.contains(F.lower(F.coalesce(n["id"], F.lit(""))), F.lit("h_plus")))),
    "sp": lambda: {"has_sp_node": uses(SP), "no_freq_job": ~uses(FREQ), "has_energy_art": F.exists("names", _energy)},
    "nbo": lambda: {"has_opt_node": uses(OPT), "has_nbo_node": uses(NBO), "nbo_after_opt": after((NBO,), (OPT,)), "nbo_artifact": named("nbo")},
    "solvation": lambda: {"has_solvator": uses(SOLVATOR, SOLVATOR_THERMO), "nsolv_arg_set": F.col("n_nsolv") > 0, "uses_freq": uses(FREQ, SOLVATOR_THERMO)},
    "protonation": lambda: {"has_sp_node": uses(SP), "has_proton_tool": uses(*PROTON_TOOLS), "multiple_sp_nodes": count_tool(SP) >= 2, "has_energy_artifacts": F.exists("names", _energy), "has_comparison": named("best", "lowest", "delta", "comparison", "site", "result", "analysis") | (count_kind("llm") > 0)},
    "spectrum": lambda: {"has_spectrum_node": uses(SPECTRUM), "no_plain_freq": ~uses(FREQ), "has_opt_node": uses(OPT), "spectrum_after_opt": after((SPECTRUM,), (OPT,)), "ir_spectrum_art": named("ir_spectrum"), "no_llm_node": no_llm()},
    "tddft": lambda: {"has_tddft_node": uses(TDDFT), "has_opt_node": uses(OPT), "tddft_after_opt": after((TDDFT,), (OPT,)), "excited_states_art": named("excited_states"), "no_llm_node": no_llm()},
    "scan": lambda: {"has_scan_node": uses(SCAN), "scan_results_art": named("scan_results"), "no_llm_node": no_llm()},
    "ts": lambda: {"has_scan_node": uses(SCAN), "has_ts_opt_node": uses(TS), "has_freq_node": uses(FREQ, SPECTRUM), "ts_opt_after_scan": after((TS,), (SCAN,)), "freq_after_ts_opt": after((FREQ, SPECTRUM), (TS,)), "no_llm_node": no_llm()},
    "casscf": lambda: {"has_casscf_node": uses(CASSCF), "has_active_space": uses(CASSCF) & (F.col("no_nel") == 0) & (F.col("no_norb") == 0), "has_energy_artifact": named("energy")},
    "interaction_scan": lambda: {"has_dimer_build": uses(DIMER), "has_sp_monomer": uses(SP), "has_scan_node": uses(SCAN), "has_delta_e_llm": count_kind("llm") == 1, "interaction_curve_art": named("interaction_curve", "binding_energy"), "scan_results_art": named("scan_results")},
    "eas": lambda: {"has_opt_node": uses(OPT), "has_charge_calc": uses(SP, NBO), "has_ranking_tool": uses(RANK_EAS), "charge_artifact": named("npa", "nbo", "charge", "fukui", "mulliken"), "ranking_artifact": named("ranking", "site", "eas", "fukui")},
    "coordination_sp": lambda: {"has_build_node": uses(BUILD), "has_opt_node": uses(OPT), "has_sp_node": uses(SP), "build_before_opt": after((OPT,), (BUILD,)), "opt_before_sp": after((SP,), (OPT,)), "all_built_are_opted": _built_are_optimised(), "has_energy_art": F.exists("names", _energy_strict), "has_homo_lumo_art": named("homo", "lumo", "gap"), "has_dipole_art": named("dipole")},
    "struct": dict,
}


def check(nodes: DataFrame, task: str) -> DataFrame:
    """plan, check, ok of one task's checks, for every plan. KeyError for a task that has none."""
    rules = CHECKERS[task]()
    rows = summary(nodes)
    if not rules:
        return rows.select("plan", F.lit(None).cast("string").alias("check"), F.lit(None).cast("boolean").alias("ok")).where(F.lit(False))
    told = F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in rules.items()))
    return rows.select("plan", F.inline(told))


def register(task: str, rules: Callable[[], dict[str, Column]]) -> None:
    """A task's checks. Raises if it has some already."""
    if task in CHECKERS:
        raise ValueError(f"{task} has checks already")
    CHECKERS[task] = rules


# results: artifacts as rows (run, name, value) --------------------------------------------------------


def check_results(artifacts: DataFrame, task: str) -> DataFrame:
    """run, check, ok of what a run has left. artifacts: run, name, number (null if it is none), items
    (an array of maps of text, null if it is no list)."""
    lower = F.lower("name")
    pka, gibbs = (F.col("name") == "pka") | F.startswith("name", F.lit("pka_")), F.startswith("name", F.lit("G_")) & F.endswith("name", F.lit("_eh"))
    energy = F.startswith("name", F.lit("E_")) | F.contains(lower, F.lit("energy"))
    every = lambda which: F.count_if(which & ~F.coalesce(F.col("number") < 0, F.lit(False))) == 0

    def listed(word: str, checks: Callable[[Column], dict[str, Column]]):
        """Checks of the first list (by name) whose name has a word."""
        full = F.contains(lower, F.lit(word)) & (F.size("items") > 0)
        got = artifacts.groupBy("run").agg(F.min_by("items", F.when(full, F.col("name"))).alias("list"), F.count_if(full).alias("n"))
        return got, checks(F.when(F.col("n") > 0, F.col("list")).otherwise(F.expr("CAST(array() AS array<map<string,string>>)")))

    have = lambda sample, field: F.forall(F.slice(sample, 1, 3), lambda e: F.array_contains(F.map_keys(e), field))
    if task in ("pka", "pka_relaxed"):
        rows = artifacts.groupBy("run").agg(F.count_if(pka).alias("n_pka"), F.count_if(pka & F.col("number").between(-20, 60) & ~F.col("number").isin(-20, 60)).alias("n_fair"), F.count_if(gibbs).alias("n_g"), every(gibbs).alias("neg"))
        rules = {"pka_present": F.col("n_pka") > 0, "pka_reasonable": F.col("n_fair") > 0, "G_eh_present": F.col("n_g") >= 2, "G_negative": F.col("neg")}
    elif task == "sp":
        rows = artifacts.groupBy("run").agg(F.count_if(energy).alias("n_e"), every(energy).alias("neg"))
        rules = {"energy_present": F.col("n_e") > 0, "energy_negative": F.col("neg")}
    elif task == "spectrum":
        positive = lambda e: F.try_element_at(e, F.lit("freq_cm1")).try_cast("double") > 0
        rows, rules = listed("ir_spectrum", lambda x: {"ir_spectrum_present": F.size(x) > 0, "has_positive_freqs": F.exists(x, positive), "has_intensity_field": have(x, "intensity_km_mol")})
    elif task == "tddft":
        rows, rules = listed("excited_states", lambda x: {"excited_states_present": F.size(x) > 0, **{f"has_{f}": (F.size(x) > 0) & have(x, f) for f in ("energy_ev", "wavelength_nm", "oscillator_strength")}})
    elif task == "scan":
        rows, rules = listed("scan_results", lambda x: {"scan_results_present": F.size(x) > 0, "has_energy_eh": (F.size(x) > 0) & have(x, "energy_eh"), "several_points": F.size(x) >= 2})
    else:
        raise KeyError(task)
    told = F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in rules.items()))
    return rows.select("run", F.inline(told))


def audit(nodes: DataFrame, task: str) -> DataFrame:
    """plan, check, ok: whether a plan computes the right thing. For a pKa: a solvent in the method or a
    calibration, frequencies instead of single points, arithmetic by a tool; for single points: no
    needless frequencies and at least three of them; for substitution: optimised before charges."""
    methods = F.array_join(F.collect_list(F.upper(F.coalesce(F.col("args")["method"], F.lit("")))), " ")
    solvent_key = F.exists(F.map_keys("args"), lambda k: (F.contains(F.lower(k), F.lit("solvent")) | F.contains(F.lower(k), F.lit("solvation"))) & ~F.startswith(F.lower(k), F.lit("method")))
    references = (F.col("tool") == "compute_pka_calibrated") & (F.coalesce(F.col("args")["references"], F.lit("")) != "")
    rows = nodes.where("kind = 'tool'").groupBy("plan").agg(methods.alias("methods"), F.collect_set("tool").alias("tools"), F.count_if(F.coalesce(solvent_key, F.lit(False))).alias("n_keys"), F.count_if(references).alias("n_refs"), F.count_if(F.col("tool") == SP).alias("n_sp"))
    wet = reduce(lambda a, b: a | b, (F.contains("methods", F.lit(k)) for k in ("CPCM", "SMD", "COSMO", "PCM")))
    has = lambda t: F.array_contains("tools", t)
    rules = {
        "pka": {"solvation_in_method": wet, "no_inert_solvation_keys": wet | (F.col("n_keys") == 0), "freq_not_sp": has(FREQ) & ~has(SP), "deterministic_pka": has("compute_pka_calibrated"), "calibration_refs_used": F.col("n_refs") > 0, "solvation_or_calibration": wet | (F.col("n_refs") > 0)},
        "sp": {"no_needless_freq": ~has(FREQ), "single_sp_per_compound": F.col("n_sp") >= 3},
        "eas": {"opt_before_charges": has(OPT)},
    }[task]
    told = F.array(*(F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in rules.items()))
    return rows.select("plan", F.inline(told))


def reflect(function: Callable) -> list[tuple[str, str, str, bool]]:
    """(tool, argument, type, required) of a function's own signature; the type is the annotation's name."""
    import inspect

    rows = []
    for name, p in inspect.signature(function).parameters.items():
        if p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD):
            continue
        kind = "any" if p.annotation is p.empty else getattr(p.annotation, "__name__", str(p.annotation))
        rows.append((function.__name__, name, kind, p.default is p.empty))
    return rows


class Registry:
    """Functions by name, for columns or for driver code. A name that is taken is refused."""

    def __init__(self):
        self.functions: dict[str, Callable] = {}

    def add(self, function: Callable, name: str | None = None) -> Callable:
        name = name or function.__name__
        if name in self.functions:
            raise ValueError(f"{name} is registered already")
        self.functions[name] = function
        return function

    def merge(self, other: Registry) -> None:
        if both := sorted(self.functions.keys() & other.functions.keys()):
            raise ValueError(f"registered in both: {both}")
        self.functions |= other.functions

    def manifest(self) -> list[tuple[str, str, str, bool]]:
        """The arguments of all functions."""
        return [row for f in self.functions.values() for row in reflect(f)]

    def call(self, name: str, /, **args):
        """What the function returns, with a status: "ok", or "error" with the message."""
        if name not in self.functions:
            return {"status": "error", "error": f"no function {name}"}
        try:
            out = self.functions[name](**args)
        except Exception as e:  # noqa: BLE001  the caller gets it as a result
            return {"status": "error", "error": f"{type(e).__name__}: {e}"}
        return out if isinstance(out, dict) and "status" in out else {"status": "ok", "result": out}


def duplicates_fixed(nodes: DataFrame) -> DataFrame:
    """nodes with ids that a plan has more than once made different: the second gets `_2` and so on, by
    place. Nodes without an id stay. Adds `was`, the id before."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("plan", "id").orderBy("pos"))
    has = F.coalesce("id", F.lit("")) != ""
    new = F.when(has & (F.col("__k") > 1), F.concat("id", F.lit("_"), F.col("__k").cast("string"))).otherwise(F.col("id"))
    return nodes.withColumn("__k", k).withColumn("was", F.col("id")).withColumn("id", new).drop("__k")
