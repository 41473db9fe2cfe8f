"""Artifacts, reports and checks of plans, sites of molecules, features and resampling on small cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.determinism import uniform
from sievewright.functions import extract as X
from sievewright.functions import geometry as G
from sievewright.functions import sites
from sievewright.operators import features as V
from sievewright.operators import learning as L
from sievewright.operators import resample as P
from sievewright.operators import retrieval as R
from sievewright.plans import artifacts as A
from sievewright.plans import checkers


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_paths_and_products():
    result = {"status": "ok", "energy": -1.5, "list": [{"x": 1}, {"x": 2}], "none": None}
    assert A.get_path(result, "list.1.x") == 2 and A.get_path(result, "list.9.x") is None and A.get_path(result, ["energy", "x"]) is None
    assert A.set_path({"a": {"b": 1}, "c": 2}, "a.d.e", 3) == {"a": {"b": 1, "d": {"e": 3}}, "c": 2}
    assert A.products("n", None, result) == {"n.energy": -1.5, "n.list": result["list"]}
    assert A.products("n", {"E": "energy", "two": {"p": "list.0.x", "q": "no"}, "lost": "no"}, result) == {"E": -1.5, "two": {"p": 1}}


def test_patches_keep_the_solvent():
    args = {"method": "B3LYP CPCM(Water)", "ncores": 1}
    assert A.patched(args, {"method": "PBE0", "scf": {"maxiter": "300"}, "resources": {"ncores": 4}, "unknown": 1}) == {"method": "PBE0 CPCM(Water)", "ncores": 4, "scf_max_iter": 300}
    assert A.patched(args, {"method": "PBE0 SMD(thf)"})["method"] == "PBE0 SMD(thf)" and A.patched({"method": "HF"}, {"method": "MP2"}) == {"method": "MP2"}


def test_reports(spark, tmp_path):
    plan = {"nodes": [{"id": "a"}, {"id": "b"}], "final_report": {"fields": ["E", "G", "x", "lost"]}}
    got = A.final_report(plan, {"E": 1}, {"a": {"properties": {"G": 2}}, "b": {"G": 3, "artifacts": {"x": 4}}}, "ok", [1])
    assert got == {"status": "ok", "run_log": [1], "E": 1, "G": 2, "x": 4, "lost": None}
    try:
        raise ValueError("bad")
    except ValueError as e:
        bug = A.bug_report({"id": "n", "tool": "t"}, e, "trace")
    paths = A.write_report(spark, bug, str(tmp_path), "bug_n", "Bug")
    assert json.load(open(paths[0]))["error_type"] == "ValueError" and "## node_spec" in open(paths[1]).read()
    text = A.result_prompt({"last_status": "ok", "artifacts": {"E": 1}, "run_log": list(range(50))}, "do it")
    assert text.startswith("User request:\ndo it") and "Workflow status: ok" in text and "  30," in text and "  29," not in text
    assert A.result_prompt({"status": "ok"}, "x" * 100, 50).endswith("...<truncated>...\n")
    assert A.compound_context([{"name": "w", "formula": "H2O", "charge": 0}]).split("\n")[1] == "  - w: formula=H2O, charge=0" and A.compound_context([{"name": "w"}], "xyz") == ""


def test_flowchart():
    plan = {"nodes": [{"id": "a-1", "kind": "tool", "tool": "t", "on_error": [{"action": "stop", "stop_reason": "no"}]}, {"id": "b", "kind": "checkpoint", "needs": ["a-1", "lost"], "on_fail": {"action": "branch", "branch_to": "a-1"}}]}
    text = A.flowchart(plan)
    assert "N_a_1 --> N_b" in text and 'N_b -. "on_fail: branch" .-> N_a_1' in text and "STOP" in text and "lost" not in text
    with pytest.raises(ValueError):
        A.flowchart({"nodes": []})


NODE = "plan string, pos int, id string, kind string, tool string, input_id string, output_id string, args map<string,string>, products array<string>"


def test_checkers(spark):
    node = lambda plan, pos, tool, kind="tool", args=None, products=None, i=None, o=None: (plan, pos, f"n{pos}", kind, tool, i, o, args or {}, products or [])
    rows = [node("p", 1, "run_opt_job"), node("p", 2, "run_freq_job"), node("p", 3, "compute_pka_calibrated", args={"g": "$(artifacts.G_HA_eh)"}), node("p", 4, None, "save", products=["G_HA_eh", "pKa"])]
    rows += [node("c", 1, "build_coordination_complex", o="x"), node("c", 2, "run_opt_job", i="x"), node("c", 3, "run_sp_energy", products=["E_x_eh", "homo_gap", "dipole"]), node("q", 1, "run_casscf_job", args={"nel": "4"}, products=["energy"])]
    df = spark.createDataFrame(rows, NODE)
    told = lambda task: {(r.plan, r.check): r.ok for r in checkers.check(df, task).collect()}
    pka = told("pka")
    assert all(ok for (plan, _), ok in pka.items() if plan == "p") and not pka["c", "calc_node_exists"]
    assert all(ok for (plan, _), ok in told("coordination_sp").items() if plan == "c") and not told("casscf")["q", "has_active_space"]
    assert checkers.check(df, "struct").count() == 0 and len(told("sp")) == 9
    with pytest.raises(KeyError):
        checkers.check(df, "nothing")
    with pytest.raises(ValueError):
        checkers.register("sp", dict)
    items = spark.createDataFrame([("r", "my_IR_spectrum", None, [{"freq_cm1": "100", "intensity_km_mol": "1"}]), ("s", "scan_results", None, [{"energy_eh": "1"}, {"x": "2"}])], "run string, name string, number double, items array<map<string,string>>")
    assert {r.check: r.ok for r in checkers.check_results(items, "spectrum").collect() if r.run == "r"} == {"ir_spectrum_present": True, "has_positive_freqs": True, "has_intensity_field": True}
    assert {r.check: r.ok for r in checkers.check_results(items, "scan").collect() if r.run == "s"} == {"scan_results_present": True, "has_energy_eh": False, "several_points": True}
    assert [one(spark, checkers.detect(F.lit(t))) for t in ("find the TS structure", "pKa of X", "", None)] == ["ts", "pka", "struct", "struct"]


def test_registry():
    def tool(name: str, n: int = 2):
        return name * n

    r, other = checkers.Registry(), checkers.Registry()
    r.add(tool)
    other.add(lambda: {"status": "warning"}, "warn")
    r.merge(other)
    assert r.manifest()[:2] == [("tool", "name", "str", True), ("tool", "n", "int", False)]
    assert r.call("tool", name="a") == {"status": "ok", "result": "aa"} and r.call("warn") == {"status": "warning"}
    assert r.call("no")["status"] == "error" and "TypeError" in r.call("tool")["error"]
    with pytest.raises(ValueError):
        r.add(tool)
    with pytest.raises(ValueError):
        r.merge(other)


def test_sites_and_protons(spark):
    rows = [(1, 0, "O", 0.0, 0.0, 0.0, None), (1, 1, "H", 0.96, 0.0, 0.0, None), (1, 2, "H", -0.24, 0.93, 0.0, "Acid"), (2, 0, "N", 0.0, 0.0, 0.0, None)]
    atoms = spark.createDataFrame(rows, "geom_id long, idx long, symbol string, x double, y double, z double, tag string")
    assert [(r.geom_id, r.idx) for r in sites.deprotonation(atoms).collect()] == [(1, 2)]
    assert {(r.geom_id, r.idx, r.score) for r in sites.protonation(atoms).collect()} == {(1, 0, 28.0), (2, 0, 20.0)}
    left = sites.without_proton(atoms).orderBy("idx").collect()
    assert [(r.geom_id, r.idx, r.symbol) for r in left] == [(1, 0, "O"), (1, 1, "H")]
    new = {r.geom_id: (r.idx, r.x, r.y, r.z) for r in sites.with_proton(atoms).where("symbol = 'H' and (geom_id = 2 or idx = 3)").collect()}
    assert new[2] == (1, 0.0, 0.0, 1.01) and new[1][0] == 3 and math.dist(new[1][1:], (0, 0, 0)) == pytest.approx(0.97)
    assert [r.idx for r in sites.select(atoms, "@ACID").collect()] == [2] and [r.idx for r in sites.select(atoms, "*").collect()] == [2]
    assert {r.geom_id for r in sites.select(atoms, "line:3").collect()} == {1} and sites.select(atoms, "oh", 1).count() == 0
    with pytest.raises(ValueError):
        sites.select(atoms, "line:x")
    assert [one(spark, c) for c in G.unit([F.lit(0.0)] * 3)] == [0.0, 0.0, 1.0] and [one(spark, c) for c in G.cross([F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0), F.lit(0.0)])] == [0, 0, 1]


def test_features_know_training_words_only(spark):
    schema = "n_atoms int, charge int, multiplicity int, solvent string, elements array<string>, task_type string"
    train = spark.createDataFrame([(10, 0, 1, None, ["C", "H"], "SP")], schema)
    other = spark.createDataFrame([(None, -1, 2, " x ", ["C", "Fe"], None)], schema)
    v = V.fit(train)
    assert V.names(v) == ["log1p_n_atoms", "charge", "mult_ne_1", "has_solvent", "elem_C", "elem_H", "task_SP", *(f"scale_{s}" for s in V.SCALES)]
    assert other.select(V.row(v)).first()[0] == [0, -1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1]
    assert V.fit(train, True).elements == tuple(V.ORGANIC)


def test_bootstrap_by_hand(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, float(v)) for g in "ab" for i, v in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    numbered = P.positions(df, ["g"], ["k"]).collect()
    place = {(r.g, r.pos): r.v for r in numbered}
    assert sorted(place) == [(g, i) for g in "ab" for i in range(1, 41)] and {r.pos_n for r in numbered} == {40}
    draws = {(r.rep, r.pos): r.u for r in spark.range(1, 21).selectExpr("id as rep", "explode(sequence(1L, 40L)) as pos").select("rep", "pos", uniform(3, "rep", "pos").alias("u")).collect()}
    for r in P.bootstrap(df, ["g"], "k", "v", 20, 3).collect():
        means = [np.mean([place[r.g, int(draws[rep, i] * 40) + 1] for i in range(1, 41)]) for rep in range(1, 21)]
        assert (r.low, r.high) == (pytest.approx(np.percentile(means, 2.5), abs=2e-6), pytest.approx(np.percentile(means, 97.5), abs=2e-6)) and r.n == 40


def test_models(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    w = L.svm(x, y)
    slack = lambda v: 0.5 * v @ v + (np.maximum(0, 1 - (2 * y - 1) * (np.column_stack([x, np.ones(120)]) @ v)) ** 2).sum()
    assert all(slack(w) <= slack(w + 1e-3 * rng.normal(size=4)) for _ in range(50)) and (((np.column_stack([x, np.ones(120)]) @ w) > 0) == y).mean() > 0.97
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "k long, x array<double>, y int")
    model = L.freeze(df, "k", "x", "y")
    from sievewright.operators import models as M

    choice = df.select("y", M.apply_frozen(F.col("x"), M.checked(model)).alias("c")).collect()
    assert sum(str(r.y) == r.c for r in choice) > 114
    name, told = L.best_of_grid(df.where("k < 80"), df.where("k >= 80"), "x", "y", {"small": lambda: L.forest(5, 3)})
    assert name == "small" and told.where("prediction = cast(y as string)").count() > 30


def test_neighbours_and_rankings_by_hand(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, size=(90, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, fold long")
    got = R.nearest(df.selectExpr("id as query_id", "v as q", "fold"), df.selectExpr("id as point_id", "v as p", "fold"), 3, block=20, group="fold").collect()
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for q in range(90):
        want = sorted((d[q, p], p) for p in range(90) if p % 3 != q % 3)[:3]
        assert [(r.distance, r.point_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    words = [[f"w{k}" for k in rng.integers(0, 30, size=rng.integers(0, 12))] for _ in range(60)]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, tokens array<string>").repartition(3)
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(words[:7])] + [(99, ["none"])], "query_id long, tokens array<string>")
    whole = R.top_then_floor(R.bm25(docs, asked), 5, -1e9).collect()
    best = R.bm25_top(docs, asked, 5).collect()
    key = lambda rows: {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 7)) for r in rows}
    assert key(whole) == key(best) and len(best) > 20
    sets = [set(w) for w in words]
    want = {(q, i): len(sets[q] & s) / len(sets[q] | s) for q in range(7) for i, s in enumerate(sets) if sets[q] & s and len(sets[q] & s) / len(sets[q] | s) >= 0.3}
    for most in (R.SENT_ROWS, 0):
        before, R.SENT_ROWS = R.SENT_ROWS, most
        try:
            got = R.similar_sets(asked.withColumnRenamed("tokens", "members"), docs.withColumnRenamed("tokens", "members"), 0.3).collect()
        finally:
            R.SENT_ROWS = before
        assert {(r.query_id, r.doc_id): r.similarity for r in got} == pytest.approx(want)


def test_more_of_logs(spark):
    text = "ORBITAL ENERGIES\n-----\nNO OCC E(Eh) E(eV)\n 0 2.0 -1.0 -27\n 1 0.0 0.5 13\n\nNEXT"
    o = one(spark, X.orbitals(F.lit(text)))
    assert (o.homo_eh, o.lumo_eh, o.open_shell) == (-1.0, 0.5, False) and one(spark, X.orbitals(F.lit("nothing"))) is None
    assert one(spark, X.json_balanced(F.lit('<think>{</think> a {"k": "}\\\\"}", "n": {}} b }'))) == '{"k": "}\\\\"}'
    assert one(spark, X.json_balanced(F.lit("no { json"))) is None and one(spark, X.json_balanced(F.lit(None).cast("string"))) is None
    assert [one(spark, X.convergence(F.lit(t))) for t in ("x", "ORCA TERMINATED NORMALLY", "the optimization has converged ORCA TERMINATED NORMALLY")] == ["error", "not_converged", "ok"]
    assert one(spark, X.ion(F.lit("Fe+2"))) == ("Fe", 2, 1) and one(spark, X.ion(F.lit("Cl-"))) == ("Cl", -1, 1) and one(spark, X.ion(F.lit("H"))) == ("H", 0, 2)
