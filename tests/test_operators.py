"""Operators on small cases that the tables don't have: nulls, ties, empty inputs, refusals."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievewright.determinism import mode, sha1_bucket, uniform
from sievewright.functions import classify as C
from sievewright.functions import extract as X
from sievewright.functions import geometry as G
from sievewright.functions import names as N
from sievewright.operators import joins as J
from sievewright.operators import models as M
from sievewright.operators import resample as P
from sievewright.operators import retrieval as R
from sievewright.operators import sampling as S
from sievewright.plans import checks, references
from sievewright.plans.expressions import to_column


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column).first()[0]


def test_draws_are_repeatable(spark):
    import hashlib

    ids = list(range(200))
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").repartition(5).orderBy("i").select(uniform(7, "i")).collect()]
    assert got == [int(hashlib.md5(f"7|{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in ids]
    assert [one(spark, sha1_bucket(F.lit(t), 50)) for t in ("abc", "", "e1")] == [int(hashlib.sha1(t.encode()).hexdigest(), 16) % 50 for t in ("abc", "", "e1")]


def test_mode_takes_the_least_of_ties(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("b", None)], "g string, v string")
    assert [tuple(r) for r in mode(df, ["g"], ["v"]).collect()] == [("a", "x", 1)]


def test_null_group_is_capped_as_one(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "i long, g string")
    assert {r.g: r["count"] for r in S.cap(df, ["g"], "i", 3).groupBy("g").count().collect()} == {None: 3, "a": 3}
    assert S.reservoir(df, "i", 0).count() == 0 and S.reservoir(df, "i", 99).count() == 20


def test_split_never_takes_a_whole_stratum(spark):
    df = spark.createDataFrame([(f"g{i % 7}", "only" if i % 7 == 0 else "s", i) for i in range(70)], "g string, s string, i long")
    for split in (S.split_by_group(df, "g", ["s"], 0.9), S.split_by_fill(df, "g", ["s"], 0.9)):
        rows = split.collect()
        assert {r.split for r in rows if r.s == "only"} == {"train"} and {r.split for r in rows if r.s == "s"} == {"train", "val"}


def test_strict_join_refuses_and_overlay_wins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(1, "z")], "k long, v string")
    with pytest.raises(ValueError, match="no match"):
        J.strict(a, b, ["k"])
    assert sorted(tuple(r) for r in J.overlay(a, b, ["k"], ["v"]).collect()) == [(1, "z"), (2, "y")]


def test_close_pairs_are_all_close_pairs(spark):
    import random

    rng = random.Random(0)
    rows = [(i, i % 3, rng.randint(-500, 500)) for i in range(200)]
    want = sorted((a, b) for a, g, t in rows for b, h, u in rows if a < b and g == h and abs(t - u) <= 17)
    got = J.close_pairs(spark.createDataFrame(rows, "k long, g long, t long"), ["g"], "t", 17, "k").collect()
    assert sorted(map(tuple, got)) == want


def test_query_without_hits_has_no_rows(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["z"]), (2, [])], "query_id long, tokens array<string>")
    assert R.bm25(docs, asked).count() == 0


def test_missing_structure_outranks_a_poor_one(spark):
    pool = spark.createDataFrame([(1, 10, 1, 0.1), (1, 11, 2, None), (1, 12, 3, 0.9), (1, 13, 4, 0.9)], "query_id long, doc_id long, rank int, similarity double")
    assert [r.doc_id for r in R.tiers(pool).orderBy("place").collect()] == [12, 13, 11, 10]


def test_spellings_and_formulas(spark):
    e = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, C.hill_formula(e("O", "H", "C", "H"))) == "CH2O" and one(spark, C.hill_formula(F.lit(None).cast("array<string>"))) == ""
    assert one(spark, C.system_type(e("Fe", "Br"), F.lit(1))) == "heavy_elem" and one(spark, C.system_type(e("Zn"), F.lit(1))) == "TM_closed" and one(spark, C.system_type(e("Zn"), F.lit(2))) == "TM_open"
    assert one(spark, C.error_code(F.lit("INPUT ERROR ... SCF NOT CONVERGED"))) == "INPUT_ERROR" and one(spark, C.error_code(F.lit(""))) is None
    assert one(spark, C.scale_bucket(C.atoms(F.lit(0), F.lit(31)))) == "L" and one(spark, C.scale_bucket(F.lit(None).cast("int"))) == "unknown"


def test_expressions(spark):
    cases = {"-7 % 3": 2.0, "7 % -3": -2.0, "2 ** -1": 0.5, "abs(-2) + sqrt(9) / 3": 3.0, "+1 - -1": 2.0}
    for text, value in cases.items():
        assert one(spark, to_column(text)) == pytest.approx(value)
    for bad in ("__import__('os')", "x.y", "[1]", "max(1, 2)", "1 if 2 else 3", "'a'", "True", "1 +", "__a"):
        with pytest.raises(ValueError):
            to_column(bad)
    with pytest.raises(ValueError, match="unknown"):
        to_column("y", {"x": F.lit(1)})


def test_references_keep_types():
    known = {"T": 298, "ok": True}
    assert references.expand({"a": "$(settings.T)", "b": ["x $(settings.T)", "$(settings.no)"]}, "settings", known) == {"a": 298, "b": ["x 298", "$(settings.no)"]}


def test_template():
    plan = {"template": {"per_compound": [{"id": "a_{C}", "in": "{C.role}"}, {"id": "once"}], "post_template": [{"id": "t_{C}", "applies_to": "targets_only"}, {"id": "end", "applies_to": "once"}]}, "compounds": [{"name": "x", "role": "target"}, {"name": "y", "role": "reference"}], "geom_ids": ["{C}_g", "k"]}
    out = references.expand_template(plan)
    assert [n["id"] for n in out["nodes"]] == ["a_x", "a_y", "once", "t_x", "end"] and out["geom_ids"] == ["x_g", "y_g", "k"]
    with pytest.raises(ValueError, match="unresolved"):
        references.expand_template({**plan, "template": {"per_compound": [{"id": "{C}", "v": "{C.nope}"}]}})
    with pytest.raises(ValueError, match="repeated"):
        references.expand_template({**plan, "template": {"per_compound": [{"id": "n{C.kind}"}]}, "compounds": [{"name": "x", "kind": 1}, {"name": "y", "kind": 1}]})


def test_checks_see_missing_inputs(spark):
    nodes = spark.createDataFrame([("p", 1, "a", "tool", "t", "", "g"), ("p", 2, "b", "tool", "t", "lost", "h"), ("q", 1, "", "llm", "", "", "")], "plan string, pos int, id string, kind string, tool string, input_id string, output_id string")
    rows = {r.plan: r for r in checks.structure(nodes, spark.createDataFrame([("t",)], "tool string")).collect()}
    assert not rows["p"].dep_graph_valid and rows["p"].tools_valid and not rows["q"].nodes_have_id


def test_log_blocks(spark):
    text = "FINAL SINGLE POINT ENERGY   -1.5\nx\nFinal Single Point Energy   none\n"
    assert one(spark, X.total_energy(F.lit(text))) is None and one(spark, X.first_energy(F.lit(text))) == -1.5
    assert one(spark, X.charges(F.lit("no block"))) is None and one(spark, X.gap(F.lit(""))) is None
    assert one(spark, X.status(F.lit("  0 Error (MDCI): bad basis"))) == ("error", None, "0 Error (MDCI): bad basis")
    xyz = "CARTESIAN COORDINATES (ANGSTROEM)\n-----\n 1 O 0.0 0.0 0.1\n H 1 2 3\n\nrest"
    assert one(spark, X.geometry(F.lit(xyz))) == "O 0.0 0.0 0.1\nH 1 2 3"
    assert one(spark, X.json_block(F.lit("a {\"k\": [1]} b"))) == '{"k": [1]}' and one(spark, X.json_block(F.lit("a {k b"))) is None
    assert one(spark, X.sanitized(F.lit(" a  b//c_ "))) == "a_b_c" and one(spark, X.sanitized(F.lit("//"))) == "job"
    steps = one(spark, X.scan_steps(F.lit("RELAXED SURFACE SCAN STEP 1\nFINAL SINGLE POINT ENERGY -1.0\nFINAL SINGLE POINT ENERGY -2.0\nRELAXED SURFACE SCAN STEP 2\nFINAL SINGLE POINT ENERGY -3.0")))
    assert [(s.step, s.energy) for s in steps] == [(1, -2.0), (2, -3.0)]
    assert one(spark, X.error_summary(F.lit("ok\nan ERROR\nfine\nabort now"), ["error", "abort"])) == "an ERROR\nabort now" and one(spark, X.tail(F.lit("a\nb\nc"), 2)) == "b\nc"


def test_frozen_model_is_checked(spark):
    model = {"classes": ["a", "b"], "mean": [0.0], "scale": [1.0], "coef": [[1.0], [1.0]], "intercept": [0.0, 0.0]}
    model["sha256"] = M.model_digest(model)
    assert one(spark, M.apply_frozen(F.array(F.lit(2.0)), M.checked(model))) == "a"
    with pytest.raises(ValueError):
        M.checked({**model, "intercept": [0.0, 1.0]})


def test_resampling_of_constants(spark):
    df = spark.createDataFrame([("g", i, 2.0) for i in range(10)], "g string, k long, v double")
    r = P.bootstrap(df, ["g"], "k", "v", 50, 1).first()
    assert (r.n, r["mean"], r.low, r.high) == (10, 2.0, 2.0, 2.0)
    assert P.sign_flip(df, ["g"], "k", "v", 200, 1).first().p < 0.05


def test_water(spark):
    atoms = spark.createDataFrame([(1, 0, "O", 0.0, 0.0, 0.0), (1, 1, "H", 0.96, 0.0, 0.0), (1, 2, "H", -0.24, 0.93, 0.0), (1, 3, "C", 9.0, 0.0, 0.0)], "geom_id long, idx long, symbol string, x double, y double, z double")
    b = G.bonds(atoms)
    assert sorted((r.aidx, r.bidx) for r in b.collect()) == [(0, 1), (0, 2)]
    assert G.angles(atoms, b).first().angle == pytest.approx(104.5, abs=0.5)
    assert G.fragments(atoms, b).first().n_parts == 2
    chain = spark.createDataFrame([(1, i, "C", 1.5 * i, 0.0, 0.0) for i in range(200)] + [(2, 0, "Fe", 0.0, 0.0, 0.0), (2, 1, "N", 2.55, 0.0, 0.0), (3, 0, "Xx", 0.0, 0.0, 0.0), (3, 1, "C", 1.5, 0.0, 0.0)], atoms.schema)
    assert {r.geom_id: r.n_parts for r in G.fragments(chain, G.bonds(chain)).collect()} == {1: 1, 2: 1, 3: 1}
    assert [r.verdict for r in G.bond_check(G.bonds(chain.where("geom_id = 2"))).collect()] == ["long"]
    p = [[F.lit(float(v)) for v in xyz] for xyz in ((1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1))]
    assert one(spark, G.dihedral(p)) == pytest.approx(-90)


def test_nearest_heavy_distance_is_not_rounded(spark):
    """Ties are by 9 digits, but 0.8537694997 must not go to 0.8537695 and then, by six digits, to 0.85377."""
    atoms = [(1, 0, "C", 0.0, 0.0, 0.0), (1, 1, "N", 0.8537694997, 0.0, 0.0), (2, 0, "H", 0.0, 0.0, 0.0), (2, 1, "O", 1.0 + 1e-11, 0.0, 0.0), (2, 2, "O", -1.0, 0.0, 0.0), (2, 3, "H", 0.0, 0.5, 0.0)]
    df = spark.createDataFrame(atoms, "geom_id long, idx long, symbol string, x double, y double, z double")
    got = {(r.geom_id, r.idx): (r.other, r.d, r.six) for r in G.nearest_heavy(df, 1.0001).withColumn("six", F.round("d", 6)).collect()}
    assert got == {(1, 0): (1, 0.8537694997, 0.853769), (1, 1): (0, 0.8537694997, 0.853769), (2, 0): (1, 1.0 + 1e-11, 1.0)}


def greedy_folds(sizes, folds):
    load, out = [0] * folds, []
    for size in sorted(sizes, reverse=True):
        out.append((size, load.index(min(load))))
        load[out[-1][1]] += size
    return out


@pytest.mark.parametrize("folds", [1, 2, 5, 7])
def test_turns_are_the_greedy_order(folds):
    draw = random.Random(folds)
    cases = [[], [1], [3] * 20, [1000] + [1] * 2500, [10, 5, 5, 5, 2, 2] + [1] * 9, [4, 4, 2, 2, 2, 2, 2]]
    cases += [[draw.choice([1, 2, 3, 5, 8, draw.randint(1, 60)]) for _ in range(draw.randint(1, 200))] for _ in range(200)]
    for sizes in cases:
        plan = S.turns(sorted(Counter(sizes).items(), reverse=True), folds)
        got = []
        for size, steps in plan:
            assert len(steps) <= folds
            for r in range(sizes.count(size)):
                first, turn = [x for x in steps if x[0] <= r][-1]
                got.append((size, turn[(r - first) % len(turn)]))
        assert got == greedy_folds(sizes, folds)


@pytest.mark.parametrize("sizes", [[], [40] + [1] * 130 + [7, 7, 3], [2, 2]])
def test_group_kfold_by_hand(spark, sizes):
    rows = [(None if g == 1 else g,) for g, n in enumerate(sizes) for _ in range(n)]
    got = S.group_kfold(spark.createDataFrame(rows, "g long"), "g", 3)
    assert got.dtypes == [("g", "bigint"), ("size", "bigint"), ("fold", "int")]
    got = got.collect()
    assert {r.g: r["size"] for r in got} == {None if g == 1 else g: n for g, n in enumerate(sizes)}
    assert Counter((r["size"], r.fold) for r in got) == Counter(greedy_folds(sizes, 3))


def test_resolved_names(spark):
    want = {
        "Fe3+": ("ion", "Fe", 3, 2), " Cl- ": ("ion", "Cl", -1, 1), "Ferric Ion": ("name", "Fe", 3, 2), "iron atom": ("name", "Fe", 0, 1), "Pd atom": ("atom", "Pd", 0, 1),
        "CC(=O)[O-]": ("structure", None, -1, 1), "[Fe+2]=[O-]": ("structure", None, 1, 1), "C=O-": ("structure", None, -1, 1), "NO2+": ("lookup", None, 1, 1), "H2+": ("lookup", None, 1, 1),
        "Xx": ("lookup", None, 0, 1), "x-99999999999": ("lookup", None, None, 1), "": ("empty", None, 0, 1), None: ("empty", None, 0, 1), " atom": ("lookup", None, 0, 1),
    }
    got = spark.createDataFrame([(k,) for k in want], "n string").select("n", N.resolved(F.col("n")).alias("r")).collect()
    assert {r.n: tuple(r.r) for r in got} == want
    assert len(N.ELEMENTS) == 86 and N.ELEMENTS[25] == "Fe" and N.ELEMENTS[78] == "Au"
