"""Decontamination, preferences and the quality classifier."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sievewright.llm import decontaminate, preferences, quality


def leaks_by_hand(texts, items):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sh = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    out = {}
    for d, t in texts.items():
        w = cut(t)
        for k, item in items.items():
            v = cut(item)
            if not v or not w:
                continue
            want, best = sh(v), None
            for place in range(-len(v) + 1, len(w)):
                here = sh(w[max(place, 0) : place + len(v)])
                shared = sum((here & want).values())
                total = sum(here.values()) + sum(want.values()) - shared
                if shared * 100 >= 80 * total and (best is None or shared / total > best[0]):
                    best = (shared / total, max(place, 0))
            if best:
                out[d, k] = best
    return out


def test_leaks(spark, docs, texts, no_docs):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = {1: " ".join(word() for _ in range(40)), 2: " ".join(word() for _ in range(18)), 3: " ".join(word() for _ in range(9)), 4: "one two", 5: None, 6: "", 7: texts[5][:200], 8: " ".join(["same"] * 12), 9: " ".join(word() for _ in range(75))}
    w9 = items[9].split()
    planted = {100: "Intro words here. " + items[1].upper().replace(" ", ", ") + " and the end", 101: items[2], 102: "x " * 37 + items[3] + " y", 103: " ".join(items[1].split()[:30]), 104: " ".join(items[1].split()[1:]), 105: "same " * 30, 106: "pre " + " ".join([*w9[:20], "other", *w9[21:]]), 107: "one  TWO three", 108: "q " * 5 + items[1] + " r " + items[2]}
    both = {**texts, **planted}
    extra = spark.createDataFrame([(*r, 1, 2) for r in planted.items()], "doc_id long, text string, item_id long, size int")
    df = docs.select("doc_id", "text", "n").unionByName(extra, allowMissingColumns=True)
    bench = spark.createDataFrame([(k, t, "z") for k, t in items.items()] + [(2, items[2], "z")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.find_leaks(df, bench).collect()}
    want = leaks_by_hand(both, items)
    assert {k: (round(s, 9), p) for k, (s, p) in got.items()} == {k: (round(s, 9), p) for k, (s, p) in want.items()}
    assert (100, 1) in got and (106, 9) in got and (103, 1) not in got
    kept = {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()}
    assert kept == set(both) - {d for d, _ in want}
    assert decontaminate.find_leaks(no_docs, bench).count() == 0
    assert decontaminate.find_leaks(df, bench.where("item_id < 0")).count() == 0


def test_leaks_cut_by_the_documents_end(spark):
    """At all starts: items that lost a fifth to the end, that lost a word there, and with a jump back inside a document."""
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in range(5, 61)}
    ends = [(n, v[: 4 + -(-4 * (n - 4) // 5)], []) for n, v in items.items()]
    ends += [(45, items[45][:a] + items[45][a + 1 :], []) for a in range(10, 40, 3)] + [(40, items[40][:a] + items[40][a - 4 : 36], ["end"] * 20) for a in range(10, 31, 4)]
    texts = [(k, n, " ".join([*(f"q{i}" for i in range(start)), *words, *after])) for k, (n, words, start, after) in enumerate((n, w, s, after) for n, w, after in ends for s in range(16))]
    df = spark.createDataFrame([(k, t) for k, _, t in texts], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(v)) for n, v in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    for n, words, _ in ends:
        assert leaks_by_hand({0: " ".join(words)}, {n: " ".join(items[n])})
    assert got == {(k, n) for k, n, _ in texts}


def test_fingerprint_blocks_find_all_within_radius():
    rng = random.Random(1)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        assert any((a >> s) & 0xFFFF == (b >> s) & 0xFFFF for s in range(0, 64, 16))


def test_preferences(spark):
    say = lambda p, c, *turns: [(p, c, i, r, t) for i, (r, t) in enumerate(turns)]
    u, a = "user", "assistant"
    rows = say(1, True, (u, "hi"), (a, "yes"), (u, "more"), (a, "good")) + say(1, False, (u, "hi"), (a, "yes"), (u, "more"), (a, "bad é"), (u, "why"), (a, "so"))
    rows += say(2, True, (u, "x")) + say(2, False, (u, "x")) + say(3, True, (u, "only")) + say(4, False, (a, "other")) + say(5, True, (u, None), (a, "")) + say(5, False, (u, ""), (a, "n"))
    rows += say(None, True, (u, "p")) + say(None, False, (u, "q")) + [(1, True, 0, u, "hi"), (6, True, None, u, "t"), (6, False, None, u, "t"), (6, False, 1, a, "w")]
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], "pair_id long, chosen boolean, turn long, role string, text string, fork int, turns string")
    got = {r.pair_id: r for r in preferences.format_pairs(df).collect()}
    one = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    r = got[1]
    assert (r.status, r.n_prompt_turns, r.prompt) == ("pair", 3, one(u, "hi") + one(a, "yes") + one(u, "more"))
    assert (r.chosen, r.rejected) == (one(a, "good"), one(a, "bad é") + one(u, "why") + one(a, "so"))
    spans = [tuple(map(int, s.split("-"))) for s in r.rejected_mask.split(",")]
    assert [r.rejected[x:y] for x, y in spans] == ["bad é<|im_end|>", "so<|im_end|>"]
    assert (got[2].status, got[2].n_prompt_turns, got[2].chosen, got[2].chosen_mask) == ("equal", 1, "", "")
    assert (got[3].status, got[3].chosen, got[3].rejected) == ("chosen only", one(u, "only"), "")
    assert (got[4].status, got[4].rejected_mask != "") == ("rejected only", True)
    assert (got[5].n_prompt_turns, got[5].chosen, got[6].rejected) == (1, one(a, ""), one(a, "w"))
    assert None not in got  # rows without a pair id belong to no pair
    assert preferences.format_pairs(df.where("pair_id < 0")).count() == 0


def test_pairs_that_fork(spark, sf):
    u, a = "user", "assistant"
    rows = [(0, 0, u, "q"), (0, 1, a, "one"), (0, 2, u, "more"), (0, 3, a, "two"), (0, 4, u, "bye"), (1, 0, u, "other"), (1, 1, a, "reply"), (1, 3, a, "later")]
    rows += [(2, 0, u, "no answer"), (3, 0, u, "x"), (3, 1, a, "y"), (4, 0, a, "hi"), (5, 0, u, "silent"), (6, 0, a, "alone"), (None, 0, a, "lost"), (0, 1, a, "one")]
    df = spark.createDataFrame([(*r, True) for r in rows], "conv_id long, turn long, role string, text string, chosen boolean")
    got = {}
    for r in preferences.forked_pairs(df).collect():
        got.setdefault((r.pair_id, r.chosen), set()).add((r.turn, r.role, r.text))
    assert got[0, True] == {(r[1], r[2], r[3]) for r in rows if r[0] == 0}
    assert got[0, False] == {(0, u, "q"), (1, a, "one"), (2, u, "more"), (3, a, "reply")}
    assert got[1, False] == {(0, u, "x"), (1, a, "y")} and got[2, False] == {(0, u, "silent")} and (3, False) not in got and (None, True) not in got
    done = preferences.format_pairs(preferences.forked_pairs(spark.read.parquet(f"{sf}/conversations.parquet"))).collect()
    forks = [r for r in done if r.n_prompt_turns > 0]
    assert len(forks) > 0.6 * len(done) and all(r.prompt and r.chosen != r.rejected for r in forks)


def test_features_whole_and_in_parts(texts):
    data = [(t or "").encode() for t in texts.values()]
    whole = quality.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
    each = np.vstack([quality.features(np.frombuffer(d, np.uint8), np.array([len(d)])) for d in data])
    assert np.isfinite(whole).all() and np.allclose(whole, each)
    repeated = quality.features(np.frombuffer(b"no no no no\nyes", np.uint8), np.array([15]))[0]
    assert np.isclose(repeated[quality.FEATURES.index("repeated_next")], 3 / 5) and np.isclose(repeated[quality.FEATURES.index("top_word")], 4 / 5)


def test_features_by_hand(texts):
    """Every feature of every text counted one character, word and line at a time."""
    digits, upper = set(b"0123456789"), set(range(65, 91))
    for t in [*texts.values(), "Hello, WORLD! 12|<3>\n\nsame same\nsame same same.\n tail #1"]:
        b = (t or "").encode()
        got = dict(zip(quality.FEATURES, quality.features(np.frombuffer(b, np.uint8), np.array([len(b)]))[0]))
        size = max(len(b), 1)
        low = bytes(c + 32 if c in upper else c for c in b)
        words = re.findall(rb"[^ \t-\r]+", low)
        lines = [w for w in (re.findall(rb"[^ \t-\r]+", x) for x in low.split(b"\n")) if w]
        n = max(len(words), 1)
        want = {"log_bytes": np.log1p(len(b)), "upper": sum(c in upper for c in b) / size, "digit": sum(c in digits for c in b) / size, "mark": sum(c in b".,;:?'\"()-" for c in b) / size, "bar": sum(c in b"|<>{}[]\\/=_~^" for c in b) / size, "bang": b.count(b"!") / size, "symbol": sum(c in b"#$%&*@+" for c in b) / size, "beyond_ascii": sum(c > 127 for c in b) / size}
        want |= {"space": 1 - sum(map(len, words)) / size, "word_length": sum(map(len, words)) / n, "repeated_next": sum(x == y for x, y in zip(words, words[1:])) / n}
        if words:
            want |= {"distinct_words": len(set(words)) / n * np.sqrt(n), "top_word": Counter(words).most_common(1)[0][1] / n, "distinct_lines": len({tuple(sorted(x)) for x in lines}) / len(lines), "line_length": np.log1p(n / len(lines)), "ended_lines": np.mean([x[-1][-1:] in [bytes([c]) for c in b".!?:;\"')"] for x in lines])}
        for k, v in want.items():
            assert np.isclose(got[k], v), (k, t)


def test_score_and_first_step_by_hand():
    """A score is a sum of table entries; the first tree of one feature is the best by all cuts."""
    rng = np.random.default_rng(5)
    x = rng.random((300, 2))
    y = (x[:, 0] > 0.6).astype(float)
    model = quality.fit(x, y, rounds=3, pair_rounds=2, bins=6)
    for row, got in zip(x[:40], model.score(x[:40])):
        at = [sum(e <= v for e in edges) for edges, v in zip(model.edges, row)]
        z = model.base + sum(t[k] for t, k in zip(model.tables, at)) + sum(t[at[f], at[g]] for f, g, t in model.pairs)
        assert np.isclose(got, 1 / (1 + np.exp(-z)))
    one = quality.fit(x[:, :1], y, rounds=1, pair_rounds=0, bins=6, rate=1.0)
    prior = (y.sum() + 9) / 310
    k = np.array([sum(e <= v for e in one.edges[0]) for v in x[:, 0]])
    g, h = y - prior, np.full(300, prior * (1 - prior))
    score = lambda parts: sum(g[np.isin(k, p)].sum() ** 2 / (h[np.isin(k, p)].sum() + 1) for p in parts)
    bins = range(len(one.tables[0]))
    first = max(([[b for b in bins if b < c], [b for b in bins if b >= c]] for c in range(1, len(bins))), key=score)
    both = [[[q for q in p if q < c], [q for q in p if q >= c]] + [o for o in first if o is not p] for p in first for c in p[1:]]
    best = max(both, key=score)
    for p in best:
        assert np.allclose(one.tables[0][p], g[np.isin(k, p)].sum() / (h[np.isin(k, p)].sum() + 1))


def test_columns_with_clashing_names(spark):
    names = ["__bad", "__leak", "__gone", "__key", "__kept", "__host", "__text", "a.b"]
    df = spark.createDataFrame([(1, "some plain text here"), (None, None), (2, "")], "doc_id long, text string").select("doc_id", "text", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "some plain text here")], "item_id long, text string")
    assert quality.keep_good(df, labels).columns == df.columns and quality.keep_good(df, labels).count() == 3
    assert {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()} == {None, 2}


def test_model_learns_effects_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97 and any({f, g} == {0, 1} for f, g, _ in model.pairs)
    assert np.allclose(quality.fit(x[:0], y[:0]).score(x[:3]), 0.9) and (quality.fit(x, np.ones(4000)).score(x) > 0.9).all()


def test_quality_held_out(spark, docs, texts, no_docs):
    base = "/root/testdata/sf0.01/"
    real, labels = spark.read.parquet(base + "documents.parquet"), spark.read.parquet(base + "labels.parquet")
    model = quality.train(real, labels)
    got = quality.score(real, model).join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    odd = quality.score(docs, model).collect()
    assert {r.doc_id for r in odd} == set(texts) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(no_docs, model).count() == 0
    kept = quality.keep_good(real, labels)
    assert kept.columns == real.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in quality.score(real, model).collect() if r.predicted}
    nothing = quality.train(real, labels.selectExpr("doc_id", "cast(null as int) as quality"))
    assert quality.score(docs, nothing).where("predicted = 0").count() == 0
