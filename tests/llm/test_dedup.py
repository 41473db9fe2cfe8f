"""Line dedup, n-gram join, suffix dedup and vector dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from sievewright.llm import common, embed_dedup, line_dedup, ngram_join, suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(texts):
    """component by id, all pairs compared."""
    key = lambda i: (i is not None, i or 0)
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts, key=key)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)), key=key)
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(docs, no_docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs).collect()}
    assert got == groups(texts)
    assert ngram_join.jaccard_groups(no_docs).count() == 0


def test_ngram_join_at_the_threshold(spark):
    """Sets that differ by about as much as links allow, and crowds that share a passage or are near copies."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out, i = {}, 0
    passage = " ".join(word() for _ in range(30))
    for size in (5, 7, 9, 14, 23, 60, 150):
        base = [word() for _ in range(size + 4)]
        for cut in range(0, size // 3 + 2):
            out[i] = " ".join(base[: len(base) - cut] + [word() for _ in range(cut if i % 2 else 0)])
            i += 1
    base = [word() for _ in range(90)]
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        out[i] = " ".join(w)
        i += 1
    for _ in range(120):
        out[i] = " ".join(word() for _ in range(60)) + " " + passage
        i += 1
    df = spark.createDataFrame(list(out.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(df).collect()}
    assert got == groups(out)


def test_block_keys_meet_for_every_link():
    """Any two sets at the least similarity share a key, whatever is left out as frequent."""
    rng = np.random.default_rng(1)
    bands = ngram_join.Bands(4, 5)
    for n in [1, 2, 4, 5, 6, 8, 9, 13, 30, 77, 200, 900]:
        for m in {n, n + n // 9, n + n // 5, int(n * 1.25)}:
            shared = -(-4 * (n + m) // 9)
            if shared > n or m * 4 > n * 5:
                continue
            pool = rng.integers(0, 2**64, n + m - shared, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:shared], pool[n:])))
            for frequent in (np.empty(0, np.uint64), np.sort(pool[: shared // 2]), np.sort(pool)):
                keys, who = ngram_join.block_keys(np.concatenate((a, b)), np.array([len(a), len(b)]), bands, frequent)
                assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist()), (n, m)
            ha, hb = ngram_join.bit_sketches(np.concatenate((a, b)), np.array([len(a), len(b)]))
            assert ngram_join.hamming(ha, hb) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_buckets_have_partitions_of_their_own(spark, monkeypatch):
    from pyspark.sql import functions as F

    for n, most in ((1, 100), (37, 100), (50, 10)):
        monkeypatch.setattr(common, "MOST_PARTITIONS", most)
        ids = common.homes(n).tolist()
        assert len(set(ids)) == n
        df = common.by_bucket(spark.createDataFrame([(i,) for i in ids], "bucket long"), n).groupBy(F.spark_partition_id()).count()
        assert {r[1] for r in df.collect()} == {-(-n // min(n, most))}


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500 + i) for i in range(60)]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), spark).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def cut_by_hand(texts, depth):
    seen, out = set(), {}
    for i in sorted(texts, key=lambda i: (i is not None, i or 0)):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            if w in seen:
                gone[p : p + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("depth", [100, 48])
def test_suffix_dedup(docs, no_docs, texts, depth):
    got = suffix_dedup.cut_repeats(docs, depth=depth).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == cut_by_hand(texts, depth)
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(s.after - s.first for s in r.spans) == r.n_removed
    if depth == 100:
        assert suffix_dedup.cut_repeats(no_docs).count() == 0


def test_suffix_dedup_with_a_crowd(spark, monkeypatch):
    """A passage in many documents, with other text, the same text, or a few bytes in common around it."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, edge = text(150), text(60)
    texts = {i: text(rng.randint(0, 150)) + (edge[-rng.randint(1, 60) :] if i % 3 else "") + passage + (edge[: rng.randint(1, 60)] if i % 2 else "") + text(rng.randint(0, 120)) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for crowd in (2, 1000):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_repeats(df).collect()}
        assert got == cut_by_hand(texts, 100)
    for depth in (40, 100, 256):
        for crowded in (False, True):
            parts = suffix_dedup.ranges(depth, crowded)
            assert [x for a, b in parts for x in range(a, b + 1)] == list(range(depth - suffix_dedup.GRAM + 1))


def test_radix_passes():
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(4000)) * 2
    at = np.arange(0, len(data) - 40, 3)
    which, group = suffix_dedup.radix_passes(data, at, np.zeros(len(at), np.int64), 40)
    want = {}
    for k, p in enumerate(at.tolist()):
        want.setdefault(data[p : p + 40], []).append(k)
    got = {}
    for k, g in zip(which.tolist(), group.tolist()):
        got.setdefault(g, []).append(k)
    assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


def test_line_dedup(spark):
    rows = [(i, "h", f"Menu\nline {i}\n  Menu \n\nshared{i % 2}") for i in range(10)] + [(20, "h", None), (21, "h", ""), (22, None, "Menu\nx"), (23, "small", "Menu\nown")] + [(0, "h", "Menu\nline 0")]
    df = spark.createDataFrame([(*r, "b") for r in rows], "page_id long, host string, body string, __key2 string")
    got = line_dedup.drop_boilerplate(df, "host", "body", ratio=0.5, min_pages=5, count_cols=("before", "dropped"))
    assert got.columns == [*df.columns, "before", "dropped"]
    by = {(r.page_id, r.host, r.body, r.before, r.dropped) for r in got.collect()}
    assert (1, "h", "line 1\n\nshared1", 5, 2) in by and (0, "h", "line 0", 2, 1) in by  # 11 of 13 pages have Menu, shared0 is on 5
    assert {(20, "h", None, 0, 0), (21, "h", "", 1, 0), (22, None, "Menu\nx", 2, 0), (23, "small", "Menu\nown", 2, 0)} <= by
    assert line_dedup.drop_boilerplate(df.where("page_id < 0"), "host", "body").count() == 0
    clash = df.selectExpr("*", "1 as __key", "2 as __bad", "3 as __gone", "4 as __kept", "5 as __page", "6 as dropped", "7 as `a.b`")
    for most in (1000, 0):  # with lists by host, and with lines joined by host and line
        again = line_dedup.drop_boilerplate(clash, "host", "body", ratio=0.5, min_pages=5, count_cols=("before", "dropped"), broadcast_lines=most)
        assert sorted(again.columns) == sorted([*(c for c in clash.columns if c != "dropped"), "before", "dropped"])
        assert {(r.page_id, r.host, r.body, r.before, r.dropped) for r in again.collect()} == by and {r["a.b"] for r in again.collect()} == {7}


def test_html_text(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("<p>A &amp; B<b>c</b></p><script>x='</p>'</script><div>d<br/>e</div><!-- z -->", "HTTPS://u@Www.X.com:80/a"), (None, "no host")], "html string, url string")
    got = df.select(line_dedup.html_text(F.col("html")).alias("t"), line_dedup.host_of(F.col("url")).alias("h")).collect()
    assert [x for x in got[0].t.split("\n") if x] == ["A & Bc", "d", "e"] and got[0].h == "www.x.com"
    assert tuple(got[1]) == (None, None)


def test_vector_dedup_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16))
    x[100:160] = x[100] + rng.normal(size=(60, 16)) * 0.12 * np.linalg.norm(x[100]) / 4
    x[200:260] = x[200]
    x[300:330] = 3 * x[300] + rng.normal(size=(30, 16)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8), (1004, [float("inf")] + [1.0] * 15), (1005, [1.0, 2.0]), (1006, []), (5, x[5].tolist()), (None, x[7].tolist())]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rep long, cell int")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, block=50).collect()}
    assert len(got) == 708 and all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(1000, 1007))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    links[7] += 1
    found = np.array([got[i].n_links for i in range(700)])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    assert got[7].component_id is None and got[None].kept and not got[7].kept
    assert embed_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0
