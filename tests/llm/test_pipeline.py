"""The pipeline's stages, each on all that the one before kept, against brute force."""

import importlib
import zlib

import numpy as np

import corpus_pipeline
from sievewright.llm import common, quality

from .test_dedup import groups
from .test_text_ops import leaks_by_hand


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = common.written(stage(spark, docs, sf), name)
        seen[name] = docs
        if name != "packed":
            assert docs.columns == columns
    text = lambda name: {r.doc_id: r.text for r in seen[name].collect()}
    before, after = text("line_filter"), text("near_duplicates")
    assert set(after) == {i for i, (_, c) in groups(before).items() if i == c} and all(before[i] == t for i, t in after.items())
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    leaked = {d for d, _ in leaks_by_hand(after, items)}
    assert leaked and set(text("benchmark_filter")) == set(after) - leaked
    packed = seen["packed"].groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in packed} == set(text("benchmark_filter"))


def test_line_filter_by_hand(spark, docs, rows):
    """Lines on more than 5 % and at least 5 of a source's rows, counted row by row."""
    menu = [(100 + i, f"Menu\nown {i}\n Menu\t\n\nbye") for i in range(30)] + [(200 + i, f"other {i}\nfour times" if i < 4 else f"other {i}") for i in range(20)]
    all_rows = [(i, t, "s") for i, t in rows] + [(i, t, "m" if i < 200 else None) for i, t in menu]
    df = spark.createDataFrame([(i, t, s, 0) for i, t, s in all_rows], "doc_id long, text string, source string, n_chars int")
    pages, total = {}, {}
    for _, t, s in all_rows:
        total[s] = total.get(s, 0) + 1
        for x in {x.strip(" \t\r") for x in (t or "").split("\n")} - {""}:
            pages[s, x] = pages.get((s, x), 0) + 1
    bad = {k for k, n in pages.items() if n >= 5 and n > 0.05 * total[k[0]]}
    want = [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in bad), s) for i, t, s in all_rows]
    got = corpus_pipeline.line_filter(spark, df, "").collect()
    assert len(bad) == 3 and sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.source)) for r in got)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_quality_filter_by_hand(spark, sf):
    """Every row whose score, looked up entry by entry, is below the threshold goes; no other."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    kept = {r.doc_id for r in corpus_pipeline.quality_filter(spark, docs, sf).collect()}
    for r in docs.collect():
        b = (r.text or "").encode()
        row = quality.features(np.frombuffer(b, np.uint8), np.array([len(b)]))[0]
        at = [sum(e <= v for e in edges) for edges, v in zip(model.edges, row)]
        z = model.base + sum(t[k] for t, k in zip(model.tables, at)) + sum(t[at[f], at[g]] for f, g, t in model.pairs)
        assert (r.doc_id in kept) == (1 / (1 + np.exp(-z)) >= 0.7)
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(i in kept) == (known[i] == 1) for i in held]) > 0.85


def test_packed_pieces_have_their_ids(spark, docs):
    pieces = corpus_pipeline.packed(spark, docs, "").collect()
    assert pieces and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)


def test_near_duplicates_with_odd_rows(spark, docs, texts):
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    want = {i for i, (_, c) in groups(texts).items() if i == c}
    assert sorted(map(repr, (r.doc_id for r in kept))) == sorted(map(repr, want))  # a row each, repeated ids or not
    assert {r.doc_id for r in kept} == want and None in want and 5 not in want


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} >= {"pipeline"} and sum(n.startswith("op") for n in names) == 10
    assert set(entry.oracle_sql()) <= names
