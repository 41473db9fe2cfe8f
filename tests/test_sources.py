"""Readers and writers, and the stream run to its end."""

import pytest
from pyspark.sql import functions as F

from sievewright.sources import records as S
from sievewright.streaming import events

SMALL = "entry_id string, n int"


def test_strict_and_lenient(spark, tmp_path):
    good, bad = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"entry_id": "x", "n": 1, "more": 2}\n\n{"entry_id": "y"}\n')
    bad.write_text('{"entry_id": "z", "n": 3}\n{"entry_id": \n')
    assert sorted(tuple(r) for r in S.read_strict(spark, [str(good)], SMALL).collect()) == [("x", 1), ("y", None)]
    assert {r.entry_id for r in S.read_lenient(spark, [str(good), str(bad), str(tmp_path / "none")], SMALL).collect()} == {"x", "y", "z"}
    assert S.read_lenient(spark, [str(tmp_path / "none")], SMALL).count() == 0
    with pytest.raises(Exception, match="(?i)malformed|bad record|FAILFAST"):
        S.read_strict(spark, [str(bad)], SMALL).collect()


def test_pool_keeps_a_source_with_one_upload(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text("".join(f'{{"entry_id": "e{i}", "upload_id": "tmQM", "functional": "PBE"}}\n' for i in range(300)) + '{"entry_id": "l", "functional": "LDA"}\n{"entry_id": "g", "basis": " gen "}\n' + "".join(f'{{"entry_id": "n{i}"}}\n' for i in range(9)))
    rows = S.pool(spark, [str(path)], cap=4).collect()
    assert len([r for r in rows if r.entry_id[0] == "e"]) > 150 and len([r for r in rows if r.entry_id[0] == "n"]) == 4 and not {"l", "g"} & {r.entry_id for r in rows}


def test_text_tree_and_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.out").write_bytes(b"ok \xff")
    (tmp_path / "b.out").write_text("x" * 100)
    files = S.whole_texts(spark, str(tmp_path), most_bytes=50)
    assert [r.stem for r in files.collect()] == ["a"]
    rows = S.batch(spark.createDataFrame([("a",), ("gone",)], "stem string"), files)
    assert {r.stem: r.status for r in rows.collect()} == {"a": "found", "gone": "missing"}
    assert S.batch(rows.select("stem"), files, inner=True).count() == 1
    assert S.newest(spark, str(tmp_path / "*.out")).endswith("b.out") and S.newest(spark, str(tmp_path / "*.none")) is None


def test_frames(spark):
    last = lambda t: spark.range(1).select(S.last_frame(F.lit(t))).first()[0]
    assert last("1\na\nC 0 0 0\n2\nb\nH 0 0 0\nH 0 0 1\n") == "2\nb\nH 0 0 0\nH 0 0 1" and last("3\ncut\nC 0 0 0") is None


def test_report_refuses_large_results(spark):
    assert S.report(spark.createDataFrame([(1, "a|b")], "k long, v string"), "T") == "# T\n\n| k | v |\n| --- | --- |\n| 1 | a\\|b |\n"
    with pytest.raises(ValueError):
        S.report(spark.range(5), "T", 3)


def test_index_round_trip(spark, tmp_path):
    from sievewright.operators.retrieval import build_index

    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"])], "doc_id long, tokens array<string>")
    S.write_index(*build_index(docs, "tokens"), str(tmp_path / "index"))
    postings, terms = S.read_index(spark, str(tmp_path / "index"))
    assert sorted((r.term, r.doc_id, r.tf, r.dl) for r in postings.collect()) == [("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 2, 1, 1)] and terms.count() == 2


def test_stream_is_the_batch_but_for_open_windows(spark, sf, tmp_path):
    events.run_once(events.windowed(events.read(spark, sf), "6 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in events.windowed(whole, "6 hours").collect()}
    end = max(s for s, _ in want)
    assert got and got.items() <= want.items() and {k for k in want if k not in got} <= {k for k in want if (end - k[0]).total_seconds() <= 12 * 3600}
