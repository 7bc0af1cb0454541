"""Lookups of records on small inputs with known results, nulls and repeats included."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import records as R
from weftline.operators import rules
from weftline.sources import files as FS


def test_captions_outcomes(spark):
    files = spark.createDataFrame([("A", 1, None), ("A", 2, None), ("B", 3, 9), ("C", 4, None), ("D", 5, None), (None, 6, None)], "media_id string, id long, superseded_by long")
    sides = spark.createDataFrame([(2, 5, 1, "late"), (2, 4, 9, "first"), (3, 1, 1, "gone"), (5, 1, 1, " \n"), (6, 1, 1, "no id")], "file_id long, fetched_at int, id long, body_text string")
    asked = spark.createDataFrame([(x,) for x in ("A", "A", "B", "C", "D", "E", None)], "media_id string")
    got = [tuple(r) for r in R.captions_outcome(asked, files, sides).collect()]
    assert sorted(got, key=str) == sorted([("A", 200, 2, "first")] * 2 + [("B", 404, None, None), ("C", 503, 4, None), ("D", 503, 5, None), ("E", 404, None, None), (None, 404, None, None)], key=str)


def test_phase_metrics(spark):
    phase = "phase string, ok boolean, model string, total_tokens long, cost double, wall_s double, words long"
    rows = [("r", [("formatter", True, "a/b/m", 1, 0.5, 2.0, 3), ("seo", False, "m", 1, 1.0, 4.0, 1), ("formatter", None, None, 7, None, 1.0, 2), (None, True, "x", 1, 1.0, 1.0, 1)], 0.9), ("empty", [], 0.1), ("none", None, None)]
    got = {(r.run, r.phase): tuple(r)[2:] for r in R.phase_metrics(spark.createDataFrame(rows, f"run string, phases array<struct<{phase.replace(' ', ':').replace(',:', ',')}>>, coverage double")).collect()}
    assert got == {("r", "formatter"): (False, None, 7, None, 1.0, 2, 0.9), ("r", "seo"): (True, None, None, None, 4.0, None, None)}


def test_maps_merge_as_the_dictionaries_do(spark):
    kind = "map<string,map<string,string>>"
    pairs = [({"a": {"x": "1", "y": "2"}, "b": {"z": "3"}}, {"a": {"y": "9", "w": None}, "c": {}}), (None, {"a": {"x": "1"}}), ({"a": {"x": "1"}}, None), (None, None)]
    got = [r[0] for r in spark.createDataFrame(pairs, f"a {kind}, b {kind}").select(R.deep_merged(F.col("a"), F.col("b"))).collect()]
    assert got == [rules.merged(a or {}, b or {}) for a, b in pairs]


def test_transcripts_are_sought_in_order_and_moved_once(spark):
    files = spark.createDataFrame([("/in/x/a.srt", b"one"), ("/in/a.srt", b"two"), ("/arc/a.srt", b"old"), ("/in/b.srt", "é".encode("latin-1")), ("abs/c.srt", b"c")], "path string, content binary")
    jobs = spark.createDataFrame([(1, "x/a.srt", "completed"), (2, "x/b.srt", "pending"), (3, "abs/c.srt", "completed"), (4, "none", "completed"), (5, None, "completed"), (6, "x/a.srt", "completed")], "id long, transcript_file string, status string")
    read = lambda f: {r.id: (r.path, r.text) for r in R.loaded_transcripts(jobs, f, "/in", "/arc").collect()}
    assert read(files) == {1: ("/in/x/a.srt", "one"), 2: ("/in/b.srt", "é"), 3: ("abs/c.srt", "c"), 4: (None, None), 5: (None, None), 6: ("/in/x/a.srt", "one")}
    once = R.moved(files, R.archive_moves(jobs, files, "/in", "/arc"))
    assert {r.path for r in once.collect()} == {"/arc/a.srt", "/in/a.srt", "/in/b.srt", "/arc/c.srt"} and once.where("path = '/arc/a.srt'").first().content == b"one"
    gone = jobs.where("id IN (3, 4)")
    assert R.archive_moves(gone, once, "/in", "/arc").count() == 0


def test_complete_jobs(spark):
    jobs = spark.createDataFrame([(1, "/p", ["a", "b"]), (2, "/q", ["a", "b"]), (3, "/p", ["a"]), (4, "/p", None)], "id long, project_path string, done array<string>")
    outputs = spark.createDataFrame([("/p/a_output.md",), ("/p/b_output.md",), ("/p/b_output.md",), ("/q/a_output.md",)], "path string")
    got = {r.id: (r.missing, r.complete) for r in R.complete(jobs, outputs, ["a", "b"]).collect()}
    assert got == {1: ([], True), 2: (["b"], False), 3: (["b"], False), 4: (["a", "b"], False)}


def test_rule_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/r.yaml").write_text("meta: {v: 1}\nlimits:\n  - {field: t, max: 3}\n  - {field: k, 'min-count': 2}\nname: x\nlist: [1, 2]\n")
    (tmp_path / "a/s.yaml").write_text("meta: {v: 1}\nlimits: []\n")
    families = rules.load(spark, str(tmp_path / "a"))
    assert list(families) == ["limits"] and sorted((r.field, r.max, r["min-count"]) for r in families["limits"].collect()) == [("k", None, "2"), ("t", "3", None)]
    (tmp_path / "a/t.yaml").write_text("- no\n")
    with pytest.raises(Exception, match="mapping with meta"):
        FS.rule_rows(spark, str(tmp_path / "a")).collect()
