"""Single operators on small inputs with known results."""

import time

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import time as TM
from weftline.operators import captions as C
from weftline.operators import events as E
from weftline.operators import jobs as J
from weftline.operators import media as M
from weftline.operators import rules as R
from weftline.operators import search as S
from weftline.sources import files as FS


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_copy_suffixes(spark):
    names = ["a (1)", "b - Copy", "c - Copy (2)", "d copy 3", "e_SM", None]
    assert values(spark, T.without_copy_suffix(F.col("x")), names) == ["a", "b", "c", "d", "e_SM", None]


def test_media_ids(spark):
    names = ["9abc1209HD_ForClaude.txt", "7ABC0000HDWEB02_REV20251202.srt", "ab_x01_promo.srt", "no id in here.srt", "x_REV20251106.srt", "8XYZ2503 (1).srt"]
    assert values(spark, T.media_id(F.col("x")), names) == ["9ABC1209HD", "7ABC0000HDWEB02_REV20251202", "ab_x01_promo", None, "x_REV20251106", "8XYZ2503"]
    assert values(spark, T.media_id_of_url(F.col("x")), ["http://h/d/2LAK1209HD%20(1).srt.srt"]) == ["2LAK1209HD"]


def test_file_names(spark):
    rows = spark.createDataFrame([("6TWN0101_REV20260319.srt",), ("2lak0501hd_pledge.mp4",), ("6TWN0101_REV20261340.srt",), ("6TWNS_x.mp4",), ("9LEC0102_NoBug.mp4",)], "x string").select(T.parse_filename(F.col("x")).alias("p")).select("p.*").collect()
    assert [r.outcome for r in rows] == ["parsed", "parsed", "bad_date", "unmatched", "parsed"]
    assert (rows[0].media_id, str(rows[0].revision_date), rows[0].hd) == ("6TWN0101", "2026-03-19", False)
    assert (rows[1].season, rows[1].episode, rows[1].variant_tag, rows[1].hd) == (5, 1, "PLEDGE", True)
    assert rows[4].unknown_tag == "NOBUG"


def test_sizes_and_slugs(spark):
    assert values(spark, T.size_bytes(F.col("x")), ["96K", "1.8G", "0", "-", "-5", "", "x"]) == [98304, 1932735283, 0, None, None, None, None]
    assert values(spark, T.size_bytes(F.col("x"), negatives=True), ["-5"]) == [-5]
    assert values(spark, T.slug(F.col("x")), ["Hello, World!"]) == ["hello_world"]
    assert values(spark, T.path_component(F.col("x")), ["a/b: c__", "", "__"]) == ["a_b_ c", "unnamed", "unnamed"]


def test_timecodes(spark):
    assert values(spark, TM.srt_ms(F.col("x")), ["00:00:01,500", "1:02:03.004", "bad"]) == [1500, 3723004, None]
    assert values(spark, TM.srt_time(F.col("x")), [3723004, -5], "x long") == ["01:02:03,004", "00:00:00,000"]
    assert values(spark, TM.display_time(F.col("x")), [3723004, 61000], "x long") == ["1:02:03", "1:01"]
    assert values(spark, TM.long_time(F.col("x")), [3723004], "x long") == ["1:02:03.004"]
    assert values(spark, TM.strict_ms(F.col("x")), ["1:02:03.5", "90:00", "1:90:00", "0:61"]) == [3723500, 5400000, None, None]


def test_text_helpers(spark):
    assert values(spark, T.content_words(F.col("x")), ["<!-- m -->\n**P:** x\n---\n# Head\n**A:** one two\n**Status:** ready\n", "one two"]) == [4, 2]
    assert values(spark, T.source_words(F.col("x")), ["1\n00:00:01,000 --> 00:00:02,000\none two\n"]) == [2]
    assert values(spark, T.srt_plain(F.col("x")), ["1\n00:00:01,000 --> 00:00:02,000\n one \ntwo\n"]) == ["one two"]
    assert values(spark, T.without_reasoning(F.col("x")), ["<think>a</think>\n```json\n{}\n```", "rest</think> out"]) == ["{}", "out"]
    assert values(spark, T.clean_chunk(F.col("x")), ["Sure, here it is.\n```markdown\n**A:** hi\n```\n"]) == ["**A:** hi"]
    assert values(spark, F.array_join(T.trigrams(F.col("x")), "|"), ["The cat sat is on mats", "no"]) == ["the cat sat|cat sat mats", ""]
    assert values(spark, T.truncated(F.col("x"), 10), ["short", "some longer text"]) == ["short", "some…"]


def test_chunks_of_many_lines(spark):
    began = time.monotonic()
    assert values(spark, T.clean_chunk(F.col("x")), ["Sure.\n```\n" + "a line\n" * 8000 + "```"]) == ["a line\n" * 7999 + "a line"]
    assert time.monotonic() - began < 30


def test_srt_round_trip(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\nhello\nthere\n\nbad\n\n7\n00:00:03,000 --> 00:00:04,500\nbye\n"
    row = spark.createDataFrame([(srt,)], "x string").select(C.parse_srt(F.col("x")).alias("c")).select("c", C.emit_srt(F.col("c")), C.emit_vtt(F.col("c"))).first()
    assert [(c["index"], c.start_ms, c.end_ms, c.text) for c in row[0]] == [(1, 1000, 2000, "hello\nthere"), (7, 3000, 4500, "bye")]
    assert row[1].startswith("1\n00:00:01,000 --> 00:00:02,000\nhello\nthere\n\n2\n") and row[2].startswith("WEBVTT\n\n00:00:01.000")


def test_caption_folds():
    import pandas as pd

    caps = [{"index": 1, "start_ms": 0, "end_ms": 2000, "text": "a"}, {"index": 2, "start_ms": 1900, "end_ms": 4000, "text": "a "}, {"index": 3, "start_ms": 4010, "end_ms": 4010, "text": "b"}, {"index": 4, "start_ms": 9000, "end_ms": 9500, "text": " "}]
    assert C.cleaned(pd.Series([caps]))[0] == [{"index": 1, "start_ms": 0, "end_ms": 5010, "text": "a\nb"}]
    cut = C.split_speakers(pd.Series([[{"index": 1, "start_ms": 0, "end_ms": 1000, "text": "ab >> cd"}]]))[0]
    assert [(c["index"], c["start_ms"], c["text"]) for c in cut] == [(1, 0, "ab"), (2, 286, ">> cd")] and cut[1]["end_ms"] == 1000
    texts = ["one two three"] * 5 + [">> new turn here"] + ["one two three."] * 6
    assert C.chunk_starts(texts, 9) == [0, 5, 8, 11]


def test_islands_and_seams(spark):
    rows = [(1, i, m) for i, m in enumerate([False, True, None, True, True, False, True])]
    out = C.missing_runs(spark.createDataFrame(rows, "doc_id long, ord int, missing boolean"), 3).collect()
    assert [(r.first, r.last, r.missing) for r in out] == [(1, 4, 3)]
    df = spark.createDataFrame([(["x", "a", "b"], ["a", "b", "c"]), (["x"], ["y"]), ([], ["y"])], "p array<string>, n array<string>")
    assert [r[0] for r in df.select(C.seam_echo(F.col("p"), F.col("n"))).collect()] == [2, 0, 0]


def test_guarded_substitutions(spark):
    apply = R.guarded_substitutions([(r"\bfoo\b", "bar"), (r"\bweb\b", "Web")])
    texts = ["foo and `x`", "see https://h/foo now foo", "web site. web page on the web", "```foo```", None]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select(apply("x").alias("r")).select("r.*").collect()
    assert [(r.text, r["count"]) for r in got] == [("bar and `x`", 1), ("see https://h/foo now bar", 1), ("web site. web page on the Web", 1), ("```foo```", 0), ("", 0)]


def test_style_checks(spark):
    assert values(spark, R.down_style(F.col("x"), ["Lake Radio", "Radio"]), ["THE lake RADIO Show", "123 go"]) == ["The Lake Radio show", "123 Go"]
    assert values(spark, R.truncation_suspect(F.col("x")), ["Done.\n\n", "cut off", ""]) == [False, True, False]
    pairs = spark.createDataFrame([(["Ann", "Ann Lee", "Bob"],)], "x array<string>").select(F.explode(R.subset_labels(F.col("x"))).alias("p")).collect()
    assert [(r.p.short, r.p.long) for r in pairs] == [("Ann", "Ann Lee")]
    assert R.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_rule_file(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("meta: {version: 1}\nlimits:\n  - {field: title, max: 5}\n")
    limits = R.load(spark, str(tmp_path / "r.yaml"))["limits"]
    fields = spark.createDataFrame([(1, "title", "too long"), (2, "title", "ok")], "doc_id long, field string, value string")
    assert [r.doc_id for r in R.limit_findings(fields, limits).collect()] == [1]


def test_greedy_match():
    import pandas as pd

    rows = [(1, "p", "flag", 1, ["a", "b"]), (1, "p", "flag", 2, ["a"]), (1, "p", "lint", 1, ["b"]), (1, "p", "lint", 2, ["b"])]
    out = R.greedy_matches(pd.DataFrame(rows, columns=["job", "phase", "kind", "ord", "rules"])).iloc[0]
    assert (out.both, out.lint_only, out.flag_only) == (1, 1, 1)


def test_floor_percentiles(spark):
    out = E.percentiles(spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 4)], "k string, v double"), ["k"], "v").first()
    assert (out.p50, out.p95, out.n) == (3.0, 4.0, 4)


def test_listing_and_delta(spark):
    html = '<table><tr><th><a href="?C=N">N</a></th></tr><tr><td><a href="a.srt">a.srt</a></td><td>2025-01-02 03:04</td><td> 96K</td></tr><tr><td><a href="d/">d/</a></td><td>2025-01-02 03:04</td><td> - </td></tr></table>'
    out = M.listing_entries(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [(r.name, r.is_dir, r.size_bytes) for r in out] == [("a.srt", False, 98304), ("d/", True, None)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "The dog"), (3, "cat and the cat dog")], "doc_id long, text string")
    index = S.postings(docs)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(S.matching(index, every=["cat"], none=["dog"])) == [1]
    assert ids(S.phrase(index, ["the", "cat"])) == [1, 3]
    assert ids(S.near(index, "cat", "dog", 1)) == [3]
    assert [r.doc_id for r in S.bm25(docs, ["cat"], 5).collect()] == [3, 1]


def test_files(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event": "smoke", "latency_ms": 5.0}\n\nnot json\n')
    assert FS.jsonl(spark, str(tmp_path / "log.jsonl")).count() == 1
    assert FS.jsonl(spark, str(tmp_path / "log.jsonl")).first().event == "smoke"
    (tmp_path / "m.json").write_text('{"label": "a",\n "phases": [{"phase": "seo", "cost": 0.5}]}')
    assert FS.metrics(spark, str(tmp_path / "m.json")).selectExpr("inline(phases)").first().cost == 0.5
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.srt").write_bytes("é".encode("latin-1"))
    (tmp_path / "s/b.scc").write_bytes("é".encode())
    (tmp_path / "s/c.txt").write_text("no")
    assert sorted(r.body_text for r in FS.side_files(spark, str(tmp_path / "s")).collect()) == ["é", "é"]
    (tmp_path / "p/x").mkdir(parents=True)
    (tmp_path / "p/x/manifest.json").write_text('{"project": "x", "status": "ok", "outputs": {"seo": "f"}}')
    assert FS.manifests(spark, str(tmp_path / "p")).first().deliverables == ["seo"]
    FS.snapshot(spark.range(3), str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 3
    head = FS.provenance(F.lit("<!-- model: gpt | tier: 2 | cost: $0.5 | tokens: 12 -->\nx"))
    row = spark.range(1).select(*(c.alias(k) for k, c in head.items())).first()
    assert (row.model, row.tier, row.tokens) == ("gpt", "2", 12)


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, "pending", 1, 5), (2, "pending", 3, 9), (3, "pending", 3, 7), (4, "failed", 9, 1)], "id long, status string, priority int, queued_at int")
    assert J.next_job(jobs).first().id == 3
    assert J.page_count(0, 25) == 1 and J.page_count(51, 25) == 3
    names = spark.createDataFrame([("a_b",), ("axb",), ("50%",)], "n string")
    assert names.where(J.contains_ci("A_B", "n")).count() == 1 and names.where(J.contains_ci("%", "n")).count() == 1


def test_many_flags_claim_in_time_that_follows_them(spark):
    import random
    import time

    draw = random.Random(3)
    groups = {j: [("flag" if draw.random() < 0.5 else "lint", [str(draw.randrange(4)), str(draw.randrange(4))]) for _ in range(30)] for j in range(40)}
    rows = [(j, "p", kind, k, rules) for j, own in groups.items() for k, (kind, rules) in enumerate(own)]
    draw.shuffle(rows)
    got = {r.job: tuple(r)[2:] for r in R.matched_flags(spark.createDataFrame(rows, "job long, phase string, kind string, ord int, rules array<string>")).collect()}
    for j, own in groups.items():
        free, both = [r[0] for kind, r in own if kind == "lint"], 0
        for kind, rules in own:
            hit = next((i for i, x in enumerate(free) if x in rules), None) if kind == "flag" else None
            if hit is not None:
                free.pop(hit)
                both += 1
        assert got[j] == (both, len(free), sum(kind == "flag" for kind, _ in own) - both)
    began = time.process_time()
    assert R.claimed([False] * 30_000 + [True] * 30_000, [["x"]] * 29_999 + [["y"]] + [["y", "z"]] * 30_000) == (1, 29_999, 29_999)
    assert time.process_time() - began < 2, "a search from the front takes 900 million steps"


def test_captions_are_held_against_one_set_of_their_document(spark):
    output = spark.createDataFrame([(1, "One two THREE four's five"), (2, None), (4, "no captions here")], "doc_id long, output string")
    texts = [(1, 3, "one TWO three"), (1, 1, "one two three zzz yyy xxx"), (1, 2, "a b"), (1, 4, None), (2, 1, "one two three"), (3, 1, "one two three")]
    found = C.caption_status(spark.createDataFrame(texts, "doc_id long, ord int, text string"), output)
    assert {tuple(r) for r in found.collect()} == {(1, 3, False), (1, 1, True), (1, 2, None), (1, 4, None), (2, 1, True)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 0, "no set is made for each caption of a document"
