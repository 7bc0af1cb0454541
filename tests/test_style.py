"""Draft checks, section text and reports on small inputs with known results, empty and null ones included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.operators import reports as R
from weftline.operators import style as S


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


PAGE = "**Project:** p\n---\n**Ann Lee:**\nHi.\n\n\n**Lee:** \nYes (2:00).\n**Note:** aside\n---\n**Status:** ready"


def test_sections(spark):
    X = F.col("x")  # noqa: N806
    assert values(spark, S.region(X)["body"], [PAGE, "no rules", "", None])[1:] == ["no rules", "", None]
    assert values(spark, S.labels(X), [PAGE, "", "**Dr. No:**"]) == [["Ann Lee", "Lee"], [], ["Dr. No"]]
    assert values(spark, S.speaker_turns(X, 2, 1), [PAGE])[0] == "**Project:** p\n---\n**Ann Lee:**  \nHi.\n\n**Lee:**  \nYes (2:00).\n\n**Note:** aside\n---\n**Status:** ready"
    assert values(spark, S.speaker_turns(X), ["plain", ""]) == ["plain", ""]
    assert values(spark, S.section_tail(X), ["a\n last \n\n", "", " \n"]) == ["last", "", ""]
    assert values(spark, S.tags(X), ["### YouTube Tags\n```\na, b,\n```", "none"]) == [["a", "b"], None]


def test_names_and_casing(spark):
    X = F.col("x")  # noqa: N806
    table = "| Speaker | Role |\n|---|---|\n| Ann Leeds | Host |\n| Bob Day | Guest |\n| kim | x |\n| Ann Leeds | again |"
    assert values(spark, S.proper_nouns(X, ["leeds"]), [table, "", None]) == [["Ann Leeds", "Bob Day"], [], []]
    seed = S.canonical_seed(["PBS"], {"atty gen": "Atty. Gen."})
    styled = S.down_styled(X, S.canonical_terms(F.array(F.lit("Pbs"), F.lit("Ann $ Leeds")), seed))
    assert values(spark, styled, ["THE ATTY GEN on pbs with ann $ LEEDS", "1 (go", "", "atty. gen. x"]) == ["The Atty. Gen. on Pbs with Ann $ Leeds", "1 (Go", "", "Atty. Gen. x"]
    fields = [(X, ["led by"], "host"), (X, ["and include"], "guest"), (F.lit("Reporters Ann Leeds and Eve Hart"), ["reporters"], "guest")]
    assert [tuple(r) for r in values(spark, S.speaker_names(fields), ["led by Ann Leeds and include Bob Day.", "", None])] == [("Ann Leeds", ["Bob Day", "Eve Hart"]), ("Ann Leeds", ["Eve Hart"]), ("Ann Leeds", ["Eve Hart"])]
    assert values(spark, S.cued_names(X, ["with"], ["Judge", "Dr"]), ["With Judge Ann van Leeds, Jo-Ann Day. Not Bob Moss", "with Dr Kim", "without Ann Leeds"]) == [["Ann van Leeds", "Jo-Ann Day"], [], []]


def test_fields_and_splices(spark):
    X = F.col("x")  # noqa: N806
    page = "### Title\n\n**Recommended:**\n\n  Old name \n\n### Long Description\n**Recommended:**\nLong one\n"
    out = S.spliced(X, [(S.field(X, "long_description"), F.lit("L")), (S.field(X, "title"), F.lit("A much longer name"))])
    assert values(spark, out, [page, "none"]) == [page.replace("Old name", "A much longer name").replace("Long one", "L"), "none"]
    stale = S.spliced(F.concat(F.lit("!"), X), [(S.field(X, "title"), F.lit("n"))])
    with pytest.raises(Exception, match="span"):
        values(spark, stale, [page])


def test_lint_of_missing_and_bad_drafts(spark):
    bad = "Id {media_id} and more text to have fifty characters in all, or else.\n---\n**Lee:**\nLate (9:99:00) end"
    df = spark.createDataFrame([(1, 10.0, None, bad, "<!-- c -->", {})], "id long, minutes double, analyst string, formatter string, seo string, limits map<string,struct<max:int,min_count:int,max_count:int>>")
    out = {r.phase: sorted(f.rule_id for f in r.findings) for r in S.lint(df).collect()}
    rule = "lint.formatter."
    assert out == {"analyst": ["lint.output_missing"], "seo": ["lint.output_missing"], "formatter": [rule + "content_past_duration", rule + "speaker_label_inconsistent", rule + "truncation_suspect", "lint.placeholder_text"]}
    assert S.lint(df.limit(0)).count() == 0


def test_verdicts_and_flags(spark):
    X = F.col("x")  # noqa: N806
    v = S.verdict_of(X, "overall string")
    assert values(spark, v["overall"], ['```json\n{"overall": "pass"}\n```', '{"overall": "fail"}', "oops", ""]) == ["pass", "fail", None, None]
    assert values(spark, S.appended(F.array(F.lit("a"), F.lit("a")), F.split(X, ",")), ["b,a,b"]) == [["a", "a", "b"]]
    with pytest.raises(Exception, match="unknown block"):
        values(spark, S.rendered_tokens(X, {}, "full"), ["{{style:k}}"])


def test_reports(spark):
    X = F.col("x")  # noqa: N806
    assert values(spark, R.export_name(X, F.lit("f.md")), ["A / b--c!"]) == ["A-b-c-f.md"]
    assert values(spark, R.version_tag(X), ["4.1.0", "4.1.1.dev3+g8a", "7"]) == ["v4.1", "v4.1", "v0.0"]
    now = dt.datetime(2025, 1, 2, 8, 0)
    assert values(spark, R.next_run(X, F.lit(now).cast("timestamp_ntz")), ["08:00", "9:30", "24:00", "x", None]) == [dt.datetime(2025, 1, 3, 8), dt.datetime(2025, 1, 2, 9, 30), None, None, None]
    assert [tuple(r) for r in values(spark, R.unavailable(X, F.lit("5")), ["", '{"error": {"retryable": false}}'])] == [("backend returned 503", 5, True), ('{"error": {"retryable": false}}', 5, False)]
    rows = spark.createDataFrame([("b", 1), ("a", 1), (None, 5)], "k string, n int")
    assert R.markdown(rows, ["k", "n"], [-F.col("n"), F.col("k")], "T").first()[0] == "## T\n\n| k | n |\n|---|---|\n| — | 5 |\n| a | 1 |\n| b | 1 |"
    assert R.markdown(rows.limit(0), ["k", "n"], [F.col("n")], "T").first()[0] == "## T\n\n_None._"


def test_walk_stops_at_its_depth(spark):
    entries = spark.createDataFrame([("/", "/a", "a", True), ("/a", "/a/b", "b", True), ("/a", "/a/1", "1", False), ("/a/b", "/a/b/2", "2", False), ("/a/b", "/", "up", True)], "directory string, url string, name string, is_dir boolean")
    roots = spark.createDataFrame([("/",), ("/a",)], "url string")
    assert sorted(r.url for r in R.walked(entries, roots, 0).collect()) == ["/a/1"]
    assert sorted(r.url for r in R.walked(entries, roots, 5).collect()) == ["/a/1", "/a/b/2"]
    assert sorted(r.url for r in R.walked(entries, roots, 5, ["b"]).collect()) == ["/a/1"]


def test_a_rule_alone_is_found_as_among_all(spark):
    from weftline.plans.style import limited

    drafts = limited(spark, "/root/testdata/sf0.001").persist()
    of = lambda rows: sorted((r.id, r.f.rule_id, r.f.message) for r in rows.select("id", F.explode("findings").alias("f")).collect())
    every = of(S.lint(drafts))
    for rule in sorted({r for _, r, _ in every}):
        alone = S.lint(drafts, rule)
        assert [x for x in of(alone) if x[1] == rule] == [x for x in every if x[1] == rule]
        if rule == "lint.formatter.truncation_suspect":
            assert {r.phase for r in alone.select("phase").distinct().collect()} == {"formatter"}, "nothing else is looked at"
    drafts.unpersist()
