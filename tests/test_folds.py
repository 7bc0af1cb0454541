"""Queries without SQL, over whole tables, against plain versions written another way."""

import re
from difflib import SequenceMatcher

import pytest

from weftline.plans import QUERIES
from weftline.plans.texts import captions, lines

SF = "/root/testdata/sf0.001"


def found(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def test_speakers_share_a_caption(spark):
    got = {}
    for r in found(spark, "f12_split_speakers"):
        got.setdefault(r["doc_id"], []).append(r)
    split = 0
    for row in captions(spark, SF).collect():
        own = sorted(got.get(row.doc_id, []), key=lambda r: r["index"])
        assert [r["index"] for r in own] == list(range(1, len(own) + 1))
        at = 0
        for c in row.captions:
            text = c.text.replace(". ", ". >> ")
            parts = [p.strip() for p in text.split(">>")]
            parts = [p if k == 0 else f">> {p}" for k, p in enumerate(parts) if p]
            if len(parts) < 2:
                parts = [text]
            mine, at = own[at : at + len(parts)], at + len(parts)
            assert [m["text"] for m in mine] == parts
            assert mine[0]["start_ms"] == c.start_ms and mine[-1]["end_ms"] == c.end_ms
            assert all(a["end_ms"] == b["start_ms"] and a["start_ms"] < a["end_ms"] for a, b in zip(mine, mine[1:], strict=False))
            size, span = sum(map(len, parts)), c.end_ms - c.start_ms
            room = len(parts) + 1
            assert all(abs((m["end_ms"] - m["start_ms"]) - span * len(m["text"]) / size) <= room for m in mine)
            split += len(parts) > 1
        assert at == len(own)
    assert split > 50


def test_flags_claim_what_is_free(spark):
    groups = {}
    for r in lines(spark, SF).collect():
        n = len(r.line)
        groups.setdefault((r.doc_id, r.lang), []).append((r.n, r.n % 2 == 0, str(n % 5), str(n % 3)))
    got = {(r["job"], r["phase"]): (r["both"], r["lint_only"], r["flag_only"]) for r in found(spark, "d10_greedy_match")}
    assert len(got) == len(groups) > 100
    for key, rows in groups.items():
        free = [a for _, lint, a, _ in sorted(rows) if lint]
        flags = [(a, b) for _, lint, a, b in sorted(rows) if not lint]
        both = 0
        for pair in flags:
            hit = min((free.index(x) for x in pair if x in free), default=None)
            if hit is not None:
                del free[hit]
                both += 1
        assert got[key] == (both, len(free), len(flags) - both)


def test_phrases_differ_as_the_blocks_say(spark):
    tokens = lambda t: re.findall(r"[\w'’\-]+|[^\w\s]", t)
    want = []
    for r in lines(spark, SF).collect():
        a, b = tokens(r.line), tokens(re.sub(r"\band\b ", "", re.sub(r"\bthe\b", "a", r.line, flags=re.A), flags=re.A))
        ops = [x for x in SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes() if x[0] != "equal"]
        want += [(r.doc_id, r.n, i, " ".join(a[p:q]), " ".join(b[s:t])) for i, (_, p, q, s, t) in enumerate(ops)]
    got = [(r["doc_id"], r["n"], r["ord"], r["old"], r["new"]) for r in found(spark, "h6_sequence_diff")]
    assert len(want) > 300 and sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["b9_guarded_substitutions"])
def test_substitutions_stay_outside_of_guards(spark, name):
    import hashlib

    def opens(text, at):
        return re.search(r"(?:\A|\n|[.!?][\"'”’]?)[ \t]*\Z", text[:at].rstrip(" \t")) is not None

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    applied = 0
    for r in found(spark, name):
        text, n = docs[r["doc_id"]], 0
        for find, new in ((r"\bthe\b", "The"), (r"\bof of\b", "of"), (r"\bis\b", "was")):
            guards = [m.span() for m in re.finditer(r"```.*?```|https?://\S+", text, re.S)]

            def put(m, text=text, new=new, guards=guards):
                nonlocal n
                kept = any(a < m.end() and m.start() < b for a, b in guards) or m[0] == new or (m[0].lower() == new.lower() and opens(text, m.start()))
                n += not kept
                return m[0] if kept else new

            text = re.sub(find, put, text)
        before, after = len(docs[r["doc_id"]].split()), len(text.split())
        ok = 0.995 <= after / max(before, 1) <= 1.005
        assert r["applied"] == n and r["reverted"] == (not ok), r["doc_id"]
        assert r["text_md5"] == hashlib.md5((text if ok else docs[r["doc_id"]]).encode()).hexdigest()
        applied += n
    assert applied > 300


@pytest.mark.parametrize("name", ["b9_guarded_substitutions", "f12_split_speakers", "h6_sequence_diff"])
def test_batches_of_whole_texts_are_bounded(spark, name):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    QUERIES[name](spark, SF)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_equal_lines_stay_out_of_python(spark):
    plan = QUERIES["h6_sequence_diff"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"ArrowEvalPython[\s\S]*Filter[^\n]*regexp_replace", plan)
