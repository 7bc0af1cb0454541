"""Phrases, flags and limits by tables, against plain scans."""

import random

import pytest

from weftline.operators import phrases as P


def scanned(own, phrases, text):
    tokens = own.tokens(text)
    out = []
    for name, phrase in phrases:
        want = [t for t, _, _ in own.tokens(phrase)]
        out += [(name, tokens[i][1], tokens[i + len(want) - 1][2]) for i in range(len(tokens) - len(want) + 1) if want and [t for t, _, _ in tokens[i : i + len(want)]] == want]
    return sorted(out)


@pytest.mark.parametrize("words", [True, False])
def test_every_place_of_every_phrase(words):
    draw = random.Random(8)
    piece = lambda n: " ".join(draw.choice(["a", "ab", "Abc", "b", "é", "İx", "c-d", "."]) for _ in range(n))
    phrases = [(f"p{i}", piece(draw.randint(1, 4))) for i in range(300)] + [("none", ""), ("two", "a a"), ("again", "a a"), ("aaa", "aa" if not words else "a a a")]
    own = P.Automaton(phrases, words)
    for _ in range(100):
        text = piece(draw.randint(0, 30)).replace(" ", draw.choice([" ", "  ", "\n"])) + "aaaa"
        assert sorted(own.find(text)) == scanned(own, phrases, text)


def test_fifty_thousand_phrases(spark):
    draw = random.Random(3)
    word = lambda: "w%d" % draw.randrange(3000)
    phrases = [(f"p{i}", " ".join(word() for _ in range(draw.choice([1, 2, 2, 3])))) for i in range(50_000)]
    texts = [(i, " ".join(word() for _ in range(200))) for i in range(60)] + [(60, None), (61, ""), (None, "w1 w2")]
    rules = spark.createDataFrame(phrases + [(None, "w1"), ("x", None)], "id string, phrase string")
    df = spark.createDataFrame([(i, "clash", t) for i, t in texts], "doc_id long, id string, text string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.id, r.start, r.end) for r in P.phrase_spans(df, rules).collect())
    by = {}
    for name, phrase in phrases:
        by.setdefault(tuple(phrase.split()), []).append(name)
    want = []
    for i, text in texts:
        own = P.Automaton([]).tokens(text or "")
        for a in range(len(own)):
            for n in (1, 2, 3):
                want += [(i is None, i or 0, name, own[a][1], own[a + n - 1][2]) for name in by.get(tuple(t for t, _, _ in own[a : a + n]), []) if a + n <= len(own)]
    assert got == sorted(want) and len(got) > 10_000


def test_tables_that_no_automaton_holds(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_PHRASES", 2)
    with pytest.raises(ValueError, match="more than"):
        P.automaton(spark.createDataFrame([("a", "x")] * 3, "id string, phrase string"))


def test_more_phrases_than_an_automaton_holds(spark, monkeypatch):
    phrases = [("a", "One two"), ("b", "two"), ("c", "one  TWO"), ("d", "three, four five"), ("a", "five"), ("e", " "), (None, "one"), ("f", None), ("g", "İx ")]
    texts = [(1, "One two two; one\nTWO three, four five"), (2, "Three , FOUR\tfive  one"), (2, "two"), (3, ""), (4, None), (None, "é one two"), (5, "aİ İx ix")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    rules = spark.createDataFrame([(i, p, None if p is None else f"{i}{p}"[:2]) for i, p in phrases], "id string, phrase string, severity string")
    rows = lambda found: sorted(tuple(map(str, r)) for r in found.collect())
    want, told = rows(P.phrase_spans(df, rules)), rows(P.phrase_findings(df, rules.where("id <> 'a' OR phrase = 'five'")))
    monkeypatch.setattr(P, "MAX_PHRASES", 2)
    monkeypatch.setattr(P, "AT_ONCE", 0)
    monkeypatch.setattr(P, "MAP_BITS", 1 << 16)
    assert rows(P.phrase_spans(df, rules)) == want and len(want) == 16
    assert rows(P.phrase_findings(df, rules.where("id <> 'a' OR phrase = 'five'"))) == told and len(told) > 5
    monkeypatch.setattr(P, "bounded", lambda t, most: t)
    assert rows(P.phrase_spans(df, rules)) == want


#: category, need, part, rule: samples of what reviewers write.
RULES = [("no_result", 1, "nothing was written", "r.none"), ("label", 1, "one-word label", "r.label"), ("label", 1, "name label", "r.label"), ("label", 0, "who said", None),
         ("too_long", 1, "letters", None), ("too_long", 2, "beyond", None), ("too_long", 2, "too many", None), ("too_long", 3, "headline", "r.title"), ("too_long", 3, "summary", "r.summary")]


def test_categories_of_flags(spark):
    rules = spark.createDataFrame([(c, n, p, r, i) for i, (c, n, p, r) in enumerate(RULES)], "category string, need int, part string, rule_id string, rank int")
    flags = ["Nothing was written here", "A ONE-WORD LABEL stands there", "name label, but who said it?", "too many letters in the summary and the headline", "too many words", "", None]
    got = {r.key: (r.categories, r.rule_ids) for r in P.categories(spark.createDataFrame(list(enumerate(flags)), "key long, text string"), rules).collect()}
    assert got == {0: (["no_result"], ["r.none"]), 1: (["label"], ["r.label"]), 2: ([], []), 3: (["too_long"], ["r.title"]), 4: ([], []), 5: ([], []), 6: ([], [])}


def test_what_a_stronger_model_can_mend(spark):
    results = [
        (1, "seo", "fail", ["too long", "source not there"], None), (1, "x", "pass", [], "mark: open"), (2, "seo", "fail", ["too long"], "text"), (3, "seo", "fail", [], "MARK: OPEN"),
        (4, "seo", "fail", None, None), (5, "seo", "pass", None, None), (6, "a", "pass", ["odd", None], ""),
    ]
    df = spark.createDataFrame(results, "id long, phase string, status string, flags array<string>, output string")
    patterns = spark.createDataFrame([("flag", "not there"), ("output", "mark: open")], "kind string, part string")
    got = {r.id: (r.fixable, r.nonfixable, r.escalate) for r in P.qa_outcome(df, patterns).collect()}
    assert got == {1: (1, 1, False), 2: (1, 0, True), 3: (0, 1, False), 4: (1, 0, True), 5: (0, 0, True), 6: (2, 0, True)}


def test_limits_most_specific_first(spark):
    table = spark.createDataFrame([("t", None, None, 60, None, None), ("k", None, None, None, 15, 20), ("k", "short", None, None, 5, 10), ("k", "short", "p", None, None, 3), ("t", None, "p", 90, None, None)], "field string, content_type string, programme string, max int, min_count int, max_count int")
    rows = spark.createDataFrame([(1, "full", None), (2, "short", None), (3, "short", "p"), (4, None, None), (5, "full", "q")], "id long, kind string, prog string")
    got = {r.id: {k: tuple(v) for k, v in r.limits.items()} for r in P.with_limits(rows, table, rows.kind, rows.prog).collect()}
    common = {"t": (60, None, None), "k": (None, 15, 20)}
    assert got == {1: common, 2: {"t": (60, None, None), "k": (None, 5, 10)}, 3: {"t": (90, None, None), "k": (None, 5, 3)}, 4: common, 5: common}
    assert [r.limits for r in P.with_limits(rows, table.limit(0)).collect()] == [None] * 5


def test_limits_of_one_kind_read_no_rows(spark, monkeypatch):
    table = spark.createDataFrame([("t", None, None, 60, None, None)], "field string, content_type string, programme string, max int, min_count int, max_count int")
    asked, own = [], P.resolved_limits
    monkeypatch.setattr(P, "resolved_limits", lambda limits, kinds: asked.append(kinds) or own(limits, kinds))
    assert [r.limits["t"].max for r in P.with_limits(spark.range(3), table).collect()] == [60] * 3
    assert "Range" not in asked[0]._jdf.queryExecution().toString()
