"""Ranked search over stored segments against scores of every document."""

import math
import random
import re
from collections import Counter

import pytest

from weftline.operators.search import B, K1
from weftline.operators.text_index import BLOCK, TextIndex


def plain(texts, terms, allowed=None):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w) & set(terms))
    out = []
    for i, w in words.items():
        tf = Counter(x for x in w if x in terms)
        if tf and (allowed is None or i in allowed):
            s = sum(math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for t, n in tf.items())
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)]


def text(draw):
    words = ["common"] * draw.randrange(0, 9) + [draw.choice(["rare", "x", "y", "z", "w1", "w2"]) for _ in range(draw.randrange(1, 40))] + ["Unique!"] * (draw.random() < 0.01)
    draw.shuffle(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    draw = random.Random(4)
    texts = {i: text(draw) for i in range(4000)}
    texts |= {4000: None, 4001: "", 4002: texts[5], 4003: texts[5]}
    out = TextIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/i")
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string").repartition(3)
    out.add(0, frame(texts))
    changed = {i: f"common rare {text(draw)}" for i in range(0, 4000, 9)} | {5000: "rare " * 30}
    gone = [(i,) for i in range(4, 4000, 17)]
    out.add(1, frame(changed), spark.createDataFrame([g for g in gone if g[0] not in changed], "doc_id long"))
    out.add(1, frame({1: "rare"}))
    texts |= changed
    return out, {i: t for i, t in texts.items() if (i,) not in gone or i in changed}


@pytest.mark.parametrize(("terms", "k", "offset"), [(["common", "rare"], 10, 0), (["unique"], 50, 0), (["common", "unique", "w1"], 25, 30), (["x"], 5, 0), (["none"], 5, 0), (["common", "none", "rare", "rare"], 3000, 1000)])
def test_pages_as_by_all_scores(index, terms, k, offset):
    found = index[0].search(terms, k, offset)
    want = plain(index[1], terms)
    assert found.total == len(want)
    got = [(r.doc_id, pytest.approx(r.score, abs=2e-6)) for r in found.page.collect()]
    assert got == want[offset : offset + k]


def test_only_some_documents_count(spark, index):
    allowed = set(range(0, 5001, 7))
    found = index[0].search(["common", "rare"], 12, 3, spark.createDataFrame([(i,) for i in allowed] + [(7,)], "doc_id long"))
    want = plain(index[1], ["common", "rare"], allowed)
    assert found.total == len(want) and [r.doc_id for r in found.page.collect()] == [i for i, _ in want[3:15]]


def test_blocks_that_cannot_reach_the_page_stay_unread(index):
    found = index[0].search(["x"], 5)
    assert found.blocks > 20 and found.read < found.blocks / 2, "blocks are in order of weight"
    scanned = index[0]._blocks(["x"])
    assert max(r.n for r in scanned.collect()) <= BLOCK
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", scanned._jdf.queryExecution().toString()), "other folders are not opened"


def test_an_empty_index(spark, tmp_path):
    empty = TextIndex(spark, f"file://{tmp_path}/i")
    assert empty.search(["x"], 5).total == 0
    empty.add(0, spark.createDataFrame([], "doc_id long, text string"))
    assert empty.search(["x"], 5).page.collect() == []


def test_words_phrases_and_prefixes_of_live_texts(index):
    from weftline.operators import search as S

    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in index[1].items()}
    ids = lambda df: {r.doc_id for r in df.collect()}
    pairs = lambda w: list(zip(w, w[1:], strict=False))
    assert ids(S.phrase(index[0].postings(["common", "rare"]), ["common", "rare"])) == {i for i, w in words.items() if ("common", "rare") in pairs(w)}
    got = S.matching(index[0].postings(["common", "x"], prefix="uni"), every=["common"], none=["x"], prefix="uni")
    assert ids(got) == {i for i, w in words.items() if "common" in w and "x" not in w and "unique" in w}
    rows = index[0].postings(["rare"]).collect()
    assert {(r.doc_id, tuple(r.positions)) for r in rows} == {(i, tuple(k for k, x in enumerate(w) if x == "rare")) for i, w in words.items() if "rare" in w}


def test_words_are_not_shuffled_to_be_counted(spark, tmp_path):
    """One exchange of postings stands between texts and files, and blocks are cut by term whatever batches they come in."""
    texts = {i: f"all all w{i % 3} end{i}" for i in range(3 * BLOCK)}
    index = TextIndex(spark, f"file://{tmp_path}/i")
    shuffled = lambda: sum(s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size())))
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = shuffled()
    index.add(0, spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    assert shuffled() - before == 3 * len(texts), "a row a term and text, once"
    blocks = index._all().select("term", "n", "docs", "places").collect()
    assert max(b.n for b in blocks) <= BLOCK and all(b.n == len(b.docs) == len(b.places) for b in blocks)
    assert sorted(d.doc_id for b in blocks if b.term == "all" for d in b.docs) == sorted(texts)
    assert all(p == [0, 1] for b in blocks if b.term == "all" for p in b.places)
