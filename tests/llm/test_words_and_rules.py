import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm.line_quality import clean_documents, line_quality
from weftline.llm.words import Words, pieces

ODD = ["", " \n\t", None, "a", "É\x0bé  A\x1fb", "x " * 30, "\n".join(["same line here"] * 5), "z" * 5000, "日本 語\n日本 語"]


def test_words_and_shingles_against_plain_python():
    draw = random.Random(3)
    texts = ODD + [" ".join(draw.choice(["A", "b", "cc", "É", "\n"]) for _ in range(draw.randint(0, 40))) for _ in range(200)]
    hashes: dict = {}
    for _, part in pieces(pa.array(texts)):
        w = Words(part)
        found = iter(w.list())
        sh, bounds = w.shingles(3)
        for i, text in enumerate(part.to_pylist()):
            own = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
            assert [next(found) for _ in own] == own
            want = [tuple(own[j : j + 3]) for j in range(max(len(own) - 2, min(len(own), 1)))]
            have = sh[bounds[i] : bounds[i + 1]].tolist()
            assert len(have) == len(want)
            for k, h in zip(want, have, strict=True):
                assert hashes.setdefault(k, h) == h
    assert len(set(hashes.values())) == len(hashes)


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    own = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = [(i, f"{own(30)}\nAll rights reserved, as ever and always by us\n{own(25)}") for i in range(40)]
    copy = "\n".join(own(20) for _ in range(3))
    rows += [(100 + i, copy) for i in range(60)]
    rows += [(200 + i, t) for i, t in enumerate(ODD)] + [(300, "one two three four five six seven eight nine # " * 5), (301, "All rights reserved, as ever and always by us\n" + "few " * 11)]
    return rows


def test_line_quality_against_brute_force(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = {r.doc_id: r for r in line_quality(df).collect()}
    assert len(got) == len(texts)
    sig = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sig[i] = tuple(w)  # these texts are equal or quite different
    seen = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            if line.split():
                seen.setdefault(" ".join(line.lower().split()), set()).add(sig[i])
    frequent = {k for k, v in seen.items() if len(v) > max(10, 0.01 * len(set(sig.values())))}
    assert frequent == {"all rights reserved, as ever and always by us"}
    for i, t in texts:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), (i, t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        gone = [j for j, x in enumerate((t or "").split("\n")) if " ".join(x.lower().split()) in frequent]
        assert r.removed == gone
        left = r.n_words - sum(len(x.split()) for j, x in enumerate((t or "").split("\n")) if j in gone)
        assert r.words_left == left and r.kept == (not r.base_failed and left >= 10 and left >= 0.2 * r.n_words)
    assert all(got[100 + i].kept for i in range(60)), "copies of one text do not make its lines frequent"


def test_documents_that_share_most_of_their_text_count_apart(spark):
    draw = random.Random(8)
    own = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = [own(30) for _ in range(6)]
    rows = [(i, "\n".join([own(20), *shared])) for i in range(50)]
    rows += [(100 + i, rows[0][1].upper().replace(" ", "  ")) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    for r in line_quality(df).collect():
        assert (r.removed, r.words_left, r.kept) == ([1, 2, 3, 4, 5, 6], 20, False), r.doc_id


def test_clean_documents(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").alias("n_chars"), F.lit(1).alias("removed"), F.lit(2).alias("host"))
    out = clean_documents(df.drop("removed"))
    assert out.columns == df.drop("removed").columns
    rows = {r.doc_id: r for r in out.collect()}
    assert "All rights" not in rows[0].text and rows[0].n_chars == len(rows[0].text) and rows[0].text.count("\n") == 1
    assert rows[100].text == dict(texts)[100] and 200 not in rows


def test_clean_documents_with_clashing_columns_and_ids(spark, texts):
    kept, gone = texts[0][1], "too short"
    rows = [(5, kept), (5, gone), (5, kept), (None, kept), (None, gone), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "removed": F.lit("x"), "host": F.lit(2), "text_hash": F.lit(3), "v": F.lit(4), "d": F.lit(5)})
    out = clean_documents(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.text, r.removed) for r in out.collect()) == [(0, kept, "x"), (5, kept, "x"), (5, kept, "x")]


def test_copies_counted_by_id(spark):
    draw = random.Random(8)
    line = " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    df = spark.createDataFrame([(i, line) for i in range(12)] + [(3, line)], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {tuple(r.removed) for r in line_quality(df).collect()} == {()}
    assert {tuple(r.removed) for r in line_quality(df, fold_copies=False).collect()} == {(0,)}
    assert {tuple(r.removed) for r in line_quality(df.where("doc_id < 10"), fold_copies=False).collect()} == {()}


def test_empty_table_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_quality(none).count() == 0
    twice = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id or 0, r.n_words) for r in line_quality(twice).collect()) == [(0, 0), (1, 2), (1, 2)]


def test_long_text_in_one_piece():
    parts = list(pieces(pa.array(["a " * 1_500_000, "b", None])))
    assert [at for at, _ in parts] == [0, 1] and np.diff(Words(parts[0][1]).bounds).tolist() == [1_500_000]
