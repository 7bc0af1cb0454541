"""Each stage of the pipeline against a plain Python version, on rows with null ids, clashing ids, repeats and other columns."""

import math
import random
import re

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_jaccard_and_leaks import shingles, windows_by_hand
from test_models import plain_bounds
from test_words_and_rules import base

from weftline.llm import quality_fm as Q
from weftline.llm.decontaminate import contaminated_windows
from weftline.llm.jaccard_join import jaccard_components
from weftline.llm.words import pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Rows whose columns clash with those that the operators make, short enough for brute force."""
    real = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect()]
    draw = random.Random(12)
    own = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    first = own(40)
    footer = "All rights of this site are reserved to its owners"
    more = [(None, first), (70001, first), (70001, first), (70002, first + " end"), (70003, None), (70003, own(30)), (None, own(30)), (None, own(30)), (None, None), (70004, ""), (70005, own(20) + ". " + items[0]), (None, own(25) + " " + items[1]), (70005, own(40))]
    more += [(70100 + i, own(25) + "\n" + footer) for i in range(15)]
    extra = spark.createDataFrame([(i, t, "en", "host0", len(t or "")) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    every = real.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(extra)
    clash = {"removed": F.lit("x"), "key": F.lit(1), "host": F.lit(2), "group": F.lit(3), "doc": F.lit(4), "item": F.lit(5), "label": F.lit(6), "score": F.lit(7), "component_id": F.lit(8), "length": F.lit(9)}
    return every.withColumns(clash)


def rows(df):
    return sorted(((r.doc_id, r.text, r.source, r.n_chars) for r in df.collect()), key=str)


def test_quality_rules(spark, docs):
    found = docs.collect()
    norm = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    hosts, seen = {}, {}
    for r in found:
        hosts.setdefault(r.source, set()).add(norm(r.text))
        for line in (r.text or "").split("\n"):
            if norm(line):
                seen.setdefault((r.source, norm(line)), set()).add(norm(r.text))
    often = {k for k, v in seen.items() if len(v) > max(10, 0.01 * len(hosts[k[0]]))}
    want = []
    for r in found:
        n, _, _, _, repeated = base(r.text)
        ls = (r.text or "").split("\n")
        left = [x for x in ls if (r.source, norm(x)) not in often]
        words = len(norm("\n".join(left)).split())
        if n >= 20 and 100 * repeated <= 30 * n and words >= 10 and words >= 0.2 * n:
            text = "\n".join(left)
            want.append((r.doc_id, text, r.source, len(text) if text != r.text else len(r.text)))
    out = P.quality_rules(spark, docs, SF)
    assert out.columns == docs.columns and often
    assert rows(out) == sorted(want, key=str)


def test_quality_classifier(spark, docs):
    machine = Q.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = []
    for r in docs.collect():
        _, i, x = Q.features(next(pieces(pa.array([r.text], pa.string())))[1])
        z = machine.w0 + machine.w[i] @ x + sum((machine.v[i[a]] @ machine.v[i[:a]].T) @ x[:a] * x[a] for a in range(1, len(i)))
        if 1 / (1 + math.exp(-z)) >= Q.THRESHOLD:
            want.append((r.doc_id, r.text, r.source, r.n_chars))
    out = P.quality_classifier(spark, docs, SF)
    assert out.columns == docs.columns and 0 < len(want) < docs.count()
    assert rows(out) == sorted(want, key=str)


def test_near_duplicates(spark, docs):
    found = sorted({(r.doc_id, r.text, r.source, r.n_chars) for r in docs.collect()}, key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    sets = [shingles(r[1], 5) for r in found]
    group = list(range(len(found)))
    for a in range(len(found)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    want = [r for i, r in enumerate(found) if group[i] == i]
    out = P.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns and len(want) < len(found)
    got = rows(out)
    assert len(got) == len(want)
    # of rows without id and equal shingles any one stays
    assert [r for r in got if r[0] is not None] == sorted((r for r in want if r[0] is not None), key=str)


def test_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = docs.collect()
    bad = {i for i, _ in windows_by_hand([(i, r.text) for i, r in enumerate(found)], items)}
    out = P.decontamination(spark, docs, SF)
    assert out.columns == docs.columns and bad
    assert rows(out) == sorted(((r.doc_id, r.text, r.source, r.n_chars) for i, r in enumerate(found) if i not in bad), key=str)


def test_packing(spark, docs):
    out = P.packing(spark, docs, SF).toPandas()
    words = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect())
    assert sorted(out.length) == words
    length, n = np.unique(words, return_counts=True)
    assert out.padding.sum() == plain_bounds(length.tolist(), n.tolist(), 16)
    assert (out.groupby("batch").bucket_length.sum() <= 32_768).all()


def test_stages_on_empty_tables(spark, docs):
    for name, step in P.STAGES:
        out = step(spark, docs.limit(0), SF)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_stages_in_order_and_each_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    assert [n for n, _ in P.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "packing"]
    for name, step in P.STAGES[:-1]:
        docs = P.stage(step(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() <= left
        left = docs.count()
    assert left > 80
    groups = jaccard_components(docs, 5, 80)
    assert groups.where("component_id <> doc_id").count() == 0
    assert contaminated_windows(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert P.STAGES[-1][1](spark, docs, SF).count() == left
    assert P.run(spark, SF).count() == left
