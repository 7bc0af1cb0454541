import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import hidden_markov as H
from weftline.llm import quality_fm as Q
from weftline.llm.packing import optimal_bounds, pack
from weftline.llm.words import pieces

SF = "/root/testdata/sf0.001"


def held(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def docs(spark):
    more = spark.createDataFrame([(90001, None), (90002, ""), (90003, "word " * 3000), (90004, " \n")], "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(more).withColumns({"block": F.lit(1), "token": F.lit("x")})


def test_base_scores_and_gain(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b" "] for i, t in rows.items()}
    counts = Counter(x for i, t in tokens.items() if held(i, 7) != 2 for x in t)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in H.score_documents(docs).collect()}
    assert got.keys() == rows.keys()
    gain = size = 0.0
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(x in counts for x in t), n, held(i, 7) == 2)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
        assert r.score <= 0
        if r.held_out:
            gain, size = gain + r.score - r.base_score, size + r.n_tokens
    assert gain / size > 0.05, "held-out texts are likelier than under the unigram model"


def tiny():
    draw = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return H.Model(norm(draw.random(3), 0), norm(draw.random((3, 3)), 1), norm(draw.random((5, 3)), 0))


def test_likelihood_and_counts_by_enumeration():
    model, sequences = tiny(), [[0, 1, 4, 2], [3], [], [2, 2, 1]]
    classes, bounds = np.array(list(itertools.chain(*sequences))), np.cumsum([0, *map(len, sequences)])
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s, have in zip(sequences, H.log10_likelihood(model, classes, bounds), strict=True):
        paths = {}
        for p in itertools.product(range(3), repeat=len(s)):
            x = model.start[p[0]] if p else 1.0
            for a, b in itertools.pairwise(p):
                x *= model.move[a, b]
            for k, o in zip(p, s, strict=True):
                x *= model.emit[o, k]
            paths[p] = x
        total = sum(paths.values())
        assert math.isclose(have, math.log10(total), abs_tol=1e-9)
        for p, x in paths.items():
            if p:
                start[p[0]] += x / total
            for a, b in itertools.pairwise(p):
                move[a, b] += x / total
            for k, o in zip(p, s, strict=True):
                emit[o, k] += x / total
    have = H.expected_counts(model, classes, bounds)
    assert math.isclose(have[3], sum(math.log(10) * x for x in H.log10_likelihood(model, classes, bounds)))
    for have, want in zip(have, (start, move, emit), strict=False):
        assert np.allclose(have, want)


def plain_counts(model, classes):
    """Log10 likelihood and expected counts of one text by the plain scaled recursions over all its tokens."""
    alpha, scale = [], []
    for i, c in enumerate(classes):
        a = (model.start if i == 0 else alpha[-1] @ model.move) * model.emit[c]
        scale.append(a.sum())
        alpha.append(a / a.sum())
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    beta = np.ones(3)
    for i in range(len(classes) - 1, -1, -1):
        emit[classes[i]] += alpha[i] * beta
        if i == 0:
            start += alpha[0] * beta
            break
        x = model.emit[classes[i]] * beta / scale[i]
        move += model.move * np.outer(alpha[i - 1], x)
        beta = model.move @ x
    return sum(map(math.log10, scale)), start, move, emit


def test_long_texts_are_exact_over_segments(monkeypatch):
    monkeypatch.setattr(H, "SEGMENT", 7)
    model, draw = tiny(), np.random.default_rng(2)
    texts = [draw.integers(0, 5, n) for n in (3 * 7 + 4, 7, 8, 1, 70, 6, 14)]
    classes, bounds = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    plain = [plain_counts(model, x) for x in texts]
    assert np.allclose(H.log10_likelihood(model, classes, bounds), [p[0] for p in plain], rtol=1e-9, atol=0)
    start, move, emit, log = H.expected_counts(model, classes, bounds)
    assert math.isclose(log, math.log(10) * sum(p[0] for p in plain), rel_tol=1e-9)
    for have, want in zip((start, move, emit), (sum(p[i] for p in plain) for i in (1, 2, 3)), strict=True):
        assert np.allclose(have, want, rtol=1e-9)


@pytest.mark.parametrize(("own_share", "common"), [(1e-9, 200_000), (1 / 300, 50)])
def test_query_scores_by_a_plain_forward_pass(spark, monkeypatch, own_share, common):
    """The rows of score_documents against a forward recursion over words, with the model that it fitted; with few own classes most words share one."""
    kept = {}
    updated = H._updated
    monkeypatch.setattr(H, "_updated", lambda *a: kept.setdefault("all", []).append(updated(*a)) or kept["all"][-1])
    monkeypatch.setattr(H, "OWN_SHARE", own_share)
    monkeypatch.setattr(H, "COMMON", common)
    more = spark.createDataFrame([(None, "the last word"), (0, "an id again"), (0, "an id again"), (7, None)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 1500).alias("text")).unionByName(more).repartition(3)
    got = {(r.doc_id, round(r.score, 6)) for r in H.score_documents(docs).collect()}
    model = kept["all"][-1][0]
    rows = [(r.doc_id, re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower())) for r in docs.collect()]
    train = lambda i: i is None or held(i, 7) != 2
    counts = Counter(x for i, t in rows if train(i) for x in t)
    tokens = sum(counts.values()) + sum(train(i) for i, _ in rows)
    words = lambda w: H.Words(next(pieces(pa.array([w.decode()])))[1])
    order = sorted(((-n, words(w).hash.view(np.int64)[0], w) for w, n in counts.items() if n >= max(5, tokens * own_share)))
    own = {w: H.OWN + k for k, (_, _, w) in enumerate(order)}
    assert len(model.emit) == H.OWN + len(own) and len(own) < len(counts)
    ending = {w: int(H._endings(words(w), np.array([0]))[0]) for w in counts}
    mass = Counter()
    for w, n in counts.items():
        if w not in own:
            mass[ending[w]] += n
    share = lambda w: (own[w], 1.0) if w in own else (ending[w], counts[w] / mass[ending[w]]) if w in counts else (H.UNKNOWN, 1.0)
    for i, text in rows:
        a, log = None, 0.0
        for c, part in [*map(share, text), (H.END, 1.0)]:
            a = (model.start if a is None else a @ model.move) * model.emit[c] * part
            log += math.log10(a.sum())
            a = a / a.sum()
        assert any((i, round(log + d, 6)) in got for d in (0, 1e-6, -1e-6)), i
    assert math.isclose(sum(model.emit[:, 0]), 1, rel_tol=1e-9)


def test_start_values_come_from_all_texts(spark):
    """Two kinds of texts, of which one is rare, have states of their own from the start."""
    draw = np.random.default_rng(3)
    kinds = [[f"{k}{i}" for i in range(50)] for k in "ab"]
    texts = [(i, " ".join(draw.choice(kinds[i % 10 == 0], 60))) for i in range(300)]
    kept = {}
    seed = H._seed
    try:
        H._seed = lambda *a: kept.setdefault("model", seed(*a))
        H.score_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), states=2, rounds=1)
    finally:
        H._seed = seed
    emit = kept["model"].emit
    share = emit[H.OWN :, 0] / emit[H.OWN :].sum(1)
    assert (np.minimum(share, 1 - share) < 0.3).mean() > 0.9 and (share > 0.5).sum() == 50


def test_scores_of_an_empty_table(spark):
    assert H.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_machine_in_linear_time_equals_all_pairs():
    draw = np.random.default_rng(4)
    m = Q.Machine(0.3, draw.normal(size=Q.SIZE), draw.normal(size=(Q.SIZE, Q.RANK)))
    bounds, index, value = Q.features(next(pieces(pa.array(["a b c a", None, "x | y!", "É\n\nÉ"])))[1])
    for r, z in enumerate(m.raw(bounds, index, value)):
        i, x = index[bounds[r] : bounds[r + 1]], value[bounds[r] : bounds[r + 1]]
        want = 0.3 + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert math.isclose(z, want, rel_tol=1e-9)


def test_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality_scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and held(r.doc_id, 5) == 0 for r in got)
    bad = [r for r in got if r.quality == 0]
    good = [r for r in got if r.quality == 1]
    assert sum(r.predicted == 1 for r in good) / len(good) >= 0.95
    assert sum(r.score for r in bad) / max(len(bad), 1) < sum(r.score for r in good) / len(good) - 0.3


def test_classifier_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert Q.quality_scores(docs, labels).count() == docs.count()
    assert Q.quality_scores(docs.limit(0), labels).count() == 0
    none = Q.quality_scores(docs, labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert none[0] == none[1] == 0.5
    assert Q.keep_quality(docs, labels.limit(0)).columns == docs.columns


def test_query_scores_by_all_pairs(spark, docs):
    """Rows of quality_scores, long, null and repeated texts included, against the sum over all pairs of features."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    every = docs.unionByName(docs.where("doc_id < 3 OR text IS NULL")).withColumns({"label": F.lit("x"), "score": F.lit(1)})
    machine = Q.train(every, labels)
    texts = {r.doc_id: r.text for r in every.collect()}
    got = Q.quality_scores(every, labels).collect()
    assert len(got) == every.count()
    for r in got:
        _, i, x = Q.features(next(pieces(pa.array([texts[r.doc_id]], pa.string())))[1])
        z = machine.w0 + machine.w[i] @ x + sum((machine.v[i[a]] @ machine.v[i[:a]].T) @ x[:a] * x[a] for a in range(1, len(i)))
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-6)


def test_features_bound_the_fit(spark, docs, monkeypatch):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).where("doc_id < 100")
    sizes = []
    fit = Q.fit
    monkeypatch.setattr(Q, "fit", lambda b, i, v, y: sizes.append(len(i)) or fit(b, i, v, y))
    monkeypatch.setattr(Q, "MAX_FEATURES", 2_000)
    Q.train(docs, labels)
    assert 0 < sizes[0] <= 2_000


def plain_bounds(length, rows, buckets):
    """Least padding of every partition, by the plain recursion over all cuts."""
    n = len(length)
    cost = lambda i, j: sum((length[j - 1] - length[m]) * rows[m] for m in range(i, j))
    best = {0: 0}
    least = math.inf
    for _ in range(min(buckets, n)):
        best = {j: min(best[i] + cost(i, j) for i in best if i < j) for j in range(1, n + 1) if any(i < j for i in best)}
        least = min(least, best.get(n, math.inf))
    return least


def test_best_buckets_against_all_cuts():
    draw = np.random.default_rng(6)
    for n, top in [(1, 9), (2, 50), (5, 9), (8, 50), (30, 5000), (60, 20_000)]:
        length = np.sort(draw.choice(top, n, replace=False)).astype(np.int64)
        rows = draw.integers(1, 9, n)
        for k in (1, 3, 7, 70):
            bounds, padding = optimal_bounds(length, rows, k)
            assert padding == plain_bounds(length.tolist(), rows.tolist(), k) and bounds[-1] == length[-1] and len(bounds) <= k
            padded = np.array(bounds)[np.searchsorted(bounds, length)]
            assert ((padded - length) * rows).sum() == padding
    assert optimal_bounds(np.zeros(0, np.int64), np.zeros(0, np.int64), 3) == ([], 0)


def test_batches(spark, docs):
    rows = pack(docs.unionByName(docs), buckets=5, budget=2000).toPandas()
    assert len(rows) == 2 * docs.count() and (rows.length <= rows.bucket_length).all() and (rows.padding == rows.bucket_length - rows.length).all()
    length = rows.length.value_counts().sort_index()
    assert rows.padding.sum() == optimal_bounds(length.index.to_numpy(), length.to_numpy(), 5)[1]
    assert rows.bucket.nunique() <= 5 and (rows.groupby("batch").bucket.nunique() == 1).all()
    size = rows.groupby("batch").bucket_length.agg(["sum", "count"])
    assert ((size["sum"] <= 2000) | (size["count"] == 1)).all()
    assert rows.set_index("doc_id").loc[90001].length.tolist() == [0, 0]
    assert pack(docs.limit(0)).count() == 0
    clash = docs.select("doc_id", "text", F.lit("x").alias("length"), F.lit("y").alias("bucket"), F.lit(0).alias("batch"))
    assert pack(clash).columns == ["doc_id", "length", "bucket", "bucket_length", "batch", "padding"] and pack(clash).count() == docs.count()


def test_query_packs_with_the_least_padding(spark):
    from weftline.llm.queries import op6_length_buckets

    rows = op6_length_buckets(spark, SF).toPandas()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.length for r in rows.itertuples()} == words
    length = sorted(Counter(words.values()).items())
    assert rows.padding.sum() == plain_bounds([x for x, _ in length], [n for _, n in length], 16)
    assert (rows.groupby("batch").bucket_length.sum() <= 32_768).all()


def test_rows_without_an_id_are_packed_over_many_tasks(spark, monkeypatch):
    from weftline.llm import packing as P

    monkeypatch.setattr(P, "SHARD", 50)
    rows = [(None, "w " * (k % 7)) for k in range(600)] + [(5, "w")] * 300 + [(None, None)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(out) == 901 and sum(r.doc_id is None for r in out) == 601
    shards = Counter(r.batch.rsplit("-", 1)[0] for r in out)
    assert len(shards) > 9 and max(shards.values()) < 120
    assert all(sum(1 for x in out if x.batch == b) * r.bucket_length <= P.TOKEN_BUDGET for b, r in {r.batch: r for r in out}.items())
