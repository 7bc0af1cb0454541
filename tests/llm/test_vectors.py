import hashlib
import math

import duckdb
import numpy as np
import pytest
from compare import differences
from pyspark.sql import functions as F

from weftline.llm import hard_negatives as N
from weftline.llm import vector_codes as V

INF, NAN = math.inf, math.nan


def whole(rows):
    return [(i, [math.floor(256 * x) for x in v], n) for i, v, n in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, rid int").repartition(3)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    # few distinct parts, so that parts repeat and distances tie; a third of all rows is one vector
    rows = [(i, (draw.integers(-3, 4, 32) / 64).tolist(), int(draw.integers(0, 4))) for i in range(400)]
    rows = [(i, rows[3][1] if i % 3 == 0 else v, n if i % 11 else None) for i, v, n in rows]
    odd = [(900, None, 1), (901, [None] * 32, 1), (902, [INF] + [0.0] * 31, 1), (903, [NAN] * 32, 1), (904, [0.0] * 32, 1), (905, [], 2), (906, [0.5], 2), (907, [1e30] + [0.0] * 31, 3), (-100, rows[7][1], 2)]
    return rows + odd + rows[100:102]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = whole(rows)
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    full = [(i, np.array([max(-V_LIMIT, min(V_LIMIT, x)) for x in v] + [0] * (parts * width - len(v))).reshape(parts, width), n) for i, v, n in kept]
    first = sorted(full, key=lambda r: (r[0] is None, r[0] or 0, r[1].ravel().tolist()))[:entries]
    books = np.array([[v[p] for _, v, _ in first] for p in range(parts)])
    nearest = lambda p, x: min(((int(((x - e) ** 2).sum()), k) for k, e in enumerate(books[p])))
    for _ in range(rounds):
        held = [[nearest(p, v[p])[1] for _, v, _ in full] for p in range(parts)]
        for p in range(parts):
            for k in set(held[p]):
                own = [v[p] for (_, v, _), h in zip(full, held[p], strict=True) if h == k]
                books[p][k] = np.sum(own, axis=0) // len(own)
    out = []
    for i, v, n in full:
        best = [nearest(p, v[p]) for p in range(parts)]
        out.append((i, n, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, books


V_LIMIT = 1 << 28


def test_codes_as_by_plain_lloyd(spark, rows):
    want, books = plain_codes(rows)
    errors = {}
    for _, n, _, d in want:
        errors[n] = errors.get(n, 0) + d
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    got = [tuple(r) for r in V.compressed(frame(spark, rows)).collect()]
    assert sorted(got) == sorted((i, c, d, errors[n], digest) for i, n, c, d in want)
    assert any(i == 905 for i, *_ in got) and sum(i == 100 for i, *_ in got) == 2, "an empty vector has a code, and so has each repeated row"


def test_few_vectors_and_none(spark):
    few = [(None, [0.25, 0.5], 1), (3, [0.25, 0.5], None), (2, [1.0, -0.001], None)]
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in V.compressed(frame(spark, few)).collect()}
    codes, _ = plain_codes(few)
    errors = {1: 0, None: sum(d for i, n, c, d in codes if n is None)}
    assert got == {(i, c, d, errors[n]) for i, n, c, d in codes}
    assert V.compressed(frame(spark, [])).collect() == []
    assert V.compressed(frame(spark, [(1, None, 1)])).collect() == []


def plain_negatives(rows, positives=5, negatives=5):
    kept = [(i, v, n) for i, v, n in whole(rows) if i is not None and n is not None]
    kept = [(i, [max(-V_LIMIT, min(V_LIMIT, x)) for x in v], (n + 1) % 10 if i % 7 == 0 else n) for i, v, n in kept]
    out = set()
    for a, va, na in kept:
        if a % 100:
            continue
        others = sorted((-sum(x * y for x, y in zip(va, v, strict=False)), i, n) for i, v, n in kept if i != a)
        for s, p, _ in [x for x in others if x[2] == na][:positives]:
            near = [x for x in others if x[2] != na and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(near)}
    return out


@pytest.mark.parametrize("anchors", [16_384, 2])
def test_negatives_as_by_plain_sort(spark, rows, anchors, monkeypatch):
    monkeypatch.setattr(N, "ANCHORS", anchors)
    monkeypatch.setattr(N, "_AT_ONCE", 300)
    more = [(None, [0.1] * 32, 1), (1000, [-0.5] * 32, 1), (1001, [-0.25] * 32, 1), (1100, [0.3] * 40, 3)]
    got = [tuple(r) for r in N.mined(frame(spark, rows + more)).collect()]
    want = plain_negatives(rows + more)
    assert len(want) > 60 and len(got) == len(set(got)) and set(got) == want


def test_no_anchors(spark):
    assert N.mined(frame(spark, [])).collect() == []
    assert N.mined(frame(spark, [(1, [0.5], 1), (200, [0.5], None), (300, [0.5, 0.1], 1)])).collect() == []


def test_sql_of_both(spark, rows, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    draw = np.random.default_rng(2)
    vectors = [(i, draw.normal(0, 0.1, 64).tolist(), int(i % 10) if i % 13 else None) for i in range(500)]
    spark.createDataFrame(vectors + [(1000, None, 1), (1007, [NAN] * 64, 2)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    df, con = spark.read.parquet(path), duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    assert differences(V.compressed(df), con, V.CODES_SQL) == ""
    assert differences(N.mined(df), con, N.NEGATIVES_SQL) == ""
    assert df.where(F.col("vec_id") % 100 == 0).count() == 6
