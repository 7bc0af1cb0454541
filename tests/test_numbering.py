"""Running totals and numbers over ranges, skewed and null keys included."""

import random

from pyspark.sql import functions as F

from weftline.operators.events import percentiles
from weftline.operators.numbering import numbered, running


def rows(n=3000):
    draw = random.Random(2)
    return [(draw.choice([None, "a", "a", "a", "b", "c"]), draw.choice([None, *range(50)]), i, draw.randrange(-5, 9)) for i in range(n)]


def test_running_totals_span_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        have = rows()
        df = spark.createDataFrame(have, "k string, v int, i long, n int").repartition(5)
        got = {(r.i): (r.sum, r.place) for r in running(df, ["k"], ["v", "i"], {"sum": F.col("n"), "place": F.lit(1)}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = {}
    for k, _, i, n in sorted(have, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        total, place = seen.get(k, (0, 0))
        seen[k] = (total + n, place + 1)
        assert got[i] == seen[k]
    assert len(got) == len(have)


def test_numbers_without_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(4)
    assert sorted((r.n, r.x) for r in numbered(df, [F.desc("x")], "n", after=41).collect()) == [(42 + i, 999 - i) for i in range(1000)]
    assert numbered(df.limit(0), ["x"], "n").collect() == []


def test_percentiles_of_any_key(spark):
    have = [(k, v) for k, v, _, _ in rows() if v is not None]
    df = spark.createDataFrame(have, "k string, v int")
    for keys, groups in ((["k"], {k for k, _ in have}), ([], {0})):
        got = {r.k if keys else 0: r for r in percentiles(df, keys, "v").collect()}
        for g in groups:
            own = sorted(v for k, v in have if not keys or k == g)
            at = lambda p, own=own: own[min(len(own) * p // 100, len(own) - 1)]
            assert (got[g].p50, got[g].p95, got[g].p99, got[g].n, got[g].least, got[g].most) == (at(50), at(95), at(99), len(own), own[0], own[-1])
