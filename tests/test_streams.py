"""Keyed streams: every split of the input into batches gives what one pass over the sorted events gives."""

import datetime as dt
import os
import random

import pytest

from weftline.streaming import jobs as K
from weftline.streaming import ordered as O

START = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)
SCHEMA = "id long, ts timestamp, seq long, kind string, number long"


def events(n, ids=3, kinds=("busy", "busy", "progress", "running", "completed", "failed"), seed=3):
    draw, at, out = random.Random(seed), 0, []
    for i in range(n):
        at += draw.choice([0, 1, 30, 200, 4000])
        out.append((draw.randrange(ids), START + dt.timedelta(seconds=at), i, draw.choice(kinds), draw.choice([None, None, 60])))
    return out


def written(spark, rows, path, sizes):
    """rows as files, read in the order of their times of writing."""
    at = 0
    for k, n in enumerate(sizes):
        spark.createDataFrame(rows[at : at + n], SCHEMA).coalesce(1).write.parquet(f"{path}/{k}")
        for f in os.listdir(f"{path}/{k}"):
            if f.endswith(".parquet"):
                os.rename(f"{path}/{k}/{f}", f"{path}/part-{k}.parquet")
                os.utime(f"{path}/part-{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
        at += n
    return K.table_stream(spark, str(path), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def micros(ts):
    return int((ts - START).total_seconds() * O.SECOND) + int(START.timestamp()) * O.SECOND


def plain(fold, rows, until):
    """One pass over each id's events up to until."""
    out = set()
    for key in {r[0] for r in rows}:
        state, own = fold.start(), sorted(r for r in rows if r[0] == key and micros(r[1]) <= until)
        for _, ts, seq, kind, number in sorted(own, key=lambda r: (r[1], r[2])):
            while (due := fold.deadline(state)) is not None and due < micros(ts):
                out |= {(key, *x) for x in fold.due(state)}
            out |= {(key, *x) for x in fold.row(state, micros(ts), seq, kind, number)}
        while (due := fold.deadline(state)) is not None and due <= until:
            out |= {(key, *x) for x in fold.due(state)}
    return out


@pytest.mark.parametrize("fold", [O.Deferral((60, 600), 5000), O.Silence(900), O.RunLog(), O.Throttle(600 * O.SECOND, 2)], ids=lambda f: type(f).__name__)
def test_every_split_gives_the_same(spark, tmp_path, fold):
    rows = events(60)
    until = micros(max(r[1] for r in rows)) - 7200 * O.SECOND
    want = plain(fold, rows, until)
    assert len(want) > 5
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=random.Random(r[2]).randrange(7000)))
    for k, (order, sizes) in enumerate([(rows, [60]), (late, [20, 1, 25, 14])]):
        path = tmp_path / str(k)
        got = [tuple(r) for r in K.run_once(O.in_order(written(spark, order, path, sizes), fold, "2 hours")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_one_busy_job_in_any_order(spark, tmp_path):
    actions = ["claim", *("pause", "resume", "claim") * 1000]
    rows = [(1, START + dt.timedelta(seconds=i), i, a, None) for i, a in enumerate(actions)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        stream = written(spark, rows[::-1], tmp_path / "a", [1000, 2001])
        out = K.latest(K.run_once(O.in_order(stream, O.Machine(), "2 hours", provisional=True), mode="update"), "id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in out] == [(1, "in_progress", 3001, 0)]


def test_settings_are_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError), O.settings(spark, O.ROCKS):
        assert spark.conf.get(key) != before
        raise RuntimeError
    assert spark.conf.get(key) == before


def test_results_follow_a_plain_reading():
    at = lambda s: micros(START) + s * O.SECOND
    ts = lambda s: START + dt.timedelta(seconds=s)
    spell = [(1, ts(0), 1, "busy", None), (1, ts(30), 2, "busy", 10), (1, ts(40), 3, "busy", None), (1, ts(700), 4, "progress", None), (1, ts(705), 5, "busy", None), (1, ts(10_000), 6, "busy", None), (1, ts(10_001), 7, "busy", None)]
    assert plain(O.Deferral((60, 600), 5000), spell, at(20_000)) == {
        (1, at(0), "deferred", 1, at(60)), (1, at(30), "deferred", 2, at(40)), (1, at(40), "deferred", 3, at(640)), (1, at(640), "woken", 3, None),
        (1, at(705), "deferred", 1, at(765)), (1, at(765), "woken", 1, None), (1, at(10_000), "paused", 1, None),
    }
    assert plain(O.Silence(100), spell, at(800)) == {(1, at(40), at(140))}
    runs = [(1, ts(0), 1, "failed", None), (1, ts(1), 2, "running", None), (1, ts(2), 3, "running", None), (1, ts(3), 4, "completed", None), (1, ts(4), 5, "running", None)]
    assert plain(O.RunLog(), runs, at(9)) == {(1, 2, "interrupted", at(1), at(2)), (1, 3, "completed", at(2), at(3))}


def test_a_burst_and_then_an_even_flow():
    at = lambda s: micros(START) + s * O.SECOND
    asked = [(1, START + dt.timedelta(seconds=s), i, "x", None) for i, s in enumerate([0, 0, 0, 5, 100, 100])]
    got = sorted((seq, (granted - at(0)) // O.SECOND) for _, seq, _, granted in plain(O.Throttle(10 * O.SECOND, 2), asked, at(999)))
    assert got == [(0, 0), (1, 0), (2, 10), (3, 20), (4, 100), (5, 100)]


def test_keys_share_the_entries_of_the_store(spark, tmp_path):
    rows = [(None if r[0] == 4 else r[0] + 2**60, *r[1:]) for r in events(60, ids=9)]
    until = micros(max(r[1] for r in rows)) - 7200 * O.SECOND
    want = plain(O.Deferral((60, 600), 5000), rows, until)
    frame = O.in_order(written(spark, rows, tmp_path, [20, 1, 39]), O.Deferral((60, 600), 5000), "2 hours", entries=2)
    got = [tuple(r) for r in K.run_once(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {r[0] for r in got} >= {None, 2**60}
