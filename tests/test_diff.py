"""Differences against what they were made from."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from weftline.operators import diff as D
from weftline.streaming import jobs as K


def edited(draw, lines):
    out = []
    for x in lines:
        r = draw.random()
        out += [] if r < 0.15 else [x, draw.choice(["", "same", f"new {draw.random()}"])] if r < 0.3 else [x]
    if draw.random() < 0.3 and len(out) > 4:
        k = draw.randrange(len(out))
        out = out[k:] + out[:k]
    return out


def test_hunks_rebuild_the_second_version(spark):
    draw, rows = random.Random(5), []
    for i in range(80):
        old = [draw.choice([f"l{k}", "same", ""]) for k in range(draw.randrange(0, 40))]
        rows.append((i, "\n".join(old), "\n".join(edited(draw, old))))
    rows += [(100, None, "a\nb"), (101, "a\nb", None), (102, None, None), (103, "", ""), (104, "a", "a"), (None, "a\nb\nc", "a\nx\nc"), (105, "a\n\n", "\na\n")]
    df = spark.createDataFrame(rows, "id long, old string, new string").repartition(3)
    got = D.line_hunks(df).select("id", "old", "new", "hunks", D.rebuilt(F.col("old"), F.col("hunks")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.back == ([] if r.new is None else r.new.split("\n")), r.id
        for h in r.hunks:
            assert (h.removed or h.added) and (not h.removed or not h.added or (h.removed[0] != h.added[0] and h.removed[-1] != h.added[-1]))
    hunks = {r.id: r.hunks for r in got}
    assert hunks[104] == hunks[103] == [] and [tuple(h) for h in hunks[None]] == [(1, ["b"], ["x"])]


def test_a_moved_block_is_one_removal_and_one_addition(spark):
    lines = [f"line {i}" for i in range(20)]
    moved = lines[:3] + lines[6:15] + lines[3:6] + lines[15:]
    df = spark.createDataFrame([(1, "\n".join(lines), "\n".join(moved))], "id long, old string, new string")
    assert [tuple(h) for h in D.line_hunks(df).first().hunks] == [(3, lines[3:6], []), (15, [], lines[3:6])]


def test_rising_runs():
    draw = random.Random(1)
    for _ in range(200):
        b = draw.sample(range(30), draw.randrange(0, 9))
        best = max((len(s) for s in ([b[i] for i in range(len(b)) if m >> i & 1] for m in range(1 << len(b))) if s == sorted(s)), default=0)
        run = D.rising(list(enumerate(b)))
        assert len(run) == best and [y for _, y in run] == sorted(y for _, y in run) and [x for x, _ in run] == sorted(x for x, _ in run)


def test_blocks_of_tokens():
    draw = random.Random(2)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(0, 25))] for _ in range(2))
        covered = lambda found: {(x + k, y + k) for x, y, n in found for k in range(n)}
        assert covered(D.blocks(a, b)) == covered(SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks())


def test_changes_of_rows(spark):
    schema = "id long, status string, n int"
    before = spark.createDataFrame([(1, "pending", 1), (2, "failed", None), (3, None, 3), (4, "x", 4), (None, "x", 1)], schema)
    after = spark.createDataFrame([(1, "completed", 1), (2, "failed", None), (3, None, None), (5, "in_progress", 0)], schema)
    changes = D.row_changes(before, after, "id")
    assert {(r.id, r.change) for r in changes.collect()} == {(1, "update"), (3, "update"), (4, "delete"), (5, "insert")}
    assert {r.message for r in D.announcements(changes, "id").collect()} == {'{"type":"job_completed","job":1,"was":"pending","is":"completed"}', '{"type":"job_updated","job":3}', '{"type":"job_deleted","job":4,"was":"x"}', '{"type":"job_started","job":5,"is":"in_progress"}'}
    assert D.row_changes(before, before, "id").count() == 0


def test_an_outbox_takes_a_batch_once(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    for batch, new in ((0, rows(1, 2)), (1, rows(3)), (0, rows(1, 2))):
        K.to_outbox(new, f"file://{tmp_path}/o", batch)
    assert sorted(map(tuple, K.outbox(spark, f"file://{tmp_path}/o", "id long").collect())) == [(1, 0), (2, 0), (3, 1)]
