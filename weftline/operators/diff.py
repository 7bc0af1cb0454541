"""Differences of two versions: by lines, by tokens, and by rows of two snapshots."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import let


def rising(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by ascending first numbers, whose second numbers rise too."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        before.append(at[k - 1] if k else -1)
        tops[k : k + 1], at[k : k + 1] = [b], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _rising_of() -> Column:
    @F.pandas_udf("array<struct<a:int,b:int>>")
    def chain(anchors: pd.Series) -> pd.Series:
        return anchors.map(lambda x: [{"a": a, "b": b} for a, b in rising([(p["a"], p["b"]) for p in x])])

    return chain


def line_hunks(versions: DataFrame) -> DataFrame:
    """(id, old, new, hunks) of versions (id, old, new: texts): hunks turn the lines of old into those of new.

    A hunk has at (lines of old before it), removed and added (arrays of lines). Lines that occur once on either side are anchors, of which the longest run in
    the order of both stays; what stands between two anchors is a hunk, without the lines that both sides begin or end with there. A null version has
    no line; ids tell rows apart; an empty line is a line.
    """
    lines = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.split(c, "\n"))
    rows = versions.select("id", "old", "new", lines("old").alias("_a"), lines("new").alias("_b"))
    side = lambda c, k: rows.select("id", F.posexplode(c).alias("n", "line"), F.lit(k).alias("side")).select("id", "n", F.xxhash64("line").alias("line"), "side")
    once = side("_a", 0).unionByName(side("_b", 1)).groupBy("id", "line").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"), F.max(F.when(F.col("side") == 0, F.col("n"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("b"))
    # a list is one document's lines
    anchors = once.where("na = 1 AND nb = 1").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("anchors"))
    kept = anchors.select(F.col("id").alias("_id"), _rising_of()("anchors").alias("chain"))
    point = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    chained = rows.join(kept, F.col("id").eqNullSafe(F.col("_id")), "left")
    ends = F.concat(F.array(point(F.lit(-1), F.lit(-1))), F.coalesce("chain", F.array().cast("array<struct<a:int,b:int>>")), F.array(point(F.size("_a"), F.size("_b"))))
    chained = chained.select("id", "old", "new", "_a", "_b", ends.alias("ends"))

    def hunk(p: Column, q: Column) -> Column:
        old, new = F.slice("_a", p["a"] + 2, q["a"] - p["a"] - 1), F.slice("_b", p["b"] + 2, q["b"] - p["b"] - 1)
        same = lambda x, y: F.coalesce(F.array_position(F.zip_with(x, y, lambda s, t: F.coalesce(s != t, F.lit(True))), True), F.lit(0)).cast("int")
        common = lambda x, y: let(same(x, y), lambda k: F.when(k == 0, F.size(x)).otherwise(k - 1))

        def trimmed(v: Column) -> Column:
            rest = F.struct(F.slice(v["x"], v["k"] + 1, F.size(v["x"]) - v["k"]).alias("x"), F.slice(v["y"], v["k"] + 1, F.size(v["y"]) - v["k"]).alias("y"))
            tail = lambda r: let(common(F.reverse(r["x"]), F.reverse(r["y"])), lambda k: F.struct((p["a"] + 1 + v["k"]).alias("at"), F.slice(r["x"], F.lit(1), F.size(r["x"]) - k).alias("removed"), F.slice(r["y"], F.lit(1), F.size(r["y"]) - k).alias("added")))
            return let(rest, tail)

        return let(F.struct(old.alias("x"), new.alias("y"), common(old, new).alias("k")), trimmed)

    pairs = F.filter(F.transform("ends", lambda p, i: F.struct(p.alias("p"), F.get("ends", i + 1).alias("q"))), lambda z: z["q"].isNotNull())
    hunks = F.filter(F.transform(pairs, lambda z: hunk(z["p"], z["q"])), lambda h: (F.size(h["removed"]) > 0) | (F.size(h["added"]) > 0))
    return chained.select("id", "old", "new", hunks.alias("hunks"))


def rebuilt(old: Column, hunks: Column) -> Column:
    """The lines of old with hunks applied, as an array."""
    lines = F.when(old.isNull(), F.array().cast("array<string>")).otherwise(F.split(old, "\n"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    put = lambda s, h: F.struct((h["at"] + F.size(h["removed"])).alias("at"), F.concat(s["out"], F.slice(lines, s["at"] + 1, h["at"] - s["at"]), h["added"]).alias("out"))
    return F.aggregate(hunks, start, put, lambda s: F.concat(s["out"], F.slice(lines, s["at"] + 1, F.size(lines) - s["at"])))


def blocks(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of common blocks: the longest one (the first in a, then in b), and those on both sides of it in turn."""
    places = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    out, waiting = [], [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        best, run = (0, 0, 0), {}
        for i in range(a0, a1):
            now = {}
            for j in places.get(a[i], ()):
                if b0 <= j < b1:
                    n = now[j] = run.get(j - 1, 0) + 1
                    if n > best[2]:
                        best = (i - n + 1, j - n + 1, n)
            run = now
        i, j, n = best
        if n:
            out.append(best)
            waiting += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return sorted(out)


def replaced_phrases():
    """pandas UDF: phrases that differ between two token lists, by longest matching blocks; null lists differ in nothing."""

    def one(a, b):
        if a is None or b is None:
            return []
        a, b, out, i, j = list(a), list(b), [], 0, 0
        for x, y, n in [*blocks(a, b), (len(a), len(b), 0)]:
            if i < x or j < y:
                out.append({"old": " ".join(a[i:x]), "new": " ".join(b[j:y])})
            i, j = x + n, y + n
        return out

    @F.pandas_udf("array<struct<old:string,new:string>>")
    def phrases(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])

    return phrases


def row_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, before, after) of two snapshots with the same columns and one row a key: insert, update and delete with both images.

    Nulls are values like others; rows that are equal in all columns are no change; rows without key are left out.
    """
    names = [c for c in before.columns if c != key]
    image = lambda df, name: df.where(F.col(key).isNotNull()).select(F.col(key), F.struct(*names).alias(name))
    both = image(before, "before").join(image(after, "after"), key, "full_outer")
    change = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, change.alias("change"), "before", "after")


#: How a change to a state is announced.
ANNOUNCED = {"completed": "job_completed", "failed": "job_failed", "in_progress": "job_started"}


def announcements(changes: DataFrame, key: str, status: str = "status") -> DataFrame:
    """(key, message) of row_changes: a JSON message of the kind that the new state tells, with the state before and after."""
    kind = F.when(F.col("change") == "delete", "job_deleted").otherwise(F.lit("job_updated"))
    for state, name in ANNOUNCED.items():
        kind = F.when((F.col("change") != "delete") & (F.col(f"after.{status}") == state), name).otherwise(kind)
    fields = F.struct(kind.alias("type"), F.col(key).alias("job"), F.col(f"before.{status}").alias("was"), F.col(f"after.{status}").alias("is"))
    return changes.select(key, F.to_json(fields).alias("message"))
