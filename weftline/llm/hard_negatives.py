"""Hard negatives by a full score sort for each anchor.

Anchors are the query set; they go block by block against all rows. A task scores its rows against every anchor of the block, sorts
each anchor's different-label scores (ties by id), finds each positive's upper limit by binary search and reads the first entries
above its lower limit. What the partitions found is merged, so neither a task nor the driver ever holds the rows of an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import stage
from weftline.llm.vectors import integers, matrix, usable

#: Anchors scored in one pass over the rows, and their components: both bound what is sent to the tasks.
ANCHORS, COMPONENTS = 16_384, 4 << 20
#: Scores held at once by a task.
_AT_ONCE = 1 << 21
_WORST, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class _Block:
    """The anchors of one pass."""

    def __init__(self, rows: list):
        self.width = max((len(r["ints"]) for r in rows), default=0)
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.vectors = np.zeros((len(rows), self.width), np.int64)
        for k, r in enumerate(rows):
            self.vectors[k, : len(r["ints"])] = r["ints"]

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, scores, ids, labels) of some anchors and the rows of a batch, rows by ascending id."""
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "label"))
            order = np.argsort(ids, kind="stable")
            ids, labels = ids[order], labels[order]
            longest = int(np.diff(batch.column("ints").offsets.to_numpy()).max(initial=0))
            rows = matrix(batch.column("ints"), max(longest, self.width))[order, : self.width]
            exact = float(np.abs(rows).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * self.width < 2**53
            step = max(1, _AT_ONCE // max(1, len(ids)))
            for at in range(0, len(self.ids), step):
                own = self.vectors[at : at + step]
                scores = (own.astype(float) @ rows.T.astype(float)).astype(np.int64) if exact else own @ rows.T
                yield np.arange(at, at + len(own)), scores, ids, labels


def _kept(best: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k (score, id) of those found, by descending score and ascending id."""
    scores, ids = (np.concatenate(x) for x in zip(*best, strict=True))
    first = np.lexsort((ids, -scores))[:k]
    return scores[first], ids[first]


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each group by score and id, numbered; each map task sends k of a group at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, block: _Block, k: int) -> DataFrame:
    """(anchor, vec_id, score, rank) of the first k same-label rows of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for anchors, scores, ids, labels in block.scored(batches):
            for label in np.unique(block.labels[anchors]).tolist():
                same = np.flatnonzero(labels == label)
                for a in anchors[block.labels[anchors] == label].tolist():
                    own = same[ids[same] != block.ids[a]]
                    s = scores[a - anchors[0], own]
                    top = np.argsort(-s, kind="stable")[:k]
                    if len(top):
                        best[a] = _kept([*filter(None, [best.get(a)]), (s[top], ids[own][top])], k)
        yield _batch([(a, s, i) for a, (ss, ii) in best.items() for s, i in zip(ss.tolist(), ii.tolist(), strict=True)], ("anchor", "score", "vec_id"))

    return _first(rows.mapInArrow(run, "anchor long, score long, vec_id long"), ["anchor"], k)


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names))


def _negatives(rows: DataFrame, block: _Block, positives: dict[int, list], k: int, low: int, high: int) -> DataFrame:
    """(anchor, place, vec_id, score, rank): the first k different-label rows within the limits of each positive (score, id)."""
    limits = {a: (np.array([high * s // 100 for s, _ in found]), np.array([-(-low * s // 100) for s, _ in found])) for a, found in positives.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for anchors, scores, ids, labels in block.scored(batches):
            for a in anchors.tolist():
                if a not in limits:
                    continue
                others = np.flatnonzero((labels != block.labels[a]) & (ids != block.ids[a]))
                down = -scores[a - anchors[0], others]
                order = np.argsort(down, kind="stable")
                down, named = down[order], ids[others[order]]
                upper, lower = limits[a]
                heads = np.searchsorted(down, -upper, side="left")
                tails = np.minimum(np.searchsorted(down, -lower, side="right"), heads + k)
                for place in np.flatnonzero(tails > heads).tolist():
                    own = slice(heads[place], tails[place])
                    best[a, place] = _kept([*filter(None, [best.get((a, place))]), (-down[own], named[own])], k)
        yield _batch([(a, p, s, i) for (a, p), (ss, ii) in best.items() for s, i in zip(ss.tolist(), ii.tolist(), strict=True)], ("anchor", "place", "score", "vec_id"))

    return _first(rows.mapInArrow(run, "anchor long, place long, score long, vec_id long"), ["anchor", "place"], k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its first same-label rows.

    Scores are inner products of the integer vectors; negatives have low to high hundredths of the positive's score, both ends
    included, so a positive with a negative score has none. Higher scores come first, ties by the smaller id.
    Rows with a null vector, label or vec_id, or a null or non-finite component take no part; a shorter vector counts as filled up
    with zeros. An anchor's own id is never its positive or negative. Rows that repeat an id are candidates each; repeated anchors are answered once.
    Other columns are left out; an empty table, or one without anchors, gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(usable(vector), integers(vector)).alias("ints"), is_anchor.alias("is_anchor")).dropna(subset=["vec_id", "label", "ints"])
    rows = stage(rows, "integer-vectors")
    anchors = rows.where("is_anchor").select("vec_id", "label", "ints").distinct()
    anchors = stage(anchors.withColumn("deal", F.xxhash64("vec_id", "label", "ints")), "anchors")
    count, width = anchors.agg(F.count("*"), F.max(F.size("ints"))).first()
    blocks = max(1, -(-count // ANCHORS), -(-count * (width or 0) // COMPONENTS))
    rows, out = rows.drop("is_anchor"), []
    for b in range(blocks if count else 0):
        block = _Block(anchors.where(F.pmod("deal", F.lit(blocks)) == b).collect())
        found: dict[int, list] = {}
        for r in sorted(_positives(rows, block, positives).select("anchor", "rank", "score", "vec_id").collect()):
            found.setdefault(r["anchor"], []).append((r["score"], r["vec_id"]))
        near = stage(_negatives(rows, block, found, negatives, low, high), f"negatives-{b}")
        named = [(a, p, int(block.ids[a]), i, s) for a, own in found.items() for p, (s, i) in enumerate(own)]
        # as many rows as the block has anchors, times the positives
        names = F.broadcast(spark.createDataFrame(named, "anchor long, place long, anchor_id long, positive_id long, positive_score long"))
        out.append(near.join(names, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def mined(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100; each seventh id has a wrong label, as in noisy data."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x : floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
