"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), in time linear in the features.
It is fitted on a bounded sample of labelled rows; scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, crc_mod, stage
from weftline.llm.words import U64, Words, pieces

#: Labelled rows that the fit uses at most, and their features together: rows of the least hash.
MAX_TRAIN, MAX_FEATURES = 6_000, 5_000_000
WORD_BUCKETS, RANK = 1 << 13, 8
STATS = ("words", "word_length", "symbols", "capitals", "digits", "marks", "bars", "shouts", "beyond_ascii", "lines", "line_words", "repeated_lines", "distinct_words", "top_word", "same_as_before", "length")
SIZE = WORD_BUCKETS + len(STATS)
THRESHOLD = 0.3
_IS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"symbols": b"#*$%&<>~^\\@_=+", "capitals": bytes(range(65, 91)), "digits": b"0123456789", "marks": b".,;:?'\"()-", "bars": b"|", "shouts": b"!", "breaks": b"\n"}.items()}


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, indexes, values) of the sparse rows of these texts."""
    words = Words(texts)
    raw = Words(texts, fold=False, hashes=False).bytes
    rows, n = words.rows, np.diff(words.bounds).astype(float)
    size = np.maximum(np.diff(words.offs), 1).astype(float)
    share = {name: np.diff(np.concatenate([[0], np.cumsum(of[raw])])[words.offs]) for name, of in _IS.items()}
    beyond = np.diff(np.concatenate([[0], np.cumsum(raw >= 0xC3)])[words.offs])
    word_bytes = np.bincount(words.row, words.end - words.start, rows)

    bucket = (words.hash % U64(WORD_BUCKETS)).astype(np.int64)
    key, count = np.unique(words.row * WORD_BUCKETS + bucket, return_counts=True)
    row, index = key // WORD_BUCKETS, key % WORD_BUCKETS
    value = np.log1p(count)
    norm = np.sqrt(np.maximum(np.bincount(row, value * value, rows), 1e-9))
    value = value / norm[row]

    top, distinct = np.zeros(rows), np.bincount(row, minlength=rows)
    np.maximum.at(top, row, count)
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    lines = share["breaks"] + 1.0
    line = np.searchsorted(np.flatnonzero(_IS["breaks"][raw]), words.start) + words.row
    line_hash = np.add.reduceat(words.hash * (np.arange(len(words.hash), dtype=U64) * U64(0) + U64(1)), np.flatnonzero(np.diff(line, prepend=-1))) if len(line) else np.zeros(0, U64)
    line_row = words.row[np.flatnonzero(np.diff(line, prepend=-1))] if len(line) else np.zeros(0, np.int64)
    order = np.lexsort((line_hash, line_row))
    again = np.zeros(len(order), bool)
    again[1:] = (line_hash[order][1:] == line_hash[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    repeated = np.bincount(line_row[order][again], minlength=rows)
    some = np.maximum(n, 1)
    dense = np.stack([
        np.log1p(n) / 8, word_bytes / some / 10, share["symbols"] / size * 10, share["capitals"] / size * 3, share["digits"] / size * 5, share["marks"] / size * 10,
        share["bars"] / size * 20, share["shouts"] / size * 20, beyond / size * 5, np.log1p(lines) / 4, np.log1p(n / lines) / 5, repeated / lines,
        distinct / some, top / some, np.bincount(words.row[same], minlength=rows) / some, np.log1p(np.diff(words.offs)) / 10,
    ], axis=1)
    dense = np.clip(dense, 0, 3)
    index = np.concatenate([index, np.tile(WORD_BUCKETS + np.arange(len(STATS)), rows)])
    value = np.concatenate([value, dense.ravel()])
    row = np.concatenate([row, np.repeat(np.arange(rows), len(STATS))])
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(rows + 1)), index[order], value[order]


class Machine:
    """w0, w (SIZE) and v (SIZE x RANK)."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        rows = len(bounds) - 1
        row = np.repeat(np.arange(rows), np.diff(bounds))
        out = self.w0 + np.bincount(row, self.w[index] * value, rows)
        for f in range(self.v.shape[1]):
            x = self.v[index, f] * value
            out += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
        return out


def fit(bounds: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4) -> Machine:
    """Adam on the logistic loss over mini-batches; the order and the start are fixed by a seed."""
    draw = np.random.default_rng(7)
    w0, w, v = 0.0, np.zeros(SIZE), draw.normal(0, 0.02 if len(label) else 0, (SIZE, RANK))
    m0 = s0 = 0.0
    mw, sw, mv, sv = np.zeros(SIZE), np.zeros(SIZE), np.zeros((SIZE, RANK)), np.zeros((SIZE, RANK))
    rows, step = len(label), 0
    for _ in range(epochs if rows else 0):
        order = draw.permutation(rows)
        for at in range(0, rows, batch):
            pick = order[at : at + batch]
            take = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in pick])
            row = np.repeat(np.arange(len(pick)), bounds[pick + 1] - bounds[pick])
            i, x = index[take], value[take]
            vx = v[i] * x[:, None]
            total = np.zeros((len(pick), RANK))
            np.add.at(total, row, vx)
            square = np.bincount(row, (vx * vx).sum(1), len(pick))
            z = w0 + np.bincount(row, w[i] * x, len(pick)) + 0.5 * ((total**2).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick]) / len(pick)
            used, back = np.unique(i, return_inverse=True)
            gw = np.bincount(back, g[row] * x, len(used)) + decay * w[used]
            gv = np.zeros((len(used), RANK))
            np.add.at(gv, back, (g[row] * x)[:, None] * (total[row] - vx))
            gv += decay * v[used]
            step += 1
            m0, s0 = 0.9 * m0 + 0.1 * g.sum(), 0.999 * s0 + 0.001 * g.sum() ** 2
            lift = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            w0 -= lift * m0 / (np.sqrt(s0) + 1e-8)
            for p, m, s, d in ((w, mw, sw, gw), (v, mv, sv, gv)):
                m[used] = 0.9 * m[used] + 0.1 * d
                s[used] = 0.999 * s[used] + 0.001 * d * d
                p[used] -= lift * m[used] / (np.sqrt(s[used]) + 1e-8)
    return Machine(w0, w, v)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in pieces(batch.column("text")):
            bounds, index, value = features(texts)
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, t)) for x, t in ((index, pa.int32()), (value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), batch.column("label").slice(at, len(texts)), *lists], ["doc_id", "label", "index", "value"])


def _scores(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column("text")):
                z = machine.value.raw(*features(texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Machine:
    """Fit on at most max_rows labelled documents, those of the least hash whose crc32(doc_id) mod 5 is not 0.

    Of these only as many as have MAX_FEATURES features together. Rows without doc_id or quality are left out; of repeated
    labels the least counts, repeated rows each count. Without any labelled row all scores are 0.5.
    """
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(crc_mod(F.col("doc_id"), 5) != 0)
    named = named.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = bounded_batches(docs).select("doc_id", "text").join(F.broadcast(named), "doc_id")  # max_rows pairs of numbers
    rows = stage(sample.mapInArrow(_rows, "doc_id long, label int, index array<int>, value array<float>").withColumn("order", F.xxhash64("doc_id")), "features")
    size = rows.select("order", F.size("index").alias("n")).toPandas().sort_values("order")
    within = size["order"][size["n"].cumsum() <= MAX_FEATURES]
    rows = rows.where(F.col("order") <= int(within.max()) if len(within) else F.lit(False)).toPandas().sort_values(["doc_id", "label"], kind="stable")
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows["index"]])]).astype(np.int64)
    flat = lambda c, t: np.concatenate([np.asarray(x, t) for x in rows[c]]) if len(rows) else np.zeros(0, t)
    return fit(bounds, flat("index", np.int64), flat("value", np.float64), rows["label"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    A null or empty text has a score too; repeated rows are scored as often as they come; other columns are left
    out; an empty table gives an empty one. held_out: crc32 of the doc_id as text is divisible by 5 (such labels are
    never used; a null doc_id is not held out). predicted is 1 for a score of THRESHOLD or more.
    """
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(machine), "doc_id long, score double")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that the classifier predicts as 1, scored in place: texts are not shuffled.

    Null and empty texts have a score too; repeated rows all stay or go; other columns pass through; an empty table gives
    an empty one.
    """
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [machine.value.raw(*features(texts)) for _, texts in pieces(batch.column("text"))]
            z = np.concatenate(keep) if keep else np.zeros(0)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
