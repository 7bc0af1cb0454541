"""Vector code compression: product codes learned from weighted distinct parts.

Each vector of integers is cut into equal parts. Equal parts of one position are counted as one weighted row; Lloyd rounds
run over these distinct rows alone, and their codes and errors are joined back to the vectors that hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import small, stage
from weftline.llm.vectors import integers, matrix, usable

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Distances held at once by a task.
_AT_ONCE = 1 << 18


def _nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry to each row of part; ties go to the lower entry."""
    code, error = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    step = max(1, _AT_ONCE // book.size)
    for at in range(0, len(part), step):
        far = ((part[at : at + step, None, :] - book[None]) ** 2).sum(axis=2)
        code[at : at + step] = best = far.argmin(axis=1)
        error[at : at + step] = far[np.arange(len(far)), best]
    return code, error


def _assigned(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, part, weight, code, error) of the distinct rows of a batch."""
    pos = batch.column("pos").to_numpy(zero_copy_only=False).astype(np.int64)
    part = matrix(batch.column("part"), books.shape[2])
    code, error = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    for p in np.unique(pos).tolist():
        own = np.flatnonzero(pos == p)
        code[own], error[own] = _nearest(part[own], books[p])
    return pos, part, batch.column("weight").to_numpy(zero_copy_only=False), code, error


def _round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one Lloyd round: weighted sums of each entry are added up over partitions; only these reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last place of each entry holds its weight
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for batch in batches:
            pos, part, weight, code, _ = _assigned(batch, books)
            np.add.at(total, (pos, code), np.column_stack([part, np.ones(len(part), np.int64)]) * weight[:, None])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "sum"])

    total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    for r in distinct.mapInArrow(sums, "at long, sum long").groupBy("at").agg(F.sum("sum").alias("sum")).collect():
        total.flat[r["at"]] = r["sum"]
    weight = total[:, :, -1:]
    return np.where(weight > 0, total[:, :, :-1] // np.maximum(weight, 1), books)


def vector_codes(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of every usable vector, and the codebooks (parts, entries, width of a part) that they refer to.

    (vec_id, label, code, error): code has the entry of each part in hex, error is the squared distance summed over parts.
    The first codebooks are the parts of the vectors with the smallest ids, null ids last, ties by vector; with fewer vectors than
    entries there are as many entries as vectors. Null vectors and those with null or non-finite components are left out. Vectors are
    filled up with zeros to the longest length and to a multiple of parts, which changes no distance between full ones. Repeated rows
    have each their code; other columns are left out; an empty table gives an empty one.
    """
    rows = vectors.where(usable(vector)).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers(vector).alias("ints"))
    rows = stage(rows, "vectors")
    width = max(1, -(-(rows.agg(F.max(F.size("ints"))).first()[0] or 0) // parts))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").select("ints").limit(entries).collect()
    books = np.zeros((parts, len(first), width), np.int64)
    for k, r in enumerate(first):
        books[:, k].flat[: len(r["ints"])] = r["ints"]

    full = F.concat("ints", F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("ints")))
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(F.col("full"), p * width + 1, width))
    held = rows.withColumn("full", full).select("rid", "vec_id", "label", F.posexplode(cut).alias("pos", "part"))
    distinct = stage(held.groupBy("pos", "part").agg(F.count("*").alias("weight")), "distinct-parts")
    for _ in range(rounds if first else 0):
        books = _round(distinct, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = _assigned(batch, books)[3:]
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), pa.array(code, pa.int32()), pa.array(error)], ["pos", "part", "entry", "error"])

    codes = stage(distinct.mapInArrow(coded, "pos int, part array<int>, entry int, error long"), "coded-parts")
    digits = max(2, len(f"{max(0, len(first) - 1):x}"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry"))), lambda x: F.lpad(F.lower(F.hex(x["entry"])), digits, "0")), "")
    out = held.join(codes, ["pos", "part"]).groupBy("rid", "vec_id", "label").agg(text.alias("code"), F.sum("error").alias("error"))
    return out.drop("rid"), books


def books_hash(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): vector_codes, with the error of all vectors of each label; null labels are one label."""
    codes, books = vector_codes(vectors)
    codes = stage(codes, "vector-codes")
    labels = stage(codes.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = codes.join(small(labels, 100_000), F.col("label").eqNullSafe(F.col("same")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))


_ASSIGN = """a{0} AS MATERIALIZED (SELECT pos, part, weight, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM
(SELECT p.pos, p.part, p.weight, b.entry, list_sum(list_transform(list_zip(p.part, b.part), lambda x : (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM dist p JOIN b{0} b ON b.pos = p.pos) GROUP BY pos, part, weight)"""
_UPDATE = """s{0} AS (SELECT pos, entry, i, CAST(floor(sum(CAST(part[i] * weight AS HUGEINT)) / sum(weight)) AS BIGINT) AS m FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM a{0}) GROUP BY pos, entry, i),
b{1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(n.part, b.part) AS part FROM b{0} b LEFT JOIN (SELECT pos, entry, list(m ORDER BY i) AS part FROM s{0} GROUP BY pos, entry) n ON n.pos = b.pos AND n.entry = b.entry)"""
CODES_SQL = f"""
WITH k AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT CAST(max(len(v)) / 16 AS BIGINT) AS w FROM k),
parts AS MATERIALIZED (SELECT rid, vec_id, label, pos, v[pos * w + 1 : pos * w + w] AS part FROM (SELECT *, unnest(range(16)) AS pos FROM k), w),
dist AS MATERIALIZED (SELECT pos, part, count(*) AS weight FROM parts GROUP BY pos, part),
b0 AS MATERIALIZED (SELECT pos, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, part FROM parts WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
{_ASSIGN.format(0)}, {_UPDATE.format(0, 1)}, {_ASSIGN.format(1)}, {_UPDATE.format(1, 2)}, {_ASSIGN.format(2)},
c AS (SELECT p.rid, p.vec_id, p.label, string_agg(lpad(format('{{:x}}', a.entry), 2, '0'), '' ORDER BY p.pos) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM parts p JOIN a2 a ON a.pos = p.pos AND a.part = p.part GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h
"""
