"""Packing into optimal length buckets.

Dynamic programming over the global histogram of all distinct lengths chooses the bucket boundaries with the least
padding; batches within a token budget form inside each bucket. A histogram has a row for each distinct length: at most
the square root of twice all tokens together, and in practice as many as the longest documents have words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import stage

N_BUCKETS, TOKEN_BUDGET = 16, 32_768
#: Rows in a shard of a bucket; batches are numbered inside a shard, so no bucket meets in one task.
SHARD = 50_000


def word_count(text: Column) -> Column:
    """Words (runs other than space, tab and line breaks) of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def optimal_bounds(length: np.ndarray, rows: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """(bucket bounds, padding): the partition of ascending lengths into at most that many buckets with the least padding.

    A bucket pads each of its rows to its longest length. Of equal partitions, the one with fewer buckets wins. The best
    last cut never moves back as the end moves on, so each layer halves: the cut of a middle end bounds those on both sides.
    """
    n = len(length)
    if not n:
        return [], 0
    cum_rows = np.concatenate([[0], np.cumsum(rows)])
    cum_total = np.concatenate([[0], np.cumsum(length * rows)])
    best, cuts, ends = np.full(n + 1, np.inf), [], []
    best[0] = 0
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        spans = [(1, n, 0, n - 1)]
        while spans:
            low, high, first, last = spans.pop()
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + length[j - 1] * (cum_rows[j] - cum_rows[i]) - (cum_total[j] - cum_total[i])
            cut[j] = i[int(np.argmin(cost))]
            now[j] = cost.min()
            if low < j:
                spans.append((low, j - 1, first, int(cut[j])))
            if j < high:
                spans.append((j + 1, high, int(cut[j]), last))
        cuts.append(cut)
        ends.append(now[n])
        best = now
    used, at, bounds = int(np.argmin(ends)), n, []
    for k in range(used, -1, -1):
        bounds.append(int(length[at - 1]))
        at = int(cuts[k][at])
    return bounds[::-1], int(min(ends))


def pack(docs: DataFrame, length: Column | None = None, buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, length, bucket, bucket_length, batch, padding) of every row of docs.

    length is a Column of lengths, by default the words of text as its tokens; null counts as 0. bucket_length is the padded length of a
    row; rows of a batch times that stay within budget (in units of length), but a row longer than the budget has a batch of its own. batch is
    unique in the result. Repeated rows are packed as often as they come; other columns are left out; an empty table
    gives an empty one.
    """
    length = F.coalesce(word_count(F.col("text")) if length is None else length.cast("long"), F.lit(0).cast("long"))
    # rows are dealt by their place: ids may be null, or many rows may share one
    rows = stage(docs.select("doc_id", length.alias("length"), F.monotonically_increasing_id().alias("place")), "lengths")
    histogram = rows.groupBy("length").count().toPandas().sort_values("length")
    bounds, _ = optimal_bounds(histogram["length"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), buckets)
    if not bounds:
        return rows.select("doc_id", "length", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_length"), F.lit("").alias("batch"), F.lit(0).cast("long").alias("padding"))
    counts = [int(histogram["count"][(histogram["length"] <= b) & (histogram["length"] > a)].sum()) for a, b in zip([-1, *bounds], bounds, strict=False)]
    edges = F.array(*map(F.lit, bounds))
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("length"))))
    size = F.element_at(edges, F.col("bucket") + 1).cast("long")
    shards = F.element_at(F.array(*(F.lit(-(-c // SHARD) or 1) for c in counts)), F.col("bucket") + 1)
    rows = rows.withColumn("bucket_length", size).withColumn("shard", F.pmod(F.xxhash64("place"), shards).cast("int"))
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))))
    nth = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("length", "doc_id", "place")) - 1
    batch = F.concat_ws("-", F.col("bucket").cast("string"), F.col("shard").cast("string"), F.floor(nth / per_batch).cast("string"))
    return rows.select("doc_id", "length", "bucket", "bucket_length", batch.alias("batch"), (F.col("bucket_length") - F.col("length")).alias("padding"))
