"""Quality rules: cross-document line frequency.

Normalised lines (A-Z lower-cased, runs of white space as one space) are hashed; for each host, distinct documents
with a line are counted; lines above the host's limit are removed, and documents that keep too little are rejected.

Copies can be one document here: documents are then told apart by a hash of their whole normalised text. Otherwise a text's
own copies would make its lines look like boilerplate. Texts that differ in any word are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, small, stage
from weftline.llm.words import _BYTE, U64, Words, _power, mix, pieces, signed

#: A line is above its host's limit if more documents have it than both of these.
MIN_DOCS, HOST_SHARE = 10, 0.01
#: A document is depleted if it keeps fewer words than KEEP_WORDS, or than KEEP_SHARE of its words.
KEEP_WORDS, KEEP_SHARE = 10, 0.2
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SCHEMA = "rid long, doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, sig long, lines array<struct<line:long,at:int,words:int>>"


def _runs(h: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of each run h[head:tail]."""
    up, down = _power(len(h) + 1)
    total = np.concatenate([[U64(0)], np.cumsum(h * up[: len(h)], dtype=U64)])
    return mix((total[tails] - total[heads]) * down[heads] + (tails - heads).astype(U64))


def _repeats(words: Words, k: int) -> np.ndarray:
    """For each row, its words that lie in a k-word window found twice or more in the row."""
    h, bounds = words.shingles(k)
    n = np.diff(words.bounds)
    out = np.zeros(words.rows, np.int64)
    for r in np.flatnonzero(n > k).tolist():
        own = h[bounds[r] : bounds[r + 1]]
        order = np.sort(own)
        if not (order[1:] == order[:-1]).any():
            continue
        twice = np.isin(own, order[1:][order[1:] == order[:-1]])
        step = np.zeros(n[r] + 1, np.int64)
        at = np.flatnonzero(twice)
        np.add.at(step, at, 1)
        np.add.at(step, at + k, -1)
        out[r] = np.count_nonzero(np.cumsum(step)[: n[r]])
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in pieces(batch.column("text")):
            own, fold = Words(texts, fold=False), Words(texts)
            rows = own.rows
            per_row = lambda flags, w=own: np.concatenate([[0], np.cumsum(flags)])[w.offs]
            inside = np.zeros(len(own.bytes) + 1, np.int64)
            np.add.at(inside, own.start, 1)
            np.add.at(inside, own.end, -1)
            inside = np.cumsum(inside)[:-1] > 0
            chars = np.diff(per_row(inside & ((own.bytes & 0xC0) != 0x80)))
            symbols = np.diff(per_row(_SYMBOLS[own.bytes]))

            # lines: cut at \n and between rows
            cut = own.bytes == 10
            edge = np.zeros(len(own.bytes) + 1, bool)
            edge[own.offs] = True
            heads = np.flatnonzero(edge[:-1] | np.concatenate([[False], cut[:-1]])) if len(cut) else np.zeros(0, np.int64)
            tails = np.concatenate([heads[1:], [len(own.bytes)]]) if len(heads) else heads
            bare = tails - (cut[tails - 1] if len(tails) else 0)
            row = np.searchsorted(own.offs, heads, side="right") - 1
            nth = np.arange(len(heads)) - np.searchsorted(row, row, side="left")
            first, last = np.searchsorted(own.start, heads), np.searchsorted(own.start, tails)
            some = last > first
            heads, bare, row, nth, first, last = (x[some] for x in (heads, bare, row, nth, first, last))
            raw = _runs(_BYTE[own.bytes], heads, bare)
            line = signed(_runs(fold.hash, first, last))
            bounds = np.searchsorted(row, np.arange(rows + 1))
            again = np.zeros(rows, np.int64)
            for r in np.flatnonzero(np.diff(bounds) > 1).tolist():
                x = raw[bounds[r] : bounds[r + 1]]
                again[r] = len(x) - len(np.unique(x))

            sig = _runs(fold.hash, fold.bounds[:-1], fold.bounds[1:])
            items = pa.StructArray.from_arrays([pa.array(line), pa.array(nth, pa.int32()), pa.array(last - first, pa.int32())], ["line", "at", "words"])
            cols = [batch.column(c).slice(at, rows) for c in ("rid", "doc_id", "host", "text_hash")]
            nums = [np.diff(own.bounds), chars, symbols, again, _repeats(own, 8), signed(sig)]
            names = ["rid", "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "sig", "lines"]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in nums), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)], names)


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def _verdicts(docs: DataFrame, host: str, min_docs: int, host_share: float, fold_copies: bool) -> DataFrame:
    """line_quality with the host and the hash of each row's text."""
    rid = F.monotonically_increasing_id()
    rows = bounded_batches(docs).select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), _host(host).alias("host"), F.xxhash64("text").alias("text_hash"), "text")
    seen = stage(rows.mapInArrow(_features, _SCHEMA), "line-features")
    who = F.col("sig") if fold_copies else F.coalesce(F.xxhash64("doc_id", F.lit(1)), F.xxhash64("rid"))
    own = seen.withColumn("who", who)
    lines = own.select("rid", "host", "who", F.explode("lines").alias("l")).select("rid", "host", "who", "l.line", "l.at", "l.words")

    hosts = own.groupBy("host", "who").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("docs"))
    counts = lines.groupBy("host", "line", "who").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("df")).where(F.col("df") > min_docs)
    limit = F.greatest(F.lit(float(min_docs)), F.col("docs") * host_share)
    above = stage(counts.join(hosts, "host").where(F.col("df") > limit).select("host", "line"), "frequent-lines")

    hit = lines.join(small(above, 500_000), ["host", "line"]).groupBy("rid").agg(F.sum("words").alias("cut"), F.sort_array(F.collect_list("at")).alias("removed"))
    out = seen.drop("lines", "sig").join(hit, "rid", "left")
    out = out.withColumn("words_left", F.col("n_words") - F.coalesce("cut", F.lit(0)))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    depleted = (F.col("words_left") < KEEP_WORDS) | (F.col("words_left") < KEEP_SHARE * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"), "words_left", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), "host", "text_hash",
    )


def line_quality(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, fold_copies: bool = True) -> DataFrame:
    """Verdict of every row of docs (doc_id, text and the host column).

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then words_left (words
    outside removed lines) and removed (positions of the removed lines among the text's \\n-split lines).
    fold_copies: texts equal after normalisation are one document of their host; otherwise each doc_id is one, and each row without.
    A null text counts as empty (all zero, base_failed); a null host is a host of its own; repeated rows each get
    their verdict; other columns are left out; an empty table gives an empty one.
    """
    return _verdicts(docs, host, min_docs, host_share, fold_copies).drop("host", "text_hash")


def clean_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """Documents that the rules keep, without their frequent lines; the columns of docs, n_chars counted anew.

    Each row goes by the verdict of its own text, also where a doc_id is null or comes with several texts: rows with equal
    doc_id, host and text have equal verdicts. Repeated rows stay as often as they come, other columns as they are; a null
    text goes; an empty table gives an empty one.
    """
    key = ("doc_id", "host", "text_hash")
    verdict = _verdicts(docs, host, MIN_DOCS, HOST_SHARE, True).where("kept").select(*key, "removed").dropDuplicates(list(key))
    verdict = small(stage(verdict, "verdicts"), 500_000).alias("v")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("v.doc_id")) & (_host(f"d.{host}") == F.col("v.host")) & (F.xxhash64("d.text") == F.col("v.text_hash"))
    gone = F.col("v.removed")
    left = F.array_join(F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.size(gone) > 0, left).otherwise(F.col("d.text"))
    columns = {c: F.col(f"d.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return docs.alias("d").join(verdict, same).select(*(c.alias(name) for name, c in columns.items()))


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, array_to_string(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS norm FROM d),
l AS (SELECT rid, host, unnest(string_split(t, chr(10))) AS line FROM d), lw AS (SELECT l.rid, l.host, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lws FROM l),
ln AS (SELECT lw.rid, lw.host, w.norm AS who, line, len(lws) AS words, translate(array_to_string(lws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lw JOIN w USING (rid) WHERE len(lws) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY rid),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)), rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rp AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT norm) AS docs FROM w GROUP BY host), freq AS (SELECT host, key, count(DISTINCT who) AS df FROM ln GROUP BY host, key),
above AS (SELECT host, key FROM freq JOIN hosts USING (host) WHERE df > greatest(10.0, docs * 0.01)), cut AS (SELECT rid, sum(words) AS cut, count(*) AS n_removed_lines FROM ln JOIN above USING (host, key) GROUP BY rid),
o AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(ws) - coalesce(cut, 0) AS BIGINT) AS words_left, coalesce(n_removed_lines, 0) AS n_removed_lines
FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rp USING (rid) LEFT JOIN cut USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND words_left >= 10 AND words_left >= 0.2 * n_words AS kept FROM b
"""
