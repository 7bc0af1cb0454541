"""A stored text index: postings in blocks by term, kept up by segments, and ranked search that leaves blocks out.

A segment holds the postings of one batch of texts in folders by a hash of the term, so that a search reads the folders of its terms
alone. A term's postings are ordered by their weight and cut into blocks with the bounds of what they can add to a score. A search
first scores each term's best blocks; the k-th score found bounds the result from below, and of the rest only blocks that can still reach it
are read. A document's last segment counts, so a changed text replaces the old one and a removed one is gone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.joins import bounded
from weftline.operators.search import K1, B
from weftline.session import text_batches

#: Folders of a segment; postings in a block; blocks of each term that are scored first, beyond what k needs.
BUCKETS, BLOCK, PROBE = 64, 128, 4
_POSTINGS = "term string, n int, max_tf long, min_len long, docs array<struct<doc_id:long,tf:long>>, places array<array<int>>, segment int, bucket int"
_DOCS = "doc_id long, len long, segment int"
_WORD = "([a-z0-9]+)"
_PLACED = "term string, doc_id long, len long, tf long, pos array<int>"
_BLOCKS = "term string, n int, max_tf long, min_len long, docs array<struct<doc_id:long,tf:long>>, places array<array<int>>"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's terms with their places; a text is whole in its row, so no word is shuffled to be counted."""
    words = re.compile(_WORD).findall
    for batch in batches:
        terms, owner, lengths, counts, flat = [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            found, own = words(text.as_py()), defaultdict(list)
            for k, w in enumerate(found):
                own[w].append(k)
            terms += own
            owner += [i] * len(own)
            lengths += [len(found)] * len(own)
            for places in own.values():
                counts.append(len(places))
                flat += places
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("int32"))
        columns = [pa.array(terms, pa.string()), batch.column(0).take(pa.array(owner, pa.int64())), pa.array(lengths, pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "len", "tf", "pos"])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in order of term and weight, as blocks of BLOCK at most, by doc_id inside; the last block of a batch waits for the next one."""

    def cut(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        term = rows.column("term").combine_chunks()
        at = np.arange(len(rows))
        new = np.concatenate([[True], pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)])
        starts = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % BLOCK == 0)
        end = len(rows) if last else starts[-1]
        starts = starts[starts < end]
        done, ends = rows.slice(0, end), np.append(starts, end).astype("int32")
        tf, length, doc = (done.column(c).to_numpy() for c in ("tf", "len", "doc_id"))
        inside = np.lexsort((tf, doc, np.repeat(np.arange(len(starts)), np.diff(ends))))
        pos = done.column("pos").take(pa.array(inside)).combine_chunks()
        docs = pa.StructArray.from_arrays([pa.array(doc[inside], pa.int64()), pa.array(tf[inside], pa.int64())], ["doc_id", "tf"])
        bound = lambda how, x: pa.array(how.reduceat(x, starts) if len(starts) else [], pa.int64())
        columns = [term.take(pa.array(starts, pa.int64())), pa.array(np.diff(ends), pa.int32()), bound(np.maximum, tf), bound(np.minimum, length), pa.ListArray.from_arrays(pa.array(ends), docs), pa.ListArray.from_arrays(pa.array(ends), pos)]
        return pa.RecordBatch.from_arrays(columns, ["term", "n", "max_tf", "min_len", "docs", "places"]), rows.slice(end)

    left = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if left is None else pa.concat_tables([left, rows])
        if len(rows):
            out, left = cut(rows, False)
            yield out
    if left is not None and len(left):
        yield cut(left, True)[0]


@dataclass
class Found:
    """A page of (doc_id, score), how many documents match at all, and the blocks read of those that the terms have."""

    page: DataFrame
    total: int
    read: int
    blocks: int


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _segments(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/docs/segment=*/_SUCCESS")
        found = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(int(x.getPath().getParent().getName().removeprefix("segment=")) for x in (found or []))

    def add(self, segment: int, texts: DataFrame, removed: DataFrame | None = None) -> None:
        """A batch of new and changed texts (doc_id, text), one a document, and ids of removed ones; a batch that comes again is left alone.

        Words are runs of ASCII letters and digits in lower case; a null text has none. Rows without doc_id are left out.
        """
        if segment in self._segments():
            return
        plain = text_batches(texts).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
        # in order of weight, for any mean: more of a term in a shorter text first; a frequent term spreads over many tasks, and nothing else is shuffled
        order = -F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / 500))
        each = plain.mapInArrow(_placed, _PLACED).withColumns({"bucket": _bucket(F.col("term")), "order": order}).repartitionByRange("bucket", "term", "order", "doc_id").sortWithinPartitions("bucket", "term", "order", "doc_id")
        # places stand in a column of their own, which ranked search doesn't read
        out = each.select("term", "doc_id", "len", "tf", "pos").mapInArrow(_blocked, _BLOCKS).withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        docs = plain.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(_WORD), 1)).cast("long").alias("len"))
        if removed is not None:
            docs = docs.unionByName(removed.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("len")))
        docs.write.mode("overwrite").parquet(f"{self.path}/docs/segment={segment}")

    def live(self) -> DataFrame:
        """(doc_id, segment, len) of the documents as their last segment has them."""
        segments = self._segments()
        rows = self.spark.read.schema(_DOCS).parquet(f"{self.path}/docs") if segments else self.spark.createDataFrame([], _DOCS)
        rows = rows.where(F.col("segment").isin(segments))
        if len(segments) > 1:
            rows = rows.groupBy("doc_id").agg(F.max(F.struct("segment", "len")).alias("last")).select("doc_id", "last.*")
        return rows.where("len IS NOT NULL").select("doc_id", "segment", "len")

    def postings(self, terms: Sequence[str], prefix: str | None = None) -> DataFrame:
        """(term, doc_id, tf, positions) of these terms, and of those that start with prefix, in the live documents: what matching, phrase and near ask for.

        Terms are sought in their own folders; for a prefix all folders are, by the bounds of their files.
        """
        blocks = self._blocks(terms)
        if prefix:
            every = self._all().where(F.startswith("term", F.lit(prefix)) & ~F.col("term").isin(*terms))
            blocks = blocks.unionByName(every)
        each = blocks.select("term", "segment", F.explode(F.arrays_zip("docs", "places")).alias("d")).select("term", "segment", F.col("d.docs.doc_id").alias("doc_id"), F.col("d.docs.tf").alias("tf"), F.col("d.places").alias("positions"))
        return each.join(self.live().select("doc_id", "segment"), ["doc_id", "segment"]).select("term", "doc_id", "tf", "positions")

    def _all(self) -> DataFrame:
        segments = self._segments()
        rows = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings") if segments else self.spark.createDataFrame([], _POSTINGS)
        return rows.where(F.col("segment").isin(segments))

    def _blocks(self, terms: Sequence[str]) -> DataFrame:
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
        return self._all().where(F.col("bucket").isin(buckets) & F.col("term").isin(*terms))

    def search(self, terms: Sequence[str], k: int, offset: int = 0, within: DataFrame | None = None) -> Found:
        """Documents with any of terms, the best by BM25 first, ties by doc_id; within: the doc_ids that count, all if not given."""
        terms = sorted(set(terms))
        live = self.live()
        n, mean = live.agg(F.count("*"), F.avg("len")).first()
        blocks, inside = self._blocks(terms), live if within is None else live.join(within.select("doc_id").distinct(), "doc_id", "left_semi")
        places = lambda b: b.select("term", "segment", F.explode("docs").alias("d")).select("term", "segment", "d.*")
        # one row a term; the live documents are counted, not the postings, as old ones stay in their segments
        seen = places(blocks).join(live.select("doc_id", "segment"), ["doc_id", "segment"]).groupBy("term").agg(F.countDistinct("doc_id").alias("df")).collect()
        total = places(blocks).join(inside.select("doc_id", "segment"), ["doc_id", "segment"]).select("doc_id").distinct().count()
        if not seen or not total:
            return Found(self.spark.createDataFrame([], "doc_id long, score double"), 0, 0, 0)
        df = self.spark.createDataFrame([tuple(r) for r in seen], "term string, df long")
        idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = blocks.join(F.broadcast(df), "term").withColumn("bound", idf * _weight(F.col("max_tf"), F.col("min_len"), F.lit(mean)))
        best = {r["term"]: r["bound"] for r in known.groupBy("term").agg(F.max("bound").alias("bound")).collect()}

        def scores(chosen: DataFrame) -> DataFrame:
            rows = chosen.select("term", "df", "segment", F.explode("docs").alias("d")).select("term", "df", "segment", "d.*").join(inside, ["doc_id", "segment"])
            return rows.groupBy("doc_id").agg(F.sum(idf * _weight(F.col("tf"), F.col("len"), F.lit(mean))).alias("sum"))

        first = Window.partitionBy("term").orderBy(F.desc("bound"), "min_len", "n")
        probe = known.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PROBE + -(-(k + offset) // BLOCK))
        top = scores(probe).orderBy(F.desc("sum")).limit(k + offset).agg(F.min("sum"), F.count("*")).first()
        floor = top[0] - 1e-5 if top[1] == k + offset else float("-inf")
        others = F.create_map(*(x for t in best for x in (F.lit(t), F.lit(sum(best.values()) - best[t]))))
        chosen = known.where(F.col("bound") + F.element_at(others, F.col("term")) >= floor)
        page = scores(chosen).select("doc_id", F.round("sum", 6).alias("score")).orderBy(F.desc("score"), "doc_id").offset(offset).limit(k)
        return Found(page, total, chosen.count(), known.count())


def search_files(index: TextIndex, files: DataFrame, terms: Sequence[str], k: int, offset: int = 0, prefix: str | None = None, since: Column | None = None, superseded: bool = False) -> Found:
    """A page of the files (doc_id and display columns) whose side files match, by rank: prefix in any case, modified since, superseded ones only if asked for."""
    rows = files if prefix is None else files.where(F.lower("prefix") == prefix.lower())
    rows = rows if since is None else rows.where(F.col("remote_modified_at") >= since)
    rows = rows if superseded else rows.where("superseded_by IS NULL")
    found = index.search(terms, k, offset, rows)
    found.page = bounded(found.page, k).join(rows, "doc_id").orderBy(F.desc("score"), "doc_id")
    return found
