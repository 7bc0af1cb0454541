"""Many phrases against many texts at once: one automaton of all phrases, run once over each text.

Phrases are sequences of tokens. By words, tokens are words and single marks in lower case, white space between them doesn't count, and a
phrase is found as whole words; by parts, tokens are characters, and a phrase is found anywhere. The automaton is built once, sent to the
tasks once, and its cost per token doesn't grow with the number of phrases. Tables of words beyond AT_ONCE go to no task whole: runs of tokens
as long as a phrase that pass a bitmap of fixed size are joined with the phrases, and the join is exact.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.operators.joins import bounded
from weftline.session import text_batches
from weftline.sources.files import scratch

#: Phrases, and characters of them, that a table of rules has at most: what one automaton holds.
MAX_PHRASES, MAX_CHARS = 1_000_000, 64 << 20
#: Phrases by words, and characters of them, up to which each task holds the automaton of all; bits of the map that runs of tokens must pass beyond.
AT_ONCE, CHARS_AT_ONCE, MAP_BITS = 10_000, 1 << 20, 1 << 27
_TOKEN = re.compile(r"\w+|[^\w\s]")


class Automaton:
    """States over tokens: where a token leads, the longest own end that is a phrase's beginning, and the phrases that end there."""

    def __init__(self, phrases: Iterable[tuple[str, str]], words: bool = True):
        self.words = words
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, int]]] = [[]]
        for name, phrase in phrases:
            tokens = [t for t, _, _ in self.tokens(phrase)]
            if not tokens:
                continue
            at = 0
            for t in tokens:
                if t not in self.next[at]:
                    self.next[at][t] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][t]
            self.ends[at].append((name, len(tokens)))
        self.back = [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            at = waiting.popleft()
            for t, to in self.next[at].items():
                waiting.append(to)
                back = self.back[at]
                while back and t not in self.next[back]:
                    back = self.back[back]
                self.back[to] = self.next[back].get(t, 0)
                self.ends[to] = self.ends[to] + self.ends[self.back[to]]

    def tokens(self, text: str) -> list[tuple[str, int, int]]:
        low = text.lower()
        if len(low) != len(text):  # lower case of another length: by characters, so that places stay
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not self.words:
            return [(c, i, i + 1) for i, c in enumerate(low)]
        return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(low)]

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(name, start, end) of every place of every phrase, overlapping ones too, in order of their ends."""
        out, at, tokens = [], 0, self.tokens(text)
        step, ends, back = self.next, self.ends, self.back
        for i, (t, _, end) in enumerate(tokens):
            while at and t not in step[at]:
                at = back[at]
            at = step[at].get(t, 0)
            for name, n in ends[at]:
                out.append((name, tokens[i - n + 1][1], end))
        return out


def automaton(phrases: DataFrame, words: bool = True) -> Automaton:
    """The automaton of a table (id, phrase), whose size is checked; null and empty phrases are left out."""
    rows = phrases.select(F.col("id").cast("string").alias("id"), "phrase").where("id IS NOT NULL AND phrase IS NOT NULL")
    n, chars = rows.agg(F.count("*"), F.sum(F.length("phrase"))).first()
    if n > MAX_PHRASES or (chars or 0) > MAX_CHARS:
        raise ValueError(f"{n} phrases of {chars} characters: more than one automaton holds")
    return Automaton(sorted((r["id"], r["phrase"]) for r in rows.collect()), words)


def phrase_spans(texts: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text", words: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(key, id, start, end) of every place of every phrase (id, phrase) in every text, with the columns keep of the phrases; places count code points, a null text has none."""
    path = scratch(phrases.sparkSession, "phrases")
    phrases.select(F.col("id").cast("string").alias("id"), "phrase", *(c for c in keep if c != "phrase")).where("id IS NOT NULL AND phrase IS NOT NULL").write.parquet(path)
    own = phrases.sparkSession.read.parquet(path)
    n, chars = own.agg(F.count("*"), F.sum(F.length("phrase"))).first()
    if words and (n > AT_ONCE or (chars or 0) > CHARS_AT_ONCE):
        return _joined_spans(texts, own, key, text, keep)
    found = _automaton_spans(texts, own, key, text, words)
    return found.join(bounded(own.dropDuplicates(["id"]).select("id", *keep), 100_000), "id").select(*found.columns, *keep) if keep else found


def _automaton_spans(texts: DataFrame, phrases: DataFrame, key: str, text: str, words: bool) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(automaton(phrases, words))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1)):
                hits = own.find(t.as_py() or "")
                at += [i] * len(hits)
                found += hits
            names, starts, ends = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [key, "id", "start", "end"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, id string, start int, end int")


def _runs(tokens: list[str], n: int) -> list[str]:
    """Each n tokens in a row, as one string; no token has white space."""
    return list(map(" ".join, zip(*(tokens[i:] for i in range(n)), strict=False)))


def _joined_spans(texts: DataFrame, phrases: DataFrame, key: str, text: str, keep: Sequence[str]) -> DataFrame:
    """phrase_spans by words, for a table of any size: a text's cost grows with the number of different lengths of phrases, not with that of phrases."""
    spark, path, cut = texts.sparkSession, scratch(texts.sparkSession, "phrase-tokens"), Automaton([])

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[t for t, _, _ in cut.tokens(x)] for x in batch.column("phrase").to_pylist()]
            yield batch.append_column("_run", pa.array([" ".join(t) for t in own], pa.string())).append_column("_n", pa.array(list(map(len, own)), pa.int32()))

    phrases.mapInArrow(normal, StructType(phrases.schema.fields + StructType.fromDDL("_run string, _n int").fields)).where("_n > 0").write.parquet(path)
    own = spark.read.parquet(path)
    lengths = sorted(r[0] for r in own.select("_n").distinct().collect())
    code = F.crc32(F.col("_run").cast("binary")) % MAP_BITS + 1
    parts = own.select(F.bitmap_bucket_number(code).alias("part"), F.bitmap_bit_position(code).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        bits[(r["part"] - 1) * len(r["bits"]) : r["part"] * len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    sent, size = spark.sparkContext.broadcast(bits), MAP_BITS
    columns = StructType([texts.schema[key], *StructType.fromDDL("_run string, _starts array<int>, _ends array<int>").fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            at, found, starts, ends = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                tokens, places = cut.tokens(t.as_py() or ""), {}
                plain = [t for t, _, _ in tokens]
                for n in lengths:
                    runs = _runs(plain, n)
                    codes = np.fromiter((crc32(x.encode()) for x in runs), np.int64, len(runs)) % size
                    for k in np.flatnonzero((own[codes >> 3] >> (codes & 7).astype(np.uint8)) & 1).tolist():
                        places.setdefault(runs[k], []).append((tokens[k][1], tokens[k + n - 1][2]))
                at += [i] * len(places)
                found += places
                starts += [[a for a, _ in p] for p in places.values()]
                ends += [[b for _, b in p] for p in places.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], columns.names)

    found = text_batches(texts.select(key, text)).mapInArrow(search, columns)
    rules = bounded(own.select("_run", "id", *keep), 300_000)
    return found.join(rules, "_run").select(key, "id", F.explode(F.arrays_zip("_starts", "_ends")).alias("_p"), *keep).select(key, "id", F.col("_p._starts").alias("start"), F.col("_p._ends").alias("end"), *keep)


def phrase_findings(texts: DataFrame, rules: DataFrame, prefix: str = "voice.forbidden") -> DataFrame:
    """(doc_id, rule_id, severity, start, end, message): a finding for every place of every rule's phrase (id, phrase, severity)."""
    found = phrase_spans(texts, rules, keep=("phrase", "severity"))
    message = F.concat(F.lit('"'), F.col("phrase"), F.lit('" at '), F.col("start").cast("string"))
    return found.select("doc_id", F.concat(F.lit(f"{prefix}."), F.col("id")).alias("rule_id"), "severity", "start", "end", message.alias("message"))


def categories(flags: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, categories, rule_ids) of flags (key, text): what each is about, by a table of parts (category, need, part, rule_id).

    A category needs a hit of each of its numbers need above 0, and none of need 0 (what excludes it). Its rule is that of its first hit that
    names one, in order of the table's column rank. A flag without a category has empty lists; both are sorted, and distinct.
    """
    numbered = rules.select(F.concat_ws("\u0001", "category", "need", "rank", F.coalesce("rule_id", F.lit(""))).alias("id"), F.col("part").alias("phrase"))
    hits = phrase_spans(flags, numbered, key="key", words=False).select("key", F.split("id", "\u0001").alias("r")).select("key", F.col("r")[0].alias("category"), F.col("r")[1].cast("int").alias("need"), F.col("r")[2].cast("int").alias("rank"), F.nullif(F.col("r")[3], F.lit("")).alias("rule_id"))
    asked = rules.where("need > 0").groupBy("category").agg(F.countDistinct("need").alias("needs"))
    met = hits.groupBy("key", "category").agg(F.countDistinct(F.when(F.col("need") > 0, F.col("need"))).alias("met"), F.count_if(F.col("need") == 0).alias("out"), F.min_by("rule_id", F.when(F.col("rule_id").isNotNull() & (F.col("need") > 0), F.col("rank"))).alias("rule_id"))
    good = met.join(bounded(asked, 100_000), "category").where("met = needs AND out = 0")
    each = good.groupBy("key").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    none = F.array().cast("array<string>")
    return flags.select("key").join(each, "key", "left").select("key", F.coalesce("categories", none).alias("categories"), F.coalesce("rule_ids", none).alias("rule_ids"))


def qa_outcome(results: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, fixable, nonfixable, escalate) of phase results (id, phase, status, flags, output), by patterns (kind, part): flag or output.

    A flag is beyond a stronger model if it has a flag pattern, or its phase's output an output pattern. A failed phase without flags counts as
    one; a phase that passed without flags as none. One such flag makes escalation futile; a job without flags is escalated.
    """
    rows = results.where("status = 'fail' OR size(coalesce(flags, array())) > 0").select("id", "phase", F.lower(F.coalesce("output", F.lit(""))).alias("output"), F.when(F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0, F.col("flags")).otherwise(F.array(F.lit(""))).alias("flags"))
    parts = lambda kind: patterns.where(F.col("kind") == kind).select(F.lit("x").alias("id"), F.col("part").alias("phrase"))
    each = rows.select("id", "phase", F.posexplode("flags").alias("nth", "flag")).withColumn("key", F.to_json(F.struct("id", "phase", "nth")))
    bad_flags = phrase_spans(each.select("key", "flag"), parts("flag"), "key", "flag", words=False).select("key").distinct().withColumn("_flag", F.lit(True))
    bad_outputs = phrase_spans(rows.withColumn("key", F.to_json(F.struct("id", "phase"))).select("key", "output"), parts("output"), "key", "output", words=False).select(F.col("key").alias("owner")).distinct().withColumn("_output", F.lit(True))
    told = each.withColumn("owner", F.to_json(F.struct("id", "phase"))).join(bad_flags, "key", "left").join(bad_outputs, "owner", "left")
    beyond = F.coalesce("_flag", F.lit(False)) | F.coalesce("_output", F.lit(False))
    counts = told.groupBy("id").agg(F.count_if(~beyond).alias("fixable"), F.count_if(beyond).alias("nonfixable"))
    out = results.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("fixable", F.lit(0).cast("long")).alias("fixable"), F.coalesce("nonfixable", F.lit(0).cast("long")).alias("nonfixable"))
    return out.withColumn("escalate", F.col("nonfixable") == 0)


def resolved_limits(limits: DataFrame, kinds: DataFrame) -> DataFrame:
    """(content_type, programme, limits) for each kind (content_type, programme): a map of field to struct max, min_count, max_count.

    Rows of limits (field, content_type, programme, max, min_count, max_count) with a null type or programme hold for all. For each number of a field the
    most specific row that has it wins: a programme's own type, its programme, the type, then all.
    """
    own, other = limits.alias("l"), kinds.select("content_type", "programme").distinct().alias("k")
    fits = lambda c: F.col(f"l.{c}").isNull() | F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}"))
    rank = F.when(F.col("l.programme").isNotNull(), 2).otherwise(0) + F.when(F.col("l.content_type").isNotNull(), 1).otherwise(0)
    # both sides are rule tables: a few kinds against a few fields
    rows = other.join(F.broadcast(own), fits("content_type") & fits("programme")).select("k.content_type", "k.programme", "field", rank.alias("rank"), "max", "min_count", "max_count")
    best = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c)
    fields = rows.groupBy("content_type", "programme", "field").agg(*map(best, ("max", "min_count", "max_count")))
    return fields.groupBy("content_type", "programme").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("max", "min_count", "max_count")))).alias("limits"))


def with_limits(rows: DataFrame, limits: DataFrame, content_type: Column | None = None, programme: Column | None = None) -> DataFrame:
    """rows with a column limits, the map that holds for each row's type and programme."""
    null = F.lit(None).cast("string")
    keyed = rows.withColumns({"_type": null if content_type is None else content_type, "_programme": null if programme is None else programme})
    # without either column all rows are of one kind, and need not be read for it
    one = content_type is None and programme is None
    kinds = limits.sparkSession.createDataFrame([(None, None)], "content_type string, programme string") if one else keyed.select(F.col("_type").alias("content_type"), F.col("_programme").alias("programme"))
    of = bounded(resolved_limits(limits, kinds), 100_000)
    return keyed.join(of, F.col("_type").eqNullSafe(F.col("content_type")) & F.col("_programme").eqNullSafe(F.col("programme")), "left").drop("_type", "_programme", "content_type", "programme")
