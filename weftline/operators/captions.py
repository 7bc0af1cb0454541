"""Caption operators: SRT parse and emit, cleaning, splitting, chunking, seams, coverage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import strip
from weftline.functions.time import SRT_TIME, srt_time
from weftline.session import text_batches

CAPTION = "index int, start_ms bigint, end_ms bigint, text string"
CAPTIONS = f"array<struct<{CAPTION.replace(' ', ':').replace(',:', ',')}>>"


def parse_srt(srt: Column) -> Column:
    """Captions of an SRT text as an array; blocks of fewer than three lines, without number or timecode are left out."""
    blocks = F.split(strip(F.regexp_replace(srt, "\r\n?", "\n")), r"\n\s*\n")
    lines = F.transform(blocks, lambda b: F.split(strip(b), "\n"))
    pattern = rf"^\s*{SRT_TIME}\s*-->\s*{SRT_TIME}\s*$"
    ms = lambda p, i: ((F.get(p, F.lit(i)).cast("long") * 60 + F.get(p, F.lit(i + 1)).cast("long")) * 60 + F.get(p, F.lit(i + 2)).cast("long")) * 1000 + F.get(p, F.lit(i + 3)).cast("long")
    good = F.filter(lines, lambda x: (F.size(x) >= 3) & x[0].rlike(r"^\s*\d+\s*$") & x[1].rlike(pattern))
    timed = F.transform(good, lambda x: F.struct(x.alias("x"), F.split(F.trim(x[1]), r"\s*-->\s*|[:,.]").alias("p")))
    return F.transform(timed, lambda c: F.struct(F.trim(c["x"][0]).cast("int").alias("index"), ms(c["p"], 0).alias("start_ms"), ms(c["p"], 4).alias("end_ms"), F.array_join(F.slice(c["x"], F.lit(3), F.size(c["x"])), "\n").alias("text")))


def emit_srt(captions: Column) -> Column:
    """SRT text of an array of captions, numbered from 1."""
    block = lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(c["start_ms"]), F.lit(" --> "), srt_time(c["end_ms"]), F.lit("\n"), c["text"], F.lit("\n"))
    return F.array_join(F.transform(captions, block), "\n")


def emit_vtt(captions: Column) -> Column:
    cue = lambda c: F.concat(srt_time(c["start_ms"], "."), F.lit(" --> "), srt_time(c["end_ms"], "."), F.lit("\n"), c["text"], F.lit("\n"))
    return F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(captions, cue), "\n"))


def document_captions(docs: DataFrame, step_ms: int = 3000, shown_ms: int = 2500) -> DataFrame:
    """(doc_id, srt): SRT text with one caption for each line of a document."""
    block = lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(i * step_ms), F.lit(" --> "), srt_time(i * step_ms + shown_ms), F.lit("\n"), x)
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), block), "\n\n").alias("srt"))


#: Fixed values of cleaning, in ms: gap between captions, length under which one is merged, gap that still counts as close.
GAP, LEAST, NEAR = 50, 1000, 500


def cleaned(captions: pd.Series) -> pd.Series:
    """Per document: drop empty and repeated captions, mend durations and overlaps, merge short ones into the one before."""

    def one(items):
        out: list[dict] = []
        for c in items:
            c = dict(c)
            words, last = c["text"].strip(), out[-1] if out else None
            if not words:
                continue
            if last and words == last["text"].strip():
                last["end_ms"] = max(last["end_ms"], c["end_ms"])
                continue
            if c["end_ms"] <= c["start_ms"]:
                c["end_ms"] = c["start_ms"] + 1000
            if last:
                c["start_ms"] = max(c["start_ms"], last["end_ms"] + GAP)
                if c["end_ms"] - c["start_ms"] < LEAST and c["start_ms"] - last["end_ms"] < NEAR:
                    last |= {"text": f"{last['text']}\n{c['text']}", "end_ms": c["end_ms"]}
                    continue
            out.append(c)
        return [c | {"index": i + 1} for i, c in enumerate(out)]

    return captions.map(one)


def split_speakers(captions: pd.Series) -> pd.Series:
    """Per document: captions with an inner >> become one for each speaker, their time shared out by length."""

    def one(items):
        out = []
        for c in items:
            head, *rest = c["text"].split(">>")
            parts = [head.strip()] * bool(head.strip()) + [f">> {p.strip()}" for p in rest if p.strip()]
            if len(parts) <= 1:
                out.append(dict(c))
                continue
            total, at, span = sum(map(len, parts)), c["start_ms"], c["end_ms"] - c["start_ms"]
            for k, p in enumerate(parts):
                left = len(parts) - 1 - k
                end = min(max(at + round(span * len(p) / total), at + 1), c["end_ms"] - left) if left else c["end_ms"]
                out.append({"start_ms": at, "end_ms": end, "text": p})
                at = end
        return [c | {"index": i + 1} for i, c in enumerate(out)]

    return captions.map(one)


def chunk_starts(texts: list[str], target: int, turn_ahead: int = 25, sentence_ahead: int = 10) -> list[int]:
    """First captions of chunks: at the target of words, a chunk ends before the next speaker's turn if one is near, else at a sentence's end, else at once."""
    starts, words, i = [0], 0, 0
    while i < len(texts):
        words += len(texts[i].split())
        if words >= target and i < len(texts) - 1:
            turn = (j for j in range(i, min(i + turn_ahead, len(texts) - 1)) if texts[j + 1].lstrip().startswith(">>"))
            sentence = (j for j in range(i, min(i + sentence_ahead, len(texts))) if texts[j].strip()[-1:] in (".", "?", "!"))
            i = next(turn, next(sentence, i)) + 1
            words = 0
            if i < len(texts):
                starts.append(i)
        else:
            i += 1
    return starts


def chunked(df: DataFrame, target: int = 120) -> DataFrame:
    """(doc_id, chunk, first, captions, words) of the column captions; under one and a half targets a document is one chunk."""

    @F.pandas_udf("array<struct<chunk:int,first:int,captions:int,words:bigint>>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(items):
            items = list(items)
            total = sum(len(t.split()) for t in items)
            starts = chunk_starts(items, target) if total >= 1.5 * target else [0]
            return [{"chunk": k, "first": a, "captions": b - a, "words": sum(len(t.split()) for t in items[a:b])} for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(items)], strict=True)) if items]

        return texts.map(one)

    parts = df.select("doc_id", F.explode(cut(F.transform("captions", lambda c: c["text"]))).alias("c"))
    return parts.select("doc_id", "c.chunk", "c.first", "c.captions", "c.words")


def missing_runs(status: DataFrame, least: int = 3) -> DataFrame:
    """Islands (doc_id, first, last, missing): runs of missing captions between present ones.

    status has doc_id, ord and missing (true, false, or null for captions too short to tell, which are transparent).
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    run = F.sum(F.when(F.col("missing") == F.lit(False), 1).otherwise(0)).over(w)
    islands = status.withColumn("run", run).where("missing").groupBy("doc_id", "run")
    return islands.agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("missing")).where(F.col("missing") >= least).drop("run")


def caption_status(captions: DataFrame, output: DataFrame, floor: float = 0.34) -> DataFrame:
    """(doc_id, ord, missing) of captions (doc_id, ord, text) against the output text (doc_id, output) of their document.

    A document's captions stand beside its output once, whose trigrams are made a set once, however many captions ask it.
    """
    words = re.compile(r"[a-z']{3,}").findall

    def grams(text: str | None) -> set[tuple[str, str, str]]:
        w = words(text or "")
        return set(zip(w, w[1:], w[2:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at, missing = batch.column(1), [], []
            for i, (texts, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                have = grams(text.as_py())
                at += [i] * len(texts)
                missing += [len(g & have) / len(g) < floor if (g := grams(t)) else None for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), own.flatten(), pa.array(missing, pa.bool_())], ["doc_id", "ord", "missing"])

    kinds = {c: captions.schema[c].dataType.simpleString() for c in ("doc_id", "ord")}
    every = text_batches(captions).groupBy("doc_id").agg(F.collect_list(F.struct("ord", F.lower("text").alias("text"))).alias("c"))
    rows = every.join(output, "doc_id").select("doc_id", F.col("c.ord").alias("ords"), F.col("c.text").alias("texts"), F.lower("output").alias("output"))
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, ord {kinds['ord']}, missing boolean")


def seam_echo(before: Column, after: Column, most: int = 6) -> Column:
    """How many first items of after repeat the last ones of before: the largest such number up to most, 0 for none."""
    sizes = F.sequence(F.least(F.size(before), F.size(after), F.lit(most)), F.lit(1), F.lit(-1))
    equal = lambda k: (F.slice(before, -k, k) == F.slice(after, F.lit(1), k)) & F.forall(F.slice(after, F.lit(1), k), lambda t: t != "")
    return F.when((F.size(before) > 0) & (F.size(after) > 0), F.coalesce(F.get(F.filter(sizes, equal), F.lit(0)), F.lit(0))).otherwise(0)


def snapped(chapters: DataFrame, title: str, cap: int) -> DataFrame:
    """Chapters (doc_id, ord, start_ms, title, end_ms of the media): unique starts, a first one at 0, none beyond the end, at most cap; each ends before the next."""
    one = Window.partitionBy("doc_id", "start_ms").orderBy("ord")
    unique = chapters.withColumn("nth", F.row_number().over(one)).where("nth = 1 AND start_ms <> 0").select("doc_id", "start_ms", "title", "media_end")
    first = chapters.select("doc_id", "media_end").distinct().select("doc_id", F.lit(0).cast("long").alias("start_ms"), F.lit(title).alias("title"), "media_end")
    every = first.unionByName(unique).where("start_ms <= media_end")
    w = Window.partitionBy("doc_id").orderBy("start_ms")
    every = every.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    return every.select("doc_id", "n", "start_ms", "title", F.coalesce(F.lead("start_ms").over(w) - 1, F.col("media_end")).alias("end_ms"))


def gap_message(spans: DataFrame) -> DataFrame:
    """(doc_id, message) of spans (doc_id, start, end, captions, sample): what an editor reads about the parts that are missing."""
    n = F.size("s")
    one = lambda x: F.concat(x["start"], F.lit("–"), x["end"], F.lit(" ("), x["captions"].cast("string"), F.lit(' captions, e.g. "'), x["sample"], F.lit('")'))
    rows = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "captions", "sample"))).alias("s"))
    text = F.concat(F.lit("SEAM GAP DETECTED: Formatter output is missing "), n.cast("string"), F.when(n == 1, " section").otherwise(" sections"), F.lit(" of source dialogue: "), F.array_join(F.transform("s", one), "; "), F.lit(". Likely a chunk-boundary drop — retry to escalate / re-chunk."))
    return rows.select("doc_id", text.alias("message"))


def chapter_checks(chapters: Column, boundaries: Column, cap: int, words: int, near_ms: int = 2000) -> dict[str, Column]:
    """Numbers of findings of a chapter list (start_ms, title): over its cap, titles of more than so many words, starts that no boundary is near."""
    long = F.filter(chapters, lambda c: F.size(F.split(F.trim(c["title"]), r"\s+")) > words)
    off = F.filter(chapters, lambda c: ~F.exists(boundaries, lambda b: F.abs(b - c["start_ms"]) <= near_ms))
    return {"over_cap": (F.size(chapters) > cap).cast("int"), "long_titles": F.size(long), "off_boundary": F.size(off)}
