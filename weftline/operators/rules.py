"""Text rules held as data, and the checks that they drive."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.joins import bounded
from weftline.session import text_batches
from weftline.sources.files import rule_rows

#: Rules that a table of them has at most, to be joined or written out in a plan.
MAX_RULES = 1_000
FINDING = "doc_id long, rule_id string, severity string, message string"


def load(spark, path: str) -> dict[str, DataFrame]:
    """Rule families of the YAML files below path as DataFrames, one column a key; items of all files, told apart by their path."""
    rows = rule_rows(spark, path)
    families = {}
    for r in rows.groupBy("family").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.json_object_keys("item"))))).alias("keys")).collect():
        own = rows.where(F.col("family") == r["family"])
        families[r["family"]] = own.select("path", *(F.get_json_object("item", f"$['{k}']").alias(k) for k in r["keys"]))
    return families


def merged(base: Mapping, over: Mapping) -> dict:
    """Deep merge: over wins, mappings are merged in turn."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), Mapping) and isinstance(v, Mapping) else v
    return out


def limit_findings(fields: DataFrame, limits: DataFrame) -> DataFrame:
    """Fields (doc_id, field, value) over their limit (field, max) in characters."""
    hit = fields.join(bounded(limits, MAX_RULES), "field").where(F.length("value") > F.col("max"))
    message = F.concat(F.col("field"), F.lit(" has "), F.length("value").cast("string"), F.lit(" of "), F.col("max").cast("string"))
    return hit.select("doc_id", F.concat(F.lit("limits."), F.col("field"), F.lit(".max")).alias("rule_id"), F.lit("error").alias("severity"), message.alias("message"))


def count_findings(fields: DataFrame, limits: DataFrame) -> DataFrame:
    """Lists (doc_id, field, items) whose size is outside [min_count, max_count]."""
    hit = fields.join(bounded(limits, MAX_RULES), "field").where(~F.size("items").between(F.col("min_count"), F.col("max_count")))
    return hit.select("doc_id", F.concat(F.lit("limits."), F.col("field"), F.lit(".count")).alias("rule_id"), F.lit("warning").alias("severity"), F.size("items").cast("string").alias("message"))


def phrase_counts(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, id, n): every phrase (id, pattern) counted in every text as whole words, any case; at most MAX_RULES phrases.

    The phrases become literals of one projection: texts are neither joined nor shuffled, and each pattern is compiled once.
    """
    rules = phrases.select("id", "pattern").limit(MAX_RULES + 1).collect()
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} phrases")
    count = lambda p: F.regexp_count("text", F.lit(f"(?i)(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])"))
    if not rules:
        return texts.select("doc_id", F.lit("").alias("id"), F.lit(0).alias("n")).limit(0)
    found = F.array(*(F.struct(F.lit(r["id"]).alias("id"), count(r["pattern"]).alias("n")) for r in rules))
    return texts.select("doc_id", F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("f")).select("doc_id", "f.id", "f.n")


def phrase_spans(phrases: Sequence[tuple[str, str]]):
    """pandas UDF: (id, start, end) of each match of the phrases in a text."""
    compiled = [(i, re.compile(rf"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])", re.I)) for i, p in phrases]

    @F.pandas_udf("array<struct<id:string,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"id": i, "start": m.start(), "end": m.end()} for i, p in compiled for m in p.finditer(t or "")])

    return spans


_GUARDED = re.compile(r"```.*?```|https?://\S+", re.S)


def guarded_substitutions(rules: Sequence[tuple[str, str]]):
    """pandas UDF: (text, count) after ordered find/replace pairs; fences and URLs stay, and a change of case alone is skipped at a sentence's start."""
    compiled = [(re.compile(find), replace) for find, replace in rules]

    def opens_sentence(text: str, at: int) -> bool:
        before = text[:at].rstrip(" \t")
        return not before or before[-1] == "\n" or before[-1] in ".!?" or (len(before) > 1 and before[-1] in "\"'”’" and before[-2] in ".!?")

    def one(text: str) -> tuple[str, int]:
        total = 0
        for pattern, replace in compiled:
            if not pattern.search(text):
                continue
            spans = [m.span() for m in _GUARDED.finditer(text)] if "```" in text or "://" in text else []
            pieces, at = [], 0
            for m in pattern.finditer(text):
                new = m.expand(replace)
                inside = any(m.start() < b and m.end() > a for a, b in spans)
                if inside or new == m[0] or (new.lower() == m[0].lower() and opens_sentence(text, m.start())):
                    continue
                pieces += [text[at : m.start()], new]
                at = m.end()
                total += 1
            text = "".join(pieces) + text[at:]
        return text, total

    @F.pandas_udf("text string, count int")
    def apply(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t or "") for t in texts], columns=["text", "count"])

    return apply


def down_style(text: Column, terms: Sequence[str]) -> Column:
    """Lower case, canonical terms as given (the longest first), and a capital at the first letter."""
    out = F.lower(text)
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        out = F.regexp_replace(out, rf"(?<![a-z0-9]){re.escape(term.lower())}(?![a-z0-9])", term.replace("\\", "\\\\").replace("$", "\\$"))
    first = F.regexp_instr(out, F.lit("[a-z]"))
    return F.when(out.rlike("^[^A-Za-z]*[a-z]"), F.concat(F.substr(out, F.lit(1), first - 1), F.upper(F.substr(out, first, F.lit(1))), F.substr(out, first + 1))).otherwise(out)


def output_missing(text: Column, least: int = 50) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"\s", "")) < least


def truncation_suspect(text: Column) -> Column:
    """The last line with words lacks an end mark."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.coalesce(~F.try_element_at(lines, F.lit(-1)).rlike(r"[.!?…\"”')\]]\s*$"), F.lit(False))


def subset_labels(labels: Column) -> Column:
    """Pairs of labels, one's words a strict part of the other's."""
    words = lambda x: F.array_distinct(F.split(F.lower(x), " "))
    part = lambda a, b: (F.size(F.array_except(words(a), words(b))) == 0) & (F.size(words(a)) < F.size(words(b)))
    return F.flatten(F.transform(labels, lambda a: F.transform(F.filter(labels, lambda b: part(a, b)), lambda b: F.struct(a.alias("short"), b.alias("long")))))


def claimed(flags: Sequence[bool], rules: Sequence[Sequence[str]]) -> tuple[int, int, int]:
    """(both, violations left, flags left) of rows in order: each flag claims the first free violation whose first rule is among the flag's."""
    free = defaultdict(deque)
    for i, (flag, own) in enumerate(zip(flags, rules, strict=True)):
        if not flag and own:
            free[own[0]].append(i)
    both = 0
    for flag, own in zip(flags, rules, strict=True):
        waiting = [free[r] for r in own if free.get(r)] if flag else None
        if waiting:
            min(waiting, key=lambda q: q[0]).popleft()
            both += 1
    n = sum(flags)
    return both, len(flags) - n - both, n - both


def greedy_matches(pdf: pd.DataFrame) -> pd.DataFrame:
    """matched_flags of one job and phase as a pandas frame."""
    own = pdf.sort_values("ord", kind="stable")
    return pd.DataFrame([(pdf.job.iloc[0], pdf.phase.iloc[0], *claimed((own.kind == "flag").tolist(), own.rules.tolist()))], columns=["job", "phase", "both", "lint_only", "flag_only"])


def matched_flags(rows: DataFrame) -> DataFrame:
    """(job, phase, both, lint_only, flag_only): flags of one job and phase in order each claim the first free violation whose rule is among theirs.

    Rows: job, phase, kind (flag or lint), ord, rules (a list). A group is an array in a row, so that a batch holds many of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [claimed(f, r) for f, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["job", "phase", "both", "lint_only", "flag_only"])

    known = text_batches(rows).where(F.col("kind").isin("flag", "lint"))
    groups = known.groupBy("job", "phase").agg(F.sort_array(F.collect_list(F.struct("ord", (F.col("kind") == "flag").alias("flag"), "rules"))).alias("s"))
    lists = groups.select("job", "phase", F.transform("s", lambda x: x["flag"]).alias("flags"), F.transform("s", lambda x: x["rules"]).alias("rules"))
    return lists.mapInArrow(run, f"job {rows.schema['job'].dataType.simpleString()}, phase {rows.schema['phase'].dataType.simpleString()}, both long, lint_only long, flag_only long")
