"""Full-text search: postings, BM25, snippets.

k1 and b are the published defaults 1.2 and 0.75. Postings are a plain table that can be written partitioned by term.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(docs: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
    """(term, doc_id, tf, positions) of lower-case ASCII words and numbers of documents (doc_id, text); only of terms, where given, before anything is shuffled."""
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)).alias("pos", "term"))
    if terms is not None:
        words = words.where(F.col("term").isin(*terms))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.regexp_count(F.lower("text"), F.lit("[a-z0-9]+")).cast("long").alias("len"))


def matching(index: DataFrame, every: Sequence[str] = (), some: Sequence[str] = (), none: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """doc_id of documents with every term, any of some, none of none, and a word that starts with prefix."""
    hit = lambda term: F.count_if(F.col("term") == term) > 0
    wanted = F.col("term").isin(*every, *some, *none)
    tests = [hit(t) for t in every] + [~hit(t) for t in none]
    if some:
        tests.append(F.count_if(F.col("term").isin(*some)) > 0)
    if prefix:
        wanted |= F.startswith(F.col("term"), F.lit(prefix))
        tests.append(F.count_if(F.startswith(F.col("term"), F.lit(prefix))) > 0)
    flags = index.where(wanted).groupBy("doc_id").agg(*(t.alias(f"t{i}") for i, t in enumerate(tests)))
    for i in range(len(tests)):
        flags = flags.where(f"t{i}")
    return flags.select("doc_id")


def phrase(index: DataFrame, words: Sequence[str]) -> DataFrame:
    """doc_id of documents where these words follow one another: positions, moved to the first word, meet."""
    parts = None
    for i, w in enumerate(words):
        own = index.where(F.col("term") == w).select("doc_id", F.transform("positions", lambda p: p - i).alias("own"))  # noqa: B023
        both = None if parts is None else parts.join(own, "doc_id").select("doc_id", F.array_intersect("at", "own").alias("at")).where(F.size("at") > 0)
        parts = own.withColumnRenamed("own", "at") if both is None else both
    return parts.select("doc_id").distinct()


def near(index: DataFrame, a: str, b: str, within: int = 10) -> DataFrame:
    """doc_id of documents where a and b stand at most within words apart: in order of place, the closest such two are neighbours."""
    of = lambda t, name: index.where(F.col("term") == t).select("doc_id", F.transform("positions", lambda p: F.struct(p.alias("p"), F.lit(name).alias("t"))).alias(name))
    both = of(a, "a").join(of(b, "b"), "doc_id").select("doc_id", F.array_sort(F.concat("a", "b")).alias("s"))
    near_by = F.exists(F.transform("s", lambda x, i: F.struct(x.alias("x"), F.get("s", i + 1).alias("y"))), lambda z: (z["x"]["t"] != z["y"]["t"]) & (z["y"]["p"] - z["x"]["p"] <= within))
    return both.where(near_by).select("doc_id")


def bm25(docs: DataFrame, terms: Sequence[str], k: int, offset: int = 0) -> DataFrame:
    """(doc_id, score): one page of documents with any of terms, the best first, ties by doc_id."""
    of = postings(docs, terms).select("term", "doc_id", "tf")
    size = lengths(docs)
    corpus = size.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    seen = of.groupBy("term").agg(F.count("*").alias("df"))
    rows = of.join(F.broadcast(seen), "term").join(size, "doc_id").crossJoin(F.broadcast(corpus))  # one row a term; one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return rows.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "doc_id").offset(offset).limit(k)


def snippet(text, terms: Sequence[str], width: int = 32):
    """About width words around the first of terms."""
    words = F.split(text, r"\s+")
    place = F.coalesce(F.array_min(F.array(*(F.nullif(F.array_position(F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", "")), t), F.lit(0)) for t in terms))), F.lit(1))
    start = F.greatest(F.lit(1).cast("long"), place - width // 2).cast("int")
    return F.array_join(F.slice(words, start, F.lit(width)), " ")
