"""N-gram Jaccard join by a token-group matrix.

Documents become sets of distinct k-word shingles. Equal sets are one class. Classes of similar documents form
groups; the matrix stores, for each token, the groups whose union has it; a query opens only groups whose union
overlaps enough of its tokens, and every opened pair is verified exactly.

Only the first tokens of a set in a global order (rare before frequent) enter the matrix: two sets that link share
at least ``ell`` of their first n - ceil(threshold * n) + ell tokens, so the overlap of a query with a group's union
is a bound that loses no link. One pass of stars around pivots first gives each document its nearest pivot and joins families of
near copies, so that these don't open one another's groups. Groups are parts of large components, and elsewhere of the
documents whose nearest pivot is the same, linked or not; a query opens only groups with members outside its own component. An opened group is answered as a whole: all its overlaps come from
one pass over the query's tokens, and only links that join components are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, small, stage, unstage
from weftline.llm.components import connected_components
from weftline.llm.words import U64, Words, mix, pieces, place, signed

#: Tokens in more documents than a limit go last in the order. The limit is the least power of two that leaves at most MAX_FREQUENT of them.
MAX_FREQUENT, LEAST_LIMIT = 400_000, 64
#: Classes in a group; queries of a group that are answered together.
GROUP, BLOCK = 64, 64
#: Classes from which a component has groups of its own.
OWN_GROUPS = 16
#: Rows of an id table up to which it is broadcast (three longs a row).
MAX_BROADCAST = 500_000
_FULL_ELL, _FULL_FROM = 3, 24


def _ell(n: np.ndarray) -> np.ndarray:
    return np.where(n >= _FULL_FROM, _FULL_ELL, 1)


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of n that enter the matrix."""
    return np.minimum(n, n + (-percent * n) // 100 + _ell(n))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in pieces(batch.column("text")):
                tokens, bounds = Words(texts).sets(k)
                n = np.diff(bounds)
                total = np.concatenate([[U64(0)], np.cumsum(mix(tokens ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
                h = mix(total[bounds[1:]] - total[bounds[:-1]])
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(signed(h), mask=n == 0)], ["doc_id", "n", "h"])

    return run


def _frequencies(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(found), return_counts=True)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(count, pa.int64())], ["token", "df"])

        for batch in batches:
            for _, texts in pieces(batch.column("text")):
                tokens, bounds = Words(texts).sets(k)
                row, rank = place(bounds)
                found.append(tokens[rank < (3 * _prefix(np.diff(bounds), percent) // 2 + 32)[row]])
                if sum(map(len, found)) > 1_000_000:
                    yield counted()
        if found:
            yield counted()

    return run


def _postings(k: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level = frequent.value
        for batch in batches:
            for _, texts in pieces(batch.column("text")):
                tokens, bounds = Words(texts).sets(k)
                n = np.diff(bounds)
                total = np.concatenate([[U64(0)], np.cumsum(mix(tokens ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
                h = signed(mix(total[bounds[1:]] - total[bounds[:-1]]))
                row, _ = place(bounds)
                at = np.minimum(np.searchsorted(often, tokens), max(len(often) - 1, 0))
                late = often[at] == tokens if len(often) else np.zeros(len(tokens), bool)
                most = _prefix(n, percent)
                early = np.concatenate([[0], np.cumsum(~late)])
                rank = early[:-1] - early[bounds[row]]
                take = ~late & (rank < most[row])
                rest = most - (early[bounds[1:]] - early[bounds[:-1]])
                more = np.flatnonzero(late & (rest[row] > 0))
                if len(more):
                    more = more[np.lexsort((tokens[more], level[at[more]], row[more]))]
                    r = row[more]
                    head = np.searchsorted(r, r, side="left")
                    take[more[np.arange(len(more)) - head < rest[r]]] = True
                yield pa.RecordBatch.from_arrays([pa.array(signed(tokens[take])), pa.array(h[row[take]]), pa.array(n[row[take]], pa.int64())], ["token", "h", "n"])

    return run


class _Joined:
    """Components that links have joined so far, inside one block."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def _open(k: int, percent: int):
    """Rows sorted by (cluster, part, block, role): a group's members, then its queries; those of their links that join components not joined before in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, comps, sets, ready, joined = None, [], [], [], None, _Joined()
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "part", "block")), strict=True))
            roles, docs, of = (batch.column(c).to_pylist() for c in ("role", "doc_id", "comp"))
            us, vs = [], []
            for at, texts in pieces(batch.column("text")):
                tokens, bounds = Words(texts).sets(k)
                for i in range(len(texts)):
                    j, own = at + i, tokens[bounds[i] : bounds[i + 1]]
                    if keys[j] != key:
                        key, ids, comps, sets, ready, joined = keys[j], [], [], [], None, _Joined()
                    if roles[j] == 0:
                        ids.append(docs[j])
                        comps.append(of[j])
                        sets.append(own.copy())
                        continue
                    if not ids:
                        continue
                    if ready is None:
                        size = np.array([len(x) for x in sets])
                        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                        order = np.argsort(every, kind="stable")
                        ready = every[order], owner[order], size
                    every, owner, size = ready
                    low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
                    n = high - low
                    hits = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                    both = np.bincount(owner[hits], minlength=len(sets))
                    for m in np.flatnonzero(100 * both >= percent * (size + len(own) - both)).tolist():
                        if joined.join(of[j], comps[m]):
                            us.append(docs[j])
                            vs.append(ids[m])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _opened_links(docs: DataFrame, members: DataFrame, queries: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): links, found on whole sets, of queries (cluster, part, u, comp) to members (cluster, part, rep, comp) of the groups that they open.

    comp is the component that each is known to be in; of links between the same components one is enough. Many
    queries of one group are dealt over blocks of BLOCK.
    """
    load = queries.groupBy("cluster", "part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asked = queries.join(load, ["cluster", "part"]).select(F.col("u").alias("doc_id"), "comp", "cluster", "part", F.pmod(F.xxhash64("u"), F.col("blocks")).alias("block"), F.lit(1).alias("role"))
    own = members.join(load, ["cluster", "part"]).select(F.col("rep").alias("doc_id"), "comp", "cluster", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"))
    needed = stage(asked.unionByName(own), "opened")
    texts = docs.select("doc_id", "text").join(small(needed, MAX_BROADCAST), "doc_id")
    order = ("cluster", "part", "block")
    rows = texts.repartition(*order).sortWithinPartitions(*order, "role")
    links = stage(rows.select(*order, "role", "doc_id", "comp", "text").mapInArrow(_open(k, percent), "u long, v long"), "links")
    unstage(needed)
    return links


def _frequent(docs: DataFrame, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, level): at most MAX_FREQUENT tokens of the most documents, and how frequent each is as a power of two."""
    counts = docs.select("text").mapInArrow(_frequencies(k, percent), "token long, df long")
    counts = counts.groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= LEAST_LIMIT)
    counts = stage(counts.withColumn("level", F.floor(F.log2("df")).cast("int")), "frequent")
    limit, total = 64, 0  # no token has as many as 2**64 documents
    for level, rows in sorted(((r["level"], r["count"]) for r in counts.groupBy("level").count().collect()), reverse=True):
        total += rows
        if total > MAX_FREQUENT:
            break
        limit = level
    rows = counts.where(F.col("level") >= limit).select("token", "level").toPandas()
    unstage(counts)
    token = rows["token"].to_numpy(np.int64).view(U64)
    order = np.argsort(token)
    return token[order], rows["level"].to_numpy(np.int32)[order]


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    Two documents link when 100 * intersection >= percent * union over their sets of distinct k-word shingles,
    A-Z lower-cased; component_id is the smallest doc_id reachable by links, the document itself included.
    A null, empty or wordless text has an empty set and links with nothing; a text with fewer than k words has its whole
    sequence as its one shingle. Rows that repeat a doc_id and text are returned as often as they come. Other columns
    are left out; an empty table gives an empty one. A row with a null doc_id links with nothing and has a null component_id.
    Sets are told apart by a 64-bit hash and their size; all overlaps are counted on whole sets.
    """
    spark = docs.sparkSession
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signs = stage(docs.mapInArrow(_signatures(k), "doc_id long, n long, h long"), "signatures")
    nameless = signs.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    docs, signs = docs.where("doc_id IS NOT NULL"), signs.where("doc_id IS NOT NULL")
    classes = stage(signs.where("n > 0").groupBy("h", "n").agg(F.min("doc_id").alias("rep")), "classes")

    frequent = spark.sparkContext.broadcast(_frequent(docs, k, percent))
    posts = stage(docs.select("text").mapInArrow(_postings(k, percent, frequent), "token long, h long, n long"), "prefixes")
    # tokens of one class alone link nothing; extremes meet before the shuffle, and joins can split a token of many rows
    key = F.struct("n", "h")
    shared = posts.groupBy("token").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select("token")
    every = posts
    posts = posts.join(shared, "token", "left_semi").distinct().join(classes, ["h", "n"])
    posts = stage(posts.select("token", "rep", "n"), "postings")
    unstage(every)

    of_size = lambda a, b: (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)
    need = lambda a, b: F.when(F.least(a, b) >= _FULL_FROM, _FULL_ELL).otherwise(1)
    nodes = stage(posts.groupBy("rep").agg(F.first("n").alias("n")), "nodes")
    pivots = posts.groupBy("token").agg(F.min(F.struct(F.xxhash64("rep").alias("x"), "rep", "n")).alias("p"))
    star = posts.join(pivots, "token").select("rep", "n", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn"))
    star = star.where((F.col("rep") != F.col("pivot")) & of_size("n", "pn")).groupBy("rep", "n", "pivot", "pn").agg(F.count("*").alias("both"))
    star = stage(star.where(F.col("both") >= need("n", "pn")), "star")
    like = stage(star.groupBy("rep").agg(F.max_by("pivot", F.struct("both", -F.col("pivot"))).alias("like")), "like")
    first = F.lit(0).cast("long").alias("part")
    asked = star.select(F.col("pivot").alias("cluster"), first, F.col("rep").alias("u"), F.col("rep").alias("comp"))
    middle = star.select(F.col("pivot").alias("cluster"), first, F.col("pivot").alias("rep"), F.col("pivot").alias("comp")).distinct()
    links = _opened_links(docs, middle, asked, k, percent)
    nodes = _joined(nodes, links)

    nodes = _with_count(nodes, "comp", OWN_GROUPS).join(like, "rep", "left")
    alone = F.col("members").isNotNull()
    nodes = stage(nodes.select("rep", "n", "comp", F.xxhash64(alone, F.when(alone, F.col("comp")).otherwise(F.coalesce("like", "rep"))).alias("cluster")), "clusters")
    parts = F.ceil(F.coalesce("members", F.lit(1)) / GROUP)
    nodes = _with_count(nodes, "cluster", GROUP + 1).withColumn("part", F.pmod(F.xxhash64("rep"), parts))
    nodes = stage(nodes.select("rep", "n", "comp", "cluster", "part"), "groups")
    member = posts.select("token", "rep").join(nodes, "rep")
    mixed = member.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    member = stage(member.join(mixed, "token", "left_semi"), "members")
    matrix = member.groupBy("token", "cluster", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    query = member.select("token", F.col("rep").alias("u"), F.col("n").alias("qn"), F.col("comp").alias("qc"), F.struct("cluster", "part").alias("home"))
    bound = (F.col("home") >= F.struct("cluster", "part")) & ((F.col("c0") != F.col("qc")) | (F.col("c1") != F.col("qc")))
    bound = bound & (F.col("high") * 100 >= F.col("qn") * percent) & (F.col("low") * percent <= F.col("qn") * 100)
    opened = query.join(matrix, "token").where(bound).groupBy("u", "qn", "qc", "cluster", "part").agg(F.count("*").alias("both"), F.min("low").alias("low"))
    opened = stage(opened.where(F.col("both") >= need("qn", "low")).select("u", F.col("qc").alias("comp"), "cluster", "part"), "opened-groups")
    more = _opened_links(docs, nodes.select("cluster", "part", "rep", "comp"), opened, k, percent)
    final = _joined(nodes, links.unionByName(more))

    of_class = stage(classes.join(final.select("rep", "comp"), "rep", "left").select("h", "n", F.coalesce("comp", "rep").alias("component_id")), "of-class")
    unstage(posts, opened, like, member)
    full = signs.where("n > 0").join(of_class, ["h", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = signs.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(none).unionByName(nameless)


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with the component that links give each, staged."""
    found = connected_components(links).withColumnRenamed("node", "rep")
    return stage(nodes.select("rep", "n").join(found, "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("comp")), "nodes")


def _with_count(nodes: DataFrame, key: str, least: int) -> DataFrame:
    """nodes with members, the rows of their key where there are at least so many, else null."""
    counts = nodes.groupBy(key).agg(F.count("*").alias("members")).where(F.col("members") >= least)
    return nodes.join(small(stage(counts, "large"), MAX_BROADCAST), key, "left")


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s), links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT r.d, links.v FROM r JOIN links ON links.u = r.c)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT d, min(c) AS component_id FROM r GROUP BY d) m ON m.d = s.doc_id
"""
