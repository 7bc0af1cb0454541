"""Hidden Markov language model.

Latent states emit word classes: frequent words have a class of their own, other words share one with those of the
same ending, and words never seen in training share the unknown class. Inside a shared class a word has its
share of the class's training count, so the model is a distribution over words. Baum-Welch counts of whole texts are taken
in every partition and summed until the likelihood settles; the scaled forward recursion gives the exact likelihood of a whole text.

Texts are encoded once into blocks with a dictionary each. Only dictionaries meet in the shuffle that counts tokens,
and each block gets the counts of its own words back, so no task or driver ever holds the vocabulary. Tokens are told apart there
by a 64-bit hash and their ending's class. A token has one row for each block of text that it stands in, at most; those of the tokens
that most blocks have get their counts from a bounded table, the others in a join that adaptive execution can split.

The start values come from all training texts too: each has a short vector of its weighted words, and clusters of these vectors, found from sums over
partitions, give each state its first emissions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, crc_mod, stage, unstage
from weftline.llm.words import U64, Words, mix, pieces

STATES = 8
#: Rounds of Baum-Welch at most; they end when a round raises the likelihood by less than this share.
ROUNDS, SETTLED = 6, 0.002
#: Classes of word endings, then the end and the unknown class, then words with a class of their own: those with at least this share of all training
#: tokens (so there are fewer than 1 / OWN_SHARE, at any size of corpus) and this count.
ENDINGS = 2_048
END, UNKNOWN, OWN = ENDINGS, ENDINGS + 1, ENDINGS + 2
OWN_SHARE, OWN_COUNT = 1 / 50_000, 5
#: Tokens whose counts are sent to every task: those in most blocks.
COMMON = 200_000
#: Tokens in a segment: longer texts are several, joined by the products of their steps' matrices.
SEGMENT = 512
#: Steps between two scalings: what a few steps take away is far above the smallest number there is.
SCALED = 8
#: Bytes of text in a block: the more, the fewer dictionary entries meet in the shuffles. Tokens that Baum-Welch works on at once.
BLOCK_BYTES, AT_ONCE = 4_000_000, 200_000
#: Numbers of a text's vector, rounds of their clusters, tokens that a text needs to be told.
VECTOR, CLUSTER_ROUNDS, TELLING = 24, 6, 30
#: Weight of the corpus-wide class shares in each state's emissions, in tokens.
SMOOTH = 500.0
_END_KEY = 0  # with an ending below 0, which no word has
_KIND = (1 << 20) - 1  # what holds a class, below the place in a dictionary


def _endings(words: Words, at: np.ndarray) -> np.ndarray:
    """Class of the last three bytes of the words at these places."""
    out = np.zeros(len(at), U64)
    for back in (1, 2, 3):
        place = words.end[at] - back
        out = out * U64(257) + np.where(place >= words.start[at], words.bytes[np.maximum(place, 0)], 0).astype(U64)
    return (mix(out) % U64(ENDINGS)).astype(np.int32)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        held = np.asarray(batch.column("held_out"))
        for at, texts in pieces(batch.column("text"), BLOCK_BYTES):
            words = Words(texts)
            _, first, code = np.unique(words.hash, return_index=True, return_inverse=True)
            out = held[at : at + len(texts)]
            count = np.bincount(code, ~out[words.row], len(first)).astype(np.int64)
            key = np.append(words.hash[first].view(np.int64), _END_KEY)
            entries = pa.StructArray.from_arrays([pa.array(key), pa.array(np.append(count, np.sum(~out))), pa.array(np.append(_endings(words, first), -1), pa.int32())], ["key", "count", "ending"])
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([batch.column("doc_id").slice(at, len(texts)).to_pylist()], pa.list_(pa.int64())), pa.array([out.tolist()], pa.list_(pa.bool_())),
                pa.array([np.diff(words.bounds).tolist()], pa.list_(pa.int32())), pa.array([code.astype(np.int32).tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), entries),
            ], ["block", "ids", "held", "lengths", "codes", "vocab"])
            block += 1


def _translate(totals, share):
    """Blocks with the counts of their dictionaries -> base scores and class sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, distinct = totals
        for batch in batches:
            for i in range(batch.num_rows):
                place, count = (batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("places", "counts"))
                order = np.argsort(place)
                count = count[order]
                kind = np.where(count == 0, UNKNOWN, place[order] & _KIND)
                inside = np.where(kind < ENDINGS, np.log10(np.maximum(count, 1) / np.maximum(share.value[kind], 1)), 0.0)
                base = np.log10((count + 1) / (tokens + distinct + 1)) if tokens + distinct else np.zeros(len(count))
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.int32)
                lengths = batch.column("lengths").slice(i, 1).flatten().to_numpy().astype(np.int64)
                rows = np.repeat(np.arange(len(lengths)), lengths)
                add = lambda x: np.bincount(rows, x[codes], len(lengths)) + x[-1]  # noqa: E731  and the end
                yield pa.RecordBatch.from_arrays([
                    batch.column("ids").slice(i, 1), batch.column("held").slice(i, 1), batch.column("lengths").slice(i, 1),
                    *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (add(base), add(inside), add((count > 0).astype(float)))),
                    pa.array([kind[codes].astype(np.uint16).tobytes()], pa.binary()),
                    pa.array([int(kind[-1])], pa.int32()),
                ], ["ids", "held", "lengths", "base", "inside", "known", "classes", "end"])

    return run


class Model:
    """start (K), move (K x K), emit (classes x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def _sequences(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(classes with the end after each text, start of each text and the end of all)."""
    lengths = batch.column("lengths").slice(i, 1).flatten().to_numpy().astype(np.int64)
    words = np.frombuffer(batch.column("classes")[i].as_py(), np.uint16)
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.empty(int(bounds[-1]), np.int64)
    ends = np.zeros(len(out), bool)
    ends[bounds[1:] - 1] = True
    out[ends] = batch.column("end")[i].as_py()
    out[~ends] = words
    return out, bounds


def _steps(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments in step order: (order by falling length, offset of each step, place of each packed item).

    Packed items of step t are those of the first offset[t + 1] - offset[t] segments.
    """
    order = np.argsort(-length, kind="stable")
    long = length[order]
    active = np.searchsorted(-long, -np.arange(int(long[0]) if len(long) else 0), side="left")
    offset = np.concatenate([[0], np.cumsum(active)])
    place = np.concatenate([start[order[:n]] + t for t, n in enumerate(active.tolist())]) if len(active) else np.zeros(0, np.int64)
    return order, offset, place


def _segments(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of segments of at most SEGMENT items."""
    n = -(-np.diff(bounds) // SEGMENT)
    text = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = bounds[text] + nth * SEGMENT
    return start, np.minimum(bounds[text + 1] - start, SEGMENT), text


def _transfers(model: Model, classes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, log10 of its scale) of each segment: the product of its steps, from the state before it to its last state."""
    k = len(model.start)
    out, logs = np.empty((len(start), k, k)), np.zeros(len(start))
    for at in range(0, len(start), 4096):
        order, offset, place = _steps(start[at : at + 4096], length[at : at + 4096])
        m, log = np.broadcast_to(np.eye(k), (len(order), k, k)).copy(), np.zeros(len(order))
        for t in range(len(offset) - 1):
            n = int(offset[t + 1] - offset[t])
            x = (m[:n].reshape(n * k, k) @ model.move).reshape(n, k, k)
            np.multiply(x, model.emit[classes[place[offset[t] : offset[t + 1]]]][:, None, :], out=m[:n])
            if t % SCALED == SCALED - 1:
                s = m[:n].sum((1, 2))
                m[:n] /= s[:, None, None]
                log[:n] += np.log10(s)
        out[at + order], logs[at + order] = m, log
    return out, logs


def _heads(model: Model, classes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state distribution at the end, log10 likelihood) of texts' first segments."""
    k = len(model.start)
    order, offset, place = _steps(start, length)
    a, log = np.broadcast_to(model.start, (len(order), k)).copy(), np.zeros(len(order))
    for t in range(len(offset) - 1):
        n = offset[t + 1] - offset[t]
        np.multiply(a[:n] @ model.move if t else a[:n], model.emit[classes[place[offset[t] : offset[t + 1]]]], out=a[:n])
        if t % SCALED == SCALED - 1:
            s = a[:n].sum(1)
            a[:n] /= s[:, None]
            log[:n] += np.log10(s)
    s = a.sum(1)
    a /= s[:, None]
    log += np.log10(s)
    end, logs = np.empty_like(a), np.empty_like(log)
    end[order], logs[order] = a, log
    return end, logs


def expected_counts(model: Model, classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (start, move, emit) of these whole texts and their log-likelihood.

    Forward and backward recursions run over all segments at once; what enters a segment from before and from behind
    comes from the products of its text's other segments, so cuts change nothing.
    """
    k = len(model.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    seg, length, text = _segments(bounds)
    if not len(seg):
        return start, move, emit, 0.0
    head = seg == bounds[text]
    enter, leave = np.tile(model.start, (len(seg), 1)), np.ones((len(seg), k))
    rest = np.flatnonzero(~head)
    if len(rest):
        m, _ = _transfers(model, classes, seg[rest], length[rest])
        whole = np.flatnonzero(head & np.append(~head[1:], False))  # first segments that others follow
        end, _ = _heads(model, classes, seg[whole], length[whole])
        before = dict(zip(whole.tolist(), end, strict=True))
        for j, s in enumerate(rest.tolist()):  # in text order
            enter[s] = a = before.pop(s - 1)
            a = a @ m[j]
            before[s] = a / a.sum()
        for j, s in reversed(list(enumerate(rest.tolist()))):
            x = m[j] @ leave[s]
            leave[s - 1] = x / x.sum()
    order, offset, place = _steps(seg, length)
    kinds = classes[place]
    b = model.emit[kinds]
    first = np.where(head[order, None], model.start, enter[order] @ model.move)
    # scales divide alpha and beta alike, so they may be 1 at most steps
    alpha, scales = np.empty((len(kinds), k)), {}
    for t in range(len(offset) - 1):
        lo, hi = offset[t], offset[t + 1]
        a = first if t == 0 else alpha[offset[t - 1] : offset[t - 1] + hi - lo] @ model.move
        np.multiply(a, b[lo:hi], out=alpha[lo:hi])
        if t % SCALED == 0:
            scales[t] = s = alpha[lo:hi].sum(1, keepdims=True)
            alpha[lo:hi] /= s
    last = alpha[offset[length[order] - 1] + np.arange(len(order))]
    beta = leave[order] / (last * leave[order]).sum(1, keepdims=True)
    gamma = alpha.copy()
    gamma[offset[-2] :] *= beta[: offset[-1] - offset[-2]]
    for t in range(len(offset) - 2, 0, -1):
        lo, hi, before_t = offset[t], offset[t + 1], offset[t - 1]
        x = b[lo:hi] * beta[: hi - lo]
        if t in scales:
            x /= scales[t]
        move += model.move * (alpha[before_t : before_t + hi - lo].T @ x)
        beta[: hi - lo] = x @ model.move.T
        gamma[before_t : offset[t]] *= beta[: offset[t] - before_t]
    gamma /= gamma.sum(1, keepdims=True)
    opening = gamma[: offset[1]]
    start += opening[head[order]].sum(0)
    later = np.flatnonzero(~head[order])
    if len(later):  # from the last token of a segment to the first of the next
        x = b[later] * beta[later] / scales[0][later]
        move += model.move * (enter[order[later]].T @ x)
    for j in range(k):
        emit[:, j] = np.bincount(kinds, gamma[:, j], len(emit))
    whole = np.log(last.sum(1)).sum() + sum(np.log(x).sum() for x in scales.values())
    return start, move, emit, float(whole)


def log10_likelihood(model: Model, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Exact log10 likelihood of each text's classes.

    A text's first segment carries a vector; each later one the product of its steps' matrices, which is then
    applied to the vector: so long texts need no more steps than SEGMENT.
    """
    out = np.zeros(len(bounds) - 1)
    if not len(classes):
        return out
    seg, length, text = _segments(bounds)
    head = seg == bounds[text]
    vector = np.zeros((len(out), len(model.start)))
    vector[text[head]], out[text[head]] = _heads(model, classes, seg[head], length[head])
    rest = np.flatnonzero(~head)
    m, log = _transfers(model, classes, seg[rest], length[rest])
    for j, owner in enumerate(text[rest].tolist()):
        v = vector[owner] @ m[j]
        s = v.sum()
        out[owner] += log[j] + np.log10(s)
        vector[owner] = v / s
    return out


def _train_only(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    classes, bounds = _sequences(batch, i)
    train = ~np.asarray(batch.column("held").slice(i, 1).flatten())
    size = np.diff(bounds)
    return classes[np.repeat(train, size)], np.concatenate([[0], np.cumsum(size[train])])


def _counts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                classes, bounds = _train_only(batch, i)
                cuts = np.unique(np.searchsorted(bounds, np.arange(0, bounds[-1] + AT_ONCE, AT_ONCE)).clip(0, len(bounds) - 1))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    parts = expected_counts(model.value, classes[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                    total = parts if total is None else tuple(x + y for x, y in zip(total, parts, strict=True))
        if total is not None:
            start, move, emit, log = total
            rows = np.concatenate([emit, move, start[None], np.full((1, len(start)), log / len(start))])
            some = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(rows[some, j]) for j in range(rows.shape[1]))], ["at", *(f"s{j}" for j in range(rows.shape[1]))])

    return run


def _directions(shares: np.ndarray) -> np.ndarray:
    """A fixed random direction for each class, rarer ones longer."""
    return (np.random.default_rng(11).standard_normal((len(shares), VECTOR)) * -np.log(np.maximum(shares, 1e-9))[:, None]).astype(np.float32)


def _text_vectors(classes: np.ndarray, bounds: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """One unit vector for each text: the sum of its words' directions; of a text with few words zero."""
    n = np.diff(bounds)
    out = np.zeros((len(n), VECTOR))
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(directions[classes], bounds[:-1][some], axis=0)
    out[n < TELLING] = 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _vectors(directions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = _text_vectors(*_train_only(batch, i), directions.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(v.tolist(), pa.list_(pa.float32()))], ["vector"])

    return run


def _moments(assign, width: int):
    """Sums over vectors: of each cluster (assign gives each vector's, -1 for none) its number, vector and squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            v = batch.column("vector").flatten().to_numpy().astype(float).reshape(-1, width)
            v = v[np.abs(v).sum(1) > 0]
            near = assign(v)
            clusters = int(near.max(initial=0)) + 1
            parts = np.zeros((max(clusters, 0 if total is None else len(total)), 1 + width + width * width))
            for c in range(clusters):
                own = v[near == c]
                parts[c] = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
            if total is not None:
                parts[: len(total)] += total
            total = parts
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at // total.shape[1]), pa.array(at % total.shape[1]), pa.array(total.ravel()[at])], ["cluster", "at", "sum"])

    return run


def _summed(vectors: DataFrame, assign, clusters: int) -> np.ndarray:
    out = np.zeros((clusters, 1 + VECTOR + VECTOR * VECTOR))
    rows = vectors.mapInArrow(_moments(assign, VECTOR), "cluster long, at long, sum double")
    for r in rows.groupBy("cluster", "at").agg(F.sum("sum").alias("sum")).collect():
        out[r["cluster"], r["at"]] = r["sum"]
    return out


def _nearest(centres: np.ndarray):
    return lambda v: (v @ centres.T).argmax(1) if len(v) else np.zeros(0, np.int64)


def _cluster_counts(directions, centres: np.ndarray, states: int):
    """(at, state, n): classes of the texts of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(directions.value), states))
        for batch in batches:
            for i in range(batch.num_rows):
                classes, bounds = _train_only(batch, i)
                v = _text_vectors(classes, bounds, directions.value)
                near, told = _nearest(centres)(v), np.abs(v).sum(1) > 0
                own = np.repeat(np.where(told, near, -1), np.diff(bounds))
                total += np.bincount(classes[own >= 0] * states + own[own >= 0], minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    return run


def _with_unknown(emit: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Emissions whose unknown class has its corpus-wide share in every state: training never meets it."""
    emit = emit.copy()
    emit[UNKNOWN] = 0
    emit *= (1 - shares[UNKNOWN]) / emit.sum(0)
    emit[UNKNOWN] = shares[UNKNOWN]
    return emit


def _seed(coded: DataFrame, states: int, shares: np.ndarray) -> Model:
    """States from clusters of all training texts; a state keeps to itself at first.

    Clusters begin as the sign patterns of the first principal directions of all vectors; where vectors don't part, states
    begin near to each other.
    """
    sent = coded.sparkSession.sparkContext.broadcast(_directions(shares))
    vectors = stage(coded.mapInArrow(_vectors(sent), "vector array<float>"), "text-vectors")
    n, total, squares = np.split(_summed(vectors, lambda v: np.zeros(len(v), np.int64), 1)[0], [1, 1 + VECTOR])
    emit = np.repeat(shares[:, None], states, 1)
    if n[0] >= states:
        mean = total / n[0]
        _, axes = np.linalg.eigh(squares.reshape(VECTOR, VECTOR) / n[0] - np.outer(mean, mean))
        bits = max(1, (states - 1).bit_length())
        axes = axes[:, ::-1][:, :bits]
        sums = _summed(vectors, lambda v: ((v - mean) @ axes > 0) @ (1 << np.arange(bits)) % states, states)
        for _ in range(CLUSTER_ROUNDS):
            centres = np.where(sums[:, :1] > 0, sums[:, 1 : 1 + VECTOR], mean)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
            sums = _summed(vectors, _nearest(centres), states)
        counts = np.zeros(emit.size)
        for r in coded.mapInArrow(_cluster_counts(sent, centres, states), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["at"]] = r["n"]
        counts = counts.reshape(emit.shape)
        emit = (counts + 1000 * shares[:, None]) / (counts.sum(0) + 1000)
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    unstage(vectors)
    return Model(np.full(states, 1 / states), move, _with_unknown(emit, shares))


def _updated(rows, states: int, shares: np.ndarray) -> tuple[Model, float]:
    """The model that expected counts make, and the log-likelihood under the one before it."""
    table = np.zeros((len(shares) + states + 2, states))
    table[rows["at"].to_numpy()] = rows[[f"s{j}" for j in range(states)]].to_numpy()
    emit, move, start = table[: len(shares)], table[len(shares) : -2] + 0.1, table[-2] + 0.1
    emit = _with_unknown((emit + SMOOTH * shares[:, None]) / (emit.sum(0) + SMOOTH), shares)
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit), float(table[-1].sum())


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Words are lower-cased in A-Z; each text ends with one end token. Training uses every row whose crc32(doc_id as
    text) mod 7 is not 2 (a null doc_id trains). base_score is the add-one unigram score, score the model's log10
    probability of the whole text. A null or empty text is the end token alone; repeated rows count and are
    scored as often as they come; other columns are left out; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out")
    schema = "block long, ids array<long>, held array<boolean>, lengths array<int>, codes binary, vocab array<struct<key:long,count:long,ending:int>>"
    blocks = stage(bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(_encode, schema), "blocks")

    entries = blocks.select("block", F.posexplode("vocab").alias("nth", "v")).select("block", "nth", "v.key", F.col("v.count").alias("own"), "v.ending")
    counted = stage(entries.groupBy("key", "ending").agg(F.sum("own").alias("count"), F.count("*").alias("blocks")), "token-counts")
    known = counted.where("count > 0")
    tokens, distinct, texts = known.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("ending") < 0, F.col("count"))), F.lit(0))).first()
    words = known.where("ending >= 0")
    # fewer than 1 / OWN_SHARE rows
    top = words.where(F.col("count") >= max(OWN_COUNT, tokens * OWN_SHARE)).orderBy(F.desc("count"), "key", "ending").select("key", "ending", "count").toPandas()
    tops = spark.createDataFrame([(int(k), int(e), i) for i, (k, e) in enumerate(zip(top["key"], top["ending"], strict=True))], "key long, ending int, top int")
    mass = np.zeros(OWN + len(top))
    mass[OWN:] = top["count"].to_numpy()
    for r in words.join(F.broadcast(tops), ["key", "ending"], "left_anti").groupBy("ending").agg(F.sum("count").alias("n")).collect():
        mass[r["ending"]] = r["n"]
    mass[END] = texts
    shares = (mass + 0.0) / max(tokens + 1, 1)
    shares[UNKNOWN] = 1 / (tokens + distinct + 1)
    shares = np.maximum(shares, 1e-12)
    shares /= shares.sum()

    kind = F.coalesce(F.col("top") + OWN, F.when(F.col("ending") < 0, F.lit(END)).otherwise(F.col("ending")))
    # two numbers a token: its class and its count, and for an entry its place with the class
    told = counted.join(F.broadcast(tops), ["key", "ending"], "left").select("key", "ending", kind.alias("kind"), "count", "blocks")
    size = F.floor(F.log2("blocks") * 16)
    held, least = 0, 1 << 30
    for r in sorted(told.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > COMMON:
            break
        least = r["size"]
    common = stage(told.where(size >= least).select("key", "ending", F.struct("kind", "count").alias("told")), "common-tokens")
    sent = entries.drop("own").join(F.broadcast(common), ["key", "ending"], "left")
    rest = told.select("key", "ending", F.struct("kind", "count").alias("told")).join(F.broadcast(common.select("key", "ending")), ["key", "ending"], "left_anti")
    # every entry is told: by the common tokens, or by the others
    rare = sent.where("told IS NULL").drop("told").join(stage(rest, "other-tokens"), ["key", "ending"])
    place = F.shiftleft(F.col("nth").cast("long"), 20) + F.col("told.kind")
    named = sent.where("told IS NOT NULL").unionByName(rare.select(*sent.columns)).select("block", place.alias("place"), F.col("told.count").alias("count"))
    looked_up = named.groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("count").alias("counts"))
    joined = blocks.select("block", "ids", "held", "lengths", "codes").join(looked_up, "block").drop("block")
    fields = "ids array<long>, held array<boolean>, lengths array<int>, base array<double>, inside array<double>, known array<double>, classes binary, end int"
    coded = stage(joined.mapInArrow(_translate((tokens, distinct), spark.sparkContext.broadcast(mass)), fields), "coded")
    unstage(blocks, counted)

    model = _seed(coded, states, shares)
    columns = [f"s{j}" for j in range(states)]
    before = None
    for _ in range(rounds):
        counts = coded.mapInArrow(_counts(spark.sparkContext.broadcast(model)), "at long, " + ", ".join(f"{c} double" for c in columns))
        model, log = _updated(counts.groupBy("at").agg(*(F.sum(c).alias(c) for c in columns)).toPandas(), states, shares)
        if before is not None and log - before < SETTLED * abs(before):
            break
        before = log
    final = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                flat = lambda c, i=i, batch=batch: batch.column(c).slice(i, 1).flatten()
                score = log10_likelihood(final.value, *_sequences(batch, i)) + flat("inside").to_numpy()
                n = flat("lengths").to_numpy().astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([flat("ids"), flat("held"), pa.array(n), pa.array(flat("known").to_numpy().astype(np.int64)), pa.array(np.full(len(n), tokens)), flat("base"), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
