"""Transcript parsing: a hidden Markov model over speaker markers and line features recovers roles by Viterbi.

Each role has two states, the first line of a turn and a later one. Long transcripts are cut into chunks: each
chunk's best-path scores between all pairs of states are one small matrix, the matrices are chained over a
transcript, and the chunks are then decoded between their end states, so the path is that of the whole transcript. Turns
run on over chunks too: how a transcript is cut changes nothing in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, crc_mod, small, stage

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role r: 2r for the first line of a turn, 2r + 1 for later ones
#: Turns of the source in a chunk.
CHUNK = 256
MARKERS = (
    ("system", r"(?i)^\s*(?:system|sys|instructions?)\s*[:>\]]\s*"),
    ("user", r"(?i)^\s*(?:user|human|question|customer|q)\s*[:>\]]\s*"),
    ("assistant", r"(?i)^\s*(?:assistant|bot|answer|agent|model|ai|a)\s*[:>\]]\s*"),
    ("switch", r"^\s*>>+\s*"),
)
N_SYMBOLS = 5 * 2 * 4


def marker(line: Column) -> Column:
    """0 for none, then 1 + place in MARKERS."""
    out = F.lit(0)
    for i in reversed(range(len(MARKERS))):
        out = F.when(line.rlike(MARKERS[i][1]), F.lit(i + 1)).otherwise(out)
    return out


def without_marker(line: Column, role: Column) -> Column:
    """line without the marker of role, or else without the mark of a switch, at its start; other markers are text."""
    own = F.lit("")
    for r, pattern in MARKERS[:-1]:
        own = F.when(role == r, F.regexp_extract(line, pattern, 0)).otherwise(own)
    return F.when(own != "", F.substr(line, F.length(own) + 1)).otherwise(F.regexp_replace(line, MARKERS[-1][1], ""))


def symbol(line: Column) -> Column:
    """Marker kind, whether a question mark ends the line, and its length in four steps, as one number."""
    n = F.length(line)
    size = F.when(n < 40, 0).when(n < 120, 1).when(n < 300, 2).otherwise(3)
    return (marker(line) * 2 + F.trim(line).endswith("?").cast("int")) * 4 + size


def estimate(lines: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, move, emit) log-probabilities from lines with known states (conv_id, chunk, turn, line, state, symbol), counts of one added.

    The pairs of neighbouring lines are counted per chunk of turns by a window; only the counts reach the driver.
    """
    order = Window.partitionBy("conv_id", "chunk").orderBy("turn", "line", "state")
    pairs = lines.withColumn("before", F.lag("state").over(order))
    emit, move, start = np.ones((STATES, N_SYMBOLS)), np.full((STATES, STATES), 0.01), np.full(STATES, 0.01)
    for r in lines.groupBy("state", "symbol").count().collect():
        emit[r["state"], r["symbol"]] += r["count"]
    for r in pairs.groupBy("before", "state").count().collect():
        if r["before"] is None:
            start[r["state"]] += r["count"]
        else:
            move[r["before"], r["state"]] += r["count"]
    return np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(emit / emit.sum(1, keepdims=True))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        new = np.zeros(rows.num_rows, bool)
        for k in keys:
            x = rows.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        heads = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            yield rows.slice(a, b - a)
        held = rows.slice(heads[-1])
    if held is not None and held.num_rows:
        yield held


def _chain(move: np.ndarray, emit: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Best log-probability from each state before the first line to each state at the last."""
    best = move + emit[:, symbols[0]]
    for s in symbols[1:]:
        best = (best[:, :, None] + move[None]).max(1) + emit[:, s]
    return best


def viterbi(enter: np.ndarray, move: np.ndarray, emit: np.ndarray, symbols: np.ndarray, last: int | None = None) -> list[int]:
    """Best states of the lines; enter: scores of the states of the first line. Of equal paths, the one with smaller states from the end."""
    score, back = enter + emit[:, symbols[0]], []
    for s in symbols[1:]:
        step = score[:, None] + move
        back.append(step.argmax(0))
        score = step.max(0) + emit[:, s]
    at = int(score.argmax()) if last is None else last
    path = [at]
    for b in reversed(back):
        at = int(b[at])
        path.append(at)
    return path[::-1]


def parse(lines: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(conv_id, chunk, place, turn, line, text, state, role, opens): lines (conv_id, turn, line, text) with their recovered states.

    A transcript's lines are ordered by turn, line and a hash of the text; place is a line's number in its chunk, opens whether a
    turn starts there: in a first-line state, or at a change of role. A null text counts as empty; repeated rows are lines of their
    own; rows with a null conv_id or turn are left out; an empty table gives an empty one; other columns are left out.
    """
    start, move, emit = model
    rows = bounded_batches(lines).where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", (F.col("turn") / CHUNK).cast("long").alias("chunk"), "turn", "line", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("symbol", symbol(F.col("text")))
    slim = rows.select("conv_id", "chunk", "turn", "line", F.xxhash64("text").alias("tie"), "symbol")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["conv_id", "chunk"]):
            m = _chain(move, emit, g.column("symbol").to_numpy())
            first = (start + emit[:, g.column("symbol")[0].as_py()]).tolist()
            rest = _chain(move, emit, g.column("symbol").to_numpy()[1:]) if g.num_rows > 1 else None
            entry = np.array(first) if rest is None else (np.array(first)[:, None] + rest).max(0)
            yield pa.RecordBatch.from_arrays([g.column("conv_id").slice(0, 1).combine_chunks(), g.column("chunk").slice(0, 1).combine_chunks(), pa.array([m.ravel().tolist()]), pa.array([entry.tolist()])], ["conv_id", "chunk", "m", "entry"])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["conv_id"]):
            ms = [np.array(x).reshape(STATES, STATES) for x in g.column("m").to_pylist()]
            score, back = np.array(g.column("entry")[0].as_py()), []
            for m in ms[1:]:
                step = score[:, None] + m
                back.append(step.argmax(0))
                score = step.max(0)
            ends = [int(score.argmax())]
            for b in reversed(back):
                ends.append(int(b[ends[-1]]))
            ends.reverse()
            yield pa.RecordBatch.from_arrays([g.column("conv_id").combine_chunks(), g.column("chunk").combine_chunks(), pa.array([-1, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())], ["conv_id", "chunk", "enter", "leave"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["conv_id", "chunk"]):
            enter, leave = g.column("enter")[0].as_py(), g.column("leave")[0].as_py()
            states = viterbi(start if enter < 0 else move[enter], move, emit, g.column("symbol").to_numpy(), leave)
            opens = [s % 2 == 0 or before < 0 or before // 2 != s // 2 for before, s in zip([enter, *states], states)]  # noqa: B905
            conv, chunk, *cols = (g.column(c).combine_chunks() for c in ("conv_id", "chunk", "turn", "line", "text"))
            place = pa.array(np.arange(len(states), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([conv, chunk, place, *cols, pa.array(states, pa.int32()), pa.array([ROLES[s // 2] for s in states]), pa.array(opens)], ["conv_id", "chunk", "place", "turn", "line", "text", "state", "role", "opens"])

    in_order = ("conv_id", "chunk", "turn", "line", "tie")
    chained = slim.repartition("conv_id", "chunk").sortWithinPartitions(*in_order).mapInArrow(matrices, "conv_id long, chunk long, m array<double>, entry array<double>")
    ends = stage(chained.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(borders, "conv_id long, chunk long, enter int, leave int"), "borders")
    whole = rows.withColumn("tie", F.xxhash64("text")).join(small(ends, 1_000_000), ["conv_id", "chunk"])
    whole = whole.repartition("conv_id", "chunk").sortWithinPartitions(*in_order)
    return whole.mapInArrow(decode, "conv_id long, chunk long, place long, turn long, line long, text string, state int, role string, opens boolean")


def render(parsed: DataFrame) -> DataFrame:
    """(conv_id, first_turn, first_line, role, n_lines, rendered): the turns of parse() in canonical form.

    A turn that runs on over chunks is one. Its first line loses the marker of its role, or a switch mark; nothing else of
    the text changes but white space around the whole. A turn is one row, however long. Empty tables give empty ones.
    """
    parsed = stage(parsed, "parsed")
    inside = Window.partitionBy("conv_id", "chunk").orderBy("place")
    numbered = parsed.withColumn("nth", F.sum(F.col("opens").cast("int")).over(inside))
    # a chunk's lines before its first opening belong to the last turn that an earlier chunk opens
    chunks = parsed.groupBy("conv_id", "chunk").agg(F.sum(F.col("opens").cast("int")).alias("opened"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("opened") > 0, F.struct("chunk", F.col("opened").alias("nth"))), ignorenulls=True).over(before)
    chunks = stage(chunks.select("conv_id", "chunk", last.alias("open")), "open-turns")
    numbered = numbered.join(small(chunks, 500_000), ["conv_id", "chunk"])
    key = F.when(F.col("nth") > 0, F.struct("chunk", "nth")).otherwise(F.struct(F.col("open.chunk").alias("chunk"), F.col("open.nth").cast("long").alias("nth")))
    text = F.when(F.col("opens"), without_marker(F.col("text"), F.col("role"))).otherwise(F.col("text"))
    turns = numbered.groupBy("conv_id", key.alias("key")).agg(F.sort_array(F.collect_list(F.struct("chunk", "place", "turn", "line", "role", text.alias("text")))).alias("lines"))
    first = F.col("lines")[0]
    body = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    rendered = F.concat(F.lit("<|"), first["role"], F.lit("|>\n"), F.trim(body), F.lit("\n<|end|>\n"))
    return turns.select("conv_id", first["turn"].alias("first_turn"), first["line"].alias("first_line"), first["role"].alias("role"), F.size("lines").cast("long").alias("n_lines"), rendered.alias("rendered"))


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, line, text, role, state): conversations written as raw transcripts, in one of four marker styles by conversation.

    Full names, short names, ">>" at each change of speaker, and names on every other turn only. A null role counts as the
    assistant's, a null text as empty; repeated rows stay; other columns are left out.
    """
    style = crc_mod(F.col("conv_id"), 4)
    label = F.initcap("role")
    brief = F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A").otherwise("Sys")
    named = F.when(style == 0, F.concat(label, F.lit(": "))).when(style == 1, F.concat(brief, F.lit(": "))).when(style == 2, F.lit(">> ")).otherwise(F.when(F.col("turn") % 2 == 0, F.concat(label, F.lit(": "))).otherwise(F.lit("")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"), named.alias("mark"))
    role = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    text = F.when(F.col("line") == 0, F.concat("mark", "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.col("line").cast("long").alias("line"), text.alias("text"), F.coalesce("role", F.lit("assistant")).alias("role"), (2 * role + (F.col("line") > 0).cast("int")).alias("state"))


def recovered_turns(conversations: DataFrame) -> DataFrame:
    """Canonical turns of conversations (conv_id, turn, role, text) written as transcripts.

    The model learns from those whose crc32(conv_id) mod 5 is not 0. Rows with a null conv_id or turn are left out; other
    cases as in transcript_lines(), parse() and render().
    """
    lines = transcript_lines(conversations)
    known = lines.where("conv_id IS NOT NULL AND turn IS NOT NULL").where(crc_mod(F.col("conv_id"), 5) != 0)
    model = estimate(known.select("conv_id", (F.col("turn") / CHUNK).cast("long").alias("chunk"), "turn", "line", "state", symbol(F.col("text")).alias("symbol")))
    return render(parse(lines, model))
