"""Exact token counts of every prefix of a text, by prefix dynamic programming.

The last token of a prefix decides its encoding: tokens(prefix) = tokens(prefix without its last token) + 1, and of the
vocabulary's tokens that end a prefix just one can stand after the last token of what is before it. So counts of all
prefixes of a word come from one pass over its bytes, without encoding any prefix, whatever its length.

A text is cut where white space follows other characters: no token crosses such a cut, whatever follows. The table of a
text is therefore the tables of its pieces in a row. It is stored as the step from each prefix to the next one character longer,
and answers the whole count, truncation and budget questions by running sums, without re-encoding.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, stage

LIMIT = 512
#: Prefixes of words, and pieces, that a worker remembers at most; then it starts anew.
MEMO, PIECES = 800_000, 300_000
#: Characters of a piece that is remembered.
SHORT = 64
_STEPS = "doc_id long, n_bytes long, width int, steps binary"
_loaded: dict[str, PrefixCounter] = {}
_NO_TAIL = object()
#: One signed byte by its value: negative indexes reach the upper half.
_BYTES = [bytes([i]) for i in range(256)]


def _byte_of() -> dict[str, int]:
    """Byte of each character in which byte-level vocabularies are written: printable ones stand for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix counts under a byte-level pair-merge vocabulary; only cutting into words is asked of the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = _byte_of()
        of = lambda token: bytes(plain[c] for c in token)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = map(of, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank[a, b] = n
            self.parts.setdefault(a + b, (a, b))
        self.made = {t: self.rank[p] for t, p in self.parts.items()}  # when a token is merged; bytes are there from the start
        #: Ends of tokens: whether such an end is itself a token that its bytes are encoded as; None: not known yet.
        self.tails: dict[bytes, bool | None] = {bytes([b]): True for b in range(256)}
        for token in self.parts:
            for i in range(len(token)):
                self.tails.setdefault(token[i:], None)
        self.ends: dict[bytes, list] = {}
        self.starts: dict[bytes, list] = {}
        self.fits_after: dict[bytes, dict[bytes, bool]] = {}
        #: Prefixes of words: (count, last token, steps from each character to the next).
        self.nodes: dict[bytes, tuple[int, bytes, bytes]] = {}
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, special))) if special else None
        space = [c for c in map(chr, range(0x110000)) if c.isspace()]
        space = "".join(c for c in space if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"!{c}")) == 2)
        self.piece = re.compile(rf"[{re.escape(space)}]*[^{re.escape(space)}]+|[{re.escape(space)}]+")
        self.leading = re.compile(rf"[{re.escape(space)}]*")
        self.tables: dict[str, bytes] = {}
        #: Pieces whose words are plain without asking: at most one white space, Latin letters, marks.
        self.simple = re.compile(r"([\n\t]?)((?<![\n\t]) ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[A-Za-z]+)([.,;:!?]*)")

    @classmethod
    def at(cls, path: str) -> PrefixCounter:
        """This worker's counter for the vocabulary file at path."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def encoded(self, texts: list[str]) -> list[int]:
        """Token counts as the library gives them."""
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int, float]]:
        """Tokens that stand at one edge of a token while it is merged: (token, when it comes, when it goes), the last first."""
        out, gone = [], float("inf")
        while True:
            made = self.made.get(token, -1)
            out.append((token, made, gone))
            if made < 0:
                return out
            token, gone = self.parts[token][side], made

    def _apart(self, a: bytes, b: bytes, whole: bool = True) -> bool:
        """Whether no merge joins the end of token a with the start of token b while these are formed; whole: nor a with b.

        Of equal ranks the left merge comes first, so b's own merge at the same rank is too late.
        """
        if a not in self.ends:
            self.ends[a] = self._edge(a, 1)
        if b not in self.starts:
            self.starts[b] = self._edge(b, 0)
        left, right, i, j = self.ends[a], self.starts[b], 0, 0
        while True:
            (x, made_x, gone_x), (y, made_y, gone_y) = left[i], right[j]
            n = self.rank.get((x, y))
            if n is not None and n < gone_x and n <= gone_y and (whole or i or j):
                return False
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                i += 1
            else:
                j += 1

    def _usable(self, token: bytes) -> bool:
        """Whether the token's own bytes are encoded as this one token."""
        known = self.tails.get(token)
        if known is None:
            known = False
            if token in self.parts:
                a, b = self.parts[token]
                known = self._usable(a) and self._usable(b) and self._apart(a, b, whole=False)
            self.tails[token] = known
        return known

    def _node(self, data: bytes, nodes: dict[bytes, tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes]:
        """The node of data, whose own prefixes have nodes: of the tokens that end it, the one that can follow the last token before it."""
        tails, end = self.tails, len(data)
        for at in range(end - 1, -1, -1):
            token = data[at:]
            usable = tails.get(token, _NO_TAIL)
            if usable is _NO_TAIL:
                break
            if usable is None:
                usable = self._usable(token)
            if not usable:
                continue
            if at == 0:
                count = 1
            else:
                count, before, _ = nodes[data[:at]]
                fits = self.fits_after.get(before)
                if fits is None:
                    fits = self.fits_after[before] = {}
                good = fits.get(token)
                if good is None:
                    good = fits[token] = self._apart(before, token)
                if not good:
                    continue
                count += 1
            if end == 1:
                return count, token, b"\x01"
            parent = nodes[data[:-1]]
            return count, token, parent[2] + _BYTES[count - parent[0]]
        raise AssertionError("every byte is a token")

    def _long(self, data: bytes) -> list[int]:
        """Counts of the prefixes of a long word, without a node for each."""
        counts, last = [0], [b""]
        for end in range(1, len(data) + 1):
            for at in range(end - 1, -1, -1):
                token = data[at:end]
                usable = self.tails.get(token, _NO_TAIL)
                if usable is _NO_TAIL:
                    raise AssertionError("every byte is a token")
                if (self._usable(token) if usable is None else usable) and (at == 0 or self._apart(last[at], token)):
                    counts.append(counts[at] + 1)
                    last.append(token)
                    break
        return counts

    def word(self, word: str) -> bytes | None:
        """Steps of the prefixes of one word, by characters; None where a step is beyond a byte."""
        data, nodes = word.encode(), self.nodes
        if len(data) > SHORT:
            counts = self._long(data)
            steps = [b - a for a, b in zip(counts, counts[1:])]  # noqa: B905
            if max(steps) > 127 or min(steps) < -128:
                return None
            out = bytes([x & 255 for x in steps])
        else:
            node = nodes.get(data)
            if node is None:
                if len(nodes) > MEMO:
                    nodes.clear()
                    self.fits_after.clear()
                at = len(data) - 1
                while at and data[:at] not in nodes:
                    at -= 1
                for end in range(at + 1, len(data) + 1):
                    node = nodes[data[:end]] = self._node(data[:end], nodes)
            out = node[2]
        if len(data) != len(word):  # a character's step is the sum of its bytes'
            sums, at = [], 0
            for c in word:
                size = len(c.encode())
                sums.append(sum(out[at : at + size]) & 255)
                at += size
            out = bytes(sums)
        if word[:1] == "'" and len(word) == 3 and word[1:].isascii() and word[1:].isalpha():  # 'll: until it is whole, two words
            out = bytes([1, 1, (_total(out) - 2) & 255])
        return out

    def _piece(self, piece: str) -> bytes | None:
        """Steps of the prefixes of a piece without special strings; None where one is beyond a byte."""
        simple = self.simple.fullmatch(piece)
        if simple:
            return b"".join([self.word(w) for w in simple.groups() if w])
        parts = [self.word(w) for w in self._words(piece)]
        if None in parts:
            return None
        out = b"".join(parts)
        lead = self.leading.match(piece).end()
        if lead > 1:  # white space at a prefix's end is one word
            run = self.word(piece[:lead])
            if run is None:
                return None
            behind = _total(out[: lead + 1]) - _total(run)
            if not -128 <= behind <= 127:
                return None
            out = run + (bytes([behind & 255]) + out[lead + 1 :] if lead < len(piece) else b"")
        return out

    def _plain(self, text: str) -> list[int]:
        """Counts of the prefixes of a text without special strings, the plain way: for texts with a step beyond a byte, or with special strings."""
        out = [0]
        for p in self.piece.findall(text):
            base, own = out[-1], [0]
            for w in self._words(p):
                counts = self._long(w.encode())
                heads = [i for i, b in enumerate(w.encode()) if b & 0xC0 != 0x80]
                counts = [counts[i] for i in [*heads, len(counts) - 1]]
                if w[:1] == "'" and len(w) == 3 and w[1:].isascii() and w[1:].isalpha():
                    counts = [0, 1, 2, counts[-1]]
                own += [own[-1] + x for x in counts[1:]]
            lead = self.leading.match(p).end()
            if lead > 1:
                run = self._long(p[:lead].encode())
                heads = [i for i, b in enumerate(p[:lead].encode()) if b & 0xC0 != 0x80]
                own[1 : lead + 1] = [run[i] for i in [*heads[1:], len(run) - 1]]
            out += [base + x for x in own[1:]]
        return out

    def _words(self, piece: str) -> list[str]:
        return [piece[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]

    def counts(self, text: str) -> list[int]:
        """Counts of the prefixes of a text: special strings are one token, but not before they are whole."""
        out, base, at = [0], 0, 0
        for m in self.specials.finditer(text) if self.specials else ():
            out += [base + x for x in self._plain(text[at : m.end() - 1])[1:]]
            base += self._plain(text[at : m.start()])[-1] + 1
            out.append(base)
            at = m.end()
        return out + [base + x for x in self._plain(text[at:])[1:]]

    def steps(self, text: str) -> tuple[int, bytes]:
        """(width, steps): T(i) - T(i - 1) for i = 1 ... len(text) as integers of width bytes, T the count of the first i characters."""
        if self.specials and self.specials.search(text):
            return self._packed(np.diff(self.counts(text)))
        out, tables = [], self.tables
        for p in self.piece.findall(text):
            table = tables.get(p)
            if table is None:
                table = self._piece(p)
                if table is None:
                    return self._packed(np.diff(self.counts(text)))
                if len(p) <= SHORT:
                    if len(tables) > PIECES:
                        tables.clear()
                    tables[p] = table
            out.append(table)
        return 1, b"".join(out)

    @staticmethod
    def _packed(step: np.ndarray) -> tuple[int, bytes]:
        width = 1 if not len(step) or np.abs(step).max() < 128 else 4
        return width, step.astype(f"<i{width}").tobytes()


def _total(steps: bytes) -> int:
    return sum(x - 256 if x > 127 else x for x in steps)


def running(width: int, steps: bytes) -> np.ndarray:
    """T(0), T(1), ... of a stored table."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64)])


def fitting(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most budget tokens."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, width, steps) of every row of docs: the token counts of all its prefixes, see running().

    A null text counts as empty; repeated rows each have a table; other columns are left out; an empty table gives an
    empty one. path: the vocabulary file, which every executor must have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.at(path)
        for batch in batches:
            size, width, steps = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                w, s = counter.steps(text)
                size.append(len(text.encode()))
                width.append(w)
                steps.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(width, pa.int32()), pa.array(steps, pa.binary())], ["doc_id", "n_bytes", "width", "steps"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _STEPS)


def answers(tables: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every prefix table: fit_chars characters of the longest prefix with at most limit tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [running(w.as_py(), s.as_py()) for w, s in zip(batch.column("width"), batch.column("steps"), strict=True)]
            found = [[int(c[-1]) for c in counts], [fitting(c, limit) for c in counts]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, pa.int64()) for x in found)], ["doc_id", "n_bytes", "n_tokens", "fit_chars"])

    counted = bounded_batches(tables).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, fit_chars long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every row of docs, from its stored prefix table.

    n_tokens is what the library gives for the whole text without added special tokens; special strings inside a
    text count as the library handles them by default. Nulls, repeats, other columns and empty tables as in prefix_tables.
    """
    return answers(stage(prefix_tables(docs, path), "prefix-tables"), limit)
