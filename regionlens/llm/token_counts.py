"""Token counts by a finite-state transducer compiled from the vocabulary of a BPE tokenizer.

Merging by priority has a local form: a text's pieces are right exactly when every two
neighbours are, and the last piece of every prefix can be found from the last pieces of shorter prefixes.
A state is therefore small: for each of the last places from which a vocabulary
piece may still run on, the last piece of the prefix that ends there.  Reading a character
leads to one other state and changes the number of pieces by a fixed amount, which annotates the transition.
States and transitions are compiled when a text first needs them and kept in tables of
bounded size, as deterministic automata of regular expressions are.

No piece has a blank mark behind another character and none holds a line end, so a blank that follows a
non-blank, a line end, and what follows a line end are read from the start state.
The stretch between two such cuts is a path from the start state to itself; its sum is kept as one composed arc.
A chunk of text is then a map: its open head, the sum between its first and last cut, its open tail.  Heads and
tails are lists of pieces of the text, never copies of more than one.  Maps compose associatively, so the map of a
long text is a tree over those of its chunks; the pieces of a stretch without a cut are read one after the other from the state
that the one before leads to.
"""

from __future__ import annotations

import gc
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from regionlens.llm.text import utf8

MARK = "▁"  # stands for a blank in the vocabulary
CHUNK = 1 << 16  # characters of one chunk
LIMIT = 4096
MOST_ARCS = 900_000  # compiled arcs before the tables start anew
MOST_STRETCHES = 200_000  # composed arcs of each of two generations
KEPT = 64  # characters of a stretch whose arc is kept
STRETCH = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


class Transducer:
    """Counts the pieces of a byte-fallback BPE vocabulary, left to right."""

    def __init__(self, scores: dict[str, float], most_arcs: int = MOST_ARCS):
        if any(a != MARK and b == MARK for p in scores for a, b in zip(p, p[1:])):
            raise ValueError("a piece holds a blank behind another character")
        if any("\n" in p for p in scores):
            raise ValueError("a piece holds a line end")
        self.scores = scores
        self.starts = {p[:n] for p in scores for n in range(1, len(p) + 1)}  # beginnings of pieces
        self.most_arcs = most_arcs
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple] = {}
        self.ways: dict[str, tuple] = {}
        self._forget()

    @classmethod
    def load(cls, path: str) -> Transducer:
        """The normal pieces of a sentencepiece model; its byte and control pieces never merge."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = (
            i
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        )
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in normal})

    def _forget(self) -> None:
        # State 0 is the start: nothing open, nothing counted.
        start = ("", ((None, 0),))
        self.states: dict[tuple, int] = {start: 0}
        self.content: list[tuple] = [start]
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]  # of each state: character, next state, change
        self.n_arcs = 0
        self.stretches: dict[str, int] = {}
        self.older: dict[str, int] = {}  # the generation before

    def _edges(self, piece: str) -> tuple[list, list, bool]:
        """How the outer symbols of a piece form: ``(symbol, level)`` at its left and right edge.

        Merging takes the best score first, then the leftmost.  The level is the lowest score used
        so far, which orders the merges of two neighbouring pieces in time.  Last: whether the
        piece is reached at all.
        """
        if (found := self.edges.get(piece)) is None:
            parts, level = list(piece), math.inf
            left, right = [(parts[0], level)], [(parts[-1], level)]
            while len(parts) > 1:
                best = max(
                    ((s, -i) for i in range(len(parts) - 1) if (s := self.scores.get(parts[i] + parts[i + 1])) is not None),
                    default=None,
                )
                if best is None:
                    break
                level, i = min(level, best[0]), -best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if i == 0:
                    left.append((parts[0], level))
                if i == len(parts) - 1:
                    right.append((parts[-1], level))
            found = self.edges[piece] = left, right, len(parts) == 1
        return found

    def _fits(self, a: str, b: str) -> bool:
        """Whether two pieces stay as they are side by side: no merge over the seam comes in time."""
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= self.most_arcs:
                self.pairs.clear()
            found = self.pairs[a, b] = self._seam_holds(self._edges(a)[1], self._edges(b)[0])
        return found

    def _seam_holds(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            over = self.scores.get(left[i][0] + right[j][0])
            next_left = left[i + 1][1] if i + 1 < len(left) else -math.inf
            next_right = right[j + 1][1] if j + 1 < len(right) else -math.inf
            if over is not None and over > next_left and over >= next_right:
                return False
            if next_left == next_right == -math.inf:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def _ways(self, text: str) -> tuple[list, str, list]:
        """What an open text allows: pieces that may end it, what of it stays open, which places to hold.

        Places count from the front of what the state before holds: one for each end of its open
        text that begins a piece, longest first, and one for the empty end.
        """
        if (found := self.ways.get(text)) is None:
            ends = [n for n in range(len(text), 0, -1) if n == 1 or text[len(text) - n : -1] in self.starts]
            pieces = [(at, last) for at, n in enumerate(ends) if (last := text[-n:]) in self.scores and self._edges(last)[2]]
            held = [(at, n) for at, n in enumerate(ends) if text[-n:] in self.starts]
            found = self.ways[text] = pieces, text[-held[0][1] :] if held else "", [at for at, _ in held]
        return found

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """The arc from ``state`` under ``char``: next state and change of the count.

        The content of a state is ``(open, places)``: the longest end of the text that begins a piece,
        and for each place a piece may run on from the last piece of the prefix up to there and the
        count of that prefix, relative to the whole.
        """
        tail, places = self.content[state]
        pieces, keep, held = self._ways(tail + char)
        for at, last in pieces:
            before, count = places[at]
            if before is None or self._fits(before, last):
                piece, count = last, count + 1
                break
        else:  # no piece for the character: it becomes bytes, and nothing runs over it
            piece, count, keep, held = None, places[-1][1] + len(utf8(char)), "", ()
        content = keep, (*[(p, c - count) for p, c in [places[at] for at in held]], (piece, 0))
        self.arcs[state][char] = arc = (self._state(content), count)
        self.n_arcs += 1
        return arc

    def _state(self, content: tuple) -> int:
        to = self.states.get(content)
        if to is None:
            to = self.states[content] = len(self.content)
            self.content.append(content)
            self.arcs.append({})
        return to

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """The state that ``text`` leads to from a state, and the pieces added on the way."""
        if self.n_arcs >= self.most_arcs:
            content = self.content[state]
            self._forget()
            state = self._state(content)
        found, arcs = 0, self.arcs
        for char in text:
            state, change = arcs[state].get(char) or self._compile(state, char)
            found += change
        return state, found

    def stretch(self, parts: tuple[str, ...]) -> int:
        """Pieces of the text between two cuts, which is a path from the start; given in parts."""
        if len(parts) != 1 or len(parts[0]) > KEPT:
            state = found = 0
            for part in parts:
                for at in range(0, len(part), CHUNK):
                    state, more = self.run(part[at : at + CHUNK], state)
                    found += more
            return found
        text = parts[0]
        found = self.stretches.get(text)
        if found is None and (found := self.older.get(text)) is not None:
            self.stretches[text] = found
        if found is None:
            if len(self.stretches) >= MOST_STRETCHES:
                self.stretches, self.older = {}, self.stretches
            found = self.stretches[text] = self.run(text)[1]
        return found

    def chunk_map(self, chunk: str) -> ChunkMap:
        parts = STRETCH.findall(chunk)
        if len(parts) < 2:
            return ChunkMap((chunk,) if chunk else (), 0, (), False)
        inner = parts[1:-1]
        counts = list(map(self.stretches.get, inner))
        if None in counts:
            counts = [self.stretch((p,)) if n is None else n for p, n in zip(inner, counts)]
        return ChunkMap((parts[0],), sum(counts), (parts[-1],), True)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks."""
        if not a.head:
            return b
        if not b.head:
            return a
        left = a.tail if a.cut else a.head
        first, last = b.head[0][0], left[-1][-1]
        if first == "\n" or last == "\n" or (first == MARK and last != MARK):  # the seam is a cut
            inner = (a.inner + self.stretch(left) if a.cut else 0) + (self.stretch(b.head) + b.inner if b.cut else 0)
            return ChunkMap(a.head, inner, b.tail if b.cut else b.head, True)
        seam = left + b.head
        if a.cut and b.cut:
            return ChunkMap(a.head, a.inner + self.stretch(seam) + b.inner, b.tail, True)
        if a.cut:
            return ChunkMap(a.head, a.inner, seam, True)
        return ChunkMap(seam, b.inner, b.tail, b.cut)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """The map of all chunks: neighbours are composed, then neighbours of these, until one is left."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Pieces of a text with a blank put in front, none for an empty text."""
        if not text:
            return 0
        starts = range(0, len(text), chunk)
        maps = [self.chunk_map((MARK if i == 0 else "") + text[i : i + chunk].replace(" ", MARK)) for i in starts]
        whole = self.scan(maps)
        return self.stretch(whole.head) + whole.inner + (self.stretch(whole.tail) if whole.cut else 0)


@dataclass(frozen=True)
class ChunkMap:
    head: tuple[str, ...]  # up to the first cut, in parts; all of a chunk without cut
    inner: int  # pieces between the first and the last cut
    tail: tuple[str, ...]  # behind the last cut
    cut: bool


_LOADED: dict[str, Transducer] = {}  # one per worker process and model


def counter(path: str):
    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _LOADED:
            _LOADED[path] = Transducer.load(path)
        machine = _LOADED[path]
        for texts in batches:
            gc.disable()  # the tables hold no cycles, and walking them over and over costs a third of the time
            counts = [machine.count(t) if t else 0 for t in texts]
            gc.enable()
            yield pd.Series(counts, dtype="int64")

    return count


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``path`` is a sentencepiece BPE model without text normalisation; it must be readable on all executors.
    NULL counts as empty: no bytes, no tokens.  Repeated rows each get a row, NULL ids
    stay NULL, other columns are ignored, an empty table gives an empty one.  There is no shuffle.  A very long
    text is read in chunks, one after the other where it has no blanks or line ends, and takes a few times its own size in memory.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return out.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        counter(path)(F.col("text")).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
