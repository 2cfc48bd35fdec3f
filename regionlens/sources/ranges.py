"""Records that go over line ends, from files that many tasks read in byte ranges.

A first scan reports for every byte range in which state it ends, for each state it may begin in: inside or
outside quotes, and for JSON how deep.  Following these reports range by range fixes the state every range
really begins in; there are as many as tasks.  The second scan cuts the records.  Pieces of a record that goes over the
end of a range are put together by the range it began in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.functions.materialize import written

Place = tuple[str, int]  # file and start of a byte range

class RecordCutter:
    """State of a scan; ``depth`` is how deep the next byte lies, ``inside`` whether it lies inside quotes.

    Fed piece by piece it yields records and parts of records: the text, whether it began in this range, and whether it ended.
    """

    separator = b"\n"

    def __init__(self, inside: bool, depth: int = 0, base: int = 0):
        self.inside, self.depth, self.base = inside, depth, base
        self.held: list[bytes] = []
        self.begun = False  # whether what is held began in this range

    def feed(self, piece: bytes) -> Iterator[tuple[bytes, bool, bool]]:
        raise NotImplementedError

    def rest(self) -> Iterator[tuple[bytes, bool, bool]]:
        if self.held:
            yield b"".join(self.held), self.begun, False


class CsvCutter(RecordCutter):
    """Lines; a field that begins with a quote goes on to the next single quote."""

    def feed(self, piece: bytes) -> Iterator[tuple[bytes, bool, bool]]:
        if not self.inside:
            self.begun = True
        self.inside = ends_inside(piece, self.inside)
        self.held.append(piece if not self.inside else piece + b"\n")
        if not self.inside:
            yield b"".join(self.held), self.begun, True
            self.held = []


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a CSV line that begins inside quotes or not ends inside quotes."""
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            while at >= 0 and line[at + 1 : at + 2] == b'"':
                at = line.find(b'"', at + 2)
            if at < 0:
                return True
            # What follows the quote up to the next separator belongs to the field.
            at = line.find(b",", at + 1) + 1
            if not at:
                return False
            inside = line[at : at + 1] == b'"'
        elif at == 0 and line[:1] == b'"':
            inside = True
        else:
            at = line.find(b',"', at) + 1
            if not at:
                return False
            inside = True
        at += inside


# Nothing is tried twice: what lies between two marks, whole strings among it, is passed in one go.
STRING = rb'[^"\\]*+(?:\\.[^"\\]*+)*+"'
JSON_MARKS = re.compile(rb'(?:[^"{}\[\]]++|"' + STRING + rb')*+(["{}\[\]])', re.DOTALL)
JSON_CLOSE = re.compile(STRING, re.DOTALL)


class JsonCutter(RecordCutter):
    """Objects at depth ``base``: 1 in files whose top level is an array, else 0.  Pieces end before a closing brace."""

    separator = b"}"

    def __init__(self, inside: bool, depth: int = 0, base: int = 0):
        super().__init__(inside, depth, base)
        self.lowest = depth

    def feed(self, piece: bytes) -> Iterator[tuple[bytes, bool, bool]]:
        # The brace behind the last piece of a file may not be there; at depth 0 it closes nothing.
        piece += b"}"
        at = begin = 0
        if self.inside:
            end = JSON_CLOSE.match(piece)
            if end is None:
                if self.depth > self.base:
                    self.held.append(piece)
                return
            at, self.inside = end.end(), False
        for mark in JSON_MARKS.finditer(piece, at):
            c = mark.group(1)
            if c in b"{[":
                if c == b"{" and self.depth == self.base:
                    begin, self.begun = mark.start(1), True
                self.depth += 1
            elif c in b"}]":
                was, self.depth = self.depth, max(0, self.depth - 1)
                self.lowest = min(self.lowest, self.depth)
                if c == b"}" and was == self.base + 1:
                    yield b"".join([*self.held, piece[begin : mark.end()]]), self.begun, True
                    self.held, self.begun, begin = [], False, mark.end()
            elif c == b'"':  # a string that goes on in the next piece
                self.inside = True
                break
        if self.depth > self.base:
            self.held.append(piece[begin:])


@dataclass(frozen=True)
class Start:
    """How a byte range begins, and the range in which the record began that it begins in."""

    inside: bool
    depth: int
    base: int
    owner: int


def _pieces(spark: SparkSession, paths: Sequence[str], separator: bytes) -> DataFrame:
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.option("lineSep", separator.decode()).text([*paths])
    return lines.select(file.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Place, list[bytes], bool]]:
    """Pieces of a task by byte range; the flag says that a range begins.  Ranges come one after the other."""
    now: Place | None = None
    for batch in batches:
        files, starts, values = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        number, start = files.dictionary_encode().indices.to_numpy(), starts.to_numpy()
        cuts = (np.flatnonzero((number[1:] != number[:-1]) | (start[1:] != start[:-1])) + 1).tolist()
        for begin, end in zip([0, *cuts], [*cuts, len(values)]):
            if begin < end:
                place = (files[begin].as_py(), starts[begin].as_py())
                yield place, values[begin:end], place != now
                now = place


def _reports(kind: type[RecordCutter]):
    """For each byte range and either beginning: its end, how far it goes down and up, and the first mark of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutters, first = None, [], b""

        def row() -> pa.RecordBatch:
            # Depths count from far above, so that a range may climb out of what it began in.
            values = [(c.inside, c.depth - DEEP, getattr(c, "lowest", DEEP) - DEEP, c.begun) for c in cutters]
            columns = [pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([first], pa.binary())]
            names = ["file", "start", "first"]
            for side, (inside, delta, lowest, begun) in zip(("out", "in"), values):
                columns += [pa.array([inside]), pa.array([delta], pa.int64()), pa.array([lowest], pa.int64()), pa.array([begun])]
                names += [f"{side}_inside", f"{side}_delta", f"{side}_lowest", f"{side}_begun"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for place, values, new in _ranges(batches):
            if new:
                if cutters:
                    yield row()
                now, first = place, b""
                cutters = [kind(inside, DEEP, DEEP) for inside in (False, True)]
            for value in values:
                first = first or value.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
                for c in cutters:
                    for _ in c.feed(value):
                        pass
                    # Only states are wanted.
                    c.held = c.held[:1] and [b""]
        if cutters:
            yield row()

    return run


DEEP = 1 << 40
REPORT = "file string, start long, first binary, " + ", ".join(f"{s}_inside boolean, {s}_delta long, {s}_lowest long, {s}_begun boolean" for s in ("out", "in"))


def starts(reports: list, nested: bool) -> dict[Place, Start]:
    """How every byte range begins, from the reports of all ranges of its file before it."""
    out: dict[Place, Start] = {}
    file, inside, depth, base, owner = None, False, 0, 0, 0
    for r in sorted(reports, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, inside, depth, owner = r["file"], False, 0, r["start"]
            base = 1 if nested and bytes(r["first"]) == b"[" else 0
        out[file, r["start"]] = Start(inside, depth, base, owner)
        side = "in" if inside else "out"
        if nested:
            # If the range came back to the records' depth, what is open at its end began in it.
            if depth <= base or depth + r[f"{side}_lowest"] <= base:
                owner = r["start"]
            depth = max(0, depth + r[f"{side}_delta"])
        elif not inside or r[f"{side}_begun"]:
            owner = r["start"]
        inside = r[f"{side}_inside"]
    return out


def _cut(kind: type[RecordCutter], known: dict[Place, Start]):
    """``file, start, row, whole, text``: whole records in the order of the range, parts under the range their record began in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, n = None, None, 0
        rows: list[tuple] = []

        def add(found: Iterator[tuple[bytes, bool, bool]]) -> None:
            nonlocal n
            for text, begun, ended in found:
                n += 1
                whole = begun and ended
                rows.append((now[0], now[1] if begun else known[now].owner, n if begun else LATE, whole, now[1], text))

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "start", "row", "whole", "part", "text"])
            rows.clear()
            return made

        for place, values, new in _ranges(batches):
            if new:
                if cutter is not None:
                    add(cutter.rest())
                now, n = place, 0
                begin = known[place]
                cutter = kind(begin.inside, begin.depth, begin.base)
            for value in values:
                add(cutter.feed(value))
                if len(rows) >= 1000:
                    yield batch()
        if cutter is not None:
            add(cutter.rest())
        if rows:
            yield batch()

    return run


LATE = 1 << 60  # a record that goes over the end of a range is the last of that range
CUT = "file string, start long, row long, whole boolean, part long, text binary"


def records(spark: SparkSession, paths: Sequence[str], kind: type[RecordCutter]) -> DataFrame:
    """``file, start, row, text``: every record of the files, with its place in them.

    Files are read twice, in byte ranges by many tasks where their compression allows it, and the records are written once.
    The driver sees one short report for each range.
    """
    pieces = _pieces(spark, paths, kind.separator)
    known = starts(pieces.mapInArrow(_reports(kind), REPORT).collect(), kind is JsonCutter)
    # Written, because the parts are looked for beside the whole records.
    cut = written(pieces.mapInArrow(_cut(kind, known), CUT))
    parts = cut.where("NOT whole").groupBy("file", "start")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("part", "row", "text"))), lambda p: p["text"])
    over = parts.agg(F.lit(LATE).alias("row"), F.aggregate(joined, F.lit("").cast("binary"), lambda a, t: F.concat(a, t)).alias("text"))
    return cut.where("whole").select("file", "start", "row", "text").unionByName(over)
