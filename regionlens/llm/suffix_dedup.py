"""Removal of passages that stand in an earlier document, by merging Burrows-Wheeler transforms.

Documents lie in blocks, the shards.  The start of a passage (``span`` bytes) has an anchor: the window of
``anchor`` bytes inside it with the smallest hash, so equal passages have equal anchors at equal places.
Starts in a row with one anchor make up one string: the bytes before the anchor, the anchor as one symbol, the
bytes behind it.  A passage is then ``depth = span - anchor + 1`` symbols of a string, and all strings that
can share it have the same anchor, so buckets of anchors are independent of each other.

Each block sorts the suffixes of its strings once and sends each bucket their Burrows-Wheeler transform.  A
bucket merges the transforms of all blocks: the interleave, a row of shard numbers, is refined one symbol a
round by the last-to-first step, within which every shard keeps its own order.  After ``depth`` rounds the
borders between rows that differ are known; what lies between two borders is an interval of equal passages.
The smallest document of the interval keeps the passage.

Starts whose wider passage holds no window of ``filter`` bytes that a second document has cannot be in such an
interval; they are left out of the transforms before the suffixes are sorted.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.materialize import bucketed, written

STOP, MARK = 0xFE, 0xFF  # end of a string and its anchor; neither byte occurs in UTF-8
LAST = np.iinfo(np.int64).max  # where a document without id stands
PIECE = 1 << 17  # starts whose windows are hashed at once
PAD = 64  # bytes around the text of a block
SYMBOLS = 7  # in a word


@dataclass(frozen=True)
class SuffixCfg:
    span: int = 50  # bytes of a passage
    anchor: int = 44  # bytes of the window that stands for one symbol
    filter: int = 24  # bytes of the window that must occur in two documents
    block_bytes: int = 6 << 20  # text of a block, of at least one document
    bucket_bytes: int = 3 << 20  # text whose anchors one bucket holds
    buckets: int = 64  # fewest buckets


def _block_row(block: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    whole = b"".join(texts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], pa.int64()),
            pa.array([len(whole)], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
            pa.array([zstandard.compress(whole, 3)], pa.binary()),
        ],
        names=["block", "bytes", "ids", "sizes", "text"],
    )


def blocks(docs: DataFrame, id_col: str, text: str, cfg: SuffixCfg) -> DataFrame:
    """Whole documents in blocks of about ``block_bytes``, one row each, where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1)):
                ids.append(doc.as_py())
                texts.append(value.as_py() or b"")
                held += len(texts[-1])
                if held >= cfg.block_bytes:
                    yield _block_row(block, ids, texts)
                    block, ids, texts, held = block + 1, [], [], 0
        if ids:
            yield _block_row(block, ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    # Both later passes join short rows to the blocks, which stay where they are.
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(rows.mapInArrow(run, "block long, bytes long, ids array<long>, sizes array<long>, text binary"), "block", ranges)


def window_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit hash of every window of ``size`` bytes."""
    power, width, done = 0x9E3779B1, 1, 0
    wide, out = text.astype(np.uint32) + np.uint32(1), None
    while True:
        if size & width:
            # The windows of ``done`` bytes follow those of ``width`` bytes.
            out = wide if out is None else wide[: len(out) - width] * np.uint32(pow(0x9E3779B1, done, 1 << 32)) + out[width:]
            done += width
            if done == size:
                break
        wide = wide[:-width] * np.uint32(power) + wide[width:]
        power, width = power * power & 0xFFFFFFFF, width * 2
    out = out.copy()
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        out ^= out >> np.uint32(shift)
        out *= np.uint32(factor)
    return out ^ (out >> np.uint32(16))


def anchors(text: np.ndarray, n: int, size: int, span: int) -> np.ndarray:
    """For each start the place of the smallest window of ``size`` bytes within ``span`` bytes, the first of equal ones."""
    out = np.empty(max(0, n - span + 1), np.int32)
    for at in range(0, len(out), PIECE):
        part = text[at : min(at + PIECE, len(out)) + span - 1]
        v = window_hashes(part, size).astype(np.uint64) << np.uint64(32)
        v |= np.arange(len(v), dtype=np.uint64)
        width, windows = 1, span - size + 1
        while width * 2 <= windows:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        if width < windows:
            v = np.minimum(v[: width - windows], v[windows - width :])
        out[at : at + len(v)] = (v & np.uint64(0xFFFFFFFF)).astype(np.int32) + np.int32(at)
    return out


def mixed(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of 64-bit words."""
    h = np.full(len(words), 0x2545F4914F6CDD1D, np.uint64)
    for column in words.T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def windows_at(text: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes at each place, one row each."""
    view = np.lib.stride_tricks.as_strided(text, (len(text) - size + 1, size), (1, 1))
    return view[places]


def window_keys(text: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at each place."""
    whole = windows_at(text, places, -(-size // 8) * 8)
    whole[:, size:] = 0
    return mixed(whole.view("<u8"))


class Block:
    """The documents of a block row as bytes, with the runs of starts that share an anchor."""

    def __init__(self, row: dict, cfg: SuffixCfg):
        self.cfg, self.block = cfg, row["block"]
        whole = zstandard.decompress(row["text"], max_output_size=max(1, row["bytes"]))
        self.n = len(whole)
        padded = np.zeros(self.n + 2 * PAD, np.uint8)
        padded[PAD : PAD + self.n] = np.frombuffer(whole, np.uint8)
        self.padded, self.text = padded, padded[PAD : PAD + self.n]
        self.ids = row["ids"]
        self.order = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.ends = np.cumsum(np.array(row["sizes"], np.int64))
        self.begins = self.ends - np.array(row["sizes"], np.int64)

    def documents(self, places: np.ndarray) -> np.ndarray:
        """The document of each of some ascending places: the few documents are looked up among the many places."""
        passed = np.searchsorted(places, self.ends)
        return np.cumsum(np.bincount(passed, minlength=len(places) + 1))[: len(places)]

    def runs(self, size: int, only: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """First start, number of starts, anchor and document of each run; ``only`` marks the starts that count."""
        place = anchors(self.text, self.n, size, self.cfg.span)
        edge = np.zeros(len(place) + 1, bool)
        if not len(place):
            return (np.zeros(0, np.int64),) * 4
        edge[1:-1] = place[1:] != place[:-1]
        edge[[0, -1]] = True
        beyond = np.maximum(self.begins, self.ends - self.cfg.span + 1)
        for marks in (self.begins, beyond):
            edge[marks[marks < len(place)]] = True
        if only is not None:
            edge[1:-1] |= only[1:] != only[:-1]
        first = np.flatnonzero(edge)
        count = np.diff(first)
        first = first[:-1]
        if only is not None:
            keep = only[first]
            first, count = first[keep], count[keep]
        doc = self.documents(first)
        keep = first + self.cfg.span <= self.ends[doc]
        first, count, doc = first[keep], count[keep], doc[keep]
        return first, count, place[first].astype(np.int64), doc

    def shared_keys(self) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The different filter windows of the block as sorted hashes, and whether two of its documents hold them."""
        first, count, at, doc = self.runs(self.cfg.filter)
        h = window_keys(self.padded, at + PAD, self.cfg.filter)
        order = np.argsort(h)
        own = h[order]
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        group = np.cumsum(new) - 1
        at_new = np.flatnonzero(new)
        ranks = self.order[doc[order]]
        twice = np.zeros(len(at_new), bool)
        if len(at_new):
            twice = np.minimum.reduceat(ranks, at_new) != np.maximum.reduceat(ranks, at_new)
        back = np.empty(len(order), np.int64)
        back[order] = group
        return own[new], twice, (first, count, back)


def key_parts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of sorted hashes, where each bucket begins, and the next 32 bits of every hash."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    found, begins = np.unique(bucket, return_index=True)
    return found, np.append(begins, len(keys)), ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _bits(total: int, cfg: SuffixCfg) -> int:
    return max(cfg.buckets, -(-total // cfg.bucket_bytes) - 1).bit_length() if cfg.buckets > 1 else 1


def _give_back() -> None:
    """Return freed memory to the system, because an executor keeps more workers than it has cores."""
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
    _give_back()


def _packed(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def filter_keys(bits: int, cfg: SuffixCfg):
    """For each block and bucket the different filter windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row, cfg)
            bucket, begins, short = key_parts(block.shared_keys()[0], bits)
            if len(bucket):
                yield _packed(
                    {
                        "bucket": pa.array(bucket, pa.int64()),
                        "block": pa.array(np.full(len(bucket), block.block), pa.int64()),
                        "keys": pa.array([short[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:])], pa.binary()),
                    }
                )

    return run


def met_elsewhere(table: pa.Table) -> pa.Table:
    """Which windows of a bucket a second block has, as one bit for each window of each block."""
    keys = [np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()]
    every = np.sort(np.concatenate(keys))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    masks = []
    for k in keys:
        at = np.searchsorted(again, k)
        masks.append(np.packbits(again[np.minimum(at, len(again) - 1)] == k if len(again) else np.zeros(len(k), bool)).tobytes())
    return pa.table({"block": table["block"], "bucket": table["bucket"], "mask": pa.array(masks, pa.binary())})


def candidates(block: Block, masks: list[dict] | None, bits: int) -> np.ndarray:
    """Starts of the block whose filter window a second document has, in this block or another."""
    keys, shared, (first, count, back) = block.shared_keys()
    found, begins, _ = key_parts(keys, bits)
    masks = {m["bucket"]: m["mask"] for m in masks or []}
    for b, lo, hi in zip(found.tolist(), begins[:-1], begins[1:]):
        if b in masks:
            shared[lo:hi] |= np.unpackbits(np.frombuffer(masks[b], np.uint8), count=hi - lo).astype(bool)
    step = np.zeros(max(0, block.n - block.cfg.span + 1) + 1, np.int8)
    hit = shared[back]
    step[first[hit]] += 1
    step[first[hit] + count[hit]] -= 1
    return np.cumsum(step[:-1], dtype=np.int8) > 0


class Strings:
    """The different strings of a block, ordered by their anchor, and the runs that hold them."""

    def __init__(self, block: Block, only: np.ndarray):
        cfg = block.cfg
        self.block, side = block, cfg.span - cfg.anchor
        self.first, self.count, self.place, self.doc = block.runs(cfg.anchor, only)
        left = self.place - self.first
        right = self.count - 1 + side - left
        h = window_keys(block.padded, self.place + PAD, cfg.anchor)
        around = np.zeros((len(h), -(-(2 * side + 2) // 8) * 8), np.uint8)
        before = windows_at(block.padded, self.place + PAD - side, side)
        behind = windows_at(block.padded, self.place + PAD + cfg.anchor, side)
        column = np.arange(side)
        around[:, :side] = np.where(column >= side - left[:, None], before, 0)
        around[:, side : 2 * side] = np.where(column < right[:, None], behind, 0)
        around[:, 2 * side], around[:, 2 * side + 1] = left, right
        words = np.column_stack([h, around.view("<u8")])
        # Equal strings side by side.  Equal hashes of different ones would only keep repeats of one of them apart.
        order = np.argsort(h)
        again = np.zeros(len(h) + 1, bool)
        again[1:-1] = h[order[1:]] == h[order[:-1]]
        several = np.flatnonzero(again[1:] | again[:-1])
        some = order[several]
        order[several] = some[np.lexsort((mixed(words[some]), h[some]))]
        words = words[order]
        new = np.ones(len(words), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in words.T])
        at_new = np.flatnonzero(new)
        self.unique = np.empty(len(order), np.int64)
        self.unique[order] = np.cumsum(new) - 1
        self.h = words[at_new, 0]
        self.left, self.right = left[order][at_new], right[order][at_new]
        self.around = around[order[at_new]]
        ranks = block.order[self.doc[order]]
        self.least = np.minimum.reduceat(ranks, at_new) if len(at_new) else np.zeros(0, np.int64)

    def transform(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Burrows-Wheeler transform of the strings and the string of each of its rows.

        Ends of strings come first, suffixes that begin with a byte next, those that begin with an anchor last; equal
        suffixes follow the order of their strings, so the step from a suffix to the longer one keeps the order.
        """
        n = len(self.h)
        strings = np.arange(n)
        before = np.where(np.arange(side) >= side - self.left[:, None], self.around[:, :side].astype(np.uint16) + 1, 0)
        behind = np.where(np.arange(side) < self.right[:, None], self.around[:, side : 2 * side].astype(np.uint16) + 1, 0)
        # Order of the suffixes from the anchors: by anchor, then by what is behind it.
        by = _order(behind)
        place = np.empty(n, np.int64)
        place[by] = strings
        marks = by[np.sort((_ranks(self.h) << 32) | place) & 0xFFFFFFFF]
        # Suffixes from behind the anchor, in the order of their strings, and from before it, in that of ``marks``.
        whose = np.repeat(strings, self.right)
        skip = np.arange(len(whose)) - np.repeat(np.cumsum(self.right) - self.right, self.right)
        sizes = self.left[marks]
        owner = np.repeat(marks, sizes)
        size = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        front = self.around  # the byte in front of a suffix
        if side < SYMBOLS:  # a string on each side of its anchor is one word, a suffix that word without its first symbols
            marked = np.concatenate([before, np.full((n, 1), MARK + 1, np.uint16)], axis=1)
            word = np.concatenate([_words(behind)[0][whose], _words(marked)[0][owner]])
            gone = np.concatenate([skip, side - size])
            order = _sorted((word << (9 * gone).astype(np.uint64)) & np.uint64((1 << 9 * SYMBOLS) - 1))
            bytes_ = (((word >> (9 * (SYMBOLS - gone)).astype(np.uint64)) & np.uint64(0x1FF)) - np.uint64(1)).astype(np.uint8)
            bytes_[: len(whose)][skip == 0] = MARK
            bytes_[len(whose) :][size == self.left[owner]] = STOP
            bytes_ = bytes_[order]
        else:
            text = np.zeros((len(whose) + len(owner), side + 1), np.uint16)
            padded = np.concatenate([behind, np.zeros_like(behind)], axis=1)
            column = np.arange(side + 1)
            text[: len(whose), :side] = padded[whose[:, None], skip[:, None] + column[:side]]
            ended = np.concatenate([before, np.full((n, 1), MARK + 1, np.uint16), np.zeros_like(before)], axis=1)
            text[len(whose) :] = ended[owner[:, None], (side - size)[:, None] + column]
            order = _order(text)
            first = np.where(skip > 0, front[whose, side + skip - 1], MARK)
            last = np.where(size < self.left[owner], front[owner, np.maximum(side - size - 1, 0)], STOP)
            bytes_ = np.concatenate([first, last]).astype(np.uint8)[order]
        stops = np.where(self.right > 0, front[strings, side + self.right - 1], MARK)
        anchors_ = np.where(self.left > 0, front[:, side - 1], STOP)[marks]
        rows = np.concatenate([strings, np.concatenate([whose, owner])[order], marks])
        return np.concatenate([stops, bytes_, anchors_]).astype(np.uint8), rows


def _words(text: np.ndarray) -> list[np.ndarray]:
    """Rows of symbols of nine bits, seven in a word, the first one highest."""
    words = []
    for at in range(0, text.shape[1], SYMBOLS):
        word = np.zeros(len(text), np.uint64)
        for column in text[:, at : at + SYMBOLS].T:
            word = (word << np.uint64(9)) | column
        words.append(word << np.uint64(9 * (SYMBOLS - min(SYMBOLS, text.shape[1] - at))))
    return words


def _order(text: np.ndarray) -> np.ndarray:
    """Stable order of rows of symbols."""
    words = _words(text)
    return _sorted(words[0]) if len(words) == 1 else np.lexsort(words[::-1])


def _sorted(words: np.ndarray) -> np.ndarray:
    """Stable order of words: by their lower halves, then by their upper ones, each sorted with the places below.

    Sorting numbers takes a fraction of the time of a stable search for their order.
    """
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    places = np.arange(len(words), dtype=np.uint64)
    by = (np.sort((words << half) | places) & low).astype(np.int64)
    return by[(np.sort(((words >> half)[by] << half) | places) & low).astype(np.int64)]


def _ranks(h: np.ndarray) -> np.ndarray:
    """Numbers of equal hashes that stand side by side."""
    new = np.zeros(len(h), np.int64)
    new[1:] = h[1:] != h[:-1]
    return np.cumsum(new)


def _shrunk(values: np.ndarray) -> bytes:
    """Numbers byte by byte: first all highest bytes, which are much the same, then the next."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T[::-1]
    return zstandard.compress(planes.tobytes(), 1)


def _grown(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes[::-1].T).view(kind).reshape(-1)


def shard_transforms(bits: int, cfg: SuffixCfg):
    """For each block and bucket the transform of the block's strings with an anchor of that bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row, cfg)
            only = candidates(block, row["masks"], bits)
            strings = Strings(block, only)
            if not len(strings.h):
                continue
            # For the block itself: the candidates, so that they are not looked for again.
            yield _packed(
                {
                    "bucket": pa.array([-1 - row["block"]], pa.int64()),
                    "block": pa.array([row["block"]], pa.int64()),
                    "anchors": pa.array([zstandard.compress(np.packbits(only).tobytes(), 1)], pa.binary()),
                    "least": pa.array([b""], pa.binary()),
                    "bwt": pa.array([b""], pa.binary()),
                }
            )
            bwt, string = strings.transform(cfg.span - cfg.anchor)
            found, begins, _ = key_parts(strings.h, bits)
            number = small(np.repeat(np.arange(len(found)), np.diff(begins)), len(found))[string]
            # The step from a suffix to the one before it stays within a string, so the rows of a bucket are a transform of their own.
            by = np.argsort(number, kind="stable")
            cuts = np.append(0, np.cumsum(np.bincount(number, minlength=len(found))))
            bwt = bwt[by]
            spans = list(zip(begins[:-1], begins[1:]))
            yield _packed(
                {
                    "bucket": pa.array(found, pa.int64()),
                    "block": pa.array(np.full(len(found), row["block"]), pa.int64()),
                    "anchors": pa.array([_shrunk(strings.h[a:b]) for a, b in spans], pa.binary()),
                    "least": pa.array([_shrunk(strings.least[a:b]) for a, b in spans], pa.binary()),
                    "bwt": pa.array([_shrunk(bwt[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                }
            )

    return run


def small(numbers: np.ndarray, most: int) -> np.ndarray:
    """Numbers up to ``most`` in as few bytes as they need; one or two bytes are sorted by counting."""
    return numbers.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def suffix_rows(bwt: np.ndarray, shard: np.ndarray, stops: np.ndarray, anchor: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walk all strings backwards together.

    ``stops`` is the row of each string's end.  Returns the rows of its suffixes that begin at the anchor and up to
    ``side`` symbols before it (-1 where the string has begun), the symbols behind the anchor, and the row they begin in.
    """
    plain = np.flatnonzero(bwt < STOP)
    # Rows of a shard are ordered by their first symbol: ends, bytes, anchors.
    by = np.argsort(bwt[plain], kind="stable")
    source = plain[by[np.argsort(small(shard[plain][by], shard[-1]), kind="stable")]]
    size = np.bincount(shard)
    ends = np.bincount(shard[stops], minlength=len(size))
    held = np.bincount(shard[plain], minlength=len(size))
    starts = np.cumsum(size) - size + ends
    step = np.full(len(bwt), -1, np.int32)
    step[source] = np.arange(len(source)) + np.repeat(starts - (np.cumsum(held) - held), held)
    at, right = stops.astype(np.int32), np.zeros(len(stops), np.int64)
    walking = np.flatnonzero(bwt[at] != MARK)
    while len(walking):
        at[walking] = step[at[walking]]
        right[walking] += 1
        walking = walking[bwt[at[walking]] != MARK]
    # By shard, anchor and row, of which no two strings have one.
    anchors_ = int(anchor.max(initial=0)) + 1
    if len(size) * anchors_ < 1 << 31:
        by = np.argsort(((shard[stops] * anchors_ + anchor) << 32) | at)
    else:
        by = np.lexsort((at, anchor, shard[stops]))
    rows = np.full((len(stops), side + 1), -1, np.int32)
    rows[by, 0] = np.arange(len(stops)) + np.repeat(starts + held - (np.cumsum(ends) - ends), ends)
    walking, row = np.arange(len(stops)), rows[:, 0]
    for k in range(1, side + 1):
        more = bwt[row] != STOP
        walking, row = walking[more], step[row[more]]
        rows[walking, k] = row
    return rows, right, at


def interleave(bwt: np.ndarray, shard: np.ndarray, stops: np.ndarray, anchor: np.ndarray, marked: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: the place of each row in the merged order, and the interval of each place.

    The state is the interleave, one shard number for each place, and the intervals of suffixes equal so far.
    ``marked`` is the row in front of which each string's anchor stands.
    """
    z = small(shard, shard[-1])
    ends = z[stops]  # ends of strings keep their places
    place = np.arange(len(z))
    interval = np.zeros(len(z), np.int32)
    symbol = np.empty(len(z), np.uint8)
    counts = np.bincount(bwt, minlength=256)[:STOP]
    plain = int(counts.sum())
    begins = np.cumsum(counts) - counts
    begins = begins[counts > 0]
    own = anchor.astype(np.uint64) << np.uint64(32)
    for _ in range(rounds):
        symbol[place] = bwt
        # Rows in the order of the byte before them, then those before which an anchor stands; where a string begins, nothing does.
        by = np.argsort(symbol, kind="stable")[:plain]
        hit = place[marked]
        order = np.sort(own | hit.astype(np.uint64))
        source = np.concatenate([by, (order & np.uint64(0xFFFFFFFF)).astype(np.int64)])
        same = interval[source]
        new = np.empty(len(source), bool)
        new[1:] = same[1:] != same[:-1]
        new[begins] = True
        order >>= np.uint64(32)
        new[plain:][:1] = True
        new[plain + 1 :] |= order[1:] != order[:-1]
        z = np.concatenate([ends, z[source]])
        interval = np.concatenate([np.zeros(len(ends), np.int32), np.cumsum(new, dtype=np.int32)])
        place = np.argsort(z, kind="stable")
    return place, interval


def merge_transforms(cfg: SuffixCfg):
    """For each string of a bucket and each passage in it: whether a smaller document has the passage than any that has the string."""
    side, depth = cfg.span - cfg.anchor, cfg.span - cfg.anchor + 1

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        if table["bucket"][0].as_py() < 0:
            return table.select(["block", "bucket", "anchors"]).rename_columns(["block", "bucket", "flags"])
        bwts, hashes, ids = (
            [_grown(v, kind) for v in table[c].to_pylist()] for c, kind in (("bwt", np.uint8), ("anchors", np.uint64), ("least", np.int64))
        )
        least = np.concatenate(ids)
        sizes = np.array([len(b) for b in bwts])
        strings = np.array([len(h) for h in hashes])
        bwt = np.concatenate(bwts)
        shard = np.repeat(np.arange(len(bwts)), sizes)
        # The ends of its strings are the first rows of each shard, in their order.
        stops = np.arange(strings.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(strings) - strings), strings)
        anchor = np.unique(np.concatenate(hashes), return_inverse=True)[1].astype(np.int64)
        rows, right, marked = suffix_rows(bwt, shard, stops, anchor, side)
        place, interval = interleave(bwt, shard, stops, anchor, marked, depth)
        left = np.arange(depth)
        passage = (rows >= 0) & (left + right[:, None] >= side)
        who, where = np.nonzero(passage)
        group = interval[place[rows[who, where]]]
        low = np.full(int(interval[-1]) + 1, LAST, np.int64)
        np.minimum.at(low, group, least[who])
        earlier = np.zeros(rows.shape, bool)
        earlier[who, where] = low[group] < least[who]
        edges = np.concatenate([[0], np.cumsum(strings)])
        flags = [np.packbits(earlier[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "flags": pa.array(flags, pa.binary())})

    return run


def kept_texts(bits: int, cfg: SuffixCfg, texts: bool):
    """For each document of a block what is left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row, cfg)
            gone = removed(block, row, bits)
            rise = np.flatnonzero(np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1)
            # A run that goes on over the end of a document is one of the next as well.
            heads = block.begins[(block.begins < block.n) & (block.ends > block.begins)]
            rise = np.union1d(rise, heads[gone[heads]])
            spans = np.bincount(np.searchsorted(block.ends, rise, side="right"), minlength=len(block.ids))
            sums = np.concatenate([[0], np.cumsum(gone)])
            n_gone = sums[block.ends] - sums[block.begins]
            left = block.text[~gone].tobytes()
            at = np.cumsum(np.concatenate([[0], block.ends - block.begins - n_gone])).tolist()
            kept = [left[a:b] for a, b in zip(at[:-1], at[1:])]
            yield _packed(
                {
                    "doc_id": pa.array(block.ids, pa.int64()),
                    "n_bytes": pa.array(block.ends - block.begins),
                    "n_removed": pa.array(n_gone, pa.int64()),
                    "n_spans": pa.array(spans, pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                }
                | ({"kept": pa.array(kept, pa.binary())} if texts else {})
            )

    return run


def removed(block: Block, row: dict, bits: int) -> np.ndarray:
    """Which bytes of a block go: those of passages that an earlier document has."""
    cfg, side = block.cfg, block.cfg.span - block.cfg.anchor
    flags = {m["bucket"]: m["flags"] for m in row["flags"] or []}
    if not flags:
        return np.zeros(block.n, bool)
    only = np.frombuffer(zstandard.decompress(flags[-1 - block.block]), np.uint8)
    strings = Strings(block, np.unpackbits(only, count=block.n - cfg.span + 1).astype(bool))
    earlier = np.zeros((len(strings.h), side + 1), bool)
    found, begins, _ = key_parts(strings.h, bits)
    for b, lo, hi in zip(found.tolist(), begins[:-1], begins[1:]):
        bitmap = np.frombuffer(flags[b], np.uint8)
        earlier[lo:hi] = np.unpackbits(bitmap, count=(hi - lo) * (side + 1)).reshape(hi - lo, side + 1)
    # Start k of a run has left - k symbols before the anchor.
    run = np.repeat(np.arange(len(strings.first)), strings.count)
    k = np.arange(len(run)) - np.repeat(np.cumsum(strings.count) - strings.count, strings.count)
    start = strings.first[run] + k
    who = strings.unique[run]
    later = earlier[who, strings.place[run] - start] | (block.order[strings.doc[run]] > strings.least[who])
    start = start[later]
    step = np.zeros(block.n + 1, np.int32)
    # A start is in one run only, so no place is met twice.
    step[start] += 1
    step[start + cfg.span] -= 1
    return np.cumsum(step[:-1], dtype=np.int32) > 0


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", cfg: SuffixCfg = SuffixCfg(), texts: bool = False
) -> DataFrame:
    """Remove every byte of a passage of ``cfg.span`` bytes that also stands in a document with a smaller id.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row, and with ``texts`` the bytes left
    as ``kept`` (a removed run may end inside a character, so they need not be UTF-8).  Passages are judged on the
    input, whole texts as UTF-8; NULL counts as empty.  Of rows with one id none is before the other, and rows without
    id stand behind all others, so equal rows lose nothing to each other.  A very long text is one block; its starts
    and strings are spread over the buckets like those of many texts.  An empty table gives no rows; other columns are
    ignored.

    A string that many documents of a block hold is sent once for the block, so the copies of a frequent passage
    reach its bucket as one string for each block.  Rows between blocks and buckets are packed; there are at most
    ``blocks * buckets`` of them and never more than anchors.  A larger corpus should have larger blocks
    (``block_bytes``, as much as a task can hold some 40 times) and with them fewer rows.
    """
    cut = blocks(docs, id_col, text, cfg)
    total = cut.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    bits = _bits(total, cfg)
    masks = (
        cut.mapInArrow(filter_keys(bits, cfg), "bucket long, block long, keys binary")
        .groupBy("bucket")
        .applyInArrow(met_elsewhere, "block long, bucket long, mask binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))
    )
    marked = cut.join(masks, "block", "left")
    flags = (
        marked.mapInArrow(shard_transforms(bits, cfg), "bucket long, block long, anchors binary, least binary, bwt binary")
        .groupBy("bucket")
        .applyInArrow(merge_transforms(cfg), "block long, bucket long, flags binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "flags")).alias("flags"))
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return cut.join(written(flags), "block", "left").mapInArrow(kept_texts(bits, cfg, texts), schema)
