"""Benchmark passages inside documents, found by greedy string tiling.

Documents and benchmark items are compared as words.  Where they share a run of ``min_match`` words (a
seed), the item is tiled: again and again the longest common run not yet covered is marked, found by running
Karp-Rabin hashes at falling lengths.  The covered share of the item decides.  Tiles may come in any order, so a
passage whose sentences were rearranged is still found.

The benchmark is a stated query set: it passes over all documents in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.materialize import written

WORD = re.compile(r"[^\W_]+")
ODD = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
HITS = "array<struct<item_id:long,coverage:double>>"


@dataclass(frozen=True)
class TileCfg:
    min_match: int = 5  # words of the shortest tile
    min_coverage: float = 0.5  # share of an item's words under tiles
    block_items: int = 5_000  # items of a block
    block_chars: int = 8_000_000  # characters of a block


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``width`` numbers."""
    if len(ids) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - width + 1, np.uint64)
    x = ids.astype(np.uint64)
    for i in range(width):
        out = out * np.uint64(ODD) + x[i : i + len(out)] + np.uint64(1)
    return out


def tile(item: list[int], text: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(place in item, place in text, length)`` of the tiles.

    A number below zero matches nothing.  Longest first; among equals the first in the item, then in the text.
    """
    free_i = [x >= 0 for x in item]
    free_t = [x >= 0 for x in text]
    tiles: list[tuple[int, int, int]] = []

    def places(width: int) -> dict[int, deque[int]]:
        found = defaultdict(deque)
        for j, h in _runs(text, free_t, width):
            found[h].append(j)
        return found

    most = min(len(item), len(text))
    while True:
        # A common run holds common runs of every smaller width, so halving finds the longest.
        least = min_match - 1
        while least < most:
            width = (least + most + 1) // 2
            there = places(width)
            if any(h in there for _, h in _runs(item, free_i, width)):
                least = width
            else:
                most = width - 1
        if most < min_match:
            return tiles
        width, there = most, places(most)
        for i, h in list(_runs(item, free_i, width)):
            queue = there.get(h)
            # Of the runs of one width, those that touch a fresh tile have an end in it.
            while queue and free_i[i] and free_i[i + width - 1]:
                j = queue.popleft()
                if free_t[j] and free_t[j + width - 1] and item[i : i + width] == text[j : j + width]:
                    tiles.append((i, j, width))
                    free_i[i : i + width] = [False] * width
                    free_t[j : j + width] = [False] * width
        most = width - 1


def _runs(ids: list[int], free: list[bool], width: int) -> Iterator[tuple[int, int]]:
    """Places and running hashes of the runs of ``width`` that are free throughout."""
    top = pow(ODD, width, 1 << 64)
    h = length = 0
    for j, (x, ok) in enumerate(zip(ids, free)):
        if not ok:
            h = length = 0
            continue
        h = (h * ODD + x + 1) & MASK
        length += 1
        if length > width:
            h = (h - top * (ids[j - width] + 1)) & MASK
        if length >= width:
            yield j - width + 1, h


class Index:
    """The seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]], cfg: TileCfg):
        self.cfg = cfg
        self.words: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        codes, owners = [], []
        for name, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in WORD.findall((text or "").lower())]
            # An item shorter than a seed is one seed as a whole; an empty one matches nothing.
            if ids:
                width = min(cfg.min_match, len(ids))
                code = rolling(np.array(ids), width)
                codes.append(code ^ np.uint64(width))
                owners.append(np.full(len(code), len(self.items)))
                self.items.append((name, ids))
        self.widths = sorted({min(cfg.min_match, len(ids)) for _, ids in self.items})
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.codes, self.owners = code[order], owner[order]

    def hits(self, text: str | None) -> list[tuple[int, float]]:
        """Items covered enough by the text, by falling coverage."""
        get = self.words.get
        ids = np.array([get(w, -1) for w in WORD.findall((text or "").lower())], np.int64)
        near = np.zeros(len(ids), bool)
        candidates: set[int] = set()
        for width in self.widths:
            if len(ids) < width:
                continue
            inside = np.convolve(ids >= 0, np.ones(width, np.int64), "valid") == width
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            code = rolling(ids, width)[at] ^ np.uint64(width)
            first = np.searchsorted(self.codes, code)
            hit = (first < len(self.codes)) & (self.codes[np.minimum(first, len(self.codes) - 1)] == code)
            last = np.searchsorted(self.codes, code[hit], "right")
            for a, b in set(zip(first[hit].tolist(), last.tolist())):
                candidates.update(self.owners[a:b].tolist())
            for k in range(width):
                near[at[hit] + k] = True
        if not candidates:
            return []
        # Words outside seeds lie under no tile; a gap of one keeps what is left apart.
        kept = np.where(near, ids, -1)
        keep = near | np.concatenate([[False], near[:-1]])
        rest = kept[keep].tolist()
        out = []
        for c in candidates:
            name, item = self.items[c]
            width = min(self.cfg.min_match, len(item))
            if self._bound(item, rest, width) < self.cfg.min_coverage:
                continue
            covered = sum(n for _, _, n in tile(item, rest, width)) / len(item)
            if covered >= self.cfg.min_coverage:
                out.append((name, covered))
        return sorted(out, key=lambda x: (-x[1], x[0] is None, x[0] or 0))

    @staticmethod
    def _bound(item: list[int], rest: list[int], width: int) -> float:
        """Share of the item that lies under shared seeds; no tiling covers more."""
        there = {h for _, h in _runs(rest, [x >= 0 for x in rest], width)}
        under = [False] * len(item)
        for i, h in _runs(item, [True] * len(item), width):
            if h in there:
                under[i : i + width] = [True] * width
        return sum(under) / len(item)


_LOADED: dict[int, Index] = {}  # the latest block of this worker


def _finder(items: Broadcast, cfg: TileCfg):
    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if items.id not in _LOADED:
            _LOADED.clear()
            _LOADED[items.id] = Index(items.value, cfg)
        index = _LOADED[items.id]
        for texts in batches:
            yield pd.Series([[{"item_id": i, "coverage": c} for i, c in index.hits(t)] for t in texts], dtype=object)

    return find


class _Items:
    """Handle to a broadcast block; carries an id of its own, which workers cache by."""

    def __init__(self, data: Broadcast, number: int):
        self.data, self.id = data, number

    @property
    def value(self) -> list:
        return self.data.value


def _blocks(benchmark: DataFrame, cfg: TileCfg) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    for r in benchmark.toLocalIterator():
        if block and (len(block) >= cfg.block_items or chars + len(r[1] or "") > cfg.block_chars):
            yield block
            block, chars = [], 0
        block.append((r[0], r[1]))
        chars += len(r[1] or "")
    yield block


def with_hits(
    docs: DataFrame, benchmark: DataFrame, cfg: TileCfg = TileCfg(), text: str = "text", name: str = "hits",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Add the benchmark items that a document covers, with their coverage.

    Items come by falling coverage, then by id.  A NULL or empty text covers nothing, nor does an empty
    item; an item shorter than a tile must occur whole.  Equal items are each reported.  An empty
    benchmark gives empty arrays.  All columns and rows are kept.  Nothing is shuffled; a benchmark of more than
    one block costs a written pass for each.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    out = docs.withColumn(name, F.array().cast(HITS))
    for number, block in enumerate(_blocks(items, cfg)):
        if number:
            out = written(out)
        handle = _Items(spark.sparkContext.broadcast(block), hash((spark.sparkContext.applicationId, id(block), number)))
        out = out.withColumn(name, _by_coverage(F.concat(F.col(name), _finder(handle, cfg)(F.col(text)))))
    return out


def _by_coverage(hits: Column) -> Column:
    return F.array_sort(
        hits,
        lambda a, b: F.when(a["coverage"] > b["coverage"], -1)
        .when(a["coverage"] < b["coverage"], 1)
        .when(a["item_id"] < b["item_id"], -1)
        .when(a["item_id"] > b["item_id"], 1)
        .otherwise(0),
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, cfg: TileCfg = TileCfg(), id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, contaminated, coverage, item_ids`` of every row; coverage is that of the best item reported, else 0."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return with_hits(plain, benchmark, cfg).select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.coalesce(F.get("hits", F.lit(0))["coverage"], F.lit(0.0)).alias("coverage"),
        F.col("hits.item_id").alias("item_ids"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, cfg: TileCfg = TileCfg(), text: str = "text") -> DataFrame:
    """The documents that cover no item, with all their columns."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"_hits{i or ''}" for i in range(len(taken) + 1)) if n not in taken)
    return with_hits(docs, benchmark, cfg, text, name).where(F.size(name) == 0).drop(name)
