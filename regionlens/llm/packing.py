"""Packing documents into batches of one length with little padding.

A document longer than the longest sequence is cut into pieces.  The histogram of piece lengths, which has at
most as many entries as the longest sequence has tokens, goes through dynamic programming: of all ways to choose the
given number of bucket lengths it finds one with the least padding.  Inside a bucket the pieces are numbered in
the order of the documents, and every run that fits the token budget is a batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.globalindex import with_global_index
from regionlens.functions.materialize import written
from regionlens.llm.text import words_of


@dataclass(frozen=True)
class PackCfg:
    max_len: int = 2048  # tokens of the longest sequence
    buckets: int = 8
    budget: int = 65_536  # tokens of a batch, padding included


def best_lengths(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Bucket lengths, ascending, at most ``buckets`` of them, with the least padded tokens in all.

    ``best[b][j]`` is the least padded size of the ``j`` smallest lengths in ``b`` buckets: the last bucket holds
    lengths ``i`` to ``j - 1`` at the size of the largest.  Fewer buckets and smaller cuts win ties.
    """
    order = np.argsort(np.asarray(lengths, np.int64), kind="stable")
    size, count = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(size)
    if not n:
        return []
    below = np.concatenate([[0], np.cumsum(count)])
    far = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        row, cut = best.copy(), np.full(n + 1, -1, np.int64)
        for j in range(1, n + 1):
            whole = best[:j] + size[j - 1] * (below[j] - below[:j])
            i = int(np.argmin(whole))
            if whole[i] < row[j]:
                row[j], cut[j] = whole[i], i
        cuts.append(cut)
        best = row
    chosen, j = [], n
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            chosen.append(int(size[j - 1]))
            j = int(cut[j])
    return chosen[::-1]


def pack(
    docs: DataFrame, cfg: PackCfg = PackCfg(), id_col: str = "doc_id", text: str = "text", tokens: str | None = None
) -> DataFrame:
    """Where every piece of every document goes.

    Returns ``doc_id, piece, n_tokens, bucket_len, batch, slot``; a batch is named by ``bucket_len`` and
    ``batch`` and holds ``budget // bucket_len`` slots, at least one.  ``tokens`` names a column with the number of ids of each text, as
    ``token_counts`` gives it (NULL counts as none), and texts are not looked at; pieces are then cut by token and batches keep
    their budget whatever the script.  Without it tokens are the words of a text.  One end is added to either, so
    NULL and empty texts have one token.  Repeated rows each get a place (which of them gets which is open), NULL
    ids come first, other columns are ignored, an empty table gives an empty one.

    Only lengths are shuffled, never texts.  The numbers inside a bucket come from ranges of (bucket, document,
    piece) and one offset per range, so a bucket with most of the rows is spread over many tasks.
    """
    n = F.size(words_of(F.col(text))) if tokens is None else F.coalesce(F.col(tokens), F.lit(0)).cast("int")
    sized = docs.select(F.col(id_col).alias("doc_id"), (n + 1).alias("n"))
    top = F.lit(cfg.max_len)
    pieces = written(
        sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / top).cast("int") - 1))).select(
            "doc_id", "piece", F.least(top, F.col("n") - F.col("piece") * top).alias("n_tokens")
        )
    )
    # At most max_len rows.
    histogram = sorted((r[0], r[1]) for r in pieces.groupBy("n_tokens").count().collect())
    lengths = best_lengths([n for n, _ in histogram], [c for _, c in histogram], cfg.buckets)
    if not lengths:
        return pieces.select("doc_id", "piece", "n_tokens", F.lit(0).alias("bucket_len"), F.lit(0).cast("long").alias("batch"), F.lit(0).alias("slot"))
    bucket = first = fits = None
    for b in reversed(lengths):
        inside = F.col("n_tokens") <= b
        before = sum(c for n, c in histogram if n <= max((x for x in lengths if x < b), default=0))
        slots = max(1, cfg.budget // b)
        bucket = F.when(inside, b).otherwise(bucket)
        first = F.when(inside, F.lit(before).cast("long")).otherwise(first)
        fits = F.when(inside, slots).otherwise(fits)
    placed = with_global_index(pieces.withColumn("bucket_len", bucket), ["bucket_len", "doc_id", "piece"], "_at")
    return placed.withColumn("_at", F.col("_at") - first).select(
        "doc_id",
        "piece",
        "n_tokens",
        "bucket_len",
        F.floor(F.col("_at") / fits).cast("long").alias("batch"),
        F.pmod("_at", fits.cast("long")).cast("int").alias("slot"),
    )
