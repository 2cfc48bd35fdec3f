"""Language-model scores from a weighted backoff automaton.

The states are the n-grams up to one word less than the order; a seen continuation is an arc to the state of its
own longest end, and a failure arc leads from a state to the one that forgets its oldest word:

    P(w | h) = weight * c(h w) / c(h) + (1 - weight) * P(w | h'),   P(w) = (c(w) + 1/2) / (N + (V + 1) / 2)

A seen arc carries the logarithm of the whole sum, the failure arc of a seen history that of
``1 - weight``, and a history never seen is no state at all.  Every token takes the arc of the longest state, after as
many failure arcs as it needs.  States are looked up at every place, from long to short, not carried from token to
token: the last words fix the state, and the parts of a seen n-gram are seen too, so both find the same arcs.

The automaton grows with the corpus, so no task holds it.  Documents are dealt to blocks of bounded size by a
hash of the row.  A block sends its different n-grams, each once, to the task that counts them over all
blocks, and gets back one count for each, in the order sent: that is the part of the automaton its
documents can reach.  Keys travel as sorted 64-bit hashes in byte planes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.materialize import written
from regionlens.llm.text import lower_words

START, END = b" start", b" end"  # no word holds a blank
ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed odd multipliers of the hash
ODD2 = np.uint64(0xBF58476D1CE4E5B9)
ONE = np.uint64(1)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class LmCfg:
    order: int = 2
    weight: float = 0.1  # of the longer history at every step
    folds: int = 5
    held_out: int = 1  # documents with this remainder are not learned from
    block_bytes: int = 6_000_000  # text of a block, about
    bucket_bytes: int = 12_000_000  # text whose n-grams one counting task receives, about


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * ODD) ^ (b + (a >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * ODD2
    return x ^ (x >> np.uint64(29))


def _key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


@dataclass
class Block:
    """The n-grams of some documents: sorted keys, and the key at every place for each length.

    The lowest bit of a key tells words from longer n-grams.  A place without a full n-gram has -1.
    """

    keys: np.ndarray
    at: list[np.ndarray]  # [k - 1][place]: index of the k-gram that ends there
    doc: np.ndarray  # document of a place
    token: np.ndarray  # false for the start before each document

    @classmethod
    def of(cls, texts: list[str | None], order: int) -> Block:
        seen = {START: 0, END: 1}
        flat: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = [seen.setdefault(w, len(seen)) for w in lower_words(text)]
            flat.append(0)
            flat += words
            flat.append(1)
            sizes[i] = len(words) + 2
        flat = np.array(flat, np.int64)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(flat)) - np.repeat(first, sizes)
        words = np.fromiter((_key(w) for w in seen), np.uint64, len(seen))[flat]
        grams = [(words | ONE, place >= 0)]
        gram = words
        for k in range(2, order + 1):
            gram = np.concatenate([gram[:1], _mix(gram[:-1], words[1:])]) if len(gram) else gram
            grams.append((gram & ~ONE, place >= k - 1))
        keys, inverse = np.unique(np.concatenate([g[ok] for g, ok in grams]), return_inverse=True)
        at, used = [], 0
        for _, ok in grams:
            ids = np.full(len(flat), -1, np.int64)
            n = int(ok.sum())
            ids[ok] = inverse[used : used + n]
            used += n
            at.append(ids)
        return cls(keys, at, np.repeat(np.arange(len(texts)), sizes), place > 0)

    def counts(self, of_doc: np.ndarray) -> np.ndarray:
        """How often each key stands in the documents marked."""
        total = np.zeros(len(self.keys), np.int64)
        marked = of_doc[self.doc]
        for ids in self.at:
            total += np.bincount(ids[marked & (ids >= 0)], minlength=len(self.keys))
        return total


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers by byte planes: the high bytes, nearly all zero, compress to nothing."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _requests(cfg: LmCfg, bucket_bits: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        block = Block.of(group["text"].tolist(), cfg.order)
        counts = block.counts(~group["held_out"].to_numpy(bool))
        bucket = (block.keys >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(block.keys), np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        rows = [
            (int(bucket[i]), int(group["block"].iloc[0]), _planes(np.diff(block.keys[i:j], prepend=np.uint64(0))), _planes(counts[i:j].astype("<u4")))
            for i, j in zip([0, *cuts], [*cuts, len(bucket)])
        ]
        return pd.DataFrame(rows, columns=["bucket", "block", "keys", "counts"])

    return run


def _totals(group: pd.DataFrame) -> pd.DataFrame:
    """Counts over all blocks for each request, and the bucket's share of N and V on its first row."""
    keys = [np.cumsum(_from_planes(k, "<u8")) for k in group["keys"]]
    counts = np.concatenate([_from_planes(c, "<u4") for c in group["counts"]])
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(unique)).astype("<u8")
    words = ((unique & ONE) == 1) & (unique != (np.uint64(_key(START)) | ONE)) & (total > 0)
    answers = total[inverse]
    cuts = np.cumsum([len(k) for k in keys])
    out = group[["block", "bucket"]].copy()
    out["totals"] = [_planes(answers[i:j]) for i, j in zip([0, *cuts[:-1]], cuts)]
    out["n"] = [int(total[words].sum())] + [0] * (len(out) - 1)
    out["v"] = [int(words.sum())] + [0] * (len(out) - 1)
    return out


class Automaton:
    """The part of the model that a block's documents can reach, one entry per n-gram of the block."""

    def __init__(self, block: Block, totals: np.ndarray, n: int, v: int, weight: float):
        self.block, self.totals = block, totals
        base = (totals + 0.5) / (n + 0.5 * (v + 1))
        self.base = np.log10(base)
        p = base  # right for words; longer n-grams follow, shorter before longer
        for k in range(1, len(block.at)):
            here = np.flatnonzero(block.at[k] >= 0)
            gram, suffix, history = block.at[k][here], block.at[k - 1][here], block.at[k - 1][here - 1]
            of = totals[history]
            p[gram] = np.where(of > 0, weight * totals[gram] / np.maximum(of, 1) + (1 - weight) * p[suffix], p[suffix])
        self.arc = np.log10(p)
        self.failure = np.log10(1 - weight)

    def traverse(self) -> np.ndarray:
        """Log10 probability of the token at every place, by lookups from long to short over all documents of the block."""
        block = self.block
        score = np.zeros(len(block.doc))
        todo = block.token.copy()
        for k in range(len(block.at) - 1, 0, -1):
            here = np.flatnonzero(todo & (block.at[k] >= 0))
            state = self.totals[block.at[k - 1][here - 1]] > 0
            arc = self.totals[block.at[k][here]] > 0
            taken = here[state & arc]
            score[taken] += self.arc[block.at[k][taken]]
            todo[taken] = False
            score[here[state & ~arc]] += self.failure
        score[todo] += self.arc[block.at[0][todo]]
        return score


def _scores(cfg: LmCfg, n: int, v: int):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = Block.of(docs["text"].tolist(), cfg.order)
        answers = answers.sort_values("bucket")
        totals = np.concatenate([_from_planes(t, "<u8") for t in answers["totals"]]).astype(np.int64)
        if len(totals) != len(block.keys):
            raise RuntimeError("counts do not fit the block: the rows changed between two reads")
        model = Automaton(block, totals, n, v, cfg.weight)
        words = block.at[0]
        add = lambda x: np.bincount(block.doc[block.token], weights=x[block.token], minlength=len(docs))
        known = totals[words] > 0
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if d is None else int(d) for d in docs["doc_id"]], dtype="Int64"),
                "held_out": docs["held_out"].to_numpy(bool),
                "n_tokens": add(np.ones(len(words))).astype(np.int64),
                "n_known": add(known.astype(float)).astype(np.int64),
                "train_tokens": n,
                "base_score": add(model.base[words]),
                "score": add(model.traverse()),
            }
        )

    return run


def lm_scores(docs: DataFrame, cfg: LmCfg = LmCfg(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every document with a model learned from all folds but one.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; both scores are sums
    of log10 probabilities, ``base_score`` by words alone.  NULL texts are empty: one end token.  A NULL id
    belongs to fold 0 (as crc32 of an empty text).  Repeated rows are each learned from and scored; other columns
    are ignored; an empty table gives an empty one.

    Texts are shuffled twice, once to collect requests and once to score, and never written; what is
    written are the counts returned, about a byte per n-gram of a block.
    """
    plain = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("text"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 2 * F.count("*")).first()[0]
    blocks = max(1, -(-size // cfg.block_bytes))
    bucket_bits = max(0, (-(-size // cfg.bucket_bytes) - 1).bit_length())
    dealt = plain.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"),
        "doc_id",
        (F.pmod(F.crc32(F.coalesce("doc_id", F.lit(""))), F.lit(cfg.folds)) == cfg.held_out).alias("held_out"),
        "text",
    )
    requests = dealt.groupBy("block").applyInPandas(
        _requests(cfg, bucket_bits), "bucket long, block long, keys binary, counts binary"
    )
    answers = written(
        requests.groupBy("bucket").applyInPandas(_totals, "block long, bucket long, totals binary, n long, v long")
    )
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return (
        dealt.groupBy("block")
        .cogroup(answers.select("block", "bucket", "totals").groupBy("block"))
        .applyInPandas(_scores(cfg, n, v), SCORES)
    )
