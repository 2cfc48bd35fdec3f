import collections
import math
import zlib

import pytest

from regionlens.llm import lm_scoring
from regionlens.llm.queries import op4_lm_scoring

from .conftest import odd_rows, order


def brute(rows, cfg):
    docs = [(i, [b" start", *(t or "").encode().lower().split(), b" end"]) for i, t in rows]
    fold = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % cfg.folds
    grams = collections.Counter()
    for i, w in docs:
        if fold(i) != cfg.held_out:
            for k in range(1, cfg.order + 1):
                grams.update(tuple(w[j - k + 1 : j + 1]) for j in range(k - 1, len(w)))
    words = {g: c for g, c in grams.items() if len(g) == 1 and g != (b" start",)}
    n, v = sum(words.values()), len(words)

    def p(w, h):
        if not h:
            return (grams[(w,)] + 0.5) / (n + 0.5 * (v + 1))
        rest = p(w, h[1:])
        return cfg.weight * grams[(*h, w)] / grams[h] + (1 - cfg.weight) * rest if grams[h] else rest

    for i, w in docs:
        at = range(1, len(w))
        yield (
            i, fold(i) == cfg.held_out, len(w) - 1, sum(grams[(w[j],)] > 0 for j in at), n,
            sum(math.log10(p(w[j], ())) for j in at),
            sum(math.log10(p(w[j], tuple(w[max(0, j - cfg.order + 1) : j]))) for j in at),
        )


@pytest.mark.parametrize("cfg", [lm_scoring.LmCfg(), lm_scoring.LmCfg(order=3, weight=0.4, block_bytes=20_000, bucket_bytes=15_000), lm_scoring.LmCfg(order=1)])
def test_scores_match_the_formula(odd, cfg):
    want = order(brute([(r[0], r[1]) for r in odd_rows()], cfg))
    got = order(map(tuple, lm_scoring.lm_scores(odd, cfg).collect()))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_empty(none):
    assert lm_scoring.lm_scores(none).count() == 0


def test_probabilities_of_all_words_sum_to_one():
    import numpy as np

    texts = ["a b a c", "b a", "c c c a"]
    block = lm_scoring.Block.of(texts, 2)
    totals = block.counts(np.ones(3, bool))
    start = (np.uint64(lm_scoring._key(lm_scoring.START)) | lm_scoring.ONE) == block.keys
    words = ((block.keys & lm_scoring.ONE) == 1) & ~start
    n, v = int(totals[words].sum()), int(words.sum())
    base = (totals[words] + 0.5) / (n + 0.5 * (v + 1))
    assert base.sum() + 0.5 / (n + 0.5 * (v + 1)) == pytest.approx(1)


def test_held_out_documents_gain(spark, sf_dir):
    rows = op4_lm_scoring(spark, sf_dir).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
