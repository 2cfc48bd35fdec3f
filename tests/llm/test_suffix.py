import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from regionlens.llm import queries, suffix_dedup
from regionlens.llm.suffix_dedup import SuffixCfg

from .conftest import odd_rows

NEVER = 2**63 - 1


def plain(rows, span=50):
    """The smallest document of every string of ``span`` bytes, in a dictionary."""
    rank = lambda i: NEVER if i is None else i
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - span + 1):
            k = b[p : p + span]
            first[k] = min(first.get(k, NEVER), rank(doc))
    out = Counter()
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if first[b[p : p + span]] < rank(doc):
                gone[p : p + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(df, cfg=SuffixCfg()):
    return Counter(tuple(r) for r in suffix_dedup.remove_repeats(df, cfg=cfg).collect())


CONFIGS = [SuffixCfg(), SuffixCfg(block_bytes=700, bucket_bytes=2000, buckets=2), SuffixCfg(block_bytes=5000, buckets=1), SuffixCfg(anchor=8, filter=8), SuffixCfg(anchor=48, filter=48, block_bytes=2000), SuffixCfg(anchor=40, filter=31)]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_against_brute_force(spark, cfg):
    rnd = random.Random(7)
    base = "".join(rnd.choice("ab é") for _ in range(3000))
    rows = []
    for i in range(90):
        a = rnd.randrange(2900)
        own = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(150)))
        rows.append((rnd.choice([i, i, 5, None]), own + base[a : a + rnd.randrange(30, 130)] + rnd.choice(["", "x" * rnd.randrange(120)]) + base[a // 2 : a // 2 + rnd.randrange(60)]))
    rows += [(7, None), (8, ""), (9, "ab" * 3000), (10, "ab" * 2000 + "c"), (3, base), (4, base), (4, base)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), cfg)
    assert got == plain(rows)
    assert sum(k[2] * n for k, n in got.items()) > 10_000


@pytest.mark.parametrize("span", [49, 50, 51])
def test_exactly_the_span(spark, span):
    passage = "".join(chr(33 + i) for i in range(span))
    rows = [(1, "A" + passage + "B"), (2, "CC" + passage + "D"), (3, passage)]
    got = {k[0]: k[2] for k in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    want = span if span >= 50 else 0
    assert got == {1: 0, 2: want, 3: want}


def test_odd_documents(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert found(odd) == plain(rows)
    assert found(none) == Counter()


def test_kept_bytes(spark):
    passage = "x".join("%04d" % i for i in range(20))
    rows = suffix_dedup.remove_repeats(spark.createDataFrame([(1, passage), (2, "a" + passage + "b" + passage)], "doc_id long, text string"), texts=True).collect()
    assert {r["doc_id"]: (bytes(r["kept"]), r["n_spans"]) for r in rows} == {1: (passage.encode(), 0), 2: (b"ab", 2)}


def test_query_on_the_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in queries.documents(spark, sf_dir).collect()]
    assert Counter(tuple(r) for r in queries.op12_suffix_dedup(spark, sf_dir).collect()) == plain(rows)


def test_frequent_passage_is_one_string_a_block(spark):
    """A passage in every document reaches a bucket once for each block, however many documents a block holds."""
    rnd = random.Random(3)
    passage = " ".join(f"{rnd.getrandbits(40):x}" for _ in range(60))
    rows = [(i, f"{rnd.getrandbits(200):x} {passage}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cfg = SuffixCfg()
    blocks = suffix_dedup.blocks(df, "doc_id", "text", cfg)
    marked = blocks.selectExpr("*", "CAST(NULL AS ARRAY<STRUCT<bucket BIGINT, mask BINARY>>) AS masks")
    sent = marked.mapInArrow(suffix_dedup.shard_transforms(6, cfg), "bucket long, block long, anchors binary, least binary, bwt binary").collect()
    # Some sixty runs a document; only those at the edge of the passage differ.
    assert sum(len(suffix_dedup._grown(r["anchors"], np.uint64)) for r in sent if r["bucket"] >= 0) < 8 * len(rows)
    got = found(df)
    assert sum(k[2] >= len(passage) for k in got) == 2999


def test_transform_of_strings_is_the_sorted_one():
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(200))) for i in range(20)]
    whole = b"".join(t.encode() for _, t in rows)
    import zstandard

    row = {"block": 0, "bytes": len(whole), "ids": [i for i, _ in rows], "sizes": [len(t) for _, t in rows], "text": zstandard.compress(whole)}
    cfg = SuffixCfg(span=20, anchor=16, filter=8)
    block = suffix_dedup.Block(row, cfg)
    strings = suffix_dedup.Strings(block, suffix_dedup.candidates(block, None, 1))
    bwt, owner = strings.transform(cfg.span - cfg.anchor)
    side, rank = cfg.span - cfg.anchor, suffix_dedup._ranks(strings.h)
    want = []
    for i, (l, r) in enumerate(zip(strings.left.tolist(), strings.right.tolist())):
        around = strings.around[i]
        text = [(0, int(c)) for c in around[side - l : side]] + [(1, int(rank[i]))] + [(0, int(c)) for c in around[side : side + r]] + [(-1, i)]
        before = [suffix_dedup.STOP] + [suffix_dedup.MARK if k == 1 else c for k, c in text[:-1]]
        want += [(text[j:], before[j], i) for j in range(len(text))]
    want.sort(key=lambda w: w[0])
    assert bwt.tolist() == [w[1] for w in want] and owner.tolist() == [w[2] for w in want]
    assert len(want) > 500 and np.unique(owner).size == len(strings.h)


def test_documents_are_looked_up_among_places(monkeypatch):
    texts = [b"", b"ab" * 200, b"", b"", b"x" * 49, b"cd" * 300, b""]
    row = suffix_dedup._block_row(0, list(range(len(texts))), texts).to_pylist()[0]
    block = suffix_dedup.Block(row, SuffixCfg())
    places = np.arange(0, block.n, 7)
    search, needles = np.searchsorted, []
    assert block.documents(places).tolist() == search(block.ends, places, side="right").tolist()
    assert block.documents(places[:0]).tolist() == []

    def watched(a, v, *args, **kwargs):
        needles.append(np.size(v))
        return search(a, v, *args, **kwargs)

    monkeypatch.setattr(np, "searchsorted", watched)
    first, _, _, doc = block.runs(24)
    assert max(needles) <= len(texts) < len(first)  # not one search for every run
    assert doc.tolist() == search(block.ends, first, side="right").tolist()


def test_words_are_sorted_as_numbers_with_their_places():
    rng = np.random.default_rng(8)
    for text in (rng.integers(0, 3, (5000, 7)), rng.integers(0, 257, (5000, 7)), rng.integers(250, 257, (300, 4)), np.zeros((0, 7), int)):
        text = text.astype(np.uint16)
        want = np.lexsort(text.T[::-1])
        assert (suffix_dedup._order(text) == want).all()
        (words,) = suffix_dedup._words(text)
        assert (suffix_dedup._sorted(words) == want).all()


def test_transforms_do_not_depend_on_the_words(monkeypatch):
    """Strings in one word a side give the transform that rows of symbols give."""
    rng = np.random.default_rng(9)
    texts = [bytes(rng.choice(list(b"ab \xc3\xa9"), 400).astype(np.uint8)) for _ in range(6)]
    row = suffix_dedup._block_row(0, list(range(6)), texts).to_pylist()[0]
    for cfg in (suffix_dedup.SuffixCfg(), suffix_dedup.SuffixCfg(span=10, anchor=7, filter=4), suffix_dedup.SuffixCfg(span=9, anchor=4, filter=4)):
        block = suffix_dedup.Block(row, cfg)
        strings = suffix_dedup.Strings(block, rng.random(block.n - cfg.span + 1) < 0.9)
        fast = strings.transform(cfg.span - cfg.anchor)
        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, "SYMBOLS", 1)
            m.setattr(suffix_dedup, "_order", lambda text: np.lexsort(text.T[::-1]))
            slow = strings.transform(cfg.span - cfg.anchor)
        assert (fast[0] == slow[0]).all() and (fast[1] == slow[1]).all()
