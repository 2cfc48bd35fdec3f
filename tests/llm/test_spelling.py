import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import pytest

from regionlens.llm import queries, spelling
from regionlens.llm.spelling import SpellingCfg

from .conftest import odd_rows


def plain(rows, cfg=SpellingCfg()):
    """Near words by leaving out each letter in turn."""
    times = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            times[run[: h % len(run)] + run[h % len(run) + 1 :] if h % cfg.slip == 0 else run] += 1
    words = {w: n for w, n in times.items() if len(w) >= cfg.letters and n >= cfg.seen}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= cfg.factor * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words.get(form[w]), root)
    return out


def found(df, cfg=SpellingCfg()):
    rows = spelling.variants(df, cfg=cfg).collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def made_rows(seed=1, docs=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abeéÀxyst") for _ in range(rnd.randint(4, 9))) for _ in range(40)]
    for _ in range(400):
        w = list(rnd.choice(words))
        at = rnd.randrange(len(w))
        w[at : at + rnd.randint(0, 1)] = rnd.choice(["", rnd.choice("abeéxyst"), "t"])
        words.append("".join(w))
    return [(rnd.choice([i, None]), " ".join(rnd.choice(words[:: rnd.choice([1, 7])]).title() for _ in range(150)) + "-É÷×ñ") for i in range(docs)]


@pytest.mark.parametrize("cfg", [SpellingCfg(), SpellingCfg(node_words=3, start=1), SpellingCfg(node_words=1, groups=("ab", "e")), SpellingCfg(letters=1, seen=1, slip=2, node_words=40)])
def test_against_brute_force(spark, cfg):
    rows = made_rows()
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), cfg)
    want = plain(rows, cfg)
    assert got == want
    assert sum(v[1] > 0 for v in want.values()) > 50 and len({v[4] for v in want.values()}) < len(want)


def test_odd_documents(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert found(odd) == plain(rows)
    assert found(none) == {}


def test_query_on_the_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in queries.documents(spark, sf_dir).collect()]
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in queries.op13_spelling(spark, sf_dir).collect()}
    assert got == plain(rows)


def test_ties_and_chains(spark):
    text = " ".join(["planet"] * 3 + ["planets"] * 6 + ["planetes"] * 12 + ["zlanet"] * 6 + ["planett"] * 6)
    got = found(spark.createDataFrame([(1, text)], "doc_id long, text string"), SpellingCfg(slip=10**9))
    # Three words are six times there; the smallest of them is the form.
    assert got["planet"][1:] == (3, "planets", 6, "planetes")
    assert got["planets"][1:] == (3, "planetes", 12, "planetes")
    assert got["planetes"][2] is None


def test_very_long_runs_and_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 64)
    rnd = random.Random(9)
    for text in (" ".join(w for _, w in made_rows(4, 3)), "ab" * 500 + " c " + "é" * 300, "", "x" * 64 + " " + "y" * 63 + " z"):
        parts = list(spelling.pieces(text))
        assert "".join(parts) == text
        assert [r for p in parts for r in spelling.RUN.findall(p)] == spelling.RUN.findall(text)
    long = "".join(rnd.choice("abc") for _ in range(3000))
    rows = [(1, " ".join([long] * 6 + [long[:-1]] * 3 + [long[:99] + "z" + long[100:]] * 3))]
    cfg = replace(SpellingCfg(), slip=10**9)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), cfg) == plain(rows, cfg)
