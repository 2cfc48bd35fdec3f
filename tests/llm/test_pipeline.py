import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regionlens.functions.globalindex import with_global_index
from regionlens.llm import decontaminate, packing, queries

from .conftest import odd_rows, order, sentence
from .test_simhash import plain_fingerprint, roots

# --- decontamination ---------------------------------------------------------------


def plain_tiles(item, text, least):
    """Greedy string tiling by comparing every pair of places."""
    item, text, covered = list(item), list(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] is not None and item[i + n] == text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        covered += n
        item[i : i + n] = [None] * n
        text[j : j + n] = [None] * n


def test_tiling_matches_brute_force():
    rnd = random.Random(6)
    for _ in range(150):
        item = [rnd.randrange(4) for _ in range(rnd.randint(1, 25))]
        text = [rnd.randrange(-1, 4) for _ in range(rnd.randint(0, 40))]
        least = rnd.choice([1, 2, 3, 5])
        tiles = decontaminate.tile(item, text, least)
        marked = set(), set()
        for i, j, n in tiles:
            assert n >= least and item[i : i + n] == text[j : j + n] and min(item[i : i + n]) >= 0
            for k in range(n):
                assert i + k not in marked[0] and j + k not in marked[1]
                marked[0].add(i + k), marked[1].add(j + k)
        plain = plain_tiles(item, [None if x < 0 else x for x in text], least)
        # The greedy choice among equal lengths may differ; the first and longest tile may not.
        if tiles or plain:
            assert max(n for *_, n in tiles) >= least and abs(len(marked[0]) - plain) <= max(2 * least, 4)


def test_many_equal_runs_take_linear_time():
    assert sum(n for *_, n in decontaminate.tile([1] * 60, [1] * 200_000, 5)) == 60


ITEMS = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", "tiny item", "", None, "one two three four five six seven eight nine ten"]


def test_documents_with_passages(spark, odd, none):
    rnd = random.Random(8)
    first, last = ITEMS[0].split(), ITEMS[4].split()
    moved = " ".join(last[5:] + ["and"] + last[:5])
    texts = [
        (f"{sentence(rnd, 40)} {ITEMS[0].upper()}! {sentence(rnd, 40)}", {10: 1.0}),
        (f"{sentence(rnd, 9)} {', '.join(first[:12])} {sentence(rnd, 9)}", {10: 0.6}),
        (f"{sentence(rnd, 9)} {' '.join(first[:8])} {sentence(rnd, 9)}", {}),
        (f"{moved} {sentence(rnd, 2000)}", {14: 1.0}),
        ("a tiny item here", {11: 1.0}), ("tiny other item", {}), (None, {}), ("", {}),
        (f"{ITEMS[4]} {ITEMS[0]}", {10: 1.0, 14: 1.0}),
        (f"{' '.join(reversed(first))}", {}),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, (t, _) in enumerate(texts)], "doc_id long, text string, hits string, item_id string").repartition(3)
    bench = spark.createDataFrame([(10 + i, t) for i, t in enumerate(ITEMS)], "item_id long, text string")
    for cfg in (decontaminate.TileCfg(), decontaminate.TileCfg(block_items=1)):
        got = {r.doc_id: {h.item_id: h.coverage for h in r.found} for r in decontaminate.with_hits(docs, bench, cfg, name="found").collect()}
        assert got == {i: h for i, (_, h) in enumerate(texts)}
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, (_, h) in enumerate(texts) if not h}
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.contaminated(odd, bench).count() == len(odd_rows()) and decontaminate.keep_clean(none, bench).count() == 0


def plain_hits(texts, items, cfg):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for name, text in texts:
        words = cut(text)
        grams = {tuple(words[i : i + cfg.min_match]) for i in range(len(words))}
        for item, t in items:
            w = cut(t)
            shared = [i for i in range(len(w) - cfg.min_match + 1) if tuple(w[i : i + cfg.min_match]) in grams]
            if len({i + k for i in shared for k in range(cfg.min_match)}) >= cfg.min_coverage * len(w):
                if plain_tiles(w, words, cfg.min_match) >= cfg.min_coverage * len(w):
                    yield name, item


def test_decontamination_query(spark, sf_dir):
    docs = [tuple(r) for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = {}
    for name, item in plain_hits(docs, items, decontaminate.TileCfg()):
        want.setdefault(name, set()).add(item)
    got = queries.op8_decontamination(spark, sf_dir).collect()
    assert len(got) == len(docs) and {r.doc_id: set(r.item_ids) for r in got if r.contaminated} == want and want


# --- packing ---------------------------------------------------------------


def padded(lengths, counts, tops):
    return sum(c * min(t for t in tops if t >= n) for n, c in zip(lengths, counts))


def test_numbering_broadcasts_offsets_only(spark):
    placed = with_global_index(spark.range(100, numPartitions=4).select((99 - F.col("id")).alias("k")), ["k"], "at")
    assert re.search(r"BroadcastHashJoin \[_part#\d+\], \[_part#\d+\], Inner, BuildRight", placed._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, placed.select("k", "at").collect())) == [(i, i) for i in range(100)]


def test_lengths_match_exhaustive_search():
    rnd = random.Random(9)
    for _ in range(60):
        lengths = sorted(rnd.sample(range(1, 60), rnd.randint(1, 9)))
        counts = [rnd.randint(1, 20) for _ in lengths]
        k = rnd.randint(1, 4)
        got = packing.best_lengths(lengths, counts, k)
        best = min(padded(lengths, counts, (*c, lengths[-1])) for n in range(k) for c in itertools.combinations(lengths[:-1], min(n, len(lengths) - 1)))
        assert len(got) <= k and got == sorted(got) and got[-1] == lengths[-1] and padded(lengths, counts, got) == best
    assert packing.best_lengths([], [], 3) == []


def check_packing(got, texts, cfg):
    size = lambda t: len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) + 1
    want = []
    for name, t in texts:
        n = size(t)
        want += [(name, p, min(cfg.max_len, n - p * cfg.max_len)) for p in range(-(-n // cfg.max_len))]
    assert order((r.doc_id, r.piece, r.n_tokens) for r in got) == order(want)
    tops = sorted({r.bucket_len for r in got})
    histogram = {}
    for *_, n in want:
        histogram[n] = histogram.get(n, 0) + 1
    assert tops == packing.best_lengths(list(histogram), list(histogram.values()), cfg.buckets)
    for b in tops:
        inside = sorted((r.batch, r.slot) for r in got if r.bucket_len == b)
        slots = max(1, cfg.budget // b)
        assert inside == [(i // slots, i % slots) for i in range(len(inside))]
    assert all(r.bucket_len == min(t for t in tops if t >= r.n_tokens) for r in got)


@pytest.mark.parametrize("cfg", [packing.PackCfg(), packing.PackCfg(max_len=16, buckets=3, budget=40), packing.PackCfg(max_len=5, buckets=9, budget=3)])
def test_packing_of_odd_documents(odd, none, cfg):
    check_packing(packing.pack(odd, cfg).collect(), [(r[0], r[1]) for r in odd_rows()], cfg)
    assert packing.pack(none, cfg).count() == 0


def test_packing_by_token_counts(spark):
    """Pieces and batches follow a column of counts: a long text without blanks is cut, and no batch passes its budget."""
    from regionlens.llm import token_counts

    rows = [(i, t) for i, t in enumerate(["日本語" * 400, "a b c", None, "", "word " * 300, "x" * 900])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counted = df.join(token_counts.token_counts(df).select("doc_id", "n_tokens"), "doc_id")
    cfg = packing.PackCfg(max_len=64, buckets=4, budget=256)
    got = packing.pack(counted, cfg, tokens="n_tokens").collect()
    want = {r["doc_id"]: r["n_tokens"] + 1 for r in counted.collect()}
    assert want[0] > 400 and {d: sum(r["n_tokens"] for r in got if r["doc_id"] == d) for d in want} == want
    for key in {(r["bucket_len"], r["batch"]) for r in got}:
        assert sum(r["bucket_len"] for r in got if (r["bucket_len"], r["batch"]) == key) <= cfg.budget


def test_packing_query(spark, sf_dir):
    texts = [tuple(r) for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()]
    check_packing(queries.op9_packing(spark, sf_dir).collect(), texts, packing.PackCfg())


# --- pipeline ---------------------------------------------------------------


def test_every_stage_by_brute_force(spark, sf_dir):
    from regionlens.llm import quality_classifier, quality_rules

    from .test_filters import plain_judge

    docs = queries.documents(spark, sf_dir)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "quality classifier", "simhash near copies", "benchmark decontamination", "packing"]
    step = {"start": docs.toPandas()}
    ids = lambda df: sorted(df["doc_id"].tolist())
    before = "start"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(step[before], docs.schema), sf_dir)
        assert name == "packing" or out.columns == columns
        step[name] = out.toPandas()
        before = name
    rows = list(step["start"][["doc_id", "text", "source"]].itertuples(index=False, name=None))
    assert ids(step["quality rules"]) == sorted(r[0] for r in plain_judge(rows, quality_rules.RuleCfg()) if r[-1])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_classifier.classify(spark.createDataFrame(step["quality rules"], docs.schema), labels)
    assert ids(step["quality classifier"]) == sorted(r.doc_id for r in judged.where("kept").collect())
    left = step["quality classifier"].sort_values("doc_id")
    fps = [plain_fingerprint(t) for t in left["text"]]
    root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    assert ids(step["simhash near copies"]) == sorted(int(left["doc_id"].iloc[r]) for r in set(root))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    texts = list(step["simhash near copies"][["doc_id", "text"]].itertuples(index=False, name=None))
    leaks = {name for name, _ in plain_hits(texts, items, decontaminate.TileCfg())}
    assert ids(step["benchmark decontamination"]) == sorted({i for i, _ in texts} - leaks)
    packed = step["packing"]
    check_packing(list(packed.itertuples()), list(step["benchmark decontamination"][["doc_id", "text"]].itertuples(index=False, name=None)), packing.PackCfg())
    whole = corpus_pipeline.run(spark, sf_dir)
    assert order(map(tuple, whole.select("doc_id", "piece", "n_tokens").collect())) == order(packed[["doc_id", "piece", "n_tokens"]].itertuples(index=False, name=None))


def test_stages_take_empty_and_odd_documents(spark, sf_dir, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, docs.limit(0)):
        step = start
        for _, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, sf_dir)
        assert (step.count() > 0) == (start is docs)
