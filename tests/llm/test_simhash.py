import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from regionlens.functions import materialize
from regionlens.llm import components as comp
from regionlens.llm import simhash

from .conftest import odd_rows, order


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g, seed=42).intdigest()
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("crowd", [0, 2, simhash.CROWD])
def test_groups_match_brute_force(odd, crowd):
    rows = [(r[0], r[1]) for r in odd_rows()]
    fps = [plain_fingerprint(t) for _, t in rows]
    close = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    root = roots(len(fps), close)
    least = {}
    for (name, _), r in zip(rows, root):
        if name is not None:
            least[r] = min(least.get(r, name), name)
    want = [(name, f"{fp:016x}", least.get(r)) for (name, _), fp, r in zip(rows, fps, root)]
    got = simhash.near_groups(odd, crowd=crowd)
    assert order(map(tuple, got.select("doc_id", simhash.hex16(F.col("fp")), "component_id").collect())) == order(want)


@pytest.mark.parametrize("crowd", [0, 8, 10**6])
def test_links_connect_what_hamming_distance_connects(spark, crowd):
    rnd = random.Random(3)
    fps = set()
    for _ in range(25):
        x = rnd.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    edges = [tuple(r) for r in simhash.links(df, crowd).collect()]
    at = {x: i for i, x in enumerate(signed)}
    mask = (1 << 64) - 1
    assert all(bin((a ^ b) & mask).count("1") <= 3 for a, b in edges)
    close = [(i, j) for i in range(len(signed)) for j in range(i) if bin((signed[i] ^ signed[j]) & mask).count("1") <= 3]
    assert roots(len(signed), close) == roots(len(signed), [(at[a], at[b]) for a, b in edges])


def test_exploded_tables_are_not_broadcast(spark):
    """Spark sizes probes and midpoints like the table they were exploded from, far too low."""
    plans = []

    def look(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    rnd = random.Random(4)
    near = {(7 << 32) | (rnd.getrandbits(4) << 40) | 1 for _ in range(30)}
    df = spark.createDataFrame([(x,) for x in near | {rnd.getrandbits(63) for _ in range(40)}], "fp long")
    fps = materialize.written(df)
    materialize.WATCHERS.append(look)
    try:
        look(simhash.links(fps, 2))
    finally:
        materialize.WATCHERS.remove(look)
    exploded = [p for p in plans if "Generate explode" in p and "Join" in p]
    assert len(exploded) == 2 and not any("Broadcast" in p for p in plans)


def test_components(spark):
    rnd = random.Random(1)
    n = 300
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(rnd.randrange(200, n), rnd.randrange(200, n)) for _ in range(60)]
    df = spark.createDataFrame(edges + [(7, 7)], "a long, b long")
    got = dict(tuple(r) for r in comp.components(df).collect())
    want = roots(n, edges)
    assert got == {v: want[v] for e in edges if e[0] != e[1] for v in e}
    assert comp.components(df.limit(0)).count() == 0


def test_one_of_each_group_stays(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    names = [r.doc_id for r in kept.select("doc_id").collect()]
    groups = simhash.near_groups(odd).collect()
    assert sorted(x for x in names if x is not None) == sorted({g.component_id for g in groups} - {None})
    # Only the lonely text is in a group without ids.
    assert kept.where("doc_id is null").select("text").collect() == [("lonely text here",)]
    assert simhash.keep_one(none).count() == 0 and simhash.near_groups(none).count() == 0


def test_one_id_with_different_texts(spark):
    rnd = random.Random(11)
    a, b, c = (" ".join(str(rnd.getrandbits(40)) for _ in range(80)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (5, b), (7, c), (7, None)]
    want = order([(3, a), (5, b), (7, c), (7, None)])
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "doc_id long, text string")
        for layout in (df.coalesce(1), df.repartition(3)):
            assert order(map(tuple, simhash.keep_one(layout).collect())) == want
