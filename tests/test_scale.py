"""Distributed algorithms against brute force: any partitioning, hot groups, copies, many blocks."""

import math

import numpy as np
import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from regionlens.config import ClusterCfg, ForestCfg, LofCfg
from regionlens.functions.globalindex import sliced, with_global_index
from regionlens.functions.quantile import bracket_aggregates, quantiles, settle
from regionlens.operators import anomalies, boxes, calendar, cluster, iforest, lof, profile, similarity


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one value, one date and one key."""
    rng = np.random.default_rng(1)
    data = [
        (i, "A" if i % 3 == 0 else f"S{int(rng.integers(0, 40))}", 7.0 if i % 3 == 0 else float(rng.normal(100, 40)))
        for i in range(3000)
    ]
    return spark.createDataFrame(data, "seq long, state string, v double")


def test_quantiles_match_numpy(spark, hot):
    probs = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 0.999, 1.0]
    df = hot.select("v", (F.col("seq") % 7).cast("double").alias("few"), F.lit(None).cast("double").alias("none"))
    got = quantiles(df, df.columns, probs)
    data = df.toPandas()
    for c in ("v", "few"):
        assert got[c] == pytest.approx(list(np.quantile(data[c], probs)))
    assert got["none"] == [None] * len(probs)


@pytest.mark.parametrize("sketch,slack,few", [(8, 0.2, 50), (8, 0.0, 10), (100, 0.01, 0), (4000, 0.0015, 50_000)])
def test_brackets_match_numpy(spark, sketch, slack, few):
    """Also with sketches that miss ranks, and where every bracket is narrowed before it is read."""
    rng = np.random.default_rng(4)
    n = 6000
    data = {
        "a": rng.normal(size=n),
        "b": np.where(rng.random(n) < 0.6, 0.0, rng.exponential(size=n)),
        "c": rng.integers(0, 9, n) * 1.0,
        "d": np.where(rng.random(n) < 0.01, -np.inf, np.exp(rng.normal(size=n) * 40)),
    }
    texts = [f"t{int(x)}" if x else None for x in data["c"]]
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in data.values()], texts)), "a double, b double, c double, d double, t string").repartition(6)
    probs = [0, 0.013, 0.25, 0.5, 0.9, 1]
    first = df.agg(*bracket_aggregates(df, list(data), probs, sketch, slack)).first().asDict()
    got, modes = settle(df, list(data), probs, first, ["t"], sketch, slack, few)
    for c, v in data.items():
        if c == "d":
            v, p = np.sort(v), [p for p in probs if p > 0.02]
            assert got[c][2:] == pytest.approx(list(np.quantile(v, p)))
        else:
            assert got[c] == pytest.approx(list(np.quantile(v, probs)))
    counts = {t: texts.count(t) for t in set(texts) - {None}}
    assert modes == {"t": min(counts, key=lambda t: (-counts[t], t))}


def test_aggregates_do_not_grow_with_ranks(spark, hot):
    few, many = (bracket_aggregates(hot, ["v", "seq"], [i / k for i in range(k + 1)]) for k in (1, 50))
    assert len(few) == len(many) == 4


def test_cuts_are_not_written_out_for_every_column(spark, monkeypatch):
    """Two comparisons a cut and column made a method that the JVM does not compile."""
    df = spark.range(2000).select(*[((F.col("id") * k) % 997).cast("double").alias(f"c{k}") for k in range(1, 8)])
    plans, collect = [], type(df).collect

    def seen(self):
        plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return collect(self)

    monkeypatch.setattr(type(df), "collect", seen)
    got = quantiles(df, df.columns, [0.25, 0.5, 0.9, 0.95])
    assert got["c1"] == pytest.approx(list(np.quantile(np.arange(2000) % 997, [0.25, 0.5, 0.9, 0.95])))
    (plan,) = [p for p in plans if ">=" in p]
    assert plan.count(">=") == 1


def test_quantiles_skip_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert quantiles(df, ["v"], [0.5])["v"] == [2.0]


@pytest.mark.parametrize("parts", [1, 37])
def test_global_index(spark, hot, parts):
    df = hot.withColumn("day", F.when(F.col("state") == "A", 5).otherwise((F.col("seq") % 11).cast("int")))
    got = with_global_index(df.repartition(parts), ["day", "seq"]).toPandas().sort_values(["day", "seq"])
    assert list(got["idx"]) == list(range(3000))


def test_slices_overlap_by_the_window(spark, hot):
    indexed = with_global_index(hot, ["seq"])
    cut = sliced(indexed, before=6, rows=50)
    assert cut.where("not _extra").count() == 3000
    assert cut.groupBy("_slice").count().agg(F.max("count")).first()[0] == 56


@pytest.mark.parametrize("parts", [1, 19])
def test_rolling_mean_over_slices(spark, hot, parts, monkeypatch):
    monkeypatch.setattr(calendar, "sliced", lambda df, before: sliced(df, before, rows=40))
    got = calendar.rolling_mean(hot.repartition(parts), "v", ["seq"]).toPandas().sort_values("seq")
    want = got["v"].rolling(7, min_periods=1).mean()
    assert np.allclose(got["rolling_mean"], want)


def facts_of(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(4000):
        s = "S00" if i % 3 == 0 else f"S{int(rng.integers(0, 30)):02d}"
        data.append((f"d{int(rng.integers(0, 60)):02d}", s, float(rng.integers(1, 9))))
    data += [("alone", "S98", 2.0), ("other", "S99", 3.0), ("alone", None, 2.0)]
    return spark.createDataFrame(data, "date string, state string, enrolment_count double")


@pytest.mark.parametrize("block", [512, 4])
def test_cosine_matches_numpy(spark, block):
    facts = facts_of(spark)
    got = {(a, b): s for a, b, s in rows(similarity.cosine_pairs(facts, block=block), "state1", "state2", "similarity")}
    wide = facts.toPandas().dropna().pivot_table(index="date", columns="state", values="enrolment_count", aggfunc="sum").fillna(0)
    m = wide.to_numpy()
    norm = np.sqrt((m * m).sum(axis=0))
    want = (m.T @ m) / np.outer(norm, norm)
    names = list(wide.columns)
    assert len(got) == len(names) * (len(names) - 1) // 2
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            assert got[(a, names[j])] == pytest.approx(want[i, j])
    assert got[("S98", "S99")] == 0.0


def test_cosine_worked_example(spark):
    df = spark.createDataFrame(
        [("d1", "A", 3.0), ("d2", "A", 4.0), ("d1", "B", 4.0), ("d3", "B", 3.0), ("d1", "C", 0.0)],
        "date string, state string, enrolment_count double",
    )
    assert rows(similarity.cosine_pairs(df)) == [("A", "B", pytest.approx(0.48)), ("A", "C", 0.0), ("B", "C", 0.0)]
    flat = rows(similarity.cosine_pairs(df.drop("date"), date=None))
    assert flat == [("A", "B", pytest.approx(1.0)), ("A", "C", 0.0), ("B", "C", 0.0)]


def brute_lof(x, k):
    """Local outlier factors at fit and at query time; ties between equal distances by vector."""
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))

    def near(i, own):
        order = sorted((j for j in range(n) if own or j != i), key=lambda j: (d[i, j], *x[j], j))
        return order[:k]

    fit = [near(i, False) for i in range(n)]
    kd = [d[i, fit[i][-1]] for i in range(n)]
    lrd_of = lambda i, nb: 1 / (np.mean([max(d[i, j], kd[j]) for j in nb]) + 1e-10)
    lrd = [lrd_of(i, fit[i]) for i in range(n)]
    score = [np.mean([lrd[j] for j in fit[i]]) / lrd[i] for i in range(n)]
    query = []
    for i in range(n):
        nb = near(i, True)
        query.append(np.mean([lrd[j] for j in nb]) / lrd_of(i, nb))
    return np.array(score), np.array(query)


@pytest.mark.parametrize("least", [0.2, 0.6, 0.95])
def test_similar_pairs_match_all_pairs(spark, least):
    rng = np.random.default_rng(8)
    rows = [(f"S{i:02d}", f"2024-01-{int(d) + 1:02d}", float(v)) for i in range(40) for d, v in zip(rng.integers(0, 30, 6), rng.exponential(size=6))]
    rows += [("T1", d, v) for s, d, v in rows if s == "S01"] + [("Z", "2024-01-01", 0.0)]
    df = spark.createDataFrame(rows, "state string, date string, enrolment_count double")
    got = {(r.state1, r.state2): r.similarity for r in similarity.similar_pairs(df, least).collect()}
    want = {(r.state1, r.state2): r.similarity for r in similarity.cosine_pairs(df).collect() if r.similarity >= least}
    assert got.keys() == want.keys() and ("S01", "T1") in got
    assert all(got[k] == pytest.approx(want[k]) for k in got)


@pytest.mark.parametrize("least", [0.1, 0.7])
def test_similar_pairs_on_shared_dates(spark, least):
    """All regions have all dates, but most of their counts in one season: other seasons are never compared."""
    rng = np.random.default_rng(12)
    data = []
    for i in range(60):
        season = i % 4
        for day in range(48):
            data.append((f"S{i:02d}", f"2024-{day // 4 + 1:02d}-{day % 4 + 1:02d}", float(rng.exponential() * (100 if day // 12 == season else 0.01))))
    df = spark.createDataFrame(data, "state string, date string, enrolment_count double")
    got = {(r.state1, r.state2): r.similarity for r in similarity.similar_pairs(df, least, block=5).collect()}
    want = {(r.state1, r.state2): r.similarity for r in similarity.cosine_pairs(df).collect() if r.similarity >= least}
    assert got.keys() == want.keys() and len(got) > 50
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    cells = similarity._cells(df, "date")
    unit = cells.join(similarity._norms(cells), "state").select("state", "date", (F.col("total") / F.col("norm")).alias("x"))
    blocks = similarity.blocked(unit, 5)
    sizes = {r["block"]: r["count"] for r in blocks.groupBy("block").count().collect()}
    compared = sum(sizes[r["b1"]] * sizes[r["b2"]] for r in similarity.block_pairs(blocks, least).collect())
    assert max(sizes.values()) == 5 and compared < 0.4 * 60 * 60 / 2 + 60 * 5


@pytest.mark.parametrize("few", [10_000, 0])
def test_boxes_of_skewed_data(spark, few, monkeypatch):
    """No box above its size, whatever the data; every point in one box, and every box a ball meets is found."""
    monkeypatch.setattr(boxes, "FEW_NODES", few)
    rng = np.random.default_rng(6)
    n = 4000
    x = np.column_stack([np.where(rng.random(n) < 0.6, 0.0, 50 * rng.random(n)), np.where(rng.random(n) < 0.999, 1.0, 9.0), rng.random(n)])
    df = spark.createDataFrame([(i, 1, *map(float, r)) for i, r in enumerate(x)], "pid long, copies long, x0 double, x1 double, x2 double").repartition(5)
    xs = ["x0", "x1", "x2"]
    cut = boxes.cut_boxes(df, xs, 50)
    placed = cut.placed.toPandas()
    assert sorted(placed["pid"]) == list(range(n)) and placed.groupby("box").size().max() <= 50
    corners = {r["node"]: (np.array(r["low"]), np.array(r["high"])) for r in cut.nodes.where("leaf").collect()}
    assert sum(placed.groupby("box").size()) == n and set(placed["box"]) == set(corners)
    some = df.where("pid < 40").withColumn("reach", F.col("pid") * 0.1)
    got = {(r["pid"], r["box"]) for r in boxes.touched(some, xs, cut).collect()}
    want = set()
    for p in range(40):
        for box, (low, high) in corners.items():
            if np.sqrt((np.maximum(np.maximum(low - x[p], x[p] - high), 0) ** 2).sum()) <= p * 0.1 * (1 + 1e-9):
                want.add((p, box))
    assert got == want
    # The node above a box with at most 60 rows holds more of them, and the box itself.
    for r in boxes.around(cut, 60).collect():
        inside = ((x >= np.array(r["far_low"])) & (x <= np.array(r["far_high"]))).all(axis=1)
        assert inside.sum() > 60 and inside[placed.loc[placed["box"] == r["box"], "pid"]].all()


@pytest.mark.parametrize("leaf_rows", [10, 100])
def test_lof_of_many_zeros(spark, leaf_rows):
    """Mostly zeros in the widest feature, copies, and boxes with fewer rows than neighbours."""
    rng = np.random.default_rng(7)
    x = np.column_stack([np.where(rng.random(300) < 0.6, 0.0, 30 * rng.random(300)), rng.random(300)])
    x = np.vstack([x, np.tile(x[:1], (60, 1))])
    df = spark.createDataFrame([(f"k{i}", float(a), float(b)) for i, (a, b) in enumerate(x)], "key string, a double, b double")
    got = lof.lof(df.repartition(7), ["a", "b"], ["key"], LofCfg(neighbours=20, leaf_rows=leaf_rows)).toPandas().set_index("key")
    score, _ = brute_lof((x - x.mean(axis=0)) / x.std(axis=0), 20)
    assert np.allclose(got.loc[[f"k{i}" for i in range(len(x))], "anomaly_score"], score)


@pytest.mark.parametrize("leaf_rows", [4096, 40])
def test_lof_matches_brute_force(spark, leaf_rows):
    rng = np.random.default_rng(5)
    x = np.vstack(
        [
            rng.normal(0, 1, (220, 2)),
            np.tile([[0.25, -0.5]], (120, 1)),  # a third are copies of one point
            rng.normal(6, 0.2, (30, 2)),
            [[15.0, -9.0], [14.5, 11.0]],
        ]
    )
    df = spark.createDataFrame([(f"k{i}", float(a), float(b)) for i, (a, b) in enumerate(x)], "key string, a double, b double")
    cfg = LofCfg(neighbours=20, leaf_rows=leaf_rows)
    got = lof.lof(df.repartition(13), ["a", "b"], ["key"], cfg).toPandas().set_index("key")
    std = (x - x.mean(axis=0)) / x.std(axis=0)
    score, query = brute_lof(std, 20)
    names = [f"k{i}" for i in range(len(x))]
    assert np.allclose(got.loc[names, "anomaly_score"], score)
    flags = (query > np.quantile(score, 0.9)).astype(int)
    close = np.isclose(query, np.quantile(score, 0.9))
    assert (got.loc[names, "is_anomaly"].to_numpy() == flags)[~close].all()


def test_lof_with_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 9.0)], "key string, v double")
    got = dict(rows(lof.lof(df, ["v"], ["key"]), "key", "anomaly_score"))
    std = (np.array([[1.0], [2.0], [9.0]]) - 4) / np.std([1.0, 2.0, 9.0])
    assert [got[k] for k in "abc"] == pytest.approx(list(brute_lof(std, 2)[0]))
    assert lof.lof(df.limit(1), ["v"], ["key"]).first()["is_anomaly"] == 0


def spiked(spark):
    rng = np.random.default_rng(9)
    data = [(f"r{i}", float(rng.normal()), float(rng.normal())) for i in range(1500)]
    data += [(f"spike{i}", 25.0 + i, -30.0 - i) for i in range(5)]
    return spark.createDataFrame(data, "key string, a double, b double")


def test_forest_finds_spikes_and_ignores_partitioning(spark):
    df = spiked(spark)
    one = iforest.isolation_forest(df.repartition(1), ["a", "b"], ["key"]).toPandas().set_index("key").sort_index()
    many = iforest.isolation_forest(df.repartition(23), ["a", "b"], ["key"]).toPandas().set_index("key").sort_index()
    assert np.allclose(one["anomaly_score"], many["anomaly_score"]) and (one["is_anomaly"] == many["is_anomaly"]).all()
    assert ((one["anomaly_score"] > 0) & (one["anomaly_score"] <= 1)).all()
    assert abs(one["is_anomaly"].mean() - 0.1) < 0.01
    assert set(one.sort_values("anomaly_score").index[-5:]) == {f"spike{i}" for i in range(5)}


def test_forest_samples_stay_bounded(spark):
    df = spark.range(50_000).select(F.col("id").cast("string").alias("key"), F.rand(1).alias("a"))
    drawn = iforest.sample_per_tree(df, ["key"], ForestCfg(trees=7))
    assert {r["count"] for r in drawn.groupBy("tree").count().collect()} == {256}
    assert drawn.select("tree", "key").distinct().count() == 7 * 256


def test_path_lengths():
    assert iforest.mean_path(1) == 0 and iforest.mean_path(2) == 1
    assert iforest.mean_path(256) == pytest.approx(10.244770920)


def regions(spark, n=60):
    rng = np.random.default_rng(2)
    data = [(f"S{i:03d}", int(i % 3), float(rng.normal(10 * (i % 3), 1)), float(rng.normal())) for i in range(n)]
    data.append(("S999", 7, 100.0, 5.0))
    return spark.createDataFrame(data, "state string, cluster int, total_enrolments double, b double")


@pytest.mark.parametrize("block", [1024, 9])
def test_silhouette_matches_brute_force(spark, block):
    df = regions(spark)
    pdf = df.toPandas()
    x = pdf[["total_enrolments", "b"]].to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    label = pdf["cluster"].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = (label == label[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[i, label == label[i]].sum() / (own - 1)
        b = min(d[i, label == c].mean() for c in set(label) if c != label[i])
        out.append((b - a) / max(a, b))
    got = cluster.silhouette(df, ["total_enrolments", "b"], block=block).first()[0]
    assert got == pytest.approx(np.mean(out))
    assert cluster.silhouette(df.withColumn("cluster", F.lit(0)), ["b"]).first()[0] is None


def test_kmeans_separates_groups_and_ignores_partitioning(spark):
    df = regions(spark).where("state <> 'S999'").drop("cluster", "b")
    cfg = ClusterCfg(k=3, restarts=4)
    one = cluster.kmeans_states(df.repartition(1), cfg).toPandas().set_index("state").sort_index()
    many = cluster.kmeans_states(df.repartition(17), cfg).toPandas().set_index("state").sort_index()
    assert (one["cluster"] == many["cluster"]).all()
    group = [int(s[1:]) % 3 for s in one.index]
    assert len(set(zip(group, one["cluster"]))) == 3
    few = cluster.kmeans_states(df.limit(2), ClusterCfg(restarts=1))
    assert few.agg(F.max("cluster")).first()[0] <= 1
    assert cluster.kmeans_states(df.limit(1)).first()["cluster_label"] == "Cluster 1"


@pytest.mark.parametrize("k,restarts", [(3, 4), (5, 1), (8, 10)])
def test_kmeans_matches_plain_rounds(spark, k, restarts):
    """Farthest-point seeds and Lloyd rounds written out for one array, with copies and ties among the regions."""
    rng = np.random.default_rng(k)
    x = np.vstack([rng.normal(c, 0.4, (12, 2)) for c in (0, 3, 8)] + [np.tile([[1.0, 1.0]], (9, 1))])
    names = [f"S{i:02d}" for i in rng.permutation(len(x))]
    df = spark.createDataFrame([(s, float(a), float(b)) for s, (a, b) in zip(names, x)], "state string, a double, b double")
    got = {r["state"]: r["cluster"] for r in cluster.kmeans_states(df.repartition(6), ClusterCfg(k=k, restarts=restarts)).collect()}
    order = np.argsort(names)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    z = (np.round(z * cluster.UNIT) / cluster.UNIT)[order]
    best = None
    for first in np.argsort(-(z**2).sum(axis=1), kind="stable")[:restarts]:
        centres = [z[first]]
        while len(centres) < k:
            centres.append(z[np.argmax(np.min([((z - c) ** 2).sum(axis=1) for c in centres], axis=0))])
        centres = np.array(centres)
        while True:
            d = ((z[:, None] - centres[None]) ** 2).sum(axis=2)
            near = d.argmin(axis=1)
            new = np.array([z[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(k)])
            if np.allclose(new, centres, rtol=0, atol=0):
                break
            centres = new
        cost = d.min(axis=1).sum()
        if best is None or cost < best[0] - 1e-9:
            best = (cost, near)
    first = {}
    for c in best[1]:
        first.setdefault(c, len(first))
    assert [got[s] for s in sorted(names)] == [first[c] for c in best[1]]


def test_squared_silhouette_matches_brute_force(spark):
    df = regions(spark)
    pdf = df.toPandas()
    x = pdf[["total_enrolments", "b"]].to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    label = pdf["cluster"].to_numpy()
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = []
    for i in range(len(x)):
        own = (label == label[i]).sum()
        a = d[i, label == label[i]].sum() / max(own - 1, 1)
        b = min(d[i, label == c].mean() for c in set(label) if c != label[i])
        out.append((b - a) / max(a, b) if own > 1 else 0.0)
    assert cluster.squared_silhouette(df, ["total_enrolments", "b"]).first()[0] == pytest.approx(np.mean(out))
    assert cluster.squared_silhouette(df.withColumn("cluster", F.lit(0)), ["b"]).first()[0] is None


def test_correlations_of_a_wide_table(spark):
    """300 columns with gaps in one scan; far from zero, constant, and constant where the other has values."""
    rng = np.random.default_rng(3)
    n, d = 400, 300
    x = rng.normal(size=(n, d)) * np.logspace(-3, 6, d) + 1e7
    x[rng.random((n, d)) < 0.1] = np.nan
    x[:, 7] = 0.1
    x[:, 8] = np.where(np.isnan(x[:, 9]), x[:, 8], 3.3)
    cells = ", ".join(f"c{i} double" for i in range(d))
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], cells).repartition(4)
    got = {(r["column1"], r["column2"]): r["correlation"] for r in profile.pairwise_pearson(df).collect()}
    assert len(got) == d * (d - 1) // 2
    for i, j in [(0, 1), (7, 9), (8, 9), (3, 7), *rng.integers(10, d, (300, 2)).tolist()]:
        if i == j:
            continue
        i, j = sorted((i, j))
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        if a.std() < 1e-12 or b.std() < 1e-12:
            assert got[f"c{i}", f"c{j}"] is None
        else:
            assert got[f"c{i}", f"c{j}"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)


def test_pca_matches_numpy(spark):
    df = regions(spark).withColumn("c", F.col("b") * 2 + F.col("total_enrolments"))
    cols = ["total_enrolments", "b", "c"]
    got = cluster.pca_2d(df, cols).toPandas().set_index("state").sort_index()
    x = df.toPandas().set_index("state").sort_index()[cols].to_numpy()
    x = x - x.mean(axis=0)
    _, vec = np.linalg.eigh(np.cov(x.T))
    for name, v in (("x", vec[:, -1]), ("y", vec[:, -2])):
        v = v * (1 if v[np.argmax(np.abs(v))] >= 0 else -1)
        assert np.allclose(got[name], x @ v)


def test_descriptions_are_keyed_by_cluster(spark):
    df = regions(spark).select("state", "cluster", "total_enrolments")
    got = dict(rows(cluster.describe_clusters(df).select("cluster", "cluster_description").distinct()))
    assert set(got) == {0, 1, 2, 7}
    assert got[7] == "Cluster 8: High Volume" and got[0] == "Cluster 1: Low Volume"


def test_detector_without_features(spark):
    df = spark.createDataFrame([("A", "2024-01")], "state string, year_month string")
    row = anomalies.detect_anomalies(df).first()
    assert (row["is_anomaly"], row["anomaly_score"], row["anomaly_confidence"]) == (0, 0.0, "LOW")
    with pytest.raises(ValueError):
        anomalies.detect_anomalies(spark.range(1), "other")
    assert math.isclose(iforest.mean_path(3), 2 * (math.log(2) + np.euler_gamma) - 4 / 3)
