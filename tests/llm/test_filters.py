import collections
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from regionlens.llm import license_scan, quality_classifier, quality_rules, queries, url_filter

from .conftest import odd_rows, order

# --- URL filter ---------------------------------------------------------------


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    fit = []
    for kind, rule in rules:
        at, _, tail = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + tail):
            fit.append((rule, kind))
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


URLS = [
    None, "", "no host", "http://", "https://NET/", "https://net", "https://a.net/x", "https://a.net?x=/", "https://planet/", "http://example.net/en/1",
    "http://www.Example.NET/en/1", "http://example.net/EN/1", "http://example.net/en", "https://m.example.com/de/5", "https://badexample.com/de/5",
    "https://x.org/fr/", "https://x.org/frx", "https://x.org#/fr/", "a://b://c/d", "ftp://ü.É.org/fr/é?q#z", "https://cheap-pills.example.com/en/1\nx",
    "https://library.example.org/es/2", "https://" + "long." * 3000 + "org/fr/" + "x" * 5000,
]


def test_urls(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(1, URLS[8], "h", "r"), (None, URLS[9], "h", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = url_filter.judge(df).collect()
    want = [(i, *plain_parts(u), *plain_rule(*plain_parts(u), url_filter.RULES)) for i, u, *_ in rows]
    assert order((r.page_id, r.host, r.path, r.rule) for r in got) == order(w[:4] for w in want)
    for r in got:
        kind = plain_rule(r.host, r.path, url_filter.RULES)[1]
        assert r.verdict == (kind or ("block" if r.host and r.p_junk >= 0.5 else "allow"))
    verdicts = {r.page_id: r.verdict for r in got}
    assert verdicts[20] == "block" and verdicts[21] == "allow" and verdicts[0] == verdicts[2] == "allow"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_longer_rule_wins(spark):
    df = spark.createDataFrame([("https://a.b.org/x/y",)], "url string").withColumn("page_id", F.lit(1))
    rules = [("block", "org/"), ("allow", "b.org/x/"), ("block", "a.b.org/")]
    assert plain_rule("a.b.org", "/x/y", rules)[0] == "b.org/x/"
    assert url_filter.judge(df, rules=rules).first().rule == "b.org/x/"


def test_url_query_covers_all_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    got = queries.op1_url_filter(spark, sf_dir).collect()
    want = [(p.page_id, *plain_parts(p.url), *plain_rule(*plain_parts(p.url), url_filter.RULES)) for p in pages]
    assert order((r.page_id, r.host, r.path, r.rule) for r in got) == order(w[:4] for w in want)


def test_regression_tells_unseen_hosts_apart(spark):
    junk = ["https://top-casino-pills.example.org/en/5", "http://free-adult-bets.example.com/fr/1"]
    fine = ["https://northern-museum.example.com/en/5", "http://m.history-school.example.com/fr/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(junk + fine)], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(df, rules=()).orderBy("page_id").collect()] == ["block", "block", "allow", "allow"]


def test_paths_and_names_outside_the_table(spark):
    junk = [
        "https://www.example.org/casino-royal/free-bets", "https://portal.example.com/buy/cheap-viagra-pills", "http://m.example.net/live/adult-cams.html",
        "https://example.com/en/best-payday-loans", "https://www.casino-win.example.net/es/1", "https://ads-track.example.org/fr/3", "https://spam-farm.example.com/en/4",
    ]
    fine = [
        "https://www.example.org/town-library/events", "https://portal.example.com/garden/tulips.html", "http://m.example.net/en/school-museum",
        "https://example.com/articles/science-history", "https://www.city-museum.example.net/es/1", "https://weather-station.example.org/fr/3", "https://www.example.org/en/4",
    ]
    held = {r.url for r in url_filter.labelled_urls(spark).collect()}
    assert not held & {*junk, *fine} and not any(n in u for u in held for n in ("casino-win", "free-bets", "cheap-pills", "adult-x", "ads-track", "spam-farm"))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(junk + fine)], "page_id long, url string")
    got = [r.verdict for r in url_filter.judge(df, rules=()).orderBy("page_id").collect()]
    assert got == ["block"] * len(junk) + ["allow"] * len(fine)


# --- license scan ---------------------------------------------------------------


def plain_scan(rows, templates, cfg):
    for name, text in rows:
        w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
        grams = [" ".join(w[i : i + cfg.words]) for i in range(len(w) - cfg.words + 1)]
        for lic, size, shingles in license_scan.template_shingles(templates, cfg):
            best = None
            for k in range(max(1, len(grams) // size + 1)):
                inside = [(g, k * size + i) for i, g in enumerate(grams[k * size : (k + 2) * size]) if g in shingles]
                share = len({g for g, _ in inside}) / len(shingles)
                if share >= cfg.containment and (best is None or share > best[0]):
                    best = (share, inside[0][1])
            if best:
                yield name, lic, *best


def test_licenses(spark, odd, none):
    full = dict(license_scan.TEMPLATES)
    words = full["MIT-grant"].split()
    texts = [
        "start " + full["MIT"] + " end", "x " * 37 + full["GPL-3.0-notice"], full["MIT-grant"].upper(), " ".join(words[:-4]), " ".join(words[: len(words) // 2]),
        " ".join(license_text for license_text in full.values()), full["GPL-3.0"].replace("public", "private"), full["Apache-2.0-notice"].replace(" ", "\n"), None, "",
        "filler " * 300 + full["BSD-3-Clause"] + " filler" * 300, (full["CC-BY-NC-4.0"] + " ") * 500,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, license string, size string")
    cfg = license_scan.LicenseCfg()
    want = order(plain_scan(rows, license_scan.TEMPLATES, cfg))
    assert order(map(tuple, license_scan.scan(df).collect())) == want and len(want) > 15
    small = license_scan.LicenseCfg(block_shingles=10, bands=30, rows=1)
    assert order(map(tuple, license_scan.scan(df, cfg=small).collect())) == want
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(none).count() == 0
    assert license_scan.scan(df, templates=[("none", "too short")]).count() == 0


GNU = (
    "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "{} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "{} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n{}\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
    "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED."
)
NAMES = (
    "{} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)


def test_licenses_of_one_family_are_told_apart(spark):
    cases = [
        (GNU.format("program", ";", "", 2), {"GPL-2.0-notice"}),
        (GNU.format("program", ":", "", 3), {"GPL-3.0-notice"}),
        (GNU.format("library", ";", "Lesser ", "2.1"), {"LGPL-2.1-notice"}),
        (GNU.format("library", ":", "Lesser ", 3), {"LGPL-3.0-notice"}),
        (GNU.format("program", ":", "Affero ", 3), {"AGPL-3.0-notice"}),
        (BSD.format("1.", "2.", ""), {"BSD", "BSD-2-Clause"}),
        (BSD.format("*", "*", ""), {"BSD", "BSD-2-Clause"}),
        (BSD.format("1.", "2.", NAMES.format("3.")), {"BSD", "BSD-3-Clause", "BSD-3-Clause-plain"}),
        (BSD.format("*", "*", NAMES.format("*")), {"BSD", "BSD-3-Clause", "BSD-3-Clause-plain"}),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", set()),
    ]
    df = spark.createDataFrame([(i, f"some words before {t} some words behind") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    found = collections.defaultdict(set)
    for r in license_scan.scan(df).collect():
        found[r.doc_id].add(r.license)
    assert [found[i] for i in range(len(cases))] == [want for _, want in cases]


def test_no_template_holds_that_of_another_license():
    cfg = license_scan.LicenseCfg()
    whole = dict(license_scan.TEMPLATES)
    for name, _, shingles in license_scan.template_shingles(license_scan.TEMPLATES, cfg):
        for other, text in whole.items():
            if not license_scan.same_license(name, other):
                w = [x for x in re.split(r"[^\w]+|_", text.lower()) if x]
                inside = {" ".join(w[i : i + cfg.words]) for i in range(len(w) - cfg.words + 1)} & set(shingles)
                assert len(inside) < cfg.containment * len(shingles), (name, other)
    # Texts that nothing tells apart stay whole.
    same = license_scan.template_shingles([("a", "one two three four five six"), ("b", "one two three four five six")], cfg)
    assert [len(s) for _, _, s in same] == [2, 2]


# --- quality rules ---------------------------------------------------------------


def plain_counts(text):
    t = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in t)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(lines)


def plain_judge(rows, cfg):
    counts = [plain_counts(t) for _, t, _ in rows]
    fails = [
        (n < cfg.min_words, 100 * rep > cfg.max_repeat_pct * n, 100 * sym > cfg.max_symbol_pct * ch, 100 * dup > cfg.max_dup_line_pct * ln)
        for n, ch, sym, dup, rep, ln in counts
    ]
    hosts = collections.defaultdict(list)
    for (_, _, h), f in zip(rows, fails):
        if h is not None:
            hosts[h].append(f)
    bad = set()
    for k in range(4):
        rates = {h: sum(f[k] for f in fs) / len(fs) for h, fs in hosts.items()}
        m = sum(rates.values()) / max(1, len(rates))
        v = sum((r - m) ** 2 for r in rates.values()) / max(1, len(rates))
        for h, fs in hosts.items():
            weight = max(m * (1 - m) / v - 1, 0) if v > 0 else 0
            if ((sum(f[k] for f in fs) + weight * m) / (len(fs) + weight) if v > 0 else m) > cfg.max_host_rate:
                bad.add(h)
    return [(i, *c[:5], f[0] or f[1], not (f[0] or f[1]) and h not in bad) for (i, _, h), c, f in zip(rows, counts, fails)]


@pytest.mark.parametrize("cfg", [quality_rules.RuleCfg(), quality_rules.RuleCfg(min_words=3, max_host_rate=0.05)])
def test_rules_match_brute_force(odd, none, cfg):
    rows = [(r[0], r[1], r[3]) for r in odd_rows()]
    want = plain_judge(rows, cfg)
    got = quality_rules.judge(odd, cfg).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")
    assert order(map(tuple, got.collect())) == order(want)
    kept = quality_rules.keep_good(odd, cfg)
    assert kept.columns == odd.columns
    assert order((r.doc_id,) for r in kept.collect()) == order((w[0],) for w in want if w[-1])
    assert quality_rules.judge(none, cfg).count() == 0 and quality_rules.keep_good(none, cfg).count() == 0


def test_rules_use_no_python(spark, sf_dir):
    for df in (queries.op10_quality_rules(spark, sf_dir), quality_rules.keep_good(queries.documents(spark, sf_dir)), queries.op2_license_scan(spark, sf_dir)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert order(map(tuple, got.select(*names).collect())) == order(want.fetchall())


# --- quality classifier ---------------------------------------------------------------


def test_levels_match_the_formulas(spark):
    cfg = quality_classifier.ClassifierCfg()
    rows = [("a", "x", 0.9), ("a", "x", 0.8), ("a", "y", 0.1), ("b", "x", 0.2), ("b", None, 0.3), (None, None, 0.6), (None, None, 0.7)]
    df = spark.createDataFrame(rows, "host string, path string, p double").repartition(3)
    got = {(r.host, r.path): r for r in quality_classifier.sites(df, cfg)[0].collect()}
    prior = quality_classifier.sites(df, cfg)[1]
    assert prior == pytest.approx(sum(r[2] for r in rows) / len(rows))

    def grouped(key):
        out = collections.defaultdict(list)
        for r in rows:
            out[key(r)].append(r[2])
        return out

    def weight(groups):
        rates = [sum(g) / len(g) for g in groups.values()]
        m = sum(rates) / len(rates)
        return max(m * (1 - m) / (sum((r - m) ** 2 for r in rates) / len(rates)) - 1, 1.0)

    hosts, paths = grouped(lambda r: r[0]), grouped(lambda r: r[:2])
    for key, ps in paths.items():
        h = hosts[key[0]]
        assert got[key].n == len(ps) and got[key].s == pytest.approx(sum(ps)) and got[key].k == pytest.approx(weight(paths))
        assert got[key].host_rate == pytest.approx((sum(h) + weight(hosts) * prior) / (len(h) + weight(hosts)))
    one = df.where("host = 'a' and path = 'x' and p > 0.85").join(quality_classifier.sites(df, cfg)[0], ["host", "path"])
    k, rate = weight(paths), got["a", "x"].host_rate
    path = (0.8 + k * rate) / (1 + k)
    lo = lambda p: math.log(p / (1 - p))
    want = 1 / (1 + math.exp(-(lo(0.9) + cfg.site_weight * (lo(path) - lo(prior)))))
    assert one.select(quality_classifier.combined(F.col("p"), prior, cfg)).first()[0] == pytest.approx(want)


def test_classifier_on_odd_documents(odd, none, spark):
    labels = spark.createDataFrame([(i, int(i not in (13, 14, 15)), 0) for i in range(8, 40)] + [(None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(odd, labels)
    assert got.count() == len(odd_rows())
    kept = quality_classifier.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert order((r.doc_id,) for r in kept.collect()) == order((r.doc_id,) for r in got.where("kept").collect())
    assert quality_classifier.classify(none, labels).count() == 0
    # No labels, or labels of one kind only: every text has the same evidence.
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert quality_classifier.classify(odd, some).select("p_text").distinct().count() == 1


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = queries.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    test = labels.where("doc_id % 2 = 1")
    got = quality_classifier.classify(docs, labels.where("doc_id % 2 = 0")).join(test, "doc_id")
    right, good, kept = got.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double")), F.sum("quality"), F.sum(F.when(F.col("kept"), F.col("quality")))).first()
    assert right > 0.97 and kept >= 0.99 * good
