"""Quality rules judged by host: native Spark expressions only.

Four rules look at each document.  Their failures are counted per host, the rates are shrunk with
a beta prior fitted to all hosts, and a host whose shrunk rate is too high under any rule loses
all its documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.materialize import written
from regionlens.llm.text import words_of

RULES = ("short", "repeats", "symbols", "lines")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RuleCfg:
    min_words: int = 50  # fewer fails the document
    max_repeat_pct: int = 50  # more per cent of words in repeated windows fails the document
    max_symbol_pct: int = 10  # more symbols per hundred word characters fails the host rule
    max_dup_line_pct: int = 30  # more repeated lines per hundred lines with words fails the host rule
    max_host_rate: float = 0.5  # a host above this shrunk rate is rejected


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, also where the optimizer copies the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Windows are compared by 64-bit hash: sorting (hash, place) brings equal ones together, their
    places spread over three words each, and the different places are counted.
    """

    def hashes(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)),
        )

    def places(s: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def counted(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # Most texts repeat no window at all; the set of hashes tells so without a sort.
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(ordered, places))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_bound(words, lambda w: _bound(hashes(w), counted)))


def counts_of(docs: DataFrame, text: str = "text", words: str = "_words") -> DataFrame:
    """Add the word, symbol, line and repetition counts (all ``long``) of ``text``.

    NULL and blank texts count zero everywhere.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.col(words)
    lines = F.filter(F.split(t, "\\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumn(words, words_of(F.col(text))).withColumn("_lines", lines)
    return out.select(
        *[F.col(c) for c in docs.columns],
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    )


def failures(cfg: RuleCfg) -> dict[str, Column]:
    """The rules over the columns of :func:`counts_of`; true where a document fails."""
    return {
        "short": F.col("n_words") < cfg.min_words,
        "repeats": 100 * F.col("n_repeat_words") > cfg.max_repeat_pct * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > cfg.max_symbol_pct * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > cfg.max_dup_line_pct * F.col("n_lines"),
    }


def host_rates(judged: DataFrame, host: str) -> DataFrame:
    """Shrunk failure rate of every host under every rule, and the host's verdict columns.

    ``judged`` has one boolean column per rule.  The beta prior of a rule comes from the mean m
    and the variance v of the plain host rates: its weight is k = m(1-m)/v - 1, the shrunk
    rate (failures + k m) / (documents + k).  Without variance every host gets m.  Rows without
    host form no host.
    """
    hosts = written(
        judged.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    )
    moments = hosts.agg(
        *[F.avg(F.col(r) / F.col("n")).alias(f"{r}_m") for r in RULES],
        *[F.var_pop(F.col(r) / F.col("n")).alias(f"{r}_v") for r in RULES],
    ).first()
    out = []
    for r in RULES:
        m, v = moments[f"{r}_m"] or 0.0, moments[f"{r}_v"] or 0.0
        if v > 0:
            k = max(m * (1 - m) / v - 1, 0.0)
            rate = (F.col(r) + F.lit(k * m)) / (F.col("n") + F.lit(k))
        else:
            rate = F.lit(m)
        out.append(rate.alias(f"{r}_rate"))
    return hosts.select("host", "n", *out)


def bad_hosts(rates: DataFrame, cfg: RuleCfg) -> DataFrame:
    """Hosts above the highest rate under any rule, one column ``host``."""
    worst = F.greatest(*[F.col(f"{r}_rate") for r in RULES])
    return rates.where(worst > cfg.max_host_rate).select("host")


def judge(docs: DataFrame, cfg: RuleCfg = RuleCfg(), id_col: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Counts and verdict of every document.

    Returns ``doc_id, host``, the counts, ``base_failed`` (own rules ``short`` or ``repeats``),
    ``host_bad`` and ``kept`` (neither).  The counts are written once without the texts, because
    the host rates and the verdicts both read them.  The host verdicts are joined back as the short
    list of rejected hosts.  A document without host is judged by its own rules; NULL text is
    empty and therefore short; repeated rows are each judged and counted; other columns are
    ignored; an empty table gives an empty one.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    fails = failures(cfg)
    judged = written(counts_of(plain).drop("text").select("*", *[c.alias(r) for r, c in fails.items()]))
    bad = written(bad_hosts(host_rates(judged, "host"), cfg)).withColumn("host_bad", F.lit(True))
    return (
        judged.join(bad, "host", "left")
        .withColumn("base_failed", F.col("short") | F.col("repeats"))
        .withColumn("host_bad", F.coalesce("host_bad", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_bad"))
        .select("doc_id", "host", *COUNTS, *RULES, "base_failed", "host_bad", "kept")
    )


def keep_good(docs: DataFrame, cfg: RuleCfg = RuleCfg(), host: str = "source", text: str = "text") -> DataFrame:
    """The documents that :func:`judge` keeps, with all their columns.

    The texts are read twice and never shuffled: once to count failures per host, once to filter.
    """
    plain = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    fails = failures(cfg)
    rates = host_rates(counts_of(plain).select("host", *[c.alias(r) for r, c in fails.items()]), "host")
    bad = written(bad_hosts(rates, cfg))
    struct = F.struct(*[F.col(c) for c in docs.columns])
    whole = docs.select(struct.alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    good = counts_of(whole).where(~(fails["short"] | fails["repeats"]))
    return good.join(bad, "host", "left_anti").select("row.*")
