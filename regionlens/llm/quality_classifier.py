"""Document quality from the text, the site and the section of the site together.

A logistic regression on the shape of a text gives each document its own evidence.  The evidence is added up per
path (a section of a host) and per host, and shrunk level by level: a host towards all documents, a path
towards its host, the stronger the fewer documents it has.  A document's final log-odds are its own plus what its
path says beyond the prior of all documents; the document itself is left out of what its path says about it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.materialize import written
from regionlens.llm.text import words_of

SIDE = 1e-4  # evidence stays this far from certainty


@dataclass(frozen=True)
class ClassifierCfg:
    train_rows: int = 20_000  # labelled rows to fit on: those with the smallest hash of the id
    site_weight: float = 0.5  # of the path's log-odds beyond the prior
    threshold: float = 0.5
    seed_weight: float = 10.0  # prior weight, in documents, where the rates of the groups do not vary


def _features(text: Column) -> dict[str, Column]:
    """Shares between 0 and 1 that describe the shape of a text; all zero for an empty one."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = words_of(text)
    n = F.greatest(F.size(words), F.lit(1))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    share = lambda pattern: (F.length(t) - left(pattern)) / chars
    return {
        "upper": share("\\p{Lu}"),
        "symbols": share("[#*$%&<>{}\\[\\]=~^\\\\]"),
        "bars": share("\\|"),
        "shouts": share("[!?]"),
        "digits": share("[0-9]"),
        "different": F.size(F.array_distinct(words)) / n,
        "short": 1 / F.sqrt(n),
        "lines": F.size(F.array_distinct(F.split(t, "\\n"))) / F.greatest(F.size(F.split(t, "\\n")), F.lit(1)),
    }


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(SIDE)), F.lit(1 - SIDE))
    return F.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, cfg: ClassifierCfg, id_col: str, text: str) -> tuple[float, dict[str, float]]:
    """Intercept and weights of the document classifier, from at most ``train_rows`` labelled documents.

    Labels without id or quality are passed over.  Without documents of both kinds the evidence is
    the plain rate of good ones (one half without labels).
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select(F.col("doc_id").alias("_id"), (F.col("quality") > 0).cast("double").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(cfg.train_rows)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(written(known), "_id")
    feats = _features(F.col("_text"))
    train = written(rows.select("label", *[c.cast("double").alias(k) for k, c in feats.items()]))
    good, total = train.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if good in (0, total):
        rate = min(max((good + 0.5) / (total + 1), SIDE), 1 - SIDE)
        return math.log(rate / (1 - rate)), dict.fromkeys(feats, 0.0)
    model = LogisticRegression(regParam=1e-3, maxIter=50).fit(VectorAssembler(inputCols=list(feats), outputCol="features").transform(train))
    return float(model.intercept), dict(zip(feats, map(float, model.coefficients)))


def evidence(text: Column, model: tuple[float, dict[str, float]]) -> Column:
    """The classifier's probability that a text is good."""
    intercept, weights = model
    total = F.lit(intercept)
    for name, value in _features(text).items():
        total = total + F.lit(weights[name]) * value
    p = 1 / (1 + F.exp(-total))
    return F.least(F.greatest(p, F.lit(SIDE)), F.lit(1 - SIDE))


def _weight(groups: DataFrame, cfg: ClassifierCfg) -> float:
    """Weight of the beta prior of group rates ``s / n`` by their mean and variance."""
    m, v = groups.agg(F.avg(F.col("s") / F.col("n")), F.var_pop(F.col("s") / F.col("n"))).first()
    if m is None or not v or v <= 0:
        return cfg.seed_weight
    return max(m * (1 - m) / v - 1, 1.0)


def sites(scored: DataFrame, cfg: ClassifierCfg) -> tuple[DataFrame, float]:
    """Per ``host, path``: documents ``n``, their evidence ``s``, the host's shrunk rate; and the global rate.

    ``scored`` has ``host, path, p``.  Sums are partial aggregates, so a host with a third of
    all rows arrives as one row per task.  A NULL host or path is a group of its own.
    """
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")))
    n, s = hosts.agg(F.coalesce(F.sum("host_n"), F.lit(0)), F.coalesce(F.sum("host_s"), F.lit(0.0))).first()
    prior = s / n if n else 0.5
    k_host = _weight(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")), cfg)
    k_path = _weight(paths, cfg)
    rates = hosts.select("host", ((F.col("host_s") + k_host * prior) / (F.col("host_n") + k_host)).alias("host_rate"))
    joined = paths.alias("p").join(rates.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "host_rate")
    return written(joined.withColumn("k", F.lit(k_path))), prior


def combined(p: Column, prior: float, cfg: ClassifierCfg) -> Column:
    """Final probability of a row with its path's ``n, s, k, host_rate``, the row itself left out."""
    path_rate = (F.col("s") - p + F.col("k") * F.col("host_rate")) / (F.col("n") - 1 + F.col("k"))
    return 1 / (1 + F.exp(-(logit(p) + cfg.site_weight * (logit(path_rate) - logit(F.lit(prior))))))


def classify(
    docs: DataFrame, labels: DataFrame, cfg: ClassifierCfg = ClassifierCfg(),
    id_col: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
) -> DataFrame:
    """``doc_id, host, path, p_text, p_quality, kept`` of every row.

    The documents carry no URL, so the source stands for the host and the language for the section of the site; both are
    arguments.  NULL texts are empty; NULL hosts and paths are groups; repeated rows each get a row; other columns
    are ignored; an empty table gives an empty one.  Texts are read once for the evidence, which
    is written without them.
    """
    model = fit(docs, labels, cfg, id_col, text)
    scored = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"),
            evidence(F.col(text), model).alias("p"),
        )
    )
    groups, prior = sites(scored, cfg)
    same = F.col("d.host").eqNullSafe(F.col("g.host")) & F.col("d.path").eqNullSafe(F.col("g.path"))
    quality = combined(F.col("p"), prior, cfg)
    return scored.alias("d").join(groups.alias("g"), same).select(
        "doc_id", "d.host", "d.path", F.col("p").alias("p_text"), quality.alias("p_quality"),
        (quality >= cfg.threshold).alias("kept"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, cfg: ClassifierCfg = ClassifierCfg(),
    id_col: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
) -> DataFrame:
    """The documents that :func:`classify` keeps, with all their columns.

    Texts are read again to filter rather than shuffled; what is joined is the table of paths.
    """
    model = fit(docs, labels, cfg, id_col, text)
    p = evidence(F.col(text), model)
    groups, prior = sites(docs.select(F.col(host).alias("host"), F.col(path).alias("path"), p.alias("p")), cfg)
    whole = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(host).alias("host"), F.col(path).alias("path"), p.alias("p")
    )
    same = F.col("d.host").eqNullSafe(F.col("g.host")) & F.col("d.path").eqNullSafe(F.col("g.path"))
    kept = whole.alias("d").join(groups.alias("g"), same)
    return kept.where(combined(F.col("p"), prior, cfg) >= cfg.threshold).select("row.*")
