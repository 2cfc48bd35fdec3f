"""URL filter: fixed rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.llm.text import ascii_lower

# Default rules: (verdict, host and path).
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)

# Names of sites and paths of the small labelled table to train on; invented, and none of them taken from given pages.
UNWANTED = (
    "pills-online", "best-pills-shop", "cheap-meds", "viagra-store", "sports-bets", "bets-now", "free-spins", "casino-royal", "big-casino", "poker-bonus",
    "slots-jackpot", "adult-chat", "adult-videos", "xxx-cams", "payday-loan", "fast-loan", "quick-cash", "spam-mail", "spam-links", "ads-server",
    "ads-click", "pixel-tracker", "link-farm", "replica-watches",
)
WANTED = (
    "library", "gardening", "news", "university", "weather", "museum", "recipes", "travel", "theatre", "science", "school", "history",
    "town-hall", "hospital", "railway", "cycling-club", "local-radio", "choir", "bakery", "mathematics", "open-data", "city-archive", "football", "bookshop",
)
PREFIXES = ("", "www.", "m.", "blog.")
ENDINGS = ("example.com", "example.net", "example.org")
PATHS = ("/en/12", "/fr/340.html", "/de/7/", "/es/2041", "/en/99.html", "/", "/fr/5/", "/de/1203")
UNWANTED_PATHS = (
    "/online-casino/12", "/casino-bonus.html", "/play/poker-slots", "/slots/jackpot/", "/bets/football-odds", "/free-spins", "/betting-tips/7", "/buy-pills.html",
    "/cheap-viagra/", "/shop/pills-online", "/meds/no-prescription", "/adult/videos/34", "/xxx-cams/live", "/sexy-adult-chat.html", "/payday-loans/apply", "/fast-cash-loan",
    "/replica-watches/sale", "/spam/links", "/ads/click/3", "/track/ads/pixel", "/link-farm/page-2", "/win-cash-prizes", "/casino/win-big", "/cheap-meds/99",
)
WANTED_PATHS = (
    "/town/history.html", "/garden/roses", "/weather/today", "/about", "/docs/install/", "/library/opening-hours", "/recipes/bread.html", "/news/local/12",
    "/science/articles/34", "/school/timetable", "/museum/visit", "/music/choir.html", "/contact", "/sports/results/7", "/travel/trains/", "/archive/2019/05",
    "/health/vaccines", "/bank/opening-an-account", "/books/reviews/99", "/courses/algebra", "/events/market.html", "/photos/bridge", "/shop/garden-tools", "/games/chess",
)


@dataclass(frozen=True)
class UrlCfg:
    grams: tuple[int, ...] = (3, 4, 5)
    features: int = 1 << 14
    threshold: float = 0.5  # probability of junk from which a URL is blocked


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "(?s)^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, NULL where none does.

    A rule fits its host and all subdomains of it, where the path starts with the rule's. Of rules of equal length the
    first given wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        at, slash, tail = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(slash + tail))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _grams(text: Column, mark: str, sizes: Sequence[int]) -> Column:
    whole = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        last = F.length(whole) - n + 1
        runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substr(whole, i, F.lit(n))))
        return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in sizes])


def with_grams(urls: DataFrame, cfg: UrlCfg) -> DataFrame:
    return urls.withColumn("_grams", F.concat(_grams(F.col("host"), "h:", cfg.grams), _grams(F.col("path"), "p:", cfg.grams)))


def train(labelled: DataFrame, cfg: UrlCfg = UrlCfg()) -> PipelineModel:
    """Fit on ``url, label`` (1: junk). Rows without label are passed over; both labels must occur."""
    host, path = parts(F.col("url"))
    rows = labelled.where(F.col("label").isNotNull()).select(host.alias("host"), path.alias("path"), F.col("label").cast("double"))
    return Pipeline(
        stages=[
            HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=cfg.features),
            Normalizer(inputCol="_tf", outputCol="_unit"),
            LogisticRegression(featuresCol="_unit", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_label", regParam=1e-3, maxIter=50),
        ]
    ).fit(with_grams(rows, cfg))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table, in two halves, so that each part of a URL tells the kinds apart by itself.

    Every name under all prefixes and endings, with paths dealt evenly; and every path on the same neutral hosts.
    A neutral path on a neutral host has no sign of junk and is good.
    """
    rows = []
    for label, names, paths in ((1, UNWANTED, UNWANTED_PATHS), (0, WANTED, WANTED_PATHS)):
        hosts = [f"{p}{n}.{e}" for n in names for p in PREFIXES for e in ENDINGS]
        rows += [(f"https://{h}{PATHS[i % len(PATHS)]}", label) for i, h in enumerate(hosts)]
        rows += [(f"https://{p}{e}{path}", label) for path in paths for p in PREFIXES for e in ENDINGS]
    rows += [(f"https://{p}{e}{path}", 0) for path in PATHS for p in PREFIXES for e in ENDINGS]
    return spark.createDataFrame(rows, "url string, label int")


def judge(
    pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, cfg: UrlCfg = UrlCfg(),
    id_col: str = "page_id", url: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, p_junk, verdict`` of every row.

    A rule's verdict goes before that of the classifier. A URL without host and rule is allowed, as there is
    nothing to judge. Repeated rows each get a row, NULL ids stay, other columns are ignored, an empty
    table gives an empty one. Nothing is shuffled and no Python runs on the rows.
    """
    model = train(labelled if labelled is not None else labelled_urls(pages.sparkSession), cfg)
    host, path = parts(F.col(url))
    rows = with_grams(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")), cfg)
    scored = model.transform(rows).withColumn("p_junk", vector_to_array("_p")[1])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    junk = (F.col("host") != "") & (F.col("p_junk") >= cfg.threshold)
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"), "p_junk",
        F.coalesce(verdict, F.when(junk, "block").otherwise("allow")).alias("verdict"),
    )
