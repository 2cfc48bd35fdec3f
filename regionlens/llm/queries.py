"""The operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regionlens.functions.materialize import scratch_path
from regionlens.llm import (
    decontaminate,
    license_scan,
    lm_scoring,
    packing,
    quality_classifier,
    quality_rules,
    simhash,
    spelling,
    suffix_dedup,
    token_counts,
    token_ids,
    url_filter,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", simhash.hex16(groups["fp"]).alias("fingerprint"), "component_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scratch_path(spark, "token-ids")
    token_ids.write_ids(documents(spark, sf_dir), files)
    return token_ids.digests(spark, files)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return white.withColumn("deviation", white["deviation"].try_cast("long"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    found = (
        op1_url_filter,
        op2_license_scan,
        op3_simhash,
        op4_lm_scoring,
        op5_quality_classifier,
        op6_token_counts,
        op7_token_ids,
        op8_decontamination,
        op9_packing,
        op10_quality_rules,
        op11_whitening,
        op12_suffix_dedup,
        op13_spelling,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": op2_sql(), "op10_quality_rules": OP10}


def op2_sql() -> str:
    """Containment of every template in every window, without hashes or bands."""
    cfg = license_scan.LicenseCfg()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [
        f"({quoted(name)}, {size}, {quoted(s)}, {len(shingles)})"
        for name, size, shingles in license_scan.template_shingles(license_scan.TEMPLATES, cfg)
        for s in shingles
    ]
    return f"""
WITH t(license, size, s, total) AS (VALUES {", ".join(rows)}),
w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
  FROM documents
), p AS (
  SELECT rid, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5
), s AS (
  SELECT rid, doc_id, i - 1 AS i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM p
), h AS (
  SELECT rid, doc_id, i, s, license, size, total, unnest([i // size - 1, i // size]) AS win FROM s JOIN t USING (s)
), c AS (
  SELECT rid, doc_id, license, win, count(DISTINCT s) / max(total) AS containment, min(i) AS start
  FROM h WHERE win >= 0 GROUP BY rid, doc_id, license, win
), best AS (
  SELECT *, row_number() OVER (PARTITION BY rid, license ORDER BY containment DESC, start) AS k FROM c WHERE containment >= {cfg.containment}
)
SELECT doc_id, license, containment, CAST(start AS BIGINT) AS start FROM best WHERE k = 1
"""


_W = "'[^\\x20\\x09-\\x0D]+'"
# Rates and prior as in quality_rules.host_rates: moments of the plain host rates, then shrinking.
OP10 = f"""
WITH t AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), {_W}) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_W})) AS l
  FROM documents
), p AS (
  SELECT *, row_number() OVER () AS rid,
         CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1),
           lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS s
  FROM t
), u AS (
  SELECT rid, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM p
), d AS (
  SELECT rid, i FROM u QUALIFY count(*) OVER (PARTITION BY rid, s) > 1
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM d, range(3) AS x(k) GROUP BY rid
), c AS (
  SELECT doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM p LEFT JOIN r USING (rid)
), f AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats,
         100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines
  FROM c
), h AS (
  SELECT host, count(*) AS n, sum(short::INT) AS a, sum(repeats::INT) AS b, sum(symbols::INT) AS c, sum(lines::INT) AS d
  FROM f WHERE host IS NOT NULL GROUP BY host
), hr AS (
  SELECT host, n, unnest([a, b, c, d]) AS x, unnest([1, 2, 3, 4]) AS k FROM h
), m AS (
  SELECT k, avg(x / n) AS m, var_pop(x / n) AS v FROM hr GROUP BY k
), bad AS (
  SELECT DISTINCT host FROM hr JOIN m USING (k)
  WHERE CASE WHEN v > 0 THEN (x + greatest(m * (1 - m) / v - 1, 0) * m) / (n + greatest(m * (1 - m) / v - 1, 0)) ELSE m END > 0.5
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, short OR repeats AS base_failed,
       NOT (short OR repeats) AND bad.host IS NULL AS kept
FROM f LEFT JOIN bad ON f.host = bad.host
"""
