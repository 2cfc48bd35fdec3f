"""Named SQL steps the oracle queries are built from (DuckDB dialect)."""

from __future__ import annotations

import re

TITLE = "array_to_string(list_transform(regexp_extract_all({c}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"
_BLANK = "CASE WHEN {c} IS NULL THEN NULL ELSE " + TITLE + " END"

_ALIASES = (
    "CASE upper(trim({c})) WHEN 'DELHI' THEN 'NCT of Delhi' WHEN 'NEW DELHI' THEN 'NCT of Delhi' "
    "WHEN 'PONDICHERRY' THEN 'Puducherry' WHEN 'ORISSA' THEN 'Odisha' WHEN 'UTTARANCHAL' THEN 'Uttarakhand' "
    "WHEN 'JAMMU & KASHMIR' THEN 'Jammu and Kashmir' ELSE " + _BLANK + " END"
)


def _dirty(date: str) -> str:
    return f"""
    SELECT seq + extra AS seq, date, state, district, pincode, enrolment_count, update_count, age_0_18, age_19_40, age_41_60, age_60_plus
    FROM (SELECT seq,
        CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 89 = 1 THEN 'not-a-date' WHEN seq % 83 = 2 THEN CAST(date AS VARCHAR)
             ELSE CAST({date} AS VARCHAR) END AS date,
        CASE WHEN seq % 61 = 4 THEN NULL WHEN seq % 7 = 0 THEN lower(state) WHEN seq % 7 = 1 THEN upper(state) ELSE state END AS state,
        CASE WHEN seq % 59 = 5 THEN NULL WHEN seq % 11 = 0 THEN district || '-2' ELSE district END AS district,
        CASE WHEN seq % 13 = 0 THEN '12' ELSE 'PIN ' || (100000 + seq % 900000) || '.0' END AS pincode,
        CASE WHEN seq % 53 = 3 THEN NULL WHEN seq % 71 = 6 THEN -1.0 ELSE enrolment_count END AS enrolment_count,
        CASE WHEN seq % 73 = 7 THEN enrolment_count * 6 ELSE update_count END AS update_count,
        age_0_18, age_19_40, age_41_60, age_60_plus FROM trade) AS b,
    LATERAL (SELECT unnest(CASE WHEN b.seq % 41 = 8 THEN [0, 1000000000] ELSE [0] END) AS extra) AS r"""


def _mode(c: str) -> str:
    return (
        f"(SELECT {c} FROM dirty_shifted WHERE date IS NOT NULL AND {c} IS NOT NULL GROUP BY 1 "
        f"ORDER BY count(*) DESC, {c} LIMIT 1)"
    )


_D3 = "sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2))"
_Z = "(coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / stddev_pop(coalesce({c}, 0)) OVER ()"

CTES: dict[str, str] = {
    "trade": """
    SELECT o_orderkey AS seq, CAST(o_orderdate AS DATE) AS date, n_name AS state, c_mktsegment AS district,
      sum(l_quantity) AS enrolment_count, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS update_count,
      sum(CASE WHEN p_size <= 12 THEN l_quantity ELSE 0 END) AS age_0_18,
      sum(CASE WHEN p_size BETWEEN 13 AND 25 THEN l_quantity ELSE 0 END) AS age_19_40,
      sum(CASE WHEN p_size BETWEEN 26 AND 38 THEN l_quantity ELSE 0 END) AS age_41_60,
      sum(CASE WHEN p_size > 38 THEN l_quantity ELSE 0 END) AS age_60_plus
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
    GROUP BY 1, 2, 3, 4""",
    "event": """
    SELECT event_id AS seq, ts AS date, event_type AS state, CAST(user_id % 10 AS VARCHAR) AS district,
      value AS enrolment_count, 0.0 AS update_count FROM events""",
    "dash": """
    SELECT seq, date, state, strftime(date, '%Y-%m') AS year_month, enrolment_count AS enrolments,
      enrolment_count - update_count AS successful_enrolments, update_count AS updates,
      (enrolment_count - update_count) / enrolment_count AS success_rate, age_0_18 / enrolment_count AS population_coverage,
      CASE WHEN update_count > enrolment_count * 0.9 THEN 1 ELSE 0 END AS is_anomaly, update_count / enrolment_count AS anomaly_score
    FROM trade""",
    "dirty": _dirty("date"),
    "dirty_shifted": _dirty("CAST(date + INTERVAL 15 YEAR AS DATE)"),
    "named": f"""
    SELECT seq, {_ALIASES.format(c='state')} AS state_name,
      CASE WHEN district IS NULL THEN NULL ELSE regexp_replace({TITLE.format(c='district')}, '[^a-zA-Z\\s]', '', 'g') END AS district_name
    FROM dirty""",
    "shifted_dates": "SELECT seq, TRY_CAST(date AS DATE) AS d FROM dirty_shifted",
    "imputed": f"""
    SELECT seq, date, coalesce(state, {_mode('state')}) AS state, coalesce(district, {_mode('district')}) AS district,
      coalesce(pincode, {_mode('pincode')}) AS pincode,
      coalesce(enrolment_count, (SELECT median(enrolment_count) FROM dirty_shifted WHERE date IS NOT NULL)) AS enrolment_count,
      update_count, age_0_18, age_19_40, age_41_60, age_60_plus
    FROM dirty_shifted WHERE date IS NOT NULL""",
    "staged": f"""
    SELECT seq, TRY_CAST(date AS DATE) AS date, {_ALIASES.format(c='state')} AS state,
      regexp_replace({TITLE.format(c='district')}, '[^a-zA-Z\\s]', '', 'g') AS district,
      nullif(regexp_extract(trim(pincode), '\\d{{6}}'), '') AS pincode,
      least(enrolment_count, 1000000) AS enrolment_count, update_count,
      greatest(age_0_18, 0) AS age_0_18, greatest(age_19_40, 0) AS age_19_40, greatest(age_41_60, 0) AS age_41_60, greatest(age_60_plus, 0) AS age_60_plus,
      CASE WHEN NOT coalesce(TRY_CAST(date AS DATE) BETWEEN DATE '2009-01-01' AND DATE '2020-01-01', false) THEN 'invalid_date'
        WHEN NOT coalesce(enrolment_count >= 0, false) THEN 'negative_enrolment'
        WHEN NOT coalesce(update_count >= 0, false) THEN 'negative_update'
        WHEN NOT coalesce(update_count <= 5 * least(enrolment_count, 1000000), false) THEN 'excess_update'
        WHEN NOT coalesce(age_0_18 + age_19_40 + age_41_60 + age_60_plus <= 1.1 * least(enrolment_count, 1000000), false) THEN 'excess_age_sum'
      END AS lost
    FROM imputed""",
    "cleaned": """
    SELECT * EXCLUDE (lost) FROM staged WHERE lost IS NULL
    QUALIFY row_number() OVER (PARTITION BY date, state, district ORDER BY seq) = 1""",
    "clean_audit": """
    SELECT 'null_date' AS step, (SELECT count(*) FROM dirty_shifted WHERE date IS NULL) AS rows_removed
    UNION ALL SELECT 'sparse', 0
    UNION ALL SELECT s.step, (SELECT count(*) FROM staged WHERE lost = s.step)
      FROM (VALUES ('invalid_date'), ('negative_enrolment'), ('negative_update'), ('excess_update'), ('excess_age_sum')) AS s(step)
    UNION ALL SELECT 'repeated', (SELECT count(*) FROM staged WHERE lost IS NULL) - (SELECT count(*) FROM cleaned)""",
    "months": """
    SELECT state, strftime(date, '%Y-%m') AS year_month, sum(enrolment_count) AS enrolment_count_sum,
      avg(enrolment_count) AS enrolment_count_mean, stddev_samp(enrolment_count) AS enrolment_count_std,
      sum(update_count) AS update_count_sum, sum(age_0_18) AS age_0_18_sum, sum(age_19_40) AS age_19_40_sum,
      sum(age_41_60) AS age_41_60_sum, sum(age_60_plus) AS age_60_plus_sum FROM trade GROUP BY 1, 2""",
    "agg": """
    SELECT *, enrolment_count_sum / nullif(lag(enrolment_count_sum) OVER (PARTITION BY state ORDER BY year_month), 0) - 1 AS mom_growth,
      CASE WHEN stddev_samp(enrolment_count_sum) OVER (PARTITION BY state) > 0
        THEN (enrolment_count_sum - avg(enrolment_count_sum) OVER (PARTITION BY state)) / stddev_samp(enrolment_count_sum) OVER (PARTITION BY state)
        ELSE 0 END AS z_score,
      update_count_sum / CASE WHEN enrolment_count_sum = 0 THEN 1 ELSE enrolment_count_sum END AS update_ratio FROM months""",
    "lagged": """
    SELECT *, CAST(year_month || '-01' AS DATE) AS date, CAST(year_month[6:7] AS INTEGER) AS month,
      lag(enrolment_count_sum, 1) OVER w AS lag_1, lag(enrolment_count_sum, 2) OVER w AS lag_2, lag(enrolment_count_sum, 3) OVER w AS lag_3,
      dense_rank() OVER (ORDER BY state) - 1 AS state_code FROM agg WINDOW w AS (PARTITION BY state ORDER BY year_month)""",
    "ml": """
    SELECT * FROM lagged WHERE lag_3 IS NOT NULL AND mom_growth IS NOT NULL AND enrolment_count_std IS NOT NULL AND (SELECT count(*) FROM agg) >= 10""",
    "scored": """
    SELECT *, CAST(year_month || '-01' AS DATE) AS date, CASE WHEN abs(z_score) > 2 THEN 1 ELSE 0 END AS is_anomaly,
      least(abs(z_score) / 4, 1.0) AS anomaly_score FROM agg""",
    "banded": """
    SELECT *, CASE WHEN r > 0.8 THEN 'VERY_HIGH' WHEN r > 0.6 THEN 'HIGH' WHEN r > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS anomaly_confidence FROM
    (SELECT *, (anomaly_score - min(anomaly_score) OVER ()) / (max(anomaly_score) OVER () - min(anomaly_score) OVER ()) AS r FROM scored)""",
    "explained": """
    SELECT state, year_month AS period, round(anomaly_score, 3) AS anomaly_score, anomaly_confidence AS confidence,
      coalesce(why[1], '') AS primary_reason, array_to_string(why[2:], '; ') AS factors,
      CASE WHEN anomaly_score > 0.8 THEN 'Immediate investigation required' WHEN anomaly_score > 0.6 THEN 'Priority review recommended'
        ELSE 'Review data quality and verify with field teams' END AS recommended_action
    FROM (SELECT *, list_filter([CASE WHEN abs(z_score) > 3 THEN 'Extreme enrolment volume (z-score: ' || printf('%.2f', round(z_score, 2)) || ')' END,
        CASE WHEN abs(mom_growth) > 0.5 THEN 'Sudden ' || CASE WHEN mom_growth > 0 THEN 'increase' ELSE 'decrease' END || ' (' || printf('%.1f', round(abs(mom_growth) * 100, 1)) || '% change)' END,
        CASE WHEN update_ratio > 0.5 THEN 'High update ratio (' || printf('%.2f', round(update_ratio, 2)) || ')'
             WHEN update_ratio < 0.05 THEN 'Low update ratio (' || printf('%.2f', round(update_ratio, 2)) || ')' END], lambda x: x IS NOT NULL) AS why
      FROM banded WHERE is_anomaly = 1)""",
    "state_norms": """
    SELECT state, sqrt(sum(t * t)) AS norm FROM (SELECT date, state, sum(enrolment_count) AS t FROM trade GROUP BY 1, 2) GROUP BY 1""",
    "state_days": "SELECT date, state, sum(enrolment_count) AS t FROM trade GROUP BY 1, 2",
    "similar_pairs": """
    SELECT a.state AS state1, b.state AS state2, CASE WHEN a.norm > 0 AND b.norm > 0 THEN coalesce(dot, 0) / (a.norm * b.norm) ELSE 0 END AS similarity
    FROM state_norms AS a CROSS JOIN state_norms AS b LEFT JOIN
      (SELECT p.state AS s1, q.state AS s2, sum(p.t * q.t) AS dot FROM state_days AS p JOIN state_days AS q ON p.date = q.date GROUP BY 1, 2) AS x
      ON s1 = a.state AND s2 = b.state""",
    "lof_points": f"""
    SELECT state, year_month, row_number() OVER (ORDER BY state, year_month) AS id, {_Z.format(c='enrolment_count_sum')} AS x0,
      {_Z.format(c='mom_growth')} AS x1, {_Z.format(c='update_ratio')} AS x2 FROM ml""",
    "lof_fit": f"""
    SELECT a.id, b.id AS nid, {_D3} AS d FROM lof_points AS a JOIN lof_points AS b ON a.id <> b.id
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_D3}, b.x0, b.x1, b.x2, b.id) <= least(20, (SELECT count(*) - 1 FROM ml))""",
    "lof_query": f"""
    SELECT a.id, b.id AS nid, {_D3} AS d FROM lof_points AS a CROSS JOIN lof_points AS b
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_D3}, b.x0, b.x1, b.x2, b.id) <= least(20, (SELECT count(*) - 1 FROM ml))""",
    "lof_kdist": "SELECT id AS kid, max(d) AS k FROM lof_fit GROUP BY 1",
    "lof_density": "SELECT id, 1 / (avg(greatest(d, k)) + 1e-10) AS lrd FROM lof_fit JOIN lof_kdist ON nid = kid GROUP BY 1",
    "lof_query_density": "SELECT id, 1 / (avg(greatest(d, k)) + 1e-10) AS lrd FROM lof_query JOIN lof_kdist ON nid = kid GROUP BY 1",
    "lof_factors": """
    SELECT p.id, state, year_month,
      (SELECT avg(n.lrd) FROM lof_fit AS f JOIN lof_density AS n ON f.nid = n.id WHERE f.id = p.id) / o.lrd AS anomaly_score,
      (SELECT avg(n.lrd) FROM lof_query AS f JOIN lof_density AS n ON f.nid = n.id WHERE f.id = p.id) / q.lrd AS query_score
    FROM lof_points AS p JOIN lof_density AS o ON o.id = p.id JOIN lof_query_density AS q ON q.id = p.id""",
    "lof_scored": """
    SELECT state, year_month, anomaly_score,
      CASE WHEN query_score > (SELECT quantile_cont(anomaly_score, 0.9) FROM lof_factors) THEN 1 ELSE 0 END AS is_anomaly FROM lof_factors""",
    "state_features": """
    SELECT state, sum(enrolment_count_sum) AS total_enrolments, avg(enrolment_count_sum) AS avg_enrolments,
      coalesce(stddev_samp(enrolment_count_sum), 0) AS std_enrolments, sum(update_count_sum) AS total_updates, avg(update_ratio) AS avg_update_ratio,
      coalesce(avg(mom_growth), 0) AS avg_growth, coalesce(stddev_samp(mom_growth), 0) AS growth_volatility,
      avg(is_anomaly) AS anomaly_frequency, avg(anomaly_score) AS avg_anomaly_score,
      sum(age_0_18_sum) / sum(age_0_18_sum + age_19_40_sum + age_41_60_sum + age_60_plus_sum) AS age_0_18_pct,
      sum(age_19_40_sum) / sum(age_0_18_sum + age_19_40_sum + age_41_60_sum + age_60_plus_sum) AS age_19_40_pct,
      sum(age_41_60_sum) / sum(age_0_18_sum + age_19_40_sum + age_41_60_sum + age_60_plus_sum) AS age_41_60_pct,
      sum(age_60_plus_sum) / sum(age_0_18_sum + age_19_40_sum + age_41_60_sum + age_60_plus_sum) AS age_60_plus_pct
    FROM scored GROUP BY 1""",
    "labelled": "SELECT *, ascii(right(state, 1)) % 3 AS cluster FROM state_features",
    "label_points": f"""
    SELECT state, cluster, {_Z.format(c='total_enrolments')} AS x0, {_Z.format(c='avg_growth')} AS x1, {_Z.format(c='avg_update_ratio')} AS x2 FROM labelled""",
    "label_distances": f"""
    SELECT a.state, a.cluster AS c, b.cluster AS oc, sum({_D3}) AS s, count(*) AS n FROM label_points AS a CROSS JOIN label_points AS b GROUP BY 1, 2, 3""",
    "silhouettes": """
    SELECT avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (
      SELECT state, max(CASE WHEN c = oc THEN n END) AS size, max(CASE WHEN c = oc AND n > 1 THEN s / (n - 1) END) AS a,
        min(CASE WHEN c <> oc THEN s / n END) AS b FROM label_distances GROUP BY 1)""",
    "described": """
    SELECT l.*, 'Cluster ' || (cluster + 1) || ': '
      || CASE WHEN v > (SELECT quantile_cont(total_enrolments, 0.75) FROM labelled) THEN 'High Volume'
              WHEN v < (SELECT quantile_cont(total_enrolments, 0.25) FROM labelled) THEN 'Low Volume' ELSE 'Medium Volume' END
      || ', ' || CASE WHEN g > 0.1 THEN 'Rapid Growth' WHEN g < -0.05 THEN 'Declining' ELSE 'Stable' END
      || ', ' || CASE WHEN f > 0.2 THEN 'High Anomalies' ELSE 'Low Anomalies' END AS cluster_description
    FROM labelled AS l JOIN (SELECT cluster AS k, avg(total_enrolments) AS v, avg(avg_growth) AS g, avg(anomaly_frequency) AS f FROM labelled GROUP BY 1) ON k = cluster""",
    "components": """
    SELECT state, least(greatest(sum(enrolment_count_sum) / 1e7, 0), 1) AS volume_risk, avg(is_anomaly) AS anomaly_frequency_risk,
      least(coalesce(avg(CASE WHEN is_anomaly = 1 THEN anomaly_score END), 0), 1) AS anomaly_severity_risk,
      least(coalesce(stddev_samp(mom_growth), 0) / 0.5, 1) AS volatility_risk,
      CASE WHEN max(date) > min(date) THEN 1 - least(count(DISTINCT year_month) / ((max(date) - min(date)) / 30), 1) ELSE 0 END AS consistency_risk,
      least(coalesce(stddev_samp(update_ratio), 0) / 0.3, 1) AS update_pattern_risk FROM scored GROUP BY 1""",
    "risk": """
    SELECT *, CASE WHEN risk_score >= 0.37 THEN 'CRITICAL' WHEN risk_score >= 0.35 THEN 'HIGH' WHEN risk_score >= 0.335 THEN 'MEDIUM'
        WHEN risk_score >= 0.33 THEN 'LOW' ELSE 'VERY_LOW' END AS risk_level,
      CASE WHEN risk_score >= 0.37 THEN '#DC3545' WHEN risk_score >= 0.35 THEN '#FD7E14' WHEN risk_score >= 0.335 THEN '#FFC107'
        WHEN risk_score >= 0.33 THEN '#28A745' ELSE '#6C757D' END AS risk_color
    FROM (SELECT *, 0.15 * volume_risk + 0.25 * anomaly_frequency_risk + 0.25 * anomaly_severity_risk + 0.15 * volatility_risk
        + 0.1 * consistency_risk + 0.1 * update_pattern_risk AS risk_score FROM components)""",
    "planted": """
    SELECT state, year_month, mom_growth, enrolment_count_sum * CASE WHEN year_month LIKE '%-03' THEN 2.5 ELSE 1 END
      * CASE WHEN state = 'NATION_7' THEN 40 ELSE 1 END * CASE WHEN year_month >= '2001-08' THEN 30 ELSE 1 END AS x FROM agg""",
    "planted_flags": """
    SELECT state, year_month, CASE WHEN hot THEN 1 ELSE is_anomaly END AS flag, CASE WHEN hot THEN 0.9 ELSE anomaly_score END AS score
    FROM (SELECT *, state = 'NATION_7' OR year_month = '1997-03' AS hot FROM scored)""",
    "last_months": "SELECT year_month, sum(x) AS t FROM planted GROUP BY 1 ORDER BY 1 DESC LIMIT 2",
    "ins2": """
    SELECT 'trend' AS type, CASE WHEN p > 0 THEN 'Significant Monthly Increased' ELSE 'Significant Monthly Decreased' END AS title,
      'Enrolments ' || CASE WHEN p > 0 THEN 'increased' ELSE 'decreased' END || ' by ' || printf('%.1f', round(abs(p), 1)) || '% from previous month' AS description,
      CASE WHEN abs(p) > 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'HIGH' AS confidence
    FROM (SELECT CASE WHEN arg_min(t, year_month) > 0 THEN (arg_max(t, year_month) - arg_min(t, year_month)) / arg_min(t, year_month) * 100 ELSE 0 END AS p, count(*) AS n
      FROM last_months) WHERE n > 1 AND abs(p) > 10""",
    "season": "SELECT CAST(year_month[6:7] AS INTEGER) AS m, avg(x) AS v FROM planted GROUP BY 1",
    "ins3": """
    SELECT 'seasonality' AS type, 'Clear Seasonal Pattern Detected' AS title,
      'Peak in ' || ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][arg_max(m, v)] || ', lowest in '
        || ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][arg_min(m, v)] AS description,
      'MEDIUM' AS severity, 'HIGH' AS confidence FROM season HAVING max(v) > 1.5 * min(v)""",
    "planted_totals": "SELECT state, sum(x) AS v FROM planted GROUP BY 1",
    "ins4": """
    SELECT 'performance' AS type, 'Significant State Disparity' AS title,
      arg_max(state, v) || ' has significantly higher enrolments than ' || arg_min(state, v) AS description,
      'MEDIUM' AS severity, 'HIGH' AS confidence FROM planted_totals HAVING count(*) > 1 AND max(v) > 10 * min(v)""",
    "flag_months": "SELECT year_month AS k, count(*) AS n FROM planted_flags WHERE flag = 1 GROUP BY 1",
    "flag_states": "SELECT state AS k, count(*) AS n FROM planted_flags WHERE flag = 1 GROUP BY 1",
    "ins5": """
    SELECT 'temporal_anomaly' AS type, 'Anomaly Cluster Detected' AS title,
      'Concentration of anomalies in ' || (SELECT k FROM flag_months ORDER BY n DESC, k LIMIT 1) || ' (' || max(n) || ' anomalies)' AS description,
      'HIGH' AS severity, 'MEDIUM' AS confidence FROM flag_months HAVING max(n) > 2 * avg(n)""",
    "ins6": """
    SELECT 'geographic_anomaly' AS type, 'Geographic Anomaly Concentration' AS title,
      (SELECT k FROM flag_states ORDER BY n DESC, k LIMIT 1) || ' has ' || max(n) || ' anomalies, significantly above average' AS description,
      'HIGH' AS severity, 'HIGH' AS confidence FROM flag_states HAVING max(n) > 3 * avg(n)""",
    "ins7": """
    SELECT 'severity' AS type, 'High Severity Anomalies Detected' AS title, n || ' anomalies with very high severity scores' AS description,
      'CRITICAL' AS severity, 'HIGH' AS confidence FROM (SELECT count(*) AS n FROM planted_flags WHERE flag = 1 AND score > 0.8) WHERE n > 0""",
    "critical_names": """
    SELECT (SELECT count(*) FROM risk WHERE risk_level = 'CRITICAL') AS n, string_agg(state, ', ' ORDER BY risk_score DESC, state) AS names
    FROM (SELECT * FROM risk WHERE risk_level = 'CRITICAL' ORDER BY risk_score DESC, state LIMIT 3)""",
    "ins8": """
    SELECT 'risk' AS type, 'Critical Risk States Identified' AS title, n || ' states at critical risk level: ' || names AS description,
      'CRITICAL' AS severity, 'HIGH' AS confidence FROM critical_names WHERE n > 0""",
    "ins9": """
    SELECT 'risk_distribution' AS type, 'Wide Risk Distribution' AS title, 'Significant variability in risk scores across states' AS description, 'MEDIUM' AS severity, 'HIGH' AS confidence
    FROM (SELECT stddev_samp(risk_score) AS sd FROM risk) WHERE sd > 0.3""",
    "ins10": """
    SELECT 'cluster_imbalance' AS type, 'Uneven State Distribution Across Clusters' AS title, 'Largest cluster has ' || a || ' states, smallest has ' || b AS description, 'LOW' AS severity, 'HIGH' AS confidence
    FROM (SELECT max(n) AS a, min(n) AS b, count(*) AS g FROM (SELECT count(*) AS n FROM labelled GROUP BY cluster)) WHERE g > 1 AND a > 5 * b""",
    "ins11": """
    SELECT 'cluster_performance' AS type, 'High-Performance Cluster Identified' AS title, 'Cluster ' || (top + 1) || ' shows significantly higher enrolment volumes' AS description, 'MEDIUM' AS severity, 'HIGH' AS confidence
    FROM (SELECT arg_max(cluster, m) AS top, max(m) AS a, min(m) AS b FROM (SELECT cluster, avg(total_enrolments) AS m FROM labelled GROUP BY cluster)) WHERE a > 2 * b""",
    "all_insights": """
    SELECT 'trend_insights' AS section, type, title, description, severity, confidence FROM ins2
    UNION ALL SELECT 'trend_insights', type, title, description, severity, confidence FROM ins3
    UNION ALL SELECT 'trend_insights', type, title, description, severity, confidence FROM ins4
    UNION ALL SELECT 'anomaly_insights', type, title, description, severity, confidence FROM ins5
    UNION ALL SELECT 'anomaly_insights', type, title, description, severity, confidence FROM ins6
    UNION ALL SELECT 'anomaly_insights', type, title, description, severity, confidence FROM ins7
    UNION ALL SELECT 'risk_insights', type, title, description, severity, confidence FROM ins8
    UNION ALL SELECT 'risk_insights', type, title, description, severity, confidence FROM ins9
    UNION ALL SELECT 'cluster_insights', type, title, description, severity, confidence FROM ins10
    UNION ALL SELECT 'cluster_insights', type, title, description, severity, confidence FROM ins11""",
    "recommended": """
    SELECT 'Data Quality' AS category, 'Anomaly Investigation' AS action, 'Investigate ' || n || ' detected anomalies' AS description,
      CASE WHEN n > 50 THEN 'HIGH' ELSE 'MEDIUM' END AS priority, '2 weeks' AS timeline, 'Data Quality Team' AS responsible
      FROM (SELECT sum(is_anomaly) AS n FROM scored) WHERE n > 0
    UNION ALL SELECT 'Risk Management', 'Immediate Risk Mitigation', 'Address critical risk in ' || n || ' states: ' || names, 'CRITICAL', '48 hours', 'Risk Management Team'
      FROM critical_names WHERE n > 0
    UNION ALL SELECT 'Operations', 'Performance Review', 'Review operations in regions showing negative growth', 'MEDIUM', '1 month', 'Operations Team'
      FROM (SELECT count(*) AS n FROM agg WHERE mom_growth < -0.1) WHERE n > 0
    UNION ALL SELECT 'Monitoring', 'Regular Dashboard Review', 'Review dashboard metrics weekly for early issue detection', 'LOW', 'Weekly', 'All Teams'
    UNION ALL SELECT 'Improvement', 'Model Retraining', 'Retrain ML models quarterly with latest data', 'MEDIUM', 'Quarterly', 'Data Science Team'""",
    "kept": """
    SELECT * FROM trade WHERE enrolment_count >= 0 AND update_count >= 0 AND update_count <= 5 * least(enrolment_count, 1000000)
      AND age_0_18 + age_19_40 + age_41_60 + age_60_plus <= 1.1 * least(enrolment_count, 1000000)
    QUALIFY row_number() OVER (PARTITION BY date, state, district ORDER BY seq) = 1""",
    "kept_months": """
    SELECT state, strftime(date, '%Y-%m') AS year_month, CAST(strftime(date, '%Y-%m') || '-01' AS DATE) AS date,
      sum(least(enrolment_count, 1000000)) AS x, sum(update_count) AS u FROM kept GROUP BY 1, 2, 3""",
    "kept_scores": """
    SELECT *, u / CASE WHEN x = 0 THEN 1 ELSE x END AS ratio, x / nullif(lag(x) OVER (PARTITION BY state ORDER BY year_month), 0) - 1 AS g,
      abs(coalesce((x - avg(x) OVER (PARTITION BY state)) / nullif(stddev_samp(x) OVER (PARTITION BY state), 0), 0)) AS z FROM kept_months""",
    "flagship": """
    SELECT state, r AS risk_score, CASE WHEN r >= 0.8 THEN 'CRITICAL' WHEN r >= 0.6 THEN 'HIGH' WHEN r >= 0.4 THEN 'MEDIUM' WHEN r >= 0.2 THEN 'LOW' ELSE 'VERY_LOW' END AS risk_level
    FROM (SELECT state, 0.15 * least(sum(x) / 1e7, 1) + 0.25 * avg(CASE WHEN z > 2 THEN 1 ELSE 0 END)
      + 0.25 * coalesce(avg(CASE WHEN z > 2 THEN least(z / 4, 1) END), 0) + 0.15 * least(coalesce(stddev_samp(g), 0) / 0.5, 1)
      + 0.1 * CASE WHEN max(date) > min(date) THEN 1 - least(count(DISTINCT year_month) / ((max(date) - min(date)) / 30), 1) ELSE 0 END
      + 0.1 * least(coalesce(stddev_samp(ratio), 0) / 0.3, 1) AS r FROM kept_scores GROUP BY 1)""",
}


# The same steps over the cleaned facts, for the whole chain: names of their own, with outlier factors as scores.
_CHAIN = (
    "months", "agg", "lagged", "ml", "lof_points", "lof_fit", "lof_query", "lof_kdist", "lof_density", "lof_query_density", "lof_factors", "lof_scored",
)


def _chained(sql: str) -> str:
    sql = re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join([*_CHAIN, 'scored', 'components'])})\b", r"\1\2chain_\3", sql)
    return re.sub(r"\bFROM trade\b", "FROM cleaned", sql)


CTES |= {f"chain_{name}": _chained(CTES[name]) for name in _CHAIN}
CTES["chain_scored"] = "SELECT m.*, s.is_anomaly, s.anomaly_score FROM chain_ml AS m JOIN chain_lof_scored AS s USING (state, year_month)"
CTES |= {f"chain_{name}": _chained(CTES[name]) for name in ("components", "risk")}


def with_ctes(query: str) -> str:
    """``query`` preceded by the steps it needs, in their order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(query)
    steps = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {steps}\n{query}" if steps else query
