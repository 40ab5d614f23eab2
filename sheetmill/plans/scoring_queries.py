"""Queries over comparison groups of devices."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetmill.functions import dicts
from sheetmill.operators import scoring as S
from sheetmill.plans.fixtures import read


#: Inputs are exact quotients of integers. Results are rounded at places that lie between all short decimals,
#: so that the last bit of a double never decides.
SHIFT = 3e-10


def _params(spark, sf_dir):
    return read(spark, sf_dir, "fx_device_params")


def _matrix(spark, sf_dir):
    return S.matrix(_params(spark, sf_dir))


def _scores(spark, sf_dir):
    return S.device_scores(_matrix(spark, sf_dir))


def _rounded(df, *names):
    return df.withColumns({n: F.round(F.col(n) + SHIFT, 6) + 0.0 for n in names})


def ag1(spark, sf_dir):
    return _rounded(S.normalised_conditions(_params(spark, sf_dir)).select("group_id", "device", "param", "norm_value", "confidence", "adjusted"), "norm_value", "confidence")


def ag2(spark, sf_dir):
    d = S.converted(S.z_numbers(S.normalised_conditions(_params(spark, sf_dir))))
    cols = {"reliability": F.col("reliability"), "a_l": F.col("z_a.l"), "a_r": F.col("z_a.r"), "b_l": F.col("z_b.l"), "b_r": F.col("z_b.r"), "f_l": F.col("fuzzy.l"), "f_r": F.col("fuzzy.r"), "weighted_value": F.col("weighted_value")}
    return d.select("group_id", "device", "param", *((F.round(c + SHIFT, 6) + 0.0).alias(n) for n, c in cols.items()))


def ag5(spark, sf_dir):
    d = S.aggregated_z(S.z_numbers(S.normalised_conditions(_params(spark, sf_dir))), ["group_id", "param"])
    return d.withColumns({n: F.round(F.col(n) + SHIFT, 6) + 0.0 for n in ("a_l", "a_m", "a_r", "b_l", "b_m", "b_r")})


def ag6(spark, sf_dir):
    return _rounded(_matrix(spark, sf_dir).select("group_id", "device", "param", "missing", "norm"), "norm")


def ag7(spark, sf_dir):
    return _rounded(_matrix(spark, sf_dir).groupBy("group_id", "param").agg(F.max("weight").alias("weight")), "weight")


def ag8(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir), "distance", "confidence", "score")


def ag11(spark, sf_dir):
    return _rounded(S.dimension_scores(_matrix(spark, sf_dir)), *dicts.DIMENSIONS)


def ag12(spark, sf_dir):
    return S.strengths(_matrix(spark, sf_dir).withColumn("norm", F.round("norm", 9)))


def ag13(spark, sf_dir):
    return _rounded(S.recommendations(_scores(spark, sf_dir)), "best_score", "second_score")


def ag14(spark, sf_dir):
    return S.differences(_params(spark, sf_dir))


def ag14_ranks(spark, sf_dir):
    return S.value_ranks(_params(spark, sf_dir))


def ag15(spark, sf_dir):
    return _rounded(S.headlines(_scores(spark, sf_dir)), "lead", "mean_confidence")


def kg9(spark, sf_dir):
    p = read(spark, sf_dir, "fx_parameters")
    return _rounded(S.scoring_parameters(p.select(F.col("chip_id").alias("chip"), F.col("param_name").alias("param"), F.col("param_value").alias("value"), F.lit("datasheet_table").alias("source"), "confidence")), "value", "confidence")


def kg10(spark, sf_dir):
    return S.comparison_matrix(_params(spark, sf_dir), ["frequency", "supply_voltage", "output_current"])


def wn1(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp"), F.col("ts").cast("timestamp")).cast("double").alias("position"))
    return S.position_clusters(e, "user_id", "position", 3600.0 * 50, 3600.0 * 80)


QUERIES = {
    "ag1_conditions": ag1,
    "ag2_ag4_z_numbers": ag2,
    "ag5_aggregate_z": ag5,
    "ag6_min_max": ag6,
    "ag7_merec_weights": ag7,
    "ag8_ag10_device_scores": ag8,
    "ag11_dimensions": ag11,
    "ag12_strengths": ag12,
    "ag13_recommendation": ag13,
    "ag14_differences": ag14,
    "ag14_value_ranks": ag14_ranks,
    "ag15_headline": ag15,
    "kg9_scoring_names": kg9,
    "kg10_comparison_matrix": kg10,
    "wn1_position_clusters": wn1,
}

_T = dicts.values_sql(dicts.TEMPERATURE_COEFFICIENTS, "t(param, t_coeff, t_type)")
_V = dicts.values_sql(dicts.VOLTAGE_COEFFICIENTS, "v(param, v_coeff)")
_S = dicts.values_sql(dicts.SOURCES, "s(source, br, bs)")
_P = dicts.values_sql([(k, *r) for k, r in enumerate(dicts.PARAMETERS)], "p(param_no, param, kind, target, esp, dimension)")
_N = dicts.values_sql([(k, *r) for k, r in enumerate(S.SCORING_NAMES)], "n(no, f, t)")

_STEPS = f"""WITH c0 AS (
  SELECT x.*, temperature - 25.0 AS dt, voltage - 3.3 AS dv, t_coeff, t_type, v_coeff FROM {{fx_device_params}} x LEFT JOIN {_T} ON t.param = x.param LEFT JOIN {_V} ON v.param = x.param),
c1 AS (
  SELECT *, coalesce(abs(dt) > 1 AND t_type IN ('resistance', 'delay', 'power', 'current') AND 1 + (t_coeff - 1) * (dt / 100) > 0, FALSE) AS by_t,
    coalesce(abs(dv) > 0.5 AND 1 + (v_coeff - 1) * (dv / 3.3) > 0, FALSE) AS by_v FROM c0),
c2 AS (
  SELECT group_id, device, param, value, source, CASE WHEN temperature IS NULL AND voltage IS NULL THEN value ELSE value / CASE WHEN by_t THEN 1 + (t_coeff - 1) * (dt / 100) ELSE 1.0 END / CASE WHEN by_v THEN 1 + (v_coeff - 1) * (dv / 3.3) ELSE 1.0 END END AS norm_value,
    CASE WHEN temperature IS NULL AND voltage IS NULL THEN CAST(0.85 AS DOUBLE) ELSE CAST(CASE WHEN by_t AND abs(dt) > 50 THEN 0.90 ELSE 1.0 END AS DOUBLE) * CASE WHEN by_t AND abs(dt) > 100 THEN 0.85 ELSE 1.0 END * CASE WHEN by_v THEN 0.92 ELSE 1.0 END END AS confidence,
    (temperature IS NOT NULL OR voltage IS NOT NULL) AND (by_t OR by_v) AS adjusted FROM c1),
z0 AS (
  SELECT c2.*, coalesce(br, 0.5) * confidence * CASE WHEN adjusted THEN 0.90 ELSE 1.0 END AS rel, abs(norm_value) * coalesce(bs, 0.15) * CASE WHEN adjusted THEN 1.2 ELSE 1.0 END AS sp FROM c2 LEFT JOIN {_S} ON s.source = c2.source),
z1 AS (SELECT *, norm_value - sp AS a_l, norm_value + sp AS a_r, greatest(0.0, rel - rel * 0.1) AS b_l, least(1.0, rel + rel * 0.1) AS b_r FROM z0),
z2 AS (SELECT *, 1 + (1 - least(greatest((b_l + 4 * rel + b_r) / 6, 0.01), 0.99)) AS wide FROM z1),
z3 AS (SELECT *, norm_value - (norm_value - a_l) * wide AS f_l, norm_value + (a_r - norm_value) * wide AS f_r FROM z2),
z AS (SELECT *, (f_l + 4 * norm_value + f_r) / 6 AS wv FROM z3),
m0 AS (
  SELECT g.group_id, d.device, g.param, z.wv, z.f_l, z.f_r, z.norm_value, z.wv IS NULL AS missing, param_no, kind, target, esp, dimension
  FROM (SELECT DISTINCT group_id, param FROM z) g JOIN (SELECT DISTINCT group_id, device FROM z) d ON d.group_id = g.group_id
  LEFT JOIN z ON z.group_id = g.group_id AND z.device = d.device AND z.param = g.param LEFT JOIN {_P} ON p.param = g.param),
m1 AS (SELECT *, min(wv) OVER (PARTITION BY group_id, param) AS lo, max(wv) OVER (PARTITION BY group_id, param) AS hi FROM m0),
m2 AS (
  SELECT *, CASE WHEN missing THEN 0.0 WHEN hi - lo < 1e-10 THEN 0.5 WHEN kind = 'cost' THEN (hi - wv) / (hi - lo)
    WHEN kind = 'target' THEN 1.0 - abs(wv - target) / greatest(abs(hi - target), abs(lo - target)) ELSE (wv - lo) / (hi - lo) END AS norm FROM m1),
w0 AS (SELECT *, min(norm) OVER (PARTITION BY group_id, param) AS nlo, max(norm) OVER (PARTITION BY group_id, param) AS nhi FROM m2),
w1 AS (SELECT *, abs(CASE WHEN nhi - nlo < 1e-10 THEN 1.0 WHEN kind = 'cost' THEN nlo / CASE WHEN norm > 0 THEN norm ELSE 1e-10 END ELSE norm / CASE WHEN nhi > 0 THEN nhi ELSE 1.0 END END) AS r FROM w0),
w2 AS (SELECT *, sum(r) OVER (PARTITION BY group_id, device) AS rs, count(*) OVER (PARTITION BY group_id, device) AS mm FROM w1),
w3 AS (SELECT *, abs(ln(1 + (rs - r) / greatest(mm - 1, 1)) - ln(1 + rs / mm)) AS effect FROM w2),
w AS (SELECT *, sum(effect) OVER (PARTITION BY group_id, param) / sum(effect) OVER (PARTITION BY group_id) AS weight FROM w3),
s0 AS (
  SELECT group_id, device, sqrt(sum(weight * power(norm - coalesce(esp, 0.6), 2))) AS distance,
    sum(weight * CASE WHEN missing THEN 0.3 ELSE 1.0 - least(CASE WHEN abs(norm_value) > 1e-10 THEN (f_r - f_l) / (2.0 * abs(norm_value)) WHEN f_r - f_l < 1e-10 THEN 0.0 ELSE 1.0 END, 1.0) END) AS confidence FROM w GROUP BY group_id, device),
s1 AS (SELECT *, (0.7 * (1.0 - distance / (max(distance) OVER (PARTITION BY group_id) + 1e-10)) + 0.3 * confidence) * 100 AS score FROM s0),
sc AS (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY round(score, 9) DESC, device) AS INTEGER) AS rank FROM s1)
"""

SQL = {
    "ag1_conditions": _STEPS + "SELECT group_id, device, param, round(norm_value + 3e-10, 6) + 0.0 AS norm_value, round(confidence + 3e-10, 6) + 0.0 AS confidence, adjusted FROM c2",
    "ag2_ag4_z_numbers": _STEPS + "SELECT group_id, device, param, round(rel + 3e-10, 6) + 0.0 AS reliability, round(a_l + 3e-10, 6) + 0.0 AS a_l, round(a_r + 3e-10, 6) + 0.0 AS a_r, round(b_l + 3e-10, 6) + 0.0 AS b_l, round(b_r + 3e-10, 6) + 0.0 AS b_r, round(f_l + 3e-10, 6) + 0.0 AS f_l, round(f_r + 3e-10, 6) + 0.0 AS f_r, round(wv + 3e-10, 6) + 0.0 AS weighted_value FROM z",
    "ag5_aggregate_z": _STEPS + "SELECT group_id, param, round(avg(a_l) + 3e-10, 6) + 0.0 AS a_l, round(avg(norm_value) + 3e-10, 6) + 0.0 AS a_m, round(avg(a_r) + 3e-10, 6) + 0.0 AS a_r, round(avg(b_l) + 3e-10, 6) + 0.0 AS b_l, round(avg(rel) + 3e-10, 6) + 0.0 AS b_m, round(avg(b_r) + 3e-10, 6) + 0.0 AS b_r FROM z GROUP BY group_id, param",
    "ag6_min_max": _STEPS + "SELECT group_id, device, param, missing, round(norm + 3e-10, 6) + 0.0 AS norm FROM w",
    "ag7_merec_weights": _STEPS + "SELECT group_id, param, round(max(weight) + 3e-10, 6) + 0.0 AS weight FROM w GROUP BY group_id, param",
    "ag8_ag10_device_scores": _STEPS + "SELECT group_id, device, round(distance + 3e-10, 6) + 0.0 AS distance, round(confidence + 3e-10, 6) + 0.0 AS confidence, round(score + 3e-10, 6) + 0.0 AS score, rank FROM sc",
    "ag11_dimensions": _STEPS + ", d AS (SELECT group_id, device, dimension, CASE WHEN sum(weight) > 0 THEN sum(weight * norm) / sum(weight) ELSE avg(norm) END * 100 AS s FROM w WHERE dimension IS NOT NULL GROUP BY group_id, device, dimension) SELECT group_id, device, " + ", ".join(f"round(coalesce(max(s) FILTER (dimension = '{n}'), 50.0) + 3e-10, 6) + 0.0 AS {n}" for n in dicts.DIMENSIONS) + " FROM d GROUP BY group_id, device",
    "ag12_strengths": _STEPS + """, o AS (SELECT group_id, device, param, param_no, kind, round(norm, 9) AS norm FROM w),
l AS (SELECT *, row_number() OVER (PARTITION BY group_id, param ORDER BY norm DESC, device) AS t, row_number() OVER (PARTITION BY group_id, param ORDER BY norm, device) AS b FROM o),
x AS (SELECT *, CASE WHEN t = 1 THEN max(norm) FILTER (t = 2) OVER (PARTITION BY group_id, param) ELSE max(norm) FILTER (t = 1) OVER (PARTITION BY group_id, param) END AS hi,
  CASE WHEN b = 1 THEN max(norm) FILTER (b = 2) OVER (PARTITION BY group_id, param) ELSE max(norm) FILTER (b = 1) OVER (PARTITION BY group_id, param) END AS lo FROM l),
y AS (SELECT *, kind IN ('benefit', 'cost') AND norm >= hi - 0.05 AS good, kind IN ('benefit', 'cost') AND NOT norm >= hi - 0.05 AND norm <= lo + 0.05 AS bad FROM x)
SELECT group_id, device, coalesce(array_to_string(list(param ORDER BY param_no) FILTER (good)[1:4], ','), '') AS strong, coalesce(array_to_string(list(param ORDER BY param_no) FILTER (bad)[1:3], ','), '') AS weak FROM y GROUP BY group_id, device""",
    "ag13_recommendation": _STEPS + "SELECT group_id, max(device) FILTER (rank = 1) AS best, round(max(score) FILTER (rank = 1) + 3e-10, 6) + 0.0 AS best_score, max(CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.6 THEN 'medium' ELSE 'low' END) FILTER (rank = 1) AS reliability, max(device) FILTER (rank = 2) AS second, round(max(score) FILTER (rank = 2) + 3e-10, 6) + 0.0 AS second_score FROM sc GROUP BY group_id",
    "ag14_differences": """WITH n AS (SELECT group_id, count(DISTINCT device) AS devices FROM {fx_device_params} GROUP BY group_id)
SELECT f.group_id, param, count(DISTINCT round(value, 4)) > 1 AS values_differ, count(value) < max(devices) AS some_missing,
  count(DISTINCT concat(coalesce(CAST(CAST(temperature AS INTEGER) AS VARCHAR), '-'), '|', coalesce(CAST(CAST(round(voltage * 10) AS INTEGER) AS VARCHAR), '-'))) > 1 AS conditions_differ
FROM {fx_device_params} f JOIN n ON n.group_id = f.group_id GROUP BY f.group_id, param""",
    "ag14_value_ranks": "SELECT group_id, param, device, CAST(row_number() OVER (PARTITION BY group_id, param ORDER BY value DESC NULLS LAST, device) AS INTEGER) AS value_rank FROM {fx_device_params}",
    "ag15_headline": _STEPS + "SELECT group_id, max(device) FILTER (rank = 1) AS winner, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) + 3e-10, 6) + 0.0 AS lead, round(avg(confidence) + 3e-10, 6) + 0.0 AS mean_confidence FROM sc GROUP BY group_id",
    "kg9_scoring_names": f"""WITH j AS (SELECT chip_id AS chip, coalesce(n.t, lower(param_name)) AS param, coalesce(n.no, -1) AS no, param_value AS value, confidence FROM {{fx_parameters}} LEFT JOIN {_N} ON lower(n.f) = lower(param_name)),
o AS (SELECT chip, param, value, 'datasheet_table' AS source, confidence FROM (SELECT *, row_number() OVER (PARTITION BY chip, param ORDER BY no DESC, confidence DESC, value DESC) AS k FROM j) WHERE k = 1),
c AS (SELECT chip, max(value) FILTER (param = 'quiescent_current') AS iq, max(value) FILTER (param = 'supply_voltage') AS v FROM o GROUP BY chip),
d AS (SELECT chip, 'power_consumption' AS param, abs(iq) * coalesce(v, 5.0) / 1000 AS value, 'llm_inference' AS source, 0.7 AS confidence FROM c WHERE iq <> 0 UNION ALL SELECT chip, 'temperature_range', 85.0, 'default_value', 0.3 FROM c
  UNION ALL SELECT chip, 'package_size', 14.0, 'default_value', 0.3 FROM c UNION ALL SELECT chip, 'ttl_compatible', CASE WHEN upper(chip) LIKE '%HCT%' OR upper(chip) LIKE '%TTL%' THEN 1.0 ELSE 0.0 END, 'rule_inference', 0.7 FROM c)
SELECT chip, param, round(CAST(value AS DOUBLE) + 3e-10, 6) + 0.0 AS value, source, round(CAST(confidence AS DOUBLE) + 3e-10, 6) + 0.0 AS confidence FROM (SELECT * FROM o UNION ALL SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.chip = d.chip AND o.param = d.param))""",
    "kg10_comparison_matrix": "SELECT group_id, device, max(value) FILTER (param = 'frequency') AS frequency, max(value) FILTER (param = 'supply_voltage') AS supply_voltage, max(value) FILTER (param = 'output_current') AS output_current FROM {fx_device_params} GROUP BY group_id, device",
    "wn1_position_clusters": """WITH e AS (SELECT user_id, floor(epoch_us(ts) / 1000000) AS position FROM {events}),
a AS (SELECT *, floor(position / 180000.0) * 180000.0 AS b, count(*) OVER (PARTITION BY user_id) AS al FROM e),
g AS (SELECT user_id, b, max(al) AS al, count(*) AS n, min(position) AS lo, max(position) AS hi FROM a GROUP BY user_id, b),
h AS (SELECT *, CASE WHEN b - lag(b) OVER (PARTITION BY user_id ORDER BY b) > 288000.0 THEN 1 ELSE 0 END AS nw FROM g),
i AS (SELECT *, CASE WHEN al <= 5 THEN 0 ELSE sum(nw) OVER (PARTITION BY user_id ORDER BY b) END AS island FROM h),
c AS (SELECT user_id, island, sum(n) AS n, min(lo) AS lo, max(hi) AS hi, max(al) AS al FROM i GROUP BY user_id, island),
s AS (SELECT *, max(n) OVER (PARTITION BY user_id) >= 3 AS enough FROM c)
SELECT user_id, CAST(island AS BIGINT) AS island, CAST(n AS BIGINT) AS n, lo, hi FROM s WHERE n >= 3 OR al <= 5
UNION ALL SELECT user_id, 0, CAST(sum(n) AS BIGINT), min(lo), max(hi) FROM s WHERE NOT enough AND al > 5 GROUP BY user_id""",
}
