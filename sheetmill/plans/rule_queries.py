"""Queries over driver x receiver pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetmill.functions import dicts, units
from sheetmill.operators import rules as R
from sheetmill.plans.fixtures import read

TEMPERATURE = 85.0


def _table(spark, sf_dir):
    return R.paired(read(spark, sf_dir, "fx_pairs"), read(spark, sf_dir, "fx_driver"), read(spark, sf_dir, "fx_receiver"))


def _results(spark, sf_dir, layers=(1, 2, 3, 4)):
    return R.check_pairs(_table(spark, sf_dir), dicts.degradation(spark), TEMPERATURE, layers)


def _layer(*layers):
    return lambda spark, sf_dir: _results(spark, sf_dir, layers).withColumn("margin", F.round("margin", 6) + 0.0)


def er14(spark, sf_dir):
    out = R.with_degradation(read(spark, sf_dir, "fx_driver"), dicts.degradation(spark), R.process_of(F.col("driver_process")), F.lit("QFP"), F.col("driver_vcc"), "d", TEMPERATURE)
    return out.select("driver", *(F.round(f"d_{c}", 6).alias(c) for c in ("rate", "factor", "ci_low", "ci_high", "lifetime")), F.col("d_risk").alias("risk"))


def er15(spark, sf_dir):
    t = read(spark, sf_dir, "fx_receiver")
    text = F.concat(F.lit("plastic-"), F.lower("receiver_package"), F.lit(" 74bicmos"))
    return t.select("receiver", R.process_of(text).alias("process"), R.package_of(text).alias("package"))


def er16(spark, sf_dir):
    return R.layer_results(_results(spark, sf_dir))


def er17(spark, sf_dir):
    return R.overall_results(R.layer_results(_results(spark, sf_dir))).withColumn("confidence", F.round("confidence", 6))


def er18(spark, sf_dir):
    return R.categorised(_results(spark, sf_dir))


def er16_report(spark, sf_dir):
    return R.rule_report(_results(spark, sf_dir))


def kg7(spark, sf_dir):
    t = read(spark, sf_dir, "fx_receiver").join(read(spark, sf_dir, "fx_pairs").select("driver", "receiver"), "receiver").join(read(spark, sf_dir, "fx_driver"), "driver")
    rows = t.select("driver", "receiver", F.round(units.current_in_amps(F.col("iil"), F.col("iil_unit")), 9).alias("iil_a"), F.round(units.current_in_milliamps(F.col("ioh"), F.col("ioh_unit")), 6).alias("ioh_ma"), F.round(units.time_in_seconds(F.col("rise_time") * 1e9, F.lit(None).cast("string")), 12).alias("rise_s"))
    return rows.groupBy("driver").agg(F.min("iil_a").alias("iil_a"), F.max("ioh_ma").alias("ioh_ma"), F.max("rise_s").alias("rise_s"))


def kg11(spark, sf_dir):
    chips = read(spark, sf_dir, "fx_chips")
    name = F.concat("name", F.when(F.col("pin_count") % 3 == 0, F.lit("-spi")).when(F.col("pin_count") % 5 == 0, F.lit("-adc")).otherwise(F.lit("")))
    return chips.select("chip_id", R.interface_of(name).alias("interface"), F.coalesce("supply_voltage", F.lit(5.0)).alias("voltage"))


def kg12(spark, sf_dir):
    t = R.with_trace_estimate(read(spark, sf_dir, "fx_driver").withColumn("fall_time", F.lit(None).cast("double")))
    return t.select("driver", F.round("est_length", 6).alias("est_length"), "est_impedance")


QUERIES = {
    "er1_er7_static_rules": _layer(1),
    "er8_er9_line_rules": _layer(2),
    "er10_er11_topology_rules": _layer(3),
    "er12_er13_stress_rules": _layer(4),
    "er14_degradation": er14,
    "er15_process_package": er15,
    "er16_layer_rollup": er16,
    "er16_rule_report": er16_report,
    "er17_overall": er17,
    "er18_categories": er18,
    "kg7_units": kg7,
    "kg11_interfaces": kg11,
    "kg12_trace_estimate": kg12,
}

_DEG = dicts.values_sql(dicts.DEGRADATION, "g(process, package, c_temp, c_hum, c_volt, base_rate, energy, ci_low, ci_high)")
_COND = ", ".join(f"'{a}>{b}'" for a, b in dicts.CONDITIONAL_INTERFACES)
_AMPS = "CASE WHEN {u} = 'mA' THEN {v} / 1000 WHEN {u} = 'uA' THEN {v} / 1000000 ELSE {v} END"
_A = {n: _AMPS.replace("{u}", f"{n}_unit").replace("{v}", n) for n in ("ioh", "iol", "iih", "iil")}


def _deg(side: str) -> str:
    return f"""d_{side} AS (
  SELECT k.*, greatest(1.0 - coalesce(g.base_rate, 0.1) * exp(coalesce(g.energy, 0.7) / 8.617e-5 * (1 / (25.0 + 273.15) - 1 / ({TEMPERATURE} + 273.15)))
    * (1 + coalesce(g.c_temp, 0.002) * ({TEMPERATURE} - 25.0) + coalesce(g.c_hum, 0.001) * 0.0 + coalesce(g.c_volt, 0.001) * (coalesce({side}_vcc, 3.3) - 3.3)), 0.1) AS {side}_factor
  FROM {"d_driver" if side == "receiver" else "t"} k LEFT JOIN {_DEG} ON g.process = {"driver_process" if side == "driver" else "'CMOS'"} AND g.package = {"'DIP'" if side == "driver" else "receiver_package"})"""


_BASE = """t AS (
  SELECT p.*, d.* EXCLUDE (driver), r.* EXCLUDE (receiver) FROM {fx_pairs} p JOIN {fx_driver} d ON d.driver = p.driver JOIN {fx_receiver} r ON r.receiver = p.receiver)"""
_RULES: dict[int, str] = {
    1: f"""SELECT driver, receiver, 1 AS layer, 'L1-V000' AS rule_id, abs(driver_vcc - receiver_vcc) <= 0.3 AS passed, 'error' AS bad, 'info' AS good, 0.3 - abs(driver_vcc - receiver_vcc) AS margin FROM d_receiver WHERE driver_vcc IS NOT NULL AND receiver_vcc IS NOT NULL
  UNION ALL SELECT driver, receiver, 1, 'L1-V001', voh >= vih, 'error', 'info', voh - vih FROM d_receiver
  UNION ALL SELECT driver, receiver, 1, 'L1-V002', vol <= vil, 'error', 'info', vil - vol FROM d_receiver
  UNION ALL SELECT driver, receiver, 1, 'L1-N001', least(voh - vih, vil - vol) / (voh - vol) >= 0.2, 'warning', 'info', least(voh - vih, vil - vol) / (voh - vol) - 0.2 FROM d_receiver WHERE voh - vol <> 0
  UNION ALL SELECT driver, receiver, 1, 'L1-I001', abs({_A["ioh"]}) >= abs({_A["iih"]}), 'error', 'info', abs({_A["ioh"]}) - abs({_A["iih"]}) FROM d_receiver
  UNION ALL SELECT driver, receiver, 1, 'L1-I002', {_A["iol"]} >= abs({_A["iil"]}), 'error', 'info', {_A["iol"]} - abs({_A["iil"]}) FROM d_receiver
  UNION ALL SELECT driver, receiver, 1, 'L1-I003', f >= 1, 'info', 'info', f - 1 FROM (SELECT driver, receiver, least(CASE WHEN iih = 0 THEN CAST('Infinity' AS DOUBLE) ELSE abs({_A["ioh"]}) / abs({_A["iih"]}) END, CASE WHEN iil = 0 THEN CAST('Infinity' AS DOUBLE) ELSE {_A["iol"]} / abs({_A["iil"]}) END) AS f FROM d_receiver)""",
    2: """SELECT driver, receiver, 2 AS layer, 'L2-T001' AS rule_id, trace_length IS NULL OR trace_length < c AS passed, 'warning' AS bad, 'info' AS good, c - trace_length AS margin FROM (SELECT *, least(coalesce(rise_time, 10e-9), 10e-9) * 1e9 * 15 / 6 AS c FROM d_receiver)
  UNION ALL SELECT driver, receiver, 2, 'L2-R001', g < 0.15, 'warning', 'info', 0.15 - g FROM (SELECT *, greatest(abs((trace_impedance - 25.0) / (trace_impedance + 25.0)), abs((1e6 - trace_impedance) / (1e6 + trace_impedance))) AS g FROM d_receiver WHERE trace_impedance IS NOT NULL)""",
    3: f"""SELECT driver, receiver, 3 AS layer, 'L3-I001' AS rule_id, fits AND NOT x AS passed, CASE WHEN NOT fits THEN 'error' ELSE 'warning' END AS bad, 'info' AS good, CAST(NULL AS DOUBLE) AS margin FROM (
    SELECT *, (a = b AND a IN ('GPIO', 'UART', 'I2C', 'SPI', 'ADC', 'PWM', 'CAN')) OR concat(a, '>', b) IN ({_COND}) OR a = 'GPIO' OR b = 'GPIO' AS fits FROM (
      SELECT *, coalesce(driver_interface, 'GPIO') AS a, coalesce(receiver_interface, 'GPIO') AS b, coalesce(abs(driver_vcc - receiver_vcc) > 0.5, FALSE) AS x FROM d_receiver))
  UNION ALL SELECT driver, receiver, 3, 'L3-P001', NOT ((a = 'input' AND b = 'input') OR (a = 'bidirectional' AND b = 'bidirectional') OR coalesce(driver_pull = 'pull_up' AND receiver_pull = 'pull_down', FALSE)
    OR coalesce(driver_pull = 'pull_down' AND receiver_pull = 'pull_up', FALSE) OR (driver_tri_state AND b <> 'input')), 'error', 'info', NULL FROM (SELECT *, coalesce(driver_direction, 'output') AS a, coalesce(receiver_direction, 'input') AS b FROM d_receiver)""",
    4: """SELECT driver, receiver, 4 AS layer, 'L4-T001' AS rule_id, NOT (hh < 0 OR lh < 0) AS passed, 'warning' AS bad, CASE WHEN hl > 0 AND ll > 0 THEN 'info' ELSE 'warning' END AS good, least(hl, ll) AS margin FROM (
    SELECT *, (voh - abs(voh * k)) - (vih + abs(vih * k)) AS hl, (voh + abs(voh * k)) - (vih - abs(vih * k)) AS hh, (vil - abs(vil * k)) - (vol + abs(vol * k)) AS ll, (vil + abs(vil * k)) - (vol - abs(vol * k)) AS lh FROM (SELECT *, 60.0 * CAST(0.002 AS DOUBLE) AS k FROM d_receiver))
  UNION ALL SELECT driver, receiver, 4, 'L4-P001', m >= 0.1, 'warning', 'info', m - 0.1 FROM (SELECT driver, receiver, least(voh * f - vih, vil - vol * (2.0 - f)) AS m FROM (SELECT *, least(driver_factor, receiver_factor) AS f FROM d_receiver))""",
}


def _with(layers: tuple[int, ...]) -> str:
    union = " UNION ALL ".join(_RULES[k] for k in layers)
    return f"WITH {_BASE}, {_deg('driver')}, {_deg('receiver')}, u AS ({union}), r AS (SELECT driver, receiver, layer, rule_id, passed, CASE WHEN passed THEN good ELSE bad END AS severity, margin FROM u)"


_ALL = _with((1, 2, 3, 4))
_LAYERS = _ALL + """, y AS (SELECT driver, receiver, layer, count(*) AS rules, count(*) FILTER (passed) AS rules_passed, count(*) FILTER (NOT passed AND severity = 'error') AS errors,
  count(*) FILTER (NOT passed AND severity = 'warning') AS warnings FROM r GROUP BY driver, receiver, layer),
z AS (SELECT *, CASE WHEN layer IN (1, 3) THEN errors = 0 ELSE warnings = 0 END AS passed FROM y)"""

SQL = {f"{name}": _with((k,)) + " SELECT driver, receiver, layer, rule_id, passed, severity, round(margin, 6) + 0.0 AS margin FROM r" for k, name in enumerate(list(QUERIES)[:4], 1)} | {
    "er14_degradation": f"""SELECT driver, round(rate, 6) AS rate, round(f, 6) AS factor, round(f * ci_low, 6) AS ci_low, round(f * ci_high, 6) AS ci_high, round(0.5 / (rate / 1000.0), 6) AS lifetime,
  CASE WHEN f >= 0.95 THEN 'LOW' WHEN f >= 0.85 THEN 'MEDIUM' WHEN f >= 0.5 THEN 'HIGH' ELSE 'CRITICAL' END AS risk
FROM (SELECT *, greatest(1.0 - rate, 0.1) AS f FROM (
  SELECT driver, coalesce(g.base_rate, 0.1) * exp(coalesce(g.energy, 0.7) / 8.617e-5 * (1 / (25.0 + 273.15) - 1 / (85.0 + 273.15))) * (1 + coalesce(g.c_temp, 0.002) * 60.0 + coalesce(g.c_volt, 0.001) * (coalesce(driver_vcc, 3.3) - 3.3)) AS rate,
    coalesce(g.ci_low, 0.95) AS ci_low, coalesce(g.ci_high, 1.05) AS ci_high FROM {{fx_driver}} LEFT JOIN {_DEG} ON g.process = driver_process AND g.package = 'QFP'))""",
    "er15_process_package": "SELECT receiver, 'BiCMOS' AS process, receiver_package AS package FROM {fx_receiver}",
    "er16_layer_rollup": _LAYERS + " SELECT driver, receiver, layer, rules, rules_passed, errors, warnings, passed FROM z",
    "er16_rule_report": _ALL + " SELECT coalesce(layer, 0) AS layer, coalesce(rule_id, 'all') AS rule_id, count(*) AS checked, count(*) FILTER (NOT passed) AS failed FROM r GROUP BY ROLLUP (layer, rule_id)",
    "er17_overall": _LAYERS + """ SELECT driver, receiver, bool_and(passed) FILTER (layer IN (1, 3)) AS compatible, round(sum(rules_passed) / sum(rules), 6) AS confidence, NOT bool_and(passed) FILTER (layer IN (2, 4)) AS has_warnings,
  CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings, coalesce(string_agg('layer' || CAST(layer AS VARCHAR), ',' ORDER BY layer) FILTER (NOT passed), '') AS advice FROM z GROUP BY driver, receiver""",
    "er18_categories": _ALL + " SELECT driver, receiver, count(*) FILTER (NOT passed AND severity <> 'warning') AS n_error, count(*) FILTER (NOT passed AND severity = 'warning') AS n_warning, count(*) FILTER (passed) AS n_info FROM r GROUP BY driver, receiver",
    "kg7_units": "SELECT p.driver, min(round(iil / 1000000, 9)) AS iil_a, max(round(ioh / 1000 * 1000, 6)) AS ioh_ma, max(round(CASE WHEN abs(rise_time * 1e9) >= 1e-3 THEN rise_time * 1e9 * 1e-9 ELSE rise_time * 1e9 END, 12)) AS rise_s FROM {fx_pairs} p JOIN {fx_driver} d ON d.driver = p.driver JOIN {fx_receiver} r ON r.receiver = p.receiver GROUP BY p.driver",
    "kg11_interfaces": "SELECT chip_id, CASE WHEN pin_count % 3 = 0 THEN 'SPI' WHEN pin_count % 5 = 0 THEN 'ADC' ELSE 'GPIO' END AS interface, coalesce(supply_voltage, 5.0) AS voltage FROM {fx_chips}",
    "kg12_trace_estimate": "SELECT driver, round(CASE WHEN rise_time > 0 THEN rise_time * 1e9 * 15 / 10 ELSE 5.0 END, 6) AS est_length, CAST(50.0 AS DOUBLE) AS est_impedance FROM {fx_driver}",
}
