"""Views over the given tables that have the shapes the operators take.

Each view is one SQL text that Spark and the checking engine both run; ``{name}`` stands for a table
or another view. Keys only drive choices, nothing is random.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "fx_device_params": """
WITH a AS (
  SELECT p.p_brand AS group_id, p.p_partkey AS k, p.p_size AS sz, CAST(round(p.p_retailprice * 100) AS BIGINT) AS rp, count(*) AS n,
         sum(CAST(round(l.l_quantity * 100) AS BIGINT)) AS q, sum(CAST(round(l.l_discount * 100) AS BIGINT)) AS d,
         max(CAST(l.l_quantity AS DOUBLE)) AS mq, sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS e
  FROM {part} p JOIN {lineitem} l ON l.l_partkey = p.p_partkey
  GROUP BY p.p_brand, p.p_partkey, p.p_size, p.p_retailprice),
u AS (
  SELECT group_id, k, 0 AS n, 'frequency' AS param, CAST(q AS DOUBLE) / CAST(n * 100 AS DOUBLE) AS value FROM a UNION ALL
  SELECT group_id, k, 1, 'propagation_delay', CAST(d * 10 AS DOUBLE) / CAST(n AS DOUBLE) FROM a UNION ALL
  SELECT group_id, k, 2, 'supply_voltage', CAST(1.8 + (sz % 8) * 0.5 AS DOUBLE) FROM a UNION ALL
  SELECT group_id, k, 3, 'output_current', mq FROM a UNION ALL
  SELECT group_id, k, 4, 'power_consumption', CAST(e AS DOUBLE) / CAST(n * 100000 AS DOUBLE) FROM a UNION ALL
  SELECT group_id, k, 5, 'quiescent_current', CAST(rp AS DOUBLE) / CAST(1000 AS DOUBLE) FROM a UNION ALL
  SELECT group_id, k, 6, 'temperature_range', CAST(40 + sz AS DOUBLE) FROM a)
SELECT group_id, CAST(k AS BIGINT) AS device, param, value,
       CASE k % 6 WHEN 0 THEN 'datasheet_direct' WHEN 1 THEN 'datasheet_table' WHEN 2 THEN 'datasheet_graph'
                  WHEN 3 THEN 'knowledge_graph' WHEN 4 THEN 'llm_inference' ELSE 'default_value' END AS source,
       CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(25 + (k % 4) * 40 AS DOUBLE) END AS temperature,
       CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(3.3 + (k % 3) * 0.4 AS DOUBLE) END AS voltage
FROM u WHERE (k + n) % 11 <> 0""",
    "fx_driver": """
SELECT CAST(s_suppkey AS BIGINT) AS driver, CAST(2.0 + (s_suppkey % 7) * 0.4 AS DOUBLE) AS voh, CAST((s_suppkey % 6) * 0.1 AS DOUBLE) AS vol,
       CAST(-1 * (s_suppkey % 9) AS DOUBLE) AS ioh, 'mA' AS ioh_unit, CAST(0.5 * (s_suppkey % 5) AS DOUBLE) AS iol, 'mA' AS iol_unit,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(3.3 + (s_suppkey % 3) * 0.2 AS DOUBLE) END AS driver_vcc,
       CASE s_nationkey % 5 WHEN 0 THEN 'CMOS' WHEN 1 THEN 'BiCMOS' WHEN 2 THEN 'TTL' WHEN 3 THEN 'NMOS' ELSE 'ECL' END AS driver_process,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST((1 + s_suppkey % 8) * 1e-9 AS DOUBLE) END AS rise_time
FROM {supplier}""",
    "fx_receiver": """
SELECT CAST(p_partkey AS BIGINT) AS receiver, CAST(1.5 + (p_size % 6) * 0.4 AS DOUBLE) AS vih, CAST(0.4 + (p_size % 4) * 0.2 AS DOUBLE) AS vil,
       CAST(0.1 * (p_partkey % 8) AS DOUBLE) AS iih, 'uA' AS iih_unit, CAST(-100 * (p_partkey % 7) AS DOUBLE) AS iil, 'uA' AS iil_unit,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(3.3 AS DOUBLE) END AS receiver_vcc,
       CASE p_size % 4 WHEN 0 THEN 'DIP' WHEN 1 THEN 'SOP' WHEN 2 THEN 'QFP' ELSE 'BGA' END AS receiver_package
FROM {part}""",
    "fx_pairs": """
WITH d AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS driver, CAST(l_partkey AS BIGINT) AS receiver FROM {lineitem})
SELECT driver, receiver,
       CASE WHEN driver % 4 = 0 THEN NULL ELSE CAST((driver % 10) * 3 AS DOUBLE) END AS trace_length,
       CASE WHEN receiver % 3 = 0 THEN NULL ELSE CAST(50 AS DOUBLE) END AS trace_impedance,
       CASE driver % 6 WHEN 0 THEN 'GPIO' WHEN 1 THEN 'UART' WHEN 2 THEN 'SPI' WHEN 3 THEN 'I2C' WHEN 4 THEN 'ADC' ELSE 'PWM' END AS driver_interface,
       CASE receiver % 5 WHEN 0 THEN 'GPIO' WHEN 1 THEN 'UART' WHEN 2 THEN 'SPI' WHEN 3 THEN 'CAN' ELSE NULL END AS receiver_interface,
       CASE driver % 3 WHEN 0 THEN 'output' WHEN 1 THEN 'bidirectional' ELSE 'input' END AS driver_direction,
       CASE receiver % 3 WHEN 0 THEN 'input' WHEN 1 THEN 'bidirectional' ELSE NULL END AS receiver_direction,
       CASE driver % 4 WHEN 0 THEN 'pull_up' WHEN 1 THEN 'pull_down' ELSE NULL END AS driver_pull,
       CASE receiver % 4 WHEN 0 THEN 'pull_down' WHEN 1 THEN 'pull_up' ELSE NULL END AS receiver_pull,
       driver % 7 = 0 AS driver_tri_state
FROM d""",
    "fx_chips": """
SELECT concat('chip', lpad(CAST(p_partkey AS VARCHAR(9)), CAST(greatest(6, length(CAST(p_partkey AS VARCHAR(9)))) AS INTEGER), '0')) AS chip_id,
       concat(CASE p_partkey % 3 WHEN 0 THEN 'SN74HC' WHEN 1 THEN 'CD4' ELSE '74LS' END, lpad(CAST(p_partkey AS VARCHAR(9)), 4, '0')) AS name,
       p_name AS full_name, p_type AS family, p_brand AS manufacturer, CAST(1.8 + (p_size % 8) * 0.5 AS DOUBLE) AS supply_voltage,
       CASE p_size % 3 WHEN 0 THEN 'DIP-14' WHEN 1 THEN 'SOP-16' ELSE NULL END AS package, CAST(8 + (p_size % 5) * 4 AS INTEGER) AS pin_count
FROM {part}""",
    "fx_parameters": """
SELECT concat('chip', lpad(CAST(l_partkey AS VARCHAR(9)), CAST(greatest(6, length(CAST(l_partkey AS VARCHAR(9)))) AS INTEGER), '0')) AS chip_id,
       CASE l_linenumber WHEN 1 THEN 'VOH' WHEN 2 THEN 'VOL' WHEN 3 THEN 'VIH' WHEN 4 THEN 'VIL' WHEN 5 THEN 'IOH' WHEN 6 THEN 'IOL' ELSE 'VCC' END AS param_name,
       concat(lpad(CAST(l_partkey AS VARCHAR(9)), CAST(greatest(6, length(CAST(l_partkey AS VARCHAR(9)))) AS INTEGER), '0'), '_', CAST(l_linenumber AS VARCHAR(3)), '_', CAST(l_orderkey % 3 AS VARCHAR(3))) AS param_id,
       round(avg(CAST(l_quantity AS DOUBLE)) / 10, 6) AS param_value, round(0.5 + avg(CAST(l_discount AS DOUBLE)), 6) AS confidence
FROM {lineitem} GROUP BY l_partkey, l_linenumber, l_orderkey % 3""",
    "fx_parameter_texts": """
SELECT chip_id, param_name, param_id, confidence,
       concat(CAST(CAST(floor(floor(param_value * 100) / 100) AS BIGINT) AS VARCHAR(20)), '.', lpad(CAST(CAST(floor(param_value * 100) AS BIGINT) % 100 AS VARCHAR(20)), 2, '0')) AS value_text
FROM {fx_parameters}""",
    "fx_tables": """
SELECT CAST(l_orderkey AS BIGINT) AS table_id, CAST(floor(l_orderkey / 3) AS BIGINT) AS document_id, CAST(1 + l_orderkey % 3 AS INTEGER) AS page,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS row_no,
       CASE l_linenumber WHEN 1 THEN 'VOH' WHEN 2 THEN 'VOL' WHEN 3 THEN 'VIH' WHEN 4 THEN 'V_IL' WHEN 5 THEN 'IOH' WHEN 6 THEN 'IOL' ELSE 'VCC' END AS symbol,
       CASE WHEN (l_linenumber + l_orderkey) % 5 = 0 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20)) END AS min_text,
       CASE WHEN (l_linenumber + l_orderkey) % 7 = 0 THEN '-' ELSE concat(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20)), '.5') END AS typ_text,
       CASE WHEN (l_linenumber + l_orderkey) % 3 = 0 THEN concat(CAST(l_linenumber AS VARCHAR(20)), ' to ', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(20))) ELSE concat(CAST(l_linenumber AS VARCHAR(20)), 'mA') END AS max_text,
       'V' AS unit_text, concat('VCC = ', CAST(l_linenumber AS VARCHAR(20)), 'V, 25C') AS condition_text
FROM {lineitem}""",
    "fx_queries": "SELECT CAST(item_id AS BIGINT) AS query_id, text AS query FROM {benchmark}",
    "fx_table_content": """
SELECT table_id, document_id, page, symbol, concat(symbol, ' ', min_text, ' ', typ_text, ' ', max_text, ' ', unit_text) AS content, row_no FROM {fx_tables}""",
    "fx_figures": """
SELECT CAST(page_id AS BIGINT) AS image_id, CAST(page_id % 40 AS BIGINT) AS document_id, concat('sheet', CAST(page_id % 40 AS VARCHAR(9)), '_ne5532.pdf') AS filename,
  lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS caption,
  CASE page_id % 4 WHEN 0 THEN 'amplifier op amp' WHEN 1 THEN 'filter' WHEN 2 THEN 'oscillator' ELSE '' END AS types,
  CASE page_id % 3 WHEN 0 THEN 'r1 c1' WHEN 1 THEN 'u1' ELSE '' END AS parts,
  CAST((page_id % 17) AS DOUBLE) / 10 AS visual, CASE WHEN page_id % 11 = 0 THEN '' ELSE concat('figures/', CAST(page_id AS VARCHAR(9)), '.png') END AS image_path,
  page_id % 5 <> 0 AS is_circuit, CAST(page_id % 25 AS DOUBLE) / 100 AS confidence
FROM {pages}""",
    "fx_figure_queries": """
SELECT CAST(item_id AS BIGINT) AS query_id, CASE item_id % 4 WHEN 0 THEN 'ne5532 amplifier' WHEN 1 THEN 'filter r1 the' WHEN 2 THEN 'lang charset title' ELSE 'oscillator u1 5532' END AS query
FROM {benchmark}""",
    "fx_names": """
SELECT CAST(p_partkey AS BIGINT) AS query_id, CASE p_partkey % 5 WHEN 0 THEN concat('SN74HC', lpad(CAST(p_partkey AS VARCHAR(9)), 4, '0')) WHEN 1 THEN concat('CD4', lpad(CAST(p_partkey AS VARCHAR(9)), 4, '0'))
  WHEN 2 THEN concat('MC74LS', lpad(CAST(p_partkey AS VARCHAR(9)), 4, '0')) WHEN 3 THEN p_name ELSE concat('LM', CAST(p_partkey AS VARCHAR(9))) END AS name
FROM {part}""",
    "fx_kb": """
SELECT chip_id, param_name, max_by(param_value, concat(lpad(CAST(CAST(round(confidence * 1000000) AS BIGINT) AS VARCHAR(20)), 12, '0'), param_id)) AS kb_value FROM {fx_parameters} GROUP BY chip_id, param_name""",
    "fx_doc_values": """
SELECT chip_id, param_name, param_value * CASE WHEN param_value < 2 THEN 1.05 ELSE 1.3 END AS doc_value, CAST(NULL AS VARCHAR(9)) AS unit FROM {fx_parameters}""",
    "fx_files": "SELECT CAST(o_orderkey AS BIGINT) AS entry, CAST(o_custkey AS BIGINT) AS document_id, concat('file', CAST(o_custkey AS VARCHAR(9)), '.pdf') AS filename, o_orderdate AS upload_time FROM {orders}",
    "fx_catalogue": """
SELECT CAST(event_id AS BIGINT) AS entry, CAST(user_id AS BIGINT) AS document_id, event_type AS status, CAST(value AS DOUBLE) AS progress, ts
FROM {events}""",
    "fx_answers": "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, text FROM {conversations} WHERE role = 'assistant'",
}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def device_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``fx_device_params``, whose SQL would read and join its tables once for each parameter.

    Lines are summed by part before they meet it, and parts are dealt by their key: as they grow with the
    lines, they are not sent to all tasks, however small their file looks.
    """
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    lines = read(spark, sf_dir, "lineitem").where("l_partkey is not null").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(cents("l_quantity")).alias("q"), F.sum(cents("l_discount")).alias("d"), F.max(F.col("l_quantity").cast("double")).alias("mq"), F.sum(cents("l_extendedprice")).alias("e"))
    parts = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    a = parts.join(lines.hint("merge"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_partkey", "p_size", "p_retailprice").agg(*(F.sum(c).alias(c) for c in ("n", "q", "d", "e")), F.max("mq").alias("mq"))
    real = lambda c: c.cast("double")
    n, k = F.col("n"), F.col("p_partkey")
    values = [
        ("frequency", real(F.col("q")) / real(n * 100)), ("propagation_delay", real(F.col("d") * 10) / real(n)), ("supply_voltage", real(F.expr("1.8 + (p_size % 8) * 0.5"))), ("output_current", F.col("mq")),
        ("power_consumption", real(F.col("e")) / real(n * 100000)), ("quiescent_current", real(cents("p_retailprice")) / 1000.0), ("temperature_range", real(F.col("p_size") + 40)),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(p).alias("param"), v.alias("value")) for i, (p, v) in enumerate(values)))
    sources = ("datasheet_direct", "datasheet_table", "datasheet_graph", "knowledge_graph", "llm_inference")
    u = a.select(F.col("p_brand").alias("group_id"), k.cast("long").alias("device"), k.alias("k"), F.inline(rows)).where("(k + n) % 11 <> 0")
    k = F.col("k")
    source = F.lit("default_value")
    for i, s in enumerate(sources):
        source = F.when(k % 6 == i, s).otherwise(source)
    return u.select("group_id", "device", "param", "value", source.alias("source"), F.expr("CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(25 + (k % 4) * 40 AS DOUBLE) END").alias("temperature"), F.expr("CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(3.3 + (k % 3) * 0.4 AS DOUBLE) END").alias("voltage"))


#: Views that Spark builds with fewer passes than their SQL would take; the rows are the same.
BUILT = {"fx_device_params": device_params}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view by its name."""
    if name in BUILT:
        return BUILT[name](spark, sf_dir)
    if name in VIEWS:
        return run_sql(spark, sf_dir, VIEWS[name])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("VARCHAR(3)", "STRING").replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING"), **{n: read(spark, sf_dir, n) for n in names_in(sql)})


def plain_sql(sql: str) -> str:
    """The SQL with its views in front, for an engine that has the tables as views."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in names_in(text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(sql)
    strip = lambda text: re.sub(r"\{(\w+)\}", r"\1", text).strip()
    views = [f"{n} AS ({strip(VIEWS[n])})" for n in order]
    body = strip(sql)
    if not views:
        return body
    if re.match(r"WITH\s+RECURSIVE\s", body):
        return f"WITH RECURSIVE {', '.join(views)}, {re.sub(r'^WITH\s+RECURSIVE', '', body).strip()}"
    if re.match(r"WITH\s", body):
        return f"WITH {', '.join(views)}, {body[4:].strip()}"
    return f"WITH {', '.join(views)} {body}"
