"""Queries over extracted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetmill.functions import values
from sheetmill.operators import tables as T
from sheetmill.plans.fixtures import read

HEADERS = [
    ["Symbol", "Parameter", "Min", "Typ", "Max", "Unit", "Condition"],
    ["Symbol", "Description", "Minimum", "Nominal", "Maximum", "Units", "Note"],
    ["Param", "DC Characteristics", "Min", "Nom", "Max", "Unit", "Remarks"],
    ["Absolute Maximum", "x", "Low", "Mid", "High", "U", "Where"],
]
PARAMS = ["VOH", "VOL", "VIH", "VIL", "IOH", "IOL", "VCC"]


def _r(df, *names):
    return df.withColumns({n: F.round(F.col(n) + 3e-10, 6) + 0.0 for n in names})


def grids(spark, sf_dir):
    rows = read(spark, sf_dir, "fx_tables")
    cells = F.array("symbol", F.lit(""), "min_text", "typ_text", "max_text", "unit_text", "condition_text")
    d = rows.groupBy("table_id", "document_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", cells.alias("cells")))), lambda s: s["cells"]).alias("body"))
    head = F.element_at(F.array(*(F.array(*(F.lit(c) for c in h)) for h in HEADERS)), (F.col("table_id") % 4 + 1).cast("int"))
    return d.select("table_id", "document_id", "page", F.concat(F.array(head), "body").alias("data"))


def scored(spark, sf_dir):
    return T.quality_scored(T.header_tagged(T.classified(T.base_confidence(T.stored(grids(spark, sf_dir))))))


def sc3(spark, sf_dir):
    return T.stored(grids(spark, sf_dir)).select("table_id", "row_count", "column_count", "empty_cells", "content")


def sc4(spark, sf_dir):
    t = _r(T.base_confidence(T.stored(grids(spark, sf_dir))), "confidence").where("confidence >= 0.65")
    return t.select("table_id", "document_id", "page", "confidence").orderBy("page", "table_id").limit(100)


def tb1(spark, sf_dir):
    return _r(T.base_confidence(T.stored(grids(spark, sf_dir))).select("table_id", "confidence"), "confidence")


def tb2(spark, sf_dir):
    return _r(T.classified(T.base_confidence(T.stored(grids(spark, sf_dir)))).select("table_id", "table_type", "confidence"), "confidence")


def tb3(spark, sf_dir):
    return scored(spark, sf_dir).select("table_id", F.array_join("header_keywords", ",").alias("header_keywords"))


def tb4(spark, sf_dir):
    return _r(scored(spark, sf_dir).select("table_id", "confidence"), "confidence")


def tb5(spark, sf_dir):
    m = T.merged_across_pages(scored(spark, sf_dir).withColumn("table_type", F.lit("electrical_characteristics")))
    return _r(m.select("table_id", "document_id", "page", F.size("data").alias("row_count"), "n_tables", "is_cross_page", "confidence"), "confidence")


def tb6(spark, sf_dir):
    d = read(spark, sf_dir, "fx_tables").groupBy("table_id").agg(F.array_sort(F.collect_list(F.col("row_no") * F.when(F.col("table_id") % 2 == 0, 2).otherwise(1))).alias("pins"))
    d = d.select("table_id", F.lit("pin_configuration").alias("table_type"), F.concat(F.array(F.array(F.lit("Pin"))), F.transform("pins", lambda p: F.array(p.cast("string")))).alias("data"), F.lit(0.8).alias("confidence"))
    return _r(T.pin_gap_penalty(d).select("table_id", "confidence"), "confidence")


def tb7(spark, sf_dir):
    g = T.stored(grids(spark, sf_dir).withColumns({"document_id": F.col("document_id") % 20, "data": F.transform("data", lambda r: F.slice(r, 1, 2))}))
    return T.deduplicated(g).select("table_id", "document_id", "page")


def tb8(spark, sf_dir):
    return T.stored(grids(spark, sf_dir)).select("table_id", T.column_roles(F.col("header")).alias("r")).select("table_id", *(F.col(f"r.{n}").alias(f"{n}_col") for n in ("symbol", "min", "typ", "max", "unit", "cond")))


def tb9(spark, sf_dir):
    return T.header_row(grids(spark, sf_dir)).select("table_id", "row_no")


def tb10(spark, sf_dir):
    return T.table_specs(grids(spark, sf_dir), PARAMS)


def tb11(spark, sf_dir):
    t = read(spark, sf_dir, "fx_tables")
    return t.select("table_id", "row_no", T.parsed_number(F.col("min_text")).alias("lo"), T.parsed_number(F.col("typ_text")).alias("typ"), T.parsed_number(F.col("max_text")).alias("hi"))


def tb13(spark, sf_dir):
    return T.scanned_text(T.stored(grids(spark, sf_dir)))


def tb14(spark, sf_dir):
    g = grids(spark, sf_dir)
    q = g.select("document_id").distinct().select(F.col("document_id").alias("query_id"), "document_id", F.lit("vih").alias("word"))
    return T.row_answers(q, g).select("query_id", "table_id", "row_no")


def pf6(spark, sf_dir):
    p = read(spark, sf_dir, "fx_parameters")
    return p.groupBy("param_name").agg(F.count("*").alias("n"), F.count_if(T.in_range(F.col("param_name"), F.col("param_value"))).alias("n_valid"))


def pf10(spark, sf_dir):
    return T.table_text(T.stored(grids(spark, sf_dir))).select("table_id", "title", F.md5("text").alias("text_key"))


QUERIES = {
    "sc3_stored_tables": sc3, "sc4_tables_by_document": sc4, "tb1_confidence": tb1, "tb2_table_type": tb2, "tb3_header_keywords": tb3, "tb4_quality": tb4, "tb5_cross_page": tb5, "tb6_pin_gaps": tb6, "tb7_dedupe": tb7,
    "tb8_column_roles": tb8, "tb9_header_row": tb9, "tb10_tb12_specs": tb10, "tb11_numbers": tb11, "tb13_text_scan": tb13, "tb14_row_answer": tb14, "pf6_range_check": pf6, "pf10_table_text": pf10,
}

_HEAD = "CASE table_id % 4 " + " ".join(f"WHEN {k} THEN {h}" for k, h in enumerate(HEADERS)) + " END"
_G = f"""WITH r AS (SELECT *, [symbol, '', min_text, typ_text, max_text, unit_text, condition_text] AS cells FROM {{fx_tables}}),
g AS (SELECT table_id, document_id, page, {_HEAD} AS header, list(cells ORDER BY row_no) AS body FROM r GROUP BY table_id, document_id, page),
s AS (SELECT *, flatten(list_prepend(header, body)) AS flat, len(body) + 1 AS rc FROM g),
c AS (SELECT *, len(list_filter(flat, lambda x: x = '')) AS ec FROM s),
b AS (SELECT *, 0.75 * (1 - CAST(ec AS DOUBLE) / (rc * 7) * 0.5) AS conf FROM c),
k AS (SELECT *, CASE table_id % 4 WHEN 0 THEN 'package_dimensions' WHEN 1 THEN 'pin_configuration' WHEN 2 THEN 'electrical_characteristics' ELSE 'absolute_maximum' END AS table_type,
  CASE table_id % 4 WHEN 0 THEN 'parameter:symbol,parameter:parameter,value:min,value:typ,value:max,unit:unit,condition:condition' WHEN 1 THEN 'parameter:symbol,description:description,value:min,value:min,value:max,unit:unit,condition:note'
    WHEN 2 THEN 'parameter:param,parameter:characteristic,value:min,value:max,unit:unit' ELSE 'value:max' END AS kw, CASE WHEN table_id % 4 = 0 THEN least(conf, 0.3) ELSE conf END AS conf2 FROM b),
q AS (SELECT *, least((1 - CAST(ec AS DOUBLE) / (rc * 7)) * 0.4 + 0.3 + least(conf2 + 0.05, 1.0) * 0.2 + 0.1, 1.0) AS quality FROM k)
"""
_R6 = lambda c, n=None: f"round({c} + 3e-10, 6) + 0.0 AS {n or c}"
_ROLES = {0: (0, 2, 3, 4, 5, 6), 1: (0, 2, 3, 4, 5, 6), 2: (0, 2, 3, 4, 5, 6), 3: (None, None, None, 0, None, None)}
_NUM = lambda c: f"TRY_CAST(trim(split_part(regexp_replace(trim({c}), '(?i)\\s*[VmAµuμnpkMGHz°CF%Ωs]+$', ''), ' to ', 1)) AS DOUBLE)"
_RANGE = "CASE param " + " ".join(f"WHEN '{p}' THEN value BETWEEN {a} AND {b}" for p, (a, b) in T.RANGES.items()) + " ELSE value IS NOT NULL END"

def _scan() -> str:
    """The scan of flattened tables as SQL: numbers in range for each anchor, then the first anchor that has some."""
    tries = []
    for p, (anchors, before, after, inner, low, high, signed, slots, unit) in values.TABLE_SCAN.items():
        number = "'([+-]?[0-9]+[.]?[0-9]*)'" if signed else "'([0-9]+[.]?[0-9]*)'"
        size = "abs(v)" if p == "IOH" else "v"
        for k, anchor in enumerate(anchors):
            window = f"substring(t, greatest(instr(u, '{anchor}') - {before}, 1), instr(u, '{anchor}') + {after} - greatest(instr(u, '{anchor}') - {before}, 1))"
            if inner:
                mark, left, right = inner
                at = f"instr(upper({window}), '{mark}')"
                window = f"CASE WHEN {at} > 0 THEN substring({window}, greatest({at} - {left}, 1), {at} + {right} - greatest({at} - {left}, 1)) END"
            good = f"list_filter(list_transform(regexp_extract_all({window}, {number}, 1), lambda x: TRY_CAST(x AS DOUBLE)), lambda v: {size} BETWEEN {low} AND {high})"
            tries.append(f"SELECT table_id, '{p}' AS param, {k} AS k, {good} AS g, '{unit}' AS unit FROM ct WHERE instr(u, '{anchor}') > 0 AND (contains(u, '{p}') OR contains(u, 'HIGH') OR contains(u, 'LOW'))")
    return _G + f""", ct AS (SELECT table_id, regexp_replace(array_to_string(list_filter(flatten(list_prepend(header, body)), lambda x: x <> ''), ' '), '\\s+', ' ', 'g') AS t, upper(t) AS u FROM g),
sn AS ({" UNION ALL ".join(tries)}), fn AS (SELECT *, row_number() OVER (PARTITION BY table_id, param ORDER BY k) AS n FROM sn WHERE len(g) > 0)
SELECT table_id, param, CASE WHEN param = 'IOH' THEN -abs(g[1]) WHEN param IN ('VOH', 'VIH', 'IOL', 'IIH', 'IIL') THEN g[1] END AS min_value, CASE param WHEN 'VOH' THEN g[2] WHEN 'VOL' THEN g[1] END AS typ_value,
  CASE param WHEN 'VOL' THEN coalesce(g[2], g[1]) WHEN 'VIL' THEN g[1] END AS max_value, unit, CAST(0.85 AS DOUBLE) AS confidence FROM fn WHERE n = 1"""


SQL = {
    "sc3_stored_tables": _G + "SELECT table_id, CAST(rc AS INTEGER) AS row_count, 7 AS column_count, CAST(ec AS INTEGER) AS empty_cells, array_to_string(list_filter(flat, lambda x: x <> ''), ' ') AS content FROM c",
    "sc4_tables_by_document": _G + f"SELECT table_id, document_id, page, {_R6('conf', 'confidence')} FROM b WHERE round(conf + 3e-10, 6) >= 0.65 ORDER BY page, table_id LIMIT 100",
    "tb1_confidence": _G + f"SELECT table_id, {_R6('conf', 'confidence')} FROM b",
    "tb2_table_type": _G + f"SELECT table_id, table_type, {_R6('conf2', 'confidence')} FROM k",
    "tb3_header_keywords": _G + "SELECT table_id, kw AS header_keywords FROM k",
    "tb4_quality": _G + f"SELECT table_id, {_R6('quality', 'confidence')} FROM q",
    "tb5_cross_page": _G + f""", l AS (SELECT table_id, document_id, page, list_distinct(list_transform(header, lambda h: lower(h))) AS h, rc, quality FROM q), pr AS (SELECT a.table_id, min(o.table_id) AS anchor FROM l a JOIN l o ON o.document_id = a.document_id AND o.table_id < a.table_id AND abs(a.page - o.page) = 1
  WHERE CAST(len(list_intersect(a.h, o.h)) AS DOUBLE) / len(list_distinct(a.h || o.h)) > 0.7 GROUP BY a.table_id), st AS (SELECT * FROM pr WHERE anchor NOT IN (SELECT table_id FROM pr)),
d AS (SELECT l.*, coalesce(anchor, l.table_id) AS gid FROM l LEFT JOIN st ON st.table_id = l.table_id)
SELECT gid AS table_id, document_id, min(page) AS page, CAST(sum(rc - 1) + 1 AS INTEGER) AS row_count, count(*) AS n_tables, count(*) > 1 AS is_cross_page, {_R6('max(quality)', 'confidence')} FROM d GROUP BY gid, document_id""",
    "tb6_pin_gaps": "WITH p AS (SELECT table_id, row_no * CASE WHEN table_id % 2 = 0 THEN 2 ELSE 1 END AS pin FROM {fx_tables}), g AS (SELECT table_id, CASE WHEN pin - lag(pin) OVER (PARTITION BY table_id ORDER BY pin) > 1 THEN 1 ELSE 0 END AS gap FROM p) SELECT table_id, round(0.8 * (1 - CAST(sum(gap) AS DOUBLE) / count(*) * 0.5) + 3e-10, 6) + 0.0 AS confidence FROM g GROUP BY table_id",
    "tb7_dedupe": _G + ", d AS (SELECT table_id, document_id % 20 AS document_id, page, row_number() OVER (PARTITION BY document_id % 20, page, rc, header[1:2], body[-1][1:2] ORDER BY table_id) AS n FROM c) SELECT table_id, document_id, page FROM d WHERE n = 1",
    "tb8_column_roles": "SELECT DISTINCT table_id, " + ", ".join("CASE table_id % 4 " + " ".join(f"WHEN {k} THEN {'NULL' if v[i] is None else v[i]}" for k, v in _ROLES.items()) + f" END AS {n}_col" for i, n in enumerate(("symbol", "min", "typ", "max", "unit", "cond"))) + " FROM {fx_tables}",
    "tb9_header_row": "SELECT DISTINCT table_id, 0 AS row_no FROM {fx_tables} WHERE table_id % 4 <> 3",
    "tb11_numbers": f"SELECT table_id, row_no, {_NUM('min_text')} AS lo, CASE WHEN typ_text = '-' THEN NULL ELSE {_NUM('typ_text')} END AS typ, {_NUM('max_text')} AS hi FROM {{fx_tables}}",
    "tb10_tb12_specs": f"""WITH n AS (SELECT table_id, row_no, replace(symbol, '_', '') AS param, {_NUM('min_text')} AS lo, CASE WHEN typ_text = '-' THEN NULL ELSE {_NUM('typ_text')} END AS typ, {_NUM('max_text')} AS hi, unit_text, condition_text FROM {{fx_tables}} WHERE table_id % 4 <> 3),
v AS (SELECT *, CASE WHEN param IN ('VOH', 'VIH', 'IOH') THEN coalesce(lo, typ, hi) WHEN param IN ('VOL', 'VIL', 'IOL') THEN coalesce(hi, typ, lo) ELSE coalesce(typ, hi, lo) END AS value FROM n),
w AS (SELECT *, row_number() OVER (PARTITION BY table_id, param ORDER BY row_no) AS k FROM v WHERE {_RANGE}) SELECT table_id, param, lo AS min_value, value, hi AS max_value, unit_text AS unit, condition_text AS condition, CAST(0.93 AS DOUBLE) AS confidence FROM w WHERE k = 1""",
    "tb13_text_scan": _scan(),
    "tb14_row_answer": """WITH t AS (SELECT *, dense_rank() OVER (PARTITION BY document_id ORDER BY page, table_id) AS tn FROM {fx_tables}),
h AS (SELECT document_id AS query_id, table_id, row_no, row_number() OVER (PARTITION BY document_id ORDER BY tn, row_no) AS k FROM t WHERE tn <= 10 AND symbol = 'VIH') SELECT query_id, table_id, row_no FROM h WHERE k = 1""",
    "pf6_range_check": f"SELECT param_name, count(*) AS n, count(*) FILTER ({_RANGE.replace('CASE param ', 'CASE param_name ').replace('value', 'param_value')}) AS n_valid FROM {{fx_parameters}} GROUP BY param_name",
    "pf10_table_text": _G + """, l AS (SELECT table_id, array_to_string(list_filter(list_transform(list_prepend(header, body), lambda r: array_to_string(list_filter(r, lambda x: x <> ''), ' | ')), lambda x: x <> ''), chr(10)) AS text, header FROM g)
SELECT table_id, concat(array_to_string(header[1:6], ' | '), ' ...') AS title, md5(text) AS text_key FROM l""",
}
