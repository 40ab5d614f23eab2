"""Queries over chips, parameters and the document catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetmill.functions import dicts
from sheetmill.operators import knowledge as K
from sheetmill.operators import maintenance as M
from sheetmill.plans.fixtures import read

REQUIRED = ["VOH", "VOL", "VIH", "VIL", "IOH", "IOL", "VCC"]


def _r(df, *names):
    return df.withColumns({n: F.round(F.col(n) + 3e-10, 6) + 0.0 for n in names})


def _params(spark, sf_dir):
    return read(spark, sf_dir, "fx_parameters")


def jn1(spark, sf_dir):
    return K.chip_parameters(read(spark, sf_dir, "fx_chips").where("name like 'SN74%'"), _params(spark, sf_dir), 0.55).select("chip_id", "name", "param_id", "param_value", "confidence")


def jn3(spark, sf_dir):
    return K.found_chips(read(spark, sf_dir, "fx_names"), read(spark, sf_dir, "fx_chips"))


def jn4(spark, sf_dir):
    c = read(spark, sf_dir, "fx_chips")
    library = c.where("pin_count = 8").select(K.normalised_name(F.col("name")).alias("canonical"), F.lit(0).alias("position")).distinct()
    aliases = c.where("pin_count = 12").select(K.normalised_name(F.col("name")).alias("alias"), F.lit("74HC0000").alias("canonical")).distinct()
    return K.resolved_names(read(spark, sf_dir, "fx_names"), library, aliases)


def jn10(spark, sf_dir):
    asked = spark.createDataFrame([("VDD",), ("VOH",), ("fmax",)], "param string")
    return K.by_alternates(asked, _params(spark, sf_dir))


def kg1(spark, sf_dir):
    return K.best_values(_params(spark, sf_dir)).select("chip_id", "param_name", "param_id", "param_value", "confidence")


def kg2(spark, sf_dir):
    return read(spark, sf_dir, "fx_names").select("query_id", K.normalised_name(F.col("name")).alias("norm"))


def kg3(spark, sf_dir):
    return read(spark, sf_dir, "fx_chips").select("chip_id", K.process_of_family(F.col("name")).alias("process"))


def pf7(spark, sf_dir):
    return _r(K.sane_values(_params(spark, sf_dir)).select("chip_id", "param_id", "param_name", "param_value"), "param_value")


def kg4(spark, sf_dir):
    doc, kb = read(spark, sf_dir, "fx_doc_values"), read(spark, sf_dir, "fx_kb")
    return _r(K.staged_merge([doc.select("chip_id", "param_name", F.col("doc_value").alias("value")), kb.select("chip_id", "param_name", F.col("kb_value").alias("value"))], 3), "value")


def kg5(spark, sf_dir):
    return _r(K.checked_merge(read(spark, sf_dir, "fx_doc_values"), read(spark, sf_dir, "fx_kb")), "value")


def kg6(spark, sf_dir):
    j = read(spark, sf_dir, "fx_doc_values").join(read(spark, sf_dir, "fx_kb"), ["chip_id", "param_name"])
    none = F.lit(None).cast("string")
    return j.groupBy("param_name").agg(F.count("*").alias("n"), F.count_if(K.suspicious(F.col("param_name"), F.col("doc_value"), none, F.col("kb_value"), F.lit("mA"))).alias("n_suspicious"))


def kg8(spark, sf_dir):
    return _r(K.completeness(read(spark, sf_dir, "fx_chips"), K.best_values(_params(spark, sf_dir)), REQUIRED), "ratio", "confidence")


def kg14(spark, sf_dir):
    c = read(spark, sf_dir, "fx_chips")
    extracted = F.when(F.col("pin_count") > 16, F.concat(F.lit("QFP-"), F.col("pin_count")))
    return c.select("chip_id", F.coalesce(F.lit(None).cast("string"), extracted, "package", F.lit("DIP")).alias("package"))


def sc8(spark, sf_dir):
    p = _params(spark, sf_dir).groupBy("chip_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("param_name", F.lit(1.5).alias("v"))))).alias("parameters"))
    c = read(spark, sf_dir, "fx_chips").join(p, "chip_id").select(F.col("chip_id").alias("name"), F.col("name").alias("family"), F.lit(None).cast("string").alias("process"), F.transform(F.sequence(F.lit(1), F.col("pin_count")), lambda i: F.struct(i.alias("pin_number"), F.concat(F.lit("P"), i).alias("pin_name"))).alias("pins"), "parameters", F.lit(1).alias("record"))
    chips, pins, params = K.flattened_chips(c)
    return chips.join(pins.groupBy("chip_id").agg(F.max("pin_number").alias("last_pin")), "chip_id").join(params.groupBy("chip_id").agg(F.count("*").alias("n_params"), F.min("param_id").alias("first_param")), "chip_id").select("chip_id", "process", "pin_count", "last_pin", "n_params", "first_param")


def sc9(spark, sf_dir):
    return K.row_counts(chips=read(spark, sf_dir, "fx_chips"), parameters=_params(spark, sf_dir))


def sc10(spark, sf_dir):
    return M.catalogue(read(spark, sf_dir, "fx_catalogue"), F.col("status") == "error").select("document_id", "entry", "status", "progress")


def st2(spark, sf_dir):
    return M.latest(read(spark, sf_dir, "fx_catalogue")).select("document_id", "entry", "status", "progress")


def st3(spark, sf_dir):
    e = read(spark, sf_dir, "fx_catalogue")
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp"), F.col("ts").cast("timestamp"))
    return M.kept_within_ttl(e.select("document_id", "entry", at.alias("at")), "document_id", 3600 * 24)


def sc13(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.concat("source", F.lit("_p1_c"), F.col("doc_id")).alias("chunk_id"), "doc_id")
    return M.without_documents(docs, docs.where("doc_id % 50 = 7").select("document_id")).select("document_id", "doc_id")


def sc3(spark, sf_dir):
    c = read(spark, sf_dir, "fx_catalogue").withColumn("bucket", F.col("document_id") % 50)
    old, new = c.where("entry % 2 = 0"), c.where("entry % 7 = 1 and document_id % 3 = 0")
    return M.upserted(old.select("document_id", "entry"), new.select("document_id", "entry"), "document_id")


def sc12(spark, sf_dir):
    f = read(spark, sf_dir, "fx_figures").select("image_id", "document_id", "types", "parts")
    new = f.where("image_id % 3 = 0").select("image_id", "document_id", F.lit("updated").alias("types"), F.when(F.col("image_id") % 2 == 0, "r9").alias("parts"))
    return M.page_update(f, new, ["image_id", "document_id"], ["types", "parts"])


def mt1(spark, sf_dir):
    """Catalogue entries of documents without a file; the files of every ninth document are taken away."""
    return M.orphans(read(spark, sf_dir, "fx_catalogue").select("document_id", "entry"), read(spark, sf_dir, "fx_files").where("document_id % 9 <> 0"))


def mt2(spark, sf_dir):
    return M.older_versions(read(spark, sf_dir, "fx_files"), "filename", 1, F.desc("upload_time"), F.desc("entry")).select("filename", "entry", "version")


def mt3(spark, sf_dir):
    files = read(spark, sf_dir, "fx_files").select(F.concat("document_id", F.lit("_"), "filename").alias("name"))
    return M.orphan_uploads(files, read(spark, sf_dir, "fx_catalogue")).groupBy("document_id").agg(F.count("*").alias("n"))


def mt4(spark, sf_dir):
    t = read(spark, sf_dir, "fx_tables").select("document_id")
    d = read(spark, sf_dir, "fx_files").select("document_id")
    f = read(spark, sf_dir, "fx_figures").select("document_id")
    gone = read(spark, sf_dir, "fx_catalogue").where("status = 'error'")
    return M.deletion_counts({"tables": t, "files": d, "figures": f}, gone)


def mt5(spark, sf_dir):
    return M.older_versions(read(spark, sf_dir, "fx_catalogue"), "document_id", 5, F.desc("ts"), F.desc("entry")).groupBy("document_id").agg(F.count("*").alias("stale"), F.max("entry").alias("newest_stale"))


def mt6(spark, sf_dir):
    return M.status_summary(read(spark, sf_dir, "fx_catalogue"), "purchase", ["view", "click", "signup"], "error")


def mt6_report(spark, sf_dir):
    return M.status_report(M.latest(read(spark, sf_dir, "fx_catalogue")))


QUERIES = {
    "jn1_chip_parameters": jn1, "jn3_fallback_lookup": jn3, "jn4_alias_resolution": jn4, "jn10_alternate_names": jn10, "kg1_best_value": kg1, "kg2_part_numbers": kg2, "kg3_process": kg3, "kg4_staged_merge": kg4,
    "kg5_checked_merge": kg5, "kg6_suspicion": kg6, "kg8_completeness": kg8, "kg14_package": kg14, "pf7_sane_values": pf7, "sc3_upsert": sc3, "sc8_nested_chips": sc8, "sc9_row_counts": sc9, "sc10_catalogue": sc10,
    "sc12_page_update": sc12, "sc13_delete_documents": sc13, "st2_latest_status": st2, "st3_ttl": st3, "mt1_jn12_orphans": mt1, "mt2_duplicates": mt2, "mt3_orphan_uploads": mt3, "mt4_cascade_counts": mt4,
    "mt5_retention": mt5, "mt6_summary": mt6, "mt6_report": mt6_report,
}

_PFX = "|".join(sorted(K.PREFIXES, key=len, reverse=True))
_NORM = lambda c: f"regexp_replace(upper(trim({c})), '^(?:{_PFX})([0-9])', '\\1')"
_LAST = "SELECT document_id, entry, status, progress FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, entry DESC) AS n FROM {fx_catalogue}) WHERE n = 1"
_MA = lambda v: f"CASE WHEN abs({v}) > 0.5 THEN {v} WHEN abs({v}) > 0.001 THEN {v} * 1000 ELSE {v} * 1000000 END"


def _suspicious(kb: str) -> str:
    volts = " ".join(f"WHEN '{n}' THEN doc_value < {a} OR doc_value > {b} OR abs(doc_value - kb_value) > {c}" for n, (a, b, c) in K.VOLTAGE_BOUNDS.items())
    d = _MA("doc_value")
    off = f"coalesce({d} <> 0 AND (abs({d}) / nullif(abs({kb}), 0) > 10 OR abs({d}) / nullif(abs({kb}), 0) < 0.1), FALSE)"
    return f"CASE param_name {volts} WHEN 'IOH' THEN abs({d}) > 1000 OR abs({d}) < 0.1 OR {off} WHEN 'IOL' THEN abs({d}) > 1000 OR abs({d}) < 0.1 OR {off} ELSE abs(doc_value - kb_value) > greatest(abs(kb_value) * 0.1, 0.0001) END"


_R6 = lambda c, n=None: f"round({c} + 3e-10, 6) + 0.0 AS {n or c}"
_BEST = "SELECT chip_id, param_name, param_id, param_value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY chip_id, param_name ORDER BY confidence DESC, param_id) AS n FROM {fx_parameters}) WHERE n = 1"
_FAM = " ".join(f"WHEN {' OR '.join(f'contains(upper(name), {chr(39)}{m}{chr(39)})' for m in marks)} THEN '{p}'" for p, marks in K.PROCESS_FAMILIES)
_FAM_ID = _FAM.replace("upper(name)", "upper(name)")

#: Of each document the first entry, and then the first that is a day or more behind the last one taken.
TTL = """WITH RECURSIVE e AS MATERIALIZED (SELECT document_id, entry, CAST(date_diff('second', TIMESTAMP '1970-01-01', CAST(ts AS TIMESTAMP)) AS BIGINT) AS sec FROM {fx_catalogue}),
k(document_id, sec, entry) AS (
  SELECT document_id, best.sec, best.entry FROM (SELECT document_id, min(struct_pack(sec := sec, entry := entry)) AS best FROM e GROUP BY document_id)
  UNION ALL
  SELECT document_id, best.sec, best.entry FROM (SELECT k.document_id, min(struct_pack(sec := e.sec, entry := e.entry)) AS best FROM k JOIN e ON e.document_id = k.document_id AND e.sec - k.sec >= 86400 GROUP BY k.document_id, k.sec, k.entry))
SELECT document_id, sec AS "at", entry FROM k"""

SQL = {
    "st3_ttl": TTL,
    "jn1_chip_parameters": "SELECT c.chip_id, name, param_id, param_value, confidence FROM {fx_chips} c JOIN {fx_parameters} p ON p.chip_id = c.chip_id WHERE name LIKE 'SN74%' AND confidence >= 0.55",
    "jn3_fallback_lookup": f"""WITH q AS (SELECT query_id, name, {_NORM('name')} AS norm FROM {{fx_names}}), e AS (SELECT query_id, chip_id, 1 AS level FROM q JOIN {{fx_chips}} c ON c.name = q.name),
l AS (SELECT query_id, chip_id, CASE WHEN c.name = norm OR contains(lower(c.name), lower(norm)) OR full_name = q.name OR contains(lower(full_name), lower(q.name)) THEN 2 WHEN norm LIKE '74%' AND contains(lower(full_name), lower(norm)) THEN 3 END AS level FROM q, {{fx_chips}} c WHERE query_id NOT IN (SELECT query_id FROM e)),
m AS (SELECT *, min(level) OVER (PARTITION BY query_id) AS b FROM l WHERE level IS NOT NULL) SELECT * FROM e UNION ALL SELECT query_id, chip_id, level FROM m WHERE level = b""",
    "jn4_alias_resolution": f"""WITH q AS (SELECT query_id, {_NORM('name')} AS norm FROM {{fx_names}}), lib AS (SELECT DISTINCT {_NORM('name')} AS canonical FROM {{fx_chips}} WHERE pin_count = 8), al AS (SELECT DISTINCT {_NORM('name')} AS alias FROM {{fx_chips}} WHERE pin_count = 12),
u AS (SELECT query_id, canonical, 1 AS level FROM q JOIN lib ON canonical = norm UNION ALL SELECT query_id, '74HC0000', 2 FROM q JOIN al ON alias = norm UNION ALL SELECT query_id, canonical, 3 FROM q, lib WHERE length(regexp_replace(canonical, '[0-9]+$', '')) > 0 AND starts_with(norm, regexp_replace(canonical, '[0-9]+$', '')))
SELECT query_id, canonical, level FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level, canonical) AS n FROM u) WHERE n = 1""",
    "jn10_alternate_names": f"""WITH t AS (SELECT * FROM {dicts.values_sql([(p, n, k) for p, ns in K.ALTERNATES.items() for k, n in enumerate(ns)], 't(param, param_name, prio)')} WHERE param IN ('VDD', 'VOH', 'fmax')),
j AS (SELECT chip_id, param, param_value, prio, row_number() OVER (PARTITION BY chip_id, param ORDER BY prio, param_id) AS n FROM t JOIN {{fx_parameters}} p ON p.param_name = t.param_name) SELECT chip_id, param, param_value AS value, prio FROM j WHERE n = 1""",
    "kg1_best_value": _BEST,
    "kg2_part_numbers": f"SELECT query_id, {_NORM('name')} AS norm FROM {{fx_names}}",
    "kg3_process": f"SELECT chip_id, CASE {_FAM} ELSE 'CMOS' END AS process FROM {{fx_chips}}",
    "pf7_sane_values": f"SELECT chip_id, param_id, param_name, {_R6('''CASE param_name WHEN 'IOH' THEN -abs(param_value) WHEN 'IOL' THEN abs(param_value) ELSE param_value END''', 'param_value')} FROM {{fx_parameters}} WHERE NOT (param_name IN ('VOH', 'VIH') AND param_value < 0.5) AND NOT (param_name IN ('VOL', 'VIL') AND param_value > 5)",
    "kg4_staged_merge": f"""WITH u AS (SELECT chip_id, param_name, doc_value AS value, 0 AS stage FROM {{fx_doc_values}} UNION ALL SELECT chip_id, param_name, kb_value, 1 FROM {{fx_kb}}), c AS (SELECT *, count(*) FILTER (stage = 0) OVER (PARTITION BY chip_id) AS have FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY chip_id, param_name ORDER BY stage, value) AS n FROM c WHERE stage = 0 OR have < 3) SELECT chip_id, param_name, {_R6('value')}, stage FROM r WHERE n = 1""",
    "kg5_checked_merge": f"""WITH j AS (SELECT coalesce(d.chip_id, k.chip_id) AS chip_id, coalesce(d.param_name, k.param_name) AS param_name, doc_value, kb_value FROM {{fx_doc_values}} d FULL OUTER JOIN {{fx_kb}} k ON k.chip_id = d.chip_id AND k.param_name = d.param_name),
u AS (SELECT *, doc_value IS NULL OR (coalesce({_suspicious(_MA('kb_value'))}, FALSE) AND kb_value IS NOT NULL) AS use_kb FROM j) SELECT chip_id, param_name, {_R6('CASE WHEN use_kb THEN kb_value ELSE doc_value END', 'value')}, CASE WHEN use_kb THEN 'knowledge_graph' ELSE 'document' END AS origin FROM u""",
    "kg6_suspicion": f"SELECT d.param_name, count(*) AS n, count(*) FILTER ({_suspicious('kb_value').replace('CASE param_name', 'CASE d.param_name')}) AS n_suspicious FROM {{fx_doc_values}} d JOIN {{fx_kb}} k ON k.chip_id = d.chip_id AND k.param_name = d.param_name GROUP BY d.param_name",
    "kg8_completeness": f"""WITH b AS ({_BEST}), n AS (SELECT chip_id, unnest({REQUIRED}) AS param_name FROM {{fx_chips}}), j AS (SELECT n.chip_id, n.param_name, param_value, confidence FROM n LEFT JOIN b ON b.chip_id = n.chip_id AND b.param_name = n.param_name)
SELECT chip_id, coalesce(string_agg(param_name, ',' ORDER BY param_name) FILTER (param_value IS NOT NULL), '') AS available, coalesce(string_agg(param_name, ',' ORDER BY param_name) FILTER (param_value IS NULL), '') AS missing, {_R6('CAST(count(param_value) AS DOUBLE) / count(*)', 'ratio')}, {_R6('avg(confidence)', 'confidence')} FROM j GROUP BY chip_id""",
    "kg14_package": "SELECT chip_id, CASE WHEN pin_count > 16 THEN concat('QFP-', pin_count) ELSE coalesce(package, 'DIP') END AS package FROM {fx_chips}",
    "sc3_upsert": "WITH n AS (SELECT document_id, entry FROM {fx_catalogue} WHERE entry % 7 = 1 AND document_id % 3 = 0) SELECT * FROM n UNION ALL SELECT document_id, entry FROM {fx_catalogue} WHERE entry % 2 = 0 AND document_id NOT IN (SELECT document_id FROM n)",
    "sc8_nested_chips": f"""WITH p AS (SELECT chip_id, count(DISTINCT param_name) AS n_params, min(concat(chip_id, '_', param_name)) AS first_param FROM {{fx_parameters}} GROUP BY chip_id)
SELECT c.chip_id, CASE {_FAM} ELSE 'CMOS' END AS process, pin_count, pin_count AS last_pin, n_params, first_param FROM {{fx_chips}} c JOIN p ON p.chip_id = c.chip_id""",
    "sc9_row_counts": "SELECT 'chips' AS table_name, count(*) AS n FROM {fx_chips} UNION ALL SELECT 'parameters', count(*) FROM {fx_parameters}",
    "sc10_catalogue": f"SELECT * FROM ({_LAST}) WHERE status <> 'error'",
    "st2_latest_status": _LAST,
    "sc12_page_update": "SELECT image_id, document_id, CASE WHEN image_id % 3 = 0 THEN 'updated' ELSE types END AS types, CASE WHEN image_id % 6 = 0 THEN 'r9' ELSE parts END AS parts FROM {fx_figures}",
    "sc13_delete_documents": "SELECT source AS document_id, doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 7)",
    "mt1_jn12_orphans": "SELECT document_id, entry FROM {fx_catalogue} WHERE document_id NOT IN (SELECT document_id FROM {fx_files} WHERE document_id % 9 <> 0)",
    "mt2_duplicates": "SELECT filename, entry, version FROM (SELECT filename, entry, CAST(row_number() OVER (PARTITION BY filename ORDER BY upload_time DESC, entry DESC) AS INTEGER) AS version FROM {fx_files}) WHERE version > 1",
    "mt3_orphan_uploads": "SELECT CAST(document_id AS VARCHAR) AS document_id, count(*) AS n FROM {fx_files} WHERE document_id NOT IN (SELECT document_id FROM {fx_catalogue}) GROUP BY document_id",
    "mt4_cascade_counts": "WITH g AS (SELECT DISTINCT document_id FROM {fx_catalogue} WHERE status = 'error'), u AS (SELECT 'tables' AS store FROM {fx_tables} WHERE document_id IN (SELECT document_id FROM g) UNION ALL SELECT 'files' FROM {fx_files} WHERE document_id IN (SELECT document_id FROM g) UNION ALL SELECT 'figures' FROM {fx_figures} WHERE document_id IN (SELECT document_id FROM g)) SELECT coalesce(store, 'all') AS store, count(*) AS deleted FROM u GROUP BY ROLLUP (store)",
    "mt5_retention": "SELECT document_id, count(*) AS stale, max(entry) AS newest_stale FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, entry DESC) AS n FROM {fx_catalogue}) WHERE n > 5 GROUP BY document_id",
    "mt6_summary": "SELECT count(*) AS total, count(*) FILTER (status = 'purchase') AS ready, count(*) FILTER (status IN ('view', 'click', 'signup')) AS in_progress, count(*) FILTER (status = 'error') AS error FROM {fx_catalogue}",
    "mt6_report": f"SELECT coalesce(status, 'all') AS status, count(*) AS n FROM ({_LAST}) GROUP BY ROLLUP (status)",
}
