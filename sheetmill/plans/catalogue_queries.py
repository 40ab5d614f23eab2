"""Queries over whole documents: profiles, indexing, device search, displays."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetmill.functions import units
from sheetmill.operators import extraction, maintenance, text
from sheetmill.plans.fixtures import read

# Words of queries and what file names call them.
DEVICE_WORDS = [("放大器", "ne55"), ("运放", "lm3"), ("sheet one", "sheet1_"), ("amplifier", "ne5532")]


def tx19(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    pages = d.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"), (F.col("doc_id") % 3 == 0).alias("regions"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("document_id"), F.lit(1).alias("page"), F.when(F.col("l_linenumber") % 2 == 0, "h").otherwise("v").alias("direction"))
    p = text.page_profile(lines, pages)
    return p.select("document_id", "borders", (F.round(F.col("density") + 3e-10, 6) + 0.0).alias("density"), "page_type", "strategy")


def pf4(spark, sf_dir):
    devices = read(spark, sf_dir, "fx_figures").select("document_id", "filename").distinct()
    q = read(spark, sf_dir, "fx_queries").select("query_id", F.when(F.col("query_id") % 4 == 0, "SHEET12").when(F.col("query_id") % 4 == 1, "放大器").when(F.col("query_id") % 4 == 2, "sheet one please").otherwise("nothing").alias("query"))
    return maintenance.device_search(q, devices, spark.createDataFrame(DEVICE_WORDS, "word string, english string"))


def kg13(spark, sf_dir):
    r = read(spark, sf_dir, "fx_receiver")
    return r.select("receiver", units.display_current(F.col("iih"), F.col("iih_unit")).alias("iih"), units.display_current(F.col("iil"), F.col("iil_unit")).alias("iil"))


def ex14(spark, sf_dir):
    c = read(spark, sf_dir, "fx_chips").select(F.col("chip_id").alias("query_id"), "pin_count")
    pins = c.select("query_id", F.explode(F.array(F.lit("VCC"), F.lit("GND"))).alias("name"))
    cites = c.select("query_id", F.inline(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(i.alias("rank"), F.lit("a.pdf").alias("file"), (i % 3).cast("int").alias("page"), F.when((i % 2 == 0) & (F.col("pin_count") % 3 == 0), "pin vcc here").otherwise("nothing").alias("snippet")))))
    return extraction.cited(cites, pins).select("query_id", "rank", "page")


QUERIES = {"tx19_page_profile": tx19, "pf4_device_search": pf4, "kg13_display": kg13, "ex14_citation_filter": ex14}

_ANY = lambda t, ws: "(" + " OR ".join(f"contains({t}, '{w}')" for w in ws) + ")"

SQL = {
    "tx19_page_profile": f"""WITH b AS (SELECT l_orderkey AS document_id, count(*) FILTER (l_linenumber % 2 = 0) >= 3 AND count(*) FILTER (l_linenumber % 2 <> 0) >= 3 AS borders FROM lineitem GROUP BY l_orderkey),
p AS (SELECT doc_id AS document_id, text, lower(text) AS t, coalesce(borders, FALSE) AS borders, doc_id % 3 = 0 AS regions, CAST(length(text) AS DOUBLE) / 480000 AS density FROM documents LEFT JOIN b ON b.document_id = doc_id),
k AS (SELECT *, CASE WHEN {_ANY('t', text.COVER_WORDS)} AND length(text) < 500 THEN 'cover' WHEN contains(t, 'contents') THEN 'toc' WHEN {_ANY('t', text.TIMING_WORDS)} THEN 'timing_diagram' WHEN (borders OR regions) AND {_ANY('t', text.PARAMETER_WORDS)} THEN 'parameter_table' WHEN (borders OR regions) AND {_ANY('t', text.PIN_WORDS)} THEN 'pin_table' ELSE 'text_only' END AS page_type FROM p)
SELECT document_id, borders, round(density + 3e-10, 6) + 0.0 AS density, page_type, CASE WHEN page_type IN ('toc', 'cover', 'text_only', 'timing_diagram') THEN 'skip' WHEN borders AND regions THEN 'lattice' WHEN regions AND density > 0.0005 THEN 'stream' WHEN borders THEN 'lattice' ELSE 'stream' END AS strategy FROM k""",
    "kg13_display": "WITH a AS (SELECT receiver, abs(iih / 1000000) AS h, abs(iil / 1000000) AS l FROM {fx_receiver}), f AS (SELECT receiver, CASE WHEN h >= 1 THEN printf('%.3fA', h) WHEN h >= 0.001 THEN printf('%.3fmA', h * 1000) ELSE printf('%.3fuA', h * 1000000) END AS iih, CASE WHEN l >= 1 THEN printf('%.3fA', l) WHEN l >= 0.001 THEN printf('%.3fmA', l * 1000) ELSE printf('%.3fuA', l * 1000000) END AS iil FROM a) SELECT * FROM f",
    "pf4_device_search": """WITH d AS (SELECT DISTINCT document_id, filename FROM {fx_figures}), q AS (SELECT query_id FROM {fx_queries})
SELECT query_id, document_id FROM q, d WHERE query_id % 4 = 0 AND contains(filename, 'sheet12') UNION ALL SELECT query_id, document_id FROM q, d WHERE query_id % 4 = 1 AND contains(filename, 'ne55')
UNION ALL SELECT query_id, document_id FROM q, d WHERE query_id % 4 = 2 AND contains(filename, 'sheet1_')""",
    "ex14_citation_filter": """WITH c AS (SELECT chip_id AS query_id, pin_count, unnest([1, 2, 3, 4]) AS rank FROM {fx_chips}), x AS (SELECT query_id, rank, rank % 3 AS page FROM c WHERE pin_count % 3 <> 0 OR rank % 2 = 0)
SELECT query_id, rank, page FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page ORDER BY rank) AS n FROM x) WHERE n = 1""",
}
