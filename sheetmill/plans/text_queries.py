"""Queries over documents, pages and conversations as texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sheetmill.functions import dicts, values
from sheetmill.functions.values import CAPTION_CLASS_WORDS, CIRCUIT_WORDS
from sheetmill.operators import text as T
from sheetmill.operators.tagging import tagger
from sheetmill.plans.fixtures import read
from sheetmill.plans.sql_parts import COLLAPSED, SENTENCES, chunks


def pages(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text", (F.col("n_chars") < 100).alias("has_error"), "source")


def sc1(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("document_id", F.concat("source", F.lit("-"), F.floor(F.col("document_id") / 100)))
    return T.page_status(p)


def sc2(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    items = T.markup_items(p).groupBy("page_id").agg(F.count("*").alias("n_items"), F.max("item").alias("last_item"))
    return p.select("page_id", F.length(T.markup_text(F.col("html"))).alias("text_length")).join(items, "page_id", "left")


def tx1(spark, sf_dir):
    return T.sentences(pages(spark, sf_dir)).groupBy("document_id").agg(F.count("*").alias("n_sentences"), F.max("end").alias("last_end"), F.sum(F.length("sentence")).alias("signs"))


def tx2(spark, sf_dir):
    return T.numbered(T.packed_chunks(pages(spark, sf_dir))).select("document_id", "chunk_id", F.length("chunk").alias("size"))


def tx3(spark, sf_dir):
    return T.windows_of(pages(spark, sf_dir)).select("document_id", "pos", "start", F.md5("chunk").alias("chunk_key"))


def tx4(spark, sf_dir):
    p = pages(spark, sf_dir).select(F.col("source").alias("document_id"), F.col("document_id").cast("int").alias("page"), "text")
    return T.numbered(T.windows_of(p)).select("document_id", "page", "pos", "chunk_id")


def tx5(spark, sf_dir):
    return pages(spark, sf_dir).select("document_id", F.length(T.chart_noise_removed(F.col("text"))).alias("kept"))


def tx6(spark, sf_dir):
    return pages(spark, sf_dir).select("document_id", F.length(T.query_time_text(F.col("text"))).alias("kept"))


def tx7(spark, sf_dir):
    t = T.circuit_types(F.col("text"), tagger(dicts.circuit_words(spark)))
    return pages(spark, sf_dir).select("document_id", F.array_join(t, ",").alias("types"))


def tx8(spark, sf_dir):
    """Classes of captions, which here are what conversations say, with a label before them."""
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.when(F.col("conv_id") % 3 == 0, " 低通滤波 LPF buck POWER").when(F.col("conv_id") % 3 == 1, " H桥 555 feedback").otherwise("")).alias("text"), F.when(F.col("turn") % 3 == 0, "filter").when(F.col("turn") % 3 == 1, "logo").alias("label"))
    t = T.circuit_types(F.col("text"), tagger(dicts.caption_words(spark)), F.coalesce("label", F.lit("other")))
    return said.select("conv_id", "turn", F.array_join(t, ",").alias("types"))


def tx9(spark, sf_dir):
    return pages(spark, sf_dir).select("document_id", F.array_join(F.array_sort(T.component_ids(F.col("text"))), ",").alias("components"))


def tx10(spark, sf_dir):
    return pages(spark, sf_dir).select("document_id", T.page_type(F.col("text"), F.col("document_id") % 3 == 0, F.col("document_id") % 4 == 0).alias("page_type"))


def tx11(spark, sf_dir):
    t = F.concat(F.substring("text", 1, 300), F.when(F.col("document_id") % 2 == 0, " Electrical Characteristics ").otherwise(" "), F.substring("text", 301, 900), F.when(F.col("document_id") % 3 == 0, " Package Information ").otherwise(" "), F.expr("substring(text, 1201)"))
    return pages(spark, sf_dir).select("document_id", F.md5(T.section(t)).alias("section_key"))


def tx12(spark, sf_dir):
    return pages(spark, sf_dir).select("document_id", T.context(F.col("text"), "thor").alias("around")).where("around is not null")


def tx13(spark, sf_dir):
    a = read(spark, sf_dir, "fx_answers")
    return T.without_repeats(a, ["conv_id", "turn"]).select("conv_id", "turn", F.md5("deduped").alias("deduped_key"), "repetitive")


def tx14(spark, sf_dir):
    a = read(spark, sf_dir, "fx_answers")
    t = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" user: next"))).otherwise(F.col("text"))
    return a.select("conv_id", "turn", F.length(T.without_role_markers(t)).alias("kept"), (F.length(t) < 5).alias("too_short"))


def tx15(spark, sf_dir):
    a = read(spark, sf_dir, "fx_answers")
    t = F.when(F.col("conv_id") % 7 == 0, F.concat("text", F.lit(" CUDA  out of memory"))).otherwise(F.col("text"))
    return a.select("conv_id", "turn", T.has_internal_error(t).alias("is_error"))


def tx16(spark, sf_dir):
    """Answers with thoughts before them, or another role and entities behind them."""
    wrapped = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("<think>x</think>## **"), "text")).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("Thinking Process: a plan\nSupply voltage 3. 3 V at 25 °C. "), "text")).otherwise(F.concat("text", F.lit(" &lt;5 mA. user: next question")))
    return read(spark, sf_dir, "fx_answers").select("conv_id", "turn", T.cleaned_answer(wrapped).alias("answer"))


def tx17(spark, sf_dir):
    return read(spark, sf_dir, "fx_answers").select("conv_id", "turn", T.caption(F.col("text"), F.lit("filter")).alias("caption"))


def tx20(spark, sf_dir):
    a = read(spark, sf_dir, "fx_answers")
    return T.accepted(a, ["conv_id", "turn"]).groupBy("verdict").agg(F.count("*").alias("n"))


def tx21(spark, sf_dir):
    f = read(spark, sf_dir, "fx_figures").select("image_id", F.concat_ws(" ", "types", "caption", "parts", F.lit("schematic NE5532 10kΩ")).alias("response"), F.when(F.col("image_id") % 3 == 0, "circuit_diagram").when(F.col("image_id") % 3 == 1, "photo").alias("clip_type"))
    return T.annotations(f).select("image_id", F.array_join("types", ",").alias("types"), "confidence")


def pf9(spark, sf_dir):
    f = read(spark, sf_dir, "fx_figures").withColumns({"clip_type": F.when(F.col("image_id") % 4 == 0, "schema").when(F.col("image_id") % 4 == 1, "table").otherwise("sketch"), "clip_confidence": F.col("visual")})
    return T.allowed_classes(f).groupBy("decision").agg(F.count("*").alias("n"))


QUERIES = {
    "sc1_document_status": sc1, "sc2_web_pages": sc2, "tx1_sentences": tx1, "tx2_chunks": tx2, "tx3_windows": tx3, "tx4_chunk_ids": tx4, "tx5_chart_noise": tx5, "tx6_query_time_text": tx6, "tx7_circuit_types": tx7, "tx8_caption_classes": tx8, "tx9_components": tx9, "tx10_page_type": tx10,
    "tx11_section": tx11, "tx12_context": tx12, "tx13_sentence_dedupe": tx13, "tx14_role_markers": tx14, "tx15_errors": tx15, "tx16_answer_cleanup": tx16, "tx17_captions": tx17, "tx20_acceptance": tx20, "tx21_annotations": tx21, "pf9_figure_classes": pf9,
}

_COL = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
_ANY = lambda t, ws: "(" + " OR ".join(f"contains({t}, '{w}')" for w in ws) + ")"

_REPEATS = """WITH s0 AS (SELECT conv_id, turn, text, list_transform(regexp_extract_all(text, '[^。！？.!?\\n]*[。！？.!?]?'), lambda x: trim(x)) AS s FROM {fx_answers}),
s1 AS (SELECT conv_id, turn, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM s0),
s2 AS (SELECT *, substring(regexp_replace(lower(s), '\\s+', '', 'g'), 1, 20) AS k FROM s1 WHERE length(s) > 6 AND length(regexp_replace(lower(s), '\\s+', '', 'g')) > 4),
s3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY pos) AS n FROM s2), s4 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS r FROM s3 WHERE n = 1),
s5 AS (SELECT conv_id, turn, string_agg(s, chr(10) ORDER BY pos) AS d FROM s4 WHERE r <= 15 GROUP BY conv_id, turn),
rp AS (SELECT a.conv_id, a.turn, a.text, coalesce(d, '') AS deduped, length(replace(a.text, ' ', '')) > 20 AND length(replace(coalesce(d, ''), ' ', '')) < 0.5 * length(replace(a.text, ' ', '')) AS repetitive
  FROM {fx_answers} a LEFT JOIN s5 ON s5.conv_id = a.conv_id AND s5.turn = a.turn)"""
_TEXT11 = "SELECT doc_id AS document_id, concat(substring(text, 1, 300), CASE WHEN doc_id % 2 = 0 THEN ' Electrical Characteristics ' ELSE ' ' END, substring(text, 301, 900), CASE WHEN doc_id % 3 = 0 THEN ' Package Information ' ELSE ' ' END, substring(text, 1201)) AS t FROM documents"
_AT = lambda t, p: f"CASE WHEN regexp_matches({t}, '{p}') THEN length(regexp_extract({t}, '(?s)^(.*?)(?:{p})', 1)) + 1 ELSE 0 END"

def _cleaned() -> str:
    """The chain of an answer's clean-up for texts of which more than ten signs are left."""
    cut = lambda t, mark, beyond: f"CASE WHEN instr(lower({t}), {mark}) > {beyond + 1} THEN substring({t}, 1, instr(lower({t}), {mark}) - 1) ELSE {t} END"
    steps = ["CASE conv_id % 3 WHEN 0 THEN concat('## **', text) WHEN 1 THEN concat('Supply voltage 3. 3 V at 25 °C. ', text) ELSE concat(text, ' &lt;5 mA. user: next question') END"]
    steps.append("regexp_replace(t, '(?im)^\\d*\\s*\\*\\s*(?:Step|Role|Task|Question|Analysis|Reasoning|User\\s+Question)\\s*\\d*\\s*[:：].*$', '', 'g')")
    steps += [cut("t", "concat(chr(10), chr(10), chr(10))", -1), *(cut("t", f"'{m}'", 20) for m in ("assistant:", "user:", "system:")), *(cut("t", f"'{m}'", 30) for m in ("###", "【答案】"))]
    for pattern, by in values.ANSWER_REPLACEMENTS:
        # The other engine has no look-ahead: the sign that is looked at is put back.
        pattern, by = (re.sub(r"\(\?=(.*)\)$", r"(\1)", pattern), "$1") if "(?=" in pattern else (pattern, by)
        steps.append(f"regexp_replace(t, '{pattern}', '{by.replace('$', chr(92))}', 'g')")
    steps += [f"replace(t, '{e}', '{x}')" for e, x in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'))]
    ctes = ", ".join(f"s{k} AS (SELECT conv_id, turn, {step} AS t FROM {f's{k - 1}' if k else '{fx_answers}'})" for k, step in enumerate(steps))
    return f"""WITH {ctes}, p0 AS (SELECT conv_id, turn, list_transform(regexp_extract_all(t, '[^。！？.!?\\n]*[。！？.!?]?'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS s FROM s{len(steps) - 1}),
p1 AS (SELECT conv_id, turn, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM p0), p2 AS (SELECT *, regexp_replace(lower(s), '\\s+', '', 'g') AS k FROM p1 WHERE length(s) > 6),
p3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, substring(k, 1, 20) ORDER BY pos) AS n FROM p2 WHERE length(k) > 4), p4 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS r FROM p3 WHERE n = 1)
SELECT conv_id, turn, string_agg(s, chr(10) ORDER BY pos) AS answer FROM p4 WHERE r <= 12 GROUP BY conv_id, turn"""


_MET = ", ".join(f"CASE WHEN {_ANY('low', ws)} THEN '{n}' END" for n, ws in CAPTION_CLASS_WORDS.items())
_ANNOTATED = f"""WITH r AS (SELECT image_id, lower(concat_ws(' ', types, caption, parts, 'schematic NE5532 10kΩ')) AS low, CASE image_id % 3 WHEN 0 THEN 'circuit_diagram' WHEN 1 THEN 'photo' END AS label FROM {{fx_figures}}),
x AS (SELECT image_id, label, CASE WHEN coalesce(label, 'other') IN ('other', 'logo', 'photo') THEN [] ELSE [label] END AS seed, list_filter([{_MET}], lambda v: v IS NOT NULL) AS t, len(list_filter([{', '.join(f"'{w}'" for w in values.CIRCUIT_EVIDENCE)}], lambda w: contains(low, w))) AS hits FROM r)
SELECT image_id, CASE WHEN len(seed) + len(t) > 0 THEN array_to_string(list_concat(seed, t), ',') ELSE 'unknown' END AS types, CASE WHEN label = 'circuit_diagram' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM x WHERE coalesce(label = 'circuit_diagram', FALSE) OR hits >= 2"""

SQL = {
    "tx21_annotations": _ANNOTATED,
    "tx9_components": "SELECT document_id, array_to_string(list_sort(list_filter(c, lambda x, i: list_position(c, x) = i AND len(list_distinct(c[:i])) <= 10)), ',') AS components FROM (SELECT doc_id AS document_id, " + "list_concat(" * 3 + ", ".join(f"list_slice(regexp_extract_all(text, '{p}', 1), 1, 5)" + (")" if k else "") for k, p in enumerate(values.COMPONENT_PATTERNS)) + " AS c FROM documents)",
    "tx11_section": f"WITH x AS ({_TEXT11}), a AS (SELECT *, {_AT('t', T.SECTION_START)} AS beg FROM x), b AS (SELECT *, CASE WHEN beg > 0 THEN substring(t, beg, 2000) ELSE substring(t, 1, 2000) END AS body FROM a), c AS (SELECT *, substring(body, 52, 2000) AS rest FROM b), d AS (SELECT *, {_AT('rest', T.SECTION_END)} AS stop FROM c) SELECT document_id, md5(CASE WHEN beg > 0 AND stop > 0 THEN substring(body, 1, stop + 50) ELSE body END) AS section_key FROM d",
    "tx12_context": f"WITH a AS (SELECT doc_id AS document_id, text, {_AT('text', '(?i)' + chr(92) + 'bthor' + chr(92) + 'b')} AS a4, {_AT('text', '(?i)' + chr(92) + 'btho' + chr(92) + 'b')} AS a3 FROM documents), b AS (SELECT *, CASE WHEN a4 > 0 THEN a4 ELSE a3 END AS f, CASE WHEN a4 > 0 THEN 4 ELSE 3 END AS s FROM a WHERE a4 > 0 OR a3 > 0) SELECT document_id, trim(substring(text, greatest(f - 125, 1), f + s + 125 - greatest(f - 125, 1))) AS around FROM b",
    "tx13_sentence_dedupe": _REPEATS + " SELECT conv_id, turn, md5(deduped) AS deduped_key, repetitive FROM rp",
    "tx16_answer_cleanup": _cleaned(),
    "sc1_document_status": "WITH p AS (SELECT concat(source, '-', CAST(floor(doc_id / 100) AS BIGINT)) AS document_id, n_chars < 100 AS e FROM documents) SELECT document_id, count(*) AS page_count, count(*) FILTER (e) AS error_pages, CASE WHEN count(*) FILTER (e) = 0 THEN 'success' WHEN count(*) FILTER (e) < count(*) THEN 'partial' ELSE 'error' END AS status FROM p GROUP BY document_id",
    "tx3_windows": f"WITH d AS (SELECT doc_id AS document_id, {_COL} AS t FROM documents), e AS (SELECT document_id, t, unnest(range(0, (length(t) + 599) // 600)) AS pos FROM d WHERE length(t) > 0) SELECT document_id, CAST(pos AS INTEGER) AS pos, CAST(pos * 600 AS INTEGER) AS start, md5(substring(t, pos * 600 + 1, 800)) AS chunk_key FROM e",
    "tx4_chunk_ids": f"WITH d AS (SELECT source AS document_id, CAST(doc_id AS INTEGER) AS page, {_COL} AS t FROM documents), e AS (SELECT document_id, page, unnest(range(0, (length(t) + 599) // 600)) AS pos FROM d WHERE length(t) > 0) SELECT document_id, page, CAST(pos AS INTEGER) AS pos, concat(document_id, '_p', page, '_c', row_number() OVER (PARTITION BY document_id ORDER BY page, pos) - 1) AS chunk_id FROM e",
    "tx8_caption_classes": "WITH s AS (SELECT conv_id, turn, concat(text, CASE conv_id % 3 WHEN 0 THEN ' 低通滤波 LPF buck POWER' WHEN 1 THEN ' H桥 555 feedback' ELSE '' END) AS text, CASE turn % 3 WHEN 0 THEN ['filter'] ELSE [] END AS seed FROM conversations), x AS (SELECT conv_id, turn, list_concat(seed, list_filter([" + ", ".join(f"CASE WHEN {_ANY('lower(text)', ws)} THEN '{n}' END" for n, ws in CAPTION_CLASS_WORDS.items()) + "], lambda v: v IS NOT NULL AND NOT list_contains(seed, v))) AS t FROM s) SELECT conv_id, turn, CASE WHEN len(t) > 0 THEN array_to_string(t, ',') ELSE 'unknown' END AS types FROM x",
    "tx1_sentences": f"WITH d AS (SELECT doc_id AS document_id, {COLLAPSED} AS t FROM documents), e AS (SELECT document_id, unnest(list_filter({SENTENCES}, lambda x: length(x) > 0)) AS raw, generate_subscripts(list_filter({SENTENCES}, lambda x: length(x) > 0), 1) AS i FROM d), f AS (SELECT document_id, raw, sum(length(raw)) OVER (PARTITION BY document_id ORDER BY i) AS stop FROM e) SELECT document_id, count(*) AS n_sentences, CAST(max(stop - (length(raw) - length(rtrim(raw)))) AS INTEGER) AS last_end, CAST(sum(length(trim(raw))) AS BIGINT) AS signs FROM f WHERE length(trim(raw)) > 0 GROUP BY document_id",
    "tx2_chunks": f"WITH RECURSIVE pg AS (SELECT doc_id AS document_id, 1 AS page, text FROM documents), {chunks('pg')} SELECT document_id, concat(document_id, '_p', page, '_c', row_number() OVER (PARTITION BY document_id ORDER BY page, pos) - 1) AS chunk_id, CAST(length(chunk) AS INTEGER) AS size FROM ck",
    "tx7_circuit_types": "WITH x AS (SELECT doc_id AS document_id, list_filter([" + ", ".join(f"CASE WHEN {_ANY('lower(text)', ws)} THEN '{n}' END" for n, ws in CIRCUIT_WORDS) + "], lambda v: v IS NOT NULL) AS t FROM documents) SELECT document_id, CASE WHEN len(t) > 0 THEN array_to_string(t, ',') ELSE 'unknown' END AS types FROM x",
    "tx10_page_type": f"""SELECT doc_id AS document_id, CASE WHEN {_ANY('lower(text)', T.COVER_WORDS)} AND length(text) < 500 THEN 'cover' WHEN contains(lower(text), 'contents') THEN 'toc' WHEN {_ANY('lower(text)', T.TIMING_WORDS)} THEN 'timing_diagram'
  WHEN (doc_id % 3 = 0 OR doc_id % 4 = 0) AND {_ANY('lower(text)', T.PARAMETER_WORDS)} THEN 'parameter_table' WHEN (doc_id % 3 = 0 OR doc_id % 4 = 0) AND {_ANY('lower(text)', T.PIN_WORDS)} THEN 'pin_table' ELSE 'text_only' END AS page_type FROM documents""",
    "tx14_role_markers": """WITH a AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN concat(text, ' user: next') ELSE text END AS t FROM {fx_answers}), m AS (SELECT *, instr(lower(t), 'assistant') AS p1, instr(lower(t), 'user:') AS p2, instr(lower(t), 'system:') AS p3, instr(lower(t), concat(chr(10), chr(10), chr(10))) AS p4 FROM a),
k AS (SELECT *, CASE WHEN p1 > 1 THEN p1 WHEN p2 > 1 THEN p2 WHEN p3 > 1 THEN p3 WHEN p4 > 1 THEN p4 ELSE 0 END AS cut FROM m) SELECT conv_id, turn, length(CASE WHEN length(t) >= 5 AND (p1 > 0 OR p2 > 0) AND cut > 1 THEN trim(substring(t, 1, cut - 1)) ELSE t END) AS kept, length(t) < 5 AS too_short FROM k""",
    "tx15_errors": "SELECT conv_id, turn, regexp_matches(CASE WHEN conv_id % 7 = 0 THEN concat(text, ' CUDA  out of memory') ELSE text END, '" + T.ERROR_PATTERN + "') AS is_error FROM {fx_answers}",
    "pf9_figure_classes": "SELECT CASE WHEN image_id % 4 = 0 THEN 'PASS' WHEN image_id % 4 = 1 THEN 'REJECT' WHEN visual < 0.3 THEN 'REJECT' ELSE 'PASS' END AS decision, count(*) AS n FROM {fx_figures} GROUP BY 1",
}
