"""Queries of retrieval: benchmark texts ask, documents, vectors, tables and figures answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetmill.functions.values import CAPTION_CLASS_WORDS, CHIP_SYNONYMS, RANKED_CHIPS
from sheetmill.functions import dicts
from sheetmill.operators import figures as G
from sheetmill.operators import late
from sheetmill.operators import retrieval as R
from sheetmill.operators.tagging import segmenter
from sheetmill.plans.fixtures import read
from sheetmill.plans.sql_parts import keywords, tokens

SHIFT = 3e-10


def _r(df, *names):
    return df.withColumns({n: F.round(F.col(n) + SHIFT, 6) + 0.0 for n in names})


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")


def _asked(spark, sf_dir):
    return read(spark, sf_dir, "fx_queries")


def _bm25(spark, sf_dir, k=20, **options):
    return R.bm25(_asked(spark, sf_dir), _docs(spark, sf_dir), k, **options)


def rt1(spark, sf_dir):
    """Some texts get a Chinese sentence, which becomes pairs of signs."""
    t = R.tokens(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("同相放大器的增益OPA一个"), "text")).otherwise(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.try_element_at(t, F.lit(1)).alias("first_token"))


def rt2(spark, sf_dir):
    words = F.concat(R.tokens(F.col("query")), F.array(F.when(F.col("query_id") % 2 == 0, "opamp").otherwise("滤波器")))
    return _asked(spark, sf_dir).select("query_id", F.array_join(F.array_sort(R.expanded(words)), " ").alias("words"))


def sc6(spark, sf_dir):
    _, _, terms, corpus = R.index_tables(_docs(spark, sf_dir))
    return _r(terms.where("df > 1").crossJoin(F.broadcast(corpus)).select("term", "df", "idf", "n", "avgdl"), "idf", "avgdl")


def rt3(spark, sf_dir):
    return _r(_bm25(spark, sf_dir), "score")


def rt7(spark, sf_dir):
    return _r(R.max_normalised(_bm25(spark, sf_dir)), "score")


def pf1(spark, sf_dir):
    return _docs(spark, sf_dir).join(_asked(spark, sf_dir).select((F.col("query_id") * 3).alias("doc_id")), "doc_id", "left_semi").where(F.col("source").isin("src0", "src3", "src6")).select("doc_id", "source")


def pf2(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    allowed = _asked(spark, sf_dir).select("query_id", F.concat(F.lit("src"), F.col("query_id") % 20).alias("source")).join(docs.select("doc_id", "source"), "source").select("query_id", "doc_id")
    return _r(R.bm25(_asked(spark, sf_dir), docs, 5, allowed=allowed), "score")


def pf3(spark, sf_dir):
    t = read(spark, sf_dir, "fx_table_content")
    q = t.where("table_id % 100 = 0 and row_no = 1").select(F.col("table_id").alias("query_id"), F.concat_ws(" ", "symbol", F.split_part("content", F.lit(" "), F.lit(3))).alias("query"))
    rows = t.select((F.col("table_id") * 1000 + F.col("row_no")).alias("doc_id"), F.col("content").alias("text"))
    return R.contains_all(q, rows, 10)


def pf5(spark, sf_dir):
    hits = _bm25(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "source", "n_chars"), "doc_id")
    return R.or_all(hits, (F.col("n_chars") > 6000) & (F.col("source") < "src15")).select("query_id", "doc_id", "rank")


def rt4(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return _r(R.dense(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), 50), "score")


def sc5(spark, sf_dir):
    return R.vector_checks(read(spark, sf_dir, "embeddings"), 64).groupBy("fits", "all_zero").agg(F.count("*").alias("n"))


def rt5(spark, sf_dir):
    """Distinct texts before encoding, and how many rows share each."""
    return _docs(spark, sf_dir).groupBy(F.md5("text").alias("cache_key")).agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_doc"))


def _late(spark, sf_dir, max_sim):
    v = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("image_id"), (F.col("vec_id") % 5).alias("patch_no"), F.col("embedding").alias("v"))
    return _r(max_sim(v.where("image_id % 100 = 0").select(F.col("image_id").alias("query_id"), F.col("patch_no").alias("token_no"), F.col("v").alias("q")), v, 10), "score")


def rt14(spark, sf_dir):
    return _late(spark, sf_dir, R.max_sim)


def rt14_cells(spark, sf_dir):
    return _late(spark, sf_dir, late.max_sim)


def rt23(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    e = v.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("x"))
    proto = e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return _r(R.zero_shot(v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q")), proto), "p")


def rt6(spark, sf_dir):
    t = read(spark, sf_dir, "fx_table_content")
    q = t.where("table_id % 100 = 0 and row_no = 1").select(F.col("table_id").alias("query_id"), F.concat_ws(" ", "symbol", F.split_part("content", F.lit(" "), F.lit(3))).alias("query"))
    rows = t.select((F.col("table_id") * 1000 + F.col("row_no")).alias("doc_id"), F.col("content").alias("text"))
    return _r(R.full_text(q, rows, 10), "score")


def hits(spark, sf_dir):
    """Hits of all three paths for the benchmark's texts; vectors and texts of documents, rows of conversations as tables."""
    return R.retrieved(*_stores(spark, sf_dir), 20)


def _stores(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    questions = _asked(spark, sf_dir).join(v.select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")), "query_id", "left")
    chunks = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("document_id"), "text")
    said = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat(F.lit("talk"), F.col("conv_id") % 50).alias("document_id"), "text")
    return questions, chunks, v, said


def rt9(spark, sf_dir):
    f = R.fused(hits(spark, sf_dir))
    return _r(f.select("query_id", "document_id", "chunk_id", "score", F.array_join("sources", ",").alias("sources"), F.col("best_rank").cast("long").alias("best_rank")), "score")


def rt10(spark, sf_dir):
    return R.without_copies(R.fused(hits(spark, sf_dir))).select("query_id", "document_id", "chunk_id")


def rt11(spark, sf_dir):
    return R.capped_per_document(R.without_copies(R.fused(hits(spark, sf_dir))), 2, 3).select("query_id", "document_id", "chunk_id")


def rt12(spark, sf_dir):
    h = R.retrieve(*_stores(spark, sf_dir), 20)
    return _r(h.select("query_id", "document_id", "chunk_id", "score", F.array_join("sources", ",").alias("sources"), "rank"), "score")


def rt13(spark, sf_dir):
    c = R.citations(R.retrieve(*_stores(spark, sf_dir), 20), ("The", "and", "th", "VCC", "er"))
    return _r(c.select("query_id", "chunk_id", "relevance", "rank", F.substring("snippet", 1, 20).alias("snippet")), "relevance")


def rt20(spark, sf_dir):
    h = _bm25(spark, sf_dir, 5)
    return R.primary_or_fallback(h.where("query_id % 3 <> 0 and rank <= 2").select("query_id", "doc_id"), h.where("rank = 5").select("query_id", "doc_id"))


def rt22(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", R.intent(F.col("text")).alias("intent"))


def rt15(spark, sf_dir):
    return _r(G.metadata_scores(read(spark, sf_dir, "fx_figure_queries"), read(spark, sf_dir, "fx_figures")), "score")


def rt17(spark, sf_dir):
    return _r(G.whole_relevance(read(spark, sf_dir, "fx_figure_queries"), read(spark, sf_dir, "fx_figures")), "relevance")


def rt18(spark, sf_dir):
    q, f = read(spark, sf_dir, "fx_figure_queries"), read(spark, sf_dir, "fx_figures")
    return _r(G.ranked_figures(q, f, G.figure_relevance(q, f), G.rank_bonus(q, f)), "score")


def pf8(spark, sf_dir):
    q, f = read(spark, sf_dir, "fx_figure_queries"), read(spark, sf_dir, "fx_figures")
    shown = G.showable_figures(f.withColumn("circuit_types", F.split("types", " ")), ("title", "page", "the", "of", "and"))
    return _r(G.confident_figures(G.figure_relevance(q, shown), shown, 0.2), "relevance")


def rt1_words(spark, sf_dir):
    """Words of Chinese questions, cut along the cheapest path through the word graph of the library's dictionary."""
    q = F.concat(F.lit("同相放大器电路"), F.when(F.col("query_id") % 3 == 0, "的增益").when(F.col("query_id") % 3 == 1, "和低通滤波").otherwise("一个未知器件NE5532"), F.lit(" "), F.col("query"))
    cut = segmenter(dicts.chinese_words(spark), R.STOP_WORDS)
    return _asked(spark, sf_dir).select("query_id", F.array_join(cut(q), " ").alias("words"))


QUERIES = {
    "rt1_tokens": rt1, "rt1_word_graph": rt1_words, "rt2_query_expansion": rt2, "rt3_jn5_bm25": rt3, "rt4_jn6_dense": rt4, "rt5_encode_once": rt5, "rt6_jn2_full_text": rt6, "rt7_normalised": rt7,
    "rt8_rt12_hybrid_search": rt12, "rt9_fusion": rt9, "rt10_copies": rt10, "rt11_document_caps": rt11, "rt13_citations": rt13, "rt14_jn7_max_sim": rt14, "rt14_two_stage_max_sim": rt14_cells, "rt15_metadata_scores": rt15,
    "rt17_figure_relevance": rt17, "rt18_figure_rank": rt18, "rt20_fallback": rt20, "rt22_intent": rt22, "rt23_zero_shot": rt23, "sc5_vector_checks": sc5, "sc6_sparse_index": sc6, 
    "pf1_jn11_metadata_filter": pf1, "pf2_post_filter": pf2, "pf3_substring_search": pf3, "pf5_chip_filter": pf5, "pf8_figure_filter": pf8,
}

_TOK = tokens


_NORM = lambda c: f"CASE WHEN list_inner_product({c}, {c}) > 0 THEN list_transform({c}, lambda x: x / sqrt(list_inner_product({c}, {c}))) ELSE {c} END"


def _index(docs: str, prefix: str = "") -> str:
    p = prefix
    return f"""{p}tk AS (SELECT doc_id, unnest({_TOK('text')}) AS term FROM {docs}),
{p}post AS (SELECT term, doc_id, count(*) AS tf FROM {p}tk GROUP BY term, doc_id),
{p}dl AS (SELECT doc_id, len({_TOK('text')}) AS dl FROM {docs}),
{p}cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {p}dl),
{p}ts AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM {p}post GROUP BY term), {p}cs)"""


_BM = f"""WITH dc AS (SELECT doc_id, text, source, n_chars FROM documents), {_index('dc')},
qt AS (SELECT DISTINCT query_id, unnest({_TOK('query')}) AS term FROM {{fx_queries}}),
sc AS (SELECT query_id, post.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN ts ON ts.term = qt.term JOIN post ON post.term = qt.term JOIN dl ON dl.doc_id = post.doc_id, cs GROUP BY query_id, post.doc_id),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM sc),
bm AS (SELECT query_id, doc_id, score, rank FROM rk WHERE rank <= 20)
"""
_HITS = f"""WITH dc AS (SELECT doc_id, text, source FROM documents), {_index('dc')},
qn AS (SELECT query_id, query FROM {{fx_queries}}),
qt AS (SELECT DISTINCT query_id, unnest({_TOK('query')}) AS term FROM qn),
sc AS (SELECT query_id, post.doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN ts ON ts.term = qt.term JOIN post ON post.term = qt.term JOIN dl ON dl.doc_id = post.doc_id, cs GROUP BY query_id, post.doc_id),
ve AS (SELECT vec_id AS doc_id, {_NORM('e')} AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
vs AS (SELECT q.query_id, c.doc_id, least(greatest(list_inner_product(v.e, c.e), 0.0), 1.0) AS score FROM qn q JOIN ve v ON v.doc_id = q.query_id, ve c),
tb AS (SELECT conv_id * 1000 + turn AS doc_id, concat('talk', conv_id % 50) AS document_id, text FROM conversations), {_index('tb', 't_')},
td AS (SELECT qt.query_id, p.doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS have FROM qt JOIN t_ts s ON s.term = qt.term JOIN t_post p ON p.term = qt.term JOIN t_dl d ON d.doc_id = p.doc_id, t_cs GROUP BY qt.query_id, p.doc_id),
al AS (SELECT query_id, 'bm25' AS source, doc_id, score FROM sc UNION ALL SELECT query_id, 'vector', doc_id, score FROM vs
  UNION ALL SELECT td.query_id, 'table', doc_id, score FROM td JOIN (SELECT query_id, count(*) AS need FROM qt GROUP BY query_id) n ON n.query_id = td.query_id AND need = have),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, doc_id) AS k FROM al),
hh AS (SELECT query_id, tp.source, d.source AS document_id, CAST(tp.doc_id AS VARCHAR) AS chunk_id, text, score FROM tp JOIN dc d ON d.doc_id = tp.doc_id WHERE tp.source <> 'table' AND k <= 40
  UNION ALL SELECT query_id, source, document_id, concat('t', CAST(tp.doc_id AS VARCHAR)), text, score FROM tp JOIN tb ON tb.doc_id = tp.doc_id WHERE source = 'table' AND k <= 20),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, document_id, chunk_id) - 1 AS r FROM hh),
fu AS (SELECT query_id, document_id, chunk_id, sum(CASE source WHEN 'vector' THEN 0.5 WHEN 'bm25' THEN 0.35 ELSE 0.15 END / CAST(60 + r + 1 AS DOUBLE)) AS score, list_sort(list(DISTINCT source)) AS sources, min(r) AS best_rank, max(text) AS text FROM hr GROUP BY query_id, document_id, chunk_id),
nc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, substring(text, 1, 100) ORDER BY round(score, 9) DESC, chunk_id) AS n FROM fu) WHERE n = 1)
"""
_CAP = lambda a, b: f""", cn AS (SELECT * EXCLUDE (n), row_number() OVER w AS n FROM nc WINDOW w AS (PARTITION BY query_id, document_id ORDER BY round(score, 9) DESC, chunk_id)),
cm AS (SELECT *, sum(CASE WHEN n > {a} AND len(sources) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, document_id ORDER BY round(score, 9) DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS m FROM cn),
ca AS (SELECT * FROM cm WHERE n <= {a} OR (len(sources) > 1 AND {a} + m <= {b}))
"""  # noqa: E731
_HYB = _HITS + _CAP(5, 8) + """, nm AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS ns FROM ca),
hy AS (SELECT query_id, document_id, chunk_id, text, ns AS score, sources, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(ns, 9) DESC, document_id, chunk_id) AS INTEGER) AS rank FROM nm)
"""
R6 = lambda c, n=None: f"round({c} + 3e-10, 6) + 0.0 AS {n or c}"
_TQ = """WITH q AS (SELECT table_id AS query_id, concat(symbol, ' ', split_part(content, ' ', 3)) AS query FROM {fx_table_content} WHERE table_id % 100 = 0 AND row_no = 1),
t AS (SELECT table_id * 1000 + row_no AS doc_id, content AS text FROM {fx_table_content})"""
_CHIPS = " OR ".join(f"(regexp_matches(query, '{'|'.join(v)}') AND regexp_matches(file, '{'|'.join(v)}'))" for v in CHIP_SYNONYMS.values())
_FIG = f"""WITH {keywords('{fx_figure_queries}', 'q')},
f AS (SELECT *, replace(lower(filename), '.pdf', '') AS file FROM {{fx_figures}}),
x AS (SELECT *, greatest(len(words), 1) AS n, len(list_filter(words, lambda w: contains(caption, w))) AS mc, len(list_filter(words, lambda w: contains(types, w))) AS mt, len(list_filter(words, lambda w: contains(parts, w))) AS mp, len(list_filter(words, lambda w: contains(file, w) AND length(w) >= 2)) AS mf FROM q, f),
rel AS (SELECT *, least(CASE WHEN contains(caption, query) THEN 1.0 WHEN mc >= 2 THEN least(CAST(mc AS DOUBLE) / n * 1.2, 1.0) ELSE CAST(mc AS DOUBLE) / n END * 0.30 + CAST(mt AS DOUBLE) / n * 0.20 + CAST(mp AS DOUBLE) / n * 0.15 + least(visual / 1.5, 1.0) * 0.15
  + CASE WHEN contains(file, query) THEN 1.0 ELSE greatest(CAST(mf AS DOUBLE) / n, CASE WHEN mf > 0 AND ({_CHIPS}) THEN 0.8 ELSE 0.0 END) END * 0.20, 1.0) AS relevance FROM x)
"""
_PLAIN = """WITH q AS (SELECT query_id, query, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS words FROM {fx_figure_queries}), f AS (SELECT *, replace(lower(filename), '.pdf', '') AS file FROM {fx_figures}),
x AS (SELECT *, len(words) AS n, len(list_filter(words, lambda w: contains(caption, w))) AS mc, len(list_filter(words, lambda w: contains(types, w))) AS mt, len(list_filter(words, lambda w: contains(parts, w))) AS mp, len(list_filter(words, lambda w: contains(file, w) AND length(w) >= 2)) AS mf FROM q, f)"""
_SYN = "CASE WHEN query_id % 2 = 0 THEN ['opamp', '运算放大器', 'operational_amplifier'] ELSE ['滤波器', '滤波', 'filter'] END"

SQL = {
    # The three Chinese questions are cut by hand; a brute-force test covers the word graph.
    "rt1_word_graph": f"SELECT query_id, array_to_string(list_concat(CASE query_id % 3 WHEN 0 THEN ['同相', '放大器', '电路', '增益'] WHEN 1 THEN ['同相', '放大器', '电路', '低通', '滤波'] ELSE ['同相', '放大器', '电路', '未知', '知器', '器件', 'ne5532'] END, {_TOK('query')}), ' ') AS words FROM {{fx_queries}}",
    "rt1_tokens": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, t[1] AS first_token FROM (SELECT doc_id, {_TOK('x')} AS t FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('同相放大器的增益OPA一个', text) ELSE text END AS x FROM documents))",
    "rt2_query_expansion": f"SELECT query_id, array_to_string(list_sort(list_distinct({_TOK('query')} || {_SYN})), ' ') AS words FROM {{fx_queries}}",
    "rt3_jn5_bm25": _BM + f"SELECT query_id, doc_id, {R6('score')}, rank FROM bm",
    "rt7_normalised": _BM + f"SELECT query_id, doc_id, {R6('score / max(score) OVER (PARTITION BY query_id)', 'score')}, rank FROM bm",
    "rt5_encode_once": "SELECT md5(text) AS cache_key, count(*) AS n_rows, min(doc_id) AS first_doc FROM documents GROUP BY md5(text)",
    "sc6_sparse_index": f"WITH {_index('documents')} SELECT term, df, {R6('idf')}, n, {R6('avgdl')} FROM ts, cs WHERE df > 1",
    "pf1_jn11_metadata_filter": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT query_id * 3 FROM {fx_queries}) AND source IN ('src0', 'src3', 'src6')",
    "pf2_post_filter": _BM + f", x AS (SELECT sc.* FROM sc JOIN dc ON dc.doc_id = sc.doc_id WHERE dc.source = concat('src', query_id % 20)), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM x) SELECT query_id, doc_id, {R6('score')}, rank FROM y WHERE rank <= 5",
    "pf3_substring_search": _TQ + ", w AS (SELECT query_id, list_filter(string_split(trim(regexp_replace(query, '[^\\p{L}\\p{N}_.]+', ' ', 'g')), ' '), lambda w: w <> '') AS words FROM q), x AS (SELECT query_id, doc_id FROM t, w WHERE len(words) > 0 AND len(list_filter(words, lambda w: NOT contains(lower(text), lower(w)))) = 0), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INTEGER) AS rank FROM x) SELECT query_id, doc_id, CAST(1.0 AS DOUBLE) AS score, rank FROM y WHERE rank <= 10",
    "pf5_chip_filter": _BM + ", x AS (SELECT bm.*, n_chars > 6000 AND source < 'src15' AS f FROM bm JOIN dc ON dc.doc_id = bm.doc_id), y AS (SELECT *, bool_or(f) OVER (PARTITION BY query_id) AS a FROM x) SELECT query_id, doc_id, rank FROM y WHERE f OR NOT a",
    "rt4_jn6_dense": f"""WITH v AS (SELECT vec_id, {_NORM('e')} AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)), s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, least(greatest(list_inner_product(q.e, c.e), 0.0), 1.0) AS score FROM v q, v c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT query_id, doc_id, {R6('score')}, rank FROM r WHERE rank <= 50""",
    "sc5_vector_checks": "SELECT len(embedding) = 64 AS fits, len(list_filter(embedding, lambda x: x <> 0)) = 0 AS all_zero, count(*) AS n FROM embeddings GROUP BY 1, 2",
    "rt14_jn7_max_sim": f"""WITH v AS (SELECT CAST(floor(vec_id / 5) AS BIGINT) AS image_id, vec_id % 5 AS p, {_NORM('e')} AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
b AS (SELECT q.image_id AS query_id, q.p, c.image_id, max(list_inner_product(q.e, c.e)) AS s FROM v q, v c WHERE q.image_id % 100 = 0 GROUP BY 1, 2, 3), t AS (SELECT query_id, image_id, avg(s) AS score FROM b GROUP BY query_id, image_id HAVING avg(s) >= 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, image_id) AS INTEGER) AS rank FROM t) SELECT query_id, image_id, {R6('score')}, rank FROM r WHERE rank <= 10""",
    "rt23_zero_shot": f"""WITH e AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) g(i) GROUP BY label, i), p AS (SELECT label, {_NORM('v')} AS p FROM (SELECT label, list(x ORDER BY i) AS v FROM e GROUP BY label)),
v AS (SELECT vec_id AS item_id, {_NORM('e')} AS q FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)), s AS (SELECT item_id, label, exp(10.0 * list_inner_product(q, p)) AS x FROM v, p), z AS (SELECT item_id, label, x / sum(x) OVER (PARTITION BY item_id) AS p FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(p, 9) DESC, label) AS k FROM z) SELECT item_id, label, {R6('p')} FROM r WHERE k = 1""",
    "rt6_jn2_full_text": _TQ + f", {_index('t')}, w AS (SELECT query_id, unnest(list_distinct({_TOK('query')})) AS term FROM q), n AS (SELECT query_id, count(*) AS need FROM w GROUP BY query_id), s AS (SELECT w.query_id, post.doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS have FROM w JOIN ts ON ts.term = w.term JOIN post ON post.term = w.term JOIN dl ON dl.doc_id = post.doc_id, cs GROUP BY w.query_id, post.doc_id), r AS (SELECT s.*, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s JOIN n ON n.query_id = s.query_id WHERE have = need) SELECT query_id, doc_id, {R6('score')}, rank FROM r WHERE rank <= 10",
    "rt9_fusion": _HITS + f"SELECT query_id, document_id, chunk_id, {R6('score')}, array_to_string(sources, ',') AS sources, CAST(best_rank AS BIGINT) AS best_rank FROM fu",
    "rt10_copies": _HITS + "SELECT query_id, document_id, chunk_id FROM nc",
    "rt11_document_caps": _HITS + _CAP(2, 3) + "SELECT query_id, document_id, chunk_id FROM ca",
    "rt8_rt12_hybrid_search": _HYB + f"SELECT query_id, document_id, chunk_id, {R6('score')}, array_to_string(sources, ',') AS sources, rank FROM hy WHERE rank <= 20",
    "rt13_citations": _HYB + f""", x AS (SELECT *, score + CASE WHEN contains(text, 'The') THEN 0.1 ELSE 0 END + CASE WHEN contains(text, 'and') THEN 0.1 ELSE 0 END + CASE WHEN contains(text, 'th') THEN 0.1 ELSE 0 END + CASE WHEN contains(text, 'VCC') THEN 0.1 ELSE 0 END + CASE WHEN contains(text, 'er') THEN 0.1 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[0-9]+(\\.[0-9]+)?\\s*(V|mA|A|W|Hz|MHz|kHz|ns)') THEN 0.2 ELSE 0 END AS relevance FROM hy WHERE rank <= 5), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 9) DESC, rank) AS INTEGER) AS k FROM x)
SELECT query_id, chunk_id, {R6('relevance')}, k AS rank, substring(text, 1, 20) AS snippet FROM y WHERE k <= 2""",
    "rt20_fallback": _BM + ", p AS (SELECT query_id, doc_id FROM bm WHERE query_id % 3 <> 0 AND rank <= 2) SELECT * FROM p UNION ALL SELECT query_id, doc_id FROM bm WHERE rank = 5 AND query_id NOT IN (SELECT query_id FROM p)",
    "rt22_intent": "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)引脚|pin|封装|管脚') THEN 'pinout' ELSE 'qa' END AS intent FROM conversations",
    "rt15_metadata_scores": _PLAIN + f", s AS (SELECT query_id, image_id, least(CAST(mc AS DOUBLE) / n * 0.4 + CAST(mt AS DOUBLE) / n * 0.3 + CAST(mp AS DOUBLE) / n * 0.2 + CAST(mf AS DOUBLE) / n * 0.1, 1.0) AS score FROM x), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, image_id) AS INTEGER) AS rank FROM s WHERE score >= 0.1) SELECT query_id, image_id, {R6('score')}, rank FROM r WHERE rank <= 10",
    "rt17_figure_relevance": _FIG + f"SELECT query_id, image_id, {R6('relevance')} FROM rel",
    "rt18_figure_rank": _FIG + f", kw AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{w.lower()}')" for k, ws in CAPTION_CLASS_WORDS.items() for w in ws)}) AS t(class, w)), b AS (SELECT query_id, image_id, least(CASE WHEN {' OR '.join(f"(contains(query, '{c}') AND (contains(caption, '{c}') OR contains(file, '{c}')))" for c in RANKED_CHIPS)} THEN 0.15 ELSE 0.0 END + coalesce((SELECT sum(CASE WHEN contains(caption, k.w) THEN 0.05 ELSE 0.0 END + CASE WHEN contains(lower(types), k.w) THEN 0.08 ELSE 0.0 END) FROM kw k WHERE k.class IN (SELECT k2.class FROM kw k2 WHERE contains(rel.query, k2.w))), 0.0), 0.3) AS bonus, relevance FROM rel), s AS (SELECT query_id, image_id, least(relevance + CAST(bonus AS DOUBLE), 1.0) AS score FROM b), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, image_id) AS INTEGER) AS rank FROM s) SELECT query_id, image_id, {R6('score')}, rank FROM r WHERE rank <= 5",
    "pf8_figure_filter": _FIG + f", s AS (SELECT query_id, image_id, relevance, avg(relevance) OVER (PARTITION BY query_id) AS a, max(relevance) OVER (PARTITION BY query_id) AS m FROM rel WHERE image_path <> '' AND len(list_filter(['title', 'page', 'the', 'of', 'and'], lambda w: contains(caption, w))) < 2 AND (is_circuit OR types <> '' OR confidence >= 0.15) AND confidence >= 0.08) SELECT query_id, image_id, {R6('relevance')} FROM s WHERE relevance >= 0.2 AND NOT (a < 0.03 AND m < 0.08)",
}
SQL["rt14_two_stage_max_sim"] = SQL["rt14_jn7_max_sim"]
