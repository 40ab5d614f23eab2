"""Retrieval for whole tables of queries: sparse, dense, full-text and multi-vector, and their fusion."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetmill.functions.folds import bound

# Words that carry no content.
STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这", "个", "那", "些",
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
)
# Synonyms of query words.
SYNONYMS = {
    "放大器": ["放大", "amplifier", "amplify"],
    "放大": ["放大器", "amplifier", "amplify"],
    "滤波器": ["滤波", "filter"],
    "滤波": ["滤波器", "filter"],
    "振荡器": ["振荡", "oscillator"],
    "振荡": ["振荡器", "oscillator"],
    "整流器": ["整流", "rectifier"],
    "整流": ["整流器", "rectifier"],
    "稳压器": ["稳压", "regulator", "voltage_regulator"],
    "稳压": ["稳压器", "regulator"],
    "电路": ["circuit"],
    "电路图": ["circuit", "schematic"],
    "电阻": ["resistor"],
    "电容": ["capacitor"],
    "电感": ["inductor"],
    "晶体管": ["transistor"],
    "二极管": ["diode"],
    "运算放大器": ["opamp", "op_amp", "operational_amplifier"],
    "opamp": ["运算放大器", "operational_amplifier"],
    "op_amp": ["运算放大器", "operational_amplifier"],
}
# Weight of each path in the fusion.
SOURCE_WEIGHTS = {"vector": 0.5, "bm25": 0.35, "table": 0.15}
SOURCE_ORDER = {"vector": 0, "bm25": 1, "table": 2}


SEPARATORS = r"[^\p{L}\p{N}_]+"
CJK = r"[\u4e00-\u9fa5]"


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case words of two signs or more that are no stop words.

    A run of CJK signs, which has no blanks, becomes its overlapping pairs. ``tagging.segmenter`` is a
    tokeniser that cuts such runs into the words of a dictionary.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.split(F.regexp_replace(low, f"({CJK}+)", " $1 "), SEPARATORS)

    def pairs(run: Column) -> Column:
        signs = F.split(run, "")
        return F.zip_with(F.slice(signs, 1, F.length(run) - 1), F.slice(signs, 2, F.length(run) - 1), lambda a, b: F.concat(a, b))

    cut = F.flatten(F.transform(words, lambda w: F.when(w.rlike(f"^{CJK}{{2}}"), pairs(w)).otherwise(F.array(w))))
    # A text without CJK signs is only split; stop words are looked up in a set and not compared one by one.
    return F.filter(F.when(low.rlike(CJK), cut).otherwise(F.split(low, SEPARATORS)), lambda t: (F.length(t) > 1) & ~t.isin(*stop_words))


def expanded(words: Column, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """Query words with their synonyms behind them, each once."""
    table = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)))))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))))


# -- sparse --------------------------------------------------------------------------------------
def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """``term, doc_id, tf``; ``tokenizer`` gives the words of a text."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokenizer(F.col(text))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def index_tables(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: Callable[[Column], Column] = tokens) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Postings, lengths of documents, terms with their weight, and one row of corpus figures."""
    lengths = docs.select(F.col(doc_id).alias("doc_id"), F.size(tokenizer(F.col(text))).cast("long").alias("dl"))
    post = postings(docs, doc_id, text, tokenizer)
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # One row of figures goes to all tasks.
    terms = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus)).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    return post, lengths, terms, corpus


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, query_terms: Column | None = None, allowed: DataFrame | None = None, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """``query_id, doc_id, score, rank``: the k best documents of each query.

    ``allowed(query_id, doc_id)`` keeps listed pairs after scoring, so that weights stay those of the
    whole corpus. Texts are cut into words once; words that nobody asks for go before anything is counted.
    """
    asked = queries.select("query_id", F.explode(tokenizer(F.col("query")) if query_terms is None else query_terms).alias("term")).distinct()
    words = docs.select("doc_id", tokenizer(F.col("text")).alias("words"))
    corpus = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"))
    parts = _parts(docs.sparkSession)
    each = words.select(_part_of("doc_id", parts), "doc_id", F.size("words").cast("long").alias("dl"), F.explode("words").alias("term"))
    # The vocabulary of the queries goes to all tasks, or else every word of every text would be shuffled to it.
    # What is left is dealt once, by text: it is counted and scored where it lies.
    found = each.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").repartition(parts, "_part").groupBy("_part", "term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    return scored(asked, found, corpus, k, k1, b, allowed)


#: Rows of asked words that meet a part of the texts at once.
ASKED = 200_000


def _parts(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _part_of(doc_id: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(parts)).cast("int").alias("_part")


def scored(asked: DataFrame, found: DataFrame, corpus: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, allowed: DataFrame | None = None) -> DataFrame:
    """The k best of ``found(term, doc_id, tf, dl)`` for ``asked(query_id, term)``; ``corpus(n, avgdl)`` is one row.

    Documents are dealt in parts (``found`` may say which in ``_part``) and queries in blocks. A part meets a block
    as arrays, and only what may be among the k best of a query leaves it; with ``allowed``, all that is scored.
    """
    from sheetmill.operators.late import _grouped

    spark = found.sparkSession
    parts, blocks = _parts(spark), max(1, -(-asked.count() // ASKED))
    if "_part" not in found.columns:
        found = found.withColumn("_part", _part_of("doc_id", parts))
    # Counts look at ``tf``, so that they read the same rows as the scores do, and these are made once.
    df = found.groupBy("term").agg(F.count("tf").alias("df")).crossJoin(F.broadcast(corpus))
    terms = df.select("term", "avgdl", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_block")
    dealt = asked.join(terms, "term").select(block, "query_id", "term", "idf", "avgdl").withColumn("_part", every(parts))
    keys = ["_part"] if blocks == 1 else ["_part", "_block"]
    left = found.select("_part", "term", "doc_id", "tf", "dl")
    left = left if blocks == 1 else left.withColumn("_block", every(blocks))
    most = k if allowed is None else None

    def met(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        names, types = ["query_id", "doc_id", "score"], [wanted.schema.field("query_id").type, rows.schema.field("doc_id").type, pa.float64()]
        if not rows.num_rows or not wanted.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        vocabulary, term = _grouped(wanted.column("term"))
        queries, query = _grouped(wanted.column("query_id"))
        weight = np.zeros(len(vocabulary))
        weight[term] = wanted.column("idf").to_numpy()
        at = pc.index_in(rows.column("term"), value_set=vocabulary)
        rows, at = rows.filter(pc.is_valid(at)), at.drop_null().to_numpy()
        docs, doc = _grouped(rows.column("doc_id"))
        tf, dl = rows.column("tf").to_numpy().astype(float), rows.column("dl").to_numpy().astype(float)
        part = weight[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / wanted.column("avgdl")[0].as_py()))
        order = np.argsort(at, kind="stable")
        doc, part, ends = doc[order], part[order], np.searchsorted(at[order], np.arange(len(vocabulary) + 1))
        by_query = np.lexsort((term, query))
        term, first = term[by_query], np.searchsorted(query[by_query], np.arange(len(queries) + 1))
        out_q, out_d, out_s = [], [], []
        for q in range(len(queries)):
            mine = np.concatenate([np.arange(ends[t], ends[t + 1]) for t in term[first[q] : first[q + 1]]])
            scores = np.bincount(doc[mine], part[mine], len(docs))
            some = np.flatnonzero(scores > 0)
            if most is not None and len(some) > most:
                some = some[_may_lead(scores[some], most)]
            out_q.append(np.full(len(some), q))
            out_d.append(some)
            out_s.append(scores[some])
        columns = [queries.take(pa.array(np.concatenate(out_q))), docs.take(pa.array(np.concatenate(out_d))), pa.array(np.concatenate(out_s))]
        return pa.table(columns, names=names)

    kinds = {**dict(found.dtypes), **dict(asked.dtypes)}
    out = left.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(met, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")
    if allowed is not None:
        out = out.join(allowed, ["query_id", "doc_id"], "left_semi")
    return top_k(out, k, "query_id", F.desc(F.round("score", 9)), F.col("doc_id"))


def _may_lead(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of all scores, in the order of ids, that can be among the k best once scores are rounded to nine digits and ties go to the first."""
    order = np.argsort(-scores, kind="stable")
    near = order[scores[order] >= scores[order[k - 1]] - 2e-9]
    value, n = scores[near], np.arange(len(near))
    run = np.maximum.accumulate(np.where(np.r_[True, value[1:] != value[:-1]], n, 0))
    return near[n - run < k]


def top_k(df: DataFrame, k: int, by: str, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def max_normalised(hits: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    top = F.max(score).over(Window.partitionBy(by))
    return hits.withColumn(score, F.when(top > 0, F.col(score) / F.nullif(top, F.lit(0.0))).otherwise(F.col(score)))


def full_text(queries: DataFrame, tables: DataFrame, k: int = 10, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """Tables (``doc_id, text``) that hold all words of a query, best first.

    Queries with the same words are answered once. A query starts from the rarest of its words; the
    other words are looked for in the rows that this one gives, so that frequent words are never joined.
    """
    asked = queries.select("query_id", F.array_sort(F.array_distinct(tokenizer(F.col("query")))).alias("words")).where(F.size("words") > 0)
    sets = asked.select("words").distinct()
    rows = tables.select("doc_id", tokenizer(F.col("text")).alias("tokens"))
    post = rows.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    corpus = rows.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    wanted = sets.select("words", F.explode("words").alias("term"))
    df = post.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weighed = wanted.join(df, "term").groupBy("words").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.collect_list(F.struct("term", "df")).alias("known"))
    # A set one of whose words no row has is answered by nothing.
    weighed = weighed.where(F.size("known") == F.size("words"))
    met = weighed.join(post, "term").drop("term").join(rows, "doc_id").where(F.size(F.array_intersect("words", "tokens")) == F.size("words")).crossJoin(F.broadcast(corpus))

    def part(word: Column) -> Column:
        idf = F.log((F.col("n") - word["df"] + 0.5) / (word["df"] + 0.5) + 1)
        tf = F.size(F.filter("tokens", lambda t: t == word["term"]))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.size("tokens") / F.col("avgdl")))

    scored = met.select("words", "doc_id", F.aggregate("known", F.lit(0.0), lambda s, w: s + part(w)).alias("score"))
    w = Window.partitionBy("words").orderBy(F.desc(F.round("score", 9)), F.col("doc_id"))
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return asked.join(best, "words").select("query_id", "doc_id", "score", "rank")


def grams(text: Column, q: int) -> Column:
    """All runs of ``q`` signs of a text, in order; none of a shorter one."""
    runs = lambda signs: F.transform(F.sequence(F.lit(0), F.size(signs) - q), lambda i: F.concat(*(F.get(signs, i + k) for k in range(q))))
    return F.when(F.length(text) >= q, bound(F.split(text, ""), runs)).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, rows: DataFrame, q: int = 4) -> DataFrame:
    """``needle, row_id``: the rows (``row_id, hay``) whose text holds a needle (``needle``, distinct texts).

    Texts send the places of their grams of ``q`` signs, as far as a needle has the gram; the texts stay where
    they are. A needle is looked up by the two rarest of its grams, which have to stand at the right distance,
    and what both give is joined with its text and compared whole. A needle shorter than a gram is a gram itself, and only such needles are broadcast.
    """
    asked = needles.where(F.length("needle") >= q).select("needle", F.posexplode(grams(F.col("needle"), q)).alias("off", "gram"))
    post = rows.where(F.length("hay") >= q).select("row_id", F.posexplode(grams(F.col("hay"), q)).alias("pos", "gram")).join(asked.select("gram").distinct().hint("merge"), "gram", "left_semi")
    df = post.groupBy("gram").agg(F.count("*").alias("df"))
    # A gram that no row has counts as the rarest, and its needle is found nowhere.
    weighed = asked.join(df.hint("merge"), "gram", "left").groupBy("needle").agg(F.slice(F.sort_array(F.collect_set(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "gram"))), 1, 2).alias("two"))
    anchors = weighed.where(F.col("two")[0]["df"] > 0).select("needle", F.size("two").alias("need"), F.inline("two"))
    met = anchors.join(post.hint("merge"), "gram").select("needle", "row_id", "need", "off", (F.col("pos") - F.col("off")).alias("at"))
    # Both grams of a needle have other offsets, so each place counts them once.
    near = met.groupBy("needle", "row_id", "need", "at").agg(F.count("*").alias("n")).where("n = need").select("needle", "row_id").distinct()
    out = near.join(rows.hint("merge"), "row_id").where(F.contains("hay", F.col("needle"))).select("needle", "row_id")
    for k in range(1, q):
        short = needles.where(F.length("needle") == k)
        each = rows.select("row_id", F.explode(F.array_distinct(grams(F.col("hay"), k))).alias("needle"))
        out = out.unionByName(each.join(short, "needle", "left_semi").select("needle", "row_id"))
    return out.unionByName(rows.where("hay is not null").join(F.broadcast(needles.where("needle = ''").limit(1)), how="cross").select("needle", "row_id"))


def contains_all(queries: DataFrame, tables: DataFrame, k: int = 10) -> DataFrame:
    """Fallback full text: tables that contain every word of a query as a substring; all score 1.

    Queries with the same words are answered once. The longest word finds the texts (``containing``),
    the others are looked for in these. Rows of equal texts are searched once: all of them match or none, so
    of a text only its ``k`` first rows can be among the ``k`` first.
    """
    words = F.filter(F.split(F.trim(F.regexp_replace("query", r"[^\p{L}\p{N}_.]+", " ")), " "), lambda w: w != "")
    asked = queries.select("query_id", F.array_sort(F.array_distinct(F.transform(words, F.lower))).alias("words")).where(F.size("words") > 0)
    longest = F.element_at(F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), 1)["w"]
    sets = asked.select("words").distinct().withColumn("needle", longest)
    rows = tables.select(F.col("doc_id").alias("row_id"), F.lower("text").alias("key")).where("key is not null")
    # A text is taken out of its group and not by its key: else each use would push its own filter down to the tables and read them again.
    texts = top_k(rows, k, "key", F.col("row_id")).groupBy("key").agg(F.first("key").alias("hay"), F.sort_array(F.collect_list("row_id")).alias("ids")).select(F.col("ids")[0].alias("row_id"), "hay", "ids")
    met = containing(sets.select("needle").distinct(), texts.select("row_id", "hay")).join(sets, "needle").join(texts, "row_id").where(F.forall("words", lambda w: F.contains(F.col("hay"), w)))
    each = met.select("words", F.explode("ids").alias("row_id"))
    best = top_k(each, k, "words", F.col("row_id"))
    return asked.join(best, "words").select("query_id", F.col("row_id").alias("doc_id"), F.lit(1.0).alias("score"), "rank")


# -- dense ---------------------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_checks(vectors: DataFrame, dim: int) -> DataFrame:
    """``vectors`` with ``fits`` (its dimension is right) and ``all_zero``."""
    return vectors.withColumns({"fits": F.coalesce(F.size("embedding") == dim, F.lit(False)), "all_zero": ~F.exists("embedding", lambda x: x != 0)})


def normalised(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def spread_pairs(left: DataFrame, right: DataFrame, parts: int | None = None) -> DataFrame:
    """Every row of ``left`` (the queries) with every row of ``right``, in even parts of ``right``.

    The queries are repeated for each part, and a part is one key of the join, so no side is sent to
    all tasks and no task holds more than its part and the queries.
    """
    spark = left.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = right.withColumn("_part", F.pmod(F.xxhash64(*right.columns), F.lit(parts)))
    q = left.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_part", F.col("_part").cast("long"))
    return r.join(q, "_part").drop("_part")


def dense(queries: DataFrame, corpus: DataFrame, k: int = 50) -> DataFrame:
    """``query_id, doc_id, score, rank`` by cosine, clipped to 0..1, of ``queries(query_id, q)`` and ``corpus(doc_id, v)``.

    The corpus is indexed by cells (``cells.cell_index``, which may be kept for further queries).
    """
    from sheetmill.operators.cells import cell_index, nearest

    return nearest(queries, *cell_index(corpus), k)


def max_sim(query_tokens: DataFrame, patches: DataFrame, k: int = 10, threshold: float = 0.0, how: str = "avg") -> DataFrame:
    """Late interaction: of each query token (``query_id, token_no, q``) the best patch of an image, averaged over tokens.

    All pairs are scored, in parts of images and blocks of queries (``late.interaction``). Tokens and patches without
    a vector take no part.
    """
    from sheetmill.operators.late import interaction, parts_of

    whole = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull())
    tokens = query_tokens.where(whole("q")).select("query_id", normalised(F.col("q")).alias("q"))
    images = patches.where(whole("v")).select("image_id", normalised(F.col("v")).alias("v"))
    best = interaction(tokens, images, parts_of(patches.count(), patches.sparkSession), how, threshold, k)
    return top_k(best, k, "query_id", F.desc(F.round("score", 9)), F.col("image_id"))


def zero_shot(items: DataFrame, prototypes: DataFrame, scale: float = 10.0) -> DataFrame:
    """``item_id, label, p``: softmax over all prototypes (``label, proto, v``), greatest per label, best label."""
    pairs = spread_pairs(prototypes.select("label", normalised(F.col("v")).alias("p")), items.select("item_id", normalised(F.col("q")).alias("q")))
    s = pairs.select("item_id", "label", F.exp(scale * dot(F.col("q"), F.col("p"))).alias("e"))
    total = s.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("item_id"))).groupBy("item_id", "label").agg(F.max("p").alias("p"))
    return top_k(total, 1, "item_id", F.desc(F.round("p", 9)), F.col("label")).drop("rank")


# -- fusion --------------------------------------------------------------------------------------
def fused(hits: DataFrame, weights: dict[str, float] = SOURCE_WEIGHTS, k: int = 60) -> DataFrame:
    """Weighted reciprocal ranks of ``hits(query_id, source, document_id, chunk_id, text, score)``."""
    w = F.coalesce(F.create_map(*(x for s, v in weights.items() for x in (F.lit(s), F.lit(v))))[F.col("source")], F.lit(0.1))
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc(F.round("score", 9)), "document_id", "chunk_id")) - 1)
    return ranked.groupBy("query_id", "document_id", "chunk_id").agg(
        F.sum(w / (k + F.col("r") + 1)).alias("score"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min("r").alias("best_rank"),
        F.first("text", ignorenulls=True).alias("text"),
    )


def without_copies(f: DataFrame, signs: int = 100) -> DataFrame:
    """Of hits of a document that begin with the same signs, the best."""
    w = Window.partitionBy("query_id", "document_id", F.substring("text", 1, signs)).orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return f.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def capped_per_document(f: DataFrame, first: int = 5, cross: int = 8) -> DataFrame:
    """The first hits of a document; beyond them only hits of several sources, up to ``cross``."""
    order = Window.partitionBy("query_id", "document_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    d = f.withColumn("_n", F.row_number().over(order))
    late = (F.col("_n") > first) & (F.size("sources") > 1)
    d = d.withColumn("_m", F.sum(late.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where((F.col("_n") <= first) | (late & (first + F.col("_m") <= cross))).drop("_n", "_m")


def hybrid(hits: DataFrame, k: int = 50, **options) -> DataFrame:
    """Fusion, copies, caps, normalised scores and the k best of each query."""
    f = max_normalised(capped_per_document(without_copies(fused(hits, **options))))
    return top_k(f, k, "query_id", F.desc(F.round("score", 9)), F.col("document_id"), F.col("chunk_id"))


def retrieved(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, tables: DataFrame | None = None, k: int = 50, signs: int = 100) -> DataFrame:
    """Hits of all paths: ``query_id, source, document_id, chunk_id, text, score``; of texts their first ``signs`` signs.

    ``queries(query_id, query, q)`` are asked of ``vectors(doc_id, v)`` and of the words of
    ``chunks(doc_id, document_id, text)``, each for ``2 k`` hits, and of ``tables(doc_id, document_id,
    text)`` for ``k``. A query without a vector, or a chunk without one, takes no part in the first.
    """
    near = dense(queries.where("q is not null").select("query_id", "q"), vectors, 2 * k)
    word = bm25(queries.select("query_id", "query"), chunks.select("doc_id", "text"), 2 * k)
    found = near.select("query_id", F.lit("vector").alias("source"), "doc_id", "score").unionByName(word.select("query_id", F.lit("bm25").alias("source"), "doc_id", "score"))
    begun = lambda df: df.select("doc_id", "document_id", F.substring("text", 1, signs).alias("text"))
    # Only ids, scores and beginnings are ranked; whole texts join what is left.
    out = found.join(begun(chunks), "doc_id").select("query_id", "source", "document_id", F.col("doc_id").cast("string").alias("chunk_id"), "text", "score")
    if tables is None:
        return out
    rows = full_text(queries.select("query_id", "query"), tables.select("doc_id", "text"), k).join(begun(tables), "doc_id")
    return out.unionByName(rows.select("query_id", F.lit("table").alias("source"), "document_id", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("chunk_id"), "text", "score"))


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, tables: DataFrame | None = None, k: int = 50, **options) -> DataFrame:
    """Hybrid retrieval: hits of all paths, fused, without copies, capped per document, normalised; the k best with their texts."""
    best = hybrid(retrieved(queries, chunks, vectors, tables, k), k, **options).drop("text")
    texts = chunks.select("document_id", F.col("doc_id").cast("string").alias("chunk_id"), "text")
    if tables is not None:
        texts = texts.unionByName(tables.select("document_id", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("chunk_id"), "text"))
    return best.join(texts, ["document_id", "chunk_id"])


def or_all(df: DataFrame, flag: Column, by: str = "query_id") -> DataFrame:
    """The rows for which the flag holds, or all rows of a query for which it never does."""
    d = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    return d.withColumn("_any", F.max("_flag").over(Window.partitionBy(by))).where(F.col("_flag") | ~F.col("_any")).drop("_flag", "_any")


# Words that mark technical passages.
TECH_KEYWORDS = ("VCC", "VDD", "VS", "±", "Supply voltage", "Electrical Characteristics", "Recommended Operating", "Absolute Maximum")


def citations(hits: DataFrame, keywords: Sequence[str] = TECH_KEYWORDS, unit: str = r"[0-9]+(\.[0-9]+)?\s*(V|mA|A|W|Hz|MHz|kHz|ns)") -> DataFrame:
    """Of each query's five best hits the two best after bonuses for keywords and numbers with units."""
    bonus = sum((F.contains("text", F.lit(w)).cast("int") * 0.1 for w in keywords), F.lit(0.0)) + F.when(F.col("text").rlike(unit), 0.2).otherwise(0.0)
    d = hits.where("rank <= 5").withColumn("relevance", F.col("score") + bonus).withColumnRenamed("rank", "_was")
    top = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("relevance", 9)), "_was")))
    return top.drop("_was").where("rank <= 2").withColumn("snippet", F.substring("text", 1, 200))


def primary_or_fallback(primary: DataFrame, fallback: DataFrame, by: str = "query_id") -> DataFrame:
    return primary.unionByName(fallback.join(primary.select(by).distinct(), by, "left_anti"))


def intent(query: Column) -> Column:
    return F.when(query.rlike("(?i)引脚|pin|封装|管脚"), "pinout").otherwise("qa")
