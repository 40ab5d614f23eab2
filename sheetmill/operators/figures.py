"""Figures for whole tables of queries, found by the words that they share and not pair by pair.

The distinct words of all queries are one dictionary; one pass over the captions, types, parts and file names
finds where they stand (``tagging.occurrences``), also inside longer words. Pairs of query and figure come
from an equi join on the word, so a pair that shares nothing is never written; its score is a constant of the
figure, and where the best k are asked for, k figures by that constant stand for all of these pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmill.functions.values import CAPTION_CLASS_WORDS, CHIP_SYNONYMS, NON_CIRCUIT_WORDS, RANKED_CHIPS
from sheetmill.operators.extraction import query_keywords
from sheetmill.operators.retrieval import spread_pairs, top_k
from sheetmill.operators.tagging import occurrences

FIELDS = ("caption", "types", "parts", "file")


def _file(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(".pdf"), F.lit(""))


def _fields(figures: DataFrame) -> DataFrame:
    """``image_id, field, hay``: the texts of a figure in which words are looked for."""
    shown = figures.withColumn("file", _file(F.col("filename")))
    named = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("hay")) for f in FIELDS))
    return shown.select("image_id", F.inline(named)).where(F.coalesce("hay", F.lit("")) != "")


def met_words(words: DataFrame, figures: DataFrame) -> DataFrame:
    """``word, image_id, field`` for every word of ``words(word)`` that a field of a figure contains."""
    hays = _fields(figures).select(F.struct("image_id", "field").alias("at"), "hay")
    dictionary = words.select("word", F.lit("").alias("tag"))
    return occurrences(hays, dictionary, "at", "hay").select("word", "at.*").distinct()


def _met(asked: DataFrame, figures: DataFrame) -> DataFrame:
    """``query_id, image_id`` of the pairs that share a word, with a count ``n_<field>`` for each field.

    ``asked(query_id, word, least)``: a word counts in file names from ``least`` signs on.
    """
    found = met_words(asked.select("word").distinct(), figures)
    counts = [F.count_if((F.col("field") == f) & ((F.col("field") != "file") | (F.length("word") >= 2))).alias(f"n_{f}") for f in FIELDS]
    return asked.join(found, "word").groupBy("query_id", "image_id").agg(*counts)


def metadata_scores(queries: DataFrame, figures: DataFrame, least: float = 0.1, k: int = 10) -> DataFrame:
    """Figures by how many words of a query their caption, types, parts and file name contain; ``least`` is above 0."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("([a-z0-9]+)"), F.lit(1)))
    asked = queries.select("query_id", words.alias("words"))
    met = _met(asked.select("query_id", F.explode("words").alias("word")), figures).join(asked.select("query_id", F.size("words").alias("n")), "query_id")
    share = lambda f: F.col(f"n_{f}") / F.col("n")
    score = F.least(share("caption") * 0.4 + share("types") * 0.3 + share("parts") * 0.2 + share("file") * 0.1, F.lit(1.0))
    return top_k(met.select("query_id", "image_id", score.alias("score")).where(F.col("score") >= least), k, "query_id", F.desc(F.round("score", 9)), F.col("image_id"))


def names_chip(query: Column, file: Column, chips: dict[str, list[str]] = CHIP_SYNONYMS) -> Column:
    """Whether query and file name hold names of one chip."""
    has = lambda c, names: c.rlike("|".join(names))
    return F.greatest(*(has(query, v) & has(file, v) for v in chips.values()))


def figure_constants(figures: DataFrame) -> DataFrame:
    """``image_id, rest, wordless``: the relevance for queries that share no word with a figure, and for those without words."""
    visual = F.when(F.col("visual") > 0, F.least(F.col("visual") / 1.5, F.lit(1.0))).otherwise(0.0)
    return figures.select("image_id", F.least(visual * 0.15, F.lit(1.0)).alias("rest"), (F.least("visual", F.lit(1.0)) * 0.5).alias("wordless"))


def figure_relevance(queries: DataFrame, figures: DataFrame, chips: dict[str, list[str]] = CHIP_SYNONYMS) -> DataFrame:
    """``query_id, image_id, relevance``: a blend of caption, type, part, visual and file-name scores.

    Rows are the pairs that share a word (or whose caption or file name holds the whole query); every other
    pair has the value of ``figure_constants``. ``queries(query_id, query)`` are looked for by their ``words``
    where they have such a column, else by the keywords of ``query_keywords``.
    """
    words = F.col("words") if "words" in queries.columns else query_keywords(F.col("query"))
    q = queries.select("query_id", F.lower("query").alias("query"), words.alias("words")).where(F.size("words") > 0)
    asked = q.select("query_id", F.explode(F.array_distinct(F.concat("words", F.array("query")))).alias("word")).where("word <> ''")
    found = asked.join(met_words(asked.select("word").distinct(), figures), "word").join(q.select("query_id", "query", F.col("words").alias("own"), F.greatest(F.size("words"), F.lit(1)).alias("n")), "query_id")
    own = F.array_contains("own", F.col("word"))
    count = lambda f, more=F.lit(True): F.count_if((F.col("field") == f) & own & more)
    whole = lambda f: F.max((F.col("field") == f) & (F.col("word") == F.col("query")))
    met = found.groupBy("query_id", "image_id", "query", "n").agg(
        count("caption").alias("mc"), count("types").alias("mt"), count("parts").alias("mp"), count("file", F.length("word") >= 2).alias("mf"), whole("caption").alias("wc"), whole("file").alias("wf")
    )
    d = met.join(figures.select("image_id", "visual", _file(F.col("filename")).alias("file")), "image_id")
    n = F.col("n")
    caption = F.when(F.col("wc"), 1.0).when(F.col("mc") >= 2, F.least(F.col("mc") / n * 1.2, F.lit(1.0))).otherwise(F.col("mc") / n)
    named = names_chip(F.col("query"), F.col("file"), chips)
    file = F.when(F.col("wf"), 1.0).otherwise(F.greatest(F.col("mf") / n, F.when(named & (F.col("mf") > 0), 0.8).otherwise(0.0)))
    visual = F.when(F.col("visual") > 0, F.least(F.col("visual") / 1.5, F.lit(1.0))).otherwise(0.0)
    score = caption * 0.30 + F.col("mt") / n * 0.20 + F.col("mp") / n * 0.15 + visual * 0.15 + file * 0.20
    return d.select("query_id", "image_id", F.least(score, F.lit(1.0)).alias("relevance"))


def whole_relevance(queries: DataFrame, figures: DataFrame, chips: dict[str, list[str]] = CHIP_SYNONYMS) -> DataFrame:
    """``query_id, image_id, relevance`` of every pair: those of ``figure_relevance``, and the constants of the others."""
    words = F.col("words") if "words" in queries.columns else query_keywords(F.col("query"))
    asked = queries.select("query_id", (F.size(words) > 0).alias("worded"))
    pairs = spread_pairs(asked, figure_constants(figures))
    own = F.coalesce("relevance", F.when(F.col("worded"), F.col("rest")).otherwise(F.col("wordless")))
    return pairs.join(figure_relevance(queries, figures, chips), ["query_id", "image_id"], "left").select("query_id", "image_id", own.alias("relevance"))


def rank_bonus(queries: DataFrame, figures: DataFrame, classes: dict[str, list[str]] = CAPTION_CLASS_WORDS, chips: Sequence[str] = RANKED_CHIPS) -> DataFrame:
    """``query_id, image_id, bonus`` (at most 0.3) of the pairs that have one.

    A chip named by the query and by caption or file name counts 0.15 once; every keyword of the classes that
    the query names counts 0.05 if the caption, and 0.08 if the types contain it.
    """
    low = F.lower("query")
    words = lambda ws: F.array(*(F.lit(w.lower()) for w in ws))
    named = F.flatten(F.array(*(F.when(F.exists(words(ws), lambda w: F.contains(low, w)), words(ws)).otherwise(F.array().cast("array<string>")) for ws in classes.values())))
    called = F.filter(F.array(*(F.lit(c) for c in chips)), lambda c: F.contains(low, c))
    kinds = F.concat(F.transform(named, lambda w: F.struct(w.alias("word"), F.lit("class").alias("kind"))), F.transform(called, lambda c: F.struct(c.alias("word"), F.lit("chip").alias("kind"))))
    # A keyword of two of the query's classes counts twice.
    asked = queries.select("query_id", F.inline(kinds)).groupBy("query_id", "word", "kind").agg(F.count("*").alias("times"))
    lowered = figures.withColumns({c: F.lower(c) for c in ("caption", "types")})
    found = asked.join(met_words(asked.select("word").distinct(), lowered), "word")
    part = F.when((F.col("kind") == "class") & (F.col("field") == "caption"), 0.05 * F.col("times")).when((F.col("kind") == "class") & (F.col("field") == "types"), 0.08 * F.col("times")).otherwise(0.0)
    chip = F.max((F.col("kind") == "chip") & F.col("field").isin("caption", "file"))
    out = found.groupBy("query_id", "image_id").agg(F.least(F.sum(part) + F.when(chip, 0.15).otherwise(0.0), F.lit(0.3)).alias("bonus"))
    return out.where("bonus > 0")


def ranked_figures(queries: DataFrame, figures: DataFrame, relevance: DataFrame, bonus: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, image_id, score, rank``: the k best figures of each query by relevance and bonus, at most 1 together.

    A figure that neither table has for a query scores its constant. Of those only the k best constants can
    be among a query's k best: whatever stands before them scores no less than its own constant.
    """
    words = F.col("words") if "words" in queries.columns else query_keywords(F.col("query"))
    asked = queries.select("query_id", (F.size(words) > 0).alias("worded"))
    constants = figure_constants(figures)
    best = lambda c, worded: constants.select("image_id").orderBy(F.desc(F.round(F.col(c), 9)), "image_id").limit(k).withColumn("worded", F.lit(worded))
    # 2 k rows at most.
    fill = asked.join(F.broadcast(best("rest", True).unionByName(best("wordless", False))), "worded").select("query_id", "image_id")
    pairs = relevance.select("query_id", "image_id").unionByName(bonus.select("query_id", "image_id")).unionByName(fill).distinct()
    d = pairs.join(relevance, ["query_id", "image_id"], "left").join(bonus, ["query_id", "image_id"], "left").join(asked, "query_id").join(constants, "image_id")
    own = F.coalesce("relevance", F.when(F.col("worded"), F.col("rest")).otherwise(F.col("wordless")))
    d = d.select("query_id", "image_id", F.least(own + F.coalesce("bonus", F.lit(0.0)), F.lit(1.0)).alias("score"))
    return top_k(d, k, "query_id", F.desc(F.round("score", 9)), F.col("image_id"))


def showable_figures(figures: DataFrame, non_circuit: Sequence[str] = NON_CIRCUIT_WORDS, least: float = 0.08) -> DataFrame:
    """Figures (``image_path, caption, is_circuit, circuit_types, confidence``) that may be shown for a query.

    They have an image, a caption with at most one word of other drawings, and some confidence; one
    that is marked as no circuit stays if it has a type, or a confidence of 0.15.
    """
    words = F.array(*(F.lit(w) for w in non_circuit))
    other = F.size(F.filter(words, lambda w: F.contains(F.lower("caption"), w)))
    typed = F.exists("circuit_types", lambda t: (t != "") & (t != "non_circuit"))
    circuit = F.coalesce("is_circuit", F.lit(True)) | F.coalesce(typed, F.lit(False)) | (F.col("confidence") >= 0.15)
    return figures.where((F.coalesce("image_path", F.lit("")) != "") & (other < 2) & circuit & (F.col("confidence") >= least))


def confident_figures(relevance: DataFrame, figures: DataFrame, least: float = 0.02) -> DataFrame:
    """Pairs of ``figure_relevance`` of some relevance; of a query whose figures are all weak, none.

    Average and maximum are those over all figures: a figure without a pair counts with its constant.
    """
    constants = figure_constants(figures).select("image_id", "rest")
    total = constants.agg(F.count("*").alias("n"), F.coalesce(F.sum("rest"), F.lit(0.0)).alias("rests"), F.max("rest").alias("top"))
    own = relevance.join(constants, "image_id").groupBy("query_id").agg(F.sum(F.col("relevance") - F.col("rest")).alias("more"), F.max("relevance").alias("most"))
    # One row of figures goes to all tasks.
    shown = own.crossJoin(F.broadcast(total)).where(~(((F.col("rests") + F.col("more")) / F.col("n") < 0.03) & (F.greatest("most", "top") < 0.08)))
    return relevance.where(F.col("relevance") >= least).join(shown.select("query_id"), "query_id", "left_semi")
