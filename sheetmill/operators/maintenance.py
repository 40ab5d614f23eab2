"""The document catalogue and what keeps its stores in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmill.functions.folds import scan

IN_PROGRESS = ("uploading", "parsing", "indexing", "processing")


def latest(log: DataFrame, key: str = "document_id", *order: str) -> DataFrame:
    """The newest entry of each key of an append log, by aggregation: no window, map-side combine."""
    order = order or ("ts", "entry")
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")).select(key, "_s.*")


def catalogue(log: DataFrame, deleted: Column) -> DataFrame:
    """Latest entries without those that say a document is deleted."""
    return latest(log).where(~F.coalesce(deleted, F.lit(False)))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows and the old ones that none of them replaces."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def page_update(index: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``index`` with the columns' new values where there are any."""
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    return index.join(n, keys, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).drop(*(f"_{c}" for c in columns))


def id_prefixes(chunk_id: Column) -> Column:
    """All that stands before a ``_p`` in a chunk id: the document ids that it may belong to."""
    parts = F.split(chunk_id.cast("string"), "_p")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "_p"))


def without_documents(store: DataFrame, gone: DataFrame) -> DataFrame:
    """A store without the rows of the documents in ``gone(document_id)``, by id or by ``{id}_p`` of the chunk id.

    The prefixes are cut out of the chunk id, so both forms are equi joins; an id may itself hold ``_p``.
    """
    ids = gone.select(F.col("document_id").cast("string").alias("_id")).distinct()
    kept = store.join(ids, store["document_id"].cast("string") == ids["_id"], "left_anti")
    if "chunk_id" not in store.columns:
        return kept
    named = kept.where(F.contains(F.col("chunk_id").cast("string"), F.lit("_p"))).select(F.col("chunk_id").alias("_chunk"), F.explode(id_prefixes(F.col("chunk_id"))).alias("_id"))
    lost = named.join(ids, "_id", "left_semi").select("_chunk").distinct()
    return kept.join(lost, F.col("chunk_id") == F.col("_chunk"), "left_anti")


def deletion_counts(stores: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    """Rows that each store loses with the documents in ``gone``, and all together."""
    ids = gone.select("document_id").distinct()
    out = None
    for name, s in stores.items():
        n = s.join(ids, "document_id", "left_semi").select(F.lit(name).alias("store"))
        out = n if out is None else out.unionByName(n)
    return out.rollup("store").agg(F.count("*").alias("deleted")).withColumn("store", F.coalesce("store", F.lit("all")))


def orphans(entries: DataFrame, others: DataFrame, key: str = "document_id") -> DataFrame:
    return entries.join(others.select(key).distinct(), key, "left_anti")


def orphan_uploads(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files whose name's part before the first ``_`` is no document."""
    return files.withColumn("document_id", F.split_part("name", F.lit("_"), F.lit(1))).join(documents.select(F.col("document_id").cast("string").alias("document_id")).distinct(), "document_id", "left_anti")


def older_versions(entries: DataFrame, by: str, keep: int, *order: Column) -> DataFrame:
    """Entries beyond the newest ``keep`` of each key."""
    return entries.withColumn("version", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("version") > keep)


def status_summary(entries: DataFrame, ready: str, running: list[str], failed: str) -> DataFrame:
    return entries.agg(F.count("*").alias("total"), F.count_if(F.col("status") == ready).alias("ready"), F.count_if(F.col("status").isin(running)).alias("in_progress"), F.count_if(F.col("status") == failed).alias("error"))


def status_report(entries: DataFrame) -> DataFrame:
    return entries.rollup("status").agg(F.count("*").alias("n")).withColumn("status", F.coalesce("status", F.lit("all")))


def kept_within_ttl(log: DataFrame, key: str, seconds: int) -> DataFrame:
    """Entries that are stored: an entry is served for ``seconds`` after it was stored, and not renewed by use.

    One pass over the sorted times of each key, which one key's times must fit into memory for;
    ``streaming.ingest.stored_entries`` keeps one time for each key instead.
    """
    times = log.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("at"), F.col("entry")))).alias("s"))
    kind = "struct<at:bigint,entry:bigint>"
    none = F.array().cast(f"array<{kind}>")

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        new = last.isNull() | (x["at"] - last >= seconds)
        return F.when(new, x["at"]).otherwise(last), F.when(new, F.array(F.struct(x["at"].alias("at"), x["entry"].alias("entry")))).otherwise(none)

    return times.select(key, F.inline(scan(F.col("s"), F.lit(None).cast("bigint"), step, kind)))


def device_search(queries: DataFrame, devices: DataFrame, keywords: DataFrame) -> DataFrame:
    """``query_id, document_id``: devices whose name holds the query, else those whose file name holds a word for it.

    ``keywords(word, english)`` maps words of a query to words of file names.
    """
    from sheetmill.operators.retrieval import containing
    from sheetmill.operators.tagging import occurrences

    rows = devices.select(F.col("document_id").alias("row_id"), F.lower("filename").alias("hay"))

    def held(asked: DataFrame) -> DataFrame:
        return containing(asked.select("needle").distinct(), rows).join(asked, "needle").select("query_id", F.col("row_id").alias("document_id")).distinct()

    direct = held(queries.select("query_id", F.lower("query").alias("needle")))
    rest = queries.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    words = keywords.select("word", F.col("english").alias("tag"))
    mapped = occurrences(rest.select("query_id", F.lower("query").alias("query")), words, "query_id", "query").select("query_id", F.col("tag").alias("needle")).distinct()
    return direct.unionByName(held(mapped))


def index_counts(chunks: DataFrame, postings: DataFrame, tables: DataFrame, **more: DataFrame) -> DataFrame:
    """``document_id`` and ``chunk_count``, ``posting_count``, ``table_count`` (and one of each of ``more``), 0 where a document has none.

    A row counts once, or as often as its ``n`` says where there is one.
    """
    outputs = {"chunk": chunks, "posting": postings, "table": tables, **more}
    all_of = None
    for name, df in outputs.items():
        n = F.col("n").cast("long") if "n" in df.columns else F.lit(1).cast("long")
        rows = df.select("document_id", F.lit(name).alias("_output"), n.alias("n"))
        all_of = rows if all_of is None else all_of.unionByName(rows)
    return all_of.groupBy("document_id").agg(*(F.sum(F.when(F.col("_output") == name, F.col("n")).otherwise(0)).alias(f"{name}_count") for name in outputs))
