"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetmill.llm.kneser_ney import cross_validated

    return cross_validated(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetmill.llm.url_filter import judged

    return judged(table(spark, sf_dir, "pages"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetmill.llm.template_decontam import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the rows whose crc32 modulo 4 is 2 are held out."""
    from sheetmill.llm.common import fold
    from sheetmill.llm.toxicity import fit, scores

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold(labels["doc_id"], 4) != 2), "toxic")
    out = scores(docs, model)
    return out.select("doc_id", (fold(out["doc_id"], 4) == 2).alias("held_out"), "score", "predicted")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetmill.llm.suffix_dedup import report

    return report(table(spark, sf_dir, "documents"))


def op6_onebit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from sheetmill.llm.onebit_ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetmill.llm.token_counts import token_report

    return token_report(table(spark, sf_dir, "documents"), tokenizer())


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetmill.llm.probminhash import report

    return report(table(spark, sf_dir, "documents"))


def op9_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the rows whose crc32 modulo 5 is 0 are held out."""
    from sheetmill.llm.common import fold
    from sheetmill.llm.rule_quality import fit, scores

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold(labels["doc_id"], 5) != 0), "quality")
    out = scores(docs, model)
    return out.select("doc_id", (fold(out["doc_id"], 5) == 0).alias("held_out"), "score", "predicted")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetmill.llm.wfst_pieces import piece_digest

    return piece_digest(table(spark, sf_dir, "documents"), tokenizer())


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetmill.llm.license_scan import report

    return report(table(spark, sf_dir, "documents"))


def op12_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetmill.llm.ptolemaic_clusters import report

    return report(table(spark, sf_dir, "embeddings"))


def op13_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheetmill.llm.gnat_codes import report

    return report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP6_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    from sheetmill.llm import gnat_codes, license_scan, ptolemaic_clusters

    return {"op6_onebit_ann": OP6_SQL, "op11_license_scan": license_scan.twin(), "op12_ptolemaic_clusters": ptolemaic_clusters.twin(), "op13_gnat_codes": gnat_codes.twin()}
