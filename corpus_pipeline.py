"""A corpus pipeline of five stages, each of which works on all that the one before it kept.

Defined results of every stage: a null text counts as empty and stays null where the row stays; an
empty table gives an empty table; whole texts are read, however long. The first four return the
columns of their input, further ones included, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetmill.llm import probminhash, rule_quality, suffix_dedup, template_decontam, wfst_pieces
from sheetmill.llm.common import checkpointed
from sheetmill.llm.queries import table, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go; it learns from all labels.

    A score equal to the threshold stays; repeated rows are judged alike.
    """
    model = rule_quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality")
    return rule_quality.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the least doc_id, a null after all others.

    Of rows that repeat id and text, one stays; all empty texts are one class.
    """
    return probminhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated stretches are taken out of the texts, at every place; a text of 200 bytes or more that repeats whole becomes empty."""
    return suffix_dedup.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, by id and text: clean rows of the same or a null id stay."""
    return template_decontam.without_matches(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document that is left, one row for each, an empty text having none."""
    return wfst_pieces.piece_digest(docs, tokenizer())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

#: Near-duplicates, repeated stretches and pieces are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what a stage leaves is written down before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
