"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage but the last takes and returns the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.llm import langid, mixing, neardup, packing, toxicity
from gleanworks.session import ship_package, staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; learned from those with a lang."""
    return langid.keep_identified(docs, langid.fit_languages(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5; learned from those with a label."""
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8); of repeated rows, one.

    Rows that repeat an id with different texts are one document: they stay or go together. Of
    rows with the same id and text the one whose other columns come first in order stays, nulls first.
    """
    judged = staged(neardup.near_duplicates(docs), "judged").where("doc_id is not null")
    gone = judged.where("not kept").select("doc_id").distinct()
    repeated = judged.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = docs.join(gone.unionByName(repeated), "doc_id", "left_anti")
    others = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])
    again = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(others).alias("first")).select("doc_id", "text", "first.*")
    return once.select(docs.columns).unionByName(again.select(docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled, or repeated, to the target weights of sources, languages and topics."""
    return mixing.copied(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(packing.pieces_of(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("toxicity", clean),
    ("near_duplicates", distinct_texts),
    ("mixing", mixed),
    ("packing", packed),
]
#: No stage but mixing is SQL; tests/llm checks every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
