"""The corpus as tables: documents, pages and chunks, with replace semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.operators.intervals import points_in_ranges

#: Columns of the corpus tables.
DOCUMENTS = "id bigint, edition int, title string, source_url string, sha256 string, page_count int, ingested_at timestamp"
PAGES = "document_id bigint, page_number int, text string"
CHUNKS = "document_id bigint, chunk_set string, ordinal int, page_start int, page_end int, section string, text string, embedding array<float>"


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Creates the tables where they are missing; chunks are laid out by document and chunk set."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns, layout in (("documents", DOCUMENTS, ""), ("pages", PAGES, ""), ("chunks", CHUNKS, "PARTITIONED BY (document_id, chunk_set)")):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet {layout}")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replaces the chunk sets that ``chunks`` holds, and no others, in a folder of Parquet files."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id", "chunk_set").parquet(path)


def upsert(current: DataFrame, changes: DataFrame, key: str, fixed: tuple[str, ...] = (), order: list[str] | None = None) -> DataFrame:
    """Rows of ``current`` with those of ``changes`` in their place; columns ``fixed`` keep the old value.

    Of several changes of one key the last in ``order`` counts (by default in all of its columns), as if
    they were made one after the other; its fixed columns keep the value of the first.
    """
    by = order or [c for c in changes.columns if c != key]
    named = F.struct(*[c for c in changes.columns if c != key])
    once = changes.groupBy(key).agg(F.max_by(named, F.struct(*by)).alias("last"), F.min_by(named, F.struct(*by)).alias("first"))
    last = once.select(key, *[F.col(f"{'first' if c in fixed else 'last'}.{c}").alias(c) for c in changes.columns if c != key])
    old = current.select(key, *[F.col(c).alias(f"__{c}") for c in fixed])
    new = last.join(old, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in fixed}).select(current.columns)
    return current.join(changes.select(key), key, "left_anti").select(current.columns).unionByName(new)


def replace_set(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in the place of all rows of ``current`` that share its ``keys``."""
    return current.join(new.select(keys).distinct(), keys, "left_anti").select(current.columns).unionByName(new.select(current.columns))


def page_chunks(chunks: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks that cover each asked (key, page); other columns of ``pages`` come along."""
    asked = pages.distinct() if set(pages.columns) == {key, "page"} else pages
    return points_in_ranges(asked, chunks, [key], "page", "page_start", "page_end")


def health(documents: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks in scope of each source."""
    return documents.select(key, "source").join(chunks.select(key, "ordinal"), key).groupBy("source").agg(F.count("*").alias("n_chunks"))


def hash_matches(rows: DataFrame, text: str, pin: str) -> DataFrame:
    """Rows with ``verified``: whether the SHA-256 of a text is the pinned one."""
    return rows.withColumn("verified", F.coalesce(F.sha2(F.col(text), 256) == F.col(pin), F.lit(False)))
