"""Documents into a corpus: checks that cost little first, then cutting, embedding and replacing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.operators.models import Embedder, embed
from gleanworks.operators.sections import CHUNKERS
from gleanworks.session import staged
from gleanworks.sources.store import hash_matches, replace_set


class IngestError(ValueError):
    """Why nothing was written."""


def vector_widths(chunks: DataFrame) -> DataFrame:
    """width, n: how many stored embeddings have each width; one width is what a corpus may have."""
    return chunks.where("embedding is not null").groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"))


def ingest(pages: DataFrame, pins: DataFrame, chunk_set: str, embedder: Embedder, current: DataFrame, width: int) -> DataFrame:
    """The chunks of ``current`` with those of ``pages`` in the place of the same documents' chunk set.

    ``pages`` has doc_id, page and text; ``pins`` doc_id, text and the pinned sha256. An unknown
    chunk set, a document whose hash differs, and an embedder whose vectors differ from
    ``width`` or from those stored raise before anything is cut. Running it again with the same
    pages gives the same chunks.
    """
    if chunk_set not in CHUNKERS:
        raise IngestError(f"no such chunk set: {chunk_set}; there are {', '.join(sorted(CHUNKERS))}")
    made = len(embedder([""])[0])
    if made != width:
        raise IngestError(f"the embedder gives vectors of {made}, the corpus holds {width}")
    other = [r["width"] for r in vector_widths(current).where(F.col("width") != width).limit(5).collect()]
    if other:
        raise IngestError(f"the corpus holds vectors of {other} besides {width}")
    wrong = [r["doc_id"] for r in hash_matches(pins, "text", "sha256").where("not verified").limit(20).collect()]
    if wrong:
        raise IngestError(f"documents that are not what their hash says: {wrong}")
    chunks = staged(CHUNKERS[chunk_set](pages).withColumn("chunk_id", F.concat_ws(":", "doc_id", "ordinal")), "chunks")
    vectors = embed(chunks, embedder, key="chunk_id")
    new = chunks.join(vectors, "chunk_id").withColumn("chunk_set", F.lit(chunk_set)).select(current.columns)
    return replace_set(current, new, ["doc_id", "chunk_set"])


def scoped(rows: DataFrame, **values) -> DataFrame:
    """The rows of one document, chunk set or whatever else is named; filters that reach the scan."""
    for name, value in values.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def sets_stored(documents: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, stored: whether a document has any chunk of the set; one page without chunks is no missing set."""
    return documents.select(key).join(chunks.select(key).distinct().withColumn("has", F.lit(True)), key, "left").select(key, F.coalesce("has", F.lit(False)).alias("stored"))


def corpus_pins(editions: DataFrame, documents: DataFrame, key: str = "edition") -> DataFrame:
    """Each asked edition's document id and hash; an edition that no document has raises."""
    unknown = [r[0] for r in editions.select(key).join(documents, key, "left_anti").limit(20).collect()]
    if unknown:
        raise LookupError(f"no document of the editions {sorted(unknown)}")
    return editions.select(key).join(documents.select(key, "doc_id", "sha256"), key)
