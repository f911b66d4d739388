"""Queries over the corpus as it is filled and scoped, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanworks.operators import chunking, models, retrieval
from gleanworks.plans.passages import _SEARCH, _WINDOWS, docs, query, questions, windows
from gleanworks.session import table
from gleanworks.sources import ingest


@query(
    "ingest_chunks",
    f"""WITH {_WINDOWS} SELECT doc_id, 'fixed-220w' AS chunk_set, ordinal, page_start, page_end, text, 64 AS width FROM windows WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')
    UNION ALL SELECT doc_id, CASE WHEN lang = 'en' THEN 'older' ELSE 'fixed-220w' END, 0, 1, 1, 'kept', 64 FROM documents WHERE doc_id % 3 = 0""",
)
def ingest_chunks(spark, sf_dir):
    d = docs(spark, sf_dir)
    new = d.where("lang = 'en' and text is not null")
    kept = d.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("lang") == "en", "older").otherwise("fixed-220w").alias("chunk_set"), F.lit(0).alias("ordinal"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("kept").alias("text"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding"))
    pins = new.select("doc_id", "text", F.sha2("text", 256).alias("sha256"))
    chunks = ingest.ingest(chunking.pages_of_text(new, 5), pins, "fixed-220w", models.hash_embedder(), kept, 64)
    return chunks.select("doc_id", "chunk_set", "ordinal", "page_start", "page_end", "text", F.size("embedding").alias("width"))


@query("vector_widths", "SELECT len(embedding)::INT AS width, count(*)::BIGINT AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1")
def vector_widths(spark, sf_dir):
    return ingest.vector_widths(table(spark, sf_dir, "embeddings"))


@query(
    "scoped_search",
    f"""WITH {_SEARCH}, scope AS (SELECT doc_id FROM documents WHERE lang = 'en' AND source = (SELECT min(source) FROM documents)),
    found AS (SELECT qid, doc_id, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM lexical_scores WHERE doc_id IN (SELECT doc_id FROM scope))
    SELECT * FROM found WHERE rank <= 20""",
)
def scoped_search(spark, sf_dir):
    d = docs(spark, sf_dir)
    first = d.agg(F.min("source")).first()[0]
    found = retrieval.lexical_search(questions(spark, sf_dir), ingest.scoped(d, lang="en", source=first))
    return found.withColumn("score", F.round(F.col("score").cast("double"), 6))


@query("chunk_sets_stored", f"WITH {_WINDOWS} SELECT doc_id, doc_id IN (SELECT doc_id FROM windows WHERE ordinal = 0 AND page_end > 1) AS stored FROM documents")
def chunk_sets_stored(spark, sf_dir):
    return ingest.sets_stored(docs(spark, sf_dir), windows(spark, sf_dir).where("ordinal = 0 and page_end > 1"))


@query("corpus_pins", "SELECT doc_id + 2000 AS edition, doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 = 1")
def corpus_pins(spark, sf_dir):
    d = docs(spark, sf_dir).select((F.col("doc_id") + 2000).alias("edition"), "doc_id", F.sha2("text", 256).alias("sha256"))
    return ingest.corpus_pins(d.where("doc_id % 10 = 1").select("edition"), d)
