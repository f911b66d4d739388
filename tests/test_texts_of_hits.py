"""Re-ranking and prompts: texts that many questions share are shuffled once, and rows of one key stay apart."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleanworks.operators import retrieval


def shuffled(spark):
    return sum(f.stat().st_size for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))


def ranking(spark, questions, ids):
    return spark.createDataFrame([(q, d, r) for q in questions for r, d in enumerate(ids, 1)], "qid long, doc_id long, rank int").withColumn("score", 1.0 / F.col("rank"))


def test_shared_texts_are_not_shuffled_for_each_question(spark):
    """Six texts of 60 kB that each of 200 questions finds: 72 MB as pairs."""
    draw = random.Random(2)
    bodies = spark.createDataFrame([(d, " ".join(f"{draw.getrandbits(40):x}" for _ in range(6000)) + (" blue" if d == 4 else "")) for d in range(6)], "doc_id long, text string")
    lex, vec = ranking(spark, range(200), [0, 1, 2, 3, 4]), ranking(spark, range(200), [5, 1, 0])
    asked = spark.createDataFrame([(q, "a blue whale") for q in range(200)], "qid long, question string")
    before = shuffled(spark)
    found = retrieval.search(asked, lex, vec, bodies).collect()
    assert len(found) == 1000 and {(r.doc_id, r.fused_rank) for r in found if r["rank"] == 1} == {(4, 6)}
    assert all(r.text.endswith(" blue") == (r.doc_id == 4) for r in found)
    assert shuffled(spark) - before < 5_000_000


@pytest.mark.parametrize("most", [0, 150, 400, 10**6])
def test_prompts_with_and_without_broadcast_texts(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "SHARED_BYTES", most)
    rows = [(1, "one"), (2, "two"), (2, "two again"), (3, None), (4, ""), (5, "five"), (5, "five")]
    bodies = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [(10, [1, 2]), (11, [3]), (12, [4, 1]), (13, [2, 3, 5]), (14, [1]), (15, [1, 5])]
    hits = spark.createDataFrame([(q, r, d) for q, ids in asked for r, d in enumerate(ids, 1)], "qid long, rank int, doc_id long")
    hits = hits.join(bodies.distinct(), "doc_id").withColumn("body", F.xxhash64("text"))
    got = {r.qid: r.prompt for r in retrieval.prompt(hits, bodies).collect()}
    assert got == {
        10: "[1] one\n\n[2] two\n\n[2] two again", 11: "(no passages)", 12: "[4] \n\n[1] one", 13: "[2] two\n\n[2] two again\n\n[5] five", 14: "[1] one", 15: "[1] one\n\n[5] five",
    }


def test_rows_of_one_key_are_ranked_each_by_its_own_text(spark):
    bodies = spark.createDataFrame([(1, "red"), (1, "blue whale"), (2, "whale"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a blue whale")], "qid long, question string")
    found = retrieval.search(asked, ranking(spark, [7], [3, 1]), ranking(spark, [7], [2, 9]), bodies).orderBy("rank").collect()
    assert [(r.doc_id, r.text, r.rerank_score) for r in found] == [(1, "blue whale", 2.0), (2, "whale", 1.0), (1, "red", 0.0), (3, None, None)]
