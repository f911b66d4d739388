"""Word search of many questions against plain counting, in passes and blocks, on odd rows, and what it shuffles."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from gleanworks.operators import retrieval, tally

WORDS = "lake house door stone river field road hill market ship grain wheel plan cost care the of".split()


def plain(asked, docs, limit):
    """(qid, doc_id, n, rank): ids that stand in several rows are one; null comes last among ties."""
    counts, wanted = {}, {}
    for d, text in docs:
        if text is not None:
            counts.setdefault(d, Counter()).update(text.split())
    for q, text in asked:
        wanted.setdefault(q, set()).update(w for w in text.split() if w not in ("the", "of"))
    out = []
    for q, words in wanted.items():
        scored = [(-sum(c[w] for w in words), d is None, d) for d, c in counts.items()]
        out += [(q, d, -n, rank) for rank, (n, _, d) in enumerate(sorted(x for x in scored if x[0])[:limit], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.qid, r.doc_id, round(float(r.score) * 10), r["rank"]) for r in df.collect()), key=str)


def rows(draw, n, words):
    return [(i, " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, words)))) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"FIRST": 5, "TIMES": 3, "BLOCK_PAIRS": 15, "GROUP_PAIRS": 40}, {"FIRST": 5, "TIMES": 2, "REPEATED": 0}])
def test_first_places_equal_plain_counting(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(tally, name, value)
    draw = random.Random(8)
    docs = rows(draw, 150, 40) + [(3, "lake lake house"), (3, "lake"), (None, "ship ship ship"), (None, "grain"), (500, None), (501, "")]
    asked = [(q, text) for q, text in rows(draw, 40, 6)] + [(1, "ship grain"), (900, "the of"), (901, "lake lake"), (902, "nowhere")]
    got = retrieval.lexical_search(spark.createDataFrame(asked, "qid int, question string"), spark.createDataFrame(docs, "doc_id int, text string").repartition(5), 6)
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "int", "double", "int"]
    assert found(got) == plain(asked, docs, 6)


def test_nothing_asked_and_nothing_there(spark):
    docs = spark.createDataFrame([(1, "lake")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "lake"), (2, "the of")], "qid long, question string")
    assert found(retrieval.lexical_search(asked.where("qid = 2"), docs)) == []
    assert found(retrieval.lexical_search(asked, docs.where("false"))) == []
    assert found(retrieval.lexical_search(asked, docs)) == [(1, 1, 1, 1)]


def test_stop_words_have_no_stems(spark):
    docs = spark.createDataFrame([(1, "doing it"), (2, "doings")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "doings")], "qid long, question string")
    assert [r.doc_id for r in retrieval.lexical_search(asked, docs, stems=True).collect()] == [2]


def test_pairs_are_not_shuffled(spark):
    """Each of 3,000 passages matches each of 3,000 questions: nine million pairs."""
    local = Path(spark.conf.get("spark.local.dir"))
    size = lambda: sum(f.stat().st_size for f in local.rglob("shuffle_*.data"))
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('lake house', repeat(' care', cast(id % 7 as int))) as text").repartition(4)
    asked = spark.range(3000).selectExpr("id as qid", "'lake care' as question")
    before = size()
    got = retrieval.lexical_search(asked, docs, 5)
    assert got.where("rank = 1 and doc_id = 6 and score > 0.69").count() == 3000 and got.count() == 15_000
    assert size() - before < 5_000_000


def test_tiles_leave_questions_out_of_reach_unsummed(monkeypatch):
    for name, value in (("TILE", 16), ("SUMMED", 7), ("KEPT", 300)):
        monkeypatch.setattr(tally, name, value)
    rng = np.random.default_rng(3)
    n, n_terms = 600, 50
    counts = rng.poisson(np.where(np.arange(n) % 40 == 0, 9.0, 0.2)[:, None], (n, n_terms))
    pairs = sorted({(int(q), int(t)) for q, t in zip(rng.integers(0, 60, 300), rng.integers(0, n_terms, 300), strict=True)})
    ids, terms = (np.array(c) for c in zip(*pairs, strict=True))
    best = tally.Tally(tally.Questions(ids, terms), n_terms, 5)
    for low in range(0, n, 200):
        part = counts[low : low + 200]
        row, term = np.nonzero(part)
        best.add(np.arange(low, low + 200), np.bincount(row, minlength=200), term, part[row, term])
        best.narrow()
    got = {}
    for q, key, score in zip(best.asked.ids[best.parts[0][0]].tolist(), *(c.tolist() for c in best.parts[0][1:]), strict=True):
        got.setdefault(q, []).append((-score, key))
    for q in set(ids.tolist()):
        scores = counts[:, terms[ids == q]].sum(axis=1)
        assert sorted(got[q]) == sorted((-int(s), k) for k, s in enumerate(scores) if s)[:5]
    assert best.summed < 0.5 * n * len(set(ids.tolist()))
