import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanworks.functions.stem import stem
from gleanworks.operators import checks, evals, models, retrieval, traces
from gleanworks.operators.components import connected_components


def ranking(spark, ids):
    return spark.createDataFrame([(1, d, r) for r, d in enumerate(ids, 1)], "qid long, doc_id long, rank int")


def test_fusion_prefers_agreement_and_breaks_ties_by_id(spark):
    fused = retrieval.fuse([ranking(spark, [11, 22, 33]), ranking(spark, [44, 22, 55])]).orderBy("fused_rank").collect()
    assert fused[0].doc_id == 22 and [r.doc_id for r in fused[1:3]] == [11, 44]
    tied = retrieval.fuse([ranking(spark, [5, 9]), ranking(spark, [9, 5])]).orderBy("fused_rank").collect()
    assert [r.doc_id for r in tied] == [5, 9]


def test_lexical_search(spark):
    docs = spark.createDataFrame([(1, "Costs of part B, costs!"), (2, "the part"), (3, None), (4, "nothing here")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "What costs part unknownword?"), (2, "the of and")], "qid long, question string")
    found = retrieval.lexical_search(asked, docs).orderBy("qid", "rank").collect()
    assert [(r.qid, r.doc_id, round(r.score, 3)) for r in found] == [(1, 1, 0.3), (1, 2, 0.1)]


def test_stems(spark):
    pairs = {"consistently": "consist", "knives": "knive", "hopping": "hop", "hoping": "hope", "cries": "cri", "ties": "tie", "generously": "generous", "relational": "relat", "happiness": "happi", "sky": "sky", "electricity": "electr"}
    assert {w: stem(w) for w in pairs} == pairs
    docs = spark.createDataFrame([(1, "He was running"), (2, "runs and runs"), (3, "walk")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "run")], "qid long, question string")
    found = retrieval.lexical_search(asked, docs, stems=True).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 3)) for r in found] == [(2, 0.2), (1, 0.1)]


def test_search_reranks_the_shortlist_only_in_hybrid_mode(spark):
    bodies = spark.createDataFrame([(i, "blue whale" if i == 4 else "red") for i in range(1, 6)], "doc_id long, text string")
    lex, vec = (ranking(spark, ids).withColumn("score", 1.0 / F.col("rank")) for ids in ([1, 2, 3, 4, 9], [1, 2, 3, 5]))
    asked = spark.createDataFrame([(1, "a blue whale")], "qid long, question string")
    hybrid = retrieval.search(asked, lex, vec, bodies, top_k=5).orderBy("rank").collect()
    assert hybrid[0].doc_id == 4 and hybrid[0].fused_rank == 4 and len(hybrid) == 5
    lexical = retrieval.search(asked, lex, vec, bodies, mode="lexical", top_k=5).orderBy("rank").collect()
    assert [r.doc_id for r in lexical] == [1, 2, 3, 4] and lexical[0].fused_rank is None


def test_metrics(spark):
    items = spark.createDataFrame([(1, [3, 9], {9: [10]}), (2, [], {}), (3, [99], {})], "qid long, expected array<bigint>, alternates map<bigint,array<bigint>>")
    hits = spark.createDataFrame([(1, 1, 7, 8), (1, 2, 10, 11), (3, 1, 1, 1)], "qid long, rank int, page_start long, page_end long")
    got = {r.qid: tuple(r)[1:] for r in evals.retrieval_metrics(items, hits).collect()}
    assert got == {1: (1.0, 0.5, 0.5), 2: (None, None, None), 3: (0.0, 0.0, 0.0)}


def test_average_precision_and_nearest_rank(spark):
    rows = [(q, r, r in useful) for q, useful in ((1, {1, 3}), (2, {4, 5}), (3, set())) for r in range(1, 6)]
    got = {r.qid: round(r.average_precision, 4) for r in evals.average_precision(spark.createDataFrame(rows, "qid long, rank int, useful boolean")).collect()}
    assert got == {1: 0.8333, 2: 0.325, 3: 0.0}
    values = spark.createDataFrame([("x", float(v)) for v in range(1, 41)], "by string, v double")
    assert tuple(evals.nearest_rank(values, "by", "v", (50, 95)).first())[1:] == (20.0, 38.0)


def test_costs_are_all_or_nothing(spark):
    calls = spark.createDataFrame([(1, "generation", 0.0), (1, "tool", None), (2, "generation", None), (3, "tool", None)], "trace_id long, kind string, cost_usd double")
    assert {r.trace_id: r.cost_usd for r in traces.trace_cost(calls).collect()} == {1: 0.0, 2: None, 3: 0.0}


def test_citations_and_quotes(spark):
    retrieved = spark.createDataFrame([(1, 7, "a b\n c d e f g h")], "qid long, doc_id long, text string")
    cited = spark.createDataFrame([(1, 7, "b  c"), (1, 7, ""), (1, 8, "b")], "qid long, doc_id long, quote string")
    assert sorted((r.doc_id, r.quote, r.known, r.quote_verified) for r in checks.check_citations(cited, retrieved).collect()) == [(7, "", True, False), (7, "b  c", True, True), (8, "b", False, False)]
    quotes = spark.createDataFrame([(1, "b c d e f g"), (2, "c d"), (3, "b c d e f x"), (4, " ")], "item_id long, text string")
    assert sorted(tuple(r) for r in checks.find_quotes(quotes, retrieved).collect()) == [(1, 7), (2, 7)]


def test_quotes_of_any_length_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = [(i, " ".join(rng.choice(list("abcdefg"), int(rng.integers(0, 30))))) for i in range(60)] + [(90, None), (91, "abc  def\nghi"), (92, "")]
    quotes = [(i, " ".join(rng.choice(list("abcdefg"), int(rng.integers(0, 9))))) for i in range(120)] + [(200, "bc def g"), (201, "bc d"), (202, "c"), (203, None)]
    got = checks.find_quotes(spark.createDataFrame(quotes, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string"))
    plain = lambda t: " ".join((t or "").split())
    want = {(i, d) for i, q in quotes for d, t in texts if plain(q) and plain(q) in plain(t)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


@pytest.mark.parametrize("block", [16_384, 7])
def test_vector_search_equals_brute_force_and_skips_odd_vectors(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 6 if i % 9 else 4).astype(float).tolist()) for i in range(150)]
    rows += [(900, None), (901, [0.0] * 6), (902, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (903, [float("nan")] * 6), (904, []), (905, [float("inf")] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = vectors.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "qid")
    got = {}
    for r in retrieval.vector_search(asked, vectors, limit=6, block=block).collect():
        got.setdefault(r.qid, {})[r.rank] = (r.vec_id, round(r.score, 9))
    sound = [(i, np.array(v)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    for q, x in sound:
        if q % 5 == 0:
            scores = [(-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 9), i) for i, y in sound if len(y) == len(x)]
            assert [got[q][k][0] for k in sorted(got[q])] == [i for _, i in sorted(scores)[:6]]
    assert set(got) == {q for q, _ in sound if q % 5 == 0}


def test_nearest_rank_of_large_and_tied_groups_equals_sorting(spark):
    rng = np.random.default_rng(2)
    rows = [("big", float(v)) for v in rng.normal(size=30_000)] + [("tied", float(v)) for v in rng.integers(0, 4, 5000)] + [("few", v) for v in (3.0, 1.0)] + [("one", 7.0), ("none", None)]
    got = {r.by: tuple(r)[1:] for r in evals.nearest_rank(spark.createDataFrame(rows, "by string, v double").repartition(5), "by", "v", (1, 50, 95, 100)).collect()}
    for name in ("big", "tied", "few", "one"):
        own = sorted(v for b, v in rows if b == name)
        assert got[name] == tuple(own[max(1, -(-p * len(own) // 100)) - 1] for p in (1, 50, 95, 100)), name
    assert set(got) == {"big", "tied", "few", "one"}


def test_models_keep_failures_in_their_rows(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "slow"), (3, "bad")], "qid long, question string")

    def model(row):
        if row["question"] == "slow":
            raise TimeoutError("late")
        if row["question"] == "bad":
            raise ValueError("no\nsecond line")
        return row["question"].upper()

    got = {r.qid: (r.value, r.error, r.fallback) for r in models.call_model(rows, model, "qid", ["question"], fallback=lambda row: "spare").collect()}
    assert got == {1: ("OK", None, False), 2: ("spare", None, True), 3: (None, "ValueError: no", False)}


def test_agent_is_forced_after_four_turns(spark):
    rows = spark.createDataFrame([(1, "q")], "qid long, question string")

    def turn(row, results, forced):
        return ([], f"after {len(results)}") if forced else ([("t", {})], None)

    got = models.agent_answers(rows, turn, {"t": lambda a: "x"}).first()
    assert (got.answer, got.turns, got.error) == ("after 4", 5, None)


def test_replies_that_do_not_fit_are_asked_for_once_more(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "mends"), (3, "never")], "qid long, question string")

    def model(row):
        return "ok" if row["question"] == "good" or (row["question"] == "mends" and row.get("problem")) else "bad"

    got = {r.qid: (r.value, r.error) for r in models.call_model(rows, model, "qid", ["question"], check=lambda v: None if v == "ok" else "not ok").collect()}
    assert got == {1: ("ok", None), 2: ("ok", None), 3: (None, "ValueError: two replies that don't fit: not ok")}


def test_agent_sends_early_and_wrong_answers_back(spark):
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(("early", "mends", "never", "silent", "beside"))], "qid long, question string")

    def turn(row, results, forced):
        kind = row["question"]
        if kind == "early":
            return ([("t", {})], "too soon") if not results else ([], "right")
        if kind == "silent":
            return [], None
        if kind == "beside":
            return [("t", {})], "right" if forced else None
        return [], "right" if kind == "mends" and forced else "wrong"

    got = {r.question: r for r in models.agent_answers(rows, turn, {"t": lambda a: "x"}, check=lambda a: None if a == "right" else "wrong one").join(rows, "qid").collect()}
    assert got["early"].answer == "right" and [(c.name, c.error is None) for c in got["early"].calls] == [("answer", False), ("t", True)]
    assert (got["mends"].answer, got["mends"].turns) == ("right", 2)
    assert (got["never"].answer, got["never"].turns, got["never"].error) == (None, 2, "two answers that don't fit: wrong one")
    assert got["silent"].error == "no answer when one was asked for"
    assert got["beside"].answer == "right" and len(got["beside"].calls) == 4


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 2)], "a long, b long")
    assert {r.node: r.component for r in connected_components(links).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


def plain_nearest(asked, vectors, limit):
    out = []
    unit = lambda v: np.array(v) / np.sqrt((np.array(v) ** 2).sum())
    for q, a in asked:
        scored = sorted((-round(float(unit(a) @ unit(v)), 9), k) for k, v in vectors if len(v) == len(a))
        out += [(q, k, rank) for rank, (_, k) in enumerate(scored[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_many_questions_find_the_nearest_vectors(spark, monkeypatch, spread):
    """With a first pass over some vectors, in blocks and tiles, over clusters and over noise, with ties."""
    for name, value in (("SAMPLE_FROM", 10), ("SAMPLE", 4), ("TILE", 7), ("KEPT", 200), ("PIVOTS", 5)):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    points = [(i, (centers[i % 6] + spread * rng.normal(size=8)).round(3).tolist()) for i in range(400)]
    points += [(1000 + i, points[i][1]) for i in range(40)] + [(2000, [0.0] * 8), (2001, [1.0, 2.0]), (2002, None)]
    vectors = spark.createDataFrame(points, "vec_id int, embedding array<double>").repartition(5)
    asked = [(i, points[i][1]) for i in range(0, 400, 9)] + [(7000, [2.0, 4.1])]
    questions = spark.createDataFrame(asked, "qid int, embedding array<double>")
    valid = [(k, v) for k, v in points if v and any(v)]
    for block in (1000, 11):
        got = retrieval.vector_search(questions, vectors, 5, block=block)
        assert sorted((r.qid, r.vec_id, r["rank"]) for r in got.collect()) == plain_nearest(asked, valid, 5)


def test_pivots_save_comparisons_on_clusters_and_lose_nothing():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 16))
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1))[:, None]
    vectors = unit(centers[np.arange(6000) % 20] + 0.05 * rng.normal(size=(6000, 16)))
    questions = vectors[:200]
    best = retrieval.Best(retrieval.Asked(np.arange(200), questions), 10)
    for at in range(0, 6000, 1000):
        best.add(np.arange(at, at + 1000), vectors[at : at + 1000])
        best.narrow()
    assert best.compared < 0.35 * 200 * 6000
    (q, ids, _), order = best.parts[0], np.lexsort((np.broadcast_to(np.arange(6000), (200, 6000)), -np.round(questions @ vectors.T, 9)), axis=1)[:, :10]
    assert (ids.reshape(200, 10) == order).all() and (q == np.repeat(np.arange(200), 10)).all()
