import pytest
from pyspark.sql import functions as F

from gleanworks.operators import judging, models
from gleanworks.sources import ingest, store


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_verdicts_are_numbered_one_to_n_in_any_order(spark):
    lists = {(1, 1): [2, 1, 3], (2, 1): [1, 1, 2], (2, 2): [1, 2], (3, 1): [0, 1], (3, 2): [1], (4, 1): [1, 2, 4], (5, 1): [1, 3, 3], (5, 3): [1, 2, 3]}
    verdicts = rows(spark, [(q, a, i) for (q, a), own in lists.items() for i in own], "qid int, attempt int, index int")
    numbered = judging.numbering(verdicts, rows(spark, [(1, 3), (2, 2), (3, 2), (4, 3), (5, 3)], "qid int, n int"))
    got = {(r.qid, r.attempt): r.problem for r in numbered.collect()}
    assert got == {(1, 1): None, (2, 1): "repeated", (2, 2): None, (3, 1): "out of range", (3, 2): "missing", (4, 1): "out of range", (5, 1): "repeated", (5, 3): None}
    accepted = {r.qid: (r.attempt, r.error) for r in judging.accepted_attempts(numbered).collect()}
    assert accepted == {1: (1, None), 2: (2, None), 3: (None, "missing"), 4: (None, "out of range"), 5: (None, "repeated")}


def test_shares_and_answer_metrics(spark):
    verdicts = rows(spark, [(1, True), (1, False), (2, False)], "qid int, supported boolean")
    got = {r.qid: r.recall for r in judging.supported_share(verdicts, rows(spark, [(1,), (2,), (3,)], "qid int"), "recall").collect()}
    assert got == {1: 0.5, 2: 0.0, 3: None}
    questions = rows(spark, [(1, True, True, True), (2, True, True, False), (3, False, True, False), (4, True, False, None)], "qid int, answerable boolean, answered boolean, found boolean")
    citations = rows(spark, [(1, 4, 6), (2, 1, 1), (3, 5, 5)], "qid int, page_start int, page_end int")
    covering = rows(spark, [(1, 6), (2, 2)], "qid int, page int")
    got = {r.qid: tuple(r)[1:] for r in judging.answer_metrics(questions, citations, covering).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (None, 1.0), 4: (None, None)}


def test_scoring_passes_resume_and_refuse(spark):
    questions = rows(spark, [(1,), (2,), (3,)], "qid int")
    scored = rows(spark, [(1, None), (2, "judge failed")], "qid int, error string")
    assert sorted(r.qid for r in judging.pending(questions, scored).collect()) == [2, 3]
    assert [r.qid for r in judging.cleared(scored, questions.where("qid = 1")).collect()] == [2]
    told = questions.select("qid", judging.applicable(F.col("qid") != 1, F.col("qid") == 4, F.col("qid") == 3).alias("m"))
    assert {r.qid: len(r.m) for r in told.collect()} == {1: 0, 2: 2, 3: 4}
    runs = rows(spark, [("a", "x"), ("b", "y"), ("c", None), ("d", "x")], "run_id string, golden_sha256 string")
    passages = rows(spark, [("a", 1, None), ("a", 2, "t"), ("b", 1, "t"), ("d", 1, "t")], "run_id string, qid int, text string")
    got = {r.run_id: r.refusal for r in judging.refusals(runs, passages, "x").collect()}
    assert got == {"a": "passages without text", "b": "another golden set", "c": "another golden set"}
    before = rows(spark, [("a", "j", "p"), ("b", "k", "p"), ("c", None, None)], "run_id string, judge string, prompts string")
    assert [(r.run_id, r.changed) for r in judging.scorer_changes(before, {"judge": "j", "prompts": "p"}).collect()] == [("b", ["judge"])]
    detail = rows(spark, [("a", '{"judge_input_tokens": 3}'), ("a", None), ("a", "no json")], "run_id string, detail string")
    assert tuple(judging.judge_tokens(detail).first()) == ("a", 3, 0)


def test_report_numbers_are_all_or_nothing(spark):
    columns = "config string, answerable boolean, answered boolean, " + ", ".join(f"{m} double" for m in judging.MEANS.values()) + ", verdict string, cost_usd double, latency_ms double, generations int, tool_calls int, fallback boolean, rerank_skipped boolean"
    own = [("a", True, True, *[1.0] * 9, "pass", 0.1 * k, 1000.0 * k, 1, 2, k == 1, False) for k in (1, 2, 3, 10)]
    other = [("b", False, False, *[None] * 9, None, None, 5.0, 1, 0, False, False), ("b", True, True, *[0.5] * 9, "fail", 1.0, 6.0, 1, 0, False, False)]
    got = {r.config: r for r in judging.run_report(rows(spark, own + other, columns)).collect()}
    assert (got["a"].p50_latency_ms, got["a"].p95_latency_ms, got["a"].max_latency_ms, got["a"].fallbacks, got["a"].tool_calls_per_query) == (2000.0, 10000.0, 10000.0, 1, 2.0)
    assert got["b"].cost_per_query_usd is None and got["b"].p50_latency_ms is None and got["b"].page_hit == 0.5 and got["b"].manual_reviewed == 1


def test_runs_are_selected_priced_and_overlaid(spark):
    questions = rows(spark, [(1, "a"), (2, "b")], "qid int, question string")
    assert judging.selected(questions, None).count() == 2 and judging.selected(questions, questions.where("qid = 2")).first().question == "b"
    with pytest.raises(ValueError, match="9"):
        judging.selected(questions, rows(spark, [(9,), (1,)], "qid int"))
    models_used = rows(spark, [("LLM", "m1"), ("RERANKER", None), ("EMBEDDING", "m2")], "variable string, model string")
    assert [tuple(r) for r in judging.unpriced(models_used, rows(spark, [("m1",)], "model string")).collect()] == [("EMBEDDING", "m2")]
    base, over = rows(spark, [(5, "x")], "top_k int, mode string"), rows(spark, [("a", 9, None), ("b", None, "y")], "config string, top_k int, mode string")
    assert sorted(tuple(r) for r in judging.overlaid(base, over).collect()) == [("a", 9, "x"), ("b", 5, "y")]
    named = rows(spark, [("z",), ("b",), ("a",), ("first",)], "name string")
    assert [r.name for r in named.orderBy(*judging.in_order(F.col("name"), ("first", "b"))).collect()] == ["first", "b", "a", "z"]


def test_small_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(judging.numbered_lines(F.array(F.lit("a  b"), F.lit("c")))) == "1. a b\n2. c"
    assert value(judging.numbered_passages(F.array().cast("array<string>"))) == "(no passages)"
    assert value(judging.list_or_json(F.lit('["a","b"]'))) == ["a", "b"] and value(judging.list_or_json(F.lit("plain"))) is None
    assert value(judging.database_label(F.lit("postgresql://me:pw@db.example:6543/main?x=1"))) == "db.example:6543/main"
    assert tuple(value(judging.fault(F.lit("chat:timeout:once")))) == ("chat", "timeout", True, True)
    assert value(judging.fault(F.lit("chat:nothing")))["valid"] is False and value(judging.fault(F.lit("  ")))["valid"] is True
    replies = rows(spark, [(1, 0, 0.5), (1, 1, 0.1), (2, 0, 0.1), (2, 0, 0.2), (3, 5, 0.1), (4, 0, None)], "qid int, index int, score double")
    got = {r.qid: r.problem for r in judging.response_problems(replies, rows(spark, [(q, 2) for q in (1, 2, 3, 4)], "qid int, n int")).collect()}
    assert got == {2: "position repeated", 3: "position out of range", 4: "score is no number"}


def test_ingest_checks_first_and_replaces(spark):
    pages = rows(spark, [(1, 1, "one two"), (1, 2, "three"), (2, 1, "four")], "doc_id long, page int, text string")
    pins = rows(spark, [(1, "a"), (2, "b")], "doc_id long, text string").withColumn("sha256", F.sha2("text", 256))
    current = rows(spark, [(1, "fixed-220w", 7, "old", [0.5, 0.5]), (1, "other", 0, "kept", [0.5, 0.5]), (3, "fixed-220w", 0, "kept", None)], "doc_id long, chunk_set string, ordinal int, text string, embedding array<float>")
    embedder = models.hash_embedder(2)
    got = ingest.ingest(pages, pins, "fixed-220w", embedder, current, 2).collect()
    assert sorted((r.doc_id, r.chunk_set, r.ordinal, r.text) for r in got) == [(1, "fixed-220w", 0, "one two three"), (1, "other", 0, "kept"), (2, "fixed-220w", 0, "four"), (3, "fixed-220w", 0, "kept")]
    for wrong in ((pages, pins, "none", embedder, current, 2), (pages, pins, "fixed-220w", models.hash_embedder(3), current, 2), (pages, pins, "fixed-220w", models.hash_embedder(3), current, 3), (pages, pins.withColumn("text", F.lit("z")), "fixed-220w", embedder, current, 2)):
        with pytest.raises(ingest.IngestError):
            ingest.ingest(*wrong)
    assert [(r.doc_id, r.stored) for r in ingest.sets_stored(pins, ingest.scoped(current, chunk_set="other")).orderBy("doc_id").collect()] == [(1, True), (2, False)]
    with pytest.raises(LookupError):
        ingest.corpus_pins(rows(spark, [(9,)], "edition int"), pins.withColumn("edition", F.lit(1)))


def test_corpus_tables_are_made_and_rewritten(spark, tmp_path):
    store.create_tables(spark, "corpus_test")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN corpus_test").collect()} == {"documents", "pages", "chunks"}
    store.create_tables(spark, "corpus_test")
    assert spark.table("corpus_test.chunks").columns[-2:] == ["document_id", "chunk_set"]


def test_failures_without_a_reply_have_a_class(spark):
    rows = [("ReadTimeoutError: no bytes", None), ("ConnectionClosedError: gone", None), ("ClientError: x", "ThrottlingException"), ("ClientError: x", "ValidationException"), ("TimeoutError: t", "ValidationException"), ("no name here", None), (None, "ModelTimeoutException")]
    df = spark.createDataFrame(rows, "error string, code string")
    got = [r[0] for r in df.select(judging.error_class(df.code, judging.raised_name(df.error))).collect()]
    assert got == ["timeout", "unavailable", "unavailable", "request", "timeout", "request", "timeout"]
