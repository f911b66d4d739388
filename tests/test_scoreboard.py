"""Scoreboard tables on hand-made runs."""

from gleanworks.operators import scoreboard

REPORT = (
    "config string, page_hit double, manual_passes long, manual_reviewed long, answered long, context_recall double, context_precision double, faithfulness double, answer_relevance double,"
    " page_recall double, mrr double, cited_page_hit double, abstention_accuracy double, cost_per_query_usd double, p50_latency_ms double, p95_latency_ms double, max_latency_ms double,"
    " generations_per_query double, tool_calls_per_query double, fallbacks long, reranks_skipped long"
)


def cells(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_headline_and_what_is_behind_it(spark):
    full = ("a", 0.8125, 3, 4, 5, 0.125, 0.5, None, 1.0, 0.5, 0.333333, 0.25, 1.0, 0.04645, 950.0, 12_350.0, 20_000.0, 1.0, 0.5, 2, 1)
    bare = ("b", None, 0, 0, 0, *[None] * 16)
    report = spark.createDataFrame([full, bare], REPORT)
    assert cells(scoreboard.headline(report)) == {"a": ("81.2%", "75.0% (4 reviewed)", "0.12", "0.50", "—", "1.00", "$0.0465", "12.4 s"), "b": ("—",) * 8}
    assert cells(scoreboard.secondary(report)) == {"a": ("50.0%", "25.0%", "100.0%", "0.33", "4 of 5"), "b": ("—",) * 5}
    configs = spark.createDataFrame([("a", True, None), ("b", False, "r")], "config string, traced boolean, reranker string")
    assert cells(scoreboard.serving(report, configs)) == {"a": ("$0.0465", "1.0 s", "12.4 s", "20.0 s", "1.00", "0.50", "2", "—")}


def test_types(spark):
    rows = [("a", "lookup", 1.0), ("a", "lookup", 0.5), ("a", "table", None), ("a", "unanswerable", 1.0), ("b", "table", 0.0)]
    df = spark.createDataFrame(rows, "config string, type string, page_hit double")
    assert cells(scoreboard.by_type(df, "page_hit")) == {"a": ("75.0% (2)", "—", "—"), "b": ("—", "0.0% (1)", "—")}
    assert cells(scoreboard.by_type(df, "page_hit", scoreboard.score))["a"][0] == "0.75 (2)"


def test_movement_goes_by_the_first_passage_that_covers(spark):
    questions = spark.createDataFrame([("r", q, [q], q != 5) for q in range(1, 6)], "config string, qid int, expected array<int>, answerable boolean")
    hits = spark.createDataFrame(
        [("r", 1, 1, 9, 1, 1), ("r", 1, 2, 1, 1, 1), ("r", 2, 3, 2, 1, 4), ("r", 3, 1, 1, 50, 60), ("r", 4, 2, 20, 77, 78), ("r", 5, 1, 9, 5, 5)],
        "config string, qid int, rank int, fused_rank int, page_start int, page_end int",
    )
    golden = spark.createDataFrame([(4, [4], {4: [78]}), (3, [3], {})], "qid int, expected array<int>, alternates map<int,array<int>>")
    assert [tuple(r) for r in scoreboard.movement(questions, hits, golden).collect()] == [("r", 2, 1, 1, 4)]


def test_steps_of_whole_runs_only(spark):
    times = [("a", 100.0, 300.0, 0.0, 400.0), ("a", 200.0, 100.0, 50.0, 400.0), ("a", 0.0, 0.0, 0.0, 0.0), ("b", None, None, None, None), ("b", 1.0, 1.0, 1.0, 3.0), ("c", 50.0, 50.0, 0.0, 100.0)]
    df = spark.createDataFrame(times, "config string, retriever double, generation double, tools double, whole_ms double")
    configs = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "config string, tools boolean")
    assert cells(scoreboard.steps(df, configs)) == {"a": ("0.1 s", "0.2 s", "0.1 s", "0.3 s", "0.0 s", "0.1 s", "25.0%"), "c": ("0.1 s", "0.1 s", "0.1 s", "0.1 s", "—", "—", "50.0%")}


def test_tools_called_and_not(spark):
    calls = spark.createDataFrame([("a", "q1", "window", None), ("a", "q1", "window", "bad"), ("a", "q2", "window", None), ("a", "q2", "made-up", "no such tool"), ("z", "q1", "window", None)], "config string, qid string, tool string, error string")
    questions = spark.createDataFrame([("a", "q1"), ("a", "q2"), ("a", "q3"), ("z", "q1")], "config string, qid string")
    offered = spark.createDataFrame([("a", "window"), ("a", "figures")], "config string, tool string")
    assert sorted(map(tuple, scoreboard.tools(calls, questions, offered).collect())) == [
        ("a", "(neither tool)", "1", "q3", "—", "—"), ("a", "figures", "0", "—", "0", "0"), ("a", "made-up", "1", "q2", "1", "1"), ("a", "window", "2", "q1, q2", "3", "1")]


def test_a_whole_document(spark):
    runs = spark.createDataFrame(
        [("a", "2026-01-01", "r1", "hybrid", "0123456789", True, 3, 2026, "f" * 64, "g"), ("a", "2026-01-02", "r2", "hybrid", "0123456789", True, 3, 2026, "f" * 64, "g"), ("b", "2026-01-01", "r3", None, "", None, 4, 2026, "e" * 64, "g")],
        "config string, created_at string, run_id string, mode string, commit string, dirty boolean, golden_count int, edition int, corpus_sha256 string, golden_sha256 string",
    )
    latest = scoreboard.latest_runs(runs)
    assert {r.config: r.run_id for r in latest.collect()} == {"a": "r2", "b": "r3"}
    made = cells(scoreboard.provenance(latest, ["mode"]))
    assert made == {"a": ("hybrid", "0123456 (dirty)", "r2"), "b": ("—", "—", "r3")}
    told = scoreboard.comparable(latest).first()
    assert (told.rows, told.comparable, told.golden_count, told.sha256) == (2, False, 3, "f" * 12)
    questions = spark.createDataFrame([("a", "r2", "boom"), ("a", "r2", None), ("b", "r3", None)], "config string, run_id string, error string")
    report = spark.createDataFrame([("z", "1"), ("b", "2"), ("a", "3")], "config string, page_hit string")
    text = scoreboard.document("Scoreboard", ["Golden set: 3 questions"], {"Headline": report, "Nothing": report.where("false"), "Rows": scoreboard.provenance(latest, ["mode"])}, {"Rows": "A note."}, scoreboard.failures(questions), ["z"])
    assert text.splitlines()[6:9] == ["| config | page_hit |", "|---|---|", "| z | 1 |"] and "Nothing" not in text and "A note." in text
    assert text.rstrip().endswith("`a`: 1 question of run r2 failed and scored nothing.")
