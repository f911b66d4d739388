import json

import pytest

from gleanworks.sources import runs, store


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, first int")
    new = spark.createDataFrame([(2, "B", 9), (3, "c", 9)], "id long, name string, first int")
    assert sorted(tuple(r) for r in store.upsert(old, new, "id", fixed=("first",)).collect()) == [(1, "a", 1), (2, "B", 2), (3, "c", 9)]
    twice = spark.createDataFrame([(2, "B", 9, 1), (2, "C", 8, 2), (3, "c", 4, 2), (3, "b", 9, 1)], "id long, name string, first int, at int")
    assert sorted(tuple(r) for r in store.upsert(old, twice, "id", ("first",), ["at"]).collect()) == [(1, "a", 1), (2, "C", 2), (3, "c", 9)]
    chunks = spark.createDataFrame([(1, "x", 0), (1, "x", 1), (1, "y", 0)], "id long, chunk_set string, ordinal int")
    again = spark.createDataFrame([(1, "x", 7)], "id long, chunk_set string, ordinal int")
    assert sorted(tuple(r) for r in store.replace_set(chunks, again, ["id", "chunk_set"]).collect()) == [(1, "x", 7), (1, "y", 0)]


def test_write_replaces_only_its_chunk_sets(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "document_id long, chunk_set string, ordinal int")
    path = str(tmp_path / "chunks")
    store.write_chunks(rows((1, "x", 0), (1, "y", 0)), path)
    store.write_chunks(rows((1, "x", 5)), path)
    assert sorted((r.chunk_set, r.ordinal) for r in spark.read.parquet(path).collect()) == [("x", 5), ("y", 0)]


def test_golden_lines(spark, tmp_path):
    good = {"id": "q001", "question": "?", "alt_pages": {"3": [4]}, "expected_pages": [3], "category": "costs", "difficulty": "easy", "type": "lookup"}
    odd = {k: v for k, v in good.items() if k != "type"} | {"extra": 1}
    (tmp_path / "golden.jsonl").write_text(json.dumps(good) + "\n\nnot json\n" + json.dumps(odd) + "\n")
    rows = sorted(runs.read_golden(spark, str(tmp_path / "golden.jsonl")).collect(), key=lambda r: r.line)
    assert [r.line for r in rows] == [1, 3, 4] and rows[0].alt_pages == {3: [4]} and rows[0].problem is None
    assert rows[1].problem.startswith("not a golden question") and rows[2].problem == "unknown fields: extra; missing fields: type"


def test_runs_are_written_one_to_a_file_and_read_in_order(spark, tmp_path):
    made = [{"run_id": r, "created_at": c, "questions": [{"id": "q001"}]} for r, c in (("b", "2026-01-02"), ("c", "2026-01-01"), ("a", "2026-01-02"))]
    for k, run in enumerate(made):
        (tmp_path / f"{k}.json").write_text(json.dumps(run))
    read = runs.read_runs(spark, str(tmp_path))
    assert [r.run_id for r in runs.in_order(read).collect()] == ["c", "a", "b"]
    out = str(tmp_path / "out")
    runs.write_run(read.where("run_id = 'a'"), out)
    assert [r.run_id for r in runs.read_runs(spark, out).collect()] == ["a"]
    with pytest.raises(ValueError):
        runs.write_run(read, out)


def test_large_files_are_split_and_lines_keep_their_numbers(spark, tmp_path):
    item = {"id": "q001", "question": "?", "expected_pages": [3], "category": "costs", "difficulty": "easy", "type": "lookup"}
    wanted = {}
    for name, n in (("a.jsonl", 90), ("b.jsonl", 7)):
        lines = ["" if k % 4 == 3 else json.dumps(item | {"question": "é" * (k % 9), "id": f"q{k:03}"}) for k in range(1, n + 1)]
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if n == 90 else ""))
        wanted |= {(name, k): f"q{k:03}" for k in range(1, n + 1) if k % 4 != 3}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        rows = runs.read_golden(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.file.rsplit("/", 1)[1], r.line): r.id for r in rows} == wanted and len(rows) == len(wanted)
    assert all(r.problem is None for r in rows)


def test_a_failed_write_leaves_the_old_run(spark, tmp_path):
    path = tmp_path / "run.json"
    run = spark.createDataFrame([("r1", 1)], "run_id string, n int")
    assert runs.write_run(run, str(path)) and path.is_file()
    old, at = path.read_text(), path.stat().st_mtime_ns
    assert not runs.write_run(run, str(path)) and path.stat().st_mtime_ns == at
    broken = run.selectExpr("run_id", "cast(raise_error('no') as int) as n")
    with pytest.raises(Exception, match="no"):
        runs.write_run(broken, str(path))
    assert path.read_text() == old
    assert runs.write_run(run.selectExpr("run_id", "n + 1 as n"), str(path)) and json.loads(path.read_text()) == {"run_id": "r1", "n": 2}
    with pytest.raises(ValueError, match="one run"):
        runs.write_run(run.where("false"), str(path))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["run.json"]


def test_scoreboard(spark):
    report = spark.createDataFrame([("b", 0.5), ("z", None), ("a", 1.0)], "config string, page_hit double")
    text = runs.scoreboard(report, ("z",), {"Times": report.where("config = 'a'"), "Nothing": report.where("false")})
    assert text.splitlines()[4:7] == ["| z | — |", "| a | 1.0 |", "| b | 0.5 |"] and "## Times" in text and "Nothing" not in text
    page = "x <!-- board -->\n" + text + "\n<!-- /board -->"
    assert not runs.block_differs(page, "board", text) and runs.block_differs(page, "board", text + "more")


def test_runs_of_an_older_shape_read_as_null(spark, tmp_path):
    question = {"id": "q001", "metrics": {"page_hit": 1.0}, "review": {"verdict": "pass"}}
    other = {"id": "q002", "metrics": {"page_hit": 0.0}, "trace": {"trace_id": "t", "calls": [{"kind": "generation", "cost_usd": 0.5}]}}
    (tmp_path / "a.json").write_text(json.dumps({"run_id": "r", "config": {"name": "hybrid"}, "questions": [question, other]}, indent=1))
    questions = runs.question_rows(runs.read_runs(spark, str(tmp_path)))
    total = runs.run_aggregates(questions).first()
    assert (total.n, total.page_hit, total.faithfulness, total.manual_pass, total.reviewed) == (2, 0.5, None, 1.0, 1)
    assert runs.call_rows(questions).first().cost_usd == 0.5


def test_markdown(spark):
    block = runs.markdown(spark.createDataFrame([("a", None)], "x string, y int"))
    assert block.splitlines() == ["| x | y |", "|---|---|", "| a | — |"]
    assert runs.replace_block("t <!-- b -->old<!-- /b --> u", "b", "new") == "t <!-- b -->\nnew\n<!-- /b --> u"
    with pytest.raises(ValueError):
        runs.replace_block("t", "b", "new")
