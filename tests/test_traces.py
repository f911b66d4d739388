"""Call trees against a walk in Python; stored traces against another service's, by hand-made cases."""

import random

import pytest

from gleanworks.operators import spans, traces


def walked(rows):
    """(trace, span) -> depth, self, subtree, n, path, last id, critical."""
    by = {(t, s): (p, ms or 0.0) for t, s, p, ms in rows}
    children = {}
    for (t, s), (p, _) in by.items():
        children.setdefault((t, p if (t, p) in by else None), []).append(s)
    own = {(t, s): max(0.0, ms - sum(by[t, c][1] for c in children.get((t, s), []))) for (t, s), (_, ms) in by.items()}
    out = {}

    def go(t, s, depth):
        below = [go(t, c, depth + 1) for c in children.get((t, s), [])]
        best = max([(own[t, s], -s), *((own[t, s] + b["best"][0], b["best"][1]) for b in below)])
        out[t, s] = {"depth": depth, "subtree": own[t, s] + sum(b["subtree"] for b in below), "n": 1 + sum(b["n"] for b in below), "best": best}
        return out[t, s]

    for t in {t for t, _ in by}:
        roots = [go(t, s, 0) for s in children[t, None]]
        end = -max(r["best"] for r in roots)[1]
        for (u, s), o in out.items():
            if u == t:
                o["critical"] = -o["best"][1] == end
    return {k: (o["depth"], own[k], o["subtree"], o["n"], o["best"][0], -o["best"][1], o["critical"]) for k, o in out.items()}


def test_call_trees_equal_a_walk(spark):
    draw = random.Random(3)
    rows = []
    for t in range(6):
        n = draw.choice([1, 2, 9, 40])
        for s in range(1, n + 1):
            parent = None if s == 1 or draw.random() < 0.05 else s - draw.randint(1, min(s - 1, 1 if t == 5 else 4))
            rows.append((t, s, parent, float(draw.randint(0, 64)) if draw.random() < 0.9 else None))
    rows += [(9, s, s - 1 or None, 1.0) for s in range(1, 101)]  # a chain
    rows.append((7, 1, 999, 3.0))  # a parent that nobody sent
    df = spark.createDataFrame(rows, "trace_id int, span_id int, parent_id int, latency_ms double")
    made = {(r.trace_id, r.span_id): (r.depth, r.self_ms, r.subtree_ms, r.n_spans, r.path_ms, r.last_id, r.critical) for r in spans.rolled_up(df).collect()}
    assert made == walked(rows)
    assert spans.rolled_up(df.where("false")).count() == 0


def test_circles_raise(spark, monkeypatch):
    monkeypatch.setattr(spans, "ROUNDS", 6)
    df = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 1, 1.0)], "trace_id int, span_id int, parent_id int, latency_ms double")
    with pytest.raises(ValueError, match="circle"):
        spans.rolled_up(df)


def test_a_span_ends_once(spark):
    df = spark.createDataFrame([(1, 1, 5, "late"), (1, 1, 2, "first"), (1, 2, 9, "only"), (1, 1, 3, "again")], "trace_id int, span_id int, seq int, output string")
    assert sorted(map(tuple, spans.ended_once(df).collect())) == [(1, 1, 2, "first"), (1, 2, 9, "only")]


TOTALS = "trace_id string, input_tokens long, output_tokens long, cost_usd double"


def test_every_difference_is_told(spark):
    stored = spark.createDataFrame(
        [("q1", "t1", 10, 5, 0.01), ("q2", "t2", 10, 5, None), ("q3", "t3", 10, 5, 0.01), ("q4", "t4", 1, 1, 0.0), ("q5", None, 1, 1, 0.0), ("q6", "t6", 7, 3, 0.5), ("q7", "t7", 0, 0, 0.2)],
        f"qid string, {TOTALS}",
    )
    outside = spark.createDataFrame([("t1", 10, 5, 0.01009), ("t2", 10, 5, 9.0), ("t3", 9, 6, 0.02), ("t6", 7, 3, 0.5002), ("t7", 0, 0, 0.2), ("t99", 1, 1, 1.0)], TOTALS)
    found = traces.differences(stored, outside)
    assert sorted((r.qid, r.problem, r.stored, r.seen) for r in found.collect()) == [
        ("q3", "cost", 0.01, 0.02), ("q3", "input tokens", 10.0, 9.0), ("q3", "output tokens", 5.0, 6.0), ("q4", "missing", None, None), ("q5", "untraced", None, None), ("q6", "cost", 0.5, 0.5002)]
    assert tuple(traces.verification(stored, found).first()) == (6, 1, 6, 4)
    assert {r.qid: r.status for r in traces.reconcile(stored, outside).collect()} == {"q1": "match", "q2": "match", "q3": "input tokens,output tokens,cost", "q4": "missing", "q5": "untraced", "q6": "cost", "q7": "match"}
    assert traces.differences(stored, outside, traced=False).where("problem = 'untraced'").count() == 0


def test_totals_of_both_sides(spark):
    calls = spark.createDataFrame(
        [("a", "generation", 10, 4, 0.5), ("a", "embedding", 3, None, 0.1), ("a", "rerank", 99, 99, 0.2), ("a", "tool", 7, 7, None), ("b", "rerank", None, None, None), ("c", "tool", 1, 1, None)],
        "trace_id string, kind string, input_tokens long, output_tokens long, cost_usd double",
    )
    assert sorted(map(tuple, traces.stored_totals(calls).collect())) == [("a", 13, 4, pytest.approx(0.8)), ("b", 0, 0, None), ("c", 0, 0, 0.0)]
    records = spark.createDataFrame(
        [("a", "Generation", 10, 4, 0.5, 9.0), ("a", "EMBEDDING", 3, None, None, 0.1), ("a", "span", 50, 50, 5.0, 5.0), ("b", None, 1, 1, 1.0, 1.0), ("c", "generation", None, None, None, None)],
        "trace_id string, type string, input_tokens long, output_tokens long, total_cost double, cost_detail double",
    )
    assert sorted(map(tuple, traces.outside_totals(records).collect())) == [("a", 13, 4, pytest.approx(0.6)), ("b", 0, 0, 0.0), ("c", 0, 0, 0.0)]
