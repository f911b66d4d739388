"""Call trees: spans that name their parent, rolled up by pointer jumping.

Every span points at an ancestor, first at its parent. In a round each span hands what it has
gathered to the one it points at, and then points twice as far up; so a tree of any
shape is rolled up in the logarithm of its depth rounds, each of two joins of equal keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.session import staged_count

#: Rounds after which parents are taken to go in a circle: a tree would be 2**ROUNDS deep.
ROUNDS = 40


def ended_once(ends: DataFrame, order: str = "seq") -> DataFrame:
    """The first end of every (trace_id, span_id), whatever else was sent for it later."""
    named = [c for c in ends.columns if c not in ("trace_id", "span_id")]
    first = ends.groupBy("trace_id", "span_id").agg(F.min_by(F.struct(*named), F.struct(order, *named)).alias("first"))
    return first.select("trace_id", "span_id", "first.*")


def self_times(spans: DataFrame) -> DataFrame:
    """``spans`` (trace_id, span_id, parent_id, latency_ms) with self_ms: what a span's children leave of its time, 0 at least.

    A parent that is not in the trace is none: its span is a root. Calls of a span follow one another.
    """
    inner = spans.where("parent_id is not null").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("latency_ms").alias("__inner"))
    own = F.greatest(F.lit(0.0), F.coalesce("latency_ms", F.lit(0.0)) - F.coalesce("__inner", F.lit(0.0)))
    known = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("__known"))
    rows = spans.join(inner, ["trace_id", "span_id"], "left").join(known, ["trace_id", "parent_id"], "left")
    return rows.select("trace_id", "span_id", F.when(F.col("__known"), F.col("parent_id")).alias("parent_id"), "latency_ms", own.alias("self_ms"))


def rolled_up(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, parent_id, depth, self_ms, subtree_ms, n_spans, path_ms, last_id, critical.

    ``subtree_ms`` and ``n_spans`` are of a span and all below it, ``path_ms`` is the longest way
    down from it by self time, which ends at ``last_id`` (the smaller id on ties), and ``critical`` tells the spans on
    the longest way of all from a root of the trace. span_id is a number, one row each (see ``ended_once``);
    spans without time count 0. Parents that go in a circle raise.
    """
    start = self_times(spans).select("trace_id", "span_id", "parent_id", F.col("parent_id").alias("up"), "self_ms", F.lit(0).cast("long").alias("depth"), F.col("self_ms").alias("climb"),
        F.col("self_ms").alias("subtree_ms"), F.lit(1).cast("long").alias("n_spans"), F.struct(F.col("self_ms").alias("ms"), (-F.col("span_id")).alias("last")).alias("best"))
    state, _ = staged_count(start.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "spans")
    for _ in range(ROUNDS):
        moving = state.where("up is not null")
        # what those that point at a span hand it: all below them, and the longest way down through them
        way = F.struct((F.col("climb") - F.col("self_ms") + F.col("best.ms")).alias("ms"), F.col("best.last").alias("last"))
        handed = moving.groupBy("trace_id", F.col("up").alias("span_id")).agg(F.sum("subtree_ms").alias("h_ms"), F.sum("n_spans").alias("h_n"), F.max(way).alias("h_best"))
        above = state.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("a_up"), F.col("climb").alias("a_climb"), F.col("depth").alias("a_depth"))
        through = F.struct((F.col("self_ms") + F.col("h_best.ms")).alias("ms"), F.col("h_best.last").alias("last"))
        new = state.join(handed, ["trace_id", "span_id"], "left").join(above, ["trace_id", "up"], "left").select(
            "trace_id", "span_id", "parent_id", F.col("a_up").alias("up"), "self_ms", (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"),
            (F.col("climb") + F.coalesce("a_climb", F.lit(0.0))).alias("climb"), (F.col("subtree_ms") + F.coalesce("h_ms", F.lit(0.0))).alias("subtree_ms"),
            (F.col("n_spans") + F.coalesce("h_n", F.lit(0))).alias("n_spans"), F.greatest("best", F.when(F.col("h_best").isNotNull(), through)).alias("best"))
        state, _ = staged_count(new, "spans")
        if state.where("up is not null").isEmpty():
            break
    else:
        raise ValueError("the parents of some spans go in a circle")
    ends = state.where("parent_id is null").groupBy("trace_id").agg((-F.max("best")["last"]).alias("end_id"))
    last = -F.col("best.last")
    return state.join(ends, "trace_id").select("trace_id", "span_id", "parent_id", "depth", "self_ms", "subtree_ms", "n_spans", F.col("best.ms").alias("path_ms"), last.alias("last_id"), (last == F.col("end_id")).alias("critical"))
