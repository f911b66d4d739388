"""Costs and times of traced calls, and their copy in another service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.operators.evals import nearest_rank

#: Kinds of calls that are billed.
PRICED = ("generation", "embedding", "rerank")


def trace_cost(calls: DataFrame) -> DataFrame:
    """trace_id, cost_usd: null if a billed call has no cost, else the sum."""
    unknown = F.coalesce(F.max(F.col("kind").isin(*PRICED) & F.col("cost_usd").isNull()), F.lit(False))
    return calls.groupBy("trace_id").agg(F.when(~unknown, F.coalesce(F.sum("cost_usd"), F.lit(0.0))).alias("cost_usd"))


def all_or_nothing(value: Column, made: Column) -> Column:
    """An aggregate, or null as soon as one row has no value."""
    return F.when(F.count(value) == F.count(F.lit(1)), made)


def step_times(calls: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """trace_id and the summed latency of each kind (0 if none), in one row."""
    return calls.groupBy("trace_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("latency_ms"))), F.lit(0.0)).alias(k) for k in kinds])


def step_percentiles(times: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """kind, p50, p95 over traces."""
    long = times.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("ms")) for k in kinds])).alias("x")).select("x.*")
    return nearest_rank(long, "kind", "ms", (50, 95))


#: Kinds of calls whose tokens are compared, and kinds of outside records that have tokens and a cost.
TOKEN_KINDS = ("generation", "embedding")
OUTSIDE_KINDS = ("GENERATION", "EMBEDDING")
#: Dollars by which a stored and an outside cost may differ.
TOLERANCE = 0.0001


def stored_totals(calls: DataFrame) -> DataFrame:
    """trace_id, input_tokens, output_tokens, cost_usd: tokens of generations and embeddings, the cost of the whole trace."""
    counted = lambda c: F.coalesce(F.sum(F.when(F.col("kind").isin(*TOKEN_KINDS), F.col(c))), F.lit(0)).alias(c)
    unknown = F.coalesce(F.max(F.col("kind").isin(*PRICED) & F.col("cost_usd").isNull()), F.lit(False))
    return calls.groupBy("trace_id").agg(counted("input_tokens"), counted("output_tokens"), F.when(~unknown, F.coalesce(F.sum("cost_usd"), F.lit(0.0))).alias("cost_usd"))


def outside_totals(records: DataFrame) -> DataFrame:
    """trace_id, input_tokens, output_tokens, cost_usd of another service's records (type, total_cost, cost_detail).

    Generations and embeddings count, however their type is spelled; a record's cost is its total,
    or the total among its details, or 0. A trace of other records has zeros.
    """
    priced = F.coalesce(F.upper("type").isin(*OUTSIDE_KINDS), F.lit(False))
    counted = lambda made, name: F.coalesce(F.sum(F.when(priced, made)), F.lit(0)).alias(name)
    return records.groupBy("trace_id").agg(counted(F.col("input_tokens"), "input_tokens"), counted(F.col("output_tokens"), "output_tokens"), counted(F.coalesce("total_cost", "cost_detail", F.lit(0.0)), "cost_usd"))


def differences(stored: DataFrame, outside: DataFrame, tolerance: float = TOLERANCE, traced: bool = True) -> DataFrame:
    """qid, trace_id, problem, stored, seen: every way in which a question's trace differs outside; none for one that matches.

    ``stored`` has qid, trace_id and totals, ``outside`` trace_id and totals. Problems are
    ``untraced`` (no trace id was stored, where the run was ``traced``), ``missing`` (no such trace
    outside), ``input tokens``, ``output tokens`` and ``cost``. Where the stored cost is unknown, only tokens are
    compared. Traces that nobody stored are no problem.
    """
    o = outside.select("trace_id", *[F.col(c).alias(f"o_{c}") for c in ("input_tokens", "output_tokens", "cost_usd")], F.lit(True).alias("there"))
    both = stored.join(o, "trace_id", "left")
    found = lambda fault, name, c: F.when(fault, F.struct(F.lit(name).alias("problem"), *[(F.col(x) if x else F.lit(None)).cast("double").alias(y) for x, y in ((c, "stored"), (c and f"o_{c}", "seen"))]))
    gone = F.col("trace_id").isNotNull() & F.col("there").isNull()
    here = F.col("there").isNotNull()
    differs = lambda c: here & (F.coalesce(c, F.lit(0)) != F.col(f"o_{c}"))
    faults = (
        found(F.col("trace_id").isNull() & F.lit(traced), "untraced", None),
        found(gone, "missing", None),
        found(differs("input_tokens"), "input tokens", "input_tokens"),
        found(differs("output_tokens"), "output tokens", "output_tokens"),
        found(here & (F.abs(F.col("cost_usd") - F.col("o_cost_usd")) > tolerance), "cost", "cost_usd"),
    )
    return both.select("qid", "trace_id", F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("x")).select("qid", "trace_id", "x.*")


def verification(stored: DataFrame, problems: DataFrame) -> DataFrame:
    """checked, without_cost, problems, failed: how many questions were compared, how many by tokens only, how many lines and questions differ."""
    told = stored.agg(F.count("trace_id").alias("checked"), F.count_if(F.col("trace_id").isNotNull() & F.col("cost_usd").isNull()).alias("without_cost"))
    lines = problems.agg(F.count("*").alias("problems"), F.count_distinct("qid").alias("failed"))
    return told.join(F.broadcast(lines), F.lit(True))  # one row each


def reconcile(stored: DataFrame, outside: DataFrame, tolerance: float = TOLERANCE, traced: bool = True) -> DataFrame:
    """qid, status: ``match``, or a question's problems in the order of ``differences``, joined by commas."""
    order = F.array(*map(F.lit, ("untraced", "missing", "input tokens", "output tokens", "cost")))
    named = differences(stored, outside, tolerance, traced).groupBy("qid").agg(F.array_sort(F.collect_set(F.struct(F.array_position(order, F.col("problem")).alias("at"), "problem"))).alias("found"))
    return stored.select("qid").distinct().join(named, "qid", "left").select("qid", F.coalesce(F.array_join(F.transform("found", lambda x: x["problem"]), ","), F.lit("match")).alias("status"))
