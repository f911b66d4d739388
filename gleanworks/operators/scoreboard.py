"""The tables of a scoreboard: a row for each configuration, every cell a text, a dash where nothing was measured.

Tables are DataFrames over question rows, reports, traces and runs; only ``document`` brings their few
rows to the driver, as Markdown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.functions.text import written
from gleanworks.operators import evals
from gleanworks.operators.judging import in_order
from gleanworks.session import staged

DASH = "—"
#: Types of questions that have an answer, in the order of the tables.
TYPES = ("lookup", "table", "multi_section")
#: The line of a configuration's questions that called no tool.
NO_TOOL = "(neither tool)"


def even(value: Column, places: int, after: str = "") -> Column:
    """A number to so many places, halves to the even digit, or a dash."""
    return F.coalesce(F.concat(F.bround(value.cast("double"), places).cast(f"decimal(38,{places})").cast("string"), F.lit(after)), F.lit(DASH))


def percentage(share: Column) -> Column:
    return even(share * 100, 1, "%")


def score(value: Column) -> Column:
    return even(value, 2)


def money(dollars: Column) -> Column:
    return written(dollars, 4, before="$")


def seconds(ms: Column) -> Column:
    return written(ms / 1000, 1, after=" s")


def dashed(cell: Column) -> Column:
    return F.coalesce(cell.cast("string"), F.lit(DASH))


def latest_runs(runs: DataFrame, by: str = "config") -> DataFrame:
    """The newest run of each configuration, by created_at and then run_id."""
    return evals.latest(runs, by, ["created_at", "run_id"])


def headline(report: DataFrame) -> DataFrame:
    """config and the headline cells of ``judging.run_report`` rows."""
    reviewed = F.col("manual_reviewed")
    passed = F.when(reviewed > 0, F.concat(percentage(F.col("manual_passes") / reviewed), F.lit(" ("), reviewed.cast("string"), F.lit(" reviewed)")))
    scores = [score(F.col(c)).alias(c) for c in ("context_recall", "context_precision", "faithfulness", "answer_relevance")]
    return report.select("config", percentage(F.col("page_hit")).alias("page_hit"), dashed(passed).alias("manual_pass"), *scores, money(F.col("cost_per_query_usd")).alias("cost"), seconds(F.col("p95_latency_ms")).alias("p95_latency"))


def secondary(report: DataFrame) -> DataFrame:
    """config and the cells of the metrics behind the headline."""
    reviewed = F.when(F.col("answered") > 0, F.concat_ws(" of ", F.col("manual_reviewed").cast("string"), F.col("answered").cast("string")))
    return report.select("config", *[percentage(F.col(c)).alias(c) for c in ("page_recall", "cited_page_hit", "abstention_accuracy")], score(F.col("mrr")).alias("mrr"), dashed(reviewed).alias("reviewed"))


def by_type(questions: DataFrame, metric: str, cell=percentage, types: Sequence[str] = TYPES) -> DataFrame:
    """config and a cell for each type of (config, type, metric) rows: the mean, and of how many questions; null scores take no part."""
    own = lambda t: F.when(F.col("type") == t, F.col(metric))
    told = lambda t: F.when(F.count(own(t)) > 0, F.concat(cell(F.avg(own(t))), F.lit(" ("), F.count(own(t)).cast("string"), F.lit(")")))
    return questions.groupBy("config").agg(*[dashed(told(t)).alias(t) for t in types])


def movement(questions: DataFrame, hits: DataFrame, golden: DataFrame, top_k: int = 5) -> DataFrame:
    """config, lifted, already, missing, answerable: what re-ranking did to the first passage that covers an expected page.

    ``questions`` has config, qid, expected and answerable of re-ranked runs, ``hits`` config, qid, rank,
    fused_rank, page_start and page_end of what they stored, ``golden`` qid, expected and alternates. A question
    without a golden item goes by its own pages.
    """
    asked = questions.where("answerable")
    pages = evals.golden_pages(asked.select("qid", "expected").dropDuplicates(["qid"]), golden).select("qid", "satisfies").distinct()
    met = evals.points_in_ranges(pages, hits.select("config", "qid", "rank", "fused_rank", "page_start", "page_end"), ["qid"], "satisfies", "page_start", "page_end")
    first = met.groupBy("config", "qid").agg(F.min_by(F.struct("fused_rank"), "rank").alias("first"))
    joined = asked.select("config", "qid").join(first, ["config", "qid"], "left")
    was = F.col("first.fused_rank")
    lifted, gone = F.count_if(was > top_k), F.count_if(F.col("first").isNull())
    return joined.groupBy("config").agg(lifted.alias("lifted"), (F.count("*") - lifted - gone).alias("already"), gone.alias("missing"), F.count("*").alias("answerable"))


def serving(report: DataFrame, configs: DataFrame) -> DataFrame:
    """config and the cells of cost and latency, of the ``configs`` (config, traced, reranker) with a trace."""
    kept = report.join(configs.where("traced").select("config", "reranker"), "config")
    return kept.select(
        "config", money(F.col("cost_per_query_usd")).alias("mean_cost"), *[seconds(F.col(f"{c}_latency_ms")).alias(f"{c}_latency") for c in ("p50", "p95", "max")],
        score(F.col("generations_per_query")).alias("generations"), score(F.col("tool_calls_per_query")).alias("tool_calls"), dashed(F.col("fallbacks")).alias("fallbacks"),
        dashed(F.when(F.col("reranker").isNotNull(), F.col("reranks_skipped"))).alias("reranks_skipped"))


def steps(times: DataFrame, configs: DataFrame) -> DataFrame:
    """config and cells of the time by step, of configurations whose every question has a trace.

    ``times`` has a row for each question: config, retriever, generation and tools in ms, whole_ms, all null without
    a trace; ``configs`` has config and tools (whether tools were offered). Percentiles are nearest ranks.
    """
    told = staged(times, "times")
    whole = told.groupBy("config").agg((F.count("whole_ms") == F.count("*")).alias("whole")).where("whole").select("config")
    share = F.when(F.col("whole_ms") > 0, F.col("generation") / F.col("whole_ms"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("double").alias("v")) for k, v in (("retriever", F.col("retriever")), ("generation", F.col("generation")), ("tools", F.col("tools")), ("share", share))])
    long = told.join(whole, "config", "left_semi").select("config", F.inline(kinds)).select(F.struct("config", "kind").alias("of"), "v")
    ranks = evals.nearest_rank(long, "of", "v", (50, 95)).select("of.config", "of.kind", "p50", "p95")
    cells = ranks.groupBy("config").agg(*[F.max(F.when(F.col("kind") == k, F.col(p))).alias(f"{k}_{p}") for k in ("retriever", "generation", "tools", "share") for p in ("p50", "p95")])
    offered = lambda c: F.when(F.col("tools"), c).otherwise(F.lit(DASH))
    return whole.join(cells, "config").join(configs.select("config", "tools"), "config").select(
        "config", *[seconds(F.col(f"{k}_{p}")).alias(f"{k}_{p}") for k in ("retriever", "generation") for p in ("p50", "p95")],
        *[offered(seconds(F.col(f"tools_{p}"))).alias(f"tools_{p}") for p in ("p50", "p95")], percentage(F.col("share_p50")).alias("generation_share"))


def tools(calls: DataFrame, questions: DataFrame, offered: DataFrame) -> DataFrame:
    """config, tool, questions, which, calls, errors: a line for each tool, called or not, and one for the questions that called none.

    ``calls`` has config, qid, tool and error of tool calls, ``questions`` the (config, qid) that have a trace,
    ``offered`` the (config, tool) pairs that a run offered. ``which`` lists a run's own questions.
    """
    used = calls.groupBy("config", "tool", "qid").agg(F.count("*").alias("n"), F.count("error").alias("failed"))
    told = used.groupBy("config", "tool").agg(F.count("*").alias("questions"), F.array_join(F.array_sort(F.collect_list(F.col("qid").cast("string"))), ", ").alias("which"), F.sum("n").alias("calls"), F.sum("failed").alias("errors"))
    of = offered.select("config").distinct()
    lines = offered.join(told, ["config", "tool"], "full_outer").join(of, "config", "left_semi")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string").alias(c)
    lines = lines.select("config", "tool", number("questions"), dashed(F.col("which")).alias("which"), number("calls"), number("errors"))
    idle = questions.join(of, "config", "left_semi").join(used.select("config", "qid").distinct(), ["config", "qid"], "left_anti")
    none = of.join(idle.groupBy("config").agg(F.count("*").alias("questions"), F.array_join(F.array_sort(F.collect_list(F.col("qid").cast("string"))), ", ").alias("which")), "config", "left")
    return lines.unionByName(none.select("config", F.lit(NO_TOOL).alias("tool"), number("questions"), dashed(F.col("which")).alias("which"), F.lit(DASH).alias("calls"), F.lit(DASH).alias("errors")))


def provenance(runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """config, commit (with ``dirty`` behind it), run and ``columns``: what made each row."""
    commit = F.concat(dashed(F.substring(F.nullif(F.col("commit"), F.lit("")), 1, 7)), F.when(F.coalesce("dirty", F.lit(False)), F.lit(" (dirty)")).otherwise(F.lit("")))
    return runs.select("config", *[dashed(F.col(c)).alias(c) for c in columns], commit.alias("commit"), F.col("run_id").alias("run"))


def failures(questions: DataFrame) -> DataFrame:
    """config, run_id, failed: the runs with questions that failed, and so scored nothing."""
    return questions.groupBy("config", "run_id").agg(F.count("error").alias("failed")).where("failed > 0")


def comparable(runs: DataFrame) -> DataFrame:
    """rows, comparable, golden_count, edition, sha256: whether all runs had one corpus and golden set, and those of the newest."""
    newest = F.max_by(F.struct("golden_count", "edition", F.substring("corpus_sha256", 1, 12).alias("sha256")), F.struct("created_at", "run_id"))
    return runs.agg(F.count("*").alias("rows"), (F.count_distinct("corpus_sha256", "golden_sha256") <= 1).alias("comparable"), newest.alias("n")).select("rows", "comparable", "n.*")


def document(title: str, header: Sequence[str], tables: dict[str, DataFrame], notes: dict[str, str] | None = None, failed: DataFrame | None = None, first: Sequence[str] = ()) -> str:
    """Markdown of tables under headings, configurations of ``first`` first; a table without rows is left out, but for the first one."""
    from gleanworks.sources.runs import markdown

    parts = [f"# {title}", *header]
    for k, (name, table) in enumerate(tables.items()):
        rest = [c for c in table.columns if c == "tool"]
        made = markdown(table.orderBy(*in_order(F.col("config"), tuple(first)), *rest))
        if k and made.count("\n") < 2:
            continue
        parts += [f"## {name}", made, *([notes[name]] if notes and name in notes else [])]
    for row in failed.orderBy("config").collect() if failed is not None else []:  # a row for each run
        parts.append(f"`{row.config}`: {row.failed} question{'s' if row.failed > 1 else ''} of run {row.run_id} failed and scored nothing.")
    return "\n\n".join(parts) + "\n"
