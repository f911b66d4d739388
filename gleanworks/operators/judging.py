"""Verdicts of a judge as rows: their numbering, the metrics made of them, and scoring passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.operators.intervals import points_in_ranges
from gleanworks.operators.ledger import ask_once
from gleanworks.session import staged

#: Metrics that a judge scores, and those of them that need an answer.
JUDGED = ("context_recall", "context_precision", "faithfulness", "answer_relevance")
NEED_ANSWER = ("faithfulness", "answer_relevance")
ATTEMPTS = 2


def numbering(verdicts: DataFrame, asked: DataFrame) -> DataFrame:
    """qid, attempt, problem: null where a list of verdicts is numbered 1 to n, once each, in any order.

    ``verdicts`` has qid, attempt and index, ``asked`` qid and n. A list without verdicts for
    n > 0 has no row: nothing was replied.
    """
    lists = verdicts.groupBy("qid", "attempt").agg(F.count("*").alias("given"), F.count_distinct("index").alias("different"), F.min("index").alias("low"), F.max("index").alias("high"))
    fault = (
        F.when((F.col("low") < 1) | (F.col("high") > F.col("n")), "out of range")
        .when(F.col("different") < F.col("given"), "repeated")
        .when(F.col("given") < F.col("n"), "missing")
    )
    return lists.join(asked, "qid").select("qid", "attempt", fault.alias("problem"))


def accepted_attempts(numbered: DataFrame) -> DataFrame:
    """qid, attempt, error: the first attempt without a problem, of two at most; else an error."""
    tried = numbered.where(F.col("attempt") <= ATTEMPTS)
    good = F.min(F.when(F.col("problem").isNull(), F.col("attempt")))
    return tried.groupBy("qid").agg(good.alias("attempt"), F.max_by("problem", "attempt").alias("last")).select("qid", "attempt", F.when(F.col("attempt").isNull(), F.col("last")).alias("error"))


def supported_share(verdicts: DataFrame, questions: DataFrame, name: str) -> DataFrame:
    """qid and the share of supported sentences or claims; null for a question that has none."""
    shares = verdicts.groupBy("qid").agg(F.avg(F.col("supported").cast("int")).alias(name))
    return questions.select("qid").join(shares, "qid", "left")


def applicable(answerable: Column, failed: Column, answered: Column) -> Column:
    """The judged metrics that apply to a question, as an array.

    None to an unanswerable question or one whose retrieval failed; without an answer, only
    those that judge what was retrieved.
    """
    every = F.array(*map(F.lit, JUDGED))
    retrieval = F.array(*[F.lit(m) for m in JUDGED if m not in NEED_ANSWER])
    return F.when(~answerable | failed, F.array().cast("array<string>")).when(answered, every).otherwise(retrieval)


def skip_reason(answerable: Column, failed: Column) -> Column:
    return F.when(~answerable, "unanswerable").when(failed, "retrieval failed")


def pending(questions: DataFrame, scored: DataFrame) -> DataFrame:
    """The questions that a scoring pass has yet to score: those without a row in ``scored``, or one with an error."""
    done = scored.where("error is null").select("qid").distinct()
    return questions.join(done, "qid", "left_anti")


def cleared(scored: DataFrame, again: DataFrame) -> DataFrame:
    """``scored`` without the questions of ``again``: what a pass that scores anew starts from."""
    return scored.join(again.select("qid").distinct(), "qid", "left_anti")


def scoring_pass(questions: DataFrame, judge: Callable[[dict], str], ledger: str, scorer: dict[str, str], columns: list[str], workers: int = 1, per_second: float | None = None) -> DataFrame:
    """``questions`` with value and error of a judge: saved question by question, so that a pass that is stopped goes on.

    ``scorer`` names the judge, its prompts and what else makes its scores: another scorer scores anew,
    and no two passes' scores stand side by side. A question that failed is asked again by the next pass.
    """
    name = "\n".join(f"{k}={v}" for k, v in sorted(scorer.items()))
    return ask_once(questions, judge, ledger, name, columns, workers, per_second)


def refusals(runs: DataFrame, passages: DataFrame, golden: str) -> DataFrame:
    """run_id, refusal: runs that can't be scored, by passages without text or another golden set.

    ``runs`` has run_id and golden_sha256, ``passages`` run_id, qid and text.
    """
    bare = passages.where("text is null").groupBy("run_id").agg(F.count_distinct("qid").alias("bare"))
    why = F.when(F.col("bare") > 0, "passages without text").when(~F.col("golden_sha256").eqNullSafe(F.lit(golden)), "another golden set")
    return runs.join(bare, "run_id", "left").select("run_id", why.alias("refusal")).where("refusal is not null")


def scorer_changes(before: DataFrame, now: dict[str, str]) -> DataFrame:
    """run_id, changed: the names of what differs between a run's stored scorer and this one; runs without a scorer have none."""
    names = [F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(c)) for c, v in sorted(now.items())]
    known = F.coalesce(*[F.col(c) for c in sorted(now)]).isNotNull()
    changed = F.filter(F.array(*names), lambda x: x.isNotNull())
    return before.where(known).select("run_id", changed.alias("changed")).where(F.size("changed") > 0)


def judge_tokens(scored: DataFrame, by: str = "run_id") -> DataFrame:
    """by, input_tokens, output_tokens of ``detail``, a JSON column; what is missing counts 0."""
    number = lambda c: F.coalesce(F.sum(F.coalesce(F.get_json_object("detail", f"$.judge_{c}").try_cast("bigint"), F.lit(0))), F.lit(0))
    return scored.groupBy(by).agg(number("input_tokens").alias("input_tokens"), number("output_tokens").alias("output_tokens"))


def answer_metrics(questions: DataFrame, citations: DataFrame, covering: DataFrame) -> DataFrame:
    """qid, cited_page_hit, abstention_correct.

    ``questions`` has qid, answerable, answered and found (what the answer says of itself);
    ``citations`` qid and the pages of what the answer cites (page_start, page_end), and
    ``covering`` qid and page: the pages that count. A question without an answer has neither
    metric, an unanswerable one only the second.
    """
    met = points_in_ranges(covering.select("qid", "page").distinct(), citations.select("qid", "page_start", "page_end"), ["qid"], "page", "page_start", "page_end")
    cited = met.select("qid").distinct().withColumn("hit", F.lit(1.0))
    joined = questions.join(cited, "qid", "left")
    return joined.select(
        "qid",
        F.when(F.col("answerable") & F.col("answered"), F.coalesce("hit", F.lit(0.0))).alias("cited_page_hit"),
        F.when(F.col("answered"), (F.col("found") == F.col("answerable")).cast("double")).alias("abstention_correct"),
    )


# ------------------------------------------------------------------ runs

MEANS = {
    "page_hit": "page_hit",
    "page_recall": "page_recall",
    "mrr": "reciprocal_rank",
    "cited_page_hit": "cited_page_hit",
    "abstention_accuracy": "abstention_correct",
    "context_recall": "context_recall",
    "context_precision": "context_precision",
    "faithfulness": "faithfulness",
    "answer_relevance": "answer_relevance",
}


def run_report(scores: DataFrame, by: str = "config") -> DataFrame:
    """The numbers of each run: counts, means of what metrics apply to, verdicts, costs and times.

    ``scores`` has a row per question: answerable, answered, the metrics of ``MEANS``, verdict
    and, of its trace, cost_usd, latency_ms, generations, tool_calls, fallback and
    rerank_skipped. Serving numbers are all or nothing: null as soon as a question has no
    trace or no cost. Percentiles are nearest ranks.
    """
    from gleanworks.operators.evals import nearest_rank

    scores = staged(scores, "scores")  # read by the report and by the ranks
    whole = F.count_if(F.col("cost_usd").isNull() | F.col("latency_ms").isNull()) == 0
    serving = lambda made: F.when(whole, made)
    report = scores.groupBy(by).agg(
        F.count("*").alias("questions"),
        F.count_if("answerable").alias("answerable"),
        F.count_if("answered").alias("answered"),
        *[F.avg(metric).alias(name) for name, metric in MEANS.items()],
        F.count_if(F.col("verdict") == "pass").alias("manual_passes"),
        F.count("verdict").alias("manual_reviewed"),
        serving(F.avg("cost_usd")).alias("cost_per_query_usd"),
        serving(F.max("latency_ms")).alias("max_latency_ms"),
        serving(F.avg("generations")).alias("generations_per_query"),
        serving(F.avg("tool_calls")).alias("tool_calls_per_query"),
        serving(F.count_if("fallback")).alias("fallbacks"),
        serving(F.count_if("rerank_skipped")).alias("reranks_skipped"),
    )
    ranks = nearest_rank(scores, by, "latency_ms", (50, 95))
    known = F.col("max_latency_ms").isNotNull()
    return report.join(ranks, by, "left").select(*report.columns, F.when(known, F.col("p50")).alias("p50_latency_ms"), F.when(known, F.col("p95")).alias("p95_latency_ms"))


def selected(questions: DataFrame, only: DataFrame | None, key: str = "qid") -> DataFrame:
    """The questions named in ``only`` (all for None); a name that no question has raises."""
    if only is None:
        return questions
    unknown = [r[0] for r in only.select(key).join(questions, key, "left_anti").limit(20).collect()]
    if unknown:
        raise ValueError(f"no such questions: {sorted(unknown)}")
    return questions.join(only.select(key).distinct(), key, "left_semi")


def unpriced(models: DataFrame, prices: DataFrame) -> DataFrame:
    """The (variable, model) rows that a run calls and that have no price: it must not start with any."""
    return models.where("model is not null").join(prices.select("model"), "model", "left_anti").select("variable", "model")


def overlaid(base: DataFrame, overrides: DataFrame, key: str = "config") -> DataFrame:
    """Settings of each configuration: the override where it has one, else the base row's value."""
    names = [c for c in base.columns if c != key]
    given = overrides.select(key, *[F.col(c).alias(f"o_{c}") for c in names])
    return given.join(F.broadcast(base.select(*names).limit(1)), F.lit(True)).select(key, *[F.coalesce(f"o_{c}", c).alias(c) for c in names])  # one base row


def in_order(name: Column, first: tuple[str, ...]) -> list[Column]:
    """Sort keys: the names of ``first`` as they stand there, then the rest by name."""
    place = F.array_position(F.array(*map(F.lit, first)), name)
    return [F.when(place > 0, place).otherwise(len(first) + 1), name]


# ------------------------------------------------------------------ small expressions


def numbered_lines(items: Column) -> Column:
    """``1. first`` and so on, an item to a line, white space collapsed."""
    from gleanworks.functions.text import collapse

    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), collapse(x))), "\n")


def numbered_passages(texts: Column) -> Column:
    """Each passage in a tag with its number; a line of its own where there is none."""
    tagged = F.transform(texts, lambda x, i: F.concat(F.lit('<passage number="'), (i + 1).cast("string"), F.lit('">'), x, F.lit("</passage>")))
    return F.when(F.size(texts) > 0, F.array_join(tagged, "\n\n")).otherwise("(no passages)")


def run_id(config: Column, when: Column) -> Column:
    """``<UTC time>_<configuration>``."""
    return F.concat_ws("_", F.date_format(when, "yyyyMMdd'T'HHmmss'Z'"), config)


def list_or_json(text: Column) -> Column:
    """A list written as JSON text; null for anything else."""
    return F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>")


def fingerprint(parts: Column) -> Column:
    """The SHA-256 of strings joined end to end."""
    return F.sha2(F.array_join(parts, ""), 256)


def tool_contexts(calls: Column) -> Column:
    """The outputs of an array of (name, output, error) calls that went well, as passages."""
    return F.transform(F.filter(calls, lambda c: c["error"].isNull() & c["output"].isNotNull()), lambda c: c["output"])


def database_label(url: Column) -> Column:
    """``host:port/name`` of a connection string, without its credentials."""
    part = lambda i: F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^:/?#]*)(?::(\d+))?/?([^?#]*)", i)
    filled = lambda c, spare: F.when(c == "", F.lit(spare)).otherwise(c)
    return F.concat(F.lower(filled(part(1), "localhost")), F.lit(":"), filled(part(2), "5432"), F.lit("/"), part(3))


#: What a fault may hit, how, and which error codes mean "not now".
FAULT = r"^(chat|embedding|rerank):(timeout|unavailable)(:once)?$"
TIMEOUT_CODES = ("ModelTimeoutException",)
UNAVAILABLE_CODES = (
    "ThrottlingException",
    "ServiceUnavailableException",
    "InternalServerException",
    "ModelNotReadyException",
    "ModelErrorException",
    "BadGatewayException",
    "DependencyFailedException",
)


def fault(text: Column) -> Column:
    """(target, fault, once, valid) of a fault as it is written; a blank one is valid and names nothing."""
    own = F.trim(text)
    some = own.rlike(FAULT)
    part = lambda i: F.when(some, F.regexp_extract(own, FAULT, i))
    return F.struct(part(1).alias("target"), part(2).alias("fault"), (part(3) == ":once").alias("once"), (some | (own == "")).alias("valid"))


#: Failures of a call before any reply, by the name of what is raised.
TIMEOUT_ERRORS = ("ReadTimeoutError", "ConnectTimeoutError", "TimeoutError")
UNAVAILABLE_ERRORS = (
    "HTTPClientError", "ConnectionError", "ConnectionClosedError", "EndpointConnectionError", "ProxyConnectionError", "SSLError", "ResponseStreamingError",
    "ConnectionResetError", "ConnectionRefusedError", "ConnectionAbortedError", "BrokenPipeError",
)


def error_class(code: Column, raised: Column | None = None) -> Column:
    """timeout, unavailable or request: only the first two are worth another model.

    ``raised`` names what was raised where there was no reply with a code: it is looked at first.
    """
    by_code = F.when(code.isin(*TIMEOUT_CODES), "timeout").when(code.isin(*UNAVAILABLE_CODES), "unavailable").otherwise("request")
    if raised is None:
        return by_code
    return F.when(raised.isin(*TIMEOUT_ERRORS), "timeout").when(raised.isin(*UNAVAILABLE_ERRORS), "unavailable").otherwise(by_code)


def raised_name(error: Column) -> Column:
    """What was raised, of an error as ``call_model`` records it; null for another text."""
    return F.nullif(F.regexp_extract(error, r"^([A-Za-z_][A-Za-z0-9_.]*): ", 1), F.lit(""))


def response_problems(results: DataFrame, asked: DataFrame) -> DataFrame:
    """qid, problem: re-ranking replies that hold a position out of range (from 0), one twice, or a score that is no number."""
    wrong = (
        F.when(F.max((F.col("index") < 0) | (F.col("index") >= F.col("n")) | F.col("index").isNull()), "position out of range")
        .when(F.count_distinct("index") < F.count("*"), "position repeated")
        .when(F.max(F.col("score").isNull() | F.isnan("score")), "score is no number")
    )
    return results.join(asked, "qid").groupBy("qid").agg(wrong.alias("problem")).where("problem is not null")
