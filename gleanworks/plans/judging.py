"""Queries over verdicts, scoring passes and runs, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanworks.functions import calendar
from gleanworks.operators import evals, judging, ledger, retrieval, scoreboard
from gleanworks.plans.analytics import _CALLS, _ITEMS, calls, hits, items
from gleanworks.plans.passages import _SEARCH, ORACLES, _words, docs, query
from gleanworks.session import staging_root, table

# labels as verdicts: ten documents make a question, a document is a sentence of it
_VERDICTS = """
verdicts AS (SELECT doc_id // 10 AS qid, 1 + toxic AS attempt, doc_id % 10 + CASE WHEN doc_id % 70 = 3 THEN -3 ELSE 1 END AS index, quality = 1 AS supported FROM labels),
asked AS (SELECT qid, max(index) AS n FROM verdicts WHERE attempt = 1 GROUP BY qid)"""


def verdicts(spark, sf_dir):
    d = F.col("doc_id")
    index = d % 10 + F.when(d % 70 == 3, -3).otherwise(1)
    return table(spark, sf_dir, "labels").select(F.floor(d / 10).alias("qid"), (1 + F.col("toxic")).alias("attempt"), index.alias("index"), (F.col("quality") == 1).alias("supported"))


def numbered(spark, sf_dir):
    own = verdicts(spark, sf_dir)
    return judging.numbering(own, own.where("attempt = 1").groupBy("qid").agg(F.max("index").alias("n")))


_NUMBERED = f"""{_VERDICTS},
numbered AS (SELECT qid, attempt, CASE WHEN min(index) < 1 OR max(index) > any_value(n) THEN 'out of range' WHEN count(DISTINCT index) < count(*) THEN 'repeated'
  WHEN count(*) < any_value(n) THEN 'missing' END AS problem FROM verdicts JOIN asked USING (qid) GROUP BY qid, attempt)"""


@query("verdict_numbering", f"WITH {_NUMBERED} SELECT qid, attempt, problem FROM numbered")
def verdict_numbering(spark, sf_dir):
    return numbered(spark, sf_dir)


@query(
    "verdict_attempts",
    f"""WITH {_NUMBERED}, best AS (SELECT qid, min(attempt) FILTER (problem IS NULL) AS attempt, arg_max_null(problem, attempt) AS last FROM numbered WHERE attempt <= 2 GROUP BY qid)
    SELECT qid, attempt, CASE WHEN attempt IS NULL THEN last END AS error FROM best""",
)
def verdict_attempts(spark, sf_dir):
    return judging.accepted_attempts(numbered(spark, sf_dir))


def _share(name: str, keep: str) -> str:
    return f"""WITH {_VERDICTS} SELECT DISTINCT q.qid, s.share AS {name} FROM (SELECT DISTINCT doc_id // 10 AS qid FROM documents) AS q
    LEFT JOIN (SELECT qid, round(avg(supported::INT), 9) AS share FROM verdicts WHERE {keep} GROUP BY qid) AS s USING (qid)"""


def _shares(spark, sf_dir, name, keep):
    questions = docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).alias("qid")).distinct()
    return judging.supported_share(verdicts(spark, sf_dir).where(keep), questions, name).withColumn(name, F.round(name, 9))


@query("context_recall", _share("context_recall", "attempt = 1"))
def context_recall(spark, sf_dir):
    return _shares(spark, sf_dir, "context_recall", "attempt = 1")


@query("faithfulness", _share("faithfulness", "index % 2 = 0"))
def faithfulness(spark, sf_dir):
    return _shares(spark, sf_dir, "faithfulness", "index % 2 = 0")


@query(
    "metric_applicability",
    """SELECT doc_id AS qid, CASE WHEN doc_id % 7 = 0 OR n_chars < 30 THEN '' WHEN quality IS NULL THEN 'context_recall,context_precision'
      ELSE 'context_recall,context_precision,faithfulness,answer_relevance' END AS metrics,
    CASE WHEN doc_id % 7 = 0 THEN 'unanswerable' WHEN n_chars < 30 THEN 'retrieval failed' END AS skipped FROM documents LEFT JOIN labels USING (doc_id)""",
)
def metric_applicability(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    answerable, failed = F.col("doc_id") % 7 != 0, F.col("n_chars") < 30
    return rows.select(F.col("doc_id").alias("qid"), F.array_join(judging.applicable(answerable, failed, F.col("quality").isNotNull()), ",").alias("metrics"), judging.skip_reason(answerable, failed).alias("skipped"))


@query(
    "scoring_pending",
    """SELECT doc_id AS qid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)""",
)
def scoring_pending(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), F.when(F.col("toxic") != 0, "failed").alias("error"))
    return judging.pending(docs(spark, sf_dir).select(F.col("doc_id").alias("qid")), scored)


@query("scores_cleared", "SELECT doc_id AS qid, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def scores_cleared(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), "quality")
    return judging.cleared(scored, docs(spark, sf_dir).where("lang = 'en'").select(F.col("doc_id").alias("qid")))


@query(
    "scoring_refusals",
    """SELECT run_id, CASE WHEN bare > 0 THEN 'passages without text' WHEN golden <> 0 THEN 'another golden set' END AS refusal FROM (
      SELECT conv_id AS run_id, conv_id % 3 AS golden, count(*) FILTER (length(text) % 11 = 0) AS bare FROM conversations GROUP BY conv_id) WHERE bare > 0 OR golden <> 0""",
)
def scoring_refusals(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "run_id")
    runs = c.select("run_id", (F.col("run_id") % 3).cast("string").alias("golden_sha256")).distinct()
    passages = c.select("run_id", F.col("turn").alias("qid"), F.when(F.length("text") % 11 != 0, F.col("text")).alias("text"))
    return judging.refusals(runs, passages, "0")


@query(
    "scorer_changes",
    """SELECT event_id AS run_id, array_to_string(list_filter([CASE WHEN event_type <> 'click' THEN 'judge_model' END, CASE WHEN event_id % 3 <> 0 THEN 'prompts' END], lambda x: x IS NOT NULL), ',') AS changed
    FROM events WHERE event_id % 5 <> 0 AND (event_type <> 'click' OR event_id % 3 <> 0)""",
)
def scorer_changes(spark, sf_dir):
    some = F.col("event_id") % 5 != 0
    before = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.when(some, F.col("event_type")).alias("judge_model"), F.when(some, (F.col("event_id") % 3).cast("string")).alias("prompts"))
    return judging.scorer_changes(before, {"judge_model": "click", "prompts": "0"}).withColumn("changed", F.array_join("changed", ","))


@query(
    "judge_tokens",
    """SELECT event_type AS run_id, sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 1000 END)::BIGINT AS input_tokens, sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id % 100 END)::BIGINT AS output_tokens FROM events GROUP BY event_type""",
)
def judge_tokens(spark, sf_dir):
    detail = F.to_json(F.struct((F.col("event_id") % 1000).alias("judge_input_tokens"), (F.col("user_id") % 100).alias("judge_output_tokens")))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.when(F.col("event_id") % 4 != 0, detail).alias("detail"))
    return judging.judge_tokens(rows)


# questions with an answer that cites its first passage; every third says that it found nothing
_ANSWERS = f"""{_SEARCH}, {_ITEMS},
questions_made AS (SELECT qid, len(expected) > 0 AS answerable, qid % 140 <> 0 AS answered, qid % 3 <> 0 AS found FROM items),
cited AS (SELECT h.qid, h.page_start, h.page_end FROM hits AS h WHERE rank <= 3),
landed AS (SELECT DISTINCT c.qid FROM cited AS c JOIN wanted AS w ON w.qid = c.qid AND w.satisfies BETWEEN c.page_start AND c.page_end),
answer_scores AS (SELECT q.qid, CASE WHEN answerable AND answered THEN (l.qid IS NOT NULL)::INT::DOUBLE END AS cited_page_hit,
  CASE WHEN answered THEN (found = answerable)::INT::DOUBLE END AS abstention_correct, answerable, answered FROM questions_made AS q LEFT JOIN landed AS l ON l.qid = q.qid),
question_scores AS (SELECT qid, m.lang, page_hit, page_recall, reciprocal_rank, cited_page_hit, abstention_correct, answerable, answered FROM metrics AS m JOIN answer_scores USING (qid))"""


def scores(spark, sf_dir):
    own = items(spark, sf_dir)
    q = F.col("qid")
    questions = own.select("qid", "lang", (F.size("expected") > 0).alias("answerable"), (q % 140 != 0).alias("answered"), (q % 3 != 0).alias("found"))
    found = hits(spark, sf_dir)
    covering = evals.expected_pages(own).select("qid", F.col("satisfies").alias("page"))
    answers = judging.answer_metrics(questions, found.where("rank <= 3"), covering)
    return evals.retrieval_metrics(own, found).join(answers, "qid").join(questions.drop("found"), "qid")


@query("question_scores", f"WITH {_ANSWERS} SELECT qid, page_hit, round(page_recall, 9) AS page_recall, round(reciprocal_rank, 9) AS reciprocal_rank, cited_page_hit, abstention_correct FROM question_scores")
def question_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("qid", "page_hit", F.round("page_recall", 9).alias("page_recall"), F.round("reciprocal_rank", 9).alias("reciprocal_rank"), "cited_page_hit", "abstention_correct")


_REPORT_ROUNDED = ("page_hit", "page_recall", "mrr", "cited_page_hit", "abstention_accuracy", "context_recall", "context_precision", "faithfulness", "answer_relevance", "cost_per_query_usd", "max_latency_ms", "generations_per_query", "tool_calls_per_query", "p50_latency_ms", "p95_latency_ms")
_NEAREST = "list_sort(list(latency_ms))[greatest(1, (count(latency_ms) * {p} + 99) // 100)]"


@query(
    "run_report",
    f"""WITH {_ANSWERS}, judged AS (SELECT qid, lang AS config, page_hit, page_recall, reciprocal_rank, cited_page_hit, abstention_correct, answerable, answered, quality::DOUBLE AS context_recall,
      CASE WHEN toxic = 0 THEN quality::DOUBLE END AS faithfulness, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' END AS verdict,
      CASE WHEN lang = 'fr' AND qid % 100 = 0 THEN NULL ELSE n_chars / 1000.0::DOUBLE END AS cost_usd, n_chars::DOUBLE AS latency_ms, qid % 4 AS generations, qid % 3 AS tool_calls,
      qid % 5 = 0 AS fallback, qid % 40 = 0 AS rerank_skipped FROM question_scores JOIN (SELECT doc_id AS qid, n_chars FROM documents) USING (qid) LEFT JOIN (SELECT doc_id AS qid, quality, toxic FROM labels) USING (qid)),
    report AS (SELECT config, count(*) AS questions, count(*) FILTER (answerable) AS answerable, count(*) FILTER (answered) AS answered, avg(page_hit) AS page_hit, avg(page_recall) AS page_recall,
      avg(reciprocal_rank) AS mrr, avg(cited_page_hit) AS cited_page_hit, avg(abstention_correct) AS abstention_accuracy, avg(context_recall) AS context_recall, avg(context_recall * 0.5) AS context_precision,
      avg(faithfulness) AS faithfulness, avg(page_recall * 0.25) AS answer_relevance, count(*) FILTER (verdict = 'pass') AS manual_passes, count(verdict) AS manual_reviewed,
      count(*) FILTER (cost_usd IS NULL OR latency_ms IS NULL) = 0 AS whole, avg(cost_usd) AS cost, max(latency_ms) AS longest, avg(generations) AS generations, avg(tool_calls) AS tools,
      count(*) FILTER (fallback) AS fallbacks, count(*) FILTER (rerank_skipped) AS skipped, {_NEAREST.format(p=50)} AS p50, {_NEAREST.format(p=95)} AS p95 FROM judged GROUP BY config)
    SELECT config, questions, answerable, answered, {", ".join(f"round({c}, 9) AS {c}" for c in _REPORT_ROUNDED[:9])}, manual_passes, manual_reviewed,
    CASE WHEN whole THEN round(cost, 9) END AS cost_per_query_usd, CASE WHEN whole THEN round(longest, 9) END AS max_latency_ms, CASE WHEN whole THEN round(generations, 9) END AS generations_per_query,
    CASE WHEN whole THEN round(tools, 9) END AS tool_calls_per_query, CASE WHEN whole THEN fallbacks END AS fallbacks, CASE WHEN whole THEN skipped END AS reranks_skipped,
    CASE WHEN whole THEN round(p50, 9) END AS p50_latency_ms, CASE WHEN whole THEN round(p95, 9) END AS p95_latency_ms FROM report""",
)
def run_report(spark, sf_dir):
    q = F.col("qid")
    sizes = docs(spark, sf_dir).select(F.col("doc_id").alias("qid"), "n_chars")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "qid")
    rows = scores(spark, sf_dir).withColumnRenamed("lang", "config").join(sizes, "qid").join(labels, "qid", "left")
    quality = F.col("quality").cast("double")
    rows = rows.withColumns(
        {
            "context_recall": quality,
            "context_precision": quality * 0.5,
            "faithfulness": F.when(F.col("toxic") == 0, quality),
            "answer_relevance": F.col("page_recall") * 0.25,
            "verdict": F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail"),
            "cost_usd": F.when(~((F.col("config") == "fr") & (q % 100 == 0)), F.col("n_chars") / 1000.0),
            "latency_ms": F.col("n_chars").cast("double"),
            "generations": q % 4,
            "tool_calls": q % 3,
            "fallback": q % 5 == 0,
            "rerank_skipped": q % 40 == 0,
        }
    )
    return judging.run_report(rows).withColumns({c: F.round(c, 9) for c in _REPORT_ROUNDED})


@query(
    "run_selection",
    "SELECT conv_id AS qid, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user' AND turn = 1)",
)
def run_selection(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "qid")
    return judging.selected(c.select("qid", "turn"), c.where("role = 'user' and turn = 1"))


@query("unpriced_models", "SELECT DISTINCT 'MODEL_' || p_size AS variable, p_brand AS model FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_retailprice > 1900)")
def unpriced_models(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    models = p.select(F.concat(F.lit("MODEL_"), F.col("p_size").cast("string")).alias("variable"), F.col("p_brand").alias("model")).distinct()
    return judging.unpriced(models, p.where("p_retailprice > 1900").select(F.col("p_brand").alias("model")))


@query(
    "settings_overlay",
    """SELECT c_custkey AS config, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, b.segment) AS segment, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END, b.nation) AS nation
    FROM customer CROSS JOIN (SELECT min(c_mktsegment) AS segment, max(c_nationkey) AS nation FROM customer) AS b""",
)
def settings_overlay(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    overrides = c.select(key.alias("config"), F.when(key % 3 == 0, F.col("c_mktsegment")).alias("segment"), F.when(key % 2 == 0, F.col("c_nationkey")).alias("nation"))
    return judging.overlaid(c.agg(F.min("c_mktsegment").alias("segment"), F.max("c_nationkey").alias("nation")), overrides)


@query(
    "priority_order",
    """SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(list_position(['Supplier#000000009', 'Supplier#000000003'], s_name), 3), s_name, s_suppkey)::INT AS place FROM supplier""",
)
def priority_order(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    order = judging.in_order(F.col("s_name"), ("Supplier#000000009", "Supplier#000000003"))
    return retrieval.ranked(s, "s_nationkey", [*order, F.col("s_suppkey")], name="place").select("s_suppkey", "place")


@query(
    "judge_prompts",
    r"""SELECT conv_id, string_agg(n || '. ' || trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY n) AS lines,
    string_agg('<passage number="' || n || '">' || text || '</passage>', chr(10) || chr(10) ORDER BY n) AS passages, sha256(string_agg(text, '' ORDER BY n)) AS fingerprint
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id""",
)
def judge_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    told = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]).alias("texts"))
    t = F.col("texts")
    return told.select("conv_id", judging.numbered_lines(t).alias("lines"), judging.numbered_passages(t).alias("passages"), judging.fingerprint(t).alias("fingerprint"))


@query("run_ids", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '_' || event_type AS run_id FROM events")
def run_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", judging.run_id(F.col("event_type"), F.col("ts")).alias("run_id"))


@query(
    "tool_passages",
    """SELECT event_type, user_id, count(*) FILTER (event_id % 3 <> 0 AND event_id % 5 <> 0)::BIGINT AS n, coalesce(string_agg(props, '|' ORDER BY event_id) FILTER (event_id % 3 <> 0 AND event_id % 5 <> 0), '') AS passages
    FROM events GROUP BY ALL""",
)
def tool_passages(spark, sf_dir):
    e = F.col("event_id")
    call = F.struct(e, F.lit("t").alias("name"), F.when(e % 3 != 0, F.col("props")).alias("output"), F.when(e % 5 == 0, "failed").alias("error"))
    rows = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.array_sort(F.collect_list(call)).alias("calls"))
    own = judging.tool_contexts(F.col("calls"))
    return rows.select("event_type", "user_id", F.size(own).cast("long").alias("n"), F.array_join(own, "|").alias("passages"))


@query(
    "fault_specs",
    """WITH f AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' chat:timeout ' WHEN 1 THEN 'rerank:unavailable:once' WHEN 2 THEN '' WHEN 3 THEN 'chat' WHEN 4 THEN 'embedding:' || event_type ELSE 'chat:timeout:twice' END AS t FROM events)
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'chat' WHEN 1 THEN 'rerank' END AS target, CASE event_id % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'unavailable' END AS fault,
    CASE event_id % 6 WHEN 0 THEN false WHEN 1 THEN true END AS once, event_id % 6 < 3 AS valid FROM f""",
)
def fault_specs(spark, sf_dir):
    e = F.col("event_id") % 6
    text = F.when(e == 0, " chat:timeout ").when(e == 1, "rerank:unavailable:once").when(e == 2, "").when(e == 3, "chat").when(e == 4, F.concat(F.lit("embedding:"), F.col("event_type"))).otherwise("chat:timeout:twice")
    return table(spark, sf_dir, "events").select("event_id", judging.fault(text).alias("f")).select("event_id", "f.*")


@query(
    "error_classes",
    """SELECT CASE l_linenumber WHEN 1 THEN 'ModelTimeoutException' WHEN 2 THEN 'ThrottlingException' WHEN 3 THEN 'BadGatewayException' ELSE 'Other' END AS code,
    CASE WHEN l_linenumber = 1 THEN 'timeout' WHEN l_linenumber < 4 THEN 'unavailable' ELSE 'request' END AS class, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""",
)
def error_classes(spark, sf_dir):
    n = F.col("l_linenumber")
    code = F.when(n == 1, "ModelTimeoutException").when(n == 2, "ThrottlingException").when(n == 3, "BadGatewayException").otherwise("Other")
    rows = table(spark, sf_dir, "lineitem").select(code.alias("code"))
    return rows.select("code", judging.error_class(F.col("code")).alias("class")).groupBy("code", "class").agg(F.count("*").alias("n"))


@query(
    "rerank_responses",
    """SELECT l_orderkey AS qid, CASE WHEN max(l_linenumber - 1) >= 6 THEN 'position out of range' WHEN count(DISTINCT l_linenumber) < count(*) THEN 'position repeated'
    WHEN max((l_quantity = 7)::INT) = 1 THEN 'score is no number' END AS problem FROM lineitem GROUP BY l_orderkey
    HAVING max(l_linenumber - 1) >= 6 OR count(DISTINCT l_linenumber) < count(*) OR max((l_quantity = 7)::INT) = 1""",
)
def rerank_responses(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_linenumber") - 1).alias("index"), F.when(F.col("l_quantity") == 7, float("nan")).otherwise(F.col("l_quantity")).alias("score"))
    return judging.response_problems(rows, rows.select("qid").distinct().withColumn("n", F.lit(6)))


@query(
    "database_labels",
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'host' || s_suppkey || ':6000/db' WHEN 1 THEN 'h.example:5432/n' || s_nationkey ELSE 'localhost:5432/' END AS label FROM supplier""",
)
def database_labels(spark, sf_dir):
    k = F.col("s_suppkey")
    number = k.cast("string")
    url = F.when(k % 3 == 0, F.concat(F.lit("postgresql://me:secret@Host"), number, F.lit(":6000/db?x=1"))).when(k % 3 == 1, F.concat(F.lit("postgres://h.example/n"), F.col("s_nationkey").cast("string"))).otherwise(F.lit("postgresql://"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", judging.database_label(url).alias("label"))


@query(
    "json_lists",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a|' || event_type END AS items FROM events""",
)
def json_lists(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.to_json(F.array(F.lit("a"), F.col("event_type")))).when(e % 3 == 1, F.col("event_type")).otherwise(F.lit("{}"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(judging.list_or_json(text), "|").alias("items"))


@query(
    "golden_fallback",
    f"""WITH {_SEARCH}, {_ITEMS} SELECT qid, page, satisfies FROM wanted WHERE qid % 40 = 0
    UNION ALL SELECT qid, p, p FROM (SELECT qid, unnest([qid + 5, qid + 6]) AS p FROM items WHERE qid % 40 <> 0)""",
)
def golden_fallback(spark, sf_dir):
    own = items(spark, sf_dir)
    q = F.col("qid")
    return evals.golden_pages(own.select("qid", F.array(q + 5, q + 6).alias("expected")), own.where("qid % 40 = 0")).select("qid", "page", "satisfies")


_WINDOW_SQL = """WITH b AS (SELECT o_orderkey, o_orderdate::DATE AS birth, (o_orderdate + INTERVAL 65 YEAR + to_days((o_orderkey % 900 - 450)::INT))::DATE AS day FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)),
    t AS (SELECT *, (birth + INTERVAL 65 YEAR)::DATE AS t65 FROM b),
    w AS (SELECT *, date_trunc('month', t65 - CASE WHEN day(birth) = 1 THEN INTERVAL 4 MONTH ELSE INTERVAL 3 MONTH END)::DATE AS starts,
      last_day(t65 + CASE WHEN day(birth) = 1 THEN INTERVAL 2 MONTH ELSE INTERVAL 3 MONTH END)::DATE AS ends FROM t),
    y AS (SELECT *, year(day) + CASE WHEN day > make_date(year(day), 3, 31) THEN 1 ELSE 0 END AS gy, year(day) + CASE WHEN day > make_date(year(day), 12, 7) THEN 1 ELSE 0 END AS oy FROM w)
    SELECT o_orderkey, t65 AS turns_65, starts, ends, CASE WHEN day < starts THEN 'before' WHEN day > ends THEN 'after' ELSE 'inside' END AS position,
    CASE WHEN day > ends THEN make_date(gy, 1, 1) END AS general, CASE WHEN day > ends THEN make_date(oy, 12, 7) END AS open, CASE WHEN day > ends THEN make_date(gy, 3, 31) END AS advantage FROM y"""


@query("window_check", _WINDOW_SQL)
def window_check(spark, sf_dir):
    born = F.col("o_orderdate").cast("date")
    leap = (F.month(born) == 2) & (F.dayofmonth(born) == 29)
    rows = table(spark, sf_dir, "orders").where(~leap).select("o_orderkey", born.alias("birth"), F.date_add(F.add_months(born, 780), (F.col("o_orderkey") % 900 - 450).cast("int")).alias("day"))
    x = rows.select("o_orderkey", calendar.window_check(F.col("birth"), F.col("day")).alias("x"))
    return x.select("o_orderkey", "x.turns_65", "x.window.starts", "x.window.ends", "x.position", F.col("x.general.starts").alias("general"), F.col("x.open.ends").alias("open"), F.col("x.advantage.ends").alias("advantage"))


def _shared_words(row: dict) -> str:
    """A stand-in for a judge: how many of a question's different words its passage has."""
    return str(len(set(row["question"].split(" ")) & set((row["text"] or "").split(" "))))


@query(
    "scoring_pass",
    rf"""WITH q AS (SELECT doc_id AS qid, array_to_string(list_slice({_words('text')}, 1, 12), ' ') AS question, text FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL)
    SELECT qid, len(list_intersect(list_distinct(string_split(question, ' ')), list_distinct(string_split(text, ' '))))::VARCHAR AS value, NULL::VARCHAR AS error, 1::BIGINT AS times FROM q""",
)
def scoring_pass(spark, sf_dir):
    """A pass over every second question, and one over all of them that asks the rest."""
    own = retrieval.question_words(docs(spark, sf_dir), 20, 12).join(docs(spark, sf_dir).select(F.col("doc_id").alias("qid"), "text"), "qid").where("text is not null")
    path, scorer, columns = f"{staging_root(spark)}/ledger-{uuid.uuid4().hex}", {"judge": "shared-words", "prompts": "1"}, ["question", "text"]
    judging.scoring_pass(own.where("qid % 40 = 0"), _shared_words, path, scorer, columns, workers=2)
    scored = judging.scoring_pass(own, _shared_words, path, scorer, columns, workers=2)
    times = ledger.responses(spark, path).select("request_id", "times")
    name = "\n".join(f"{k}={v}" for k, v in sorted(scorer.items()))
    return scored.withColumn("request_id", ledger.request_id(name, columns)).join(times, "request_id").select("qid", "value", "error", "times")


# ------------------------------------------------------------------ scoreboard tables


def _cell(x: str, places: int, after: str = "") -> str:
    """A number as text, halves to the even digit, or a dash."""
    return f"coalesce(round_even({x}, {places})::DECIMAL(38, {places})::VARCHAR || '{after}', '—')"


def _up(x: str, places: int, before: str = "", after: str = "") -> str:
    return f"coalesce('{before}' || round(({x})::VARCHAR::DECIMAL(38, 12), {places})::DECIMAL(38, {places})::VARCHAR || '{after}', '—')"


_REPORT = ORACLES["run_report"]


@query(
    "scoreboard_headline",
    f"""SELECT config, {_cell('page_hit * 100', 1, '%')} AS page_hit, CASE WHEN manual_reviewed > 0 THEN {_cell('manual_passes / manual_reviewed * 100', 1, '%')} || ' (' || manual_reviewed || ' reviewed)' ELSE '—' END AS manual_pass,
    {", ".join(f"{_cell(c, 2)} AS {c}" for c in ("context_recall", "context_precision", "faithfulness", "answer_relevance"))}, {_up('cost_per_query_usd', 4, before='$')} AS cost, {_up('p95_latency_ms / 1000', 1, after=' s')} AS p95_latency FROM ({_REPORT})""",
)
def scoreboard_headline(spark, sf_dir):
    return scoreboard.headline(run_report(spark, sf_dir))


@query(
    "scoreboard_secondary",
    f"""SELECT config, {", ".join(f"{_cell(f'{c} * 100', 1, '%')} AS {c}" for c in ("page_recall", "cited_page_hit", "abstention_accuracy"))}, {_cell('mrr', 2)} AS mrr,
    CASE WHEN answered > 0 THEN manual_reviewed || ' of ' || answered ELSE '—' END AS reviewed FROM ({_REPORT})""",
)
def scoreboard_secondary(spark, sf_dir):
    return scoreboard.secondary(run_report(spark, sf_dir))


@query(
    "scoreboard_serving",
    f"""SELECT config, {_up('cost_per_query_usd', 4, before='$')} AS mean_cost, {", ".join(f"{_up(f'{c}_latency_ms / 1000', 1, after=' s')} AS {c}_latency" for c in ("p50", "p95", "max"))},
    {_cell('generations_per_query', 2)} AS generations, {_cell('tool_calls_per_query', 2)} AS tool_calls, coalesce(fallbacks::VARCHAR, '—') AS fallbacks, CASE WHEN config <> 'de' THEN coalesce(reranks_skipped::VARCHAR, '—') ELSE '—' END AS reranks_skipped
    FROM ({_REPORT}) WHERE config IN (SELECT lang FROM documents WHERE doc_id % 20 = 0 AND n_chars > 10)""",
)
def scoreboard_serving(spark, sf_dir):
    configs = docs(spark, sf_dir).where("doc_id % 20 = 0").groupBy(F.col("lang").alias("config")).agg(F.bool_or(F.col("n_chars") > 10).alias("traced"))
    return scoreboard.serving(run_report(spark, sf_dir), configs.withColumn("reranker", F.when(F.col("config") != "de", F.lit("rerank"))))


@query(
    "scoreboard_types",
    f"""WITH {_ANSWERS}, typed AS (SELECT lang AS config, page_recall, CASE qid % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'table' ELSE 'multi_section' END AS type FROM question_scores)
    SELECT config, {", ".join(f"CASE WHEN count(page_recall) FILTER (type = '{t}') > 0 THEN {_cell(f"avg(page_recall) FILTER (type = '{t}') * 100", 1, '%')} || ' (' || count(page_recall) FILTER (type = '{t}') || ')' ELSE '—' END AS {t}" for t in scoreboard.TYPES)}
    FROM typed GROUP BY config""",
)
def scoreboard_types(spark, sf_dir):
    kind = F.when(F.col("qid") % 3 == 0, "lookup").when(F.col("qid") % 3 == 1, "table").otherwise("multi_section")
    return scoreboard.by_type(scores(spark, sf_dir).select(F.col("lang").alias("config"), "page_recall", kind.alias("type")), "page_recall")


_STEP_COLUMNS = ", ".join(f"{_up(f'max({k}_{p}) / 1000', 1, after=' s')} AS {k}_{p}" for k in ("retriever", "generation") for p in ("p50", "p95"))


@query(
    "scoreboard_steps",
    f"""WITH {_CALLS}, t AS (SELECT trace_id, trace_id % 4 AS config, coalesce(sum(latency_ms) FILTER (kind = 'retrieval'), 0) AS retriever, coalesce(sum(latency_ms) FILTER (kind = 'generation'), 0) AS generation,
      coalesce(sum(latency_ms) FILTER (kind = 'tool'), 0) AS tools, coalesce(sum(latency_ms), 0) AS whole_ms, bool_or(trace_id % 97 = 3) AS lost FROM calls GROUP BY trace_id),
    u AS (SELECT config, kind, v FROM (SELECT config, unnest(['retriever', 'generation', 'tools', 'share']) AS kind, unnest([retriever, generation, tools, CASE WHEN whole_ms > 0 THEN generation / whole_ms END]) AS v FROM t) WHERE v IS NOT NULL),
    o AS (SELECT config, kind, v, row_number() OVER (PARTITION BY config, kind ORDER BY v) AS r, count(*) OVER (PARTITION BY config, kind) AS n FROM u),
    p AS (SELECT config, {", ".join(f"max(v) FILTER (kind = '{k}' AND r = greatest(1, (n * {q} + 99) // 100)) AS {k}_p{q}" for k in ("retriever", "generation", "tools", "share") for q in (50, 95))} FROM o GROUP BY config)
    SELECT config::VARCHAR AS config, {_STEP_COLUMNS}, {", ".join(f"CASE WHEN config <> 1 THEN {_up(f'max(tools_{p}) / 1000', 1, after=' s')} ELSE '—' END AS tools_{p}" for p in ("p50", "p95"))}, {_cell('max(share_p50) * 100', 1, '%')} AS generation_share
    FROM p WHERE config NOT IN (SELECT config FROM t WHERE lost) GROUP BY config""",
)
def scoreboard_steps(spark, sf_dir):
    i = F.col("trace_id")
    own = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("latency_ms"))), F.lit(0.0))
    t = calls(spark, sf_dir).groupBy("trace_id").agg(own("retrieval").alias("retriever"), own("generation").alias("generation"), own("tool").alias("tools"), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("whole_ms"))
    kept = lambda c: F.when(i % 97 != 3, F.col(c)).alias(c)
    times = t.select((i % 4).cast("string").alias("config"), *map(kept, ("retriever", "generation", "tools", "whole_ms")))
    configs = t.select((i % 4).cast("string").alias("config")).distinct().withColumn("tools", F.col("config") != "1")
    return scoreboard.steps(times, configs)


_IDS = "coalesce(array_to_string(list_sort(list(DISTINCT trace_id::VARCHAR) FILTER (trace_id IS NOT NULL)), ', '), '—')"


@query(
    "scoreboard_tools",
    f"""WITH {_CALLS}, used AS (SELECT (trace_id % 4)::VARCHAR AS config, trace_id, (k % 3)::VARCHAR AS tool, k >= 90 AS failed FROM calls WHERE kind = 'tool' AND trace_id % 4 <> 2 AND trace_id % 9 <> 0),
    offered(config, tool) AS (SELECT * FROM (VALUES ('0'), ('1'), ('3')) AS c(config), (VALUES ('0'), ('1'), ('spare')) AS t(tool)),
    lines AS (SELECT coalesce(o.config, u.config) AS config, coalesce(o.tool, u.tool) AS tool, trace_id, failed FROM offered AS o FULL OUTER JOIN used AS u ON o.config = u.config AND o.tool = u.tool),
    idle AS (SELECT DISTINCT (trace_id % 4)::VARCHAR AS config, trace_id FROM calls WHERE trace_id % 4 <> 2 AND trace_id NOT IN (SELECT trace_id FROM used))
    SELECT config, tool, count(DISTINCT trace_id)::VARCHAR AS questions, {_IDS} AS which, count(trace_id)::VARCHAR AS calls, count(*) FILTER (failed)::VARCHAR AS errors FROM lines GROUP BY config, tool
    UNION ALL SELECT c.config, '(neither tool)', count(DISTINCT trace_id)::VARCHAR, {_IDS}, '—', '—' FROM (SELECT DISTINCT config FROM offered) AS c LEFT JOIN idle USING (config) GROUP BY c.config""",
)
def scoreboard_tools(spark, sf_dir):
    i = F.col("trace_id")
    c = calls(spark, sf_dir).withColumn("config", (i % 4).cast("string"))
    used = c.where((F.col("kind") == "tool") & (i % 9 != 0)).select("config", i.alias("qid"), (F.col("k") % 3).cast("string").alias("tool"), F.when(F.col("k") >= 90, "refused").alias("error"))
    offered = spark.createDataFrame([(config, tool) for config in "013" for tool in ("0", "1", "spare")], "config string, tool string")
    return scoreboard.tools(used, c.select("config", i.alias("qid")).distinct(), offered)
