"""Queries over metrics, traces, dates, costs and the corpus tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanworks.functions import calendar, money
from gleanworks.functions.text import written
from gleanworks.operators import checks, chunking, evals, retrieval, spans, traces
from gleanworks.plans.passages import _SEARCH, _WINDOWS, docs, lexical, query, windows
from gleanworks.session import staged, table
from gleanworks.sources import store

# ------------------------------------------------------------------ coverage and metrics

_ITEMS = """
items AS (SELECT doc_id AS qid, CASE WHEN doc_id % 60 = 0 THEN []::BIGINT[] ELSE [doc_id, doc_id + 1] END AS expected, lang FROM documents WHERE doc_id % 20 = 0),
wanted AS (SELECT qid, page, unnest(CASE WHEN page = qid + 1 THEN [page, page + 1] ELSE [page] END) AS satisfies FROM (SELECT qid, unnest(expected) AS page FROM items)),
hits AS (SELECT l.qid, l.rank, l.doc_id AS page_start, l.doc_id + n_chars % 3 AS page_end FROM lexical AS l JOIN documents USING (doc_id)),
coverage AS (SELECT w.qid, w.page, min(h.rank) AS rank FROM wanted AS w LEFT JOIN hits AS h ON h.qid = w.qid AND w.satisfies BETWEEN h.page_start AND h.page_end GROUP BY ALL),
metrics AS (SELECT i.qid, lang, CASE WHEN count(page) > 0 THEN (count(rank) > 0)::INT::DOUBLE END AS page_hit,
  CASE WHEN count(page) > 0 THEN count(rank) / count(page) END::DOUBLE AS page_recall,
  CASE WHEN count(page) > 0 THEN coalesce(1.0::DOUBLE / min(rank), 0.0) END AS reciprocal_rank, min(rank) AS first_rank
  FROM items AS i LEFT JOIN coverage AS c USING (qid) GROUP BY i.qid, lang)"""


def items(spark, sf_dir):
    q = F.col("doc_id")
    none = F.array().cast("array<bigint>")
    return docs(spark, sf_dir).where(q % 20 == 0).select(q.alias("qid"), F.when(q % 60 == 0, none).otherwise(F.array(q, q + 1)).alias("expected"), F.create_map(q + 1, F.array(q + 2)).alias("alternates"), "lang")


def hits(spark, sf_dir):
    return lexical(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id").select("qid", "rank", F.col("doc_id").alias("page_start"), (F.col("doc_id") + F.col("n_chars") % 3).alias("page_end"))


@query("page_coverage", f"WITH {_SEARCH}, {_ITEMS} SELECT qid, page, rank::INT AS rank FROM coverage")
def page_coverage(spark, sf_dir):
    return evals.coverage(items(spark, sf_dir), hits(spark, sf_dir))


@query("alt_page_expansion", f"WITH {_SEARCH}, {_ITEMS} SELECT * FROM wanted")
def alt_page_expansion(spark, sf_dir):
    return evals.expected_pages(items(spark, sf_dir))


@query("retrieval_metrics", f"WITH {_SEARCH}, {_ITEMS} SELECT qid, page_hit, round(page_recall, 9) AS page_recall, round(reciprocal_rank, 9) AS reciprocal_rank FROM metrics")
def retrieval_metrics(spark, sf_dir):
    scored = evals.retrieval_metrics(items(spark, sf_dir), hits(spark, sf_dir))
    return scored.withColumns({c: F.round(c, 9) for c in ("page_recall", "reciprocal_rank")})


@query(
    "candidate_buckets",
    f"""WITH {_SEARCH}, {_ITEMS}, b AS (SELECT lang, CASE WHEN first_rank IS NULL THEN 'absent' WHEN first_rank <= 5 THEN '1-5' WHEN first_rank <= 20 THEN '6-20' ELSE '21+' END AS bucket
      FROM metrics WHERE page_hit IS NOT NULL)
    SELECT coalesce(lang, 'all') AS type, count(*) FILTER (bucket = '1-5')::BIGINT AS top, count(*) FILTER (bucket = '6-20')::BIGINT AS pool,
    count(*) FILTER (bucket = '21+')::BIGINT AS beyond, count(*) FILTER (bucket = 'absent')::BIGINT AS absent FROM b GROUP BY ROLLUP (lang)""",
)
def candidate_buckets(spark, sf_dir):
    first = evals.coverage(items(spark, sf_dir), hits(spark, sf_dir)).groupBy("qid").agg(F.min("rank").alias("rank"))
    b = items(spark, sf_dir).select("qid", "lang").join(first, "qid").withColumn("bucket", evals.bucket(F.col("rank")))
    count = lambda name, value: F.count_if(F.col("bucket") == value).alias(name)
    return b.rollup("lang").agg(count("top", "1-5"), count("pool", "6-20"), count("beyond", "21+"), count("absent", "absent")).select(F.coalesce("lang", F.lit("all")).alias("type"), "top", "pool", "beyond", "absent")


@query(
    "average_precision",
    """WITH r AS (SELECT doc_id // 10 AS qid, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS rank, quality = 1 AND toxic = 0 AS useful FROM labels),
    p AS (SELECT *, sum(useful::INT) OVER (PARTITION BY qid ORDER BY rank) / rank AS prec FROM r)
    SELECT qid, round(coalesce(avg(prec) FILTER (useful), 0), 9)::DOUBLE AS average_precision FROM p GROUP BY qid""",
)
def average_precision(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 10).alias("qid"), "doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("useful"))
    scored = evals.average_precision(retrieval.ranked(rows, "qid", [F.col("doc_id")]))
    return scored.withColumn("average_precision", F.round("average_precision", 9))


@query(
    "answer_relevance",
    """WITH f AS (SELECT label, min_by(embedding, vec_id)::DOUBLE[] AS asked FROM embeddings WHERE label IS NOT NULL GROUP BY label)
    SELECT vec_id, round(CASE WHEN vec_id % 10 = 9 THEN 0.0 ELSE list_cosine_similarity(embedding::DOUBLE[], asked) END, 9)::DOUBLE AS relevance FROM embeddings JOIN f USING (label)""",
)
def answer_relevance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    asked = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("asked"))
    score = F.when(F.col("vec_id") % 10 == 9, 0.0).otherwise(retrieval.cosine(F.col("embedding"), F.col("asked")))
    return e.join(asked, "label").select("vec_id", F.round(score, 9).alias("relevance"))


@query(
    "run_aggregates",
    """SELECT source AS config, count(*)::BIGINT AS n, round(avg(quality), 9) AS mean_quality, round(avg(CASE WHEN toxic = 0 THEN quality END), 9) AS mean_quality_clean,
    (count(*) FILTER (quality = 1) / nullif(count(quality), 0))::DOUBLE AS manual_pass, count(quality)::BIGINT AS reviewed
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def run_aggregates(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    verdict = F.when(F.col("quality") == 1, "pass").when(F.col("quality").isNotNull(), "fail")
    return rows.groupBy(F.col("source").alias("config")).agg(
        F.count("*").alias("n"),
        F.round(F.avg("quality"), 9).alias("mean_quality"),
        F.round(F.avg(F.when(F.col("toxic") == 0, F.col("quality"))), 9).alias("mean_quality_clean"),
        evals.manual_pass(verdict).alias("manual_pass"),
        F.count("quality").alias("reviewed"),
    )


@query("manual_pass", "SELECT lang, (count(*) FILTER (quality = 1) / nullif(count(quality), 0))::DOUBLE AS rate, count(quality)::BIGINT AS reviewed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def manual_pass(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    verdict = F.when(F.col("quality") == 1, "pass").when(F.col("quality").isNotNull(), "fail")
    return rows.groupBy("lang").agg(evals.manual_pass(verdict).alias("rate"), F.count("quality").alias("reviewed"))


@query(
    "metric_by_type",
    """SELECT source AS config, """
    + ", ".join(f"round(avg(quality) FILTER (lang = '{x}'), 9) AS {x}_mean, count(quality) FILTER (lang = '{x}')::BIGINT AS {x}_n" for x in ("de", "en", "es", "fr"))
    + " FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
)
def metric_by_type(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy(F.col("source").alias("config")).pivot("lang", ["de", "en", "es", "fr"]).agg(F.round(F.avg("quality"), 9).alias("mean"), F.count("quality").alias("n")).fillna(0, [f"{x}_n" for x in ("de", "en", "es", "fr")])


@query("latest_per_config", "SELECT event_type AS config, max(event_id) AS event_id, max_by(round(value, 6), (ts, event_id)) AS value FROM (SELECT * FROM events WHERE (props::JSON ->> 'k')::BIGINT <> 7) GROUP BY event_type")
def latest_per_config(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").cast("long") != 7).select(F.col("event_type").alias("config"), "ts", "event_id", F.round("value", 6).alias("value"))
    return evals.latest(rows, "config", ["ts", "event_id"]).select("config", "event_id", "value")


@query("incomparable_runs", "SELECT lang, count(DISTINCT (source, n_chars % 2)) > 1 AS incomparable, count(DISTINCT (source, n_chars % 2))::BIGINT AS pins FROM documents GROUP BY lang")
def incomparable_runs(spark, sf_dir):
    pins = F.count_distinct(F.struct("source", F.col("n_chars") % 2))
    return docs(spark, sf_dir).groupBy("lang").agg((pins > 1).alias("incomparable"), pins.alias("pins"))


@query(
    "golden_problems",
    """WITH g AS (SELECT item_id AS line, CASE WHEN item_id % 9 = 0 THEN 'q' || item_id::VARCHAR WHEN item_id % 11 = 0 THEN 'q011' ELSE 'q' || lpad(item_id::VARCHAR, 3, '0') END AS id,
      CASE WHEN item_id % 13 = 0 THEN '  ' ELSE text END AS question, CASE WHEN item_id % 5 = 0 THEN 'other' ELSE 'costs' END AS category,
      CASE WHEN item_id % 7 = 0 THEN NULL ELSE 'easy' END AS difficulty, CASE WHEN item_id % 4 = 0 THEN 'unanswerable' ELSE 'lookup' END AS type,
      CASE WHEN item_id % 3 = 0 THEN []::BIGINT[] ELSE [item_id, item_id % 6] END AS pages, item_id % 6 AS alt, item_id % 8 = 0 AS needs_review FROM benchmark)
    SELECT line, id, unnest(list_filter([
      CASE WHEN NOT regexp_matches(id, '^q[0-9]{3}$') THEN 'id' END, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' END,
      CASE WHEN trim(question) = '' THEN 'question' END, CASE WHEN category <> 'costs' THEN 'category' END, CASE WHEN difficulty IS NULL THEN 'difficulty' END,
      CASE WHEN len(list_filter(pages, lambda p: p < 1)) > 0 THEN 'page below 1' END, CASE WHEN len(pages) <> len(list_distinct(pages)) THEN 'repeated page' END,
      CASE WHEN type <> 'unanswerable' AND len(pages) = 0 THEN 'no pages' END, CASE WHEN type = 'unanswerable' AND len(pages) > 0 THEN 'pages of an unanswerable question' END,
      CASE WHEN NOT list_contains(pages, alt) THEN 'alternate of no expected page' END, CASE WHEN list_contains(pages, alt + 1) THEN 'alternate that is expected' END,
      CASE WHEN NOT needs_review AND len(list_filter(pages, lambda p: p <> line)) > 0 THEN 'page without evidence' END], lambda p: p IS NOT NULL)) AS problem FROM g""",
)
def golden_problems(spark, sf_dir):
    i = F.col("item_id")
    none = F.array().cast("array<bigint>")
    g = table(spark, sf_dir, "benchmark").select(
        i.alias("line"),
        F.when(i % 9 == 0, F.concat(F.lit("q"), i.cast("string"))).when(i % 11 == 0, "q011").otherwise(F.concat(F.lit("q"), F.lpad(i.cast("string"), 3, "0"))).alias("id"),
        F.when(i % 13 == 0, "  ").otherwise(F.col("text")).alias("question"),
        F.when(i % 5 == 0, "other").otherwise("costs").alias("category"),
        F.when(i % 7 != 0, "easy").alias("difficulty"),
        F.when(i % 4 == 0, "unanswerable").otherwise("lookup").alias("type"),
        F.when(i % 3 == 0, none).otherwise(F.array(i, i % 6)).alias("pages"),
        F.create_map(i % 6, F.array(i % 6 + 1)).alias("alternates"),
        F.array(i).alias("evidence_pages"),
        (i % 8 == 0).alias("needs_review"),
    )
    return checks.golden_problems(g)


# ------------------------------------------------------------------ traces

KINDS = ("generation", "embedding", "rerank", "tool", "retrieval")
_CALLS = """
calls AS (SELECT event_id, user_id AS trace_id, CASE event_type WHEN 'purchase' THEN 'generation' WHEN 'view' THEN 'embedding' WHEN 'click' THEN 'rerank' WHEN 'signup' THEN 'tool' ELSE 'retrieval' END AS kind,
  value AS latency_ms, (props::JSON ->> 'k')::BIGINT AS k FROM events),
prices(model, pin, pout, punit) AS (VALUES ('chat-large', 5.5::DOUBLE, 27.5::DOUBLE, NULL::DOUBLE), ('chat-small', 2.2, 11.0, NULL), ('embed-text', 0.02, NULL, NULL), ('rerank', NULL, NULL, 0.002)),
costed AS (SELECT c.*, coalesce(CASE WHEN punit IS NOT NULL THEN ceil(k / 100.0) * punit END, k * pin / 1000000 + coalesce(k * 2 * pout / 1000000, 0)) AS cost_usd FROM
  (SELECT *, CASE kind WHEN 'generation' THEN CASE WHEN k = 50 AND trace_id % 2 = 0 THEN 'unlisted' ELSE 'chat-large' END WHEN 'embedding' THEN 'embed-text' WHEN 'rerank' THEN 'rerank' END AS model FROM calls) AS c LEFT JOIN prices USING (model)),
trace_costs AS (SELECT trace_id, CASE WHEN NOT bool_or(kind IN ('generation', 'embedding', 'rerank') AND cost_usd IS NULL) THEN coalesce(sum(cost_usd), 0) END AS cost_usd, sum(latency_ms) AS latency_ms FROM costed GROUP BY trace_id)"""


def calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    kind = F.when(kind == "purchase", "generation").when(kind == "view", "embedding").when(kind == "click", "rerank").when(kind == "signup", "tool").otherwise("retrieval")
    rows = e.select("event_id", F.col("user_id").alias("trace_id"), kind.alias("kind"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    unlisted = (F.col("k") == 50) & (F.col("trace_id") % 2 == 0)
    model = F.when(F.col("kind") == "generation", F.when(unlisted, "unlisted").otherwise("chat-large")).when(F.col("kind") == "embedding", "embed-text").when(F.col("kind") == "rerank", "rerank")
    priced = rows.withColumn("model", model).join(money.price_table(spark), "model", "left")
    return priced.withColumn("cost_usd", money.call_cost(F.col("k"), F.col("k") * 2, money.rerank_units(F.col("k")))).select("event_id", "trace_id", "kind", "latency_ms", "k", "model", "cost_usd")


@query("call_costs", f"WITH {_CALLS} SELECT event_id, model, round(cost_usd, 9)::DOUBLE AS cost_usd FROM (SELECT *, CASE kind WHEN 'generation' THEN CASE WHEN k = 50 AND trace_id % 2 = 0 THEN 'unlisted' ELSE 'chat-large' END WHEN 'embedding' THEN 'embed-text' WHEN 'rerank' THEN 'rerank' END AS model FROM costed)")
def call_costs(spark, sf_dir):
    return calls(spark, sf_dir).select("event_id", "model", F.round("cost_usd", 9).alias("cost_usd"))


@query("trace_cost", f"WITH {_CALLS} SELECT trace_id, round(cost_usd, 9)::DOUBLE AS cost_usd FROM trace_costs")
def trace_cost(spark, sf_dir):
    return traces.trace_cost(calls(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 9))


@query(
    "serving_summary",
    f"""WITH {_CALLS} SELECT trace_id % 4 AS run, count(*)::BIGINT AS n, CASE WHEN count(cost_usd) = count(*) THEN round(avg(cost_usd), 9) END::DOUBLE AS mean_cost,
    CASE WHEN count(cost_usd) = count(*) THEN round(max(latency_ms), 6) END::DOUBLE AS max_latency FROM trace_costs GROUP BY trace_id % 4""",
)
def serving_summary(spark, sf_dir):
    c = calls(spark, sf_dir)
    per = traces.trace_cost(c).join(c.groupBy("trace_id").agg(F.sum("latency_ms").alias("latency_ms")), "trace_id")
    cost = F.col("cost_usd")
    return per.groupBy((F.col("trace_id") % 4).alias("run")).agg(
        F.count("*").alias("n"), traces.all_or_nothing(cost, F.round(F.avg(cost), 9)).alias("mean_cost"), traces.all_or_nothing(cost, F.round(F.max("latency_ms"), 6)).alias("max_latency")
    )


@query(
    "latency_percentiles",
    """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(value) FILTER (r = greatest(1, (n * 50 + 99) // 100)) AS p50, max(value) FILTER (r = greatest(1, (n * 95 + 99) // 100)) AS p95 FROM o GROUP BY event_type""",
)
def latency_percentiles(spark, sf_dir):
    return evals.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", (50, 95))


_TIMES = ", ".join(f"coalesce(sum(latency_ms) FILTER (kind = '{k}'), 0) AS {k}" for k in KINDS)


@query(
    "step_times",
    f"""WITH {_CALLS}, t AS (SELECT trace_id, {_TIMES} FROM calls GROUP BY trace_id),
    u AS (UNPIVOT t ON {', '.join(KINDS)} INTO NAME kind VALUE ms),
    o AS (SELECT kind, ms, row_number() OVER (PARTITION BY kind ORDER BY ms) AS r, count(*) OVER (PARTITION BY kind) AS n FROM u)
    SELECT kind, round(max(ms) FILTER (r = greatest(1, (n * 50 + 99) // 100)), 6) AS p50, round(max(ms) FILTER (r = greatest(1, (n * 95 + 99) // 100)), 6) AS p95 FROM o GROUP BY kind""",
)
def step_times(spark, sf_dir):
    times = traces.step_percentiles(traces.step_times(calls(spark, sf_dir), KINDS), KINDS)
    return times.select("kind", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(
    "generation_share",
    f"""WITH {_CALLS}, s AS (SELECT trace_id, sum(latency_ms) FILTER (kind = 'generation') / sum(latency_ms) AS share FROM calls GROUP BY trace_id HAVING sum(latency_ms) > 0)
    SELECT round(max(share) FILTER (r = greatest(1, (n * 50 + 99) // 100)), 9) AS median_share, max(n)::BIGINT AS traces
    FROM (SELECT coalesce(share, 0) AS share, row_number() OVER (ORDER BY coalesce(share, 0)) AS r, count(*) OVER () AS n FROM s)""",
)
def generation_share(spark, sf_dir):
    t = traces.step_times(calls(spark, sf_dir), KINDS)
    total = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    shares = staged(t.where(total > 0).select(F.lit(0).alias("all"), (F.col("generation") / total).alias("share")), "shares")
    middle = evals.nearest_rank(shares, "all", "share", (50,))
    return shares.groupBy("all").agg(F.count("*").alias("traces")).join(F.broadcast(middle), "all", "left").select(F.round("p50", 9).alias("median_share"), "traces")  # one row


_TOOLS = "('0'), ('1'), ('2'), ('3'), ('9')"


@query(
    "tool_usage",
    f"""WITH {_CALLS}, tools(tool) AS (VALUES {_TOOLS}), used AS (SELECT trace_id, (k % 4)::VARCHAR AS tool, k >= 90 AS failed FROM calls WHERE kind = 'tool')
    SELECT tool, count(DISTINCT trace_id)::BIGINT AS questions, count(trace_id)::BIGINT AS calls, count(*) FILTER (failed)::BIGINT AS errors FROM tools LEFT JOIN used USING (tool) GROUP BY tool""",
)
def tool_usage(spark, sf_dir):
    used = calls(spark, sf_dir).where("kind = 'tool'").select("trace_id", (F.col("k") % 4).cast("string").alias("tool"), (F.col("k") >= 90).alias("failed"))
    tools = spark.createDataFrame([("0",), ("1",), ("2",), ("3",), ("9",)], "tool string")
    return tools.join(used, "tool", "left").groupBy("tool").agg(F.count_distinct("trace_id").alias("questions"), F.count("trace_id").alias("calls"), F.count_if("failed").alias("errors"))


@query("tool_callers", f"WITH {_CALLS} SELECT DISTINCT (k % 4)::VARCHAR AS tool, trace_id FROM calls WHERE kind = 'tool'")
def tool_callers(spark, sf_dir):
    return calls(spark, sf_dir).where("kind = 'tool'").select((F.col("k") % 4).cast("string").alias("tool"), "trace_id").distinct()


@query("no_tool_questions", f"WITH {_CALLS} SELECT DISTINCT trace_id FROM calls WHERE trace_id NOT IN (SELECT trace_id FROM calls WHERE kind = 'tool' AND k % 4 = 1)")
def no_tool_questions(spark, sf_dir):
    c = calls(spark, sf_dir)
    return c.select("trace_id").distinct().join(c.where("kind = 'tool' and k % 4 = 1").select("trace_id"), "trace_id", "left_anti")


@query("fallback_questions", f"WITH {_CALLS} SELECT trace_id, bool_or(kind = 'generation' AND k > 97) AS fallback, bool_or(kind = 'rerank' AND k = 0) AS skipped_rerank, count(*) FILTER (kind = 'generation')::BIGINT AS generations, coalesce(sum(k) FILTER (kind IN ('generation', 'embedding')), 0)::BIGINT AS tokens FROM calls GROUP BY trace_id")
def fallback_questions(spark, sf_dir):
    kind = F.col("kind")
    return calls(spark, sf_dir).groupBy("trace_id").agg(
        F.bool_or((kind == "generation") & (F.col("k") > 97)).alias("fallback"),
        F.bool_or((kind == "rerank") & (F.col("k") == 0)).alias("skipped_rerank"),
        F.count_if(kind == "generation").alias("generations"),
        F.coalesce(F.sum(F.when(kind.isin("generation", "embedding"), F.col("k"))), F.lit(0)).alias("tokens"),
    )


_TRACES = f"""{_CALLS},
own AS (SELECT trace_id AS qid, CASE WHEN trace_id % 13 <> 0 THEN trace_id END AS trace_id, coalesce(sum(k) FILTER (kind IN ('generation', 'embedding')), 0) AS i,
  coalesce(sum(2 * k) FILTER (kind IN ('generation', 'embedding')), 0) AS o, any_value(t.cost_usd) AS c FROM costed JOIN trace_costs AS t USING (trace_id) GROUP BY trace_id),
seen AS (SELECT trace_id, coalesce(sum(k + CASE WHEN trace_id % 7 = 0 THEN 1 ELSE 0 END) FILTER (kind IN ('generation', 'embedding')), 0) AS i,
  coalesce(sum(2 * k - CASE WHEN trace_id % 7 = 0 THEN 1 ELSE 0 END) FILTER (kind IN ('generation', 'embedding')), 0) AS o,
  coalesce(sum(coalesce(cost_usd, 0.5) + CASE WHEN trace_id % 5 = 0 THEN 0.001 ELSE 0 END) FILTER (kind IN ('generation', 'embedding', 'rerank')), 0) AS c
  FROM costed WHERE trace_id % 11 <> 0 GROUP BY trace_id),
compared AS (SELECT own.qid, own.trace_id, own.i, own.o, own.c, seen.trace_id IS NOT NULL AS there, seen.i AS si, seen.o AS so, seen.c AS sc FROM own LEFT JOIN seen ON own.trace_id = seen.trace_id),
problems AS (SELECT qid, trace_id, 1 AS place, 'untraced' AS problem, NULL::DOUBLE AS stored, NULL::DOUBLE AS seen FROM compared WHERE trace_id IS NULL
  UNION ALL SELECT qid, trace_id, 2, 'missing', NULL, NULL FROM compared WHERE trace_id IS NOT NULL AND NOT there
  UNION ALL SELECT qid, trace_id, 3, 'input tokens', i, si FROM compared WHERE there AND i <> si
  UNION ALL SELECT qid, trace_id, 4, 'output tokens', o, so FROM compared WHERE there AND o <> so
  UNION ALL SELECT qid, trace_id, 5, 'cost', c, sc FROM compared WHERE there AND abs(c - sc) > 0.0001)"""


def stored_and_seen(spark, sf_dir):
    """Stored totals by question, and records of another service: late, wrong or lost for some."""
    c, i = staged(calls(spark, sf_dir), "calls"), F.col("trace_id")
    totals = traces.stored_totals(c.withColumns({"input_tokens": F.col("k"), "output_tokens": 2 * F.col("k")}))
    totals = totals.select(i.alias("qid"), F.when(i % 13 != 0, i).alias("trace_id"), "input_tokens", "output_tokens", "cost_usd")
    odd, reranked = F.when(i % 7 == 0, 1).otherwise(0), F.col("kind") == "rerank"  # which the other service calls a generation without tokens
    cost = F.coalesce("cost_usd", F.lit(0.5)) + F.when(i % 5 == 0, 0.001).otherwise(0.0)
    records = c.where(i % 11 != 0).select(
        "trace_id", F.when(reranked, "GENERATION").otherwise(F.initcap("kind")).alias("type"), F.when(~reranked, F.col("k") + odd).alias("input_tokens"), F.when(~reranked, 2 * F.col("k") - odd).alias("output_tokens"),
        F.when(F.col("event_id") % 2 == 0, cost).alias("total_cost"), cost.alias("cost_detail"))
    return totals, traces.outside_totals(records)


@query("trace_differences", f"WITH {_TRACES} SELECT qid, trace_id, problem, round(stored, 9) AS stored, round(seen, 9) AS seen FROM problems")
def trace_differences(spark, sf_dir):
    found = traces.differences(*stored_and_seen(spark, sf_dir))
    return found.select("qid", "trace_id", "problem", F.round("stored", 9).alias("stored"), F.round("seen", 9).alias("seen"))


@query("trace_reconcile", f"WITH {_TRACES} SELECT qid, coalesce(string_agg(problem, ',' ORDER BY place), 'match') AS status FROM own LEFT JOIN problems USING (qid) GROUP BY qid")
def trace_reconcile(spark, sf_dir):
    return traces.reconcile(*stored_and_seen(spark, sf_dir))


@query(
    "trace_verification",
    f"""WITH {_TRACES} SELECT (SELECT count(trace_id) FROM own)::BIGINT AS checked, (SELECT count(*) FROM own WHERE trace_id IS NOT NULL AND c IS NULL)::BIGINT AS without_cost,
    (SELECT count(*) FROM problems)::BIGINT AS problems, (SELECT count(DISTINCT qid) FROM problems)::BIGINT AS failed""",
)
def trace_verification(spark, sf_dir):
    stored, seen = stored_and_seen(spark, sf_dir)
    return traces.verification(stored, traces.differences(stored, seen))


_SPANS = """
turn AS (SELECT user_id AS trace_id, event_id AS span_id, value AS latency_ms, (props::JSON ->> 'k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
spans AS (SELECT t.trace_id, t.span_id, p.span_id AS parent_id, coalesce(t.latency_ms, 0) AS latency_ms FROM turn AS t LEFT JOIN turn AS p ON p.trace_id = t.trace_id AND p.i = t.i - 1 - t.k % 3 AND t.i % 40 <> 1),
own AS (SELECT s.trace_id, s.span_id, s.parent_id, greatest(0, s.latency_ms - coalesce(c.ms, 0)) AS self_ms FROM spans AS s LEFT JOIN (SELECT trace_id, parent_id, sum(latency_ms) AS ms FROM spans GROUP BY ALL) AS c ON c.trace_id = s.trace_id AND c.parent_id = s.span_id),
below(trace_id, top, span_id, ms, far) AS (SELECT trace_id, span_id, span_id, self_ms, 0 FROM own
  UNION ALL SELECT b.trace_id, b.top, o.span_id, b.ms + o.self_ms, b.far + 1 FROM below AS b JOIN own AS o ON o.trace_id = b.trace_id AND o.parent_id = b.span_id),
rolled AS (SELECT b.trace_id, b.top AS span_id, sum(o.self_ms) AS subtree_ms, count(*) AS n_spans, max(b.ms) AS path_ms FROM below AS b JOIN own AS o ON o.trace_id = b.trace_id AND o.span_id = b.span_id GROUP BY ALL),
depths AS (SELECT trace_id, span_id, max(far) AS depth FROM below GROUP BY ALL)"""


@query(
    "trace_spans",
    f"WITH RECURSIVE {_SPANS} SELECT o.trace_id, o.span_id, o.parent_id, depth::BIGINT AS depth, round(self_ms, 6) AS self_ms, round(subtree_ms, 6) AS subtree_ms, n_spans::BIGINT AS n_spans, round(path_ms, 6) AS path_ms"
    " FROM own AS o JOIN rolled USING (trace_id, span_id) JOIN depths USING (trace_id, span_id)",
)
def trace_spans(spark, sf_dir):
    own = Window.partitionBy("trace_id").orderBy("span_id")  # one trace
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    turn = staged(e.withColumn("i", F.row_number().over(own)), "turns")
    parent = F.when(F.col("i") % 40 != 1, F.col("i") - 1 - F.col("k") % 3)
    p = turn.select("trace_id", F.col("i").alias("p"), F.col("span_id").alias("parent_id"))
    tree = turn.withColumn("p", parent).join(p, ["trace_id", "p"], "left").select("trace_id", "span_id", "parent_id", "latency_ms")
    rolled = spans.rolled_up(tree)
    return rolled.select("trace_id", "span_id", "parent_id", "depth", *[F.round(c, 6).alias(c) for c in ("self_ms", "subtree_ms")], "n_spans", F.round("path_ms", 6).alias("path_ms"))


# ------------------------------------------------------------------ dates, costs, formats

_BIRTHS = """
b AS (SELECT o_orderkey, o_orderdate::DATE AS birth, (o_orderdate::DATE + to_years(65) + to_days((o_orderkey % 400 - 200)::INT))::DATE AS day FROM orders),
w AS (SELECT *, CASE WHEN NOT (month(birth) = 2 AND day(birth) = 29) THEN (birth + to_years(65))::DATE END AS t65 FROM b),
f AS (SELECT *, CASE WHEN day(birth) = 1 THEN date_trunc('month', t65 - INTERVAL 4 MONTH) ELSE date_trunc('month', t65 - INTERVAL 3 MONTH) END::DATE AS starts,
  CASE WHEN day(birth) = 1 THEN last_day((t65 + INTERVAL 2 MONTH)::DATE) ELSE last_day((t65 + INTERVAL 3 MONTH)::DATE) END AS ends FROM w)"""


def births(spark, sf_dir):
    birth = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", birth.alias("birth"), F.date_add(F.add_months(birth, 780), (F.col("o_orderkey") % 400 - 200).cast("int")).alias("day"))


@query("enrollment_window", f"WITH {_BIRTHS} SELECT o_orderkey, t65 AS turns_65, starts, ends, CASE WHEN day < starts THEN 'before' WHEN day > ends THEN 'after' WHEN ends IS NOT NULL THEN 'inside' END AS position FROM f")
def enrollment_window(spark, sf_dir):
    b = F.col("birth")
    window = calendar.first_window(b)
    return births(spark, sf_dir).select("o_orderkey", calendar.turns_65(b).alias("turns_65"), window["starts"].alias("starts"), window["ends"].alias("ends"), calendar.position(b, F.col("day")).alias("position"))


@query(
    "coverage_start",
    f"""WITH {_BIRTHS}, m AS (SELECT *, (year(day) - year(starts)) * 12 + month(day) - month(starts) AS m0, (year(day) - year(t65)) * 12 + month(day) - month(t65) AS m1 FROM f)
    SELECT o_orderkey, CASE WHEN day BETWEEN starts AND ends AND m0 < 3 THEN CASE WHEN day(birth) = 1 THEN date_trunc('month', t65 - INTERVAL 1 MONTH) ELSE date_trunc('month', t65) END
    WHEN day BETWEEN starts AND ends AND m1 >= 0 THEN date_trunc('month', day + INTERVAL 1 MONTH) END::DATE AS coverage FROM m""",
)
def coverage_start(spark, sf_dir):
    return births(spark, sf_dir).select("o_orderkey", calendar.coverage_start(F.col("birth"), F.col("day")).alias("coverage"))


@query(
    "later_periods",
    f"""WITH {_BIRTHS}, y AS (SELECT o_orderkey, day, year(day) + CASE WHEN day > make_date(year(day), 3, 31) THEN 1 ELSE 0 END AS gy, year(day) + CASE WHEN day > make_date(year(day), 12, 7) THEN 1 ELSE 0 END AS oy FROM f WHERE day > ends)
    SELECT o_orderkey, make_date(gy, 1, 1) AS general_starts, make_date(gy, 3, 31) AS general_ends, day BETWEEN make_date(gy, 1, 1) AND make_date(gy, 3, 31) AS in_general,
    make_date(oy, 10, 15) AS open_starts, make_date(oy, 12, 7) AS open_ends, day BETWEEN make_date(oy, 10, 15) AND make_date(oy, 12, 7) AS in_open FROM y""",
)
def later_periods(spark, sf_dir):
    day = F.col("day")
    general, opened = calendar.yearly_window(day, *calendar.GENERAL), calendar.yearly_window(day, *calendar.OPEN)
    late = births(spark, sf_dir).where(day > calendar.first_window(F.col("birth"))["ends"])
    return late.select("o_orderkey", general["starts"].alias("general_starts"), general["ends"].alias("general_ends"), day.between(general["starts"], general["ends"]).alias("in_general"),
        opened["starts"].alias("open_starts"), opened["ends"].alias("open_ends"), day.between(opened["starts"], opened["ends"]).alias("in_open"))


_FIGURES = ", ".join(f"({i}, '{k}', '{a}', '{u}', {p})" for i, (k, a, u, p) in enumerate(money.COST_FIGURES))


@query("cost_lookup", f"""WITH c(i, key, amount_text, unit, page) AS (VALUES {_FIGURES}), a AS (SELECT event_id, (props::JSON ->> 'k')::BIGINT % 13 AS i FROM events)
    SELECT event_id, amount_text, amount_text::DECIMAL(10, 2)::DOUBLE AS amount, unit, page::INT AS page, CASE WHEN key IS NULL THEN 'no such figure' END AS error FROM a LEFT JOIN c USING (i)""")
def cost_lookup(spark, sf_dir):
    names = F.array(*[F.lit(k) for k, *_ in money.COST_FIGURES])
    asked = table(spark, sf_dir, "events").select("event_id", F.get(names, (F.get_json_object("props", "$.k").cast("int") % 13)).alias("key"))
    found = asked.join(money.cost_table(spark).withColumn("known", F.lit(True)), "key", "left")
    return found.select("event_id", "amount_text", F.col("amount").cast("double").alias("amount"), "unit", "page", F.when(F.col("known").isNull(), "no such figure").alias("error"))


@query("rerank_units", "SELECT event_id, CASE WHEN n > 0 THEN ceil(n / 100.0) ELSE 0 END::BIGINT AS units, round(CASE WHEN n > 0 THEN ceil(n / 100.0) ELSE 0 END * 0.002, 9)::DOUBLE AS cost_usd FROM (SELECT event_id, (props::JSON ->> 'k')::BIGINT * (event_id % 9) AS n FROM events)")
def rerank_units(spark, sf_dir):
    n = F.get_json_object("props", "$.k").cast("long") * (F.col("event_id") % 9)
    units = money.rerank_units(n)
    return table(spark, sf_dir, "events").select("event_id", units.alias("units"), F.round(units * 0.002, 9).alias("cost_usd"))


@query("display_format", """SELECT event_id, coalesce('$' || round(v::VARCHAR::DECIMAL(38, 12), 2)::DECIMAL(38, 2)::VARCHAR, '—') AS money, coalesce(round((value / 1000)::DECIMAL(18, 9)::DECIMAL(38, 12), 1)::DECIMAL(38, 1)::VARCHAR || ' s', '—') AS seconds
    FROM (SELECT *, CASE WHEN event_id % 10 <> 0 THEN value::DECIMAL(18, 2) + 0.005 END AS v FROM events)""")
def display_format(spark, sf_dir):
    v = F.when(F.col("event_id") % 10 != 0, F.col("value").cast("decimal(18,2)") + F.lit("0.005").cast("decimal(4,3)"))
    seconds = (F.col("value") / 1000).cast("decimal(18,9)")
    return table(spark, sf_dir, "events").select("event_id", written(v, 2, before="$").alias("money"), written(seconds, 1, after=" s").alias("seconds"))


# ------------------------------------------------------------------ the corpus tables


@query("content_hashes", "SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 3 = 0 THEN sha256(text || ' ') ELSE sha256(text) END = sha256(text) AS verified FROM documents")
def content_hashes(spark, sf_dir):
    pinned = docs(spark, sf_dir).select("doc_id", "text", F.sha2("text", 256).alias("sha256"), F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.sha2("text", 256)).alias("pin"))
    return store.hash_matches(pinned, "text", "pin").select("doc_id", "sha256", "verified")


@query("upsert_documents", """WITH old AS (SELECT doc_id, source, n_chars FROM documents WHERE lang <> 'fr'), new AS (SELECT doc_id, 'changed' AS source, n_chars + 1 AS n_chars FROM documents WHERE lang <> 'de')
    SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT n.doc_id, coalesce(o.source, n.source), n.n_chars FROM new AS n LEFT JOIN old AS o USING (doc_id)""")
def upsert_documents(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source", "n_chars", "lang")
    changes = d.where("lang <> 'de'").select("doc_id", F.lit("changed").alias("source"), (F.col("n_chars") + 1).alias("n_chars"))
    return store.upsert(d.where("lang <> 'fr'").drop("lang"), changes, "doc_id", fixed=("source",))


@query("replace_chunk_set", f"""WITH {_WINDOWS}, old AS (SELECT doc_id, 'fixed-220w' AS chunk_set, ordinal FROM windows UNION ALL SELECT doc_id, 'other', ordinal FROM windows),
    new AS (SELECT doc_id, 'fixed-220w' AS chunk_set, 1000 + ordinal AS ordinal FROM windows JOIN documents USING (doc_id) WHERE lang = 'en')
    SELECT * FROM old WHERE (doc_id, chunk_set) NOT IN (SELECT doc_id, chunk_set FROM new) UNION ALL SELECT * FROM new""")
def replace_chunk_set(spark, sf_dir):
    own = windows(spark, sf_dir).select("doc_id", "ordinal")
    named = lambda name: own.select("doc_id", F.lit(name).alias("chunk_set"), "ordinal")
    english = docs(spark, sf_dir).where("lang = 'en'").select("doc_id")
    new = named("fixed-220w").join(english, "doc_id", "left_semi").withColumn("ordinal", F.col("ordinal") + 1000)
    return store.replace_set(named("fixed-220w").unionByName(named("other")), new, ["doc_id", "chunk_set"])


@query(
    "page_chunks",
    f"""WITH {_WINDOWS}, asked AS (SELECT doc_id, unnest(generate_series(1, ceil(len(string_split(text, chr(10))) / 5)::BIGINT))::INT AS page FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, ordinal, page, page_start, page_end FROM windows JOIN asked USING (doc_id) WHERE page BETWEEN page_start AND page_end""",
)
def page_chunks(spark, sf_dir):
    asked = chunking.pages_of_text(docs(spark, sf_dir), 5).select("doc_id", "page")
    return store.page_chunks(windows(spark, sf_dir), asked).select("doc_id", "ordinal", "page", "page_start", "page_end")


@query("corpus_health", f"WITH {_WINDOWS} SELECT source, count(*)::BIGINT AS n_chunks FROM windows JOIN documents USING (doc_id) GROUP BY source")
def corpus_health(spark, sf_dir):
    return store.health(docs(spark, sf_dir), windows(spark, sf_dir))
