"""Queries over passages and retrieval, with the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanworks.functions.text import STOP_WORDS, collapse, iso_date, lexemes, page_label, preview, whole_sentences, words
from gleanworks.operators import checks, chunking, models, retrieval, sections
from gleanworks.session import spread, staged, staging_root, table
from gleanworks.sources import postings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_filter(string_split({_collapse(x)}, ' '), lambda w: w <> '')"


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _lexemes(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'), lambda w: w NOT IN ({_STOPS}))"


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id")


# ------------------------------------------------------------------ chunking

_WINDOWS = f"""
by_line AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: {_words('l')}) AS by_line FROM documents WHERE text IS NOT NULL),
stream AS (SELECT doc_id, flatten(by_line) AS words,
  flatten(list_transform(by_line, lambda ws, i: list_transform(ws, lambda x: (i - 1) // 5 + 1))) AS pages FROM by_line),
numbered AS (SELECT *, unnest(generate_series(0, greatest(0, ceil((len(words) - 220) / 180.0))::BIGINT)) AS o FROM stream WHERE len(words) > 0),
windows AS (SELECT doc_id, o::INT AS ordinal, pages[o * 180 + 1]::INT AS page_start, list_slice(pages, o * 180 + 1, o * 180 + 220)[-1]::INT AS page_end,
  array_to_string(list_slice(words, o * 180 + 1, o * 180 + 220), ' ') AS text FROM numbered)"""


def windows(spark, sf_dir):
    return chunking.text_windows(docs(spark, sf_dir)).drop("section")


query("fixed_window_chunks", f"WITH {_WINDOWS} SELECT * FROM windows")(windows)


@query(
    "chunk_word_stats",
    f"""WITH {_WINDOWS}, counted AS (SELECT doc_id, len({_words('text')}) AS n FROM windows)
    SELECT lang, min(n)::INT AS min_words, median(n)::DOUBLE AS median_words, max(n)::INT AS max_words, count(*)::BIGINT AS n_chunks
    FROM counted JOIN documents USING (doc_id) GROUP BY lang""",
)
def chunk_word_stats(spark, sf_dir):
    counted = windows(spark, sf_dir).select("doc_id", F.size(words(F.col("text"))).alias("n"))
    rows = counted.join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.min("n").alias("min_words"), F.percentile("n", 0.5).alias("median_words"), F.max("n").alias("max_words"), F.count("*").alias("n_chunks"))


_LINES = f"""
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, line_no::INT AS line_no, {_collapse('raw')} AS line, (raw LIKE '% ' OR {_collapse('raw')} LIKE '%-') AS continues FROM raw WHERE {_collapse('raw')} <> ''),
furniture AS (SELECT line, count(DISTINCT doc_id)::BIGINT AS n_pages FROM lines WHERE line_no < 3 GROUP BY line HAVING count(DISTINCT doc_id) >= 3)"""


@query("furniture_lines", f"WITH {_LINES} SELECT * FROM furniture")
def furniture_lines(spark, sf_dir):
    return chunking.furniture_lines(docs(spark, sf_dir))


@query(
    "content_lines",
    f"""WITH {_LINES} SELECT doc_id, line_no, line, continues FROM lines WHERE line NOT IN (SELECT line FROM furniture)
    AND NOT (line_no < 3 AND line IN (doc_id::VARCHAR, doc_id::VARCHAR || doc_id::VARCHAR))""",
)
def content_lines(spark, sf_dir):
    return chunking.content_lines(docs(spark, sf_dir))


_PAGES = f"""
paged AS (SELECT doc_id, (i // 8 + 1)::INT AS page, (i % 8)::INT AS line_no, {_collapse('raw')} AS line, (raw LIKE '% ' OR {_collapse('raw')} LIKE '%-') AS continues FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL) WHERE {_collapse('raw')} <> ''),
opening AS (SELECT doc_id, line, count(DISTINCT page)::BIGINT AS n_pages FROM paged WHERE line_no < 3 GROUP BY doc_id, line HAVING count(DISTINCT page) >= 3)"""


@query("page_furniture", f"WITH {_PAGES} SELECT * FROM opening")
def page_furniture(spark, sf_dir):
    return chunking.page_furniture(chunking.pages_of_text(docs(spark, sf_dir), 8))


@query(
    "page_content",
    f"""WITH {_PAGES} SELECT doc_id, page, line_no, line, continues FROM paged AS p WHERE NOT (line_no < 3 AND line IN (page::VARCHAR, page::VARCHAR || page::VARCHAR))
    AND NOT EXISTS (SELECT 1 FROM opening AS o WHERE o.doc_id = p.doc_id AND o.line = p.line)""",
)
def page_content(spark, sf_dir):
    return chunking.page_content(chunking.pages_of_text(docs(spark, sf_dir), 8))


_AMOUNT_ROW = r"""(len(list_filter(string_split(line, ' '), lambda w: regexp_matches(w, '^(\$[0-9,]+(\.[0-9]+)?|[0-9]+(\.[0-9]+)?%\**)$'))) >= 2
  AND 2 * len(list_filter(string_split(line, ' '), lambda w: regexp_matches(w, '^(\$[0-9,]+(\.[0-9]+)?|[0-9]+(\.[0-9]+)?%\**)$'))) >= len(string_split(line, ' ')))"""


@query(
    "amount_rows",
    f"""WITH {_LINES} SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER ({_AMOUNT_ROW})::BIGINT AS n_amount_rows,
    count(*) FILTER (length(line) <= 55 OR {_AMOUNT_ROW})::BIGINT AS n_narrow FROM lines GROUP BY doc_id""",
)
def amount_rows(spark, sf_dir):
    line = F.col("line")
    return chunking.lines_of(docs(spark, sf_dir)).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(chunking.is_amount_row(line)).alias("n_amount_rows"), F.count_if(chunking.is_narrow(line)).alias("n_narrow")
    )


@query(
    "narrow_runs",
    f"""WITH {_LINES}, marked AS (SELECT *, (length(line) <= 55 OR {_AMOUNT_ROW}) AS narrow, (continues OR {_AMOUNT_ROW}) AS cell FROM lines),
    islands AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - row_number() OVER (PARTITION BY doc_id, narrow ORDER BY line_no) AS island FROM marked)
    SELECT doc_id, min(line_no)::INT AS first_line, count(*)::BIGINT AS n_lines, count(*) FILTER (cell)::BIGINT AS n_cells,
    (count(*) >= 10 AND 2 * count(*) FILTER (cell) >= count(*)) AS is_table FROM islands WHERE narrow GROUP BY doc_id, island""",
)
def narrow_runs(spark, sf_dir):
    return chunking.narrow_runs(chunking.lines_of(docs(spark, sf_dir)))


@query(
    "heading_candidates",
    f"""WITH {_LINES}, placed AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM lines)
    SELECT doc_id, line_no, line FROM placed WHERE length(line) <= CASE WHEN line LIKE '%?' THEN 75 ELSE 65 END
    AND regexp_matches(line, '^[“‘"'']*\\p{{Lu}}') AND regexp_matches(line, '\\p{{Ll}}')
    AND NOT regexp_matches(regexp_replace(line, '[”’"'']+$', ''), '[.,;:!&/\\-–—0-9]$') AND NOT starts_with(line, 'Go to ')
    AND (before IS NULL OR regexp_matches(before, '[.?!][)”’"'']*$'))""",
)
def heading_candidates(spark, sf_dir):
    return chunking.heading_candidates(chunking.lines_of(docs(spark, sf_dir)))


@query(
    "chunk_sentences",
    f"""WITH stream AS (SELECT doc_id, {_words('text')} AS words FROM documents WHERE text IS NOT NULL),
    cut AS (SELECT doc_id, words, list_filter(generate_series(1, len(words)), lambda i: i = len(words)
      OR (regexp_matches(words[i], '[.?!][)”’"'']*$') AND regexp_matches(words[i + 1], '^[A-Z0-9•“"(]'))) AS ends FROM stream WHERE len(words) > 0),
    stops AS (SELECT doc_id, words, ends, generate_subscripts(ends, 1) AS k FROM cut)
    SELECT doc_id, (k - 1)::INT AS sentence_no, array_to_string(list_slice(words, CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END, ends[k]), ' ') AS sentence FROM stops""",
)
def chunk_sentences(spark, sf_dir):
    return chunking.sentences(docs(spark, sf_dir))


@query("section_chunks")
def section_chunks(spark, sf_dir):
    return sections.section_chunks(sections.pages_in_row(docs(spark, sf_dir), 40))


def _sentences(x: str) -> str:
    """Sentences of a text, as a list: marks behind stops, less those of abbreviations, and cuts at the rest."""
    space = r"[\s\p{Zs}]"
    # RE2 looks nowhere ahead, so a mark is set with the white space behind it and what starts there is found again
    stops = rf"""regexp_replace({x}, '([.!?]+[”’"'')\]]*)({space}+[“‘"''(\[]*[A-Z])', '\1' || chr(57344) || '\2', 'g')"""
    held = rf"""'((?:^|{space})[“‘"''(\[]*(?:(?i:dr|jr|mr|mrs|ms|sr|st|vs)|(?:[A-Za-z]\.)+[A-Za-z])\.)' || chr(57344)"""
    return rf"""list_filter(list_transform(string_split(regexp_replace({stops}, {held}, '\1', 'g'), chr(57344)), lambda s: regexp_replace(s, '^{space}+|{space}+$', '', 'g')), lambda s: s <> '')"""


@query(
    "answer_sentences",
    f"""WITH cut AS (SELECT doc_id, {_sentences('text')} AS s FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, unnest(generate_series(1, len(s)))::INT AS sentence_no, unnest(s) AS sentence FROM cut""",
)
def answer_sentences(spark, sf_dir):
    return models.answer_sentences(docs(spark, sf_dir))


# ------------------------------------------------------------------ retrieval

_SEARCH = f"""
questions AS (SELECT doc_id AS qid, array_to_string(list_slice({_words('text')}, 1, 12), ' ') AS question FROM documents WHERE doc_id % 20 = 0),
lex AS (SELECT doc_id, unnest({_lexemes('text')}) AS lexeme FROM documents WHERE text IS NOT NULL),
postings AS (SELECT doc_id, lexeme, count(*) AS n FROM lex GROUP BY ALL),
asked AS (SELECT DISTINCT qid, unnest({_lexemes('question')}) AS lexeme FROM questions),
lexical_scores AS (SELECT qid, doc_id, sum(n) * 0.1 AS score FROM asked JOIN postings USING (lexeme) GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM lexical_scores) WHERE rank <= 20),
e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
vector_scores AS (SELECT q.doc_id AS qid, e.doc_id, list_cosine_similarity(q.v, e.v) AS score FROM e AS q, e WHERE q.doc_id % 20 = 0),
vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM vector_scores) WHERE rank <= 20),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, doc_id) AS fused_rank FROM (
  SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused FROM (SELECT qid, doc_id, rank FROM lexical UNION ALL SELECT qid, doc_id, rank FROM vector) GROUP BY qid, doc_id)),
pool AS (SELECT qid, doc_id, l.rank AS lexical_rank, v.rank AS vector_rank, f.fused AS score, d.text FROM fused AS f
  LEFT JOIN lexical AS l USING (qid, doc_id) LEFT JOIN vector AS v USING (qid, doc_id) JOIN documents AS d USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS fused_rank FROM pool),
shared AS (SELECT r.*, CASE WHEN fused_rank <= 20 THEN len(list_intersect(
  list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')), list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))))::DOUBLE END AS rerank_score
  FROM ranked AS r JOIN questions USING (qid)),
reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY (fused_rank > 20), rerank_score DESC NULLS LAST, fused_rank) AS rank FROM shared)"""


def questions(spark, sf_dir):
    return retrieval.question_words(docs(spark, sf_dir), 20, 12)


def lexical(spark, sf_dir):
    return retrieval.lexical_search(questions(spark, sf_dir), docs(spark, sf_dir))


def vector(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    return retrieval.vector_search(asked, vectors.select("vec_id", "embedding")).withColumnRenamed("vec_id", "doc_id")


@query("lexical_search", f"WITH {_SEARCH} SELECT qid, doc_id, round(score, 6)::DOUBLE AS score, rank::INT AS rank FROM lexical")
def lexical_search(spark, sf_dir):
    return lexical(spark, sf_dir).withColumn("score", F.round(F.col("score").cast("double"), 6))


_LEXICAL = f"WITH {_SEARCH} SELECT qid, doc_id, round(score, 6)::DOUBLE AS score, rank::INT AS rank FROM lexical"


def _indexed(passages, name):
    path = f"{staging_root(passages.sparkSession)}/{name}-{uuid.uuid4().hex}"
    postings.build(passages, path)
    return path


@query("lexical_search_stored", _LEXICAL)
def lexical_search_stored(spark, sf_dir):
    found = postings.search(questions(spark, sf_dir), _indexed(docs(spark, sf_dir).select("doc_id", "text"), "postings"))
    return found.withColumn("score", F.round(F.col("score").cast("double"), 6))


@query("lexical_search_replaced", _LEXICAL)
def lexical_search_replaced(spark, sf_dir):
    """An index of other texts for a third of the documents, and of some that are no more, put right."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    third = F.col("doc_id") % 3 == 0
    older = d.select("doc_id", F.when(third, F.concat_ws(" ", F.lit("an older text"), F.substring("text", 1, 400))).otherwise(F.col("text")).alias("text"))
    more = d.select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    path = _indexed(older.unionByName(more), "postings")
    postings.replace(spark, path, d.where(third), more.select("doc_id"))
    return postings.search(questions(spark, sf_dir), path).withColumn("score", F.round(F.col("score").cast("double"), 6))


@query(
    "phrase_search",
    f"""WITH lex AS (SELECT doc_id, {_lexemes('text')} AS w FROM documents WHERE text IS NOT NULL), asked AS (SELECT item_id AS phrase_id, list_slice({_lexemes('text')}, 2, 4) AS p FROM benchmark),
    phrases AS (SELECT phrase_id, p, unnest(p) AS lexeme, generate_subscripts(p, 1) AS turn FROM asked), words AS (SELECT doc_id, unnest(w) AS lexeme, generate_subscripts(w, 1) AS place FROM lex),
    starts AS (SELECT phrase_id, len(p) AS n, doc_id, place - turn AS start, count(*) AS found FROM words JOIN phrases USING (lexeme) GROUP BY ALL)
    SELECT phrase_id, doc_id, count(*)::BIGINT AS places FROM starts WHERE found = n GROUP BY ALL""",
)
def phrase_search(spark, sf_dir):
    index = postings.open_index(spark, _indexed(docs(spark, sf_dir).select("doc_id", "text"), "postings"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.slice(lexemes(F.col("text")), 2, 3).alias("lexemes"))
    return postings.phrases(index, asked).withColumnRenamed("key", "doc_id")


@query("lexical_search_stemmed")
def lexical_search_stemmed(spark, sf_dir):
    return retrieval.lexical_search(questions(spark, sf_dir), docs(spark, sf_dir), stems=True)


@query("vector_search", f"WITH {_SEARCH} SELECT qid, doc_id, round(score, 6)::DOUBLE AS score, rank::INT AS rank FROM vector")
def vector_search(spark, sf_dir):
    return vector(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("rrf_fusion", f"WITH {_SEARCH} SELECT qid, doc_id, round(fused, 9) AS fused, fused_rank::INT AS fused_rank FROM fused")
def rrf_fusion(spark, sf_dir):
    return retrieval.fuse([lexical(spark, sf_dir), vector(spark, sf_dir)]).withColumn("fused", F.round("fused", 9))


def bodies(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "text")


def pool(spark, sf_dir):
    return retrieval.candidates(lexical(spark, sf_dir), vector(spark, sf_dir), bodies(spark, sf_dir))


@query(
    "hybrid_candidates",
    f"""WITH {_SEARCH} SELECT qid, doc_id, lexical_rank::INT AS lexical_rank, vector_rank::INT AS vector_rank, round(score, 9) AS score, fused_rank::INT AS fused_rank FROM ranked""",
)
def hybrid_candidates(spark, sf_dir):
    return pool(spark, sf_dir).select("qid", "doc_id", "lexical_rank", "vector_rank", F.round("score", 9).alias("score"), "fused_rank")


@query("rerank_overlap", f"WITH {_SEARCH} SELECT qid, doc_id, fused_rank::INT AS fused_rank, rerank_score, rank::INT AS rank FROM reranked")
def rerank_overlap(spark, sf_dir):
    return retrieval.rerank(pool(spark, sf_dir), questions(spark, sf_dir), bodies(spark, sf_dir)).select("qid", "doc_id", "fused_rank", "rerank_score", "rank")


def found(spark, sf_dir):
    return retrieval.hits(questions(spark, sf_dir), lexical(spark, sf_dir), vector(spark, sf_dir), bodies(spark, sf_dir))


@query("search_top_k", f"WITH {_SEARCH} SELECT qid, doc_id, fused_rank::INT AS fused_rank, rerank_score, rank::INT AS rank FROM reranked WHERE rank <= 5")
def search_top_k(spark, sf_dir):
    return found(spark, sf_dir).select("qid", "doc_id", "fused_rank", "rerank_score", "rank")


@query(
    "prompt_assembly",
    f"""WITH {_SEARCH} SELECT qid, coalesce(nullif(string_agg('[' || doc_id::VARCHAR || '] ' || text, chr(10) || chr(10) ORDER BY rank), ''), '(no passages)') AS prompt
    FROM reranked WHERE rank <= 5 GROUP BY qid""",
)
def prompt_assembly(spark, sf_dir):
    return retrieval.prompt(found(spark, sf_dir), bodies(spark, sf_dir))


@query(
    "reranker_movement",
    f"""WITH {_SEARCH}, firsts AS (SELECT qid, min(rank) FILTER (rank <= 5) AS best, min_by(fused_rank, rank) AS fused_rank FROM reranked WHERE abs(doc_id - qid) <= 2 AND rank <= 5 GROUP BY qid)
    SELECT count(*) FILTER (fused_rank > 5)::BIGINT AS lifted, count(*) FILTER (fused_rank <= 5)::BIGINT AS already,
    ((SELECT count(*) FROM questions) - count(*))::BIGINT AS missing FROM firsts""",
)
def reranker_movement(spark, sf_dir):
    near = found(spark, sf_dir).where(F.abs(F.col("doc_id") - F.col("qid")) <= 2).groupBy("qid").agg(F.min_by("fused_rank", "rank").alias("fused_rank"))
    joined = questions(spark, sf_dir).select("qid").join(near, "qid", "left")
    return joined.agg(F.count_if(F.col("fused_rank") > 5).alias("lifted"), F.count_if(F.col("fused_rank") <= 5).alias("already"), F.count_if(F.col("fused_rank").isNull()).alias("missing"))


@query("hash_embeddings")
def hash_embeddings(spark, sf_dir):
    return models.embed(docs(spark, sf_dir), models.hash_embedder())


_WORD_SET = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"


@query(
    "extractive_answers",
    f"""WITH {_SEARCH}, best AS (SELECT qid, question, {_sentences('text')} AS s FROM reranked JOIN questions USING (qid) WHERE rank = 1),
    cut AS (SELECT qid, question, unnest(s) AS sentence, generate_subscripts(s, 1) AS k FROM best),
    told AS (SELECT *, len(list_intersect({_WORD_SET.format('question')}, {_WORD_SET.format('sentence')})) AS n FROM cut)
    SELECT qid, max_by(sentence, n * 1000000 - k) AS value, NULL::VARCHAR AS error, false AS fallback FROM told GROUP BY qid""",
)
def extractive_answers(spark, sf_dir):
    first = staged(found(spark, sf_dir).where("rank = 1").select("qid", "question", "doc_id", "body"), "first")
    cut = retrieval.texts_of(first, bodies(spark, sf_dir)).select("doc_id", "body", whole_sentences(F.col("text")).alias("sentences"))
    best = first.join(cut, ["doc_id", "body"]).select("qid", "question", "sentences")
    return models.call_model(best, models.extractive_answer, "qid", ["question", "sentences"])


def _look_then_answer(row: dict, results: list[dict], forced: bool):
    if not results and not forced:
        return [("count_words", {"text": row["question"]}), ("unknown", {})], None
    return [], f"{row['question'].split(' ')[0]}: {results[0]['output']}"


@query("agent_answers")
def agent_answers(spark, sf_dir):
    return models.agent_answers(questions(spark, sf_dir).where("question <> ''"), _look_then_answer, {"count_words": _count_words}).select("qid", "answer", "turns", F.size("calls").alias("n_calls"), "error")


def _count_words(arguments: dict) -> str:
    return str(len(arguments["text"].split()))


# ------------------------------------------------------------------ checks and labels


@query(
    "evidence_check",
    f"""SELECT item_id, doc_id FROM (SELECT item_id, {_collapse('text')} AS quote FROM benchmark) AS b
    JOIN (SELECT doc_id, {_collapse('text')} AS body FROM documents) AS d ON quote <> '' AND contains(body, quote)""",
)
def evidence_check(spark, sf_dir):
    return checks.find_quotes(table(spark, sf_dir, "benchmark"), docs(spark, sf_dir))


@query(
    "citation_check",
    f"""WITH cited AS (
      SELECT doc_id % 50 AS qid, doc_id, array_to_string(list_slice({_words('text')}, 3, 8), '  ') AS quote FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT item_id % 50, item_id, text FROM benchmark),
    retrieved AS (SELECT doc_id % 50 AS qid, doc_id, text FROM documents WHERE lang <> 'fr')
    SELECT c.qid, c.doc_id, quote, r.text IS NOT NULL AS known,
      coalesce({_collapse('quote')} <> '' AND contains({_collapse('r.text')}, {_collapse('quote')}), false) AS quote_verified
    FROM cited AS c LEFT JOIN retrieved AS r USING (qid, doc_id)""",
)
def citation_check(spark, sf_dir):
    d = docs(spark, sf_dir)
    own = d.where("text is not null").select((F.col("doc_id") % 50).alias("qid"), "doc_id", F.array_join(F.slice(words(F.col("text")), 3, 6), "  ").alias("quote"))
    other = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 50).alias("qid"), F.col("item_id").alias("doc_id"), F.col("text").alias("quote"))
    retrieved = d.where("lang <> 'fr'").select((F.col("doc_id") % 50).alias("qid"), "doc_id", "text")
    return checks.check_citations(own.unionByName(other), retrieved)


@query(
    "hit_summaries",
    f"""WITH {_WINDOWS} SELECT doc_id, ordinal, CASE WHEN page_start = page_end THEN page_start::VARCHAR ELSE page_start::VARCHAR || '-' || page_end::VARCHAR END AS pages,
    CASE WHEN length(text) > 78 THEN left(text, 78) || '…' ELSE text END AS opening FROM windows""",
)
def hit_summaries(spark, sf_dir):
    return windows(spark, sf_dir).select("doc_id", "ordinal", page_label(F.col("page_start"), F.col("page_end")).alias("pages"), preview(F.col("text"), 78).alias("opening"))


@query(
    "question_validation",
    f"""SELECT conv_id, turn, {_collapse('text')} AS question, coalesce({_collapse('text')} = '', true) AS blank, role IN ('user', 'assistant') AS role_ok, turn BETWEEN 1 AND 20 AS turn_ok FROM conversations""",
)
def question_validation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    own = collapse(F.col("text"))
    return c.select("conv_id", "turn", own.alias("question"), F.coalesce(own == "", F.lit(True)).alias("blank"), F.col("role").isin("user", "assistant").alias("role_ok"), F.col("turn").between(1, 20).alias("turn_ok"))


@query(
    "iso_dates",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE ts::DATE END AS day
    FROM events""",
)
def iso_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    spelled = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy/MM/dd")).when(F.col("event_id") % 5 == 1, F.lit("2026-02-30")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", iso_date(spelled).alias("day"))


@query("conversation_turns", f"""SELECT conv_id, count(*)::BIGINT AS turns, count(*) FILTER (role = 'user')::BIGINT AS asked, max(turn)::BIGINT AS last_turn,
    max_by({_collapse('text')}, turn) AS last_text FROM conversations GROUP BY conv_id""")
def conversation_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.max("turn").alias("last_turn"), F.max_by(collapse(F.col("text")), "turn").alias("last_text"))


@query("question_lexemes", f"SELECT item_id, list_distinct({_lexemes('text')}).list_sort().array_to_string(' ') AS lexemes FROM benchmark")
def question_lexemes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(lexemes(F.col("text")))), " ").alias("lexemes"))
