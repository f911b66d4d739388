"""Citations and evidence against their sources; validity of golden questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.functions.text import collapse, contains_quote, words
from gleanworks.operators.grams import containing
from gleanworks.session import small

CATEGORIES = ("costs", "coverage", "enrollment", "original_vs_advantage", "part_d", "medigap")
DIFFICULTIES = ("easy", "medium", "hard")
TYPES = ("lookup", "table", "multi_section", "unanswerable")
#: Words of a quote, from its second on, that have to stand in a text before the text is searched.
ANCHOR = 4
#: Quotes, or their anchors, that are broadcast; beyond, they are joined.
QUOTES = 200_000


def find_quotes(quotes: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """item_id, key: the texts that contain each quote, but for white space.

    A quote of three words or more is looked up by a run of its inner words (up to four),
    which are whole words in every text that holds it. The runs asked for are broadcast where
    there are few, so that a text's other runs go no further. Quotes of one or two words have
    no whole word for sure: they are compared with every text, and are broadcast too.
    """
    q = quotes.select("item_id", collapse(F.col("text")).alias("quote"), words(F.col("text")).alias("w")).where("quote <> ''")
    t = texts.where("text is not null").select(key, collapse(F.col("text")).alias("body"), words(F.col("text")).alias("w"))
    size = F.least(F.size("w") - 2, F.lit(ANCHOR))
    run = lambda w, at, n: F.xxhash64(F.array_join(F.slice(w, at, n), " "), n)
    anchored = q.where(F.size("w") > 2).withColumn("n", size).select("item_id", "quote", "n", run(F.col("w"), F.lit(2), F.col("n")).alias("anchor"))
    sizes = [r["n"] for r in anchored.select("n").distinct().collect()]  # 1 to ANCHOR
    none = F.array().cast("array<bigint>")

    def runs(n: int):
        every = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: run(F.col("w"), i, F.lit(n)))
        return F.when(F.size("w") >= n, every).otherwise(none)

    spots = t.select(key, F.explode(F.array_distinct(F.concat(none, *map(runs, sizes)))).alias("anchor"))
    # texts are fetched for the few that hold an anchor, not carried through the join
    met = spots.join(small(anchored.select("item_id", "anchor"), QUOTES, "anchors"), "anchor").select(key, "item_id").distinct()
    held = met.join(anchored.select("item_id", "quote"), "item_id").join(t.select(key, "body"), key).where(F.contains("body", F.col("quote"))).select("item_id", key)
    short = q.where(F.size("w") <= 2).select("item_id", "quote")
    if short.isEmpty():
        return held.distinct()
    return held.unionByName(containing(short, t.select(key, "body"), key=key).select("item_id", key)).distinct()


def check_citations(citations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Citations (qid, doc_id, quote) with known and quote_verified, against retrieved (qid, doc_id, text)."""
    joined = citations.join(retrieved.select("qid", "doc_id", "text"), ["qid", "doc_id"], "left")
    known = F.col("text").isNotNull()
    return joined.select("qid", "doc_id", "quote", known.alias("known"), (known & F.coalesce(contains_quote(F.col("quote"), F.col("text")), F.lit(False))).alias("quote_verified"))


def golden_problems(items: DataFrame) -> DataFrame:
    """line, id, problem: every fault of every golden question, all at once.

    Columns: line, id, question, category, difficulty, type, pages (array), alternates (map of
    page to array), evidence_pages (array), needs_review.
    """
    pages = F.coalesce("pages", F.array().cast("array<bigint>"))
    alternates = F.coalesce("alternates", F.create_map().cast("map<bigint,array<bigint>>"))
    answers = F.col("type") != "unanswerable"
    stray = F.size(F.filter(F.map_keys(alternates), lambda k: ~F.array_contains(pages, k))) > 0
    clash = F.size(F.filter(F.flatten(F.map_values(alternates)), lambda v: F.array_contains(pages, v))) > 0
    empty = F.size(F.filter(F.map_values(alternates), lambda v: F.size(v) == 0)) > 0
    unproved = F.size(F.array_except(pages, F.coalesce("evidence_pages", F.array().cast("array<bigint>")))) > 0
    rules = (
        (~F.coalesce(F.col("id").rlike("^q[0-9]{3}$"), F.lit(False)), "id"),
        (F.count("*").over(Window.partitionBy("id")) > 1, "duplicate id"),
        (F.coalesce(F.trim("question"), F.lit("")) == "", "question"),
        (~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "category"),
        (~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False)), "difficulty"),
        (~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "type"),
        (F.size(F.filter(pages, lambda p: p.isNull() | (p < 1))) > 0, "page below 1"),
        (F.size(pages) != F.size(F.array_distinct(pages)), "repeated page"),
        (answers & (F.size(pages) == 0), "no pages"),
        (~answers & (F.size(pages) > 0), "pages of an unanswerable question"),
        (stray, "alternate of no expected page"),
        (clash, "alternate that is expected"),
        (empty, "empty alternate"),
        (~F.coalesce("needs_review", F.lit(False)) & unproved, "page without evidence"),
    )
    found = F.filter(F.array(*[F.when(fault, F.lit(name)) for fault, name in rules]), lambda p: p.isNotNull())
    return items.withColumn("problems", found).select("line", "id", F.explode("problems").alias("problem"))
