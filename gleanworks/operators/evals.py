"""Metrics of retrieval and answers, rolled up by run and by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.operators.intervals import points_in_ranges
from gleanworks.session import small, staged

#: Groups whose bounds are broadcast; beyond, they are joined.
GROUPS = 100_000
#: Accuracy of rank sketches, and how far from a rank their bounds are put: about three times the usual error.
SKETCH_K, SLACK = 400, 0.02


def covers(start: Column, end: Column, page: Column) -> Column:
    """Whether an inclusive page range holds a page."""
    return page.between(start, end)


def expected_pages(items: DataFrame) -> DataFrame:
    """qid, page, satisfies: a row per expected page and page that satisfies it.

    ``items`` has qid, expected (array) and alternates (map of page to array).
    """
    page = items.select("qid", "alternates", F.explode("expected").alias("page"))
    own = F.array_distinct(F.concat(F.array("page"), F.coalesce(F.try_element_at("alternates", F.col("page")), F.array().cast("array<bigint>"))))
    return page.select("qid", "page", F.explode(own).alias("satisfies"))


def golden_pages(questions: DataFrame, golden: DataFrame) -> DataFrame:
    """qid, page, satisfies of stored questions (qid, expected): by their golden item, or by their own pages where there is none."""
    known = golden.select("qid", F.col("expected").alias("g"), "alternates", F.lit(True).alias("has"))
    joined = questions.select("qid", "expected").join(known, "qid", "left")
    return expected_pages(joined.select("qid", F.when(F.col("has"), F.col("g")).otherwise(F.col("expected")).alias("expected"), "alternates"))


def coverage(items: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, page, rank: the best rank of a passage that covers each expected page; null if none."""
    wanted = expected_pages(items)
    met = points_in_ranges(wanted, hits.select("qid", "rank", "page_start", "page_end"), ["qid"], "satisfies", "page_start", "page_end")
    best = met.groupBy("qid", "page").agg(F.min("rank").alias("rank"))
    return wanted.select("qid", "page").distinct().join(best, ["qid", "page"], "left")


def retrieval_metrics(items: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, page_hit, page_recall, reciprocal_rank; null for questions that expect no page."""
    found = coverage(items, hits).groupBy("qid").agg(F.count("rank").alias("n_found"), F.count("*").alias("n_pages"), F.min("rank").alias("first"))
    scored = items.select("qid").join(found, "qid", "left")
    return scored.select(
        "qid",
        F.when(F.col("n_pages") > 0, (F.col("n_found") > 0).cast("double")).alias("page_hit"),
        (F.col("n_found") / F.col("n_pages")).alias("page_recall"),
        F.when(F.col("n_pages") > 0, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
    )


def bucket(rank: Column, shown: int = 5, pool: int = 20) -> Column:
    """1-5, 6-20, 21+ or absent."""
    return F.when(rank.isNull(), "absent").when(rank <= shown, f"1-{shown}").when(rank <= pool, f"{shown + 1}-{pool}").otherwise(f"{pool + 1}+")


def average_precision(rows: DataFrame, by: str = "qid") -> DataFrame:
    """by, average_precision of (by, rank, useful) rows: 0 without a useful one."""
    found = F.sum(F.col("useful").cast("int")).over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    at = rows.withColumn("precision", F.when(F.col("useful"), found / F.col("rank")))
    return at.groupBy(by).agg(F.coalesce(F.avg("precision"), F.lit(0.0)).alias("average_precision"))


def _told(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def rank_sketches(rows: DataFrame, by: str, value: str, k: int = SKETCH_K) -> DataFrame:
    """by, n, sketch: a mergeable sketch of the ranks of each group's values, to be stored."""
    told = rows.where(_told(value))
    return told.groupBy(by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: str) -> DataFrame:
    """Stored sketches of several days or parts as one of each group."""
    return sketches.groupBy(by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def nearest_rank(rows: DataFrame, by: str, value: str, percents: tuple[float, ...], sketches: DataFrame | None = None, slack: float = SLACK) -> DataFrame:
    """by, p50, ...: values at rank max(1, ceil(p n / 100)); null and NaN take no part, and a group of those has no row."""
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * F.lit(float(p)) / 100, 6)))
    return values_at(rows, by, value, {f"p{p}": (p / 100, rank(p)) for p in percents}, sketches, slack)


def values_at(rows: DataFrame, by: str, value: str, spots: dict[str, tuple[float, Column]], sketches: DataFrame | None = None, slack: float = SLACK) -> DataFrame:
    """by and a column for each spot: the value at a rank, given as about what share of the rows it is and as an expression of ``n``.

    Sketches (those given, of just these rows, or made in a first scan) tell two values that
    the rank should lie between. A second scan counts what lies under them, and what lies between
    by value, so that a few hundredths of a group are ranked, and a group of any size is no
    one's task. A sketch may err: groups whose rank does not lie between, as the counts show, are
    counted by value as a whole.
    """
    told = rows.where(_told(value)).select(F.col(by).alias("__by"), F.col(value).alias("v"))
    made = rank_sketches(rows, by, value) if sketches is None else sketches
    bound = lambda share: F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, share))))
    asked = F.array(*[F.struct(F.lit(name).alias("spot"), rank.cast("long").alias("rank"), bound(share - slack).alias("low"), bound(share + slack).alias("high")) for name, (share, rank) in spots.items()])
    spans = small(made.select(F.col(by).alias("__by"), asked.alias("spans")), GROUPS, "spans")
    near = told.join(spans, "__by").select("__by", "v", F.explode("spans").alias("s")).where(F.col("v") <= F.col("s.high"))
    inside = F.when(F.col("v") >= F.col("s.low"), F.col("v"))
    found = staged(_at_ranks(near.select("__by", F.col("s.spot").alias("spot"), F.col("s.rank").alias("rank"), inside.alias("v"))), "ranks")
    missed = found.where("v is null").select("__by", "spot", "rank")
    if not missed.isEmpty():
        whole = told.join(small(missed, GROUPS * len(spots), "missed"), "__by")
        found = found.where("v is not null").unionByName(_at_ranks(whole.select("__by", "spot", "rank", "v")))
    kind = dict(rows.dtypes)[value]
    return found.groupBy(F.col("__by").alias(by)).agg(*[F.min(F.when(F.col("spot") == name, F.col("v"))).cast(kind).alias(name) for name in spots])


def _at_ranks(values: DataFrame) -> DataFrame:
    """__by, spot, rank, v: the value at the rank of each spot, of (__by, spot, rank, v) rows; null where it lies under all values told, or over them.

    A null value is what is only known to lie under the others.
    """
    counts = values.groupBy("__by", "spot", "rank", "v").agg(F.count("*").alias("of"))
    upto = F.sum("of").over(Window.partitionBy("__by", "spot").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("upto", upto).withColumn("upto", F.when(F.col("upto") >= F.col("rank"), F.col("upto")))
    return reached.groupBy("__by", "spot", "rank").agg(F.min_by("v", "upto").alias("v"))


def manual_pass(verdict: Column) -> Column:
    """Passes among verdicts given; null when none was."""
    return F.try_divide(F.count_if(verdict == "pass"), F.count(verdict))


def latest(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The row of each ``by`` that is last in ``order``."""
    named = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*named), F.struct(*order)).alias("last")).select(by, "last.*")
