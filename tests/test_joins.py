"""Interval joins, gram look-ups and ranks from sketches, against plain computations."""

import random
import statistics

import pytest

from gleanworks.operators import checks, evals, grams, intervals
from gleanworks.sources import store


@pytest.mark.parametrize("levels", [0, 2, 16])
def test_covers_are_exact_and_small(spark, levels):
    draw = random.Random(levels)
    ranges = [(a := draw.randint(-50, 400), a + draw.choice([-1, 0, 1, 2, 7, 40, 300])) for _ in range(60)] + [(None, 3), (3, None)]
    df = spark.createDataFrame(ranges, "s int, e int")
    for s, e, cut in df.select("s", "e", intervals.dyadic_cover(df.s, df.e, levels)).collect():
        numbers = [n for k, node in (cut or []) for n in range(node << k, (node + 1) << k)]
        assert sorted(numbers) == (list(range(s, e + 1)) if s is not None and e is not None else [])


def test_wide_ranges_stay_few_rows(spark):
    wide = spark.createDataFrame([(1, k, k + 1_000_000) for k in (1, 7, 65_536)], "doc_id int, page_start int, page_end int")
    rows = wide.select(intervals.dyadic_cover(wide.page_start, wide.page_end).alias("c")).collect()
    assert max(len(r.c) for r in rows) <= 2 * intervals.LEVELS + 16
    asked = spark.createDataFrame([(1, p) for p in (0, 1, 500_000, 1_000_001, 1_000_007, 1_065_536, 1_065_537)], "doc_id int, page int")
    got = sorted((r.page, r.page_start) for r in store.page_chunks(wide, asked).collect())
    assert got == sorted((p, s) for p in (0, 1, 500_000, 1_000_001, 1_000_007, 1_065_536, 1_065_537) for s in (1, 7, 65_536) if s <= p <= s + 1_000_000)


def test_points_and_ranges_equal_nested_loops(spark):
    draw = random.Random(5)
    points = [(draw.randint(0, 3), draw.randint(0, 99), i) for i in range(150)] + [(1, None, 900), (None, 4, 901)]
    ranges = [(draw.randint(0, 3), a := draw.randint(0, 99), a + draw.randint(-3, 30), i) for i in range(80)] + [(1, None, 5, 900)]
    p = spark.createDataFrame(points, "g int, x int, i int")
    r = spark.createDataFrame(ranges, "g int, a int, b int, j int")
    met = intervals.points_in_ranges(p, r, ["g"], "x", "a", "b")
    wanted = sorted((i, j) for g, x, i in points for h, a, b, j in ranges if None not in (g, x, h, a, b) and g == h and a <= x <= b)
    assert sorted((m.i, m.j) for m in met.collect()) == wanted
    other = spark.createDataFrame([(g, a, b, j) for g, a, b, j in ranges[:40]], "g int, c int, d int, k int")
    pairs = intervals.overlapping_ranges(r, other, ["g"], ("a", "b"), ("c", "d"))
    wanted = sorted((j, k) for g, a, b, j in ranges for h, c, d, k in ranges[:40] if None not in (a, c) and g == h and a <= b and c <= d and a <= d and c <= b)
    assert sorted((m.j, m.k) for m in pairs.collect()) == wanted
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="both sides"):
        intervals.points_in_ranges(p, p, ["g"], "x", "x", "x")


def test_strings_of_any_length_are_found_where_they_stand(spark):
    draw = random.Random(2)
    letters = "ab é𝄞\n"
    texts = [(i, "".join(draw.choice(letters) for _ in range(draw.randint(0, 25)))) for i in range(60)] + [(60, None), (61, "")]
    strings = [(i, "".join(draw.choice(letters) for _ in range(1 + i % 5))) for i in range(70)] + [(70, ""), (71, None), (72, "a"), (73, "zz"), (74, "zzzz")]
    t, s = spark.createDataFrame(texts, "doc_id int, body string"), spark.createDataFrame(strings, "item_id int, quote string")
    found = grams.containing(s, t)
    wanted = sorted((i, k) for i, q in strings for k, b in texts if q and b and q in b)
    assert sorted((r.item_id, r.doc_id) for r in found.collect()) == wanted
    assert grams.containing(s.where("false"), t).count() == 0 and grams.containing(s, t.where("false")).count() == 0


def test_short_quotes_need_no_nested_loop(spark):
    texts = spark.createDataFrame([(1, "costs  of a\nplan"), (2, "the cost is $5"), (3, None)], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "a"), (2, "cost"), (3, "$5"), (4, "of a"), (5, "the cost is"), (6, " "), (7, "of  a plan"), (8, "s o")], "item_id int, text string")
    found = checks.find_quotes(quotes, texts)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 1), (5, 2), (7, 1), (8, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute_rank(values, p):
    return sorted(values)[max(1, -(-p * len(values) // 100)) - 1]


def test_ranks_equal_sorting(spark):
    draw = random.Random(7)
    groups = {"one": [3.5], "ties": [1.0] * 500 + [2.0], "wide": [draw.lognormvariate(0, 3) for _ in range(3000)], "few": [5.0, -1.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None), ("nan", float("nan")), ("wide", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p0, r.p50, r.p95, r.p100) for r in evals.nearest_rank(df, "g", "v", (0, 50, 95, 100)).collect()}
    assert got == {g: tuple(brute_rank(vs, p) for p in (0, 50, 95, 100)) for g, vs in groups.items()}


def test_sketches_that_err_are_put_right(spark):
    """Bounds of no width miss most ranks; the counts tell, and those groups are counted as a whole."""
    draw = random.Random(8)
    groups = {g: [draw.random() for _ in range(2000)] for g in "abc"}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    for slack in (0.0, -0.1):
        got = {r.g: (r.p10, r.p50) for r in evals.nearest_rank(df, "g", "v", (10, 50), slack=slack).collect()}
        assert got == {g: (brute_rank(vs, 10), brute_rank(vs, 50)) for g, vs in groups.items()}


def test_stored_sketches_of_parts_merge(spark):
    values = [float(i % 997) for i in range(4000)]
    df = spark.createDataFrame([(i % 2, i // 2000, v) for i, v in enumerate(values)], "g int, day int, v double")
    parts = evals.rank_sketches(df.where("day = 0"), "g", "v").unionByName(evals.rank_sketches(df.where("day = 1"), "g", "v"))
    got = {r.g: r.p50 for r in evals.nearest_rank(df, "g", "v", (50,), sketches=evals.merged_sketches(parts, "g")).collect()}
    assert got == {g: brute_rank(values[g::2], 50) for g in (0, 1)}
    assert statistics.median_low(values[0::2]) == got[0]
