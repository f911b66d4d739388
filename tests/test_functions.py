from datetime import date

from pyspark.sql import functions as F

from gleanworks.functions import calendar, money, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'date' if isinstance(v, date) else 'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_collapse_and_labels(spark):
    assert one(spark, text.collapse(F.col("t")), t=" a\t\n b c ") == "a b c"
    assert one(spark, text.words(F.col("t")), t="  ") == []
    assert one(spark, text.page_label(F.col("a"), F.col("b")), a=23, b=23) == "23"
    assert one(spark, text.page_label(F.col("a"), F.col("b")), a=23, b=24) == "23-24"
    assert one(spark, text.preview(F.col("t"), 4), t="abc defg") == "abc …"
    assert one(spark, text.first_line(F.col("t")), t="a\nb") == "a"


def test_dates_and_numbers_as_written(spark):
    assert one(spark, text.iso_date(F.col("t")), t="2026-02-28") == date(2026, 2, 28)
    for bad in ("2026-02-30", "2026-2-3", "26-02-03", "2026-02-28x"):
        assert one(spark, text.iso_date(F.col("t")), t=bad) is None
    assert one(spark, text.written(F.col("v"), 2, before="$"), v=0.125) == "$0.13"
    assert one(spark, text.written(F.col("v").cast("double"), 2), v="x" * 0 + "1.005") == "1.01"


def test_quotes(spark):
    assert one(spark, text.contains_quote(F.col("q"), F.col("t")), q="b  c", t="a b\nc d")
    assert not one(spark, text.contains_quote(F.col("q"), F.col("t")), q="  ", t="a")
    assert not one(spark, text.contains_quote(F.col("q"), F.col("t")), q="B c", t="a b c")


def test_windows_around_the_65th_birthday(spark):
    second = one(spark, calendar.first_window(F.col("b")), b=date(1961, 6, 2))
    first = one(spark, calendar.first_window(F.col("b")), b=date(1961, 6, 1))
    assert (second.starts, second.ends) == (date(2026, 3, 1), date(2026, 9, 30))
    assert (first.starts, first.ends) == (date(2026, 2, 1), date(2026, 8, 31))
    assert one(spark, calendar.turns_65(F.col("b")), b=date(1960, 2, 29)) is None
    cover = lambda b, s: one(spark, calendar.coverage_start(F.col("b"), F.col("s")), b=b, s=s)
    assert cover(date(1961, 6, 2), date(2026, 4, 10)) == date(2026, 6, 1)
    assert cover(date(1961, 6, 1), date(2026, 3, 10)) == date(2026, 5, 1)
    assert cover(date(1961, 6, 1), date(2026, 5, 10)) is None  # the month that no rule names
    assert cover(date(1961, 6, 2), date(2026, 6, 10)) == date(2026, 7, 1)
    assert cover(date(1961, 6, 2), date(2027, 1, 1)) is None
    general = one(spark, calendar.yearly_window(F.col("d"), *calendar.GENERAL), d=date(2026, 4, 1))
    assert general.starts == date(2027, 1, 1)


def test_prices(spark):
    assert [one(spark, money.rerank_units(F.col("n")), n=n) for n in (0, 1, 100, 101)] == [0, 1, 1, 2]
    figures = {r.key: r for r in money.cost_table(spark).collect()}
    assert figures["part_b_standard_premium"].amount_text == "202.90" and figures["part_b_deductible"].amount_text == "283"
