"""Text expressions: white space, words, labels, previews, written numbers, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words too common to be looked up.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them"
    " their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing"
    " a an the and but if or because as until while of at by for with about against between into through during before after above below to"
    " from up down in out on off over under again further then once here there when where why how all any both each few more most other some"
    " such no nor not only own same so than too very s t can will just don should now".split()
)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """The words of a text in order; none for an empty one."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def runs(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def lexemes(text: Column) -> Column:
    """``runs`` without stop words."""
    return F.filter(runs(text), lambda w: ~w.isin(*STOP_WORDS))


def page_label(start: Column, end: Column) -> Column:
    """``23`` or ``23-24``."""
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def preview(text: Column, most: int) -> Column:
    """The collapsed text, cut with an ellipsis beyond ``most`` letters."""
    short = collapse(text)
    return F.when(F.length(short) > most, F.concat(F.substring(short, 1, most), F.lit("…"))).otherwise(short)


def first_line(text: Column) -> Column:
    """What stands before the first line break."""
    return F.split(text, "\n").getItem(0)


def half_up(value: Column, places: int) -> Column:
    """Rounding half up of the decimal as it is written, not of the binary number behind it."""
    return F.round(value.cast("string").cast("decimal(38,12)"), places).cast(f"decimal(38,{places})")


def written(value: Column, places: int, before: str = "", after: str = "") -> Column:
    """A number half-up with so many places, or a dash for null."""
    return F.coalesce(F.concat(F.lit(before), half_up(value, places).cast("string"), F.lit(after)), F.lit("—"))


def iso_date(text: Column) -> Column:
    """The date a text writes as YYYY-MM-DD; null for any other spelling and for no real date."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def contains_quote(quote: Column, text: Column) -> Column:
    """Whether a quote that is not blank stands in a text, but for white space."""
    q = collapse(quote)
    return (q != "") & F.contains(collapse(text), q)


#: Words whose full stop ends no sentence.
ABBREVIATIONS = ("dr", "jr", "mr", "mrs", "ms", "sr", "st", "vs")
#: A mark that no text has: where a sentence may end.
MARK = "\ue000"


def whole_sentences(text: Column) -> Column:
    """The sentences of a text as an array, white space inside them as it is; none for null.

    A mark goes behind every stop (with what it closes) that white space and a capital follow.
    Marks behind the single full stop of an abbreviation or of initials go again, and the rest
    are where the text is cut. A mark in the text itself is lost.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("")), r"([.!?]+[”’\"')\]]*)(?=(?U:\s)+[“‘\"'(\[]*[A-Z])", "$1" + MARK)
    held = rf"((?:^|(?U:\s))[“‘\"'(\[]*(?:(?i:{'|'.join(ABBREVIATIONS)})|(?:[A-Za-z]\.)+[A-Za-z])\.){MARK}"
    cut = F.split(F.regexp_replace(marked, held, "$1"), MARK)
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^(?U:\s)+|(?U:\s)+$", "")), lambda s: s != "")
