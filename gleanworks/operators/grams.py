"""Texts that contain given strings, by an inverted index of character grams.

Every string is looked up by the gram of its own, up to three characters long, that the fewest
texts hold. Only grams that some string asks for are indexed: they are told apart where a text is
read, and a text has a row for each of them at most. What the index finds is verified in the
text. No string is compared with a text that lacks its rarest gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.session import small, staged

#: Characters of a gram; shorter strings are grams themselves.
SIZE = 3
#: Grams, or strings, that are broadcast; beyond, they are joined.
ASKED = 200_000


def grams(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters of a text; none for a shorter or null one."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def gram_index(texts: DataFrame, asked: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """key, gram: which texts hold which of the ``asked`` grams, all of one of the ``sizes``."""
    own = F.flatten(F.array(*[grams(F.col(text), n) for n in sizes]))
    return texts.select(key, F.explode(own).alias("gram")).join(asked, "gram", "left_semi")


def containing(strings: DataFrame, texts: DataFrame, string: str = "quote", text: str = "body", key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """The rows of ``strings`` with the key of every text that contains them.

    Empty and null strings are in no text, nor is anything in a null text. Strings and texts are
    compared character by character; repeated rows give repeated rows.
    """
    asked = strings.where(F.col(string) != "")
    short = F.least(F.char_length(string), F.lit(size))
    distinct = asked.select(F.col(string).alias("__s")).distinct()
    own = F.coalesce(*[F.when(F.char_length("__s") == n, grams(F.col("__s"), n)) for n in range(1, size)], grams(F.col("__s"), size))
    pairs = staged(distinct.select("__s", F.explode(own).alias("gram")), "grams")
    wanted = small(pairs.select("gram").distinct(), ASKED, "asked")
    sizes = sorted(r[0] for r in asked.select(short.alias("n")).distinct().collect())  # 1 to ``size``
    if not sizes:
        return asked.join(texts.select(key), F.lit(False))
    index = staged(gram_index(texts, wanted, key, text, sizes), "index")
    held = index.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no text holds rules its string out
    rarest = pairs.join(held, "gram", "left").groupBy("__s").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    looked = small(rarest, ASKED, "rarest")
    met = index.join(looked, "gram").select(key, "__s")
    found = met.join(texts.select(key, text), key).where(F.contains(F.col(text), F.col("__s"))).select(key, "__s").distinct()
    return asked.join(found, F.col(string) == F.col("__s")).drop("__s")
