"""Mixing sources to target weights by iterative proportional fitting.

The corpus is summed into cells of (source, lang, topic). Sweeps rake the cells' token weights
to the target share of every source, every language and every topic in turn, until no
marginal is off by more than a tolerance. A cell's weight against its tokens, scaled to the
tokens wanted in all, is the number of copies of its documents in the mean: over 1 where the
targets want more of a rare cell than there is. A document has the whole part of that number
of copies, and one more by a hash of the document with the rest as its probability, so no
target is missed by a cut at 1. A topic is a class by format and length, no subject.
Everything is built-in Spark functions over tables in the staging folder: only single numbers
reach the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.session import staged, table

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Settings:
    """``targets`` by dimension: the wanted share of the kept tokens of each value named there.

    What the named values of a dimension leave is for its other values, by ``temperature``: their shares of tokens to
    that power, normalized (1 keeps them as they are, 0 makes them even). With no values left
    over, the named shares have to add up to 1. ``fraction`` of all tokens is kept in the mean,
    copies counted. Raking ends at ``tolerance``, or after ``sweeps``: with a warning, or, where
    targets were named, with an error, for the cells cannot meet them. Named values that no
    document has raise, too.
    """

    targets: Mapping[str, Mapping[str, float]] = field(default_factory=dict)

    temperature: Mapping[str, float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.8})
    fraction: float = 0.7
    sweeps: int = 15
    tolerance: float = 1e-4
    seed: int = 11


def token_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A topic by the shape of a text: table, marked (symbols or shouting), note, long or prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(tokens == 0, "empty")
        .when(F.regexp_count(text, F.lit(r" \| ")) * 10 >= tokens, "table")
        .when(F.regexp_count(text, F.lit(r"[#$%&*]{3}|!!")) * 5 >= tokens, "marked")
        .when(tokens < 50, "note")
        .when(tokens >= 1000, "long")
        .otherwise("prose")
    )


def describe(docs: DataFrame, settings: Settings = Settings(), topic: Column | None = None) -> DataFrame:
    """row (all columns of ``docs``), source, lang, topic, tokens and draw (0 to 1) of every document.

    ``topic`` may be any expression over ``docs``; by default it is the class of ``topic_of``.
    A null source, lang or topic is a value of its own, ``(none)``. The draw is a hash of
    doc_id, or of the text where that is null.
    """
    text, tokens = F.col("text").cast("string"), F.col("tokens")
    named = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text))
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(settings.seed)), 11).cast("double") * F.lit(2.0**-53)
    counted = docs.select(F.struct("*").alias("row"), named(F.col("source")).alias("source"), named(F.col("lang")).alias("lang"), text.alias("text"), *([named(topic).alias("topic")] if topic is not None else []), token_count(text).alias("tokens"), draw.alias("draw"))
    return counted.select("row", "source", "lang", (F.col("topic") if topic is not None else topic_of(F.col("text"), tokens)).alias("topic"), "tokens", "draw")


def rake(cells: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Columns ``weight`` (the raked tokens) and ``<dimension>_target`` for cells (source, lang, topic, tokens > 0).

    A sweep scales the cells to the sources', languages' and topics' targets in turn. It is
    the last one if what the later factors do to a cell, and so to an earlier marginal, is
    within the tolerance.
    """
    counted = staged(cells, "cells")
    total = counted.agg(F.sum("tokens")).first()[0]
    if not total:
        return counted.withColumns({"weight": F.col("tokens").cast("double"), **{f"{name}_target": F.col("tokens").cast("double") for name in DIMENSIONS}})
    aimed = counted.withColumn("weight", F.col("tokens").cast("double"))
    for name in DIMENSIONS:
        aimed = aimed.join(aims(counted, name, total, settings), name)
    raked, most = staged(aimed, "cells"), float("inf")
    fixed = [*DIMENSIONS, "tokens", *[f"{name}_target" for name in DIMENSIONS]]
    for _ in range(settings.sweeps):
        swept = raked.select(*fixed, "weight")
        for name in DIMENSIONS:
            held = F.sum("weight")  # 0 where nothing is wanted, or nothing is left
            factor = swept.groupBy(name).agg(F.when(held > 0, F.max(f"{name}_target") / held).when(F.max(f"{name}_target") > 0, F.lit(float("inf"))).otherwise(1.0).alias(f"{name}_factor"))
            swept = swept.join(factor, name).withColumn("weight", F.col("weight") * F.col(f"{name}_factor"))
        of_sources, of_langs = F.col("lang_factor") * F.col("topic_factor"), F.col("topic_factor")
        raked = staged(swept.select(*fixed, "weight", F.greatest(F.abs(of_sources - 1), F.abs(of_langs - 1)).alias("off")), "cells")
        most = raked.agg(F.max(F.when(F.col("weight") != 0, F.col("off")))).first()[0] or 0.0
        if most <= settings.tolerance:
            break
    if not most <= settings.tolerance:
        why = f"raking stopped after {settings.sweeps} sweeps, a marginal up to {most:.2g} off its target: the tolerance is {settings.tolerance:.2g}"
        if settings.targets:
            worst = marginals(raked).orderBy(F.desc(F.abs(F.col("target") - F.col("share")))).limit(3).collect()
            raise ValueError(f"{why}; furthest off: {', '.join(f'{r.dimension} {r.value} {r.share:.4f} for {r.target:.4f}' for r in worst)}")
        warnings.warn(why, stacklevel=2)
    return raked.select(*fixed, "weight")


def aims(cells: DataFrame, name: str, total: int, settings: Settings) -> DataFrame:
    """Each value of a dimension and ``<name>_target``, the tokens wanted of it."""
    named = settings.targets.get(name, {})
    given = F.create_map(*[F.lit(x) for pair in named.items() for x in (str(pair[0]), float(pair[1]))]) if named else F.create_map().cast("map<string,double>")
    values = cells.groupBy(name).agg(F.pow(F.sum("tokens") / F.lit(float(total)), F.lit(float(settings.temperature[name]))).alias("raised")).withColumn("given", F.try_element_at(given, F.col(name)))
    found, others = values.agg(F.count("given"), F.sum(F.when(F.col("given").isNull(), F.col("raised")))).first()
    if found < len(named):
        have = {r[0] for r in values.where("given is not null").select(name).collect()}  # named ones only
        raise ValueError(f"targets for values of {name} that no document has: {sorted(set(map(str, named)) - have)}")
    rest = 1.0 - sum(named.values())
    if min(named.values(), default=0.0) < 0 or rest < -1e-9 or (others is None and abs(rest) > 1e-9):
        raise ValueError(f"the targets of {name} add up to {1.0 - rest}")
    share = F.coalesce("given", F.col("raised") * F.lit(max(0.0, rest) / (others or 1.0)))
    return values.select(name, (share * F.lit(float(total))).alias(f"{name}_target"))


def marginals(raked: DataFrame) -> DataFrame:
    """dimension, value, target and share (of the kept tokens in the mean) of every value of raked cells."""
    rows = raked.select("weight", F.inline(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value"), F.col(f"{n}_target").alias("aim")) for n in DIMENSIONS])))
    by_value = rows.groupBy("dimension", "value").agg(F.max("aim").alias("aim"), F.sum("weight").alias("weight"))
    sums = by_value.groupBy("dimension").agg(F.sum("aim").alias("aims"), F.sum("weight").alias("weights"))  # a row for each dimension
    return by_value.join(F.broadcast(sums), "dimension").select("dimension", "value", (F.col("aim") / F.col("aims")).alias("target"), (F.col("weight") / F.col("weights")).alias("share"))


def mixed(described: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``describe``'s rows with weight, probability and copies.

    ``probability`` is the number of copies in the mean, over 1 for what is repeated;
    ``copies`` is how many a document has. Documents without words have no tokens to weigh:
    weight 1, one copy. Repeated rows are judged alike; an empty table gives an empty result.
    ``described`` is read three times: hand in a staged table.
    """
    cells = described.where("tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    raked = rake(cells, settings)
    total, weighed = raked.agg(F.sum("tokens"), F.sum("weight")).first()
    scale = settings.fraction * total / weighed if total else 1.0
    ratio = F.col("weight") / F.col("tokens")
    weights = raked.select(*DIMENSIONS, ratio.alias("w"), (ratio * F.lit(scale)).alias("p"))
    probability = F.when(F.col("tokens") == 0, 1.0).otherwise(F.coalesce("p", F.lit(1.0)))
    weighed_rows = described.join(weights, list(DIMENSIONS), "left").withColumns({"weight": F.coalesce("w", F.lit(1.0)), "probability": probability}).drop("w", "p")
    whole = F.floor("probability")
    return weighed_rows.withColumn("copies", whole + (F.col("draw") < F.col("probability") - whole).cast("long"))


def mix(docs: DataFrame, settings: Settings = Settings(), topic: Column | None = None) -> DataFrame:
    """``docs`` with __source, __lang, __topic, __tokens, __weight, __probability, __copies and __kept.

    See ``describe`` and ``mixed``. Names that ``docs`` already has are refused: nothing of
    it is overwritten.
    """
    names = ("source", "lang", "topic", "tokens", "weight", "probability", "copies", "kept")
    if clash := {f"__{n}" for n in names} & set(docs.columns):
        raise ValueError(f"columns of the input have names that mixing adds: {sorted(clash)}")
    rows = mixed(staged(describe(docs, settings, topic), "described"), settings).withColumn("kept", F.col("copies") > 0)
    return rows.select("row.*", *[F.col(n).alias(f"__{n}") for n in names])


def copied(docs: DataFrame, settings: Settings = Settings(), topic: Column | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` has copies of it, whatever their columns are called."""
    rows = mixed(staged(describe(docs, settings, topic), "described"), settings).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Weight, mean and drawn number of copies, and decision of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    described = describe(docs).withColumn("row", F.struct("row.doc_id"))  # texts are read once, and not staged
    rows = mixed(staged(described, "described"))
    return rows.select("row.doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), "weight", "probability", "copies", (F.col("copies") > 0).alias("kept"))
