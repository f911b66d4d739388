"""Sharding by a hierarchical weighted hash tree.

A document walks down a tree of regions, racks and shards. At every level each child draws
``-ln(u) / weight`` with ``u`` in (0, 1] hashed from the document's id and the child's name,
and the smallest draw wins, so a child wins in proportion to its weight. When the weight of
a child grows, only its own draw shrinks: rows move into that subtree and between no others.

Law: ``key``. The shard depends on ``doc_id`` and the tree alone. A grown tree takes one more
shard in a region of its own, so every row either stays or moves into the new shard.

Everything here is built-in Spark functions. Rows are numbered within a shard from counts
per input partition, so no shard is ever gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.session import staged, table


@dataclass(frozen=True)
class Leaf:
    """One shard: its number, where it stands and its weight."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


#: Eight equal shards: two regions of two racks of two shards.
EIGHT = tuple(Leaf(i, f"region{i // 4}", f"rack{i // 2}") for i in range(8))
#: The same tree and a ninth shard, alone in a third region.
NINE = (*EIGHT, Leaf(8, "region2", "rack4"))


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def _descend(key: Column, leaves: tuple[Leaf, ...], levels: tuple[str, ...]) -> Column:
    """The shard below the winning child, level by level."""
    level, rest = levels[0], levels[1:]
    children: dict[str, list[Leaf]] = {}
    for leaf in leaves:
        children.setdefault(str(getattr(leaf, level)), []).append(leaf)
    if rest:
        below = {name: _descend(key, tuple(own), rest) for name, own in children.items()}
    else:
        below = {name: F.lit(own[0].shard) for name, own in children.items()}
    if len(below) == 1:
        return next(iter(below.values()))
    draws = [
        F.struct(_draw(key, f"{level}:{name}", sum(x.weight for x in own)).alias("draw"), F.lit(name).alias("name"))
        for name, own in sorted(children.items())
    ]
    winner = F.least(*draws)["name"]
    names = sorted(below)
    chosen = below[names[-1]]
    for name in names[-2::-1]:
        chosen = F.when(winner == name, below[name]).otherwise(chosen)
    return chosen


def shard_of(doc_id: Column, leaves: tuple[Leaf, ...] = EIGHT) -> Column:
    """The shard of a document id; a null id counts as an id of its own."""
    shards = [leaf.shard for leaf in leaves]
    if not leaves or len(set(shards)) != len(shards) or any(not leaf.weight > 0 for leaf in leaves):
        raise ValueError("a tree needs shards with distinct numbers and weights above 0")
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return _descend(key, tuple(leaves), ("region", "rack", "shard")).cast("int")


def assign_shards(docs: DataFrame, leaves: tuple[Leaf, ...] = EIGHT, grown: tuple[Leaf, ...] = NINE) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1; ``text_crc32`` of a null text is
    that of the empty text. ``slot`` numbers a shard's rows gaplessly from 0. Null ids form
    one key; repeated rows keep a slot each; an empty table gives an empty result; other
    columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("part"),
    )
    rows = staged(rows.withColumns({"shard": shard_of(F.col("doc_id"), leaves), "grown_shard": shard_of(F.col("doc_id"), grown)}), "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("place", place).join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard"
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 7, and where a ninth shard would take them."""
    return assign_shards(table(spark, sf_dir, "documents"))
