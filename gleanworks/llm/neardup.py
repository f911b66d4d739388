"""Near duplicates by SetSketch registers, banded, estimated by likelihood and verified.

Every document's set of word shingles is hashed and sketched on its own: register ``i`` is
``floor(1 - log_b h)`` of the least exponential draw ``h`` of the set's members, truncated to
``0..q + 1``. Sketches of parts merge by the larger register, and two registers agree about
as often as the sets overlap. Equal sets become one class at once. Classes that agree in all
registers of a band share its bucket:

* In a first round every member of a bucket is compared with the bucket's smallest member.
* Buckets whose members are not yet in one component are then compared within, in blocks,
  between different components only. Candidates are drawn from the sketches and confirmed
  inside a task, and only links that join components leave it.

Pairs whose likelihood estimate comes near the threshold are candidates, and each is confirmed
on the full sets before it becomes a link. So no group of copies
is expanded into its pairs, and a link is given up only where it joins what other links have
joined already. Two sets at the threshold of 0.8 share none of 32 bands of 5 registers with
probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from gleanworks.llm.arrow import map_batches, utf8
from gleanworks.operators.components import connected_components
from gleanworks.session import staged, table

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Settings:
    """Shingle length, least similarity in hundredths, and the shape of the sketch.

    ``base``, ``rate`` and ``most`` are SetSketch's b, a and q + 1; ``margin`` is how far under
    the threshold an estimate may fall and still be verified (5 standard deviations).
    ``block`` members of a bucket are compared in one task at a time.
    """

    words: int = 5
    least: int = 80
    bands: int = 32
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    most: int = 65535
    margin: float = 0.15
    block: int = 2048

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles; fewer words than one takes are one shingle."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(h))
    n = len(h) - k + 1
    mixed = np.full(n, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _draws(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 64, settings.registers, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, settings.registers, np.uint64)


def registers(members: np.ndarray, draws: tuple[np.ndarray, np.ndarray], settings: Settings) -> np.ndarray:
    """SetSketch registers of a set of hashes, as uint16."""
    a, b = draws
    top = np.zeros(settings.registers, np.uint64)
    for i in range(0, len(members), 1024):
        top = np.maximum(top, (members[i : i + 1024, None] * a + b).max(axis=0))
    least = -np.log1p(-((~top).astype(np.float64) + 0.5) / 2.0**64) / settings.rate
    return np.clip(np.floor(1 - np.log(least) / np.log(settings.base)), 0, settings.most).astype(np.uint16)


def likelihood_slope(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float, base: float) -> np.ndarray:
    """Derivative at ``similarity`` of the joint log likelihood of two sketches.

    ``more``, ``less`` and ``equal`` count the registers where the first is larger, smaller
    and equal; set sizes are known. The likelihood is concave, so the estimate is at least
    ``similarity`` where the slope is not negative.
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    c = (base - 1) / base
    x, y = np.maximum(u - v * similarity, 1e-12), np.maximum(v - u * similarity, 1e-12)
    p, q = -np.log1p(-c * x) / np.log(base), -np.log1p(-c * y) / np.log(base)
    dp, dq = -v * c / (1 - c * x) / np.log(base), -u * c / (1 - c * y) / np.log(base)
    return more * dp / p + less * dq / q - equal * (dp + dq) / np.maximum(1 - p - q, 1e-12)


def _near(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, settings: Settings) -> np.ndarray:
    """Which pairs of sketches may reach the threshold."""
    sizes = 100 * np.minimum(n_a, n_b) >= settings.least * np.maximum(n_a, n_b)
    slope = likelihood_slope((a > b).sum(axis=-1), (a < b).sum(axis=-1), (a == b).sum(axis=-1), n_a, n_b, settings.least / 100 - settings.margin, settings.base)
    return sizes & (slope >= 0)


def sketch(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_shingles, set (a fingerprint of 128 bits) and registers of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        draws = _draws(settings)
        n, prints, sketches = [], [], []
        for text in utf8(batch.column(1)):
            members = shingles(text or b"", settings.words)
            n.append(len(members))
            prints.append(xxh3_128_digest(members.tobytes()) if len(members) else None)
            sketches.append(registers(members, draws, settings).tobytes() if len(members) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "set", "registers"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id bigint, n_shingles bigint, set binary, registers binary")


def _estimated(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose sketches may reach the threshold."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {settings.least} * greatest(n_a, n_b)").select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_a, n_b = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
        r_a, r_b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, settings.registers) for i in (4, 5))
        return batch.select([0, 1]).filter(pa.array(_near(r_a, r_b, n_a, n_b, settings)))

    return map_batches(both, run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"t_{x}"))  # noqa: E731  # a row for each set of a repeated id
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for a, t_a, t_b in zip(batch.column(0).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                if last != (a, t_a):
                    last, own = (a, t_a), shingles(t_a, settings.words)
                other = shingles(t_b, settings.words)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= settings.least * (len(own) + len(other) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def _links_of_block(rows: list[tuple], settings: Settings) -> list[tuple[int, int]]:
    """Links that join the components of a block's members, as far as they are not joined yet.

    Rows are (rep, component, n, registers, text, centre, band, block). A pair is looked at
    where it first shares a band, once; pairs with the centre were looked at before.
    """
    rows = list({(r[0], r[4]): r for r in rows}.values())
    rep = np.array([r[0] for r in rows])
    component = [r[1] for r in rows]
    n = np.array([r[2] for r in rows], float)
    sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), settings.bands, settings.rows)
    centre, band = rows[0][5], rows[0][6]
    block = np.array([r[7] for r in rows])
    cross = bool((block != block[0]).any())
    names, sizes = np.unique(component, return_counts=True)
    rank = dict(zip(names.tolist(), np.argsort(np.argsort(sizes, kind="stable"), kind="stable").tolist(), strict=True))
    order = np.array([rank[c] for c in component])
    root = {c: c for c in names.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    sets: dict[int, np.ndarray] = {}

    def members(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingles(rows[k][4], settings.words)
        return sets[k]

    links = []
    for i in np.flatnonzero(rep != centre).tolist():  # against the larger components only: the largest has no turn
        at = np.flatnonzero((order > order[i]) & (rep != centre) & (block != block[i] if cross else True))
        at = at[(sketches[at] == sketches[i]).all(axis=2).argmax(axis=1) == band]
        if len(at):
            at = at[_near(sketches[i].reshape(1, -1), sketches[at].reshape(len(at), -1), n[i], n[at], settings)]
        for j in at.tolist():
            one, other = find(component[i]), find(component[j])
            if one == other:
                continue
            common = len(np.intersect1d(members(i), members(j), assume_unique=True))
            if 100 * common >= settings.least * (len(members(i)) + len(members(j)) - common):
                links.append((int(rep[i]), int(rep[j])))
                root[one] = other
    return links


def _within_buckets(open_rows: DataFrame, settings: Settings) -> DataFrame:
    """Confirmed links (a, b) between the components that share a bucket.

    Rows come sorted by bucket and block; a block is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        held, name = [], None
        for batch in batches:
            found = []
            columns = [utf8(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in batch.columns]
            for bucket, i, j, *row in zip(*columns, strict=True):
                if (bucket, i, j) != name:
                    if len(held) > 1:
                        found += _links_of_block(held, settings)
                    held, name = [], (bucket, i, j)
                held.append(tuple(row))
            if found:
                yield made(found)
        if len(held) > 1:
            yield made(_links_of_block(held, settings))

    blocks = F.ceil(F.col("members") / settings.block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    spread = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "component", "n", "registers", "text", "centre", "band", F.col("own").alias("block"))
    return spread.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


def _texts_of(docs: DataFrame, wanted: DataFrame, repeated: DataFrame | None, settings: Settings) -> DataFrame:
    """(rep, set, text): one text for each (rep, set) of ``wanted``.

    A document with one row has one set; only the rows of ``repeated`` ids are hashed again
    to tell which text has which set.
    """
    ids = wanted.withColumnRenamed("rep", "doc_id")
    text = F.coalesce("text", F.lit("")).alias("text")
    if repeated is None:
        return docs.join(ids, "doc_id").select(F.col("doc_id").alias("rep"), "set", text)
    once = docs.join(ids.join(repeated, "doc_id", "left_anti"), "doc_id").select(F.col("doc_id").alias("rep"), "set", text)
    again = docs.join(ids.join(repeated, "doc_id", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [xxh3_128_digest(shingles(t, settings.words).tobytes()) for t in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), batch.column(1)], ["rep", "set", "text"])

    told = map_batches(again, run, "rep bigint, set binary, text string").join(wanted, ["rep", "set"], "left_semi").dropDuplicates(["rep", "set"])
    return once.unionByName(told)


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept.

    A null, empty or blank text has no shingles and links with nothing. Rows without a doc_id
    can't be named: they link with nothing, have no component_id and are kept. Rows that
    repeat a doc_id are one document, which links by the set of any of its rows; each row has
    its own n_shingles, all have the same component_id and decision. An empty table gives an
    empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = staged(sketch(docs, settings), "sketches")
    classes = staged(
        sketches.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.count("*").alias("copies")),
        "classes",
    )
    repeated = staged(sketches.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    any_repeated = not repeated.isEmpty()
    step = 2 * settings.rows
    keys = F.array(*[F.xxhash64(F.substring("registers", step * k + 1, step), F.lit(k)) for k in range(settings.bands)])
    banded = classes.select("rep", "set", F.posexplode(keys).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).where("members > 1")
    buckets = staged(banded.join(shared, "bucket"), "buckets")
    texts = staged(_texts_of(docs, buckets.select("rep", "set").distinct(), repeated if any_repeated else None, settings), "texts")

    first = buckets.where("rep != centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirmed(_estimated(first, classes, settings), texts, settings)
    if any_repeated:  # the classes of one document
        own = sketches.join(repeated, "doc_id", "left_semi").select("doc_id", "set").distinct().join(classes.select("set", "rep"), "set")
        links = links.unionByName(own.where("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    found = connected_components(staged(links, "first-links"))

    placed = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    opened = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    open_rows = placed.join(opened, "bucket").join(classes.select("rep", "set", "n", "registers"), ["rep", "set"]).join(texts, ["rep", "set"])
    more = staged(_within_buckets(open_rows, settings), "more-links")
    # components of components: what the second round joins of the first one's
    name = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    merged = connected_components(more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))
    # left joins only: adaptive execution splits a large component on the left side
    wider = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left")
    alone = merged.join(found.select("node"), "node", "left_anti").select(F.col("node").alias("rep"), "component")
    final = wider.select(F.col("node").alias("rep"), F.coalesce("wider", "component").alias("component")).unionByName(alone)
    named = classes.select("set", "rep", "copies").join(final, "rep", "left").where("component is not null or copies > 1").select("set", F.coalesce("component", "rep").alias("component"))
    judged = sketches.select("doc_id", "n_shingles", "set").join(named, "set", "left").withColumn("component", F.coalesce("component", "doc_id"))
    if any_repeated:  # a row without shingles goes by the document's other rows
        by_id = judged.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("lowest"))
        judged = judged.join(by_id, "doc_id", "left").withColumn("component", F.coalesce("lowest", "component"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return judged.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, on shingles of two words."""
    return near_duplicates(table(spark, sf_dir, "documents"), Settings(words=2))
