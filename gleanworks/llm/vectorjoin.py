"""Exact cosine range join of vectors by pivots: near duplicates among embeddings.

Unit vectors at cosine ``c`` lie ``sqrt(2 - 2 c)`` apart, so the join is a metric range join
with that radius. Equal vectors of a label become one class first. Pivots cut space into
cells: a vector belongs to its nearest pivot, in its inner ring (up to two radii) or its
outer one. By the triangle inequality a vector can only have partners in a ring that lies
within the radius of its distance to the ring's pivot, where that pivot is at most two radii
farther than its own; there, and only in cells after its own, it is copied to. Every linked
pair then meets exactly once, in one cell. Cells are joined independently, in blocks of
bounded size, and send out counts and one link per vector and block, never the pairs of a
group.

How many pivots deal a label's vectors out grows with their number, so that a label of one
block is never copied. Within a block all pivots cut again: only rings that may hold
partners are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.arrow import map_batches
from gleanworks.operators.components import connected_components
from gleanworks.session import staged, table

#: Slack for rounding in what is copied; links themselves are judged without it.
ROUNDING = 1e-9
#: Rows and columns of a matrix of cosines.
TILE = 2048


@dataclass(frozen=True)
class Settings:
    """A pivot for every ``per_pivot`` classes, ``pivots`` at most.

    A label is dealt out by one pivot for every ``block`` of its classes. A task holds
    ``block`` members of a cell and compares them with each other, and with ``block`` others
    that pass by.
    """

    least: float = 0.93
    per_pivot: int = 64
    pivots: int = 512
    block: int = 16384

    @property
    def radius(self) -> float:
        return float(np.sqrt(2 - 2 * self.least))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def choose_pivots(sample: np.ndarray, n: int, radius: float) -> np.ndarray:
    """``n`` unit vectors of a sample: first the centres of its dense groups, then far ones.

    Up to half are the vectors with the most others within the radius, none within the radius
    of another; the rest are each the farthest from those before.
    """
    near = _distances(sample, sample) <= radius
    crowd = near.sum(axis=1)
    chosen: list[int] = []
    free = crowd > 1
    while free.any() and 2 * len(chosen) < n:
        k = int(np.where(free, crowd, 0).argmax())
        chosen.append(k)
        free &= ~near[k]
    if not chosen:
        chosen = [0]
    least = _distances(sample, sample[chosen]).min(axis=1)
    while len(chosen) < min(n, len(sample)):
        k = int(least.argmax())
        if least[k] <= 0:
            break
        chosen.append(k)
        least = np.minimum(least, _distances(sample, sample[k : k + 1])[:, 0])
    return sample[chosen]


def cells_of(d: np.ndarray, radius: float) -> np.ndarray:
    """The cell of each vector from its distances to the pivots: nearest pivot, and inner or outer ring.

    The inner ring of a pivot reaches to two radii. A dense group around a pivot is so kept
    apart from what is nearest to that pivot and far from it.
    """
    own = d.argmin(axis=1)
    return 2 * own + (d[np.arange(len(d)), own] > 2 * radius)


def cells_near(d: np.ndarray, cells: np.ndarray, pivots: np.ndarray, radius: float) -> np.ndarray:
    """A mask (vectors, cells) of the cells that may hold partners, each vector's own one included.

    By the triangle inequality a partner is as far from any pivot as the vector, give or take
    the radius: so a vector within the radius of a ring may have partners there, if the
    ring's pivot is at most two radii farther than its own one. In the plane of both pivots
    it also is within the radius of the border between them.
    """
    own = cells // 2
    least = d[np.arange(len(d)), own][:, None]
    slack = radius + ROUNDING
    near = (d <= least + 2 * slack) & (d * d - least * least <= 2 * slack * _distances(pivots, pivots)[own] + ROUNDING)
    return np.stack([near & (d <= 2 * radius + slack), near & (d > 2 * radius - slack)], axis=2).reshape(len(d), -1)


def _roots(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label of the component of every row and column of a bipartite graph."""
    n, m = hit.shape
    left, right, most = np.arange(n), np.arange(n, n + m), n + m
    while True:
        new_right = np.minimum(right, np.where(hit, left[:, None], most).min(axis=0, initial=most))
        new_left = np.minimum(left, np.where(hit, new_right[None], most).min(axis=1, initial=most))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


class _Block:
    """A block's vectors, compared with each other and with those that pass by."""

    def __init__(self, settings: Settings, pivots: np.ndarray):
        self.settings, self.pivots = settings, pivots
        self.parts: list[tuple] = []
        self.closed = False

    def add(self, rep: np.ndarray, copies: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((rep, copies, x))

    def close(self, within: bool) -> None:
        """All of the block's own vectors are there; ``within``: compares them with each other."""
        self.closed = True
        self.rep, self.copies, self.x = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.parts = []
        tiles = [np.arange(at, min(at + TILE, len(self.x))) for at in range(0, len(self.x), TILE)]
        self.cell = np.concatenate([cells_of(_distances(self.x[t], self.pivots), self.settings.radius) for t in tiles])
        self.links = np.zeros(len(self.rep), np.int64)
        self.root = list(range(len(self.rep)))
        order = np.argsort(self.cell, kind="stable")
        names, starts = np.unique(self.cell[order], return_index=True)
        self.members = dict(zip(names.tolist(), np.split(order, starts[1:]), strict=True))
        for rows in tiles if within else []:
            near = self._near(self.x[rows], self.cell[rows])
            for c, own in self.members.items():
                b = rows[near[:, c] & (self.cell[rows] >= c)]
                for a, hit in self._hits(own, self.x[b]):
                    hit &= (self.cell[b] != c)[None] | (a[:, None] < b[None])
                    if hit.any():
                        self._join(a, np.concatenate([a, b]), hit, self.links, b, self.copies[b])

    def _near(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return cells_near(_distances(x, self.pivots), cell, self.pivots, self.settings.radius)

    def _hits(self, own: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(own) if len(y) else 0, TILE):
            a = own[at : at + TILE]
            hit = self.x[a] @ y.T >= self.settings.least
            if hit.any():
                yield a, hit

    def _find(self, k: int) -> int:
        root = self.root
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    def _unite(self, pairs: Iterator[tuple[int, int]]) -> None:
        for k, m in pairs:
            if k != m and (one := self._find(k)) != (two := self._find(m)):
                self.root[max(one, two)] = min(one, two)

    def _join(self, a: np.ndarray, both: np.ndarray, hit: np.ndarray, links: np.ndarray, b: np.ndarray, copies: np.ndarray) -> None:
        """Counts the hits of rows ``a`` and columns ``b``; unites what ``both`` numbers."""
        self.links[a] += (hit * copies[None]).sum(axis=1)
        links[b] += (hit * self.copies[a][:, None]).sum(axis=0)
        left, right = _roots(hit)
        labels = np.concatenate([left, right])[: len(both)]
        self._unite(zip(both.tolist(), both[labels].tolist(), strict=True))

    def visit(self, rep: np.ndarray, copies: np.ndarray, x: np.ndarray) -> list[tuple[int, int, int]]:
        """Compares others with the block's vectors: (rep, links, a linked rep) of those with links."""
        cell = cells_of(_distances(x, self.pivots), self.settings.radius)
        links, other = np.zeros(len(rep), np.int64), np.full(len(rep), -1)
        near = self._near(x, cell)
        for c, own in self.members.items():
            b = np.flatnonzero(near[:, c])
            for a, hit in self._hits(own, x[b]):
                self._join(a, a, hit, links, b, copies[b])
                linked = hit.any(axis=0)
                first = a[hit.argmax(axis=0)]
                self._unite((int(other[k]), int(m)) for k, m in zip(b[linked].tolist(), first[linked].tolist(), strict=True) if other[k] >= 0)
                other[b[linked]] = first[linked]
        return [(int(rep[k]), int(links[k]), int(self.rep[other[k]])) for k in np.flatnonzero(links).tolist()]

    def result(self) -> list[tuple[int, int, int]]:
        """(rep, links, another rep of its component) of the block's own vectors that have links."""
        return [(int(self.rep[k]), int(self.links[k]), int(self.rep[self._find(k)])) for k in np.flatnonzero(self.links).tolist()]


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    """A column of lists of one length as unit vectors, from its buffer."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _runs(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of a batch with equal values in its first columns."""
    keys = list(zip(*(c.to_pylist() for c in batch.columns[:n_keys]), strict=True))
    at = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[at]:
            yield keys[at], batch.slice(at, k - at)
            at = k


def link_vectors(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels and lengths are equal and their cosine is at least
    ``settings.least``. Those with a null label, null or zero vectors and such with null or
    non-finite components link with nothing. Rows without vec_id can't be named: they link
    with nothing, have no component_id and are kept. A row that repeats vec_id, label and
    vector is the same vector again. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("valid", valid)
    classes = staged(rows.where("valid").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")).withColumn("length", F.size("v")), "vector-classes")

    n = classes.count()
    wanted = max(1, min(settings.pivots, -(-n // settings.per_pivot)))
    # at most 4 * settings.pivots vectors: a proven bound
    sample = classes.orderBy(F.xxhash64("rep", "label"), "rep").limit(4 * wanted).select("v").collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    radius, most = settings.radius, settings.block
    shared = spark.sparkContext.broadcast({length: choose_pivots(_vectors(pa.array(found), length), wanted, radius) for length, found in by_length.items()})
    label_type = rows.schema["label"].dataType.simpleString()
    group = ["label", "length"]
    dealers = classes.groupBy(*group).agg(F.least(F.lit(wanted), F.ceil(F.count("*") / most)).cast("int").alias("dealers"))

    def pivots_of(length: int) -> np.ndarray:
        """A length that the sample missed has one pivot: no vector is far from it by mistake."""
        known = shared.value.get(length)
        return known if known is not None else np.eye(1, length)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        source, cells, replica = [], [], []
        at = 0
        for (_, length, n_dealers), part in _runs(batch, 3):
            pivots = pivots_of(length)[:n_dealers]
            d = _distances(_vectors(part.column(3), length), pivots)
            own = cells_of(d, radius)
            if n_dealers == 1:  # one cell: its rings are told apart where it is joined
                own[:] = 0
                near = np.ones((len(own), 1), bool)
            else:
                near = cells_near(d, own, pivots, radius)
            k, c = np.nonzero(near & (np.arange(near.shape[1])[None] > own[:, None]))
            source += [np.arange(at, at + len(own)), k + at]
            cells += [own, c]
            replica += [np.zeros(len(own), bool), np.ones(len(c), bool)]
            at += len(own)
        taken = batch.take(pa.array(np.concatenate(source)))
        made = [pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(replica))]
        return pa.RecordBatch.from_arrays([*(taken.column(i) for i in (0, 1, 3, 4, 5)), *made], ["label", "length", "v", "rep", "copies", "cell", "replica"])

    named = classes.join(dealers, group).select(*group, "dealers", "v", "rep", "copies")
    dealt = staged(map_batches(named, deal, f"label {label_type}, length int, v array<double>, rep bigint, copies bigint, cell int, replica boolean"), "dealt")
    cell = [*group, "cell"]
    sizes = dealt.groupBy(*cell).agg(F.count_if(~F.col("replica")).alias("own"), F.count_if("replica").alias("others"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int")
    sizes = sizes.where("own > 0 and own + others > 1").select(*cell, blocks("own").alias("n_own"), blocks("others").alias("n_others"))
    placed = dealt.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("replica"), F.col("n_others")).otherwise(F.col("n_own"))).cast("int"))
    span = F.sequence(F.lit(0), F.greatest("n_own", "n_others") - 1)
    place = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    as_left = F.transform(span, lambda j: place(F.col("block"), j, 0))
    as_right = F.transform(F.filter(F.sequence(F.lit(0), F.col("n_own") - 1), lambda i: i < F.col("block")), lambda i: place(i, F.col("block"), 1))
    as_copy = F.transform(F.sequence(F.lit(0), F.col("n_own") - 1), lambda i: place(i, F.col("block"), 1))
    spread = placed.withColumn("at", F.explode(F.when(F.col("replica"), as_copy).otherwise(F.concat(as_left, as_right))))
    spread = spread.select(*cell, "at.i", "at.j", "at.role", "rep", "copies", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: a block's own vectors, then those that pass by."""
        block, name = None, None
        found: list[tuple[int, int, int]] = []

        def ended() -> list[tuple[int, int, int]]:
            if block is None:
                return []
            if not block.closed:
                block.close(name[3] == name[4])
            return block.result()

        for batch in batches:
            for (*key, role), part in _runs(batch, 6):
                if key != name:
                    found += ended()
                    block, name = _Block(settings, pivots_of(key[1])), key
                for at in range(0, part.num_rows, TILE):
                    tile = part.slice(at, TILE)
                    values = tile.column(6).to_numpy(), tile.column(7).to_numpy(), _vectors(tile.column(8), key[1])
                    if role == 0:
                        block.add(*values)
                        continue
                    if not block.closed:
                        block.close(name[3] == name[4])
                    found += block.visit(*values)
            if len(found) >= 10_000:
                yield made(found)
                found = []
        found += ended()
        if found:
            yield made(found)

    def made(found):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], ["rep", "links", "other"])

    keys = [*cell, "i", "j"]
    linked = staged(spread.repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(compare, "rep bigint, links bigint, other bigint"), "vector-links")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(linked, "rep", "other").withColumnRenamed("node", "rep")
    named = classes.join(counts, "rep", "left").join(components, "rep", "left").where("copies > 1 or links is not null")
    named = named.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    judged = rows.where("valid").join(named, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    rest = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_vector_join(spark, sf_dir: str) -> DataFrame:
    """Links and components among all embeddings of equal labels, from a cosine of 0.93 on."""
    return link_vectors(table(spark, sf_dir, "embeddings"))
