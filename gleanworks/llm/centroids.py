"""Centroid clustering of integer vectors with Spark's own expressions.

Vectors become integers, so every distance and every mean is exact and no order of adding
can change a result. ``zip_with`` and ``aggregate`` give the product with, and so the squared distance to, each
centroid, an array literal; the least struct of (distance, number) is the assignment. New
centroids are column sums by cluster, which are added up where the rows lie: a round
shuffles one row of sums for each cluster and task, whatever the number of vectors. Only
``k`` rows of sums come to the driver in a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.session import spread, staged, table

K, ROUNDS, WIDTH, SCALE, SEED = 16, 3, 64, 64, 1
#: The largest integer component: squared distances of 64 of them stay below 2**63.
LARGEST = 1 << 27


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Each component x as floor(scale * x); one beyond ``LARGEST`` raises."""
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    fits = lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < F.lit(float(LARGEST))
    return F.transform(vector, lambda x: F.when(fits(x), whole(x)).otherwise(F.raise_error(F.lit(f"a component times {scale} exceeds {LARGEST}")).cast("long")))


def usable(vector: Column, width: int = WIDTH) -> Column:
    """True for vectors of ``width`` components, none of them null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    return F.coalesce((F.size(vector) == width) & F.forall(vector, finite), F.lit(False))


def long_array(values: list[int]) -> str:
    """An array literal as SQL text: parsed at once, where one call of the JVM for every number would take seconds."""
    return f"array({', '.join(f'{v}L' for v in values)})"


def squared_norm(vector: str) -> str:
    """The sum of the squares of an integer vector."""
    return f"aggregate({vector}, 0L, (total, x) -> total + x * x)"


def squared_distance(vector: str, norm: str, centroid: list[int]) -> str:
    """The squared Euclidean distance of integer vectors: both norms less twice the product, all exact."""
    product = f"aggregate(zip_with({vector}, {long_array(centroid)}, (a, b) -> a * b), 0L, (total, x) -> total + x)"
    return f"{norm} + {sum(x * x for x in centroid)}L - 2L * {product}"


def nearest(vector: str, norm: str, centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid, the smaller number on ties; ``norm`` is the vector's squared norm."""
    each = (f"struct({squared_distance(vector, norm, c)} AS distance, {k} AS cluster)" for k, c in enumerate(centroids))
    return F.expr(f"array_min(array({', '.join(each)}))")


def seeds(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The vectors with the ``k`` smallest sha256 of ``<seed>:<id>``; ids that repeat go by vector, null ids come last."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__id").cast("string")), 256)
    first = vectors.select(drawn.alias("h"), "__v").orderBy(F.col("h").asc_nulls_last(), "__v").limit(k)
    return [list(r["__v"]) for r in first.collect()]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floors of exact means; empty clusters stay."""
    width = range(len(centroids[0]))
    at = vectors.select("__v", nearest("__v", "__n", centroids)["cluster"].alias("c"))
    sums = at.groupBy("c").agg(F.expr("count(*) AS n"), *(F.expr(f"sum(__v[{i}]) AS s{i}") for i in width))
    floors = ", ".join(f"(s{i} - pmod(s{i}, n)) div n" for i in width)
    new = {r["c"]: r["m"] for r in sums.selectExpr("c", f"array({floors}) AS m").collect()}
    return [new.get(c, old) for c, old in enumerate(centroids)]


def cluster(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Columns of ``df`` whose vectors are usable, with a struct ``assigned``.

    ``assigned`` holds cluster, distance, cluster_inertia, inertia and centroid_sha256. Rows
    with other vectors (null, of another width, with null or non-finite components) are left
    out; repeated rows are vectors of their own; with fewer than ``k`` vectors there are as
    many centroids; an empty table gives an empty result. A column ``assigned`` of the input
    is refused. Components whose integers exceed ``LARGEST`` raise rather than overflow.
    """
    if clash := {"assigned", "__id", "__v", "__n"} & set(df.columns):
        raise ValueError(f"columns of the input have names that clustering adds: {sorted(clash)}")
    rows = spread(df, id_column).where(usable(F.col(f"`{vector_column}`"), width)).withColumn("__id", F.col(f"`{id_column}`")).withColumn("__v", integers(F.col(f"`{vector_column}`"), scale)).withColumn("__n", F.expr(squared_norm("__v")))
    vectors = rows.select("__id", "__v", "__n")
    centroids = seeds(vectors, k, seed)
    kind = "assigned struct<cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string>"
    if not centroids:
        return rows.drop("__id", "__v", "__n").withColumn("assigned", F.lit(None).cast(kind.removeprefix("assigned ")))
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    final = staged(rows.withColumn("__at", nearest("__v", "__n", centroids)).drop("__id", "__v", "__n"), "clustered")
    sums = {r["c"]: r["s"] for r in final.groupBy(F.col("__at.cluster").alias("c")).agg(F.sum("__at.distance").alias("s")).collect()}
    number = F.col("__at.cluster")
    hashes = F.expr(f"array({', '.join(f"sha2('{','.join(map(str, c))}', 256)" for c in centroids)})")
    assigned = F.struct(
        number.alias("cluster"),
        F.col("__at.distance").alias("distance"),
        F.expr(long_array([sums.get(c, 0) for c in range(len(centroids))]))[number].alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        hashes[number].alias("centroid_sha256"),
    )
    return final.withColumn("assigned", assigned).drop("__at")


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    """All vectors of 64 finite components in 16 clusters after 3 rounds."""
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "assigned.*")


def _sql() -> str:
    """The same in DuckDB: vectors in long form, one group of common table expressions a round."""
    parts = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {K}))",
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"d{n} AS (SELECT r, k, list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: (v.v[i] - c{n}.v[i]) * (v.v[i] - c{n}.v[i])))::BIGINT AS d FROM v, c{n})")
        parts.append(f"a{n} AS (SELECT r, m.k AS k, m.d AS d FROM (SELECT r, min({{'d': d, 'k': k}}) AS m FROM d{n} GROUP BY r))")
        if n < ROUNDS:
            means = f"m{n} AS (SELECT k, i, (sum(x) // count(*) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS m FROM (SELECT k, unnest(range(1, {WIDTH + 1})) AS i, unnest(v) AS x FROM a{n} JOIN v USING (r)) GROUP BY k, i)"
            parts += [means, f"c{n + 1} AS (SELECT k, coalesce(w.v, c{n}.v) AS v FROM c{n} LEFT JOIN (SELECT k, list(m ORDER BY i) AS v FROM m{n} GROUP BY k) AS w USING (k))"]
    last = f"a{ROUNDS}"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256 FROM {last} JOIN v USING (r) JOIN c{ROUNDS} USING (k)"
    )


SQL = _sql()
