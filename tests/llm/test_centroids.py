"""op11: exact clustering against a plain computation in Python."""

import hashlib
import random

import duckdb
import pytest

from gleanworks.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance double"


def brute(rows, k, rounds, width, scale=64):
    kept = []
    for r in rows:
        v = r[1]
        if v is not None and len(v) == width and all(x is not None and abs(x) < float("inf") for x in v):
            kept.append((r[0], [int((scale * x) // 1) for x in v]))
    order = sorted((i, v) for i, v in ((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept))
    means = [list(v) for _, v in order[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(means))

    for _ in range(rounds):
        at = [assign(v)[1] for _, v in kept]
        sets = {n: [v for (_, v), a in zip(kept, at, strict=True) if a == n] for n in range(len(means))}
        means = [[sum(col) // len(s) for col in zip(*s, strict=True)] if (s := sets[n]) else m for n, m in enumerate(means)]
    found = [(i, *assign(v)) for i, v in kept]
    by = {n: sum(d for _, d, m in found if m == n) for n in range(len(means))}
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, n, d, by[n], sum(by.values()), digest[n]) for i, d, n in found), key=str)


def made(df):
    return sorted((tuple(r) for r in df.select("vec_id", "assigned.*").collect()), key=str)


@pytest.mark.parametrize("k", [1, 3, 9])
def test_clusters_equal_a_plain_computation(spark, k):
    draw = random.Random(k)
    rows = [(i, [draw.gauss(c := i % 3, 1.0) - c * 2 for _ in range(4)], None, 1, 2.0) for i in range(80)]
    rows += [rows[5]] * 30 + [(None, [0.5, -0.25, 0.0, 1.0], 1, 1, 1.0), (7, [0.5, -0.5, 0.5, -0.5], 1, 1, 1.0)]
    odd = [None, [], [1.0] * 3, [1.0] * 5, [1.0, None, 1.0, 1.0], [float("nan"), 1.0, 1.0, 1.0], [1.0, 1.0, float("inf"), 1.0]]
    rows += [(1000 + n, v, 1, 1, 1.0) for n, v in enumerate(odd)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert made(centroids.cluster(df, k=k, width=4)) == brute(rows, k, 3, 4)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [1.0, 0.0], 1, 1, 1.0) for i in range(5)] + [(9, [0.0, 0.0], 1, 1, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert made(centroids.cluster(df, k=4, width=2)) == brute(rows, 4, 3, 2)


def test_no_vectors_few_vectors_and_refusals(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(none).count() == 0 and centroids.cluster(none).columns[-1] == "assigned"
    one = spark.createDataFrame([(4, [0.1] * 64, 1, 1, 1.0)], SCHEMA)
    assert [tuple(r)[:4] for r in centroids.cluster(one).select("vec_id", "assigned.*").collect()] == [(4, 0, 0, 0)]
    with pytest.raises(ValueError, match="assigned"):
        centroids.cluster(one.withColumnRenamed("cluster", "assigned"))
    with pytest.raises(Exception, match="exceeds"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, 1, 1, 1.0)], SCHEMA)).count()


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(i, [i / 7.0] * 64, 1, 1, 1.0) for i in range(20)], SCHEMA)
    rows = df.where(centroids.usable(df.embedding)).withColumn("v", centroids.integers(df.embedding)).withColumn("n", centroids.F.expr(centroids.squared_norm("v"))).select(centroids.nearest("v", "n", [[1] * 64, [5] * 64]).alias("at"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_its_sql_with_odd_vectors(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(64)], i % 3, 1, 1.0) for i in range(60)] + [(70, None, 1, 1, 1.0), (71, [0.5] * 63, 1, 1, 1.0), (72, [float("nan")] * 64, 1, 1, 1.0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    made = centroids.op11_centroids(spark, str(tmp_path))
    assert sorted(map(tuple, made.collect())) == sorted(con.execute(centroids.SQL).fetchall())
