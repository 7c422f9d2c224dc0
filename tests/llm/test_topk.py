import math

import pytest
from pyspark.sql import functions as F

from plexgraph.llm import topk


def brute(rows, queries, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[i] = [math.floor(64 * x) for x in v]
    out = []
    for q in queries:
        if q in ints:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def make(seed, n, dims):
    import random

    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]
    hot = rows[3][1]
    rows = [(i, hot if i % 3 == 0 else v) for i, v in rows]  # one vector holds a third of the rows
    return rows + [(n, None), (n + 1, [None] + [0.1] * (dims - 1)), (n + 2, [float("nan")] * dims), (n + 3, [float("inf")] * dims), (n + 4, [0.0] * dims)]


@pytest.mark.parametrize("chunk,block,pivots", [(256, 50_000, 16), (4, 40, 5)])
def test_equals_brute_force(spark, chunk, block, pivots):
    rows = make(2, 240, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("chunk", F.lit(1)).withColumn("cell", F.lit("x"))
    v = topk.scaled(df)
    got = topk.top_k(v, v.filter("vec_id % 5 = 0"), 20, pivots=pivots, chunk=chunk, block_rows=block)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, [i for i, _ in rows if i % 5 == 0], 20)


def test_fewer_partners_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, [0.5]), (3, [])], "vec_id long, embedding array<double>")
    v = topk.scaled(df)
    got = sorted(map(tuple, topk.top_k(v, v, 20).collect()))
    assert got == [(1, 1, 2, 2048), (1, 2, 3, 0), (2, 1, 1, 2048), (2, 2, 3, 0), (3, 1, 1, 0), (3, 2, 2, 0)]
    none = topk.scaled(df.limit(0))
    assert topk.top_k(none, none).count() == 0


def test_wide_values_stay_exact(spark):
    rows = [(i, [float((i * 7919) % 1000 - 500) * 1e4, float(i)]) for i in range(30)]
    v = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(v, v, 3)
    assert sorted(map(tuple, got.collect())) == brute(rows, range(30), 3)


def _share(spark, rows, every, pivots):
    """The share of (query, cell) pairs that are looked at."""
    import numpy as np

    v = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = np.array([r.ints for r in v.orderBy("vec_id").collect()])
    centres = topk._spread(x, pivots)
    data = topk._cells(v, centres, "<i2")
    sums = sorted(data.groupBy("cell").agg(F.max("dist"), F.max("norm"), F.min("along"), F.max("along"), F.max("across")).collect())
    cells, stats = np.array([r[0] for r in sums], dtype=np.int32), np.array([r[1:] for r in sums], dtype=float)
    got = topk.routes(v.filter(F.col("vec_id") % every == 0), x, centres, cells, stats, 21, "<i2").collect()
    return sum(len(r.needs) for r in got) / (len(got) * len(cells))


def test_clustered_vectors_are_pruned(spark):
    import random

    rng = random.Random(5)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [m + rng.gauss(0, 0.08) for m in middles[i % 40]]) for i in range(4000)]
    assert _share(spark, rows, 20, 40) < 0.1
    v = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(v, v.filter("vec_id % 200 = 0"), 20, pivots=40, chunk=8, block_rows=300)
    assert sorted(map(tuple, got.collect())) == brute(rows, range(0, 4000, 200), 20)
