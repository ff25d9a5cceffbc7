import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quadrat.llm import topk


def brute(rows, every, top=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in kept if i % every == 0}):
        mine = min(v for i, v in kept if i == q)
        found = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in kept if i != q)[:top]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def check(spark, rows, every=3, **more):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % every == 0, **more).collect()))
    clean = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(clean, every)


def test_edges(spark):
    rows = [(0, [0.5, -0.5]), (1, [0.5, -0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [0.0, 0.0]), (7, [1.0]), (8, []), (9, [0.25, 3.0, 7.0]), (None, [1.0, 1.0]), (1, [0.5, -0.5]), (10, [-1.0, 2.0])]
    check(spark, rows)


def test_ties_and_sparse(spark):
    rnd = random.Random(1)
    check(spark, [(i, [rnd.choice([0.0, 0.0, 0.0, 0.5, -0.25]) for _ in range(12)]) for i in range(300)], every=7)


def test_query_blocks(spark):
    rnd = random.Random(2)
    check(spark, [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(150)], every=5, block=8)


@pytest.mark.parametrize("scale", [1e3, 1e5, 1e6])
def test_large_components(spark, scale):
    rnd = random.Random(3)
    check(spark, [(i, [rnd.uniform(-scale, scale) for _ in range(6)]) for i in range(60)])


def test_empty(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect() == []


def test_embeddings(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0).collect())) == brute(rows, 50)
