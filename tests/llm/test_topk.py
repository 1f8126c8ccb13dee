"""Exact search against plain Python, with ties, copies and odd vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=10, every=100):
    kept = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v):
            kept.append((n, i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for n, i, v in kept:
        if i is None or i % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j, m) for m, j, w in kept if m != n and len(w) == len(v))
        out += [(i, r + 1, j, -s) for r, (s, _, j, _) in enumerate(found[:k])]
    return sorted(out, key=str)


def run(spark, rows, k=10, every=100, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, topk.top_k(spark, df, F.col("vec_id") % every == 0, k, **more).collect()), key=str)


def test_query_against_plain_python(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(12)]) for i in range(230)]
    rows += [(300 + i, [0.5] * 12) for i in range(60)] + [(400, rows[3][1]), (400, rows[3][1]), (500, None), (501, [1.0, None] + [0.0] * 10), (600, [float("nan")] + [0.0] * 11), (601, [float("inf")] + [0.0] * 11), (None, [0.5] * 12), (-100, [-0.5] * 12), (700, [0.0] * 12)]
    spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((tuple(r) for r in queries.op12_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()), key=str)
    assert got == plain(rows)


def test_ties_of_one_vector_go_to_the_smallest_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(None, [1.0, 2.0])]
    got = run(spark, rows, k=7)
    assert got == plain(rows, k=7) and [r[2] for r in got if r[0] == 300] == [0, 1, 2, 3, 4, 5, 6]


def test_fewer_candidates_lengths_and_empty_vectors(spark):
    rows = [(0, [1.0]), (1, [-3.0]), (2, [2.0]), (100, [1.0, 1.0]), (101, [4.0, -4.5]), (200, []), (201, []), (300, [1.0, 2.0, 3.0])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == [] and run(spark, [(0, [1.0])]) == []


@pytest.mark.parametrize("bins", [2, 7, 64])
def test_bins_do_not_matter(spark, bins):
    rng = random.Random(bins)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5, 1.0]) for _ in range(5)]) for i in range(120)]
    assert run(spark, rows, k=9, every=20, bins=bins) == plain(rows, k=9, every=20)


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**16 for _ in range(6)]) for i in range(60)]
    assert run(spark, rows, k=4, every=10) == plain(rows, k=4, every=10)
    a = np.array([[2.0**40 + 1, 3.0], [2.0**61, 0.0]])
    assert topk.scores(a, a).tolist() == [[min(topk.MOST, (2**40 + 1) ** 2 + 9), topk.MOST], [topk.MOST, topk.MOST]]


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(150)]
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "TILE", 16)
    assert run(spark, rows, k=5, every=5) == plain(rows, k=5, every=5)
