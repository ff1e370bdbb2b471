"""The index of cells against brute force: exact results, recall with few cells visited, groups cut by hash, greedy order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.operators import neighbours


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(4)
    middle = unit(r.normal(size=(40, 24)))
    x = unit(middle[r.integers(0, 40, 1200)] + r.normal(size=(1200, 24)) * 0.12)
    x[7] = 0  # an empty text
    x[50:70] = x[49]  # copies
    return x


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} long, vector array<double>")


def brute(x, q, k):
    dots = np.round(q @ x.T, 3)
    return [[(int(j), float(row[j])) for j in np.lexsort((np.arange(len(x)), -row))[:k]] for row in dots]


@pytest.mark.parametrize("cut", [False, True])
def test_exact_results(spark, vectors, monkeypatch, cut):
    if cut:
        monkeypatch.setattr(neighbours, "STORED", 16)
        monkeypatch.setattr(neighbours, "ASKED", 5)
    index = neighbours.Index(frame(spark, vectors))
    assert len(index.centres) > 5 and index.count.sum() == len(vectors)
    asked = vectors[::20]
    queries = frame(spark, asked, "query_id")
    for k in (1, 6):
        got = {}
        for r in neighbours.nearest(index, queries, k, probes=None).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
        assert [got[i] for i in range(len(asked))] == brute(vectors, asked, k)
    index.release()


def test_recall_with_few_cells(spark, vectors):
    index = neighbours.Index(frame(spark, vectors))
    asked = vectors[::20]
    want = brute(vectors, asked, 10)
    found = {(r["query_id"], r["id"]) for r in neighbours.nearest(index, frame(spark, asked, "query_id"), 10, probes=6).collect()}
    hits = sum((i, j) in found for i, row in enumerate(want) for j, _ in row)
    assert hits / sum(map(len, want)) >= 0.9
    # At the threshold of the duplicates.
    near = [(i, j) for i, row in enumerate(np.round(asked @ vectors.T, 3)) for j in np.flatnonzero(row >= 0.9) if j < i * 20]
    got = {r["pos"]: r["first"] for r in neighbours.least_near(index, spark.createDataFrame([(i * 20, [float(v) for v in q]) for i, q in enumerate(asked)], "pos long, vector array<double>"), 0.9, probes=6).collect()}
    least = {i * 20: min(j for k, j in near if k == i) for i, _ in near}
    assert sum(got.get(p) == j for p, j in least.items()) / len(least) >= 0.9


def test_only_possible_cells_are_visited(spark, vectors):
    index = neighbours.Index(frame(spark, vectors))
    one = frame(spark, vectors[:200], "query_id").select(F.size(neighbours.visits(F.col("vector"), index, least=F.lit(0.97))).alias("n"))
    assert one.agg(F.avg("n")).first()[0] < 0.5 * len(index.centres)


def test_greedy_order_in_rounds(spark, vectors):
    """Against the rows added one after another; a chain of rows, each near to the last, takes more rounds."""
    steps = np.linspace(0, 0.4, 9)
    chain = np.zeros((9, 24))
    chain[:, 0], chain[:, 1] = np.cos(steps), np.sin(steps)
    x = np.concatenate([vectors[:200], chain])
    kept, want = [], {}
    for i in range(len(x)):
        near = [j for j in kept if round(float(x[i] @ x[j]), 3) >= 0.99]
        want[i] = near[0] if near else None
        if not near:
            kept.append(i)
    rounds = []
    got = neighbours.first_kept(frame(spark, x, "pos"), 0.99, told=lambda *x: rounds.append(x))
    assert {r["pos"]: r["first"] for r in got.collect()} == want
    assert len(rounds) > 1 and sum(n for _, n, _ in rounds) == len(kept) and sum(n + m for _, n, m in rounds) == len(x)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, vector array<double>")
    index = neighbours.Index(empty)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    assert neighbours.nearest(index, asked, 3, None).collect() == [] == neighbours.nearest(index, asked, 3).collect()
    some = neighbours.Index(spark.createDataFrame([(5, [0.0, 1.0]), (4, None), (6, [0.0, 1.0])], "id long, vector array<double>"))
    assert [tuple(r) for r in neighbours.nearest(some, asked, 3, None).collect()] == [(1, 1, 5, 0.0), (1, 2, 6, 0.0)]
    assert neighbours.nearest(some, asked.limit(0), 3).collect() == []
    assert neighbours.first_kept(empty.withColumnRenamed("id", "pos"), 0.9).collect() == []
