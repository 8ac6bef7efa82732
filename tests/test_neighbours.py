"""Neighbours by page bounds: the rows of brute force, with ties, few points, far centres and null coordinates, in two passes over points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import index, search
from latticework.sources import store, versions


def brute(rows, centre, k):
    near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(r[1:], centre)))), r[0]) for r in rows if all(v is not None and np.isfinite(v) for v in r[1:]))
    return [i for _, i in near[:k]]


@pytest.mark.parametrize("dims, n, size", [(1, 300, 10), (2, 2500, 16), (2, 7, 16), (2, 0, 16), (3, 1200, 12)])
def test_neighbours_equal_brute_force(spark, tmp_path, dims, n, size):
    rng = np.random.default_rng(dims * n)
    xs = rng.uniform(0, 100, (n, dims))
    xs[::4] = np.round(xs[::4] / 10) * 10  # ties
    rows = [(i, *map(float, x)) for i, x in enumerate(xs)]
    if n > 100:
        rows += [(9000 + i, *[50.0] * dims) for i in range(60)] + [(9500, None, *[1.0] * (dims - 1)), (9501, float("nan"), *[1.0] * (dims - 1)), (9502, float("inf"), *[2.0] * (dims - 1))]
    coords = tuple(f"x{i}" for i in range(dims))
    p = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in coords))
    ix = store.build_index(p, coords, "id", f"{tmp_path}/ix", parts=4, page_size=size, segments=5)
    own = [(q, *map(float, x)) for q, x in enumerate(np.vstack([rng.uniform(-40, 140, (25, dims)), np.full((1, dims), 50.0), np.full((1, dims), 1e6)]))]
    centres = spark.createDataFrame([*own, (90, None, *[0.0] * (dims - 1)), (91, float("nan"), *[0.0] * (dims - 1))], "qid int, " + ", ".join(f"c{i} double" for i in range(dims)))
    for k in (1, 30) if n == 2500 else (5,):
        found, reads = search.knn_with_reads(ix, centres, k, "id")
        got = {}
        for r in found.orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
            assert r["rank"] == len(got[r["qid"]])
        assert got == {q: b for q, *c in own if (b := brute(rows, c, k))}
        if n:
            held = {(r["qid"], r["page"]) for r in reads.collect()}
            page = {r["id"]: r["page"] for r in ix.points.collect()}
            assert all((q, page[i]) in held for q, ids in got.items() for i in ids)


def test_points_are_read_twice_at_most(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    p = spark.createDataFrame([(i, *map(float, rng.uniform(0, 100, 2))) for i in range(4000)], "id long, x double, y double")
    ix = store.build_index(p, ("x", "y"), "id", f"{tmp_path}/ix", parts=4, page_size=20, segments=5)
    ix = versions.delete(spark, f"{tmp_path}/ix", p.filter("id % 3 = 0").select("x", "y"))
    passes, real = [], index.in_reach
    monkeypatch.setattr(index, "in_reach", lambda *a: passes.append(1) or real(*a))
    centres = spark.range(40).select(F.col("id").cast("int").alias("qid"), (F.col("id") * 37 % 100).cast("double").alias("c0"), (F.col("id") * 71 % 100).cast("double").alias("c1"))
    found, reads = search.knn_with_reads(ix, centres, 5, "id")
    assert found.count() == 200 and len(passes) == 2
    assert reads.groupBy("qid").count().agg(F.max("count")).first()[0] < 30 < ix.pages.count()


def test_copies_do_not_widen_what_is_read(spark, tmp_path, monkeypatch):
    """Many copies of each point fill the page of a centre, so that it holds one or two different points; pages farther away are bounded by nearer ones."""
    rng = np.random.default_rng(6)
    xs = rng.uniform(0, 100, (500, 2))
    rows = [(c * len(xs) + i, *map(float, x)) for c in range(20) for i, x in enumerate(xs)]
    p = spark.createDataFrame(rows, "id long, x double, y double").repartition(4)
    ix = store.build_index(p, ("x", "y"), "id", f"{tmp_path}/ix", parts=4, page_size=20, segments=5)
    own = [(q, *map(float, x)) for q, x in enumerate(rng.uniform(10, 90, (10, 2)))]
    centres = spark.createDataFrame(own, "qid int, c0 double, c1 double")
    monkeypatch.setattr(search, "FIRST_PAGES", 4)
    found, reads = search.knn_with_reads(ix, centres, 5, "id")
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {q: brute(rows, c, 5) for q, *c in own}
    count = reads.count()
    monkeypatch.setattr(search, "FIRST_PAGES", 1 << 30)
    at_once = search.knn_with_reads(ix, centres, 5, "id")[1].count()
    assert count * 2 < at_once, (count, at_once)
