"""Lattice regression: estimates of neighbour distances from a regular lattice of nodes."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import Grid, IndexSpec
from ..sources import generate
from . import search
from .ranks import saved

#: Points that a lattice is trained on and tested with, for each of its nodes, and neighbours whose distances it learns.
TRAIN, TEST, NEIGHBOURS = 40, 10, 10
#: Weight of smoothness against the training points.
ALPHA = 1.0
#: Systems of more nodes than this are solved by conjugate gradients.
DENSE_NODES = 3000


def nodes(spark, spec: IndexSpec) -> DataFrame:
    """(node_id, coords): (intervals + 1)^dims regular nodes, the last dimension fastest; made by arithmetic, not by joins."""
    per = spec.lattice_intervals + 1
    at = [F.pmod(F.floor(F.col("id") / per ** (spec.dims - 1 - i)), F.lit(per)) for i in range(spec.dims)]
    coords = [F.lit(float(spec.low[i])) + a * ((spec.high[i] - spec.low[i]) / spec.lattice_intervals) for i, a in enumerate(at)]
    return spark.range(per**spec.dims).select(F.col("id").alias("node_id"), F.array(*coords).alias("coords"))


def corner_weights(points: DataFrame, spec: IndexSpec, id_col: str) -> DataFrame:
    """(id, node_id, w): the 2^dims corners of each point's lattice cell, with normalised inverse distances.

    Points outside of the lattice belong to its outermost cells.
    """
    d, per = spec.dims, spec.lattice_intervals + 1
    step = [(spec.high[i] - spec.low[i]) / spec.lattice_intervals or 1.0 for i in range(d)]
    x = [F.col(c).cast("double") for c in spec.coords]
    base = points.select(id_col, *[v.alias(f"x{i}") for i, v in enumerate(x)])
    for i in range(d):
        base = base.withColumn(f"g{i}", F.greatest(F.lit(0), F.least(F.lit(spec.lattice_intervals - 1), F.floor((F.col(f"x{i}") - spec.low[i]) / step[i]))))
    corner = base.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(2**d - 1))))
    at = [F.col(f"g{i}") + F.shiftright("corner", d - 1 - i).bitwiseAND(F.lit(1)) for i in range(d)]
    dist = F.sqrt(reduce(lambda a, b: a + b, [(F.lit(float(spec.low[i])) + at[i] * step[i] - F.col(f"x{i}")) ** 2 for i in range(d)]))
    node = reduce(lambda a, b: a * per + b, at)
    raw = corner.select(id_col, node.cast("long").alias("node_id"), (1 / (dist + 1e-8)).alias("inv"))
    return raw.select(id_col, "node_id", (F.col("inv") / F.sum("inv").over(Window.partitionBy(id_col))).alias("w"))


def edges(spark, spec: IndexSpec) -> DataFrame:
    """(a, b) with a < b: neighbouring nodes of the lattice."""
    per, d = spec.lattice_intervals + 1, spec.dims
    steps = F.explode(F.array(*[F.lit(per ** (d - 1 - i)) for i in range(d)])).alias("step")
    found = spark.range(per**d).select(F.col("id").alias("a"), steps)
    return found.filter(F.pmod(F.floor(F.col("a") / F.col("step")), F.lit(per)) < per - 1).select("a", (F.col("a") + F.col("step")).alias("b"))


def laplacian(spark, spec: IndexSpec) -> DataFrame:
    """(row, col, val): degrees less adjacency, times 2 / the sum of the degrees."""
    e = edges(spark, spec)
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    total = both.count()
    degree = both.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a").alias("row"), F.col("a").alias("col"), (F.col("n") * 2.0 / total).alias("val"))
    return degree.unionByName(both.select(F.col("a").alias("row"), F.col("b").alias("col"), F.lit(-2.0 / total).alias("val")))


def solve(spark, spec: IndexSpec, weights: DataFrame, targets: DataFrame, id_col: str, alpha: float = ALPHA) -> DataFrame:
    """(node_id, radii) from (W W' / m + alpha L) B = W Y' / m.

    ``weights`` as from ``corner_weights``, ``targets`` (id, radii). Sums over points run in Spark; what reaches the driver is
    sized by the lattice: a node couples with at most 3^dims others.
    """
    m = max(1, targets.count())
    other = weights.select(id_col, F.col("node_id").alias("other"), F.col("w").alias("v"))
    square = weights.join(other, id_col).groupBy("node_id", "other").agg((F.sum(F.col("w") * F.col("v")) / m).alias("val"))
    left = square.select(F.col("node_id").alias("row"), F.col("other").alias("col"), "val").unionByName(laplacian(spark, spec).select("row", "col", (F.col("val") * alpha).alias("val")))
    entries = left.groupBy("row", "col").agg(F.sum("val").alias("val")).toPandas()
    right = weights.join(targets, id_col).select("node_id", "w", F.posexplode("radii").alias("k", "radius")).groupBy("node_id", "k").agg((F.sum(F.col("w") * F.col("radius")) / m).alias("val")).toPandas()
    n, k = (spec.lattice_intervals + 1) ** spec.dims, int(right["k"].max()) + 1 if len(right) else 1
    rhs = np.zeros((n, k))
    rhs[right["node_id"].to_numpy(int), right["k"].to_numpy(int)] = right["val"].to_numpy()
    row, col, val = entries["row"].to_numpy(int), entries["col"].to_numpy(int), entries["val"].to_numpy()
    if n <= DENSE_NODES:
        dense = np.zeros((n, n))
        dense[row, col] = val
        found = np.linalg.lstsq(dense, rhs, rcond=None)[0]
    else:
        found = conjugate_gradients(row, col, val, rhs)
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(found)], "node_id long, radii array<double>")


def conjugate_gradients(row: np.ndarray, col: np.ndarray, val: np.ndarray, rhs: np.ndarray, rounds: int = 2000, near: float = 1e-10) -> np.ndarray:
    def times(x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(row, val * x[col, j], len(x)) for j in range(x.shape[1])], 1)

    x = np.zeros_like(rhs)
    r = rhs - times(x)
    p, rr = r.copy(), (r * r).sum(axis=0)
    for _ in range(rounds):
        if (rr <= near * np.maximum((rhs * rhs).sum(axis=0), 1e-300)).all():
            break
        ap = times(p)
        a = rr / np.maximum((p * ap).sum(axis=0), 1e-300)
        x, r = x + a * p, r - a * ap
        new = (r * r).sum(axis=0)
        p, rr = r + (new / np.maximum(rr, 1e-300)) * p, new
    return x


def estimated_radii(points: DataFrame, spec: IndexSpec, model: DataFrame, id_col: str) -> DataFrame:
    """(id, radii): weighted sums of the corners' radii. The lattice's size is set by the spec; Spark sees it and may broadcast it."""
    joined = corner_weights(points, spec, id_col).join(model, "node_id").select(id_col, "w", F.posexplode("radii").alias("k", "radius"))
    sums = joined.groupBy(id_col, "k").agg(F.sum(F.col("w") * F.col("radius")).alias("r"))
    return sums.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("radii"))


def first_radius(radii: Column, k: int, spec: IndexSpec) -> Column:
    """The estimate for rank k, clipped to a small part of the domain below and to all of it above."""
    widest = max(h - l for l, h in zip(spec.low, spec.high)) or 1.0
    return F.greatest(F.lit(widest * 1e-4), F.least(F.lit(widest), F.element_at(radii, k)))


def sampled(spark, spec: IndexSpec, per_node: int, seed: int) -> DataFrame:
    """(qid, c0 ..): ``per_node`` points a lattice node, uniform in the domain."""
    points = generate.uniform_points(spark, per_node * (spec.lattice_intervals + 1) ** spec.dims, spec.dims, 0.0, 1.0, seed=seed, digits=15)
    return points.select(F.col("id").alias("qid"), *[(F.col(f"x{i}") * (spec.high[i] - spec.low[i]) + spec.low[i]).alias(f"c{i}") for i in range(spec.dims)])


def labelled(points, centres: DataFrame, grid: Grid, k: int, id_col: str, rows: int) -> DataFrame:
    """(qid, radii): exact distances of centres to their first k points, fewer if there are fewer points."""
    k = max(1, min(k, rows))
    if isinstance(points, search.Index):
        near = search.knn_pages(points, centres, k, id_col)
    else:
        near = search.knn(points, centres, grid, k, id_col, F.lit(search.density_radius(grid, rows, k)))
    return search.knn_radii(near, k).filter("radii IS NOT NULL")


def as_points(centres: DataFrame, spec: IndexSpec) -> DataFrame:
    return centres.select("qid", *[F.col(f"c{i}").alias(c) for i, c in enumerate(spec.coords)])


def train(points, grid: Grid, id_col: str, k: int = NEIGHBOURS, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(node_id, radii): the lattice's coefficients, from ``tables`` (training_points, training_radii) or from a sample of the domain.

    ``points`` is a table or an index.
    """
    spec = grid.spec
    if tables is None:
        spark, rows = (points.points if isinstance(points, search.Index) else points).sparkSession, _rows(points)
        sample = saved(sampled(spark, spec, TRAIN, 5), "lattice-points")
        tables = {"training_points": sample, "training_radii": saved(labelled(points, sample, grid, k, id_col, rows), "lattice-radii")}
    spark = tables["training_radii"].sparkSession
    weights = corner_weights(as_points(tables["training_points"], spec), spec, "qid")
    return solve(spark, spec, saved(weights, "lattice-weights"), tables["training_radii"], "qid")


def _rows(points) -> int:
    return (points.pages.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) if isinstance(points, search.Index) else points.count()


def prepared(points, grid: Grid, id_col: str, k: int = NEIGHBOURS) -> dict[str, DataFrame]:
    """The tables that a lattice is trained and tested on: nodes, training and testing points, and the exact radii of each."""
    spec = grid.spec
    spark, rows = (points.points if isinstance(points, search.Index) else points).sparkSession, _rows(points)
    at = saved(nodes(spark, spec), "lattice-nodes")
    out = {"nodes": at, "training_points": saved(sampled(spark, spec, TRAIN, 5), "lattice-points"), "testing_points": saved(sampled(spark, spec, TEST, 50), "lattice-points")}
    centres = {
        "node_radii": at.select(F.col("node_id").alias("qid"), *[F.element_at("coords", i + 1).alias(f"c{i}") for i in range(spec.dims)]),
        "training_radii": out["training_points"],
        "testing_radii": out["testing_points"],
    }
    return out | {name: saved(labelled(points, c, grid, k, id_col, rows), "lattice-radii") for name, c in centres.items()}
