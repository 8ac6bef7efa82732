"""Equi-depth grid and the monotone mapping of points to one dimension."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import finite, literals, search_right
from ..plans.spec import Grid, IndexSpec
from .ranks import selected

#: More literal bounds than this make generated methods that the JVM does not compile; a vectorised search takes over.
TREE_BOUNDS = 64


def spec_for(points: DataFrame, coords: tuple[str, ...], **sizes) -> IndexSpec:
    """A spec whose domain is that of the data's finite coordinates; (0, 0) where there are none."""
    row = points.agg(*[f(finite(c)).alias(f"{n}{i}") for i, c in enumerate(coords) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return IndexSpec(tuple(coords), tuple(float(row[f"lo{i}"] or 0) for i in range(len(coords))), tuple(float(row[f"hi{i}"] or 0) for i in range(len(coords))), **sizes)


def cut_ranks(n: int, parts: int) -> list[int]:
    """Ranks of the first elements of parts 1 .. parts - 1 when n sorted elements are dealt out as evenly as can be."""
    q, r = divmod(n, parts)
    return [(i + 1) * (q + 1) if i < r else (i + 1) * q + r for i in range(parts - 1)]


def part_bounds(points: DataFrame, spec: IndexSpec, dim: int, parent: Column) -> np.ndarray:
    """Bounds (parents, parts) of one dimension below each parent cell: values at exact ranks; the last is the domain's maximum.

    Null, NaN and infinite coordinates have no rank. Parents without rows get the domain's maximum for all bounds. Only the bounds reach the driver.
    """
    x = spec.coords[dim]
    slim = points.select(parent.cast("long").alias("parent"), finite(x).alias("x")).filter(F.col("x").isNotNull())
    out = np.full((spec.parts**dim, spec.parts), spec.high[dim])
    counts = {r["parent"]: r["n"] for r in slim.groupBy("parent").agg(F.count("*").alias("n")).collect()}
    cuts = {p: [k for k in cut_ranks(n, spec.parts) if k < n] for p, n in counts.items()}
    found = selected(slim, "parent", "x", cuts)
    for p, ranks in cuts.items():
        out[p, : len(ranks)] = [found[p, k] for k in ranks]
    return np.maximum.accumulate(out, axis=1)


def build_grid(points: DataFrame, spec: IndexSpec) -> Grid:
    """Splits dimensions 0 .. dims - 2 one after the other; a few passes of counts over one column for each, see ``ranks.selected``."""
    grid = Grid(spec, ())
    for dim in range(spec.dims - 1):
        placed = with_cell(points, grid) if dim else points.withColumn("cell", F.lit(0))
        grid = Grid(spec, (*grid.bounds, part_bounds(placed, spec, dim, F.col("cell"))))
    return grid


def _placer(grid: Grid, dim: int):
    @F.pandas_udf("long")
    def place(parent: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(grid.place(dim, parent.to_numpy(np.int64), x.to_numpy(np.float64)))

    return place


def part_of(grid: Grid, dim: int, parent: Column, x: str) -> Column:
    """The part of the double column ``x`` in ``dim`` below ``parent``."""
    bounds = grid.bounds[dim]
    if len(bounds) == 1 and bounds.shape[1] - 1 <= TREE_BOUNDS:
        return search_right(f"`{x}`", bounds[0][:-1]).cast("long")
    if bounds.size <= 4 * TREE_BOUNDS:
        # small grids are placed without Python, where each dimension would have a worker of its own in a task
        at = parent.cast("int") + 1
        return reduce(lambda n, edge: n + F.when(F.col(x) < F.element_at(literals(edge), at), 0).otherwise(1), bounds.T[:-1], F.lit(0)).cast("long")
    return _placer(grid, dim)(parent.cast("long"), F.col(x))


def with_cell(points: DataFrame, grid: Grid, out: str = "cell", coords: tuple[str, ...] | None = None) -> DataFrame:
    """Adds the row-major cell number over the dimensions that ``grid`` splits. Rows with a null, NaN or infinite coordinate get an outermost cell."""
    df = points.withColumn(out, F.lit(0).cast("long"))
    for dim, name in zip(range(len(grid.bounds)), coords or grid.spec.coords):
        df = df.withColumn("__x", F.col(name).cast("double"))
        df = df.withColumn("__part", part_of(grid, dim, F.col(out), "__x")).withColumn(out, F.col(out) * grid.spec.parts + F.col("__part")).drop("__part", "__x")
    return df


def fraction(grid: Grid, dim: int, cell: Column, x: Column) -> Column:
    """Where x lies in its cell along ``dim``, from 0 to 1; 0 in a cell without extent. ``cell``: over all split dimensions."""
    lower, upper = grid.edges(dim)
    flat = lambda a: literals(a.reshape(-1))
    prefix = F.floor(cell / grid.spec.parts ** (len(grid.bounds) - 1 - dim)).cast("int")
    if lower.size <= 4 * TREE_BOUNDS:
        lo, hi = F.element_at(flat(lower), prefix + 1), F.element_at(flat(upper), prefix + 1)
        share = F.coalesce((x - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    lo_all, hi_all = lower.reshape(-1), upper.reshape(-1)

    @F.pandas_udf("double")
    def share_of(at: pd.Series, v: pd.Series) -> pd.Series:
        i = at.to_numpy(np.int64)
        width = hi_all[i] - lo_all[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.where(width > 0, (v.to_numpy(np.float64) - lo_all[i]) / width, 0.0)
        return pd.Series(np.clip(found, 0.0, 1.0))

    return share_of(prefix, x)


def level(spec: IndexSpec, x: Column) -> Column:
    """The last dimension's share of the mapping, from 0 to parts - 1."""
    width = spec.high[-1] - spec.low[-1]
    share = (x - spec.low[-1]) / width if width else F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (spec.parts - 1)


def with_mapping(points: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``cell`` and ``m``: eta * the product of the cell fractions + the last dimension's level + cell * parts.

    The part within a cell is below ``parts``, so cells do not overlap in m, and m rises with each coordinate in a cell.
    """
    spec = grid.spec
    df = with_cell(points, grid)
    shares = [fraction(grid, i, F.col("cell"), F.col(spec.coords[i]).cast("double")) for i in range(spec.dims - 1)]
    measure = reduce(lambda a, b: a * b, shares, F.lit(1.0)) if shares else F.lit(0.0)
    return df.withColumn("m", measure * spec.eta + level(spec, F.col(spec.coords[-1]).cast("double")) + F.col("cell") * spec.parts)


def cell_borders(spark, grid: Grid) -> DataFrame:
    """cell, lo and hi (arrays over the split dimensions) and volume of each cell."""
    spec, rows = grid.spec, []
    for cell in range(spec.cells):
        lo, hi = [], []
        for dim in range(spec.dims - 1):
            lower, upper = grid.edges(dim)
            at = cell // spec.parts ** (spec.dims - 2 - dim)
            lo.append(float(lower.reshape(-1)[at]))
            hi.append(float(upper.reshape(-1)[at]))
        rows.append((cell, lo, hi, float(np.prod(np.subtract(hi, lo)))))
    return spark.createDataFrame(rows, "cell long, lo array<double>, hi array<double>, volume double")


def cell_intervals(boxes: DataFrame, grid: Grid, extra: tuple[str, ...] = (), domain: tuple | None = None) -> DataFrame:
    """(qid, cell, low_m, high_m, lo, hi, extra...) for each cell that a box (qid, lo, hi) meets: its points' m lie in [low_m, high_m].

    The lower fraction counts in the first part along a dimension only (0 in later ones), the upper one in the last (1 in
    earlier ones). Boxes with hi < lo or outside of the domain, by default the grid's, give no cell; points beyond the grid belong to its outermost cells.
    """
    spec = grid.spec
    lo, hi = (lambda i: F.element_at("lo", i + 1)), (lambda i: F.element_at("hi", i + 1))
    low, high = domain or (spec.low, spec.high)
    fits = reduce(lambda a, b: a & b, [(lo(i) <= hi(i)) & (hi(i) >= low[i]) & (lo(i) <= high[i]) for i in range(spec.dims)])
    df = boxes.select("qid", "lo", "hi", *extra).filter(fits).withColumn("cell", F.lit(0).cast("long"))
    df = df.withColumns({f"__{n}{i}": f(i).cast("double") for n, f in (("lo", lo), ("hi", hi)) for i in range(spec.dims - 1)})
    for i in range(spec.dims - 1):
        df = df.withColumns({"__a": part_of(grid, i, F.col("cell"), f"__lo{i}"), "__b": part_of(grid, i, F.col("cell"), f"__hi{i}")})
        df = df.withColumn("__p", F.explode(F.sequence("__a", "__b")))
        df = df.withColumns({"cell": F.col("cell") * spec.parts + F.col("__p"), f"__first{i}": F.col("__p") == F.col("__a"), f"__last{i}": F.col("__p") == F.col("__b")}).drop("__a", "__b", "__p")
    low = reduce(lambda a, b: a * b, [F.when(F.col(f"__first{i}"), fraction(grid, i, F.col("cell"), lo(i))).otherwise(0.0) for i in range(spec.dims - 1)], F.lit(1.0)) if spec.dims > 1 else F.lit(0.0)
    high = reduce(lambda a, b: a * b, [F.when(F.col(f"__last{i}"), fraction(grid, i, F.col("cell"), hi(i))).otherwise(1.0) for i in range(spec.dims - 1)], F.lit(1.0)) if spec.dims > 1 else F.lit(0.0)
    base, last = F.col("cell") * spec.parts, spec.dims - 1
    return df.select("qid", "cell", (low * spec.eta + level(spec, lo(last)) + base).alias("low_m"), (high * spec.eta + level(spec, hi(last)) + base).alias("high_m"), "lo", "hi", *extra)


def merged_intervals(intervals: DataFrame, gap: float = 1e-5) -> DataFrame:
    """(qid, low_m, high_m) with neighbours closer than ``gap`` made one; by gaps and islands in each query."""
    from pyspark.sql import Window

    order = Window.partitionBy("qid").orderBy("low_m", "high_m")
    reach = F.max("high_m").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("__new", F.when(reach.isNull() | (F.col("low_m") - reach >= gap), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(order))
    return marked.groupBy("qid", "__island").agg(F.min("low_m").alias("low_m"), F.max("high_m").alias("high_m")).drop("__island")
