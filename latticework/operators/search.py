"""Range, radius and nearest-neighbour queries: equi-joins on grid cells, or on an index's pages, with exact residual filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, in_box
from ..plans.spec import Grid
from . import index as indexes
from .grid import cell_intervals, with_cell, with_mapping
from .index import Index
from .layout import with_segment
from .ranks import saved


def range_rows(points: DataFrame | Index, boxes: DataFrame, grid: Grid, keep: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """(qid, keep..., extra...) for each point in each closed box; ``extra`` are columns of ``boxes``.

    Points may be an index, whose pages are then looked up, or a table, which may carry its ``cell`` already. The join on
    cell is an equi-join: Spark broadcasts the boxes' cells if they are small and shuffles both sides by cell otherwise; AQE
    splits crowded cells. Boxes with nulls find nothing, nor are points with a null coordinate in any box.
    """
    if isinstance(points, Index):
        return indexes.range_rows(points, boxes, keep, extra)
    coords = grid.spec.coords
    celled = points if "cell" in points.columns else with_cell(points, grid)
    hits = cell_intervals(boxes, grid, extra).select("qid", "cell", "lo", "hi", *extra)
    n = len(coords)
    inside = in_box(coords, [F.element_at("lo", i + 1) for i in range(n)], [F.element_at("hi", i + 1) for i in range(n)])
    slim = celled.select(*dict.fromkeys([*keep, *coords, "cell"]))
    return slim.join(hits, "cell").filter(inside).select("qid", *keep, *extra)


def range_count(points: DataFrame | Index, boxes: DataFrame, grid: Grid) -> DataFrame:
    """(qid, n) with 0 for boxes without points."""
    hits = range_rows(points, boxes, grid, [grid.spec.coords[0]]).groupBy("qid").agg(F.count("*").alias("n"))
    return boxes.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


def boxes_around(centres: DataFrame, grid: Grid, radius: Column, domain: tuple | None = None) -> DataFrame:
    """(qid, lo, hi, centre, r) from (qid, c0 .. c{d-1}): the spheres' boxes, clipped to the domain, by default the grid's.

    A box that the domain does not meet stays as it is and finds nothing.
    """
    spec = grid.spec
    low, high = domain or (spec.low, spec.high)
    c = [F.col(f"c{i}").cast("double") for i in range(spec.dims)]
    lo = F.array(*[F.greatest(x - radius, F.lit(low[i])) for i, x in enumerate(c)])
    hi = F.array(*[F.least(x + radius, F.lit(high[i])) for i, x in enumerate(c)])
    return centres.select("qid", lo.alias("lo"), hi.alias("hi"), F.array(*c).alias("centre"), radius.cast("double").alias("r"))


def radius_rows(points: DataFrame | Index, centres: DataFrame, grid: Grid, radius: Column, keep: list[str]) -> DataFrame:
    """(qid, keep..., dist) of the points at most ``radius`` away, by closed L2 distance; none for centres with a null coordinate."""
    spec = grid.spec
    around = boxes_around(centres, grid, radius, points.domain if isinstance(points, Index) else None)
    found = range_rows(points, around, grid, list(dict.fromkeys([*keep, *spec.coords])), ("centre", "r"))
    near = found.withColumn("dist", distance(spec.coords, [F.element_at("centre", i + 1) for i in range(spec.dims)]))
    return near.filter(F.col("dist") <= F.col("r")).select("qid", *keep, "dist")


def radius_count(points: DataFrame | Index, centres: DataFrame, grid: Grid, radius: Column) -> DataFrame:
    """(qid, n) with 0 for spheres without points."""
    hits = radius_rows(points, centres, grid, radius, [grid.spec.coords[0]]).groupBy("qid").agg(F.count("*").alias("n"))
    return centres.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


def _nearest(near: DataFrame, k: int, id_col: str) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", id_col)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _widened(points: DataFrame | Index, centres: DataFrame, grid: Grid, k: int, id_col: str, first: Column, empty: int = 2) -> DataFrame:
    """(qid, r, near): the final radius of each centre, and its k nearest points as an array of (rank, id, dist).

    Spheres start with ``first`` and those with fewer than k points double, or grow ``empty`` times if they hold none; finished centres leave the loop. A sphere stops at
    the farthest corner of the domain, so tables of fewer than k points end too. A round keeps k points a centre at most.
    """
    spec, coords = grid.spec, [f"c{i}" for i in range(grid.spec.dims)]
    slim = points
    if not isinstance(points, Index):
        slim = points if "cell" in points.columns else saved(with_cell(points.select(id_col, *spec.coords), grid), "celled")
    low, high = points.domain if isinstance(points, Index) else (spec.low, spec.high)
    far = F.sqrt(sum(((F.greatest(F.abs(F.col(c) - low[i]), F.abs(F.col(c) - high[i]))) ** 2 for i, c in enumerate(coords)), F.lit(0.0)))
    open_ = centres.select("qid", *coords, F.greatest(first.cast("double"), F.lit(1e-9)).alias("__r"), (far * 1.000001 + 1e-9).alias("__far"))
    open_, done = saved(open_.filter(F.col("__far").isNotNull()), "centres"), None
    while True:
        near = _nearest(radius_rows(slim, open_, grid, F.col("__r"), [id_col]), k, id_col)
        lists = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", id_col, "dist"))).alias("near"))
        state = saved(open_.join(lists, "qid", "left").withColumn("__n", F.greatest(F.size("near"), F.lit(0))), "spheres")
        ends = (F.col("__n") >= k) | (F.col("__r") >= F.col("__far"))
        part = state.filter(ends).select("qid", F.col("__r").alias("r"), "near")
        done = part if done is None else done.unionByName(part)
        open_ = state.filter(~ends).withColumn("__r", F.least(F.col("__r") * F.when(F.col("__n") == 0, empty).otherwise(2), F.col("__far"))).drop("near", "__n")
        if open_.isEmpty():
            return done


def nearest_in_spheres(points: DataFrame | Index, centres: DataFrame, grid: Grid, k: int, id_col: str, first: Column) -> DataFrame:
    """(qid, id, dist, r): all points in the final sphere of each centre, which holds k points or reaches across the domain.

    Centres with a null coordinate have no sphere.
    """
    ends = _widened(points, centres, grid, k, id_col, first).select("qid", "r")
    wide = centres.join(ends, "qid")
    return radius_rows(points, wide, grid, F.col("r"), [id_col]).join(ends, "qid").select("qid", id_col, "dist", "r")


def knn(points: DataFrame | Index, centres: DataFrame, grid: Grid, k: int, id_col: str, first: Column) -> DataFrame:
    """(qid, rank, id, dist): the k nearest points, fewer if there are fewer; equal distances go to the smaller id.

    Centres with a null coordinate have no neighbour, and points with one are nobody's.
    """
    found = _widened(points, centres, grid, k, id_col, first, 4)
    return found.select("qid", F.explode("near").alias("__p")).select("qid", "__p.rank", f"__p.{id_col}", "__p.dist")


#: Pages that are read for a centre before those farther away are looked at again, and how many times more each next round reads.
FIRST_PAGES, MORE_PAGES = 32, 8


def _by_rounds(ix: Index, hits: DataFrame, k: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(qid, rank, id, dist), and (qid, page): the pages that were read, of ``hits`` (as from ``pages_of``, with r, apart and nth by rising apart).

    The nearest pages come first; the k-th distance in them bounds what is read of the others. A round reads ``MORE_PAGES`` times as many
    pages as the one before, so there are few rounds, and a centre reads a bounded multiple of the pages that its nearest points need.
    """
    coords, n = list(ix.grid.spec.coords), range(ix.grid.spec.dims)
    near, reads, most = None, None, FIRST_PAGES
    while True:
        part, later = hits.filter(F.col("nth") <= most), hits.filter(F.col("nth") > most)
        rows = indexes.rows_in(ix, part, list(dict.fromkeys([id_col, *coords])), ("centre", "r")).withColumn("dist", distance(coords, [F.element_at("centre", i + 1) for i in n]))
        rows = rows.filter(F.col("dist") <= F.col("r")).select("qid", id_col, "dist")
        near = _nearest(rows if near is None else rows.unionByName(near.select("qid", id_col, "dist")), k, id_col).select("qid", "rank", id_col, "dist")
        own = part.select("qid", "page")
        reads = own if reads is None else reads.unionByName(own)
        if later.isEmpty():
            return near, reads
        near = saved(near, "near")
        bound = near.filter(F.col("rank") == k).select("qid", (F.col("dist") * (1 + 1e-9)).alias("__r"))
        closer = later.join(bound, "qid", "left").withColumn("r", F.least("r", "__r")).drop("__r")
        hits, most = saved(closer.filter(F.col("apart") <= F.col("r")), "hits"), most * MORE_PAGES


def knn_pages(ix: Index, centres: DataFrame, k: int, id_col: str) -> DataFrame:
    """(qid, rank, id, dist) as from ``knn``, through an index in a few passes over points; see ``knn_with_reads``."""
    return knn_with_reads(ix, centres, k, id_col)[0]


def knn_with_reads(ix: Index, centres: DataFrame, k: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(qid, rank, id, dist), and (qid, page): the pages that were read for each centre.

    The first pass reads the page that a centre's own mapping leads to. The distance of its k-th point there bounds the k-th distance of all,
    so what follows reads pages whose boxes come that near, by the directory: in a second pass if they are few, else the nearest
    first, see ``_by_rounds``. Many equal points make the first bound wide, as a page then holds few different ones. Centres whose own page
    holds fewer than k points take spheres that widen, see ``knn``. Equal distances go to the smaller id. Centres with a null or non-finite coordinate have no neighbour.
    """
    grid, dims = ix.grid, range(ix.grid.spec.dims)
    coords, c = list(grid.spec.coords), [f"c{i}" for i in dims]
    asked = centres.select("qid", *[F.col(x).cast("double").alias(x) for x in c])
    asked = asked.filter(" AND ".join(f"{x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < double('infinity')" for x in c))
    at = with_mapping(asked.select("qid", *[F.col(a).alias(b) for a, b in zip(c, coords)]), grid).select("qid", "m", *[F.col(b).alias(a) for a, b in zip(c, coords)])
    marks = ix.pages.select("segment", F.col("low_m").alias("m"), F.struct("page", "block", "low_m", "high_m").alias("at"))
    home = indexes.last_before(marks, with_segment(at, ix.starts), "segment", ["m"], "at", "__at")
    home = saved(home.select("qid", *c, "__at.page", "__at.block", F.col("__at.low_m").alias("from_m"), F.col("__at.high_m").alias("to_m")), "home")
    apart = distance(coords, [F.col(x) for x in c])
    near = indexes.in_reach(ix, home.filter("page IS NOT NULL")).select(id_col, "page", *coords).join(home.select("qid", "page", *c), "page").withColumn("dist", apart).filter(F.col("dist") < float("inf"))
    bound = _nearest(near.select("qid", id_col, "dist"), k, id_col).filter(F.col("rank") == k).select("qid", (F.col("dist") * (1 + 1e-9)).alias("__r"))
    open_ = saved(home.select("qid", *c).join(bound, "qid", "left"), "bounds")
    spheres = boxes_around(open_.filter("__r IS NOT NULL"), grid, F.col("__r"), ix.domain)
    corners = ix.pages.select("page", "low", "high")
    hits = indexes.pages_of(ix, spheres, ("centre", "r")).join(corners, "page")
    hits = hits.withColumn("apart", indexes.least_distance("low", "high", [F.element_at("centre", i + 1) for i in dims])).drop("low", "high").filter(F.col("apart") <= F.col("r"))
    hits = saved(hits.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("apart", "page", "cell"))), "hits")
    found, further = _by_rounds(ix, hits, k, id_col)
    reads = home.filter("page IS NOT NULL").select("qid", "page").unionByName(further)
    rest = open_.filter("__r IS NULL").drop("__r")
    if not rest.isEmpty():
        n = ix.pages.agg(F.sum("n")).first()[0] or 0
        # the last sphere of a centre has read all the pages that its box meets
        wide = saved(_widened(ix, rest, grid, k, id_col, F.lit(density_radius(grid, n, k)), 4), "spheres")
        found = found.unionByName(wide.select("qid", F.explode("near").alias("__p")).select("qid", "__p.rank", f"__p.{id_col}", "__p.dist"))
        last = boxes_around(rest.join(wide.select("qid", F.col("r").alias("__r")), "qid"), grid, F.col("__r"), ix.domain)
        reads = reads.unionByName(indexes.pages_of(ix, last).select("qid", "page"))
    return found, reads.distinct()


def density_radius(grid: Grid, rows: int, k: int) -> float:
    """The radius whose box holds 2k points if points were spread evenly: a first guess."""
    spec = grid.spec
    volume = 1.0
    for l, h in zip(spec.low, spec.high):
        volume *= max(h - l, 1e-9)
    return 0.5 * (volume * 2 * k / max(rows, 1)) ** (1 / spec.dims)


def knn_radii(neighbours: DataFrame, k: int) -> DataFrame:
    """(qid, radii): distances to the first k neighbours in rising order, null if there are fewer than k."""
    got = neighbours.filter(F.col("rank") <= k).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dist"))), lambda x: x["dist"]).alias("radii"))
    return got.select("qid", F.when(F.size("radii") == k, F.col("radii")).alias("radii"))


def fixed_radii(points: DataFrame | Index, centres: DataFrame, grid: Grid, k: int, id_col: str, radius: Column) -> DataFrame:
    """(qid, radii): distances to the first k neighbours of every centre within a fixed radius, null if fewer than k lie in it."""
    found = knn_radii(_nearest(radius_rows(points, centres, grid, radius, [id_col]), k, id_col), k)
    return centres.select("qid").join(found, "qid", "left").select("qid", "radii")
