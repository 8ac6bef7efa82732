"""Queries through an index: intervals of the mapping, the segments' models, a page directory, and only then points."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import finite, in_box
from ..plans.spec import Grid
from . import grid as grids
from . import layout
from .ranks import in_order, saved

#: Folders that the points of an index are dealt into, by segment; a query reads those that it may find something in.
BLOCKS = 128
#: Pages whose predicted ranks fall into one bucket of the directory.
BUCKET_PAGES = 16
#: Rows that follow each other in a sequence and are looked at in one group: two to this power at most.
RUN_BITS = 16
#: What a mapping may be off by rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """``points`` with cell, m, segment, shard, page and block; ``models`` by segment; ``pages``: the directory, with the
    predicted ranks of each page's first and last mapping; ``starts``: first mappings of segments 1 .. in order; ``token``: what it was
    built from; ``version``: how often it was changed since."""

    points: DataFrame
    models: DataFrame
    pages: DataFrame
    grid: Grid
    starts: list[float]
    token: str = ""
    version: int = 0

    @cached_property
    def domain(self) -> tuple[tuple[float, ...], tuple[float, ...]]:
        """Bounds of all points: the grid's, and those of the pages once points may have been inserted beyond it."""
        spec = self.grid.spec
        if not self.version:
            return spec.low, spec.high
        n = range(spec.dims)
        ends = self.pages.agg(*[F.min(F.element_at("low", i + 1)) for i in n], *[F.max(F.element_at("high", i + 1)) for i in n]).first()
        wider = lambda f, own, found: tuple(f(a, b) if b is not None else a for a, b in zip(own, found))
        return wider(min, spec.low, ends[: spec.dims]), wider(max, spec.high, ends[spec.dims :])

    @cached_property
    def columns(self) -> list[str]:
        return self.points.columns


def block_of(segments: int) -> Column:
    return F.floor(F.col("segment") * min(BLOCKS, segments) / segments).cast("int")


def with_rank(df: DataFrame, models: DataFrame, m: str, out: str) -> DataFrame:
    """Adds the predicted rank of ``m`` over all segments from its ``segment``: rows of earlier segments and the model's position."""
    own = models.select("segment", *[F.col(c).alias(f"__{c}") for c in ("min_m", "n", "alphas", "betas", "first")])
    return df.join(own, "segment").withColumn(out, F.col("__first") + layout.predicted_position(F.col(m), "__")).select(*df.columns, out)


def with_first(models: DataFrame) -> DataFrame:
    """Adds ``first``, the number of rows in earlier segments; a window over one row a segment."""
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return models.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def directory(indexed: DataFrame, models: DataFrame, coords: tuple[str, ...]) -> DataFrame:
    """(page, shard, segment, block, n, low_m, high_m, low, high, low_rank, high_rank): one row a page. ``models`` as from ``with_first``.

    ``low`` and ``high`` are the corners of the box of the page's points whose coordinates are all finite; null where it has none.
    """
    placed = reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in coords])
    ends = [F.array(*[f(F.when(placed, F.col(c).cast("double"))) for c in coords]).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    pages = indexed.groupBy("segment", "shard", "page", "block").agg(F.count("*").alias("n"), F.min("m").alias("low_m"), F.max("m").alias("high_m"), *ends)
    return with_rank(with_rank(pages, models, "low_m", "low_rank"), models, "high_m", "high_rank")


def least_distance(low: str, high: str, centre: list[Column]) -> Column:
    """The distance of a centre to the box between two corners; null for a box of null corners."""
    sides = [F.greatest(F.element_at(low, i + 1) - c, c - F.element_at(high, i + 1), F.lit(0.0)) for i, c in enumerate(centre)]
    apart = F.sqrt(reduce(lambda a, b: a + b, [x * x for x in sides]))
    return F.when(F.element_at(low, 1).isNotNull(), apart)


def ranked_ends(intervals: DataFrame, index: Index) -> DataFrame:
    """``intervals`` with low_rank and high_rank, the predicted ranks of both ends; the ends may lie in different segments."""
    df = intervals
    for m, out in (("low_m", "low_rank"), ("high_m", "high_rank")):
        df = with_rank(layout.with_segment(df, index.starts, m), index.models, m, out).drop("segment")
    return df


def last_before(marks: DataFrame, rows: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the ``value`` of the last mark that does not come after the row in the sequence of its group, or of the
    group's first mark; null in a group without marks.

    ``marks`` and ``rows`` have ``group`` and the columns of ``order``; a mark stands before a row of equal order, marks of equal order stand by
    ``value``. Both form one sequence, which is cut into runs of bounded length, and each run of a group starts with the last mark of the
    runs before it. So a group may have any number of rows and marks; the windows over runs have one row for each.
    """
    own = marks.select(group, *order, F.col(value).alias("__value"))
    both = rows.unionByName(own, allowMissingColumns=True).withColumn("__tie", F.monotonically_increasing_id())
    kept = in_order(both, [group, *order, F.col("__value").isNull(), "__value", "__tie"]).withColumn("__run", F.shiftright("__at", RUN_BITS))
    marked = F.when(F.col("__value").isNotNull(), F.col("__at"))
    runs = kept.groupBy(group, "__run").agg(F.max_by("__value", marked).alias("__high"), F.min_by("__value", marked).alias("__low"))
    within = Window.partitionBy(group).orderBy("__run")
    first = F.first("__low", True).over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = runs.select(group, "__run", F.coalesce(F.last("__high", True).over(within.rowsBetween(Window.unboundedPreceding, -1)), first).alias("__start"))
    so_far = Window.partitionBy(group, "__run").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = kept.withColumn("__own", F.last("__value", True).over(so_far)).filter(F.col("__value").isNull()).join(before, [group, "__run"])
    return at.select(*rows.columns, F.coalesce("__own", "__start").alias(out))


def predicted_shards(index: Index, at: DataFrame, m: str) -> DataFrame:
    """``at`` with shard: that of the last page whose predicted first rank does not exceed that of ``m``, found in the directory.

    Any number of look-ups may fall into one segment.
    """
    placed = with_rank(layout.with_segment(at, index.starts, m), index.models, m, "__rank").withColumn("__m", F.col(m))
    pages = index.pages.select("segment", F.col("low_rank").alias("__rank"), F.col("low_m").alias("__m"), F.struct("page", "shard").alias("__page"))
    found = last_before(pages, placed, "segment", ["__rank", "__m"], "__page", "__found")
    return found.select(*at.columns, F.col("__found.shard").alias("shard"))


def met_pages(index: Index, wanted: DataFrame) -> DataFrame:
    """``wanted`` (low_m, high_m, ...) with page, block, from_m and to_m for each page whose range of m its own meets.

    The models turn an interval of m into an interval of predicted ranks. As predictions rise with m, a page that meets the one
    meets the other; pages and intervals join on buckets of ranks, in the first bucket that they share, and the pages' true
    ranges of m decide.
    """
    width = BUCKET_PAGES * index.grid.spec.page_size
    # rounding may move a rank across a bucket's edge
    first, last = (lambda c: F.floor((F.col(c) - 1) / width)), (lambda c: F.floor((F.col(c) + 1) / width))
    spread = ranked_ends(wanted, index).withColumn("__a", first("low_rank")).withColumn("bucket", F.explode(F.sequence("__a", last("high_rank"))))
    pages = index.pages.select("page", "block", F.col("low_m").alias("from_m"), F.col("high_m").alias("to_m"), first("low_rank").alias("__b"), last("high_rank").alias("__z"))
    met = spread.join(pages.withColumn("bucket", F.explode(F.sequence("__b", "__z"))), "bucket")
    met = met.filter((F.col("from_m") <= F.col("high_m") + SLACK) & (F.col("to_m") >= F.col("low_m") - SLACK) & (F.col("bucket") == F.greatest("__a", "__b")))
    return met.select(*wanted.columns, "page", "block", "from_m", "to_m")


def pages_of(index: Index, boxes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(qid, cell, page, block, from_m, to_m, lo, hi, extra...): the pages that may hold points of each box in each cell, once each."""
    met = met_pages(index, grids.cell_intervals(boxes, index.grid, extra, index.domain))
    return met.select("qid", "cell", "page", "block", F.greatest("from_m", "low_m").alias("from_m"), F.least("to_m", "high_m").alias("to_m"), "lo", "hi", *extra)


def in_reach(index: Index, hits: DataFrame) -> DataFrame:
    """The points of the blocks, and of the ranges of m in each, that ``hits`` touch: filters that reach the scan.

    At most ``BLOCKS`` rows reach the driver, whatever the numbers of points and queries.
    """
    ranges = hits.groupBy("block").agg(F.min("from_m").alias("a"), F.max("to_m").alias("z")).collect()
    if not ranges:
        return index.points.filter(F.lit(False))
    # blocks follow m, so a range of m says as much as a block and a range; the mapping's rounding is given room
    near = reduce(lambda x, y: x | y, [F.col("m").between(r["a"] - SLACK, r["z"] + SLACK) for r in ranges])
    return index.points.filter(F.col("block").isin([r["block"] for r in ranges]) & near)


def rows_in(index: Index, hits: DataFrame, keep: list[str], extra: tuple[str, ...]) -> DataFrame:
    """(qid, keep..., extra...) for the points in the boxes of ``hits`` (as from ``pages_of``, stored) on their pages."""
    coords = index.grid.spec.coords
    slim = in_reach(index, hits).select(*dict.fromkeys([*keep, *coords, "page", "cell"]))
    n = range(len(coords))
    inside = in_box(coords, [F.element_at("lo", i + 1) for i in n], [F.element_at("hi", i + 1) for i in n])
    # a point has one cell, so it meets a box once
    return slim.join(hits.select("qid", "page", "cell", "lo", "hi", *extra), ["page", "cell"]).filter(inside).select("qid", *keep, *extra)


def range_rows(index: Index, boxes: DataFrame, keep: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """(qid, keep..., extra...) for each point in each closed box, by way of the pages.

    The pages to read are written first: Spark then knows their size, and broadcasts them to the points only if they are few.
    """
    return rows_in(index, saved(pages_of(index, boxes, extra), "hits"), keep, extra)


def range_query(index: Index, boxes: DataFrame) -> DataFrame:
    """(qid, n_pages, n): pages read for each box and points found, 0 for boxes without any."""
    hits = saved(pages_of(index, boxes), "hits")
    pages = hits.groupBy("qid").agg(F.countDistinct("page").alias("n_pages"))
    found = rows_in(index, hits, [index.grid.spec.coords[0]], ()).groupBy("qid").agg(F.count("*").alias("n"))
    return boxes.select("qid").join(pages, "qid", "left").join(found, "qid", "left").select("qid", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n", F.lit(0)).alias("n"))


def within_shard(splits: Column, m: Column, right: bool = True) -> Column:
    """Place of the page in a shard that ``m`` belongs to: split mappings at or below it (``right``), or below it; -1 without pages (null splits)."""
    at = F.size(F.filter(splits, (lambda s: s <= m) if right else (lambda s: s < m)))
    return F.when(splits.isNull(), F.lit(-1)).otherwise(at)
