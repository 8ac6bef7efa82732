"""Segments, position models, shards and pages of an index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import search_right
from ..plans.spec import Grid, IndexSpec
from .grid import TREE_BOUNDS, cell_intervals, with_mapping
from .model import train_runs
from .ranks import ranked, ranked_within, saved, selected

#: Cuts whose values are found by counting; more of them take a range shuffle. The values are the same.
COUNTED_CUTS = 1 << 14
MODEL = "segment long, min_m double, n long, alphas array<double>, betas array<double>, loss double"


def segment_count(n: int, spec: IndexSpec) -> int:
    """Segments that ``n`` rows are cut into: as many as the spec says, of a page at least."""
    return max(1, min(spec.segments, n // max(1, spec.page_size)))


def segment_bounds(mapped: DataFrame, spec: IndexSpec) -> list[float]:
    """Lower bounds of segments 1 .. of about equal count: the first m above the middle between the m's on both sides of a cut.

    The values at the cuts are found by counts, see ``ranks.selected``; so many cuts that their counts would burden the driver, by
    ranks over everything. Cuts inside a run of equal m fall together, so there may be fewer.
    """
    n = mapped.count()
    k = segment_count(n, spec)
    if n == 0 or k == 1:
        return []
    cuts = [i * n // k for i in range(1, k)]
    wanted = sorted({c - 1 for c in cuts} | set(cuts))
    if len(wanted) <= COUNTED_CUTS:
        at = {r: v for (_, r), v in selected(mapped.select(F.lit(0).cast("long").alias("all"), "m"), "all", "m", {0: wanted}).items()}
    else:
        places = mapped.sparkSession.createDataFrame([(c,) for c in wanted], "rank long")
        # a row's number parts ties, whose order does not matter
        every = ranked(mapped.select("m", F.monotonically_increasing_id().alias("tie")), ["m", "tie"])
        at = {r["rank"]: r["m"] for r in every.join(places, "rank").select("rank", "m").collect()}
    return sorted({at[c] for c in cuts if at[c] > at[c - 1]})


def with_segment(mapped: DataFrame, bounds: list[float], m: str = "m", out: str = "segment") -> DataFrame:
    """Adds the segment of ``m``, the number of bounds at or below it: comparisons in generated code, or a vectorised search of many bounds."""
    if len(bounds) <= TREE_BOUNDS:
        return mapped.withColumn(out, search_right(f"`{m}`", bounds).cast("long"))
    edges = np.array(bounds)

    @F.pandas_udf("long")
    def segment_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(np.float64), side="right"))

    return mapped.withColumn(out, segment_of(m))


def segment_sizes(segmented: DataFrame) -> DataFrame:
    """(segment, n, first): counts and running starts; a window over one row a segment."""
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return segmented.groupBy("segment").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def train_models(segmented: DataFrame, spec: IndexSpec) -> DataFrame:
    """A position model for each segment, from one row for each of its different mappings.

    Equal mappings are counted before they move, so a segment's group holds about twice the rows between two cuts at most
    (``IndexSpec.sized`` bounds these), even where a run of equal mappings, which no cut divides, holds most of the table.
    """
    knots = spec.knots

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        runs = pdf.sort_values("m")
        m, often = runs["m"].to_numpy(np.float64), runs["often"].to_numpy(np.int64)
        alphas, betas, loss = train_runs(m, often, knots)
        return pd.DataFrame({"segment": [key[0]], "min_m": [m[0]], "n": [int(often.sum())], "alphas": [alphas.tolist()], "betas": [betas.tolist()], "loss": [loss]})

    return segmented.groupBy("segment", "m").agg(F.count("*").alias("often")).groupBy("segment").applyInPandas(fit, MODEL)


def predicted_position(m: Column, prefix: str = "") -> Column:
    """Rank of m in its segment by the joined columns min_m, n, alphas and betas: one expression for layout and look-up."""
    shift = m - F.col(f"{prefix}min_m")
    terms = F.zip_with(f"{prefix}alphas", f"{prefix}betas", lambda a, b: a * F.greatest(F.lit(0.0), shift - b))
    return F.greatest(F.lit(0.0), F.least(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.col(f"{prefix}n").cast("double")))


def merged_tails(counts: DataFrame, size: int) -> DataFrame:
    """(segment, raw, own, c) from (segment, raw, c): from the end of a segment, shards merge until the last one holds more than ``size``.

    ``own`` is the merged shard's number. A segment with no more than ``size`` rows becomes one shard. No row is dropped.
    """
    back = Window.partitionBy("segment").orderBy(F.col("raw").desc())
    tail = counts.withColumn("tail", F.sum("c").over(back))
    # the last kept shard of a segment is the highest one whose tail count exceeds a page, or the first
    last = tail.groupBy("segment").agg(F.coalesce(F.max(F.when(F.col("tail") > size, F.col("raw"))), F.min("raw")).alias("last"))
    return tail.join(last, "segment").select("segment", "raw", F.least("raw", "last").alias("own"), "c")


def numbered_shards(named: DataFrame, size: int) -> DataFrame:
    """(segment, own, count, shard, first_page, first_row): shards, pages and rows numbered over all segments.

    They are numbered within a segment first; only the segments' totals, one row each, go through a window over everything.
    """
    shards = named.groupBy("segment", "own").agg(F.sum("c").alias("count")).withColumn("__pages", F.ceil(F.col("count") / size))
    inside = Window.partitionBy("segment").orderBy("own")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = shards.withColumn("__shard", F.row_number().over(inside) - 1).withColumns({f"__{out}": F.coalesce(F.sum(c).over(before), F.lit(0)) for out, c in (("page", "__pages"), ("row", "count"))})
    earlier = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("segment").agg(F.count("*").alias("__s"), F.sum("__pages").alias("__p"), F.sum("count").alias("__r"))
    starts = totals.select("segment", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("__s", "__p", "__r")])
    numbers = [(F.col(a) + F.col(b)).alias(out) for a, b, out in (("__s", "__shard", "shard"), ("__p", "__page", "first_page"), ("__r", "__row", "first_row"))]
    return local.join(starts, "segment").select("segment", "own", "count", *numbers)


def model_rises(alphas: str, betas: str) -> Column:
    """Whether a model's knots rise strictly and no slope, a sum of the first alphas, is negative but for rounding."""
    places = F.sequence(F.lit(2), F.greatest(F.size(betas), F.lit(2)))
    knots = F.forall(places, lambda i: (i > F.size(betas)) | (F.get(betas, i - 1) > F.get(betas, i - 2)))
    scale = F.aggregate(alphas, F.lit(0.0), lambda s, a: F.greatest(s, F.abs(a)))
    sums = F.aggregate(alphas, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("low")), lambda s, a: F.struct((s["sum"] + a).alias("sum"), F.least(s["low"], s["sum"] + a).alias("low")))
    return knots & (sums["low"] >= scale * -1e-9)


def with_shard(segmented: DataFrame, models: DataFrame, spec: IndexSpec, id_col: str) -> DataFrame:
    """Adds shard (dense over all segments) and page (dense), and drops nothing.

    A raw shard is the predicted rank by the page size; see ``merged_tails``. Pages cut a shard's sequence by (m, id) every
    ``page_size`` points. A run of equal m falls into one shard, however long it is, so places in a shard come from ranks over
    everything, in range partitions that ids divide, less the rows of earlier shards.
    """
    size = spec.page_size
    raw = segmented.join(models.select("segment", "min_m", "n", "alphas", "betas"), "segment").withColumn("raw", F.floor(predicted_position(F.col("m")) / size)).drop("min_m", "n", "alphas", "betas")
    # predictions are made once: counts, the sample of the ranges and the ranges themselves all need them
    raw = saved(raw, "raw")
    named = merged_tails(raw.groupBy("segment", "raw").agg(F.count("*").alias("c")), size)
    table = named.select("segment", "raw", "own").join(numbered_shards(named, size), ["segment", "own"])
    placed = ranked(raw.join(table, ["segment", "raw"]), ["shard", "m", id_col], "__rank")
    page = F.col("first_page") + F.floor((F.col("__rank") - F.col("first_row")) / size)
    return placed.withColumn("page", page).drop("raw", "own", "count", "first_page", "first_row", "__rank")


def build_index(points: DataFrame, grid: Grid, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(points with cell, m, segment, shard and page; models): the whole load as one plan."""
    mapped = with_mapping(points, grid)
    segmented = with_segment(mapped, segment_bounds(mapped, grid.spec))
    models = train_models(segmented, grid.spec)
    return with_shard(segmented, models, grid.spec, id_col), models


def segment_pages(segmented: DataFrame, spec: IndexSpec, id_col: str) -> DataFrame:
    """Adds page, numbered in each segment, by exact rank of (m, id) in the segment: what a model without error would give.

    A segment may be of any size.
    """
    return ranked_within(segmented, "segment", ["m", id_col], "__nth").withColumn("page", F.floor(F.col("__nth") / spec.page_size)).drop("__nth")


def rank_pages(mapped: DataFrame, spec: IndexSpec, id_col: str) -> DataFrame:
    """Adds page by exact rank of (m, id): the layout of an ideal model."""
    return ranked(mapped, ["m", id_col]).withColumn("page", F.floor(F.col("rank") / spec.page_size))


def page_table(paged: DataFrame) -> DataFrame:
    """(page, n, low_m, high_m): the directory."""
    return paged.groupBy("page").agg(F.count("*").alias("n"), F.min("m").alias("low_m"), F.max("m").alias("high_m"))


def split_mappings(pages: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard, page, low_m, next_low): first mapping of the following page of the shard, null at its end."""
    order = Window.partitionBy("shard").orderBy("page")
    return pages.join(shards, "page").withColumn("next_low", F.lead("low_m").over(order)).select("shard", "page", "low_m", "next_low")


def pages_per_query(pages: DataFrame, boxes: DataFrame, grid: Grid, domain: tuple | None = None) -> DataFrame:
    """(qid, n_pages): pages whose range of m meets an interval of the box. Pages and intervals join on the cells they span."""
    parts = grid.spec.parts
    spread = pages.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low_m") / parts), F.floor(F.col("high_m") / parts)))).select("page", "cell", F.col("low_m").alias("from_m"), F.col("high_m").alias("to_m"))
    hits = cell_intervals(boxes, grid, domain=domain).join(spread, "cell").filter((F.col("from_m") <= F.col("high_m")) & (F.col("to_m") >= F.col("low_m"))).select("qid", "page").distinct()
    counted = hits.groupBy("qid").agg(F.count("*").alias("n_pages"))
    return boxes.select("qid").join(counted, "qid", "left").select("qid", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


def shard_directory(indexed: DataFrame) -> DataFrame:
    """(shard, segment, n, pages, low_m, high_m): one row a shard."""
    return indexed.groupBy("shard", "segment").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"), F.min("m").alias("low_m"), F.max("m").alias("high_m"))


def shards_per_segment(directory: DataFrame) -> DataFrame:
    """(segment, shards) from (segment, shard)."""
    return directory.groupBy("segment").agg(F.count("*").alias("shards"))


def shards_for(intervals: DataFrame, directory: DataFrame, parts: int) -> DataFrame:
    """(qid, shard): shards whose range of m meets an interval (qid, cell, low_m, high_m); both sides join on cells."""
    spread = directory.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low_m") / parts), F.floor(F.col("high_m") / parts)))).select("shard", "cell", F.col("low_m").alias("from_m"), F.col("high_m").alias("to_m"))
    return intervals.join(spread, "cell").filter((F.col("from_m") <= F.col("high_m")) & (F.col("to_m") >= F.col("low_m"))).select("qid", "shard").distinct()


def index_stats(indexed: DataFrame, models: DataFrame, grid: Grid) -> DataFrame:
    """One row: points, pages, shards, segments, cells and numbers that the models and the grid hold."""
    held = indexed.agg(F.count("*").alias("points"), F.countDistinct("page").alias("pages"), F.countDistinct("shard").alias("shards"), F.countDistinct("segment").alias("segments"))
    params = models.agg(F.coalesce(F.sum(F.size("alphas") + F.size("betas") + 1), F.lit(0)).alias("model_numbers"))
    return held.join(F.broadcast(params)).withColumn("cells", F.lit(grid.spec.cells)).withColumn("grid_numbers", F.lit(int(sum(b.size for b in grid.bounds))))
