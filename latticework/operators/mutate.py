"""Insert and delete with bag semantics, and the pages that they touch."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import IndexSpec
from .index import last_before
from .ranks import in_order, ranked_within, saved


def insert_bag(points: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; equal rows stay apart, nulls and NaNs are kept."""
    return points.unionByName(new)


def delete_bag(points: DataFrame, gone: DataFrame, coords: list[str]) -> DataFrame:
    """Coordinates of ``points`` less one copy for each row of ``gone``; rows that are not there are ignored. Nulls equal nulls, NaNs equal NaNs."""
    return points.select(*coords).exceptAll(gone.select(*coords))


def doomed(points: DataFrame, gone: DataFrame, coords: list[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``points`` that stay, rows that go): one of equal coordinates for each row of ``gone``, the smallest ids first.

    Only rows of coordinates that are to go are numbered, by ranks that a hot coordinate does not gather in one task. Nulls equal nulls.
    """
    wanted = gone.groupBy(*coords).agg(F.count("*").alias("__gone"))
    same = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"g.{c}")) for c in coords])
    met = saved(points.alias("p").join(wanted.alias("g"), same, "left").select(*[F.col(f"p.`{c}`") for c in points.columns], "__gone"), "met")
    # null coordinates form groups too
    key = F.struct(*coords)
    numbered = saved(ranked_within(met.filter(F.col("__gone").isNotNull()).withColumn("__key", key), "__key", [id_col], "__nth").drop("__key"), "numbered")
    stay = met.filter(F.col("__gone").isNull()).select(*points.columns).unionByName(numbered.filter(F.col("__nth") >= F.col("__gone")).select(*points.columns))
    return stay, numbered.filter(F.col("__nth") < F.col("__gone")).select(*points.columns)


def delete_rows(points: DataFrame, gone: DataFrame, coords: list[str], id_col: str) -> DataFrame:
    """Whole rows less one for each row of ``gone`` of equal coordinates, the smallest ids first; see ``doomed``."""
    return doomed(points, gone, coords, id_col)[0]


def repage(points: DataFrame, shards: DataFrame, spec: IndexSpec, id_col: str) -> DataFrame:
    """New pages (shard, page_in_shard) for the points of the touched ``shards`` only; other shards keep theirs.

    Deleted points leave neither holes nor tombstones, and small neighbours merge, since a touched shard is cut anew. A shard may be of any size.
    """
    touched = points.join(shards.select("shard").distinct(), "shard", "left_semi")
    return ranked_within(touched, "shard", ["m", id_col], "__nth").withColumn("page_in_shard", F.floor(F.col("__nth") / spec.page_size)).select(*touched.columns, "page_in_shard")


def split_page(page: DataFrame, id_col: str) -> DataFrame:
    """Adds half (0 or 1) to the points of overfull pages: by m, the first half gets the odd point. A page may be of any size."""
    cut = ranked_within(page, "page", ["m", id_col], "__nth", "__n")
    return cut.withColumn("half", F.when(F.col("__nth") < F.ceil(F.col("__n") / 2), 0).otherwise(1)).select(*page.columns, "half")


def misplaced(points: DataFrame, pages: DataFrame) -> DataFrame:
    """Points whose m is outside of their page's range: empty after a right insert."""
    return points.join(pages, "page").filter((F.col("m") < F.col("low_m")) | (F.col("m") > F.col("high_m"))).select(*points.columns)


def placed(pages: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (segment, m, ...) with page: the last page of its segment whose first mapping does not exceed m, or the segment's first.

    ``pages``: (segment, page, low_m). A point of a segment without pages gets page 0. A segment may be of any size; see ``last_before``.
    """
    found = last_before(pages.select("segment", F.col("low_m").alias("m"), "page"), new, "segment", ["m"], "page", "__page")
    return found.select(*new.columns, F.coalesce("__page", F.lit(0)).alias("page"))


def in_pieces(rows: DataFrame, keys: list[str], size: int, id_col: str) -> DataFrame:
    """Adds piece: a page (``keys``) of n points above ``size`` is cut by (m, id) into ceil(n / size) even pieces, others are piece 0."""
    cut = ranked_within(rows, keys, ["m", id_col], "__nth", "__n")
    return cut.withColumn("piece", F.expr(f"CAST((__nth * ceil(__n / {size})) div __n AS INT)")).select(*rows.columns, "piece")


def inserted(paged: DataFrame, new: DataFrame, spec: IndexSpec, id_col: str) -> DataFrame:
    """Points of ``paged`` (segment, page, m, ...) and ``new`` (segment, m, ...), with piece.

    New points go to the page that their mapping belongs to. A page of n points above the page size splits by (m, id) into
    ceil(n / page_size) even pieces, in one step for any number of new points, all of one page too. Equal rows stay apart.
    """
    low = paged.groupBy("segment", "page").agg(F.min("m").alias("low_m"))
    return in_pieces(paged.unionByName(placed(low, new)), ["segment", "page"], spec.page_size, id_col)


def merged(paged: DataFrame, spec: IndexSpec) -> DataFrame:
    """``paged`` (segment, page, ...) after deletions, with merged: the page that it is part of now.

    The pages left in a segment are paired in order; a pair whose points fit one page becomes the left one. Emptied pages are gone.
    A segment may have any number of pages. See ``chained`` for merges of more than two.
    """
    counts = paged.groupBy("segment", "page").agg(F.count("*").alias("n"))
    both = Window.partitionBy("segment", "pair")
    joined = ranked_within(counts, "segment", ["page"], "__nth").withColumn("pair", F.floor(F.col("__nth") / 2)).withColumn("merged", F.when(F.sum("n").over(both) <= spec.page_size, F.min("page").over(both)).otherwise(F.col("page")))
    return paged.join(joined.select("segment", "page", "merged"), ["segment", "page"])


#: Pages of a run that one task walks through.
WALK = 1 << 12


def walked(n: np.ndarray, heads: np.ndarray, start: int, size: int) -> np.ndarray:
    """Whether each page opens a new one, where ``heads`` mark the first pages of groups, and the open page before the first page here holds ``start`` points (0: none)."""
    opens, held = np.zeros(len(n), bool), start
    for i, (own, head) in enumerate(zip(n.tolist(), heads.tolist())):
        opens[i] = head or held == 0 or held + own > size
        held = own if opens[i] else held + own
    return opens


def chained(counts: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """``counts`` (group, order, n > 0, ...) with chain: pages of equal chain in a group become one page.

    From left to right, a page joins the open one as long as both fit ``size``, and opens a new one otherwise; so chains of any length
    merge, and of no two neighbours that are left do all points fit one page. The sequence of all groups is cut into runs, so that small groups
    share a task's call and a large one is spread. What a run does to the group that it starts in is a function from the points of
    the open page before it (0 to ``size``) to those after it, a list of ``size`` + 1 numbers. The functions of a group that goes over several runs
    are applied one after the other, a list a run; and tasks walk through the runs once more, each with its start.
    """
    kept = in_order(counts.filter(F.col(group).isNotNull()), [group, order]).withColumn("__run", F.expr(f"__at div {WALK}"))
    slim = kept.select(group, "__run", "__at", "n")
    kind = slim.schema[0].dataType.simpleString()

    def in_run(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        rows = pdf.sort_values("__at")
        return rows, rows[group].ne(rows[group].shift()).to_numpy()

    def ends(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a run's first group the function, and of its last one, if it begins in the run, the points that it leaves open."""
        rows, heads = in_run(pdf)
        n, begun = rows["n"].tolist(), np.flatnonzero(heads)
        held = np.arange(size + 1)
        for own in n[: begun[1] if len(begun) > 1 else None]:
            held = np.where((held > 0) & (held + own <= size), held + own, own)
        told = [(rows[group].iloc[0], key[0], True, held.tolist())]
        if len(begun) > 1:
            left = 0
            for own in n[begun[-1] :]:
                left = left + own if left and left + own <= size else own
            told.append((rows[group].iloc[-1], key[0], False, [left]))
        return pd.DataFrame(told, columns=[group, "__run", "__first", "__ends"])

    def starts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("__run")
        held, found = 0, []
        for after in rows["__ends"]:
            found.append(held)
            held = int(after[min(held, len(after) - 1)])
        return pd.DataFrame({"__run": rows["__run"], "__start": found})[rows["__first"].to_numpy()]

    told = slim.groupBy("__run").applyInPandas(ends, f"`{group}` {kind}, __run long, __first boolean, __ends array<long>")
    begun = saved(told.groupBy(group).applyInPandas(starts, "__run long, __start long"), "starts")

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, heads = in_run(pdf)
        start, at = int(rows["__start"].iloc[0]), rows["__at"].to_numpy()
        heads[0] = start == 0
        own = np.maximum.accumulate(np.where(walked(rows["n"].to_numpy(), heads, start, size), at, -1))
        return pd.DataFrame({group: rows[group], "__run": key[0], "__at": at, "__own": own})

    # a chain is named by the place of the page that opened it, which may stand in an earlier run
    opened = saved(slim.join(begun, "__run").groupBy("__run").applyInPandas(walk, f"`{group}` {kind}, __run long, __at long, __own long"), "opened")
    earlier = Window.partitionBy(group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    before = opened.groupBy(group, "__run").agg(F.max("__own").alias("__own")).select(group, "__run", F.max("__own").over(earlier).alias("__before")).filter("__before IS NOT NULL")
    chains = opened.join(before, [group, "__run"], "left").select("__at", F.when(F.col("__own") >= 0, F.col("__own")).otherwise(F.col("__before")).alias("chain"))
    return kept.join(chains, "__at").select(*counts.columns, "chain")
