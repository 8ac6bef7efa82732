"""Cleansing of points and diagnostics of order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import finite
from .index import RUN_BITS
from .ranks import in_order, ranked, saved, tasks_for


def scaled(points: DataFrame, coords: list[str], low: float, high: float) -> DataFrame:
    """Each coordinate rescaled so that its least finite value is ``low`` and its greatest ``high``; constant ones become ``low``.

    Nulls stay null, NaN and infinite values stay what they are. An empty table stays empty.
    """
    ends = points.agg(*[f(finite(c)).alias(f"__{n}{i}") for i, c in enumerate(coords) for n, f in (("lo", F.min), ("hi", F.max))])
    df = points.join(F.broadcast(ends))  # one row
    for i, c in enumerate(coords):
        share = (F.col(c).cast("double") - F.col(f"__lo{i}")) / F.nullif(F.col(f"__hi{i}") - F.col(f"__lo{i}"), F.lit(0.0))
        odd = F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
        df = df.withColumn(c, F.when(finite(c).isNotNull(), F.lit(low) + F.coalesce(share, F.lit(0.0)) * (high - low)).otherwise(odd))
    return df.drop(*ends.columns)


def without_repeats(points: DataFrame, coords: list[str]) -> DataFrame:
    """One row for each combination of coordinates. Nulls are equal to each other, and so are NaNs; which row stays is not defined."""
    return points.dropDuplicates(coords)


def inversions(df: DataFrame, order: str, value: str, strict: bool = False) -> DataFrame:
    """One row (n): neighbours in the sequence by ``order`` (unique) whose values fall, or do not rise if ``strict``.

    Ranks are cut into runs; a run's window also sees the last row of the run before it, so no window sees all rows.
    """
    run = 1 << 16
    at = ranked(df.select(order, value), [order])
    spread = at.withColumn("run", F.explode(F.when(F.pmod(F.col("rank") + 1, F.lit(run)) == 0, F.array(F.floor(F.col("rank") / run), F.floor(F.col("rank") / run) + 1)).otherwise(F.array(F.floor(F.col("rank") / run)))))
    before = F.lag(value).over(Window.partitionBy("run").orderBy("rank"))
    pairs = spread.withColumn("before", before).filter(F.floor(F.col("rank") / run) == F.col("run"))
    bad = F.col("before") >= F.col(value) if strict else F.col("before") > F.col(value)
    return pairs.agg(F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).cast("long").alias("n"))


#: Points of a label block that one task compares by itself, a power of two.
LABEL_BLOCK = 4096


def dominated_later(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether an earlier point has both a larger x and a larger y, by merging halves: sorts and running maxima of all halves of a size at once."""
    n = len(x)
    size = 1 << max(1, (n - 1).bit_length())
    # what fills up to a power of two is below all in x and above all in y
    x, y = np.append(x, np.full(size - n, -np.inf)), np.append(y, np.full(size - n, np.inf))
    bad = np.zeros(size, bool)
    half = 1
    while half < size:
        shape = (size // (2 * half), 2 * half)
        # later points stand first, so that they come before earlier ones of equal x in the sort
        swapped = np.roll(np.arange(size).reshape(shape), -half, axis=1)
        order = np.take_along_axis(swapped, np.argsort(-x[swapped], axis=1, kind="stable"), axis=1)
        earlier = order % (2 * half) < half
        highest = np.maximum.accumulate(np.where(earlier, y[order], -np.inf), axis=1)
        bad[order] |= ~earlier & (highest > y[order])
        half *= 2
    return bad[:n]


def staircase(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the points that no other one equals or exceeds in both coordinates; of equal ones, the first."""
    order = np.lexsort((-y, -x))
    before = np.maximum.accumulate(np.append(-np.inf, y[order][:-1]))
    return order[y[order] > before]


def merge_rows(blocks: DataFrame) -> DataFrame:
    """(level, group, side, nth, x, y): what each level of a merge tree over label blocks compares, from (block, nth, x, y, step).

    On each level, neighbouring groups of blocks meet, the earlier with its steps only (side 0), the later with all its points (side 1). So a point
    is in one row a level at most, and there are as many levels as the number of blocks has bits.
    """
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.col("blocks"))).cast("int") - 1, F.lit(0)))
    wide = blocks.join(F.broadcast(blocks.agg((F.coalesce(F.max("block"), F.lit(0)) + 1).alias("blocks"))))  # one row
    each = wide.filter("blocks > 1").withColumn("level", F.explode(levels))
    placed = each.withColumn("group", F.expr("shiftright(block, level + 1)")).withColumn("side", F.expr("shiftright(block, level) & 1"))
    return placed.filter("side = 1 OR step").select("level", "group", "side", "nth", "x", "y")


def dominance_violations(df: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """One row (n): points for which some earlier label has both a larger x and a larger y. Labels are unique; rows with a null or NaN coordinate do not count.

    Blocks of labels are compared in tasks, and then the blocks by a merge tree, for the points that their own block does not settle. On a
    level, points that follow each other by falling x see the highest y of the earlier side so far; they are cut into runs of bounded
    length, and each run starts with the highest one of the runs before it. So about n log n rows move at most, and no task sees more than a
    block or a run at once, whatever the order of the points. Shuffles have as many partitions as their rows need, since those that Spark
    chooses by bytes grow to millions of rows.
    """
    number = lambda c: F.col(c).cast("double")
    slim = df.select(F.col(label).alias("label"), number(x).alias("x"), number(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    at = ranked(slim, ["label"], "nth").withColumn("block", F.floor(F.col("nth") / LABEL_BLOCK)).select("block", "nth", "x", "y")
    spark = df.sparkSession

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("nth")
        a, b = own["x"].to_numpy(), own["y"].to_numpy()
        step = np.zeros(len(own), bool)
        step[staircase(a, b)] = True
        return own.assign(step=step, bad=dominated_later(a, b))

    by_block = at.repartition(tasks_for(spark, at.count()), "block")
    blocks = saved(by_block.groupBy("block").applyInPandas(within, "block long, nth long, x double, y double, step boolean, bad boolean"), "blocks")
    # a point that is settled is below a step of its block, so it settles no other one that the step does not
    open_ = blocks.filter("NOT bad")
    told = open_.agg(F.count("*").alias("n"), F.coalesce(F.max("block"), F.lit(0)).alias("last")).first()
    tasks = tasks_for(spark, told["n"] * told["last"].bit_length())
    group = ["level", "group"]
    kept = in_order(merge_rows(open_), [*group, F.col("x").desc(), F.col("side").desc(), "nth"], tasks).withColumn("run", F.shiftright("__at", RUN_BITS))
    held = F.when(F.col("side") == 0, F.col("y"))
    before = Window.partitionBy(*group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy(*group, "run").agg(F.max(held).alias("high")).withColumn("high", F.max("high").over(before))
    so_far = Window.partitionBy(*group, "run").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_run = kept.repartition(tasks, *group, "run").withColumn("own", F.max(held).over(so_far))
    worse = by_run.filter("side = 1").join(starts, [*group, "run"]).filter(F.greatest("own", "high") > F.col("y")).select("nth")
    counts = [one.agg(F.count("*").alias("n")) for one in (blocks.filter("bad"), worse.repartition(tasks, "nth").distinct())]
    return counts[0].unionByName(counts[1]).agg(F.sum("n").alias("n"))


def rising(column: str):
    """Whether an array column rises strictly."""
    a = F.col(column)
    return F.forall(F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda p, q: p < q), lambda ok: ok)
