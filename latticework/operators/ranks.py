"""Exact ranks, and values at exact ranks, without a task that sees all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is not set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not hasattr(context, "_latticework_points"):
        context._latticework_points = tempfile.mkdtemp(prefix="latticework-")
    return context._latticework_points


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes and rereads ``df``, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a shuffle that one task takes, at about, where partitions follow the rows.
TASK_ROWS = 1 << 19


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that ``rows`` rows are dealt to, so that a task's memory does not grow with them; as many as there are cores at least."""
    return max(1, spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def in_order(df: DataFrame, order: list, parts: int = 0) -> DataFrame:
    """``df`` with ``__at``, which rises along the sequence by ``order``: the range partition in the upper bits, the place in it in the lower 33.

    There are as many range partitions as Spark's shuffles have, or ``parts`` if these are more.
    """
    n = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranks")


def ranked(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Adds the position from 0 in the sequence by ``order``: range-partitioned, sorted in place, shifted by the partitions' counts.

    Ties keep one deterministic order only if ``order`` ends in a unique column.
    """
    kept = in_order(df, order)
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return kept.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__start")


def ranked_within(df: DataFrame, group: str | list[str], order: list, out: str, count: str | None = None) -> DataFrame:
    """Adds the position from 0 among the rows of equal ``group``, by ``order``, and with ``count`` their number.

    It is the rank over everything less the group's first, so a group of any size is spread, and there may be any number of groups:
    each has one row, which joins back. Rows of a null group are not returned.
    """
    keys = [group] if isinstance(group, str) else group
    everywhere = ranked(df, [*keys, *order], "__rank")
    firsts = everywhere.groupBy(*keys).agg(F.min("__rank").alias("__first"), *([F.count("*").alias(count)] if count else []))
    return everywhere.join(firsts, keys).withColumn(out, F.col("__rank") - F.col("__first")).drop("__rank", "__first")


#: Buckets that the values between wanted ranks are counted in, over all ranks; each open interval has ``LEAST`` at least.
BUCKETS, LEAST = 1 << 14, 16
#: Rows that a task looks up at once.
LOOKED_UP = 1 << 18


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order; -0.0 is 0.0."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def from_bits(bits: int) -> float:
    return float(np.int64(bits ^ 0x7FFFFFFFFFFFFFFF if bits < 0 else bits).view(np.float64))


class Histogram:
    """Buckets of the open intervals of all groups: a group's buckets are ``starts[first[g] : first[g + 1]]`` with their ``ends``, in rising
    order; ``intervals`` lists (group, interval, first bucket, end)."""

    def __init__(self, open_: dict[int, list[tuple[int, int, int, list[int]]]]):
        each = max(LEAST, BUCKETS // max(1, sum(map(len, open_.values()))))
        self.groups, self.intervals = sorted(open_), []
        starts, ends, first = [], [], [0]
        for g in self.groups:
            for interval in open_[g]:
                low, high = interval[:2]
                width = -(-(high - low + 1) // each)
                at = range(low, high + 1, width)
                self.intervals.append((g, interval, len(starts), len(starts) + len(at)))
                starts += at
                ends += [min(high, a + width - 1) for a in at]
            first.append(len(starts))
        self.starts, self.ends, self.first = (np.array(v, np.int64) for v in (starts, ends, first))

    def places(self, group: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values that lie in a bucket, their buckets)."""
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group, self.groups, "left", sorter=order), np.searchsorted(group, self.groups, "right", sorter=order)
        values, buckets = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, (a, z) in enumerate(zip(*edges)):
            if a < z:
                own, (low, high) = bits[order[a:z]], self.first[k : k + 2]
                at = np.searchsorted(self.starts[low:high], own, "right") - 1
                inside = (at >= 0) & (own <= self.ends[low + np.maximum(at, 0)])
                values.append(own[inside])
                buckets.append(low + at[inside])
        return np.concatenate(values), np.concatenate(buckets)


def counted(made: Histogram, df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, least and greatest value of each bucket, from (group, x); tasks send those that they have rows in."""
    shared = df.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, held, rows = shared.value, [], 0
        n, low, high = np.zeros(len(h.starts), np.int64), np.full(len(h.starts), np.iinfo(np.int64).max), np.full(len(h.starts), np.iinfo(np.int64).min)

        def look_up() -> None:
            values, at = h.places(np.concatenate([g for g, _ in held]), ordered_bits(np.concatenate([x for _, x in held])))
            np.add.at(n, at, 1)
            np.minimum.at(low, at, values)
            np.maximum.at(high, at, values)

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            rows += batch.num_rows
            if rows >= LOOKED_UP:
                look_up()
                held, rows = [], 0
        if held:
            look_up()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (some, n[some], low[some], high[some])], ["bucket", "n", "low", "high"])

    told = df.mapInArrow(run, "bucket long, n long, low long, high long").groupBy("bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    out = tuple(np.zeros(len(made.starts), np.int64) for _ in range(3))
    for o, c in zip(out, ("n", "low", "high")):
        o[told["bucket"].to_numpy()] = told[c].to_numpy()
    shared.unpersist()
    return out


def selected(df: DataFrame, group: str, x: str, wanted: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """The value of ``x`` at each wanted rank (from 0) of each group of long numbers: {(group, rank): value}. ``x`` is neither null nor NaN.

    The values between the least and the greatest of a group are counted in buckets; each bucket with wanted ranks is counted in finer
    ones, from its own least to its own greatest value, until it holds one value. So a pass fixes 4 to 14 bits of the wanted values, and
    frequent values are fixed early. Tasks send counts, no rows; what reaches the driver is bounded by ``BUCKETS``, or by ``LEAST`` for each rank.
    """
    slim = df.select(F.col(group).cast("long").alias("group"), F.col(x).cast("double").alias("x"))
    bits = lambda v: int(ordered_bits(np.array([v], np.float64))[0])
    open_ = {r["group"]: [(bits(r["a"]), bits(r["z"]), 0, sorted(set(wanted[r["group"]])))] for r in slim.groupBy("group").agg(F.min("x").alias("a"), F.max("x").alias("z")).collect() if wanted.get(r["group"])}
    found: dict[tuple[int, int], float] = {}

    def unsettled(parts: dict[int, list]) -> dict[int, list]:
        for g, own in parts.items():
            found.update({(g, r): from_bits(low) for low, high, _, ranks in own if low == high for r in ranks})
        return {g: left for g, own in parts.items() if (left := [p for p in own if p[0] < p[1]])}

    open_ = unsettled(open_)
    while open_:
        made = Histogram(open_)
        n, low, high = counted(made, slim)
        finer: dict[int, list] = {}
        for g, (_, _, before, ranks), a, z in made.intervals:
            up_to = before + np.cumsum(n[a:z])
            at = np.searchsorted(up_to, ranks, "right")
            for b in np.unique(at).tolist():
                mine = [r for r, own in zip(ranks, at.tolist()) if own == b] if len(ranks) < 50 else np.array(ranks)[at == b].tolist()
                finer.setdefault(g, []).append((int(low[a + b]), int(high[a + b]), int(up_to[b] - n[a + b]), mine))
        open_ = unsettled(finer)
    return found
