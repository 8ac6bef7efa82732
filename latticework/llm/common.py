"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent (tests on one machine) a temporary folder is used; on a
    cluster an absent setting is an error, since no folder is known to be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = getattr(context, "_latticework_dir", None) or tempfile.mkdtemp(prefix="latticework-")
        context._latticework_dir = found
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``written``, with the path, for tables that ``discard`` removes once nothing reads them."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str | None) -> None:
    """Removes an intermediate table."""
    if path:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bucket_bits(rows: int, rows_per_bucket: int = 4096) -> int:
    """Bits of a hash that deal ``rows`` into buckets of about ``rows_per_bucket``; 4 to 20."""
    return min(20, max(4, (max(1, rows) // rows_per_bucket).bit_length()))


def running_total(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str, totals: DataFrame) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its group.

    A group may hold a third of all rows, so it is never sorted in one task. ``bucket`` is a number
    that rises with ``order``; ``totals`` (group, bucket, total) gives each bucket's sum, the window over
    it sees one row a bucket, and the window over rows sees one bucket. Both share one exchange of ``df``.
    Group and bucket must not be null.
    """
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(group, bucket, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, [group, bucket])
        .withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__start")
    )


def global_rank(df: DataFrame, order: list[str], out: str, label: str) -> DataFrame:
    """``df`` range-sorted by ``order`` with ``out``, its dense position from 0; no task sees more than its own range.

    Rows that are equal in ``order`` share a range, so ``order`` has to end in columns that are nearly unique.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = written(ranged.withColumn("__id", F.monotonically_increasing_id()), label)
    part = F.shiftright(F.col("__id"), 33)
    counts = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # one row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (
        kept.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(out, F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__part", "__id", "__start")
    )


def utf8_size(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: What a Python worker keeps for its next tasks: at most one large object, by its key.
_held: dict = {}


def held(key, make):
    """The object of this key, made by ``make`` unless it is the last one that this worker was asked for; others are let go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Frees what an earlier stage's tasks have left in this worker: workers serve all stages, one after the other."""
    _held.clear()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Spark hand texts to Python in batches of at most ``rows``, unless the session's own setting is lower.

    The default of 10,000 rows puts no useful bound on the memory that long texts take outside of the heap.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def text_batches(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: bounds what a Python worker holds decoded at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
