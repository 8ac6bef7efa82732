"""Streams of points and of mutations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.grid import with_cell
from ..operators.mutate import delete_bag, insert_bag
from ..plans.spec import Grid


def cell_counts(stream: DataFrame, grid: Grid, time: str, window: str, late: str) -> DataFrame:
    """(start, cell, n): points per cell and time window of a stream; rows later than ``late`` are dropped."""
    timed = with_cell(stream.withWatermark(time, late), grid)
    return timed.groupBy(F.window(time, window).alias("w"), "cell").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "cell", "n")


def apply_batch(points: DataFrame, batch: DataFrame, coords: list[str], op: str = "op") -> DataFrame:
    """Coordinates after a batch of rows with ``op`` insert or delete: inserts come first, both with bag semantics."""
    added = insert_bag(points.select(*coords), batch.filter(F.col(op) == "insert").select(*coords))
    return delete_bag(added, batch.filter(F.col(op) == "delete"), coords)


def run_updates(stream: DataFrame, load: Callable[[int], DataFrame], store: Callable[[DataFrame, int], None], coords: list[str], checkpoint: str) -> StreamingQuery:
    """Applies each micro-batch to a versioned table: ``load(version)`` gives the table before batch ``version``, and ``store`` writes
    the one after it. A batch that runs again reads and writes the same versions, so its effect is had once."""

    def step(batch: DataFrame, number: int) -> None:
        store(apply_batch(load(number), batch, coords), number + 1)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
