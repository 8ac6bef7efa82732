"""Readers and writers: points, boxes, lists, key-value maps, arrays, grids and lattices. All paths are Spark's."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import converted
from ..plans.spec import Grid, IndexSpec


def read_points(spark: SparkSession, path: str, coords: list[str], id_col: str | None = None) -> DataFrame:
    """Points of a Parquet table, coordinates as doubles; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*([F.col(id_col).cast("long").alias(id_col)] if id_col else []), *[F.col(c).cast("double").alias(c) for c in coords])


def npy_rows(contents: DataFrame, dims: int) -> DataFrame:
    """(row, x0 .. x{dims-1}) of .npy matrices from (content); a matrix is one task's, its rows leave it in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                x = np.load(io.BytesIO(data), allow_pickle=False).astype(np.float64).reshape(-1, dims)
                for at in range(0, len(x), 65536):
                    part = x[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), *(pa.array(part[:, i].copy()) for i in range(dims))], ["row", *(f"x{i}" for i in range(dims))])

    kind = "row long, " + ", ".join(f"x{i} double" for i in range(dims))
    return contents.select("content").mapInArrow(run, kind)


def read_npy(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(row, x0 .. x{dims-1}) of .npy matrices, by way of Spark's file reader; a file is one task's, of 2 GB at most: larger matrices come as several files."""
    return npy_rows(spark.read.format("binaryFile").load(path), dims)


def text_rows(points: DataFrame, coords: list[str]) -> DataFrame:
    """(value): a row's numbers with ten decimals, separated by spaces; nulls are left out."""
    return points.select(F.concat_ws(" ", *[F.format_string("%.10f", F.col(c).cast("double")) for c in coords]).alias("value"))


def write_text_rows(points: DataFrame, path: str, coords: list[str]) -> None:
    """Rows of numbers with ten decimals, separated by spaces."""
    text_rows(points, coords).write.mode("overwrite").text(path)


def list_of(lines: DataFrame) -> DataFrame:
    """(value): lines without white space at their ends."""
    return lines.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return list_of(spark.read.text(path))


def boxes_of(lines: DataFrame, dims: int) -> DataFrame:
    """(lo, hi) from lines of ``dims`` lows and then ``dims`` highs."""
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double"))
    return lines.filter(F.trim("value") != "").select(numbers.alias("v")).select(F.slice("v", 1, dims).alias("lo"), F.slice("v", dims + 1, dims).alias("hi"))


def read_boxes(spark: SparkSession, path: str, dims: int) -> DataFrame:
    return boxes_of(spark.read.text(path), dims)


def map_of(lines: DataFrame, key: str, value: str, separator: str = "\t", reverse: bool = False) -> DataFrame:
    """(key, value) from (at, value) lines in order of ``at``; of equal keys the last one holds. ``reverse``: value stands first."""
    import re

    parts = F.split("value", re.escape(separator))
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    k, v = (second, first) if reverse else (first, second)
    cells = lines.select("at", converted(k, key).alias("key"), converted(v, value).alias("value"))
    return cells.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def read_map(spark: SparkSession, path: str, key: str = "str", value: str = "str", separator: str = "\t", reverse: bool = False) -> DataFrame:
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return map_of(lines, key, value, separator, reverse)


def map_lines(pairs: DataFrame, separator: str = "\t") -> DataFrame:
    """(value): key, separator and value of each pair; nulls are left out with their separator."""
    return pairs.select(F.concat_ws(separator, F.col("key").cast("string"), F.col("value").cast("string")).alias("value"))


def write_map(pairs: DataFrame, path: str, separator: str = "\t") -> None:
    map_lines(pairs, separator).write.mode("overwrite").text(path)


def list_files(spark: SparkSession, path: str, suffix: str, deep: bool = True) -> DataFrame:
    """(path, length) of files with a suffix; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", str(deep).lower())
    return reader.load(path).select("path", "length")


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _folder(spark, path)
    fs.mkdirs(where)


def remove_folder(spark: SparkSession, path: str, only_empty: bool = False) -> bool:
    """Removes a folder; False if there is none, or it holds something and ``only_empty`` is set."""
    fs, where = _folder(spark, path)
    if not fs.exists(where) or only_empty and len(fs.listStatus(where)):
        return False
    return fs.delete(where, not only_empty)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` and its job ended."""
    fs, where = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, written first by ``make`` if it is not there: a stage that was done is not done again.

    ``path`` has to name all that the table is made from, see ``store.digest``.
    """
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def put_text(spark: SparkSession, path: str, text: str, only_new: bool = False) -> None:
    """Writes a small text; an error with ``only_new`` if the file is there."""
    fs, where = _folder(spark, path)
    out = fs.create(where, not only_new)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str | None:
    fs, where = _folder(spark, path)
    if not fs.exists(where):
        return None
    opened = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    finally:
        opened.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, where = _folder(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


LATTICE = ("nodes", "node_radii", "training_points", "training_radii", "testing_points", "testing_radii", "model")


def save_lattice(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of a trained lattice, see ``lattice.prepared``, and ``model`` (node_id, radii)."""
    for name in LATTICE:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def load_lattice(spark: SparkSession, path: str, names: tuple[str, ...] = LATTICE) -> dict[str, DataFrame] | None:
    """The saved tables, or None if one of ``names`` is missing and the lattice has to be trained first; ``("model",)`` is enough to estimate."""
    if not all(exists(spark, f"{path}/{n}") for n in names):
        return None
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def save_grid(spark: SparkSession, grid: Grid, path: str) -> None:
    spec = grid.spec
    rows = [(i, p, [float(x) for x in b]) for i, level in enumerate(grid.bounds) for p, b in enumerate(level)]
    meta = [(list(spec.coords), list(spec.low), list(spec.high), spec.parts, spec.eta, spec.page_size, spec.segments, spec.knots, spec.lattice_intervals)]
    kind = "coords array<string>, low array<double>, high array<double>, parts int, eta double, page_size int, segments int, knots int, lattice_intervals int"
    spark.createDataFrame(meta, kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/spec")
    spark.createDataFrame(rows, "dim int, parent int, bounds array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")


def load_grid(spark: SparkSession, path: str) -> Grid | None:
    """The saved grid, or None if it is not there."""
    if not all(exists(spark, f"{path}/{t}") for t in ("spec", "grid")):
        return None
    s = spark.read.parquet(f"{path}/spec").first()
    spec = IndexSpec(tuple(s["coords"]), tuple(s["low"]), tuple(s["high"]), s["parts"], s["eta"], s["page_size"], s["segments"], s["knots"], s["lattice_intervals"])
    levels: dict[int, dict[int, list[float]]] = {}
    for r in spark.read.parquet(f"{path}/grid").collect():
        levels.setdefault(r["dim"], {})[r["parent"]] = r["bounds"]
    return Grid(spec, tuple(np.array([levels[i][p] for p in range(len(levels[i]))]) for i in sorted(levels)))
