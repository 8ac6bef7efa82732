"""Stored indexes. Each stage's folder is named by what it was made from, and a manifest names the folders that make up a version.

A changed input or size so leads to other folders, from the first stage that it concerns on; a build that was stopped goes on at the
stage it had reached, and readers of an older build are not disturbed. Manifests are written last and never changed.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import asdict, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import grid as grids
from ..operators import index as indexes
from ..operators import layout
from ..operators.index import Index
from ..plans.spec import Grid, IndexSpec
from . import files

#: What a spec holds besides the grid's coordinates and domain.
SIZES = ("parts", "eta", "page_size", "segments", "knots", "lattice_intervals")


def digest(*parts) -> str:
    """A name for all of ``parts``."""
    return hashlib.sha256(json.dumps(parts, default=str, sort_keys=True).encode()).hexdigest()[:16]


def files_token(spark: SparkSession, paths: list[str]) -> str:
    """What the files at or below ``paths`` are: names, lengths and times of change. Contents are not read.

    Spark lists them, and a task looks at many, so that it takes about a task a core whatever their number.
    """
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 50))
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "modificationTime", "length")
        told = found.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")).alias("h")).first()
    finally:
        spark.conf.set(name, before)
    return digest("files", told["n"], told["h"])


def source_token(points: DataFrame) -> str:
    """What ``points`` is read from, by ``files_token``, and its columns; rows that come from no file are hashed themselves, by their bag."""
    paths = points.inputFiles()
    if paths:
        return digest(files_token(points.sparkSession, sorted(unquote(p) for p in paths)), points.schema.simpleString())
    told = points.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*points.columns).cast("decimal(38,0)")).alias("h")).first()
    return digest("rows", told["n"], told["h"], points.schema.simpleString())


def manifest_path(path: str, token: str, version: int) -> str:
    return f"{path}/{token}.{version:06d}.json"


def newest(spark: SparkSession, path: str, token: str) -> int:
    """The newest version of an index that was built from ``token``; -1 without any."""
    found = [int(m[1]) for n in files.names_in(spark, path) if (m := re.fullmatch(rf"{token}\.(\d+)\.json", n))]
    return max(found, default=-1)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, or of the newest one, of the index that was built last; None if there is none."""
    token = files.get_text(spark, f"{path}/current")
    if token is None:
        return None
    text = files.get_text(spark, manifest_path(path, token, newest(spark, path, token) if version is None else version))
    return json.loads(text) if text else None


def put_manifest(spark: SparkSession, path: str, held: dict) -> None:
    """Of two writers of the same version one fails, and no work of the other is lost."""
    files.put_text(spark, manifest_path(path, held["token"], held["version"]), json.dumps(held), only_new=True)


def in_folders(spark: SparkSession, path: str, entries: list[dict], schema: T.StructType) -> DataFrame:
    """The rows of the entries' folders, but for blocks that others have taken over."""
    parts = []
    for e in entries:
        rows = spark.read.schema(schema).parquet(f"{path}/{e['folder']}")
        parts.append(rows.filter(~F.col("block").isin(e["without"])) if e["without"] else rows)
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_points(rows: DataFrame, path: str, id_col: str) -> None:
    """By block in files sorted by m, so that filters on block and m skip files and row groups; ids divide runs of equal m."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "block", "m", id_col).sortWithinPartitions("block", "m").write.mode("overwrite").partitionBy("block").parquet(path)


def _finish(indexed: DataFrame, models: DataFrame, grid: Grid, path: str, id_col: str, token: str, names: dict) -> None:
    """Points, page directory and the manifest of version 0."""
    spark = indexed.sparkSession
    blocked = indexed.withColumn("block", indexes.block_of(max(1, models.count())))
    points, pages = f"points-{token}", f"pages-{token}"
    if not files.exists(spark, f"{path}/{points}"):
        write_points(blocked, f"{path}/{points}", id_col)
    kept = spark.read.schema(blocked.schema).parquet(f"{path}/{points}")
    listed = indexes.directory(kept, models, grid.spec.coords)
    files.stage(spark, f"{path}/{pages}", lambda: listed)
    last = spark.read.schema(listed.schema).parquet(f"{path}/{pages}").agg(F.max("page"), F.max("shard")).first()
    put_manifest(
        spark,
        path,
        names
        | {
            "token": token,
            "version": 0,
            "id": id_col,
            "sizes": {k: v for k, v in asdict(grid.spec).items() if k in SIZES},
            "points": [{"folder": points, "without": []}],
            "pages": [{"folder": pages, "without": []}],
            "retired": [],
            "next_page": (last[0] if last[0] is not None else -1) + 1,
            "next_shard": (last[1] if last[1] is not None else -1) + 1,
            "schemas": {"points": blocked.schema.json(), "pages": listed.schema.json()},
        },
    )


def save_index(indexed: DataFrame, models: DataFrame, grid: Grid, path: str, id_col: str = "id") -> None:
    """Stores points that are laid out already, with their models and grid, as the current index at ``path``."""
    spark, token = indexed.sparkSession, digest(uuid.uuid4().hex)
    names = {"bounds": f"bounds-{token}", "models": f"models-{token}"}
    files.save_grid(spark, grid, f"{path}/{names['bounds']}")
    indexes.with_first(models).write.mode("overwrite").parquet(f"{path}/{names['models']}")
    _finish(indexed, spark.read.parquet(f"{path}/{names['models']}"), grid, path, id_col, token, names)
    files.put_text(spark, f"{path}/current", token)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, Grid] | None:
    """(points, models, grid), or None if a table or a segment's model is missing."""
    found = open_index(spark, path)
    return found and (found.points, found.models, found.grid)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index | None:
    """A version of the stored index, the newest one by default, ready for queries; None if a table or a segment's model is missing.

    Pages that later versions have replaced are left out by their numbers, which are never used again; filters on block and m pass below that.
    """
    held = manifest(spark, path, version)
    if held is None or not all(files.exists(spark, f"{path}/{f}") for f in (held["models"], *(e["folder"] for e in held["points"] + held["pages"]), *held["retired"])):
        return None
    grid = files.load_grid(spark, f"{path}/{held['bounds']}")
    if grid is None:
        return None
    models = spark.read.parquet(f"{path}/{held['models']}")
    points, pages = (in_folders(spark, path, held[t], T.StructType.fromJson(json.loads(held["schemas"][t]))) for t in ("points", "pages"))
    if held["retired"]:
        gone = reduce(lambda a, b: a.unionByName(b), [spark.read.schema("page long").parquet(f"{path}/{f}") for f in held["retired"]])
        points, pages = points.join(gone, "page", "left_anti").select(*points.columns), pages.join(gone, "page", "left_anti").select(*pages.columns)
    if pages.select("segment").join(models, "segment", "left_anti").limit(1).count():
        return None
    # one number a segment
    starts = [r["min_m"] for r in models.select("segment", "min_m").orderBy("segment").collect()][1:]
    return Index(points, models, pages, Grid(replace(grid.spec, **held["sizes"]), grid.bounds), starts, held["token"], held["version"])


def build_index(points: DataFrame, coords: tuple[str, ...], id_col: str, path: str, grid: Grid | None = None, source: str | None = None, **sizes) -> Index:
    """Bulk load: grid, mapping, segments, models, points by shard and page, directory. Opens the index if all of it is there.

    A stage is kept under ``path`` and done once for what it is made from: ``source`` (what the points are read from, told by ``source_token``
    unless given), the stages before it and the sizes that it depends on. Segments follow the number of rows. Rows with a null or
    non-finite coordinate are kept, in an outermost cell or at the end of one, where no box finds them. Versions that were made of an
    older build stay with it.
    """
    spark = points.sparkSession
    spec = IndexSpec(tuple(coords), (0.0,) * len(coords), (0.0,) * len(coords), **sizes) if grid is None else grid.spec
    given = None if grid is None else [asdict(grid.spec), [b.tolist() for b in grid.bounds]]
    first = digest(source or source_token(points), coords, spec.parts, given)
    bounds = f"{path}/bounds-{first}"
    rows = files.get_text(spark, f"{bounds}/rows")
    if rows is None:
        made = grid or grids.build_grid(points, grids.spec_for(points, coords, **sizes))
        files.save_grid(spark, made, bounds)
        rows = str(points.count())
        files.put_text(spark, f"{bounds}/rows", rows)
    held = files.load_grid(spark, bounds)
    sized = replace(held.spec, **{k: getattr(spec, k) for k in SIZES})
    grid = Grid(sized if given else sized.sized(int(rows)), held.bounds)
    second = digest(first, grid.spec.eta)
    third = digest(second, grid.spec.segments, grid.spec.page_size, id_col)
    fourth = digest(third, grid.spec.knots)
    token = digest(fourth, indexes.BLOCKS, grid.spec.lattice_intervals)
    if newest(spark, path, token) < 0:
        mapped = files.stage(spark, f"{path}/mapped-{second}", lambda: grids.with_mapping(points, grid))
        segmented = files.stage(spark, f"{path}/segmented-{third}", lambda: layout.with_segment(mapped, layout.segment_bounds(mapped, grid.spec)))
        models = files.stage(spark, f"{path}/models-{fourth}", lambda: indexes.with_first(layout.train_models(segmented, grid.spec)))
        _finish(layout.with_shard(segmented, models, grid.spec, id_col), models, grid, path, id_col, token, {"bounds": f"bounds-{first}", "models": f"models-{fourth}"})
    if files.get_text(spark, f"{path}/current") != token:
        files.put_text(spark, f"{path}/current", token)
    return open_index(spark, path)
