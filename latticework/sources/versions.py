"""Versions of a stored index: inserts and deletes that later queries see, without building it anew.

Pages are copied on write. A change reads the pages that it touches, writes what they become under new page numbers beside the others,
with their rows of the directory, and lists the old numbers as retired; the next version's manifest adds these folders. Readers union the
folders and leave retired pages out, so an older version can still be read. Models and grid stay as they were built, and answers
do not depend on them. Once there are many folders, the blocks that changes have touched are written anew and the folders fall away.

Of two changes to the same version one fails when it writes its manifest, and may be tried again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as grids
from ..operators import index as indexes
from ..operators import layout, mutate
from ..operators.index import Index
from ..operators.ranks import ranked, saved
from . import files, store

#: Folders of points that a version has before the touched blocks are compacted.
MOST_FOLDERS = 8


def _opened(spark: SparkSession, path: str) -> tuple[Index, dict]:
    held = store.manifest(spark, path)
    found = held and store.open_index(spark, path, held["version"])
    if not found:
        raise ValueError(f"{path} holds no index")
    return found, held


def rows_of(ix: Index, pages: DataFrame) -> DataFrame:
    """The points of some pages (rows of the directory), read from their blocks and ranges of m only."""
    near = indexes.in_reach(ix, pages.select("block", F.col("low_m").alias("from_m"), F.col("high_m").alias("to_m")))
    return near.join(pages.select("page"), "page", "left_semi").select(*ix.columns)


def renumbered(rows: DataFrame, keys: list[str], next_page: int) -> tuple[DataFrame, int]:
    """``rows`` with a new page number for each combination of ``keys``, in the order of their first m, and the next free number."""
    firsts = saved(ranked(rows.groupBy(*keys).agg(F.min("m").alias("__m")), ["__m", *keys], "__place").drop("__m"), "new-pages")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys])
    joined = rows.alias("r").join(firsts.alias("f"), same).select(*[F.col(f"r.`{c}`") for c in rows.columns if c != "page"], (F.col("f.__place") + next_page).alias("page"))
    return joined, next_page + firsts.count()


def _add(spark: SparkSession, path: str, ix: Index, held: dict, rows: DataFrame, retired: DataFrame, next_page: int, next_shard: int) -> Index:
    """Writes the rows of new pages, their directory and the retired numbers, and then the manifest that makes them a version."""
    name = f"{held['version'] + 1:06d}-{uuid.uuid4().hex[:8]}"
    store.write_points(rows.select(*ix.columns), f"{path}/points-{name}", held["id"])
    new = spark.read.schema(ix.points.schema).parquet(f"{path}/points-{name}")
    indexes.directory(new, ix.models, ix.grid.spec.coords).select(*ix.pages.columns).write.parquet(f"{path}/pages-{name}")
    retired.select(F.col("page").cast("long").alias("page")).write.parquet(f"{path}/retired-{name}")
    changed = held | {
        "version": held["version"] + 1,
        "points": [*held["points"], {"folder": f"points-{name}", "without": []}],
        "pages": [*held["pages"], {"folder": f"pages-{name}", "without": []}],
        "retired": [*held["retired"], f"retired-{name}"],
        "next_page": next_page,
        "next_shard": next_shard,
    }
    store.put_manifest(spark, path, changed)
    return compact(spark, path) if len(changed["points"]) > MOST_FOLDERS else store.open_index(spark, path)


def insert(spark: SparkSession, path: str, new: DataFrame) -> Index:
    """Adds the points ``new`` (id, coordinates, ...); equal ones stay apart. Gives the next version.

    A point goes to the last page of its segment that starts at or below its mapping, else to the segment's first one. Pages that get
    points are written anew, cut into even pieces where they would be too large. Points without a mapping (a null last
    coordinate) are left out, as in a build; columns that the index lacks are left out, and columns that ``new`` lacks are null. A point of
    a segment whose pages are all gone opens a page and a shard of its own.
    """
    ix, held = _opened(spark, path)
    mapped = grids.with_mapping(new, ix.grid)
    own = [c for c in mapped.columns if c in ix.columns]
    added = saved(layout.with_segment(mapped.select(*own), ix.starts), "added")
    near = ix.pages.join(added.select("segment").distinct(), "segment", "left_semi")
    marks = near.select("segment", F.col("low_m").alias("m"), F.struct("page", "shard").alias("at"))
    placed = indexes.last_before(marks, added, "segment", ["m"], "at", "__at")
    segments = max(1, ix.models.count())
    at = saved(
        placed.select(
            *added.columns,
            F.coalesce("__at.page", -1 - F.col("segment")).alias("page"),
            F.coalesce("__at.shard", F.lit(held["next_shard"]) + F.col("segment")).alias("shard"),
            indexes.block_of(segments).alias("block"),
        ),
        "placed",
    )
    touched = saved(near.join(at.select("page").distinct(), "page", "left_semi"), "touched")
    both = rows_of(ix, touched).unionByName(at, allowMissingColumns=True)
    cut = saved(mutate.in_pieces(both, ["page"], ix.grid.spec.page_size, held["id"]).withColumnRenamed("page", "__old"), "pieces")
    rows, next_page = renumbered(cut, ["__old", "piece"], held["next_page"])
    return _add(spark, path, ix, held, rows, touched, next_page, held["next_shard"] + segments)


def delete(spark: SparkSession, path: str, gone: DataFrame) -> Index:
    """Takes one point of equal coordinates away for each row of ``gone`` (coordinates), the smallest ids first. Gives the next version.

    Rows that are not there are ignored, nulls equal nulls. Pages are found by the models and the directory. Of the pages of a touched shard,
    neighbours merge from left to right as long as their points fit a page (see ``mutate.chained``); emptied pages are gone.
    """
    ix, held = _opened(spark, path)
    spec = ix.grid.spec
    coords = list(spec.coords)
    wanted = saved(grids.with_mapping(gone.select(*[F.col(c).cast("double").alias(c) for c in coords]), ix.grid).select(*coords, "m"), "gone")
    ends = wanted.select(F.col("m").alias("low_m"), F.col("m").alias("high_m")).distinct()
    found = saved(indexes.met_pages(ix, ends).select("page").distinct(), "candidates")
    candidates = rows_of(ix, ix.pages.join(found, "page", "left_semi"))
    stay, go = mutate.doomed(candidates, wanted, coords, held["id"])
    touched = saved(go.groupBy("page").agg(F.count("*").alias("__lost")), "touched")
    shards = ix.pages.join(touched, "page", "left_semi").select("shard").distinct()
    left = ix.pages.join(shards, "shard", "left_semi").join(touched, "page", "left").withColumn("n", F.col("n") - F.coalesce("__lost", F.lit(0)))
    chains = saved(mutate.chained(left.filter("n > 0").withColumn("__order", F.struct("low_m", "page")), "shard", "__order", spec.page_size), "chains")
    # pages that lost a point, and those that merge with another one
    merging = chains.groupBy("shard", "chain").agg(F.count("*").alias("__members"), F.max("__lost").alias("__any")).filter("__members > 1 OR __any IS NOT NULL")
    changed = saved(chains.join(merging, ["shard", "chain"]).select(*ix.pages.columns, "__lost", "chain"), "changed")
    whole = changed.filter("__lost IS NULL")
    kept = stay.join(touched, "page", "left_semi").unionByName(rows_of(ix, whole))
    rows, next_page = renumbered(saved(kept.join(changed.select("page", "chain"), "page").drop("page"), "merged"), ["shard", "chain"], held["next_page"])
    retired = touched.select("page").unionByName(whole.select("page"))
    return _add(spark, path, ix, held, rows, retired, next_page, held["next_shard"])


def compact(spark: SparkSession, path: str) -> Index:
    """Writes the blocks that changes have touched into one folder each for points and directory; other blocks stay where they are.

    Rows, pages and their numbers stay the same. Gives the next version, or the present one if there is nothing to do.
    """
    ix, held = _opened(spark, path)
    if not held["retired"]:
        return ix
    schema = ix.pages.schema
    later = store.in_folders(spark, path, [e for e in held["pages"][1:] if e["folder"].startswith("pages-")], schema).select("block") if len(held["pages"]) > 1 else None
    gone = reduce(lambda a, b: a.unionByName(b), [spark.read.schema("page long").parquet(f"{path}/{f}") for f in held["retired"]])
    old = store.in_folders(spark, path, held["pages"], schema).join(gone, "page", "left_semi").select("block")
    # a number for each block, of which there are at most ``index.BLOCKS``
    blocks = sorted(r["block"] for r in (old.unionByName(later) if later is not None else old).distinct().collect())
    name = f"{held['version'] + 1:06d}-{uuid.uuid4().hex[:8]}"
    store.write_points(ix.points.filter(F.col("block").isin(blocks)), f"{path}/points-{name}", held["id"])
    ix.pages.filter(F.col("block").isin(blocks)).write.parquet(f"{path}/pages-{name}")
    base = lambda t: [e | {"without": sorted({*e["without"], *blocks})} for e in held[t][:1]]
    changed = held | {"version": held["version"] + 1, "retired": []} | {t: [*base(t), {"folder": f"{t}-{name}", "without": []}] for t in ("points", "pages")}
    store.put_manifest(spark, path, changed)
    return store.open_index(spark, path)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes folders and manifests that the newest version does not need, older builds' too; gives their names. Older versions are gone then."""
    held = store.manifest(spark, path)
    if held is None:
        return []
    used = {"current", held["bounds"], held["models"], f"{held['token']}.{held['version']:06d}.json", *held["retired"], *(e["folder"] for t in ("points", "pages") for e in held[t])}
    gone = sorted(n for n in files.names_in(spark, path) if n not in used)
    for n in gone:
        files.remove_folder(spark, f"{path}/{n}")
    return gone
