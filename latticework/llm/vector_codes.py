"""Product codes of vectors: Lloyd's rounds over each part's codebook, by the filtering of kd-trees.

Rows are packed into blocks where they lie. A block holds a kd-tree for each part: its points are stored in the order of the tree's
leaves, so that a node is a run of them, halves of a node are its children, and boxes, sums and counts of all nodes follow from the
runs. In a round, the codebook's entries come down the tree. At a node, the entry nearest to the middle of the box drops every entry
that is farther than itself from all of the box; once one is left, the whole subtree is its, and the node's cached sum and count are
added to it. Only leaves that several entries reach compare points with those. All arithmetic is on integers, so codes
and codebooks do not depend on how rows are dealt over partitions and blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block, whose trees are a task's unit, and points of a leaf.
BLOCK = 8192
LEAF = 8
#: Integers beyond this take Python's, as squares and sums of their differences might not fit 64 bits.
NARROW = 1 << 26


def levels(n: int) -> list[np.ndarray]:
    """Bounds of the nodes' runs on each level of a tree of ``n`` points, the root first; node i has the children 2i and 2i + 1."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max() > LEAF:
        ends = out[-1]
        halved = np.empty(2 * len(ends) - 1, np.int64)
        halved[::2], halved[1::2] = ends, (ends[:-1] + ends[1:]) >> 1
        out.append(halved)
    return out


def tree_order(points: np.ndarray) -> np.ndarray:
    """The order of (n, width) points in the leaves: each node is halved along the widest side of its box."""
    order = np.arange(len(points))
    for ends in levels(len(points))[:-1]:
        x = points[order]
        wide = (np.maximum.reduceat(x, ends[:-1]) - np.minimum.reduceat(x, ends[:-1])).argmax(axis=1)
        node = np.repeat(np.arange(len(wide)), np.diff(ends))
        order = order[np.lexsort((x[np.arange(len(x)), wide[node]], node))]
    return order


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of all places in the runs."""
    length = ends - starts
    owner = np.repeat(np.arange(len(starts)), length)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + starts[owner]


def filtered(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(assigned, sums, counts) of (n, width) points in tree order and a (k, width) codebook.

    Each point is assigned to the nearest entry, the lower one of equally near ones; ``sums`` (k, width) and ``counts`` (k) are
    those of the entries' points, for subtrees from what their nodes hold.
    """
    ends = levels(len(points))
    low, high, total = ([f.reduceat(points, ends[-1][:-1])] for f in (np.minimum, np.maximum, np.add))
    for _ in ends[1:]:
        for held, f in ((low, np.minimum), (high, np.maximum), (total, np.add)):
            held.append(f(held[-1][::2], held[-1][1::2]))
    k = len(book)
    places = np.arange(k)
    assigned, sums, counts = np.zeros(len(points), np.int64), np.zeros_like(book), np.zeros(k, np.int64)
    far = (1 << 200) if points.dtype == object else np.iinfo(np.int64).max
    node, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level, bounds in enumerate(ends):
        lo, hi = low[-1 - level][node], high[-1 - level][node]
        # twice the middle, so that it is whole
        near = ((2 * book[None] - (lo + hi)[:, None]) ** 2).sum(axis=2)
        best = np.where(open_, near, far).argmin(axis=1)
        chosen = book[best][:, None]
        # the corner of the box that is nearest to an entry in comparison with the chosen one
        corner = np.where(book[None] > chosen, hi[:, None], lo[:, None])
        gap = ((corner - book[None]) ** 2).sum(axis=2) - ((corner - chosen) ** 2).sum(axis=2)
        open_ &= (gap < 0) | ((gap == 0) & (places <= best[:, None]))
        whole = open_.sum(axis=1) == 1
        owner, place = runs(bounds[node[whole]], bounds[node[whole] + 1])
        assigned[place] = best[whole][owner]
        np.add.at(sums, best[whole], total[-1 - level][node[whole]])
        np.add.at(counts, best[whole], bounds[node[whole] + 1] - bounds[node[whole]])
        node, open_ = node[~whole], open_[~whole]
        if level < len(ends) - 1:
            node, open_ = np.stack([2 * node, 2 * node + 1], axis=1).reshape(-1), np.repeat(open_, 2, axis=0)
    if len(node):
        owner, place = runs(ends[-1][node], ends[-1][node + 1])
        held, entry = np.nonzero(open_)
        often = np.bincount(held, minlength=len(node))
        first = np.cumsum(often) - often
        # a row for each point and entry that reached its leaf
        point, at = runs(first[owner], first[owner] + often[owner])
        entry = entry[at]
        apart = ((points[place][point] - book[entry]) ** 2).sum(axis=1)
        begins = np.cumsum(often[owner]) - often[owner]
        nearest = np.flatnonzero(apart == np.minimum.reduceat(apart, begins)[point])
        once = np.ones(len(nearest), bool)
        once[1:] = point[nearest[1:]] != point[nearest[:-1]]
        own = entry[nearest[once]]
        assigned[place] = own
        np.add.at(sums, own, points[place])
        np.add.at(counts, own, 1)
    return assigned, sums, counts


def parted(x: np.ndarray, width: int) -> np.ndarray:
    """(parts, rows, width) of (rows, parts * width)."""
    return np.ascontiguousarray(x.reshape(len(x), x.shape[1] // width, width).swapaxes(0, 1))


def packed(rows: DataFrame, label: str, dim: int, width: int, scale: int, block: int) -> DataFrame:
    """Blocks of rows: ids and labels, and for each part its points in the tree's order with their places in the block."""

    def bundled(ids: list, labels: list, x: list) -> pa.RecordBatch:
        parts = parted(np.concatenate(x), width)
        orders = [tree_order(p) for p in parts]
        ends = pa.array([0, parts.shape[1]], pa.int32())
        points = np.stack([p[o] for p, o in zip(parts, orders)])
        kind = np.int32 if np.abs(points).max(initial=0) < 1 << 31 else np.int64
        lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(v)) for v in (ids, labels)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([points.astype(kind).tobytes()]), pa.array([np.stack(orders).astype(np.int32).tobytes()])], ["ids", "labels", "points", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x, n = [], [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - n)
                ids.append(part.column("vec_id"))
                labels.append(part.column("label"))
                x.append(vectors.integers(vectors.matrix(part.column("embedding"), dim), scale))
                n, at = n + part.num_rows, at + part.num_rows
                if n == block:
                    yield bundled(ids, labels, x)
                    ids, labels, x, n = [], [], [], 0
        if n:
            yield bundled(ids, labels, x)

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"ids array<long>, labels array<{kind}>, points binary, places binary")


def unpacked(batch: pa.RecordBatch, at: int, width: int, parts: int) -> np.ndarray:
    """(parts, rows, width) of a block; Python's integers where they are wide."""
    rows = len(batch.column("ids")[at])
    data = batch.column("points")[at].as_buffer()
    kind = np.int32 if data.size == 4 * rows * parts * width else np.int64
    return np.frombuffer(data, kind).reshape(parts, rows, width).astype(np.int64)


def fitting(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers, or both as Python's where those might overflow."""
    if max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)) >= NARROW:
        return points.astype(object), book.astype(object)
    return points, book


def improved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The (parts, entries, width) codebooks after a round: the floors of the means of each entry's points; unused entries stay."""
    parts, k, width = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, k, width + 1), object)
        for batch in batches:
            for at in range(batch.num_rows):
                points = unpacked(batch, at, width, parts)
                for p in range(parts):
                    _, sums, counts = filtered(*fitting(points[p], shared.value[p]))
                    totals[p, :, :width] += sums
                    totals[p, :, width] += counts
        p, e, i = np.nonzero(totals != 0)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(i, pa.int32()), pa.array([int(v) for v in totals[p, e, i]], pa.decimal128(38, 0))], ["part", "entry", "place", "total"])

    # a task sends a number for each number of the codebooks, and one more for each entry
    found = blocks.mapInArrow(run, "part int, entry int, place int, total decimal(38,0)").groupBy("part", "entry", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    totals = np.zeros((parts, k, width + 1), object)
    for r in found:
        totals[r["part"], r["entry"], r["place"]] = int(r["total"])
    out = books.copy()
    for p, e in zip(*np.nonzero(totals[:, :, width])):
        out[p, e] = [t // totals[p, e, width] for t in totals[p, e, :width]]
    return out


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each row of the blocks."""
    parts, _, width = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                points = unpacked(batch, at, width, parts)
                places = np.frombuffer(batch.column("places")[at].as_buffer(), np.int32).reshape(parts, -1)
                n = places.shape[1]
                codes, errors = np.zeros((n, parts), np.uint8), np.zeros(n, object)
                for p in range(parts):
                    x, book = fitting(points[p], shared.value[p])
                    own, _, _ = filtered(x, book)
                    codes[places[p], p] = own
                    errors[places[p]] += ((x - book[own]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                told = [pa.array([text[i * 2 * parts : (i + 1) * 2 * parts] for i in range(n)], pa.string()), pa.array([min(int(v), vectors.LONG) for v in errors], pa.int64())]
                held = [batch.column(c).slice(at, 1).flatten() for c in ("ids", "labels")]
                yield pa.RecordBatch.from_arrays([*held, *told], ["vec_id", "label", "code", "error"])

    kind = blocks.schema["labels"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def first_books(rows: DataFrame, dim: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts of the vectors of the smallest vec_ids: at most ``entries`` rows reach the driver. Null ids come last, ties by the vectors."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    x = np.zeros((len(first), dim))
    for i, r in enumerate(first):
        x[i, : len(r["embedding"])] = r["embedding"]
    return parted(vectors.integers(x, scale), dim // parts)


def coded(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each row of ``table`` (vec_id, embedding, label), and the (parts, entries, width) codebooks.

    Rows whose vector is null or holds null or non-finite components take no part. A component x counts as floor(scale * x), at most
    2^53 in absolute value; shorter vectors count as padded with zeros, and all are padded until they can be cut into ``parts``. Each
    part's codebook starts with the rows of the smallest vec_ids (null ones last, ties by the vectors, repeated rows one by one), of
    which there may be fewer than ``entries`` (256 at most). ``error`` is 2^63 - 1 where it is beyond. Repeated rows each have their
    result. An empty table gives no rows and empty codebooks. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part")
    rows = vectors.finite_rows(table, "label")
    dim = -(-max(1, vectors.dimensions(rows)) // parts) * parts
    blocks = common.written(packed(rows, "label", dim, dim // parts, scale, block), "vector-blocks")
    books = first_books(rows, dim, parts, entries, scale)
    if not books.shape[1]:
        return table.sparkSession.createDataFrame([], f"vec_id long, label {table.schema['label'].dataType.simpleString()}, code string, error long"), books
    for _ in range(rounds):
        books = improved(blocks, books)
    return assigned(blocks, books), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    """Codes with the errors of their labels, nulls together; a label's rows are summed in tasks before they move, and AQE splits a frequent one's."""
    found, books = coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = common.written(found, "vector-codes")
    sums = rows.groupBy(F.col("label").alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(vectors.LONG)).cast("long").alias("label_error"))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_COLUMNS = ("x1", "x2", "x3", "x4")


def _round_sql(i: int) -> str:
    """Round ``i``: the nearest entry of each part, as distance * 64 + entry, and the codebooks that follow."""
    apart = " + ".join(f"(w.{c} - b.{c}) * (w.{c} - b.{c})" for c in _COLUMNS)
    means = ", ".join(f"CASE WHEN n > 0 THEN CAST(floor(CAST(s.{c} AS DOUBLE) / n) AS BIGINT) ELSE b.{c} END AS {c}" for c in _COLUMNS)
    return f"""a{i} AS (SELECT rid, w.part, min(({apart}) * 64 + entry) AS best FROM w JOIN b{i} b USING (part) GROUP BY 1, 2),
s{i} AS (SELECT w.part, best % 64 AS entry, count(*) AS n, {", ".join(f"sum(w.{c}) AS {c}" for c in _COLUMNS)} FROM w JOIN a{i} USING (rid, part) GROUP BY 1, 2),
b{i + 1} AS (SELECT b.part, b.entry, {means} FROM b{i} b LEFT JOIN s{i} s USING (part, entry))"""


#: For vectors of 64 components, as the tables have them.
ORACLE = f"""
WITH good AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT rid, part, {", ".join(f"CAST(floor(256 * CAST(embedding[part * 4 + {i + 1}] AS DOUBLE)) AS BIGINT) AS {c}" for i, c in enumerate(_COLUMNS))} FROM good, range(16) p(part)),
b0 AS (SELECT part, rid AS entry, {", ".join(_COLUMNS)} FROM w WHERE rid < 64),
{_round_sql(0)},
{_round_sql(1)},
{_round_sql(2)},
c AS (SELECT rid, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY rid),
h AS (SELECT sha256(string_agg(concat_ws(',', {", ".join(_COLUMNS)}), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM good JOIN c USING (rid), h
"""
