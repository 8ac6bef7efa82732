"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

Rows are dealt into bands by norm, each within a factor of two, so that a few long vectors do not set the scale of the others;
bands are cut half-way between powers of two, so that vectors of norm 1 are in one, whatever rounding does.
With M the largest norm of a band, its row x becomes (x, sqrt(M^2 - |x|^2)) and a query (q * M / |q|, 0), so that the nearest
one has the largest inner product. A table's hash is a row of functions floor((a . x + b) / w) with a drawn from the normal
distribution, which is 2-stable: where a . q = u, a row at the angle t from q has a . x = u cos(t) + M sin(t) N(0, 1). So the
probability that a neighbour is in a cell is known for each function. Of the buckets that hold rows, the likeliest are visited
until they have the part ``success`` of the probability of all, however far from the query they lie, and hold enough rows for k
neighbours. Bands whose norms are too
small for any of the k largest products are left out. The tables' candidates are scored exactly, merged and ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tables, width of a cell in deviations of the projections, and the part of the probability that one table's probes aim at.
TABLES = 2
WIDTH = 3.0
SUCCESS = 0.72
#: Rows that distances and projections are measured on, at most; every row is indexed.
SAMPLE = 2048
#: Rows of a bucket that one task scores; larger buckets are split, and their queries go to each part.
PART = 8192
#: The cosine of the angle to a neighbour counts as this at most.
NEAREST = 0.9
SEED = 11


class Band:
    """Hash functions of the rows of a band: ``a`` (tables, functions, dim + 1), ``b`` and ``w``; none if the band is one bucket.

    ``cells`` lists each table's buckets that hold rows, by ``keys``, their hashes in ascending order; ``parts`` what each is cut into,
    ``rows`` how many rows it holds.
    """

    def __init__(self, n: int, norm: float, sample: np.ndarray, tables: int, width: float, seed: list[int]):
        self.norm, dim = norm, sample.shape[1]
        # norms whose squares are beyond doubles are not hashed: such a band is one bucket
        hashed = 1e-150 < norm < 1e150
        functions = min(12, max(4, round(math.log2(max(1, n) / 3200)))) if hashed else 0
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables if hashed else 1, functions, dim + 1))
        wide = float((self.lifted(sample) @ self.a.reshape(-1, dim + 1).T).std(axis=0).mean()) if hashed and len(sample) > 30 else norm
        self.w = width * max(1e-12 * norm, wide)
        self.b = rng.uniform(0, self.w, size=self.a.shape[:2]) if hashed else np.zeros((1, 0))
        self.keys, self.cells, self.parts, self.rows = [], [], [], []

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.norm**2 - (x**2).sum(axis=1)))[:, None]])

    def cells_of(self, x: np.ndarray, table: int) -> np.ndarray:
        if not self.a.shape[1]:
            return np.zeros((len(x), 0), np.int64)
        return np.floor((self.lifted(x) @ self.a[table].T + self.b[table]) / self.w).astype(np.int64)

    def fill(self, found: list) -> None:
        """Takes the buckets that hold rows, (table, cells, parts, rows)."""
        for t in range(len(self.a)):
            own = sorted((tuple(c), p, n) for table, c, p, n in found if table == t)
            cells = np.array([c for c, _, _ in own], np.int64).reshape(len(own), self.a.shape[1])
            keys = bucket_of(cells)
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.cells.append(cells[order])
            self.parts.append(np.array([p for _, p, _ in own], np.int64)[order])
            self.rows.append(np.array([n for _, _, n in own], np.int64)[order])

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        """Each row's place in ``cells``; a row whose cells round differently from when they were listed goes to the nearest."""
        own, keys = self.cells_of(x, table), self.keys[table]
        wanted = bucket_of(own)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        for i in np.flatnonzero(keys[at] != wanted):
            at[i] = np.abs(self.cells[table] - own[i]).sum(axis=1).argmin()
        return at

    def probes(self, units: np.ndarray, cosines: np.ndarray, table: int, success: float, need: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query, bucket) of the probes of queries of norm 1 whose neighbours lie at angles of these cosines.

        Buckets are visited until both the probability and ``need`` rows are reached, or there are no more.
        """
        cells = self.cells[table]
        if not cells.shape[1]:
            return np.arange(len(units)), np.zeros(len(units), np.int64)
        middle = (self.norm * (units @ self.a[table, :, :-1].T) * cosines[:, None] + self.b[table]) / self.w
        spread = self.norm * np.sqrt(1 - cosines**2) / self.w
        queries, buckets = [], []
        step = max(1, 2_000_000 // len(cells))
        for at in range(0, len(units), step):
            p = np.ones((len(units[at : at + step]), len(cells)))
            for j, column in enumerate(cells.T):
                places, which = np.unique(column, return_inverse=True)
                low = (places - middle[at : at + step, j, None]) / spread[at : at + step, None]
                high = (places + 1 - middle[at : at + step, j, None]) / spread[at : at + step, None]
                p *= np.maximum(erf(high) - erf(low), 1e-12)[:, which]
            order = np.argsort(-p, axis=1, kind="stable")
            mass = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
            before = np.cumsum(self.rows[table][order], axis=1) - self.rows[table][order]
            q, rank = np.nonzero((np.hstack([np.zeros((len(p), 1)), mass[:, :-1]]) < success * mass[:, -1:]) | (before < need))
            queries.append(q + at)
            buckets.append(order[q, rank])
        return np.concatenate(queries), np.concatenate(buckets)


def erf(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.erf, 1, 1)(x / math.sqrt(2)).astype(float)


class Index:
    """The bands, and a sample of the table (``ids``, ``x``) that tells how near a query's neighbours are."""

    def __init__(self, dim: int, sample: list, k: int, bands: list, tables: int, width: float, success: float, seed: int, often: int = 1):
        #: ``need`` rows of a band hold k ids beside the query's own, as no id has more than ``often`` rows
        self.dim, self.k, self.success, self.need = dim, k, success, (k + 1) * often
        own = {i: (v, band) for i, v, band in reversed(sample)}
        self.ids, self.x = np.array(list(own), np.int64), self.padded([v for v, _ in own.values()])
        at = np.array([band for _, band in own.values()], np.int64)
        self.bands = {band: Band(n, norm, self.x[at == band], tables, width, [seed, band & 0xFFFF]) for band, n, norm in bands}
        self.n = sum(n for _, n, _ in bands)

    def padded(self, vectors: list) -> np.ndarray:
        out = np.zeros((len(vectors), self.dim))
        for row, x in zip(out, vectors):
            row[: len(x)] = x
        return out

    def reach(self, u: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries of norm 1: the component along them of a neighbour, and one that k other ids surely have.

        The first is read off each query's own products with the sample, so that no other rows decide how near its neighbours
        lie. Its rank is above the expected one of the k-th neighbour, by two deviations: the search rather goes too far.
        """
        own = u @ self.x.T
        own[ids[:, None] == self.ids[None, :]] = -np.inf
        order = -np.sort(-own, axis=1)
        expected = self.k * len(self.ids) / max(self.n, 1)
        rank = math.ceil(expected + 2 * math.sqrt(expected))
        pick = lambda r: order[:, r] if r < order.shape[1] else np.full(len(u), -np.inf)
        near = pick(rank)
        return np.where(np.isfinite(near), near, 0.0), pick(self.k - 1)


def units(x: np.ndarray) -> np.ndarray:
    top = np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0.0), 1e-300)
    return x / top / np.sqrt(((x / top) ** 2).sum(axis=1, keepdims=True))


def bucket_of(cells: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of cells."""
    out = np.zeros(len(cells), np.uint64)
    for c in cells.astype(np.int64).T:
        out = (out ^ np.ascontiguousarray(c).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return out.view(np.int64)


KEYED = "band int, table int, bucket int, part int, vec_id long, vector binary"


def banded(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(band, ids, vectors) of at most 1024 rows."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            x, ids, bands = index.padded(batch.column("embedding").to_pylist()), batch.column("vec_id").to_numpy(), batch.column("band").to_numpy()
            for band in np.unique(bands):
                yield int(band), ids[bands == band], x[bands == band]


def held(index: Index):
    """Rows to (band, table, cells, n): the buckets that hold rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, _, x in banded(index, batches):
            for t in range(len(index.bands[band].a)):
                cells = index.bands[band].cells_of(x, t)
                found, n = np.unique(cells, axis=0, return_counts=True) if cells.shape[1] else (cells[:1], np.array([len(x)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), band, np.int32)), pa.array(np.full(len(n), t, np.int32)), pa.array(found.tolist(), pa.list_(pa.int64())), pa.array(n, pa.int64())], ["band", "table", "cells", "n"])

    return run


def keyed(index: Index, queries: bool):
    """Rows to KEYED: a row of the index's tables, or a row for each part of each probe of a query."""
    names = ["band", "table", "bucket", "part", "vec_id", "vector"]

    def record(band, t, bucket, part, ids, raw, rows):
        at = pa.array(rows)
        for a in range(0, len(rows), 65_536):
            cut = slice(a, a + 65_536)
            same = [pa.array(np.full(len(rows[cut]), v, np.int32)) for v in (band, t)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(bucket[cut].astype(np.int32)), pa.array(part[cut].astype(np.int32)), pa.array(ids[rows[cut]]), raw.take(at[cut])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, ids, x in banded(index, batches):
            raw = pa.array([v.tobytes() for v in x], pa.binary())
            if not queries:
                for t in range(len(index.bands[own].a)):
                    bucket = index.bands[own].buckets(x, t)
                    part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % index.bands[own].parts[t][bucket]
                    yield from record(own, t, bucket, part, ids, raw, np.arange(len(x)))
                continue
            u = units(x)
            near, sure = index.reach(u, ids)
            for number, band in index.bands.items():
                some = np.flatnonzero(band.norm * (1 + 1e-9) >= sure)
                for t in range(len(band.a)) if len(some) else ():
                    q, bucket = band.probes(u[some], np.clip(near[some] / max(band.norm, 1e-300), -NEAREST, NEAREST), t, index.success, index.need)
                    parts = band.parts[t][bucket]
                    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    yield from record(number, t, np.repeat(bucket, parts), part, ids, raw, np.repeat(some[q], parts))

    return run


def best(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k ids of largest inner product with ``rows``, ties to smaller ids, its own id left out.

    An id's rows count once, with the largest product.
    """
    out = ([], [], [])
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    for a in range(0, len(queries), 256):
        rough = queries[a : a + 256] @ rows.T
        rough[q_ids[a : a + 256, None] == ids[None, :]] = -np.inf
        tops = np.maximum.reduceat(rough, starts, axis=1) if len(starts) < len(ids) else rough
        take = min(k, len(starts))
        floor = np.partition(tops, len(starts) - take, axis=1)[:, len(starts) - take]
        slack = 1e-9 * (1 + np.abs(rough[np.isfinite(rough)]).max(initial=0))
        q, x = np.nonzero((rough >= floor[:, None] - slack) & np.isfinite(rough))
        score = np.einsum("ij,ij->i", queries[a + q], rows[x])
        if len(starts) < len(ids):
            order = np.lexsort((-score, ids[x], q))
            q, x, score = q[order], x[order], score[order]
            once = (np.diff(q, prepend=-1) != 0) | (np.diff(ids[x], prepend=0) != 0)
            q, x, score = q[once], x[once], score[once]
        order = np.lexsort((ids[x], -score, q))
        q, x, score = q[order], x[order], score[order]
        first = np.searchsorted(q, np.arange(len(rough)))
        keep = np.arange(len(q)) - first[q] < k
        for o, v in zip(out, (q_ids[a + q[keep]], ids[x[keep]], score[keep])):
            o.append(v)
    return tuple(np.concatenate(o) for o in out)


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, width: float = WIDTH, success: float = SUCCESS, sample: int = SAMPLE, part: int = PART, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: up to k neighbours of largest inner product for each row whose vec_id divides by ``every``.

    All rows are indexed and are candidates, but for rows of the query's own id. The functions are fitted to the ``sample`` distinct
    rows of least hash. Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids.
    Shorter vectors count as padded with zeros. Ties go to the smaller vec_id; repeated rows of an id count once. An empty
    table gives an empty result. A query gets k rows, or all candidates if there are fewer: bands that are left out cannot
    hold the k best, and in each other band a table visits enough rows for k ids.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & x.isNotNull())
        .filter(~bad & F.exists(x, lambda v: v != 0))
        .distinct()
    )
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    good = good.withColumn("band", F.coalesce(F.floor(F.log2(norm) + 0.5), F.lit(-1100)).cast("int"))
    seen = good.groupBy("band").agg(F.count("*").alias("n"), F.max(F.size(x)).alias("dim"), F.max(norm).alias("norm")).orderBy("band").collect()
    picked = [(r["vec_id"], r["embedding"], r["band"]) for r in good.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(sample).collect()]
    often = good.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    index = Index(max((r["dim"] for r in seen), default=1), picked, k, [(r["band"], r["n"], r["norm"]) for r in seen], tables, width, success, seed, often)
    # buckets that hold rows, with the parts they are cut into
    found = good.mapInArrow(held(index), "band int, table int, cells array<long>, n long").groupBy("band", "table", "cells").agg(F.ceil(F.sum("n") / part).cast("int").alias("parts"), F.sum("n").alias("rows")).collect()
    for number, band in index.bands.items():
        band.fill([(r["table"], r["cells"], r["parts"], r["rows"]) for r in found if r["band"] == number])
    rows = good.mapInArrow(keyed(index, False), KEYED)
    probes = good.filter(F.col("vec_id") % every == 0).mapInArrow(keyed(index, True), KEYED)

    def score(queries: pa.Table, members: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not members.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        matrix = lambda t: np.frombuffer(b"".join(t.column("vector").to_pylist())).reshape(t.num_rows, -1)
        found = best(matrix(queries), queries.column("vec_id").to_numpy(), matrix(members), members.column("vec_id").to_numpy(), k)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=names)

    keys = ["band", "table", "bucket", "part"]
    scored = probes.groupBy(keys).cogroup(rows.groupBy(keys)).applyInArrow(score, "query_id long, vec_id long, score double")
    merged = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
