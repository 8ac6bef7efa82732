"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, 2, 4, ... segments; each keeps its mean m and deviation s. For a segment of length l the
distance of two vectors is at least sqrt(l * ((m1 - m2)^2 + (s1 - s2)^2)), and so their inner product is at most
l * (m1 * m2 + s1 * s2). Bounds from coarse to fine discard candidates below the k-th best exact score that the query is
known to have, first among the longest vectors, then in the blocks it has met; survivors are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
QUERY_BLOCK = 512
#: Components of the candidates, and of the queries, that a task holds: 32 MB and 8 MB.
CANDIDATE_LANE, QUERY_LANE = 1 << 22, 1 << 20
LEVELS = (1, 2, 4, 8, 16)
BLOCK_SCHEMA = "block long, n int, ids binary, vectors binary"
#: Below this, products summed over any usual dimension are exact in double precision.
EXACT = 2**20


def quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part (not null, no null or non-finite component), and their vectors floor(scale * x) as integers."""
    rows, vectors = [], []
    values = column.values.cast(pa.float64()) if column.values.null_count else None
    flat = (values.to_numpy(zero_copy_only=False) if values is not None else column.values.to_numpy(zero_copy_only=False)).astype(np.float64)
    starts, good = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(good):
        x = flat[starts[i] : starts[i + 1]]
        if np.isfinite(x).all():
            rows.append(i)
            vectors.append(np.floor(x * scale))
    return np.array(rows, dtype=np.int64), vectors


def packer(scale: int, size: int, dim: int, keep: int):
    """Packs rows into blocks of at most ``size``: one row a block, ids and vectors as bytes. ``keep``: only ids divisible by it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        vectors: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            nonlocal made
            matrix = np.zeros((len(ids), dim))
            for row, x in zip(matrix, vectors):
                row[: len(x)] = x
            block = (task << 24) + made
            made += 1
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "vectors": pa.array([matrix.tobytes()], pa.binary())})

        for batch in batches:
            kept, found = quantised(batch.column("embedding"), scale)
            own = batch.column("vec_id").to_pylist()
            for i, x in zip(kept.tolist(), found):
                if own[i] is not None and own[i] % keep == 0:
                    ids.append(own[i])
                    vectors.append(x)
                    if len(ids) == size:
                        yield out()
                        ids.clear(), vectors.clear()
        if ids:
            yield out()

    return pack


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of ``segments`` segments, scaled so that a product of two rows bounds their inner product."""
    parts = np.array_split(x, segments, axis=1)
    root = [np.sqrt(p.shape[1]) for p in parts]
    return np.concatenate([np.stack([p.mean(axis=1) * r for p, r in zip(parts, root)], 1), np.stack([p.std(axis=1) * r for p, r in zip(parts, root)], 1)], 1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products of two equally long matrices."""
    if q.size and max(np.abs(q).max(), np.abs(x).max()) >= EXACT:
        products = [sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(q, x)]
        return np.array([min(max(p, -(2**63)), 2**63 - 1) for p in products], dtype=np.int64)
    return np.einsum("ij,ij->i", q, x).astype(np.int64)


def search_block(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block for each query: (query row, vec_id, score), own id left out, ties to smaller ids.

    ``floors``: scores that k candidates of each query reach anyway; nothing below them is returned. They rise to what the
    block shows.
    """
    levels = [s for s in LEVELS if s <= x.shape[1]] or [1]
    stats = [(statistics(q, s), statistics(x, s)) for s in levels]
    slack = 1e-9 * np.linalg.norm(q, axis=1) * (np.linalg.norm(x, axis=1).max(initial=0) + 1) + 1e-6
    out_q, out_id, out_score = [], [], []
    coarse = stats[0][0] @ stats[0][1].T
    seeds = stats[min(2, len(stats) - 1)]
    for i in range(len(q)):
        bound = coarse[i]
        # seeds: the best by a middle level give a k-th score that holds for the block
        guess = seeds[1] @ seeds[0][i]
        take = min(len(x), 4 * k + 1)
        first = np.argpartition(-guess, take - 1)[:take]
        own = x_ids[first] != q_ids[i]
        scores = np.sort(exact(np.broadcast_to(q[i], (own.sum(), q.shape[1])), x[first[own]]))
        floor = scores[-k] if len(scores) >= k else -np.inf
        if floors is not None:
            floor = floors[i] = max(floor, floors[i])
        left = np.flatnonzero(bound + slack[i] >= floor)
        for own_q, own_x in stats[1:]:
            left = left[own_x[left] @ own_q[i] + slack[i] >= floor]
        left = left[x_ids[left] != q_ids[i]]
        scores = exact(np.broadcast_to(q[i], (len(left), q.shape[1])), x[left])
        if floors is not None:
            left, scores = left[scores >= floor], scores[scores >= floor]
        best = np.lexsort((x_ids[left], -scores))[:k]
        out_q.append(np.full(len(best), i))
        out_id.append(x_ids[left[best]])
        out_score.append(scores[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)


def floors_of(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k-th best exact score of each query among these candidates; minus infinity if there are fewer."""
    out = np.full(len(q), -np.inf)
    if len(x):
        row, _, scores = search_block(q_ids, q, x_ids, x, k)
        n = np.bincount(row, minlength=len(q))
        out[n >= k] = scores[(np.cumsum(n) - 1)[n >= k]]
    return out


def floored(shared, dim: int, k: int):
    """Packed query blocks with ``floors``, from the candidates that every task has: once for a query, before blocks are copied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_ids, top = np.frombuffer(shared.value[0], np.int64), np.frombuffer(shared.value[1]).reshape(-1, dim)
        for batch in batches:
            made = [floors_of(ids, q, top_ids, top, k).tobytes() for ids, q in unpacked(batch, dim)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "ids", "vectors")), pa.array(made, pa.binary())], ["block", "ids", "vectors", "floors"])

    return run


def unpacked(table: pa.Table | pa.RecordBatch, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of packed blocks."""
    return [(np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(v.as_buffer()).reshape(-1, dim)) for i, v in zip(table.column("ids"), table.column("vectors"))]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product for every row whose vec_id divides by ``every``.

    Rows are packed into blocks where they lie. Candidates are dealt into rows and queries into columns of a grid of lanes; a
    lane is a task's unit, and its memory is bounded by the lane's sizes, which set the numbers of rows and columns. Only packed
    blocks move. Floors from the ``block`` longest vectors, which every task has, spare most exact scores; a lane returns at most
    k rows a query and block, those that reach the floors, and the last step ranks these.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids. Shorter vectors count as
    padded with zeros. Repeated rows are candidates one by one, but rows of the query's own id are left out. Equal scores
    go to the smaller vec_id. An empty table gives an empty result. Scores beyond 64 bits saturate.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & x.isNotNull())
    wanted = F.col("vec_id") % every == 0
    seen = rows.agg(F.max(F.size(x)).alias("dim"), F.count("*").alias("n"), F.count_if(wanted).alias("q")).first()
    dim = max(1, seen["dim"] or 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, -(-seen["q"] * dim // QUERY_LANE))
    lanes = max(-(-seen["n"] * dim // CANDIDATE_LANE), min(-(-seen["n"] // block), -(-parts // columns)), 1)
    # the longest vectors, a block of them: a sample that makes floors high, not a bound on what is searched
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    longest = rows.filter(finite).orderBy(norm.desc(), "vec_id").limit(block)
    packed = longest.coalesce(1).mapInArrow(packer(scale, block, dim, 1), BLOCK_SCHEMA).toArrow()
    shared = spark.sparkContext.broadcast(([b.tobytes() for b in unpacked(packed, dim)[0]] if packed.num_rows else [b"", b""]))

    def lane_of(seed: int, n: int):
        return F.pmod(F.xxhash64("block", F.lit(seed)), F.lit(n)).cast("int")

    across, down = F.sequence(F.lit(0), F.lit(columns - 1)), F.sequence(F.lit(0), F.lit(lanes - 1))
    candidates = rows.mapInArrow(packer(scale, block, dim, 1), BLOCK_SCHEMA).select(lane_of(1, lanes).alias("lane"), F.explode(across).alias("column"), "ids", "vectors")
    asking = rows.filter(wanted).mapInArrow(packer(scale, query_block, dim, every), BLOCK_SCHEMA).mapInArrow(floored(shared, dim, k), "block long, ids binary, vectors binary, floors binary")
    queries = asking.select(F.explode(down).alias("lane"), lane_of(2, columns).alias("column"), "ids", "vectors", "floors")

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        blocks = unpacked(held, dim)
        known = [np.frombuffer(f.as_buffer()) for f in asked.column("floors")]
        for q_ids, q, floors in merged(unpacked(asked, dim), known, query_block) if blocks else ():
            for ids, own in blocks:
                row, found, scores = search_block(q_ids, q, ids, own, k, floors)
                for o, v in zip(out, (q_ids[row], found, scores)):
                    o.append(v)
        return pa.table([pa.array(np.concatenate(o), pa.int64()) for o in out], names=["query_id", "vec_id", "score"])

    found = queries.groupBy("lane", "column").cogroup(candidates.groupBy("lane", "column")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merged(blocks: list[tuple[np.ndarray, np.ndarray]], floors: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of small blocks, with their floors, in blocks of ``size``."""
    if blocks:
        ids, x, known = np.concatenate([i for i, _ in blocks]), np.concatenate([v for _, v in blocks]), np.concatenate(floors)
        for at in range(0, len(ids), size):
            yield ids[at : at + size], x[at : at + size], known[at : at + size]


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH good AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM good),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
