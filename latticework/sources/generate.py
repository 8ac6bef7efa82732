"""Generators of points, boxes and lattices; each is a plan over ``spark.range``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked


def uniform_points(spark: SparkSession, n: int, dims: int, low: float, high: float, seed: int = 1, digits: int = 5) -> DataFrame:
    """(id, x0 ..): n points, rounded; repeats are left in, see ``distinct_uniform``."""
    return spark.range(n).select("id", *[F.bround(F.rand(seed + i) * (high - low) + low, digits).alias(f"x{i}") for i in range(dims)])


def zipf_points(spark: SparkSession, n: int, dims: int, a: float, most: float, seed: int = 1) -> DataFrame:
    """(id, x0 ..): coordinates of a Pareto law of exponent ``a`` cut at ``most``, rounded down, by inverse distribution."""
    reach = 1.0 - most ** (1.0 - a)
    draw = [F.floor((1 - F.rand(seed + i) * reach) ** (1.0 / (1.0 - a))).cast("double").alias(f"x{i}") for i in range(dims)]
    return spark.range(n).select("id", *draw)


def hash_threshold(df: DataFrame, u: str, n: int) -> tuple[int, int]:
    """(t, below): the n-th smallest of the long column ``u`` (1 <= n <= rows), and the number of rows below it.

    Rows are counted by 16 bits, then those of one count by the next 16 bits, until the value is told: up to four passes over the column,
    which hashes narrow by 65,536 each, and as many numbers to the driver. Nothing is sorted.
    """
    low, below = -(1 << 63), 0
    for shift in (48, 32, 16, 0):
        near = df.filter(F.col(u).between(low, low + (1 << (shift + 16)) - 1)) if shift < 48 else df
        for r in sorted(near.groupBy(F.shiftright(u, shift).alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["b"]):
            if below + r["n"] >= n:
                low = r["b"] << shift
                break
            below += r["n"]
    return low, below


def cut(df: DataFrame, n: int, keys: list[str], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(exactly n rows, the others), all rows if there are fewer: those of least hash of ``keys``, so that reruns agree if keys are unique.

    Of rows that share the last hash as many are taken as are missing.
    """
    u = df.withColumn("__u", F.xxhash64(*keys, F.lit(seed)))
    total = df.count()
    if n <= 0 or n >= total:
        none, every = df.filter(F.lit(False)), df
        return (every, none) if n > 0 else (none, every)
    t, below = hash_threshold(u, "__u", n)
    ties = ranked(u.filter(F.col("__u") == t).withColumn("__tie", F.monotonically_increasing_id()), [*keys, "__tie"], "__nth")
    pick = lambda left, right: left.select(*df.columns).unionByName(right.select(*df.columns))
    return pick(u.filter(F.col("__u") < t), ties.filter(F.col("__nth") < n - below)), pick(u.filter(F.col("__u") > t), ties.filter(F.col("__nth") >= n - below))


def _distinct(draw, n: int, names: list[str]) -> DataFrame:
    """n different points: ``draw(count)`` is asked for more until it gives enough, or no new ones; too few are an error."""
    drawn, before = n + n // 100 + 1, -1
    while True:
        found = draw(drawn).select(*names).distinct()
        have = found.count()
        if have >= n:
            return cut(found, n, names)[0]
        if have == before or drawn > 1024 * n:
            raise ValueError(f"{n} different points were asked for, and {drawn} draws gave {have}")
        drawn, before = 2 * drawn, have


def distinct_zipf(spark: SparkSession, n: int, dims: int, a: float, most: float, seed: int = 1) -> DataFrame:
    """(x0 ..): n different points of the law of ``zipf_points``; an error if it hardly has so many."""
    return _distinct(lambda k: zipf_points(spark, k, dims, a, most, seed), n, [f"x{i}" for i in range(dims)])


def distinct_uniform(spark: SparkSession, n: int, dims: int, low: float, high: float, seed: int = 1, digits: int = 5) -> DataFrame:
    """(x0 ..): exactly n different rounded points: drawn with some to spare, rounded, and cut to size after repeats are gone."""
    return _distinct(lambda k: uniform_points(spark, k, dims, low, high, seed, digits), n, [f"x{i}" for i in range(dims)])


def image_feature(image: Column) -> Column:
    """The 324 values of a 450 x 600 image, array<array<array>> of rows, columns and channels: three channels of every 50th row and column from the 25th."""
    rows, columns = F.sequence(F.lit(25), F.lit(449), F.lit(50)), F.sequence(F.lit(25), F.lit(599), F.lit(50))
    return F.flatten(F.transform(rows, lambda h: F.flatten(F.transform(columns, lambda w: F.slice(F.get(F.get(image, h), w), 1, 3)))))


def mirrored_pixels(features: DataFrame, column: str = "feature") -> DataFrame:
    """(x0 .. x5), distinct: each pixel of a feature's first half with the pixel as far from its end, three channels each."""
    half = F.explode(F.sequence(F.lit(0), F.expr(f"CAST(size({column}) / 6 AS INT) - 1"))).alias("j")
    pairs = features.select(F.col(column).alias("f"), half)
    near = [F.get("f", F.col("j") * 3 + i).alias(f"x{i}") for i in range(3)]
    far = [F.get("f", F.size("f") - (F.col("j") + 1) * 3 + i).alias(f"x{i + 3}") for i in range(3)]
    return pairs.select(*near, *far).distinct()


def spread_pixels(pixels: DataFrame, seed: int = 1) -> DataFrame:
    """Six coordinates of ``mirrored_pixels`` with noise from 0 to 1, scaled from 0 .. 257 to 0 .. 1000 and moved off 0."""
    return pixels.select(*[((F.col(f"x{i}") + F.rand(seed + i)) / 257.0 * 1000.0 + 0.001).alias(f"x{i}") for i in range(6)])


def boxes(spark: SparkSession, n: int, dims: int, start: tuple[float, float], extent: tuple[float, float], most: float, seed: int = 1) -> DataFrame:
    """(qid, lo, hi): lows uniform in ``start``, extents uniform in ``extent``, highs cut at ``most``."""
    lows = spark.range(n).select(F.col("id").cast("int").alias("qid"), F.array(*[F.rand(seed + i) * (start[1] - start[0]) + start[0] for i in range(dims)]).alias("lo"), F.array(*[F.rand(seed + 100 + i) * (extent[1] - extent[0]) + extent[0] for i in range(dims)]).alias("__e"))
    return lows.select("qid", "lo", F.zip_with("lo", "__e", lambda a, b: F.greatest(F.lit(start[0]), F.least(F.lit(most), a + b))).alias("hi"))


def product(frames: list[DataFrame]) -> DataFrame:
    """Rows of all combinations of small one-column tables, as asked for."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out


def splits(points: DataFrame, id_col: str, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(initial half, insert half, a half of all to delete), of exact sizes (the first and the third round down), by hashes of ids, so that reruns agree."""
    n = points.count()
    first, second = cut(points, n // 2, [id_col], seed)
    return first, second, cut(points, n // 2, [id_col], seed + 1)[0]
