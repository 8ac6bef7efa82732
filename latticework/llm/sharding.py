"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to a grid of 2^BITS steps each, cells are numbered along the Hilbert curve, rows are sorted by
that number, and the sorted sequence is cut into runs of equal length. Equal texts share the first number that one of them has,
so they stay together but where a run ends. A shard then covers a compact box in every
dimension, so minimum and maximum statistics prune files for filters on any of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 6
SHARDS = 40
#: A text that makes up one in so many rows is frequent.
FREQUENT = 1000


def hilbert_sql(names: list[str], bits: int, xor=lambda a, b: f"({a} ^ {b})", shift=lambda a, n: f"shiftright({a}, {n})") -> list[tuple[str, str]]:
    """Steps (column, SQL) that turn grid coordinates ``names`` into ``h0, h1, ...``, the curve index's transposed bits.

    Per bit from the top: a coordinate with the bit clear swaps its lower bits with the first one, one with it set
    inverts the first one's lower bits; then the Gray code is undone. Each step reads only columns that stand before it, so
    expressions stay short. The last step is ``hilbert``, the interleaved index.
    """
    steps: list[tuple[str, str]] = []
    now = {i: n for i, n in enumerate(names)}
    made = 0

    def put(sql: str) -> str:
        nonlocal made
        made += 1
        steps.append((f"__h{made}", sql))
        return f"__h{made}"

    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(names)):
            is_set = f"({shift(now[i], bit)} & 1) = 1"
            if i == 0:
                now[0] = put(f"CASE WHEN {is_set} THEN {xor(now[0], str(low))} ELSE {now[0]} END")
                continue
            differ = put(f"CASE WHEN {is_set} THEN {low} ELSE {xor(now[0], now[i])} & {low} END")
            moved = put(f"CASE WHEN {is_set} THEN {now[i]} ELSE {xor(now[i], differ)} END")
            now[0], now[i] = put(xor(now[0], differ)), moved
    for i in range(1, len(names)):
        now[i] = put(xor(now[i], now[i - 1]))
    flips = "0"
    last = now[len(names) - 1]
    for bit in range(bits - 1, 0, -1):
        flips = put(f"CASE WHEN ({shift(last, bit)} & 1) = 1 THEN {xor(flips, str((1 << bit) - 1))} ELSE {flips} END")
    for i in range(len(names)):
        now[i] = put(xor(now[i], flips))
    terms = [f"(({shift(now[i], bit)} & 1) * {1 << (bit * len(names) + len(names) - 1 - i)})" for bit in range(bits) for i in range(len(names))]
    steps.append(("hilbert", " + ".join(terms)))
    return steps


def with_hilbert(df: DataFrame, names: list[str], bits: int = BITS) -> DataFrame:
    """Adds ``hilbert`` (long) for integer columns ``names`` in 0 .. 2^bits - 1."""
    out, extra = df, []
    for name, sql in hilbert_sql([f"CAST({n} AS BIGINT)" for n in names], bits):
        out = out.withColumn(name, F.expr(sql).cast("long"))
        extra.append(name)
    return out.drop(*extra[:-1])


def size_step(size, bits: int = BITS):
    """A size's step on a logarithmic grid, by integer operations: its bit length and its two bits below the top."""
    length = F.length(F.bin(size))
    below = F.expr("CAST(substring(rpad(substring(bin(size), 2), 2, '0'), 1, 2) AS INT)")
    return F.least(F.lit((1 << bits) - 1), (length - 1) * 2 + F.floor(below / 10)).cast("long")


def string_steps(df: DataFrame, column: str, out: str, bits: int = BITS) -> DataFrame:
    """Adds ``out``: the rank of the string among the distinct ones, scaled to the grid; null has rank 0.

    One row a distinct value is ranked, range-sorted; the join back is a broadcast only if Spark finds the table small.
    """
    values = df.groupBy(F.col(column).alias("__value")).agg(F.count("*").alias("__rows"))
    ranked = common.global_rank(values.drop("__rows"), ["__value"], "__rank", "shard-values")
    n = max(1, ranked.count())
    steps = ranked.select(F.coalesce(F.concat(F.lit("s"), "__value"), F.lit("n")).alias("__text"), F.floor(F.col("__rank") * (1 << bits) / n).alias(out))
    return df.withColumn("__text", F.coalesce(F.concat(F.lit("s"), column), F.lit("n"))).join(steps, "__text").drop("__text")


def curved(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` (lang, source, size, ...) with ``hilbert``, each row's own place on the curve over language, source and size."""
    grid = string_steps(string_steps(rows, "lang", "__lang_step", bits), "source", "__source_step", bits).withColumn("__size_step", size_step(F.col("size"), bits))
    return with_hilbert(grid, ["__lang_step", "__source_step", "__size_step"], bits).drop("__lang_step", "__source_step", "__size_step")


def together(curve: DataFrame, rows: int) -> DataFrame:
    """``curve`` (text_key, hilbert, doc_id, ...), of that many rows, with the least hilbert of the rows of equal text_key for all of them.

    Only texts that have several places on the curve are joined. Texts of at least a ``FREQUENT``-th of all rows, of which there cannot be
    more than ``FREQUENT``, are broadcast, and their rows are dealt by their doc_id in the other texts' join.
    """
    ends = curve.groupBy("text_key").agg(F.min("hilbert").alias("low"), F.max("hilbert").alias("high"), F.count("*").alias("n")).filter("low < high")
    often = F.col("n") >= max(2.0, rows / FREQUENT)
    hot = ends.filter(often).select("text_key", F.col("low").alias("__hot"))
    cold = ends.filter(~often).select(F.col("text_key").alias("__key"), F.col("low").alias("__low"))
    own = F.when(F.col("__hot").isNotNull(), F.unhex(F.md5(F.concat("text_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))).otherwise(F.col("text_key"))
    marked = curve.join(F.broadcast(hot), "text_key", "left").withColumn("__key", own)
    return marked.join(cold, "__key", "left").withColumn("hilbert", F.coalesce("__hot", "__low", "hilbert")).drop("__key", "__hot", "__low")


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and hilbert for every row of ``docs`` (doc_id, text, lang, source).

    Dimensions: language, source and size. Rows of equal text take the first curve index that one of them has. Rows are ordered by curve index, then the text's
    hash (equal texts stand side by side), then doc_id; row r of n goes to shard floor(r * shards / n), so counts differ by one
    at most: the law is ``rows``. So equal texts lie in one shard, unless a run ends among them.

    Null text: size 16, checksum of the empty text, and equal to it. Null language or source: ranked first. Repeated rows each get a slot. An empty
    table gives an empty result. Other columns are ignored.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", "lang", "source", (common.utf8_size("text") + 16).alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("text_key"))
    kept = common.written(slim, "shard-rows")
    n = max(1, kept.count())
    curve = together(curved(kept, bits), n).select("doc_id", "size", "text_crc32", "text_key", "hilbert")
    ranked = common.global_rank(curve, ["hilbert", "text_key", "doc_id"], "__r", "shard-order")
    return (
        ranked.withColumn("shard", F.expr(f"CAST((__r * {shards}) div {n} AS INT)"))
        .withColumn("slot", F.col("__r") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
