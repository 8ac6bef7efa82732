"""Packing documents into sequences by minimum bin slack.

Only the lengths matter, and there are at most ``capacity`` of them, so the search runs over the counts by length, whose
size does not grow with the data. For a bin, the longest length left is fixed, a subset-sum dynamic program over bitsets
finds the fullest combination with the lengths available, and the combination is removed: while all its lengths are in large
supply for a part of what the counts allow at once, then bin by bin. A little more slack than the least may be allowed for.
Rows then find their place by their rank among the rows of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 1024
END_ID = 2
#: Parts of texts whose ids a Python worker keeps.
KEPT_PARTS = 400_000
PIECES = "piece int, start long, length long, ids_crc32 long"


#: A combination is taken at once for this part of the bins that its scarcest length allows, so that the lengths left stay mixed.
SHARE = 2
#: Tokens beyond the least slack that a bin may lose in favour of longer documents, which are harder to place later: each is tried.
SLACKS = (0, 8, 16)


def fullest(counts: dict[int, int], room: int, slack: int = 0) -> dict[int, int]:
    """A multiset of available lengths whose sum is the largest one within ``room``, or up to ``slack`` less than that; of these, the
    one of the longest lengths.

    ``reach`` after each length, from the shortest up, is the set of sums as bits of one integer. Going back, all sums that
    are still good enough are kept, as bits too.
    """
    lengths = sorted(x for x, n in counts.items() if n and x <= room)
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for x in lengths:
        steps.append(reach)
        left, copies = min(counts[x], room // x), 1
        while left:
            took = min(copies, left)
            reach |= (reach << (x * took)) & mask
            left, copies = left - took, copies * 2
    least = max(0, reach.bit_length() - 1 - slack)
    good, out = reach >> least << least, {}
    for x, before in zip(reversed(lengths), reversed(steps)):
        n = min(counts[x], (good.bit_length() - 1) // x)
        while not (good >> (n * x)) & before:
            n -= 1
        good = (good >> (n * x)) & before
        if n:
            out[x] = n
    return out


def patterns(counts: dict[int, int], capacity: int = CAPACITY, slack: int = 0) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, their lengths) until nothing is left. The search's steps grow with the logarithm of the counts."""
    left, out = {x: n for x, n in counts.items() if n > 0}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        found = fullest(left, capacity - seed, slack)
        left[seed] += 1
        found[seed] = found.get(seed, 0) + 1
        times = max(1, min(left[x] // n for x, n in found.items()) // SHARE)
        out.append((times, found))
        for x, n in found.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def fewest(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """The patterns of fewest bins over ``SLACKS``; ends early where no packing could need fewer."""
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    best: list[tuple[int, dict[int, int]]] = []
    bins = -1
    for slack in SLACKS:
        found = patterns(counts, capacity, slack)
        now = sum(times for times, _ in found)
        if bins < 0 or now < bins:
            best, bins = found, now
        if bins == bound:
            break
    return best


def placement(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, copies in a bin, offset of the first copy) for runs of ranks of a length."""
    bins, used, out = 0, dict.fromkeys(counts, 0), []
    for times, found in fewest(counts, capacity):
        at = 0
        for x, n in sorted(found.items(), reverse=True):
            out.append((x, used[x], used[x] + n * times, bins, n, at))
            used[x] += n * times
            at += n * x
        bins += times
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each row's ids with the end id, longer ones cut so that only the first piece is short.

    Null and empty texts are one piece of the end id. Repeated rows each give their pieces; null doc_ids are kept; an empty table gives
    an empty result; other columns are ignored.
    """
    common.bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = tokens.encoder(path, KEPT_PARTS), END_ID.to_bytes(4, "little")
        for batch in common.text_batches(batches, 1024):
            ids, rows = batch.column("doc_id"), []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = enc.encode(text) + end
                n = len(data) // 4
                at, size, piece = 0, n % capacity or capacity, 0
                while at < n:
                    rows.append((i, piece, at, size, zlib.crc32(data[at * 4 : (at + size) * 4])))
                    at, size, piece = at + size, capacity, piece + 1
            col = list(zip(*rows))
            if rows:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(col[0])), pa.array(col[1], pa.int32()), *(pa.array(c, pa.int64()) for c in col[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32); their lengths are 1 to ``capacity``.

    Repeated rows are pieces of their own. An empty table gives an empty result. The counts by length and the placement
    table, at most a few runs for each length, are the only things that reach the driver. A length may hold a third of the
    rows: its ranks come from two-level running counts, never from one task.
    """
    spark = cut.sparkSession
    bits = common.bucket_bits(cut.count())
    dealt = cut.withColumn("__h", F.xxhash64("doc_id", "piece", "start", "ids_crc32")).withColumn("__b", F.shiftright("__h", 64 - bits)).withColumn("__one", F.lit(1))
    totals = dealt.groupBy("length", "__b").agg(F.count("*").alias("total"))
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("total").alias("n")).collect()}
    runs = placement(counts, capacity)
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], "length long, lo long, hi long, bin long, copies long, at long")
    ranked = common.running_total(dealt, "length", "__b", ["__h", "doc_id", "piece", "start", "ids_crc32"], "__one", "__rank", totals)
    # the runs of a length in one row: the join adds no rows; a table of at most ``capacity`` rows
    by_length = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "bin", "copies", "at"))).alias("__runs"))
    joined = ranked.join(F.broadcast(by_length), "length")
    mine = F.expr("filter(__runs, r -> r.lo <= __rank AND __rank < r.hi)[0]")
    return (
        joined.withColumn("__run", mine)
        .withColumn("__nth", F.col("__rank") - F.col("__run.lo"))
        .withColumn("sequence_id", F.col("__run.bin") + F.expr("__nth div __run.copies"))
        .withColumn("offset", F.col("__run.at") + F.expr("__nth % __run.copies") * F.col("length"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    )


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their places. Null texts count as empty: one piece that holds the end id alone."""
    cut = pieces(docs, path or tokens.path_of("byte_bpe_50k.json"), capacity)
    return pack(common.written(cut, "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
