"""SimHash near-duplicates by an inverted index on the bytes of fingerprints and their positions, with a count filter.

Fingerprints that differ in at most 2 of 64 bits differ in at most 2 of 8 bytes, so they share 6 positional bytes or more. Postings of
single bytes would make every pair of a 64th of all pairs a tally, which grows with the square of the table. But of the four pairs
of neighbouring positions such fingerprints share at least two in full: so the index is kept on the four positional bytes of each two
pairs, six postings a fingerprint, and what shares less never meets. In a posting list the shared positional bytes of each two
fingerprints are tallied; those that reach the guaranteed minimum are verified bit by bit. Long lists are cut by two further
positions, of which enough must agree as well: a list of six positions has at most 65,536 different fingerprints, whatever the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .neardup import components

WORDS, SEED, BITS = 3, 42, 2
#: Bytes of a fingerprint, and those that linked ones share at least.
BYTES = 8
SHARED = BYTES - BITS
#: Fingerprints of a list of four positional bytes, at most; longer lists are cut by two more. What is found does not depend on it.
LONG_LIST = 1024
#: Bytes of a text that are cut into words at once, and fingerprints' hashes that are turned into bits at once.
WINDOW = 1 << 20
SLICE = 1 << 16

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def windows(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``WINDOW`` bytes that end at white space."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + WINDOW)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def digests(text: bytes, words: int = WORDS) -> Iterator[bytes]:
    """Big-endian XXH64 hashes of a text's shingles, joined, a window at a time."""
    import xxhash

    last: list[bytes] = []
    some = False
    for piece in windows(text):
        # bytes.lower and bytes.split know ASCII only: A-Z, and the six white space characters
        own = last + piece.lower().split()
        if len(own) >= words:
            some = True
            yield b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*(own[i:] for i in range(words)))), repeat(SEED)))
        last = own[-(words - 1) :] if words > 1 else []
    if last and not some:
        yield xxhash.xxh64_digest(b" ".join(last), SEED)


def fingerprints(texts: list[bytes | None], words: int = WORDS) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text: the bits that are set in over half of its shingles' hashes; 0 without words."""
    ones, count = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owners: list[int] = []
    size = 0

    def tally() -> None:
        nonlocal size
        bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8), axis=1)
        lengths = np.array([len(h) // 8 for h in held])
        starts = np.cumsum(lengths) - lengths
        np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        np.add.at(count, owners, lengths)
        held.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        for part in digests(text, words) if text else ():
            held.append(part)
            owners.append(i)
            size += len(part) // 8
            if size >= SLICE:
                tally()
    if held:
        tally()
    return np.packbits(2 * ones > count[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprinted(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of each row; texts do not move. ``fp`` is the fingerprint as a signed long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in common.text_batches(batches, 256):
            found = fingerprints(batch.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    common.bounded_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def positional(fp: str, places: tuple[int, ...]) -> Column:
    """(which positions, their bytes): the key of a posting."""
    held = [F.shiftrightunsigned(F.col(fp), 8 * (BYTES - 1 - p)).bitwiseAND(F.lit(0xFF)) for p in places]
    value = held[0]
    for h in held[1:]:
        value = F.shiftleft(value, 8).bitwiseOR(h)
    return F.struct(F.lit(sum(1 << p for p in places)).alias("places"), value.alias("bytes"))


PAIRS = tuple((2 * i, 2 * i + 1) for i in range(BYTES // 2))
#: Positions of the postings: each two pairs of neighbouring ones; and for each of these, with two more of the others.
LISTS = tuple(a + b for a, b in combinations(PAIRS, 2))
FINER = {places: tuple(tuple(sorted((*places, *two))) for two in combinations([p for p in range(BYTES) if p not in places], 2)) for places in LISTS}


def tallied(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of linked fingerprints in the same group of the sorted ``group``, just enough to connect all that are linked there."""
    n = len(rows)
    root = np.arange(n)
    links: list[tuple[int, int]] = []
    live = np.flatnonzero(group[1:] == group[:-1]) if n else np.empty(0, np.int64)
    step = 1
    while len(live):
        differ = rows[live] ^ rows[live + step]
        # the upper bit of each byte that differs
        low = np.uint64(0x7F7F7F7F7F7F7F7F)
        marks = (((differ & low) + low) | differ) & ~low
        shared = BYTES - np.bitwise_count(marks)
        at = live[shared >= SHARED]
        at = at[np.bitwise_count(rows[at] ^ rows[at + step]) <= BITS]
        at = at[root[at] != root[at + step]]
        for i in at.tolist():
            a, b = _top(root, i), _top(root, i + step)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, i + step))
        if len(at):
            while (root[root] != root).any():
                root = root[root]
        step += 1
        live = live[live + step < n]
        live = live[group[live] == group[live + step]]
    found = np.array(links, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _top(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        i = int(root[i])
    return i


def posted_links(postings: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints in the same posting list, from (key, fp).

    Lists are dealt out by their keys and come sorted, so a task holds one list, of a bounded length, and what came with it in a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        names = ("places", "bytes", "fp")
        kept = {c: np.empty(0, np.int64) for c in names}

        def linked(places: np.ndarray, held: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.concatenate([[0], (places[1:] != places[:-1]) | (held[1:] != held[:-1])])) if len(fp) else fp
            a, b = tallied(fp.view(np.uint64), group)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[a], fp[b])), pa.array(np.maximum(fp[a], fp[b]))], ["a", "b"])

        for batch in batches:
            kept = {c: np.concatenate([kept[c], batch.column(c).to_numpy().astype(np.int64)]) for c in names}
            # the last list may go on in the next batch
            ends = np.flatnonzero((kept["places"] != kept["places"][-1]) | (kept["bytes"] != kept["bytes"][-1])) if len(kept["fp"]) else []
            if len(ends):
                cut = int(ends[-1]) + 1
                yield linked(*(kept[c][:cut] for c in names))
                kept = {c: kept[c][cut:] for c in names}
        yield linked(*(kept[c] for c in names))

    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = postings.select("key.places", "key.bytes", "fp").repartition(n, "places", "bytes").sortWithinPartitions("places", "bytes", "fp")
    return slim.mapInArrow(run, "a long, b long").distinct()


def links(fps: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """Links (a, b) that connect all different fingerprints (fp) that links of at most ``BITS`` differing bits connect."""
    listed = fps.select("fp", F.explode(F.array(*[positional("fp", p) for p in LISTS])).alias("key"))
    counts = listed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # lists of one are most of them; rows of frequent keys are split by AQE
    shared = common.written(listed.join(counts, "key"), "postings")
    long_ = shared.filter(F.col("n") > long_list)
    finer = None
    for places, more in FINER.items():
        part = long_.filter(F.col("key.places") == sum(1 << p for p in places)).select("fp", F.explode(F.array(*[positional("fp", m) for m in more])).alias("key"))
        finer = part if finer is None else finer.unionByName(part)
    short = shared.filter(F.col("n") <= long_list).select("key", "fp")
    return posted_links(short.unionByName(finer.distinct().select("key", "fp")))


def near_duplicates(docs: DataFrame, words: int = WORDS, long_list: int = LONG_LIST) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row a row of ``docs`` (doc_id, text).

    Words are runs of characters other than ASCII white space, with A-Z in lower case; a shingle is ``words`` of them in a row,
    or all words of a shorter text. A text without words, null ones too, has fingerprint zero, and is linked to others of that
    fingerprint and to those near it. ``component_id`` is the smallest doc_id that links reach; null ids are never the smallest, and
    a component of null ids alone has a null one. Repeated rows and equal texts share a fingerprint, which counts once in the search,
    so a group of copies makes no pairs. An empty table gives an empty result. Other columns are ignored.
    """
    rows = common.written(fingerprinted(docs, words), "fingerprints")
    heads = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("head")), "fingerprints-distinct")
    roots = components(links(heads.select("fp"), long_list))
    placed = heads.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("head").alias("component_id"))
    found = placed.join(least, "root").select("fp", "component_id")
    # a row a fingerprint; AQE splits the rows of a frequent one
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
