"""Near-duplicate detection by BagMinHash signatures of word-shingle multisets.

A shingle of weight w owns the range (0, w] of a weight axis. On each of the axis's dyadic intervals (0, 1], (1, 2], (2, 4],
(4, 8], ... a Poisson process, seeded by shingle and interval, lays a point in time; then the interval splits: the point
belongs to one half, the other half gets a process of its own, down to units. A point that the weight covers updates one
component of the signature with its time. Components are minima, so two signatures agree in one with a
probability equal to the weighted Jaccard similarity. Points come in rising time and stop at the largest component, which
leaves a few points a shingle. Signatures are banded; members of a band's bucket are verified by exact overlap of their multisets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
COMPONENTS = BANDS * ROWS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers by shifts and odd multipliers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def uniform(state: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper 53 bits."""
    return ((state >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and the offsets of the texts. Words are lower case, cut at ASCII white space."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    coded = pc.dictionary_encode(lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()))
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return own[coded.indices.to_numpy()] if len(own) else np.empty(0, np.uint64), offsets - offsets[0]


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text row, shingle hash, count), sorted by row and hash. A text of fewer words has one shingle, all of it; one without words has none."""
    hashes, offsets = word_hashes(texts)
    n = np.diff(offsets)
    # the split of an empty text is one empty word
    empty = np.array([not t for t in pc.ascii_trim_whitespace(pc.fill_null(texts, "")).to_pylist()], bool)
    count = np.where(empty, 0, np.maximum(1, n - words + 1))
    row = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    last = np.repeat(offsets[1:], count)
    out = np.zeros(len(row), np.uint64)
    for k in range(words):
        at = place + k
        inside = at < last
        h = np.where(inside, hashes[np.minimum(at, max(0, len(hashes) - 1))] if len(hashes) else 0, np.uint64(0))
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(k + 1))
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (out[1:] != out[:-1])
    first = np.flatnonzero(new)
    return row[first], out[first], np.diff(np.append(first, len(row)))


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, size: int = COMPONENTS) -> np.ndarray:
    """BagMinHash signatures (texts, size) of weighted shingles; infinite in rows without any."""
    sig = np.full(texts * size, np.inf)
    # top intervals (0, 1] and (2^(j-1), 2^j] that the weights reach
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    item = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    high = 1 << level
    owner, most = row[item], weight[item]
    state = mixed(shingle[item] + (low.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F) + high.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    time = np.zeros(len(item))
    part = np.zeros(len(item), np.int64)  # the component that the current point updates
    fresh = np.ones(len(item), bool)  # whose next point is still to be drawn
    told = np.zeros(len(item), bool)  # whose point has been counted higher up
    limit = np.full(texts, np.inf)
    while len(owner):
        drawn = mixed(state + np.uint64(0x9E3779B97F4A7C15))
        state = np.where(fresh, drawn, state)
        time = np.where(fresh, time - np.log(uniform(drawn)) / ((high - low) * float(size)), time)
        part = np.where(fresh, (mixed(drawn ^ np.uint64(0x589965CC75374CC3)) % np.uint64(size)).astype(np.int64), part)
        live = time <= limit[owner]
        owner, most, low, high, state, time, part, told = (x[live] for x in (owner, most, low, high, state, time, part, told))
        counts = (high <= most) & ~told
        np.minimum.at(sig, owner[counts] * size + part[counts], time[counts])
        limit = sig.reshape(texts, size).max(axis=1) if texts else limit
        # an interval of one unit draws its next point; a wider one has had its only point and splits: the point goes to
        # one half, the other half draws its own from this time on. This holds whatever the weight, so all texts agree.
        wide = high - low > 1
        fresh = np.ones(len(owner), bool)
        told = np.zeros(len(owner), bool)
        if wide.any():
            o, m, a, e, s, t, c = (x[wide] for x in (owner, most, low, high, state, time, part))
            known, half = e <= m, (a + e) >> 1
            right = (mixed(s ^ np.uint64(0x1D8E4E27C47D124F)) >> np.uint64(63)).astype(bool)
            in_reach = half < m  # else the right half is beyond the weight
            unit = ~wide

            def joined(x, left, other):
                return np.concatenate([x[unit], left, other[in_reach]])

            state = joined(state, mixed(s + np.uint64(0x8EBC6AF09C88C6E3)), mixed(s + np.uint64(0xC2B2AE3D27D4EB4F)))
            low, high = joined(low, a, half), joined(high, half, e)
            owner, most, time, part = joined(owner, o, o), joined(most, m, m), joined(time, t, t), joined(part, c, c)
            fresh = joined(fresh, right, ~right)
            told = joined(told, known & ~right, known & right)
    return sig.reshape(texts, size)


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash (texts, bands) of each band's components."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.zeros((len(sig), bands), np.uint64)
    for i in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return mixed(out + np.arange(1, bands + 1, dtype=np.uint64))


def overlap(a: pa.Array, b: pa.Array, words: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of two equally long arrays, exactly; 1 if both have no word."""
    n = len(a)
    row, shingle, count = shingles(pa.concat_arrays([a, b]), words)
    side, row = row >= n, row % max(n, 1)
    order = np.lexsort((shingle, row))
    row, shingle, count, side = row[order], shingle[order], count[order], side[order]
    same = np.flatnonzero((row[1:] == row[:-1]) & (shingle[1:] == shingle[:-1]))
    shared = np.bincount(row[same], np.minimum(count[same], count[same + 1]), n)
    both = np.bincount(row, count, n)
    union = both - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b, similar) for pairs (a, b) of ids. Each side's text joins once; hot ids are split by AQE's skew join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in common.text_batches(batches, 128):
            near = overlap(batch.column("left"), batch.column("right"), words) >= similarity - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], ["a", "b", "similar"])

    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("left")), texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long, similar boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that links (a, b) reach, for the ids that have links; alternates large and small stars.

    Each round moves every link's larger end towards the smallest neighbour; stars stay linear in the links.
    """
    edges, old = common.written_at(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        # large star: larger neighbours are linked to the smallest one
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        # small star: smaller neighbours and the node itself are linked to the smallest one
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        edges, path = common.written_at(small, "links")
        common.discard(links.sparkSession, old)  # the round before is in no plan any more
        old = path
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key (checksum of the text) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("key"), F.col("text").cast("string").alias("text"))


def sketched(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key, buckets (a hash for each band; null without words) of each row: one pass over the texts, which do not move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in common.text_batches(batches, 256):
            row, shingle, weight = shingles(batch.column("text"), words)
            sig = signatures(row, shingle, weight, batch.num_rows, bands * rows)
            keys = bands_of(sig, bands, rows).view(np.int64).reshape(-1)
            offsets = pa.array(np.arange(0, len(keys) + 1, bands), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys))
            lists = pc.if_else(pa.array(np.isfinite(sig[:, 0])), lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), lists], ["doc_id", "key", "buckets"])

    return keyed(docs).mapInArrow(run, "doc_id long, key string, buckets array<long>")


#: Rounds in which each text of a bucket is compared with one leader, before all pairs across classes that are left.
STAR_ROUNDS = 2
#: Buckets of at most so many texts make rows of their pairs; larger ones are compared block by block inside tasks. Classes are the same.
FEW = 16
#: Tasks that the texts of a large bucket are dealt over while their blocks are numbered.
SPREAD = 32
#: Texts, and bytes of text, of a block.
BLOCK_TEXTS = 1024
BLOCK_BYTES = 8_000_000
#: Shingles of a slice of the blocks' incidence matrices.
SLICE = 4096


def shared_counts(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, texts) sizes of multiset intersections, and the multisets' sizes, by products of slices of incidence matrices.

    A shingle that occurs n times counts as n shingles, (shingle, 1) to (shingle, n). Shingles of a single text are left out.
    """
    n = len(texts)
    row, shingle, count = shingles(texts, words)
    sizes = np.bincount(row, count, n)
    item = np.repeat(np.arange(len(row)), count)
    nth = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    key = mixed(shingle[item] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, column, often = np.unique(key, return_inverse=True, return_counts=True)
    keep = often[column] > 1
    new = np.cumsum(often > 1) - 1
    column, owner = new[column[keep]], row[item[keep]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n))
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, SLICE):
        a, b = np.searchsorted(column, (at, at + SLICE))
        part = np.zeros((n, SLICE), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out, sizes


def spanning(ids: np.ndarray, roots: np.ndarray, texts: pa.Array, words: int, similarity: float) -> list[tuple[int, int]]:
    """Links between similar texts of different classes, just enough to connect the classes that any such links connect."""
    shared, sizes = shared_counts(texts, words)
    _, at = np.unique(roots, return_inverse=True)
    union = np.maximum(sizes[:, None] + sizes[None, :] - shared, 1)
    # slices are exact in single precision, sums in double: the same test as that of single pairs
    near = (shared / union >= similarity - 1e-12) & (sizes[:, None] + sizes[None, :] > 0) & (at[:, None] < at[None, :])
    lead = list(range(int(at.max(initial=-1)) + 1))

    def top(x: int) -> int:
        while lead[x] != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    out = []
    for i, row in enumerate(near):
        for j in np.flatnonzero(row).tolist():
            a, b = top(int(at[i])), top(int(at[j]))
            if a != b:
                lead[max(a, b)] = min(a, b)
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def dealt_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(bucket, id, root, lo, hi): a row for each pair of blocks of its bucket that a text belongs to, from (bucket, id, root).

    The texts of a bucket's largest class, its main ones, have no need of each other. So the others are cut into blocks that all meet,
    and the main ones into blocks that meet those of the others: a bucket of N texts of which few are others sends O(N) rows.
    """
    counts = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mains = counts.groupBy("bucket").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"))
    # a bucket may hold a third of all texts: its rows are dealt by a hash beside the bucket
    salt = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SPREAD)).cast("int")
    salted = members.withColumn("salt", salt)
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    sided = salted.join(spread(mains), ["bucket", "salt"]).withColumn("odd", F.col("root") != F.col("main"))
    sized = sided.select("bucket", "id", "odd").join(texts.select("id", common.utf8_size("text").alias("bytes")), "id")
    blocks = lambda own: F.ceil(F.greatest(F.count_if(own) / BLOCK_TEXTS, F.sum(F.when(own, F.col("bytes")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    plan = sized.groupBy("bucket").agg(F.greatest(blocks(F.col("odd")), F.lit(1)).alias("odds"), F.greatest(blocks(~F.col("odd")), F.lit(1)).alias("rest"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("odd"), F.col("odds")).otherwise(F.col("rest"))).cast("int")
    numbered = sided.join(spread(plan), ["bucket", "salt"]).withColumn("mine", F.when(F.col("odd"), own).otherwise(F.col("odds") + own))
    # blocks of others are numbered first; each meets all blocks, a main one only those
    meets = F.sequence(F.lit(0), F.when(F.col("odd"), F.col("odds") + F.col("rest")).otherwise(F.col("odds")) - 1)
    paired = numbered.withColumn("other", F.explode(meets))
    return paired.select("bucket", "id", "root", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))


def block_links(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) across classes in large buckets, from (bucket, id, root): a task compares two blocks of a bucket, whose sizes are bounded."""
    rows = dealt_blocks(members, texts).join(texts, "id")

    def run(table: pa.Table) -> pa.Table:
        found = spanning(table.column("id").to_numpy(), table.column("root").to_numpy(), table.column("text").combine_chunks(), words, similarity)
        return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return rows.groupBy("bucket", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def linked(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id, root): the class of each text that is linked, by way of similar texts, to another one that shares a bucket with it.

    ``members``: (bucket, id). In a bucket each text is compared with a leader, another one each round, as long as the two are in
    different classes. What then shares a bucket and is still in different classes is compared in full, but for pairs that were:
    in small buckets as rows, in large ones block by block, where a task returns only links that connect classes.
    So the links connect all that similar pairs in common buckets connect, and no group makes rows for all its pairs.
    """
    spark = members.sparkSession
    often = max(2.0, members.count() / FREQUENT)
    links = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "id long, root long")
    done = spark.createDataFrame([], "a long, b long")
    for turn in range(STAR_ROUNDS + 1):
        now = members.join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
        order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        leads = now.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(order.alias("o"), "id", "root")).alias("lead")).filter("lo <> hi")
        leads, found = common.written(leads, "leads"), None
        if turn < STAR_ROUNDS:
            met = by_bucket(now, leads, often).filter("root <> lead.root").select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"))
        else:
            still = common.written(by_bucket(now, leads.select("bucket", "n"), often), "open")
            few, many = still.filter(F.col("n") <= FEW), still.filter(F.col("n") > FEW)
            other = few.select("bucket", F.col("id").alias("b"), F.col("root").alias("root_b"))
            met = few.join(other, "bucket").filter("id < b AND root <> root_b").select(F.col("id").alias("a"), "b")
            found = common.written(block_links(many.select("bucket", "id", "root"), texts, words, similarity), "links-large")
        pairs = written_pairs(met.distinct().join(done, ["a", "b"], "left_anti"))
        checked = common.written(verified(pairs, texts, words, similarity), "pairs-checked")
        done = done.unionByName(checked.select("a", "b"))
        links = links.unionByName(checked.filter("similar").select("a", "b"))
        links = links.unionByName(found) if found is not None else links
        roots = components(links)
    return roots


#: A bucket of at least one in so many (text, bucket) rows is frequent.
FREQUENT = 1000


def by_bucket(rows: DataFrame, found: DataFrame, often: float) -> DataFrame:
    """``rows`` (bucket, id, ...) joined with ``found`` (bucket, n, ...), which has one row a bucket, n counting the bucket's rows.

    Buckets of at least ``often`` rows are broadcast and their rows are dealt by id in the other buckets' join; with a ``FREQUENT``-th
    of all rows for ``often`` there are no more than ``FREQUENT`` of them, however many rows they hold.
    """
    told = [c for c in found.columns if c != "bucket"]
    whole = F.struct(*told)
    hot = found.filter(F.col("n") >= often).select("bucket", whole.alias("__hot"))
    cold = found.filter(F.col("n") < often).select(F.col("bucket").alias("__key"), whole.alias("__cold"))
    key = F.when(F.col("__hot").isNull(), F.col("bucket")).otherwise(F.xxhash64("id"))
    joined = rows.join(F.broadcast(hot), "bucket", "left").withColumn("__key", key).join(cold, "__key", "left").withColumn("__of", F.coalesce("__hot", "__cold"))
    return joined.filter("__of IS NOT NULL").select(*[F.col(c) for c in rows.columns], *[F.col("__of")[c].alias(c) for c in told])


def written_pairs(pairs: DataFrame) -> DataFrame:
    return common.written(pairs, "pairs")


def classes(docs: DataFrame, words: int, similarity: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key, row) and, for each key, (key, text_id, class_id, n_texts, class_row)."""
    common.bounded_batches(docs.sparkSession)
    rows_in = common.written(sketched(docs, words, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    heads = common.written(
        rows_in.groupBy("key")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.first("buckets", True).alias("buckets"))
        .select("key", "first", "buckets", F.monotonically_increasing_id().alias("id")),
        "texts",
    )
    spread = heads.select("id", F.explode("buckets").alias("bucket"))
    counts = common.written(spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    # rows of buckets that are shared: at least those that the frequent ones hold
    shared = counts.agg(F.sum("n")).first()[0] or 0
    members = common.written(by_bucket(spread, counts, max(2.0, shared / FREQUENT)).select("id", "bucket"), "members")
    wanted = members.select("id").distinct().join(heads, "id").select("id", "key", F.coalesce("first.doc_id", F.lit(-(2**63))).alias("own"))
    # the doc_id in the join deals out the rows of one text that has many copies
    texts = common.written(keyed(docs).select("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("own"), "text").join(wanted, ["key", "own"]).select("id", "text").dropDuplicates(["id"]), "near-texts")
    roots = linked(members, texts, words, similarity)
    every = heads.select("id", "key", "first").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = every.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("n_texts"))
    return rows_in, every.join(least, "root").select("key", F.col("first.doc_id").alias("text_id"), F.col("head.doc_id").alias("class_id"), "n_texts", F.col("head.row").alias("class_row"))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, class_id, text_id, n_texts, kept.

    ``text_id`` is the smallest doc_id of the rows with exactly this text, ``class_id`` the smallest doc_id of the class: texts
    that links connect, where a link is a pair in some common bucket whose multisets of word shingles have a weighted Jaccard
    similarity of at least ``similarity``. ``n_texts`` counts the different texts of the class. ``kept`` marks one row a class.
    A bucket's size decides how its pairs are compared, not which.

    Exact copies are grouped first, so a group of copies counts as one text. Null texts are copies of each other. Texts without words
    have no shingle and only exact copies; texts of fewer than five words have one shingle. Null doc_ids stand behind others;
    a class of null ids alone has a null class_id. Repeated rows are copies, one of which may be kept. An empty table gives an
    empty result. Other columns are ignored.
    """
    rows_in, found = classes(docs, words, similarity, bands, rows)
    # a row a text; AQE splits the partition of a text with many copies
    return rows_in.select("doc_id", "key", "row").join(found, "key").select("doc_id", "class_id", "text_id", "n_texts", (F.col("row") == F.col("class_row")).alias("kept"))


def deduplicated(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one row a class, all columns kept; see ``near_duplicates``."""
    rows_in, found = classes(docs, words, similarity, bands, rows)
    none = F.lit(-(2**63))
    kept = rows_in.join(found.select("class_row"), F.col("row") == F.col("class_row"), "left_semi").select("key", F.coalesce("doc_id", none).alias("own"))
    # the row as one column, so that no name of its own can clash
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("key"), F.coalesce(F.col("doc_id").cast("long"), none).alias("own"))
    # repeated rows of a kept document are one
    return own.join(kept, ["key", "own"], "left_semi").dropDuplicates(["key", "own"]).select("all.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
