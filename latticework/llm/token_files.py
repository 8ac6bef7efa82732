"""Token ids in binary files of patched frame-of-reference blocks.

File: ``LWT2``, then little-endian counts (documents D, ids N, blocks B, exceptions E), the number of the file's range of doc_ids and the
ids of that range in files before this one, as unsigned 64-bit integers; the doc_ids as D
signed 64-bit integers with D bytes that say which are null; the document lengths as D unsigned 32-bit integers; the block index, the
byte offset in the payload of each of the B blocks, as unsigned 64-bit integers; a minimum (unsigned 32 bits), a width and an
exception count (a byte each) for each block; the exceptions as E bytes of places in their blocks and E unsigned 32-bit values;
the payload. A block holds 128 ids. Its minimum is subtracted; ``width`` is the number of bits that the percentile's value
needs, packed 128 to a block in 64-bit words; values that need more are packed as 0 and listed as exceptions. A line end closes the file.

Files are written by Spark's own writer, a record a file, so they go to whatever store Spark writes to, and its commit protocol lets
each be there once, however often a task runs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC, HEAD = b"LWT2", "<4s6Q"
BLOCK = 128
PERCENTILE = 95
END_ID = 2
#: Bytes of text that a range of doc_ids gets, at least, and the most ranges; a range's ids are cut into files of at most so many ids.
RANGE_BYTES, MOST_RANGES, FILE_IDS = 8_000_000, 8192, 8_000_000


#: Widths of machine types, and blocks packed at once for other widths.
WHOLE, CHUNK = {8: "<u1", 16: "<u2", 32: "<u4"}, 512


def pack_words(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values below 2^width to (blocks, 2 * width) 64-bit words, the first value in the lowest bits.

    Widths that are a machine type's need a conversion only; others go in chunks that stay in the processor's cache.
    """
    if width in WHOLE:
        return np.ascontiguousarray(values, WHOLE[width]).view("<u8")
    if len(values) > CHUNK:
        return np.concatenate([pack_words(values[a : a + CHUNK], width) for a in range(0, len(values), CHUNK)])
    lanes = np.ascontiguousarray(values.T).astype(np.uint64)
    words = np.zeros((2 * width, values.shape[0]), np.uint64)
    for i in range(BLOCK):
        word, off = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(off)
        if off + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - off)
    return np.ascontiguousarray(words.T)


def unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    if width in WHOLE:
        return np.ascontiguousarray(words, "<u8").view(WHOLE[width]).astype(np.uint32)
    lanes = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, words.shape[0]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, off = divmod(i * width, 64)
        x = lanes[word] >> np.uint64(off)
        if off + width > 64:
            x = x | lanes[word + 1] << np.uint64(64 - off)
        out[i] = x & mask
    return np.ascontiguousarray(out.T)


def bits_of(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, number: int = 0, before: int = 0) -> bytes:
    """One file's bytes without the line end. The last block is filled up with its last id."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1] if n else 0, np.uint32)]).reshape(blocks, BLOCK)
    low = padded.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = padded - low[:, None]
    widths = bits_of(np.partition(rest, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]) if blocks else np.empty(0, np.uint8)
    over = rest > ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    where = np.nonzero(over)
    values = rest[where].astype("<u4")
    rest[where] = 0
    sizes = widths.astype(np.uint64) * np.uint64(BLOCK // 8)
    index = np.cumsum(sizes, dtype=np.uint64) - sizes
    payload = np.zeros(int(sizes.sum()) // 8, np.uint64)
    for w in np.unique(widths[widths > 0]).tolist():
        mine = np.flatnonzero(widths == w)
        places = (index[mine] // np.uint64(8)).astype(np.int64)[:, None] + np.arange(2 * w)
        payload[places] = pack_words(rest[mine], w)
    head = struct.pack(HEAD, MAGIC, len(doc_ids), n, blocks, len(values), number, before)
    null = np.array([d is None for d in doc_ids], np.uint8)
    own = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, own.tobytes(), null.tobytes(), lengths.astype("<u4").tobytes(), index.astype("<u8").tobytes(), low.astype("<u4").tobytes(), widths.tobytes(), over.sum(axis=1).astype(np.uint8).tobytes(), where[1].astype(np.uint8).tobytes(), values.tobytes(), payload.astype("<u8").tobytes()])


def decode_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a file."""
    magic, docs, n, blocks, odd, _, _ = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(HEAD)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    own, null, lengths, index = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u8", blocks)
    low, widths, counts = take("<u4", blocks), take("u1", blocks), take("u1", blocks)
    places, values = take("u1", odd), take("<u4", odd)
    payload = take("<u8", int(widths.sum(dtype=np.int64)) * BLOCK // 64)
    out = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(widths[widths > 0]).tolist():
        mine = np.flatnonzero(widths == w)
        words = payload[(index[mine] // np.uint64(8)).astype(np.int64)[:, None] + np.arange(2 * w)]
        out[mine] = unpack_words(words, w)
    out[np.repeat(np.arange(blocks), counts), places] = values
    out += low[:, None]
    return [None if z else int(d) for d, z in zip(own, null)], lengths, out.reshape(-1)[:n]


def place_of(data: bytes) -> tuple[int, int]:
    """The number of a file's range, and the ids of that range in files before it."""
    return struct.unpack_from(HEAD, data)[5:]


def range_cuts(docs: DataFrame, range_bytes: int) -> list[int]:
    """Ascending doc_ids that cut the rows into ranges of about ``range_bytes`` of text, at most ``MOST_RANGES``; null counts as the least.

    A doc_id of more rows than a range has stands there as often as ranges lie in it.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    total = docs.agg(F.sum(common.utf8_size("text")).alias("bytes")).first()["bytes"] or 0
    ranges = max(1, min(MOST_RANGES, -(-total // range_bytes)))
    if ranges == 1:
        return []
    return sorted(docs.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cuts")).first()["cuts"] or [])


def range_of(cuts: np.ndarray, ids: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Each row's range. Rows of an id that stands in ``cuts`` several times are dealt over as many ranges by their content."""
    low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    for i in np.flatnonzero(high - low > 1).tolist():
        high[i] = low[i] + 1 + zlib.crc32(data[i]) % (high[i] - low[i])
    return high


def write_files(docs: DataFrame, folder: str, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes ``docs`` (doc_id, text) to ``folder``, files for each range of doc_ids; returns (number, before, docs, ids) of the files.

    Texts are encoded where they lie and only compressed ids move: to the task of their range, sorted by doc_id, then
    length and content (rows of a very frequent doc_id by a hash of the content first). A task holds one file at a time, whatever
    its range holds. Documents of a null doc_id come first. Null texts hold the end id alone. Repeated rows are each written.
    An empty table gives no file.
    """
    cuts = np.array(range_cuts(docs, range_bytes), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, end, z = tokens.encoder(path), END_ID.to_bytes(4, "little"), zstandard.ZstdCompressor(level=1)
        for batch in common.text_batches(batches):
            ids = batch.column("doc_id").cast(pa.int64())
            data = [enc.encode(t) + end for t in batch.column("text").to_pylist()]
            number = range_of(cuts, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), data)
            small = [x if (x := np.frombuffer(d, "<u4")).max() > 65535 else x.astype("<u2") for d in data]
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), ids, pa.array([len(d) // 4 for d in data], pa.int64()), pa.array([z.compress(x) for x in small], pa.binary())], ["number", "doc_id", "n", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        now, before, held, own, parts = None, 0, 0, [], []

        def file() -> pa.RecordBatch:
            data = encode_file(own, np.array([len(p) for p in parts], np.uint32), np.concatenate(parts), now, before)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        for batch in batches:
            for r in batch.to_pylist():
                if own and (r["number"] != now or held + r["n"] > FILE_IDS):
                    yield file()
                    before, held, own, parts = before + held, 0, [], []
                if r["number"] != now:
                    now, before = r["number"], 0
                own.append(r["doc_id"])
                raw = z.decompress(r["data"])
                parts.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * r["n"] else "<u4").astype(np.uint32))
                held += r["n"]
        if own:
            yield file()

    encoded = docs.select("doc_id", "text").mapInArrow(encode, "number int, doc_id long, n long, data binary")
    dealt = encoded.repartition(len(cuts) + 1, "number").sortWithinPartitions("number", "doc_id", "n", "data")
    packed = dealt.mapInArrow(pack, "data binary")
    # the writer puts a text's bytes down as they are
    packed.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [struct.unpack_from(HEAD, x.as_buffer()) for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in found], pa.int64()) for i in (5, 6, 1, 2)], ["number", "before", "docs", "ids"])

    return token_bytes(docs.sparkSession, folder).mapInArrow(heads, "number long, before long, docs long, ids long")


def token_bytes(spark, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).filter("length > 0").select("content")


def read_files(spark, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files, which are read once.

    A file tells its own place in its range; the ranges' totals, at most ``MOST_RANGES`` rows, give the ranges' starts.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                raw = data.as_buffer()
                number, before = place_of(raw)
                own, lengths, ids = decode_file(raw)
                ends = np.cumsum(lengths, dtype=np.int64)
                view = memoryview(ids.astype("<u4")).cast("B")
                starts = ends - lengths
                crc = [zlib.crc32(view[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(own), pa.int32()), pa.array(own, pa.int64()), pa.array(before + starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["number", "doc_id", "local", "n_tokens", "ids_crc32"])

    found = common.written(token_bytes(spark, folder).mapInArrow(read, "number int, doc_id long, local long, n_tokens long, ids_crc32 long"), "token-rows")
    totals = found.groupBy("number").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("number", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    return found.join(F.broadcast(starts), "number").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` to token files and returns what the files hold; see ``write_files`` for nulls, ties, repeats and empty tables."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    folder = folder or common.new_path(spark, "token-files")
    write_files(docs, folder, path or tokens.path_of("word_bpe_49k.json"))
    return read_files(spark, folder)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
