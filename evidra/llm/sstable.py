"""Token ids as sorted string tables: binary shards in ascending doc_id order, looked up by binary search.

A shard file is: data blocks, a block index, a Bloom filter, a footer.

- A data block holds entries in key order. Key: 8 bytes, doc_id with its sign bit flipped, big-endian, so that bytes
  sort as numbers do; a null doc_id has no bytes and so sorts before all. Each entry: shared prefix length (1 byte),
  number of own key bytes (1), own key bytes, bytes an id (1: 2, or 4 where an id needs them), number of ids (uint32),
  ids (little-endian). The first key of a block shares nothing. After its entries a block has crc32 of them (uint32).
- Block index: for each block its first key's length (1 byte) and bytes, offset (uint64), length (uint32), entries (uint32).
- Bloom filter: number of hashes (uint32), number of bits (uint64), bits.
- Footer, 56 bytes: index offset and length, filter offset and length, entries, ids (uint64 each), magic.

Shards come from a range partitioning by (doc_id, hash of the text); each task streams its sorted rows into files of
its own names in the shared folder, a new one after SHARD_BYTES of ids, so a retried or speculated task never touches another's
file, and only files named in the manifest count. Tasks take LEAST_BYTES of text each, or more where that would be over MANY_TASKS
tasks, and as many read. Texts are encoded after the exchange, once. Reading streams one block at a time. The manifest is a table with a row
for each shard; the ids before a shard are running sums over it, by ranges of partitions.

Defined results: null text: empty; null doc_id: sorts first and reads back as null; equal doc_ids stand in order of
their texts' hashes; an empty table gives no shards and no rows; other columns, whatever their names, are not written.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import cut, map_batches, new_path, slices
from evidra.llm.tokens import default_path, encoder

SHARD_BYTES = 64 << 20
LEAST_BYTES = 16 << 20
MANY_TASKS = 20_000
#: Partitions whose ids are summed as one range.
RANGE = 1024
BLOCK_BYTES = 64 << 10
BITS_PER_KEY = 10
HASHES = 7
RUN = 256
MAGIC = b"EVSST003"
FOOTER = struct.Struct("<6Q8s")

MANIFEST = T.StructType(
    [T.StructField("path", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("first_doc", "last_doc", "part", "shard", "docs", "ids", "bytes")]
)


def to_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + 2**63)


def from_key(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def bloom_bits(key_hash: int, n_hashes: int, n_bits: int) -> list[int]:
    """Places of a key by its 64-bit hash: the halves are two hashes that depend on every bit of the key."""
    a, b = key_hash >> 32, key_hash & 0xFFFFFFFF | 1
    return [(a + i * b) % n_bits for i in range(n_hashes)]


def narrow(ids: bytes) -> tuple[int, bytes]:
    """Little-endian 32-bit ids in as few bytes as their largest needs, 2 or 4."""
    x = np.frombuffer(ids, "<u4")
    return (2, x.astype("<u2").tobytes()) if x.max(initial=0) < 65536 else (4, ids)


def wide(width: int, data: bytes) -> bytes:
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Streams ascending (key, ids) into one shard."""

    def __init__(self, path: str) -> None:
        self.path = path
        files, where = open_path(path)
        files.create_dir(where.rpartition("/")[0])
        self.file = files.open_output_stream(where)
        self.at, self.keys, self.n_ids, self.n = 0, [], 0, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.block, self.first, self.last, self.entries = bytearray(), b"", b"", 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = to_key(doc_id)
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        width, data = narrow(ids)
        self.block += struct.pack("<BB", shared, len(key) - shared) + key[shared:] + struct.pack("<BI", width, len(ids) // 4) + data
        self.last = key
        self.entries += 1
        self.keys.append(xxhash.xxh64_intdigest(key))
        self.n_ids += len(ids) // 4
        self.n += 1
        if len(self.block) >= BLOCK_BYTES:
            self.end_block()

    def put(self, data: bytes) -> tuple[int, int]:
        self.file.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def end_block(self) -> None:
        if self.block:
            at, length = self.put(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
            self.index.append((self.first, at, length, self.entries))
            self.block, self.entries = bytearray(), 0

    def close(self) -> int:
        self.end_block()
        index = self.put(b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QII", *x) for k, *x in self.index))
        n_bits = max(64, BITS_PER_KEY * self.n)
        bits = bytearray(-(-n_bits // 8))
        for x in self.keys:
            for bit in bloom_bits(x, HASHES, n_bits):
                bits[bit >> 3] |= 1 << (bit & 7)
        bloom = self.put(struct.pack("<IQ", HASHES, n_bits) + bytes(bits))
        self.put(FOOTER.pack(*index, *bloom, self.n, self.n_ids, MAGIC))
        self.file.close()
        return self.at


class Reader:
    """One shard: streams its entries, or looks up a doc_id by filter, binary search over block keys, and one block."""

    def __init__(self, path: str) -> None:
        files, where = open_path(path)
        self.file = files.open_input_file(where)
        size = self.file.size()
        if size < FOOTER.size:
            raise ValueError(f"{path} is not a shard")
        *places, self.n, self.n_ids, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        index, at, self.index = self.read(*places[:2]), 0, []
        while at < len(index):
            n = index[at]
            self.index.append((index[at + 1 : at + 1 + n], *struct.unpack_from("<QII", index, at + 1 + n)))
            at += 17 + n
        self.bloom = places[2:]
        self.filter = b""

    def read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def entries(self, block: int) -> Iterator[tuple[int | None, bytes]]:
        _, start, length, _ = self.index[block]
        data = self.read(start, length)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum differs")
        at, key = 0, b""
        while at < length - 4:
            shared, own = data[at], data[at + 1]
            key = key[:shared] + data[at + 2 : at + 2 + own]
            width, n = struct.unpack_from("<BI", data, at + 2 + own)
            at += 7 + own
            yield from_key(key), wide(width, data[at : at + width * n])
            at += width * n

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for block in range(len(self.index)):
            yield from self.entries(block)

    def may_hold(self, key: bytes) -> bool:
        """Whether the filter, which is read once, has all bits of the key."""
        self.filter = self.filter or self.read(*self.bloom)
        n_hashes, n_bits = struct.unpack_from("<IQ", self.filter)
        return all(self.filter[12 + (bit >> 3)] >> (bit & 7) & 1 for bit in bloom_bits(xxhash.xxh64_intdigest(key), n_hashes, n_bits))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every entry with this doc_id."""
        key = to_key(doc_id)
        if not self.index or not self.may_hold(key):
            return []
        firsts = [k for k, *_ in self.index]
        block, found = max(0, bisect_right(firsts, key) - 1), []
        while block > 0 and firsts[block] == key:
            block -= 1
        while block < len(self.index) and firsts[block] <= key:
            found += [ids for d, ids in self.entries(block) if d == doc_id]
            block += 1
        return found


def partitions(rows: int, size: int) -> int:
    """How many tasks take rows of size bytes in all: tasks grow from LEAST_BYTES with the input, so that there are at most MANY_TASKS.
    A task streams, so its size is no matter of memory."""
    return max(1, min(rows, math.ceil(size / LEAST_BYTES), MANY_TASKS))


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, shard_bytes: int = SHARD_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write docs' ids into shards in folder; the manifest, a row for each shard, with the ids before it (start)."""
    path = path or default_path()
    end = struct.pack("<I", end_id)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        enc = encoder(path)
        writer = first = last = None
        part, shard = -1, 0

        def done() -> dict:
            size = writer.close()
            return {k: [v] for k, v in zip(MANIFEST.fieldNames(), (writer.path, first, last, part, shard, writer.n, writer.n_ids, size), strict=True)}

        for batch in batches:
            for some in slices(batch, RUN):
                docs, texts, parts = (some.column(c).to_pylist() for c in ("doc_id", "text", "part"))
                for doc, ids in zip(docs, enc.encode([t or "" for t in texts]), strict=True):
                    if writer is None:
                        writer, first, part = Writer(f"{folder}/{uuid.uuid4().hex}.sst"), doc, parts[0]
                    writer.add(doc, ids + end)
                    last = doc
                    if writer.n_ids * 4 >= shard_bytes:
                        yield done()
                        writer, shard = None, shard + 1
        if writer:
            yield done()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ranged = rows.repartitionByRange(partitions(n, size), *order).sortWithinPartitions(*order)
    shards = cut(map_batches(ranged.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")), MANIFEST, run), "manifest")
    shards = shards.withColumn("range", F.expr(f"part div {RANGE}"))
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    # a row for each RANGE partitions
    ranges = shards.groupBy("range").agg(F.sum("ids").alias("all")).select("range", F.coalesce(F.sum("all").over(before(Window.orderBy("range"))), F.lit(0)).alias("earlier"))
    own = F.coalesce(F.sum("ids").over(before(Window.partitionBy("range").orderBy("part", "shard"))), F.lit(0))
    return shards.withColumn("own", own).join(ranges, "range").select(*MANIFEST.fieldNames(), (F.col("earlier") + F.col("own")).alias("start"))


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids, from the files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                start, reader = row["start"], Reader(row["path"])
                for block in range(len(reader.index)):
                    out: dict[str, list] = {"doc_id": [], "start": [], "ids": []}
                    for doc, ids in reader.entries(block):
                        for n, v in zip(out, (doc, start, ids), strict=True):
                            out[n].append(v)
                        start += len(ids) // 4
                    yield out

    # as many tasks as wrote, so that a task reads what is about LEAST_BYTES or more
    files = cut(manifest.select("path", "start", "bytes"), "files")
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return map_batches(files.repartition(partitions(n, size)), DOCS, run)


def folder(spark: SparkSession) -> str:
    return new_path(spark, "sst")
