"""Block-gzip text in parallel: a file of many small gzip blocks is split at any byte, no index needed.

register(spark); spark.read.format("block_gzip_text").option("path", ...).load() gives value, a row for each line. path is a file or a
folder of files on any store that pyarrow can open by its URI; split_bytes is how many compressed bytes a partition takes. A partition
begins at the first block that starts within its bytes: a block is known by its header, whose length leads to another block's header or the
file's end. Lines may run over blocks and partitions: a partition leaves what comes before its first line's end to the one
before, and goes on into the next blocks until its own last line ends. So each line comes once, whole.

write_lines writes rows in that format, a file for each task.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evidra.ship import ship

#: How a block begins, its largest size, and the empty block at a file's end.
MAGIC = b"\x1f\x8b\x08\x04"
LARGEST = 1 << 16
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SPLIT_BYTES = 32 << 20
#: Bytes of text in a block, and lines given to Spark at once.
BLOCK_TEXT, LINES = 60_000, 8192


def block_size(head: bytes) -> int | None:
    """The size of the block that begins with these bytes, or None if they begin none."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    (extra,) = struct.unpack_from("<H", head, 10)
    at = 12
    while at + 4 <= min(len(head), 12 + extra):
        kind, length = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and length == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    return None


def first_block(file, at: int, size: int) -> int:
    """Where the first block at or after a byte begins; the file's size if none does."""
    if at == 0 or at >= size:
        return min(at, size)
    file.seek(at)
    data = file.read(2 * LARGEST + 64)
    found = data.find(MAGIC)
    while found >= 0:
        length = block_size(data[found : found + 64])
        if length:
            after = at + found + length
            file.seek(after)
            if after == size or block_size(file.read(64)):
                return at + found
        found = data.find(MAGIC, found + 1)
    if at + len(data) < size:
        raise OSError("no block begins where one has to: not a block-gzip file")
    return size


def blocks(file, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Blocks from one's start on: where they begin and their text."""
    while at < size:
        file.seek(at)
        length = block_size(head := file.read(64))
        if not length:
            raise OSError(f"no block at {at}")
        raw = head[:length] + (file.read(length - len(head)) if length > len(head) else b"")
        if len(raw) < length:
            raise OSError("the file ends within a block")
        yield at, zlib.decompress(raw, 31)
        at += length


def lines_of(file, size: int, first: int, last: int) -> Iterator[bytes]:
    """The lines of the partition of bytes first to last (not included)."""
    at = first_block(file, first, size)
    if at >= last:
        return
    rest, begun = b"", first == 0
    for where, data in blocks(file, at, size):
        if where >= last:  # the last line's end, or the first one's if it has not come yet, is beyond
            if not begun:
                return
            head, end, _ = data.partition(b"\n")
            rest += head
            if end:
                yield rest
                return
            continue
        if not begun:
            _, end, data = data.partition(b"\n")
            if not end:
                continue
            begun = True
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if begun and rest:
        yield rest


def files_at(path: str) -> list[tuple[str, int]]:
    """The file, or the files of the folder in order, with their sizes."""
    from pyarrow import fs

    store, where = store_of(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [x for x in store.get_file_info(fs.FileSelector(where)) if x.type == fs.FileType.File and x.base_name[:1] not in "._"]
    return [(f"{path.rstrip('/')}/{x.base_name}", x.size) for x in sorted(found, key=lambda x: x.base_name)]


def store_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Split(InputPartition):
    path: str
    size: int
    first: int
    last: int


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.step = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        return [Split(p, n, a, min(n, a + self.step)) for p, n in files_at(self.path) for a in range(0, n, self.step)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        store, where = store_of(part.path)
        with store.open_input_file(where) as raw:
            held: list[str] = []
            for line in lines_of(io.BufferedReader(raw, 1 << 20), part.size, part.first, part.last):
                held.append(line.removesuffix(b"\r").decode())
                if len(held) == LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_gzip_text"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(BlockSource)


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """value: the lines of a block-gzip file or folder, read by many tasks."""
    register(spark)
    return spark.read.format("block_gzip_text").option("path", path).option("split_bytes", split_bytes).load()


def packed(data: bytes) -> bytes:
    """A block of up to BLOCK_TEXT bytes of text."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return MAGIC + bytes.fromhex("00000000 00ff 0600 4243 0200") + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_lines(lines: DataFrame, folder: str) -> DataFrame:
    """Write the rows of lines (value) as block-gzip files, one for each task that has rows: path and number of lines of each. A file gets a
    name of its own, so only those that are named in the result count; they are named by a table that has to be written before it is used."""
    ship(lines.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, buffer, n, path = None, bytearray(), 0, ""
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if file is None:
                    path = f"{folder}/{uuid.uuid4().hex}.gz"
                    store, where = store_of(path)
                    store.create_dir(where.rpartition("/")[0])
                    file = store.open_output_stream(where, compression=None)
                buffer += (value or "").encode() + b"\n"
                n += 1
                while len(buffer) >= BLOCK_TEXT:
                    file.write(packed(bytes(buffer[:BLOCK_TEXT])))
                    del buffer[:BLOCK_TEXT]
        if file:
            if buffer:
                file.write(packed(bytes(buffer)))
            file.write(END)
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n"])

    return lines.select("value").mapInArrow(run, "path string, n long")
