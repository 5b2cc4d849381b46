"""Best-fit packing of tokenised documents into sequences of a fixed length.

Each task packs the documents it reads as they come: bounded-space online best-fit. A fixed number of bins is open;
they are kept by free space, with one bit per free space in a bitset, so that the fullest bin that still takes a piece
is the lowest set bit at or above its length. When a bin more would be open, the fullest closes. Nothing is shuffled and
a piece is put out as soon as it has its place, so memory is bounded by the open bins whatever the partition's size.
Small partitions are joined until each has about MIN_ROWS rows or TASK_BYTES of text, as the bins left open at a task's end stay unfilled.

Documents: a null text is empty, and then only holds its end id; documents longer than the sequence are cut into whole
sequences, of which the first may be shorter, and only these are cut. A null doc_id is kept. Repeated rows are packed one
by one. An empty table gives no rows. Other columns are not carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import map_batches, slices
from evidra.llm.tokens import default_path, encoder

OPEN_BINS = 1024
MIN_ROWS = 4096
TASK_BYTES = 256 << 20
RUN = 256

PIECES = T.StructType(
    [T.StructField(n, T.IntegerType() if n == "piece" else T.LongType()) for n in ("doc_id", "piece", "start", "length", "sequence_id", "offset")]
    + [T.StructField("ids", T.BinaryType())]
)


class Bins:
    """The open bins: for each free space the bins that have it, and a bitset of the free spaces that occur."""

    def __init__(self, size: int, most: int, first: int = 0) -> None:
        self.size, self.most, self.next, self.open = size, most, first, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0

    def take(self, free: int) -> int:
        own = self.by_free[free]
        found = own.pop()
        if not own:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin that takes a piece of this length, and the piece's offset in it."""
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            found = self.take(free)
        else:
            found, free = self.next, self.size
            self.next += 1
        if left := free - length:
            if self.open == self.most:
                self.take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.size - free


def cuts(n: int, size: int) -> list[int]:
    """The pieces' lengths of a document of n ids: whole sequences, before them what is over."""
    return [n] if n <= size else [n % size] * (n % size > 0) + [size] * (n // size)


def pack(
    docs: DataFrame, path: str | None = None, size: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    path = path or default_path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        enc = encoder(path)
        bins = Bins(size, open_bins, first=TaskContext.get().partitionId() << 33)
        for batch in batches:
            for some in slices(batch, RUN):
                out: dict[str, list] = {n: [] for n in PIECES.fieldNames()}
                for doc, ids in zip(some.column("doc_id").to_pylist(), enc.encode([t or "" for t in some.column("text").to_pylist()]), strict=True):
                    ids += end
                    start = 0
                    for piece, length in enumerate(cuts(len(ids) // 4, size)):
                        at, offset = bins.place(length)
                        for n, v in zip(out, (doc, piece, start, length, at, offset, ids[4 * start : 4 * (start + length)]), strict=True):
                            out[n].append(v)
                        start += length
                yield out

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows.coalesce(tasks(rows)), PIECES, run)


def tasks(rows: DataFrame) -> int:
    """How many tasks pack rows at most: none with under MIN_ROWS rows, unless they have TASK_BYTES of text."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(1, math.ceil(n / MIN_ROWS), math.ceil(size / TASK_BYTES))


def with_crc32(pieces: DataFrame) -> DataFrame:
    """ids_crc32 in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

