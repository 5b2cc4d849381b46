"""Batch source of variant records by region, from block-gzip files with a bin index.

register(spark); spark.read.format("variant_regions").option("path", ...).option("regions",
"1:1000-2000;X:5-9").load() gives the records that overlap the regions, 1-based and both ends included. Without that option the
region comes from filters on chrom (equal) and pos (bounds), where spark.sql.python.filterPushdown.enabled is true; without either
the read fails. The index prunes
the file to chunks: bins of the region, less those that end before the linear index's offset; chunks with small gaps are
read as one. Each merged chunk is a partition, so tasks read only their own byte ranges. A region is whole or the task
fails: nothing that cannot be read looks absent. A record starts where the chunk's virtual offset says, so no line of a
chunk's ends is lost. load() may be given a list of files, each with its index beside it (<file>.tbi); indexes are read by the driver, so
for very many files read_regions is the way. A file may lie on any store that pyarrow can open by its URI.

read_regions does the same for regions that are a table: bins, pruning and merging are joins and windows over the index's rows, and the byte
ranges are rows that tasks read.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from evidra.shared import cut, drop
from evidra.ship import ship
from evidra.sources.blocks import BLOCK_TEXT, END, packed, store_of

SCHEMA = "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string, format string, sample string"
#: Chunks whose gap in the file is at most this many bytes are read together.
GAP = 65_536
LINEAR = 14
#: The last position that the bins reach.
LAST = 1 << 29


#: The six levels of the binning scheme of genomic indexes, as (first bin, shift).
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
#: The last bin of places; an index may have one beyond it for counts.
LAST_BIN = 37448


def bins(start: int, end: int) -> list[int]:
    """Index bins that may hold records overlapping [start, end), 0-based."""
    return [b for first, shift in LEVELS for b in range(first + (start >> shift), first + ((end - 1) >> shift) + 1)]


@dataclass
class Contig:
    chunks: dict[int, list[tuple[int, int]]]
    linear: list[int]


def read_index(data: bytes) -> dict[str, Contig]:
    """Contigs of a bin index (the gunzipped file), by name."""
    if data[:4] != b"TBI\1":
        raise ValueError("not a bin index")
    n, *_, l_names = struct.unpack_from("<8i", data, 4)
    names = data[36 : 36 + l_names].rstrip(b"\0").decode().split("\0") if n else []
    at, out = 36 + l_names, {}
    for name in names:
        (n_bins,) = struct.unpack_from("<i", data, at)
        at += 4
        chunks = {}
        for _ in range(n_bins):
            number, k = struct.unpack_from("<Ii", data, at)
            chunks[number] = [struct.unpack_from("<QQ", data, at + 8 + 16 * i) for i in range(k)]
            at += 8 + 16 * k
        (n_linear,) = struct.unpack_from("<i", data, at)
        out[name] = Contig(chunks, list(struct.unpack_from(f"<{n_linear}Q", data, at + 4)))
        at += 4 + 8 * n_linear
    return out


def chunks_of(contig: Contig, start: int, end: int) -> list[tuple[int, int]]:
    """Pruned and merged chunks (virtual offsets) for [start, end), 0-based."""
    least = contig.linear[min(start >> LINEAR, len(contig.linear) - 1)] if contig.linear else 0
    found = sorted(c for b in bins(start, end) for c in contig.chunks.get(b, ()) if c[1] > least)
    merged: list[tuple[int, int]] = []
    for a, b in found:
        if merged and (a >> 16) - (merged[-1][1] >> 16) <= GAP:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def lines(file, first: int, last: int) -> Iterator[bytes]:
    """Whole lines that start at virtual offsets from first up to last."""
    at, skip, rest = first >> 16, first & 0xFFFF, b""
    while at <= last >> 16:
        file.seek(at)
        head = file.read(18)
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            break
        size = struct.unpack("<H", head[16:18])[0] + 1
        file.seek(at)
        raw = file.read(size)
        if len(raw) < size:
            raise OSError("the file ends within a block")
        data = zlib.decompress(raw, 31)
        data = data[: last & 0xFFFF] if at == last >> 16 else data
        *whole, rest = (rest + data[skip:]).split(b"\n")
        yield from whole
        at, skip = at + size, 0
    if rest:
        yield rest


def union(regions: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Regions that share a place as one, so that a record is read once."""
    out: list[tuple[str, int, int]] = []
    for chrom, start, end in sorted(regions):
        if out and out[-1][0] == chrom and start <= out[-1][2] + 1:
            out[-1] = chrom, out[-1][1], max(end, out[-1][2])
        else:
            out.append((chrom, start, end))
    return out


@dataclass
class Part(InputPartition):
    path: str
    chrom: str
    start: int
    end: int
    first: int
    last: int


def opened(path: str):
    from pyarrow import fs

    files, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files.open_input_file(where)


class RegionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        paths = json.loads(options["paths"]) if options.get("paths") else [options["path"]]
        if options.get("index") and len(paths) > 1:
            raise ValueError("of several files each one's index lies beside it")
        self.files = [(p, options.get("index") or p + ".tbi") for p in paths]
        self.regions: list[tuple[str, int, int]] = []
        for r in filter(None, options.get("regions", "").split(";")):
            m = re.fullmatch(r"(?:chr)?([^:]+):([0-9]+)-([0-9]+)", r.strip())
            if not m or int(m[2]) > int(m[3]) or int(m[2]) < 1:
                raise ValueError(f"not a region: {r}")
            self.regions.append((m[1], int(m[2]), int(m[3])))
        self.regions = union(self.regions)

    def partitions(self) -> list[Part]:
        parts = []
        for path, at in self.files:
            with opened(at) as file:
                index = read_index(gzip.decompress(file.read()))
            own = {re.sub("^chr", "", name): contig for name, contig in index.items()}
            parts += [Part(path, c, s, e, a, b) for c, s, e in self.regions if c in own for a, b in chunks_of(own[c], s - 1, e)]
        return parts

    def read(self, part: Part) -> Iterator[tuple]:
        if part is None:
            return
        with opened(part.path) as file:
            for line in lines(file, part.first, part.last):
                row = record(line, part.chrom)
                if row and overlaps(row, [part.start], [part.end]):
                    if any(c == part.chrom and overlaps(row, [b], [e]) for c, b, e in self.regions if e < part.start):
                        continue  # a long record that an earlier region gave
                    yield row


INDEX = "path string, chrom string, bin int, first long, last long"


def index_rows(files: DataFrame) -> DataFrame:
    """The indexes of files (path, index) as rows: path, chrom, bin, first, last (virtual offsets) of their chunks; bin is null for the linear
    index, of which first is the window and last the offset. A task reads whole indexes, which are small files."""
    ship(files.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                with opened(index) as file:
                    contigs = read_index(gzip.decompress(file.read()))
                for name, c in contigs.items():
                    rows = [(b, x, y) for b, chunks in c.chunks.items() if b <= LAST_BIN for x, y in chunks] + [(None, w, v) for w, v in enumerate(c.linear)]
                    own = [pa.array([path] * len(rows), pa.string()), pa.array([re.sub("^chr", "", name)] * len(rows), pa.string())]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["path", "chrom", "bin", "first", "last"])

    return files.select("path", "index").mapInArrow(run, INDEX)


def byte_ranges(regions: DataFrame, index: DataFrame, gap: int = GAP) -> DataFrame:
    """path, chrom, first, last (virtual offsets), bytes (compressed, to the start of the last block) and regions (start, end of those that
    need it) of what a table of regions (chrom, st, en: from 1, both ends included) needs of the files: bins of each region, less the chunks that end
    before the linear index's offset, chunks with small gaps as one. Of a contig's regions those that share a place are one first."""
    from evidra.operators.intervals import merged_spans, region_bins

    own = merged_spans(regions.where("st <= en AND en >= 1").select(F.regexp_replace("chrom", "^chr", "").alias("chrom"), F.greatest("st", F.lit(1)).cast("long").alias("st"), F.least("en", F.lit(LAST)).cast("long").alias("en")).where("st <= en"), 1, ["chrom"])
    linear = index.where("bin IS NULL").select("path", "chrom", F.col("first").alias("window"), F.col("last").alias("least"))
    tops = index.groupBy("path", "chrom").agg(F.max(F.when(F.col("bin").isNull(), F.col("first"))).alias("top"))
    own = own.join(tops, "chrom").withColumn("window", F.least(F.shiftright(F.col("st") - 1, LINEAR), F.col("top"))).join(linear, ["path", "chrom", "window"], "left")
    need = own.select("path", "chrom", "st", "en", F.coalesce("least", F.lit(0)).alias("least"), F.explode(region_bins((F.col("st") - 1).cast("int"), F.col("en").cast("int"))).alias("bin"))
    chunks = need.join(index.where("bin IS NOT NULL"), ["path", "chrom", "bin"]).where("last > least")
    # chunks of a contig as one where the next begins at most gap bytes after all before end
    by = Window.partitionBy("path", "chrom").orderBy("first", "last")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.shiftright("first", 16) - F.shiftright(before, 16) > gap), 1).otherwise(0)
    islands = chunks.withColumn("_new", new).withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = islands.groupBy("path", "chrom", "_island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_set(F.struct("st", "en"))).alias("regions"))
    return found.select("path", "chrom", "first", "last", (F.shiftright("last", 16) - F.shiftright("first", 16)).alias("bytes"), "regions")


def one_file(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """path, index of one indexed file."""
    return spark.range(1).select(F.lit(path).alias("path"), F.lit(index or path + ".tbi").alias("index"))


def read_regions(files: DataFrame, regions: DataFrame, task_bytes: int = 32 << 20) -> DataFrame:
    """The records of indexed files (path, index) that overlap a table of regions (chrom, st, en), each once, as a table: Catalyst would take
    rows that a function makes of a few byte ranges to be few, and broadcast them in a join. The files' byte ranges are rows, dealt to tasks by
    bytes; tasks read theirs only, and no region goes through the driver."""
    index = cut(index_rows(files), "index")
    ranges = cut(byte_ranges(regions, index), "ranges")
    drop(index)
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # on small files a few tasks for each core, as ranges that are dealt out by their names may meet
    share = max(1, min(task_bytes, size // (3 * files.sparkSession.sparkContext.defaultParallelism)))
    tasks = max(1, min(n, -(-size // share)))
    upto = F.sum("bytes").over(Window.partitionBy("path", "chrom").orderBy("first"))
    dealt = ranges.withColumn("_task", F.floor(upto / share)).repartition(tasks, "path", "chrom", "_task").sortWithinPartitions("path", "chrom", "first")
    dealt = dealt.select("path", "chrom", "first", "last", F.transform("regions", lambda r: r["st"]).alias("sts"), F.transform("regions", lambda r: r["en"]).alias("ens"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = pa.schema([(n, pa.int64() if n == "pos" else pa.string()) for n in names])
        for batch in batches:
            for r in batch.to_pylist():
                held = []
                with opened(r["path"]) as file:
                    for line in lines(file, r["first"], r["last"]):
                        row = record(line, r["chrom"])
                        if row and overlaps(row, r["sts"], r["ens"]):
                            held.append(row)
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), to, strict=True)], schema=to)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), to, strict=True)], schema=to)

    found = cut(dealt.mapInArrow(run, SCHEMA), "records")
    drop(ranges)
    return found


def record(line: bytes, chrom: str) -> tuple | None:
    """The columns of a line of a contig's record, or None."""
    f = line.decode().split("\t")
    if line.startswith(b"#") or len(f) < 8 or re.sub("^chr", "", f[0]) != chrom:
        return None
    f += [None] * (10 - len(f))
    return (chrom, int(f[1]), *f[2:10])


def overlaps(row: tuple, starts: list[int], ends: list[int]) -> bool:
    """Whether a record shares a place with one of some sorted regions that share none with each other."""
    at = bisect_right(starts, row[1] + len(row[3]) - 1) - 1
    return at >= 0 and ends[at] >= row[1]


def smallest_bins(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each [start, end), 0-based, the smallest bin that holds it."""
    inside = [start >> shift == (end - 1) >> shift for _, shift in LEVELS]
    if not inside[0].all():
        raise ValueError("a record goes on beyond the last position that the bins reach")
    return np.select(inside[::-1], [first + (start >> shift) for first, shift in reversed(LEVELS)])


class IndexedFile:
    """Writes one contig's records, in order, as a block-gzip file, then its bin index. What it keeps of a record is its place, its reference's
    length and its line's; blocks hold BLOCK_TEXT bytes of text, so where a line begins in the file follows from where it does in the text."""

    def __init__(self, path: str, chrom: str) -> None:
        self.path, self.chrom, self.at, self.rest, self.n = path, chrom, 0, b"", 0
        self.begins = [0]
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        store, where = store_of(path)
        store.create_dir(where.rpartition("/")[0])
        self.file = store.open_output_stream(where, compression=None)

    def add(self, pos: np.ndarray, length: np.ndarray, sizes: np.ndarray, text: bytes) -> None:
        """The next records: their places, the lengths of their references and of their lines in bytes, and the lines."""
        self.kept.append((pos, length, sizes))
        self.n += len(pos)
        text = self.rest + text
        whole = len(text) - len(text) % BLOCK_TEXT
        for i in range(0, whole, BLOCK_TEXT):
            self.put(text[i : i + BLOCK_TEXT])
        self.rest = text[whole:]

    def put(self, data: bytes) -> None:
        block = packed(data)
        self.file.write(block)
        self.at += len(block)
        self.begins.append(self.at)

    def index(self) -> bytes:
        pos, length, sizes = (np.concatenate(c) for c in zip(*self.kept, strict=True))
        text = np.concatenate([[0], np.cumsum(sizes)])
        offsets = np.array(self.begins, np.int64)[text // BLOCK_TEXT] << 16 | text % BLOCK_TEXT
        start, end = pos - 1, pos - 1 + np.maximum(1, length)
        # records of a bin that follow each other are a chunk
        own = smallest_bins(start, end)
        first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        order = np.argsort(own[first], kind="stable")
        chunks = np.stack([offsets[first], offsets[np.append(first[1:], self.n)]], 1)[order].astype("<u8")
        bins, upto = np.unique(own[first][order], return_index=True)
        # of each window the first record that lies in it, or else the one of the window before
        wide = ((end - 1) >> LINEAR) - (start >> LINEAR) + 1
        record = np.repeat(np.arange(self.n), wide)
        windows, met = np.unique(np.repeat((start >> LINEAR) - np.cumsum(wide) + wide, wide) + np.arange(len(record)), return_index=True)
        linear = np.concatenate([[0], offsets[record[met]]])[np.searchsorted(windows, np.arange(windows[-1] + 1), "right")].astype("<u8")
        name = self.chrom.encode() + b"\0"
        out = [b"TBI\1", struct.pack("<8i", 1, 2, 1, 2, 0, ord("#"), 0, len(name)), name, struct.pack("<i", len(bins))]
        for b, c in zip(bins.tolist(), np.split(chunks, upto[1:]), strict=True):
            out += [struct.pack("<Ii", b, len(c)), c.tobytes()]
        return b"".join([*out, struct.pack("<i", len(linear)), linear.tobytes()])

    def close(self) -> str:
        out = self.index()
        if self.rest:
            self.put(self.rest)
        self.file.write(END)
        self.file.close()
        store, where = store_of(self.path + ".tbi")
        with store.open_output_stream(where, compression=None) as file:
            for i in range(0, len(out), BLOCK_TEXT):
                file.write(packed(out[i : i + BLOCK_TEXT]))
            file.write(END)
        return self.path + ".tbi"


#: Records that a task sorts and writes as indexed files.
FILE_ROWS = 500_000


def write_indexed(rows: DataFrame, folder: str, stretch: int = 1 << 24, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write records (the columns of SCHEMA) as indexed block-gzip files, one or more for each stretch of places of a contig: a table of path,
    index, chrom, n of each. A task sorts about file_rows records, however many a stretch has, and writes them in order of places; files have names
    of their own, so only those that are named count."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    ship(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = file = None
        done = lambda f: pa.RecordBatch.from_arrays([pa.array([f.path]), pa.array([f.close()]), pa.array([f.chrom]), pa.array([f.n], pa.int64())], ["path", "index", "chrom", "n"])
        for batch in batches:
            if not batch.num_rows:
                continue
            chroms, part, pos, length = (batch.column(n) for n in ("chrom", "_part", "pos", "_length"))
            text = batch.column("_line").cast(pa.large_string())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            new = np.flatnonzero(pc.or_(pc.not_equal(chroms[1:], chroms[:-1]), pc.not_equal(part[1:], part[:-1])).to_numpy(zero_copy_only=False)) + 1
            for a, b in pairwise([0, *new.tolist(), len(text)]):
                if (key := (chroms[a].as_py(), part[a].as_py())) != now:
                    if file:
                        yield done(file)
                    now, file = key, IndexedFile(f"{folder}/{uuid.uuid4().hex}.vcf.gz", key[0])
                # a copy, as Spark may use a batch's memory again
                file.add(pos[a:b].to_numpy().copy(), length[a:b].to_numpy().astype(np.int64), np.diff(ends[a : b + 1]), text.buffers()[2][ends[a] : ends[b]].to_pybytes())
        if file:
            yield done(file)

    parts = cut(rows.where("chrom IS NOT NULL AND pos >= 1").select(F.expr(f"pos div {stretch}").alias("_part"), *names), "records")
    order = ["chrom", "_part", "pos", "ref", "alt"]
    dealt = parts.repartitionByRange(max(1, -(-parts.count() // file_rows)), *order).sortWithinPartitions(*order)
    line = F.concat(F.concat_ws("\t", *[F.coalesce(F.col(n).cast("string"), F.lit(".")) for n in names]), F.lit("\n"))
    dealt = dealt.select("chrom", "_part", F.col("pos").cast("long"), F.coalesce(F.length("ref"), F.lit(0)).alias("_length"), line.alias("_line"))
    files = cut(dealt.mapInArrow(run, "path string, index string, chrom string, n long"), "files")
    drop(parts)
    return files


class FilteredReader(RegionReader):
    """Of a read without named regions. Spark refuses it where spark.sql.python.filterPushdown.enabled is false."""

    pushed = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the region from the filters; Spark still applies them all to the rows."""
        chrom, low, high = None, 1, LAST
        for f in filters:
            match f:
                case EqualTo(("chrom",), value):
                    chrom = value
                case EqualTo(("pos",), value):
                    low, high = max(low, value), min(high, value)
                case GreaterThanOrEqual(("pos",), value) | GreaterThan(("pos",), value):
                    low = max(low, value)
                case LessThanOrEqual(("pos",), value) | LessThan(("pos",), value):
                    high = min(high, value)
        if chrom is None:
            raise ValueError("name regions, or filter by chrom")
        self.regions, self.pushed = [(chrom, low, high)] if low <= high else [], True
        return filters

    def partitions(self) -> list[Part]:
        if not self.pushed:
            raise ValueError("name regions, or filter by chrom")
        return super().partitions()


class RegionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "variant_regions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RegionReader:
        return (RegionReader if self.options.get("regions") else FilteredReader)(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RegionSource)
