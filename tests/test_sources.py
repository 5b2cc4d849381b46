"""Readers, writers and the region source on generated files."""

from __future__ import annotations

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from evidra.sources import regions, sinks, tables

RECORDS = [("chr1" if i % 2 else "1", 100 + 700 * i, "A" if i % 5 else "ACG", "C,T" if i % 4 == 0 else "G") for i in range(200)]


def vcf_text(records):
    head = "##fileformat=VCFv4.2\n##reference=ref38\n##contig=<ID=1,length=9>\n##contig=<ID=2>\n##INFO=<ID=AF,Number=A>\n##FORMAT=<ID=GT>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n"
    return head + "".join(f"{c}\t{p}\t.\t{r}\t{a}\t.\tPASS\tAF=0.1\tGT\t0/1\n" for c, p, r, a in records) + "short\tline\n"


def test_vcf(spark, tmp_path):
    path = tmp_path / "a.vcf.gz"
    text = vcf_text(RECORDS)
    path.write_bytes(gzip.compress(text[:3000].encode()) + gzip.compress(text[3000:].encode()))  # several members
    got = tables.read_vcf(spark, str(path), partitions=3)
    assert got.count() == sum(1 + a.count(",") for *_, a in RECORDS) and {r.chrom for r in got.select("chrom").distinct().collect()} == {"1"}
    assert {r.qual for r in got.collect()} == {None}
    head = {(r.kind, r.value) for r in tables.vcf_header(spark, str(path)).collect()}
    assert head == {("reference", "ref38"), ("contig", "1"), ("contig", "2"), ("INFO", "AF"), ("FORMAT", "GT"), ("samples", "1")}


def test_text_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\t.\n")
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    assert tables.read_tsv(spark, str(tmp_path / "t.tsv")).collect()[0].b == "."
    assert tables.read_sniffed(spark, str(tmp_path / "c.csv")).columns == tables.read_sniffed(spark, str(tmp_path / "t.tsv")).columns == ["a", "b"]
    (tmp_path / "m.tsv").write_text("symbol\tGRCh38_chr\tchr_start\tchr_end\tRefSeq_nuc\nA\t1\t5\t9\tT1\nB\t2\t1\t2\tT2\nA\t1\t50\t90\tT3\n")
    assert {(r.gene, r.st, r.transcript) for r in tables.read_gene_summary(spark, str(tmp_path / "m.tsv")).collect()} == {("A", 50, "T3"), ("B", 1, "T2")}
    (tmp_path / "n.txt").write_text("# all\nA # first\n\n B\n")
    assert [tuple(r) for r in tables.read_names(spark, str(tmp_path / "n.txt")).collect()] == [("A", 2), ("B", 4)]
    (tmp_path / "s.gmt").write_text("s up\tx\ta,1.0\tb\t\nshort\tx\n")
    assert [(r.name, r.genes) for r in tables.read_gene_sets(spark, str(tmp_path / "s.gmt")).collect()] == [("s up", ["A", "B"])]
    (tmp_path / "e.gmt").write_text("")
    with pytest.raises(ValueError, match="no gene set"):
        tables.read_gene_sets(spark, str(tmp_path / "e.gmt"))


def test_gff_and_fasta(spark, tmp_path):
    line = "NC_000001.11\tx\t{}\t{}\t{}\t.\t-\t.\tID=e;Parent=rna-T1;gene=A\n"
    (tmp_path / "g.gff").write_text("#h\n" + line.format("exon", 50, 60) + line.format("exon", 10, 20) + line.format("CDS", 15, 20) + line.format("gene", 1, 99))
    t = tables.transcripts(tables.read_gff(spark, str(tmp_path / "g.gff"))).collect()[0]
    assert (t.acc, t.gene, t.strand, [tuple(e) for e in t.exons], [tuple(e) for e in t.cds]) == ("T1", "A", "-", [(10, 20), (50, 60)], [(15, 20)])
    (tmp_path / "f.fa").write_text(">T1 some\nacg\nTT\n>T2\n\nA\n")
    assert {(r.acc, r.seq) for r in tables.read_fasta(spark, str(tmp_path / "f.fa")).collect()} == {("T1", "ACGTT"), ("T2", "A")}


def test_files_and_blobs(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.vcf.gz").write_text("1")
    (tmp_path / "d" / "y.txt").write_text("22")
    from evidra.operators.text import GENOMIC_FILE

    assert [r.length for r in tables.list_files(spark, str(tmp_path), GENOMIC_FILE).collect()] == [1]
    (tmp_path / "d" / "z.txt").write_text("22")
    blobs = tables.distinct_blobs(tables.file_blobs(spark, str(tmp_path), "txt$")).collect()
    assert [(r.path.rpartition("/")[2], bytes(r.content), r.n) for r in blobs] == [("y.txt", b"22", 2)]


def test_sweep_skips_what_lies_below_listed_folders(spark):
    files = [("/a/b/x.vcf", 1), ("/a/b/c/y.vcf", 2), ("/a/b2/z.vcf", 4), ("/a/q.txt", 8), ("/d/x.bam", 16), ("top.vcf", 32), ("/a/b/c/n.txt", 64)]
    folders = [("/a/b/",), ("/a/b/c",), ("/none",), ("/a/b",), (None,)]
    got = tables.swept_files(spark.createDataFrame(files, "path string, length long"), spark.createDataFrame(folders, "folder string"), r"\.(vcf|bam)$")
    want = {("folder", "/a/b", 67, 3), ("folder", "/a/b/c", 66, 2), ("file", "/a/b2/z.vcf", 4, 1), ("file", "/d/x.bam", 16, 1), ("file", "top.vcf", 32, 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumn("s", F.lit("x"))
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert tables.read_tsv(spark, str(tmp_path / "t")).count() == 5
    sinks.write_submission(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.append_log(df, str(tmp_path / "j"))
    assert tables.read_json_lines(spark, str(tmp_path / "j"), "id long, s string").count() == 10
    sinks.replace_state(df, str(tmp_path / "p"))
    sinks.replace_state(df.limit(2), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.replace_state(spark.read.parquet(str(tmp_path / "p")).unionByName(df), str(tmp_path / "p"))  # may read what it replaces
    assert spark.read.parquet(str(tmp_path / "p")).count() == 7
    with pytest.raises(Exception, match="wrong"):  # a write that fails leaves the old table
        sinks.replace_state(df.withColumn("s", F.raise_error(F.lit("wrong")).cast("string")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 7 and not [p for p in tmp_path.iterdir() if p.name.endswith(".old")]


def test_appended_columns_and_cached_targets(spark, tmp_path):
    sinks.append_columns(spark.range(3).withColumn("s", F.lit("x")), str(tmp_path / "a"), twice=F.col("id") * 2)
    got = tables.read_tsv(spark, str(tmp_path / "a"))
    assert got.columns == ["id", "s", "twice"] and {r.twice for r in got.collect()} == {"0", "2", "4"}
    (tmp_path / "t.json").write_text('{"symbol": "A", "effects": [1.5, null], "tractability": [{"modality": "m", "value": true}]}\n')
    assert [(r.symbol, r.effects) for r in tables.read_targets(spark, str(tmp_path / "t.json")).collect()] == [("A", [1.5, None])]
    (tmp_path / "e.json").write_text('{"errors": ["no such field"]}\n')
    with pytest.raises(Exception, match="no such field"):
        tables.read_targets(spark, str(tmp_path / "e.json")).collect()


def test_overlapping_regions_give_a_record_once(spark, tmp_path):
    records = [("chr1", 100 + 700 * i, "A" * (3000 if i % 50 == 3 else 1), "G") for i in range(200)]
    indexed(tmp_path / "r.vcf.gz", records)
    regions.register(spark)
    some = [(1, 3000), (2000, 9000), (3500, 3600), (20000, 21000)]
    got = spark.read.format("variant_regions").option("path", str(tmp_path / "r.vcf.gz")).option("regions", ";".join(f"1:{a}-{b}" for a, b in some)).load()
    assert sorted(r.pos for r in got.collect()) == sorted(p for _, p, r, _ in records if any(p <= b and p + len(r) - 1 >= a for a, b in some))


def test_regions_of_several_files(spark, tmp_path):
    """Places, lengths and regions are such that both files have records in a region, and one has none in another."""
    own = {n: [("chr1", first + 700 * i, "ACG" if i % 9 == 0 else "A", "G") for i in range(120)] for n, first in (("a", 100), ("b", 60_000))}
    for n, records in own.items():
        indexed(tmp_path / f"{n}.vcf.gz", records)
    regions.register(spark)
    some = [(1, 900), (70_000, 75_000), (140_000, 150_000), (72_000, 76_000)]
    read = spark.read.format("variant_regions").option("regions", ";".join(f"1:{a}-{b}" for a, b in some))
    paths = [str(tmp_path / f"{n}.vcf.gz") for n in own]
    want = sorted(p for records in own.values() for _, p, r, _ in records if any(p <= b and p + len(r) - 1 >= a for a, b in some))
    assert sorted(r.pos for r in read.load(paths).collect()) == want
    assert sorted(r.pos for r in read.load(paths[:1]).collect()) == [p for p in want if p in {p for _, p, _, _ in own["a"]}]
    with pytest.raises(Exception, match="beside it"):
        read.option("index", paths[0] + ".tbi").load(paths).collect()


def test_regions_from_filters(spark, tmp_path):
    records = [("chr1", 100 + 700 * i, "A", "G") for i in range(200)]
    indexed(tmp_path / "r.vcf.gz", records)
    regions.register(spark)
    read = lambda: spark.read.format("variant_regions").option("path", str(tmp_path / "r.vcf.gz")).load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = read().where("chrom = '1' AND pos >= 30000 AND pos < 60000")
        assert sorted(r.pos for r in got.collect()) == [p for _, p, *_ in records if 30000 <= p < 60000]
        assert got.rdd.getNumPartitions() <= 2
        assert read().where("chrom = '9'").count() == 0 and read().where("chrom = '1' AND pos > 5 AND pos < 3").count() == 0
        with pytest.raises(Exception, match="name regions"):
            read().collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def block(data):
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def indexed(path, records):
    """A block-gzip file of the records and its index, as the format says."""
    out, chunks, linear, at = b"", {}, {}, 0
    buf, start = b"", 0
    places = []
    for c, p, r, a in records:
        line = f"{c}\t{p}\t.\t{r}\t{a}\t.\tPASS\t.\tGT\t0/1\n".encode()
        places.append((at << 16 | len(buf), p, r))
        buf += line
        if len(buf) > 400:  # lines may cross blocks
            out += block(buf[:390])
            buf, at = buf[390:], len(out)
            rest = buf
    out += block(buf)
    end = len(out) << 16
    # virtual offsets of lines that fell over a block's end
    fixed, blocks, pos, text = [], [], 0, b""
    while pos < len(out):
        size = struct.unpack("<H", out[pos + 16 : pos + 18])[0] + 1
        data = zlib.decompress(out[pos : pos + size], 31)
        blocks.append((pos, len(text), len(data)))
        text += data
        pos += size
    offset = 0
    for (_, p, r), line in zip(places, text.splitlines(keepends=True), strict=True):
        virtual = next(b << 16 | offset - s for b, s, n in blocks if s <= offset < s + n)
        fixed.append((virtual, p, r))
        offset += len(line)
    for i, (v, p, r) in enumerate(fixed):
        nxt = fixed[i + 1][0] if i + 1 < len(fixed) else end
        b = [x for x in regions.bins(p - 1, p - 1 + len(r)) if x >= 4681 or len(regions.bins(p - 1, p - 1 + len(r))) > 6][-1]
        chunks.setdefault(b, []).append((v, nxt))
        for w in range((p - 1) >> 14, ((p + len(r) - 2) >> 14) + 1):
            linear.setdefault(w, v)
    top = max(linear) + 1
    lin, last = [], 0
    for w in range(top):
        last = linear.get(w, last)
        lin.append(last)
    index = b"TBI\1" + struct.pack("<8i", 1, 2, 1, 2, 0, ord("#"), 0, 5) + b"chr1\0" + struct.pack("<i", len(chunks))
    for b, own in chunks.items():
        index += struct.pack("<Ii", b, len(own)) + b"".join(struct.pack("<QQ", *c) for c in own)
    index += struct.pack("<i", top) + struct.pack(f"<{top}Q", *lin)
    path.write_bytes(out + block(b""))
    path.with_suffix(path.suffix + ".tbi").write_bytes(gzip.compress(index))


@pytest.mark.parametrize(("start", "end"), [(1, 200000), (800, 800), (801, 802), (50000, 90000), (139400, 139401), (150000, 160000)])
def test_region_source(spark, tmp_path, start, end, monkeypatch):
    records = [("chr1", 100 + 700 * i, "A" if i % 5 else "ACG", "G") for i in range(200)]
    path = tmp_path / "r.vcf.gz"
    indexed(path, records)
    regions.register(spark)
    got = spark.read.format("variant_regions").option("path", str(path)).option("regions", f"1:{start}-{end}").load()
    assert sorted((r.pos, r.ref) for r in got.collect()) == sorted((p, r) for _, p, r, _ in records if p <= end and p + len(r) - 1 >= start)


def test_region_bins():
    assert regions.bins(0, 1) == [0, 1, 9, 73, 585, 4681]
    assert regions.bins(16383, 16385)[-2:] == [4681, 4682]


def test_a_table_of_regions_reads_its_byte_ranges_only(spark, tmp_path):
    records = [("chr1", 100 + 700 * i, "A" * (3000 if i % 50 == 3 else 1), "G") for i in range(400)]
    path = tmp_path / "r.vcf.gz"
    indexed(path, records)
    some = [("1", 1, 3000), ("chr1", 2000, 9000), ("1", 3500, 3600), ("1", 200_000, 210_000), ("1", 260_000, 250_000), ("2", 1, 9), ("1", 900_000, 900_001), (None, 1, 2)]
    table = spark.createDataFrame(some, "chrom string, st long, en long")
    want = sorted(p for _, p, r, _ in records if any(c in ("1", "chr1") and p <= b and p + len(r) - 1 >= a for c, a, b in some if a <= b))
    for task_bytes in (100, 1 << 20):
        assert sorted(r.pos for r in regions.read_regions(regions.one_file(spark, str(path)), table, task_bytes).collect()) == want
    ranges = regions.byte_ranges(table, regions.index_rows(regions.one_file(spark, str(path))), gap=0).collect()
    assert 0 < sum(r.bytes for r in ranges) < path.stat().st_size / 2 and len(ranges) >= 2
    assert regions.read_regions(regions.one_file(spark, str(path)), table.where("false")).count() == 0


def test_indexed_files_written_are_read_by_regions(spark, tmp_path):
    import random

    rng = random.Random(6)
    rows = [(rng.choice(["1", "2", "X"]), rng.randrange(1, 300_000), f"v{i}", "A" * rng.choice([1, 1, 2, 40_000]), "G", ".", "PASS", "X=1", "GT", "0/1") for i in range(900)]
    files = regions.write_indexed(spark.createDataFrame(rows, regions.SCHEMA), str(tmp_path / "w"), 100_000).collect()
    assert sum(f.n for f in files) == 900 and len(files) == 9
    table = spark.createDataFrame([(f["path"], f["index"]) for f in files], "path string, index string")
    some = [("1", 1, 20_000), ("X", 150_000, 150_500), ("X", 150_400, 160_000), ("2", 299_000, 400_000), ("3", 1, 9)]
    got = regions.read_regions(table, spark.createDataFrame(some, "chrom string, st long, en long"))
    assert sorted(r.id for r in got.collect()) == sorted(v for c, p, v, r, *_ in rows if any(c == d and p <= e and p + len(r) - 1 >= s for d, s, e in some))
    regions.register(spark)
    one = next(f for f in files if f.chrom == "2")  # the source takes them too
    read = spark.read.format("variant_regions").option("path", one.path).option("regions", "2:1-400000").load()
    assert read.count() == one.n


def test_records_of_regions_are_not_taken_to_be_few(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("'1' AS chrom", "id + 1 AS pos", "'x' AS id", "'A' AS ref", "'G' AS alt", "'.' AS qual", "'PASS' AS filter", "concat('X=', id) AS info", "'GT' AS format", "'0/1' AS sample")
    files = regions.write_indexed(rows, str(tmp_path / "w"))
    read = regions.read_regions(files.select("path", "index"), spark.createDataFrame([("1", 1, 20_000)], "chrom string, st long, en long"))
    assert read.count() == 20_000
    assert int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 20_000  # else a join broadcasts them


def test_tasks_write_a_bounded_number_of_records_of_a_stretch(spark, tmp_path):
    rows = spark.range(3000).selectExpr("'1' AS chrom", "1 + id % 500 AS pos", "concat('v', id) AS id", "'AC' AS ref", "concat('G', id) AS alt", "'.' AS qual", "'PASS' AS filter", "'X=1' AS info", "'GT' AS format", "'0/1' AS sample")
    files = regions.write_indexed(rows, str(tmp_path / "w"), file_rows=300)
    assert max(f.n for f in files.collect()) < 1000 and sum(f.n for f in files.collect()) == 3000
    read = regions.read_regions(files.select("path", "index"), spark.createDataFrame([("1", 100, 100)], "chrom string, st long, en long"))
    assert sorted(r.id for r in read.collect()) == sorted(f"v{i}" for i in range(3000) if 1 + i % 500 in (99, 100))


@pytest.mark.parametrize("cuts", [[], [1, 2, 9], [400, 401, 1500]])
def test_indexed_files_are_written_from_whole_batches(tmp_path, cuts):
    import gzip
    import random

    import numpy as np

    def smallest(start, end):
        return next(first + (start >> shift) for first, shift in reversed(regions.LEVELS) if start >> shift == (end - 1) >> shift)

    rng = random.Random(len(cuts))
    rows = sorted((rng.choice([1, 5, rng.randrange(1, 400_000)]), "A" * rng.choice([0, 1, 1, 3, 40_000]), i) for i in range(2000))
    lines = [f"1\t{p}\té{i}\t{r}\n".encode() for p, r, i in rows]
    file = regions.IndexedFile(str(tmp_path / "f.vcf.gz"), "1")
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        file.add(np.array([p for p, *_ in rows[a:b]]), np.array([len(r) for _, r, _ in rows[a:b]]), np.array([len(x) for x in lines[a:b]]), b"".join(lines[a:b]))
    with gzip.open(file.close()) as index:
        contig = regions.read_index(index.read())["1"]
    assert gzip.open(tmp_path / "f.vcf.gz").read() == b"".join(lines)
    with open(tmp_path / "f.vcf.gz", "rb") as f:
        # each bin's chunks hold the records of that bin, in order
        for b, chunks in contig.chunks.items():
            own = [x for (p, r, _), x in zip(rows, lines, strict=True) if smallest(p - 1, p - 1 + max(1, len(r))) == b]
            assert [x + b"\n" for c in chunks for x in regions.lines(f, *c)] == own
        for w, first in enumerate(contig.linear):
            met = [x for (p, r, _), x in zip(rows, lines, strict=True) if (p - 1) >> 14 <= w <= (p - 2 + max(1, len(r))) >> 14]
            if met:
                assert next(regions.lines(f, first, 1 << 60)) + b"\n" == met[0]


def bgzip(text: bytes, size: int) -> bytes:
    return b"".join(block(text[i : i + size]) for i in range(0, len(text), size)) + block(b"")


@pytest.mark.parametrize(("size", "split"), [(97, 100), (97, 333), (390, 1000), (5000, 64), (60000, 1 << 20)])
def test_block_gzip_is_split_anywhere(spark, tmp_path, size, split):
    import random

    from evidra.sources import blocks

    rng = random.Random(size)
    lines = ["".join(rng.choice("ACGT\t.:é") for _ in range(rng.choice([0, 1, 30, 96, 97, 98, 400]))) for _ in range(300)]
    text = "\n".join(lines).encode()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.gz").write_bytes(bgzip(text + b"\n", size))
    (tmp_path / "f" / "b.gz").write_bytes(bgzip(text + b"\nno newline at the end", size))
    one = blocks.read_lines(spark, str(tmp_path / "f" / "a.gz"), split)
    assert [r.value for r in one.collect()] == lines
    both = blocks.read_lines(spark, str(tmp_path / "f"), split)
    assert [r.value for r in both.collect()] == lines + lines + ["no newline at the end"]
    assert split > 1000 or one.rdd.getNumPartitions() > 5
    (tmp_path / "x.gz").write_bytes(gzip.compress(text * 40, 1))
    with pytest.raises(Exception, match="block"):
        blocks.read_lines(spark, str(tmp_path / "x.gz"), 64).collect()


def test_variants_of_block_gzip_equal_the_plain_read(spark, tmp_path):
    text = vcf_text(RECORDS * 5)
    (tmp_path / "a.vcf.gz").write_bytes(bgzip(text.encode(), 777))
    plain, split = tables.read_vcf(spark, str(tmp_path / "a.vcf.gz")), tables.read_vcf(spark, str(tmp_path / "a.vcf.gz"), split_bytes=500)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, split.collect()), key=str) and split.rdd.getNumPartitions() > 10
    single = tables.read_vcf(spark, str(tmp_path / "a.vcf.gz"), split_alleles=False)
    assert single.count() == sum("," not in a for *_, a in RECORDS * 5)


def test_block_gzip_files_written(spark, tmp_path):
    from evidra.sources import blocks

    rows = spark.range(0, 30_000, 1, 3).selectExpr("concat('line ', id, ' ', repeat('x', id % 50)) AS value")
    files = blocks.write_lines(rows, str(tmp_path / "w")).collect()
    assert len(files) == 3 and sum(f.n for f in files) == 30_000
    got = blocks.read_lines(spark, str(tmp_path / "w"), 20_000)
    assert sorted(r.value for r in got.collect()) == sorted(r.value for r in rows.collect())
    assert gzip.decompress(open(files[0].path, "rb").read()).count(b"\n") == files[0].n
    assert blocks.write_lines(rows.where("false"), str(tmp_path / "e")).count() == 0
