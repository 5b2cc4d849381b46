"""Readers of the text formats, typed once at the source. Every value spelled empty or with a dot reads as null only where
a function says so; columns stay strings else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.fields import bare_contig, known
from evidra.sources.blocks import read_lines
from evidra.sources.lines import numbered

VCF = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample")


def read_vcf(spark: SparkSession, path: str, partitions: int | None = None, split_alleles: bool = True, split_bytes: int | None = None) -> DataFrame:
    """Records of a variant file, or a folder of them, with one sample: contigs without chr, one row per alternate allele, or only
    records with one where split_alleles is false. split_bytes: a block-gzip file, read by a task for so many of its bytes. A gzip file is read
    by one task else; partitions deals its rows out after parsing."""
    rows = vcf_records(spark.read.text(path) if split_bytes is None else read_lines(spark, path, split_bytes))
    rows = rows.withColumn("alt", F.explode(F.split("alt", ","))) if split_alleles else rows.where(~F.contains("alt", F.lit(",")) & (F.col("alt") != "."))
    return rows.repartition(partitions, "chrom", "pos") if partitions else rows


def vcf_records(lines: DataFrame) -> DataFrame:
    """The typed columns of lines of records with one sample; headers and short lines are left out."""
    f = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#")) & (F.size(f) >= 10)).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(VCF)])
    return rows.withColumns({"chrom": bare_contig(F.col("chrom")), "pos": F.col("pos").try_cast("long"), "qual": known(F.col("qual")).try_cast("double")}).where("pos IS NOT NULL")


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """kind (reference, contig, source, FORMAT, INFO, samples) and value of the header lines."""
    h = spark.read.text(path).where(F.startswith("value", F.lit("#")))
    kind = F.regexp_extract("value", "^##(reference|contig|source|FORMAT|INFO)=", 1)
    value = F.when(kind.isin("contig", "FORMAT", "INFO"), F.regexp_extract("value", "ID=([^,>]+)", 1)).otherwise(F.regexp_extract("value", "^##[^=]+=(.*)$", 1))
    meta = h.where(kind != "").select(kind.alias("kind"), value.alias("value"))
    samples = h.where(F.startswith("value", F.lit("#CHROM"))).select(F.lit("samples").alias("kind"), F.greatest(F.size(F.split("value", "\t")) - 9, F.lit(0)).cast("string").alias("value"))
    return meta.unionByName(samples)


def read_tsv(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A headered table, all columns strings."""
    return spark.read.option("header", True).option("sep", sep).option("quote", "").csv(path)


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """A headered table whose separator, tab or comma, its first line shows."""
    first = spark.read.text(path).limit(1).collect()
    sep = "\t" if first and "\t" in first[0].value else ","
    return spark.read.option("header", True).option("sep", sep).csv(path)


def read_gene_summary(spark: SparkSession, path: str) -> DataFrame:
    """gene, chrom, st, en, transcript from a summary table by column name; of repeated symbols the last row, in the order of
    files and lines."""
    rows = numbered(read_tsv(spark, path), "_line")
    cols = {"chrom": F.col("GRCh38_chr"), "st": F.col("chr_start").try_cast("long"), "en": F.col("chr_end").try_cast("long"), "transcript": F.col("RefSeq_nuc")}
    last = rows.groupBy(F.col("symbol").alias("gene")).agg(F.max_by(F.struct(*[c.alias(n) for n, c in cols.items()]), "_line").alias("r"))
    return last.select("gene", "r.*")


def attribute(attrs: Column, key: str) -> Column:
    return known(F.regexp_extract(attrs, f"(?:^|;){key}=([^;]*)", 1))


def read_gff(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("exon", "CDS")) -> DataFrame:
    """acc, gene, chrom accession, strand, kind, st, en of exon and CDS lines."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.size(f) >= 9) & F.get(f, F.lit(2)).isin(*kinds))
    a = F.get(f, F.lit(8))
    return rows.select(
        F.regexp_replace(attribute(a, "Parent"), "^rna-", "").alias("acc"), attribute(a, "gene").alias("gene"), F.get(f, F.lit(0)).alias("chrom_acc"), F.get(f, F.lit(6)).alias("strand"),
        F.get(f, F.lit(2)).alias("kind"), F.get(f, F.lit(3)).try_cast("long").alias("st"), F.get(f, F.lit(4)).try_cast("long").alias("en"),
    )


def transcripts(gff: DataFrame) -> DataFrame:
    """acc, gene, chrom_acc, strand, exons and cds as sorted arrays of (st, en)."""
    spans = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("st", "en"))))
    return gff.groupBy("acc", "gene", "chrom_acc", "strand").agg(spans("exon").alias("exons"), spans("CDS").alias("cds"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """acc (a header's first token), seq (its lines joined, upper case). One row a record."""
    r = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    lines = F.split("value", "\r?\n")
    return r.select(F.get(F.split(F.get(lines, F.lit(0)), r"\s+"), F.lit(0)).alias("acc"), F.upper(F.regexp_replace(F.concat_ws("", F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), r"\s", "")).alias("seq"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """gene, place: names, one a line, with their lines' numbers; # starts a comment."""
    rows = numbered(spark.read.text(path), "place")
    return rows.select(F.trim(F.regexp_replace("value", "#.*", "")).alias("gene"), "place").where("gene <> ''")


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """name, genes (upper case, weights cut off) of a set library; an empty one is an error."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 3).select(
        F.trim(F.get(f, F.lit(0))).alias("name"), F.filter(F.transform(F.slice(f, 3, F.size(f)), lambda g: F.upper(F.trim(F.get(F.split(g, ","), F.lit(0))))), lambda g: g != "").alias("genes")
    )
    if rows.isEmpty():
        raise ValueError(f"{path} holds no gene set")
    return rows


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_signature_hits(spark: SparkSession, path: str) -> DataFrame:
    """Cached hits of a signature search: sig_id, pert_desc, pert_id, cell_id, score."""
    return read_json_lines(spark, path, "sig_id string, pert_desc string, pert_id string, cell_id string, score double")


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    """Cached answers on compounds: query, molecules with their names and highest phases."""
    return read_json_lines(spark, path, "query string, molecules array<struct<pref_name string, max_phase string>>")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Cached nested answers on targets, an error in one fails the read: symbol, effects, tractability, interactions."""
    rows = read_json_lines(
        spark, path, "symbol string, errors array<string>, effects array<double>, tractability array<struct<modality string, value boolean>>, interactions array<struct<drug string, approved boolean, types array<string>>>"
    )
    return rows.where(F.when(F.size("errors") > 0, F.raise_error(F.concat(F.lit("an answer is an error: "), F.get("errors", F.lit(0)))).cast("boolean")).otherwise(F.lit(True))).drop("errors")


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, length of the files below path whose name matches; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").where(F.col("path").rlike(pattern))


def file_blobs(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """blob (sha256 of the content), path, length, content of the files below path whose name matches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("path").rlike(pattern))
    return files.select(F.sha2("content", 256).alias("blob"), "path", "length", "content")


def distinct_blobs(blobs: DataFrame, key: str = "blob", path: str = "path") -> DataFrame:
    """A row for each content: of equal ones that with the smallest path, and n, how many there are."""
    others = [c for c in blobs.columns if c not in (key, path)]
    own = blobs.groupBy(key).agg(F.min_by(F.struct(*others, path), path).alias("_b"), F.count("*").alias("n"))
    return own.select(key, *[F.col(f"_b.{c}").alias(c) for c in (path, *others)], "n")


def swept_files(files: DataFrame, folders: DataFrame, pattern: str) -> DataFrame:
    """kind, path, length, n: each listed folder (folder) that has files with the size and number of all below it, and each file (path,
    length) that matches and lies below none of them. A file meets the folders by its path's prefixes, in an equi join, so a folder with a
    longer name is not taken for one below."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))
    names = folders.select(F.regexp_replace("folder", "/+$", "").alias("folder")).distinct()
    below = files.where(F.size(parts) > 1).select("path", "length", F.explode(F.array_distinct(above)).alias("folder")).join(names, "folder")
    sizes = below.groupBy("folder").agg(F.sum("length").alias("length"), F.count("*").alias("n"))
    alone = files.where(F.col("path").rlike(pattern)).join(below.select("path"), "path", "left_anti")
    return sizes.select(F.lit("folder").alias("kind"), F.col("folder").alias("path"), "length", "n").unionByName(alone.select(F.lit("file").alias("kind"), "path", "length", F.lit(1).cast("long").alias("n")))
