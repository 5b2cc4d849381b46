"""Expressions over the text fields of variant files: key=value bags, sample bags, genotypes, contig names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CANONICAL = "^(chr)?([1-9]|1[0-9]|2[0-2]|X|Y)$"
AUTOSOME = "^(chr)?([1-9]|1[0-9]|2[0-2])$"


def known(c: Column) -> Column:
    """Null for the spellings of no value: empty and a dot."""
    return F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("."))


def info_text(info: Column, key: str) -> Column:
    """The first value of key in a k=v;flag;... bag, or null."""
    return known(F.regexp_extract(info, f"(?:^|;){key}=([^;]*)", 1))


def info_number(info: Column, key: str, kind: str = "double") -> Column:
    return info_text(info, key).try_cast(kind)


def first_gene(info: Column) -> Column:
    """The first symbol of GENEINFO=symbol:id|symbol:id."""
    return known(F.regexp_extract(info, r"(?:^|;)GENEINFO=([^:;|]*)", 1))


def sample_value(format_: Column, sample: Column, key: str) -> Column:
    """A FORMAT key's value in the sample column; null for a key that is absent or beyond a short sample's end."""
    at = F.array_position(F.split(format_, ":"), key)
    return F.when(at > 0, known(F.get(F.split(sample, ":"), (at - 1).cast("int"))))


def zygosity(gt: Column) -> Column:
    """missing, hom_ref, hom_alt or het of a diploid genotype; missing for any other ploidy. gt occurs three times only: Catalyst
    writes the expression behind it out for each, and long generated methods are not compiled to machine code."""
    return F.when(gt.rlike("^0[/|]0$"), "hom_ref").when(gt.rlike(r"^([^./|]+)[/|]\1$"), "hom_alt").when(called(gt), "het").otherwise("missing")


def called(gt: Column) -> Column:
    """Two alleles, both known."""
    return gt.rlike("^[^./|]+[/|][^./|]+$")


def non_reference(gt: Column) -> Column:
    return called(gt) & ~gt.rlike("^0[/|]0$")


def bare_contig(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def normal_contig(chrom: Column) -> Column:
    """chr1 ... chr22, chrX, chrY, chrM, or null for any other name."""
    name = F.upper(F.trim(chrom))
    bare = F.when(F.startswith(name, F.lit("CHR")), F.substr(name, F.lit(4))).otherwise(name)
    return F.when(bare.isin(*[str(n) for n in range(1, 23)], "X", "Y"), F.concat(F.lit("chr"), bare)).when(bare.isin("M", "MT"), "chrM")


def accession_chrom(acc: Column) -> Column:
    """Chromosome of a RefSeq accession NC_0000nn: numbers, 23 X, 24 Y, 12920 MT; null else."""
    n = F.regexp_extract(acc, r"^NC_0*([0-9]+)\.[0-9]+$", 1).try_cast("int")
    return F.when(n == 23, "X").when(n == 24, "Y").when(n == 12920, "MT").when(n.between(1, 22), n.cast("string"))


def is_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1) & (alt != ".")


def variant_type(ref: Column, alt: Column) -> Column:
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNV").otherwise("indel")


def mentions(c: Column, word: str) -> Column:
    """Whether c holds the word; null does not."""
    return F.coalesce(F.contains(c, F.lit(word)), F.lit(False))


def starts_with_any(c: Column, *heads: str) -> Column:
    return c.rlike("^(" + "|".join(heads) + ")")


def contig_order(chrom: Column) -> list[Column]:
    """Sort keys: numbered contigs by number, then the others by name."""
    bare = bare_contig(chrom)
    return [bare.try_cast("int").asc_nulls_last(), bare.asc()]


def size_text(n: Column) -> Column:
    """Bytes in B, KB, MB or GB with one decimal; in whole numbers only, halves to even, so that no sum in doubles decides."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))

    def one_decimal(unit: int, name: str) -> Column:
        low, rest = div(n * 10, unit), 2 * (n * 10 % unit)
        tenths = low + F.when((rest > unit) | ((rest == unit) & (low % 2 == 1)), 1).otherwise(0)
        return F.concat(div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))

    sizes = [one_decimal(1024**k, name) for k, name in enumerate(("B", "KB", "MB", "GB"))]
    return F.when(n < 1024, sizes[0]).when(n < 1024**2, sizes[1]).when(n < 1024**3, sizes[2]).otherwise(sizes[3])


def thousands(n: Column) -> Column:
    """A whole number with dots between groups of three."""
    return F.translate(F.format_number(n, 0), ",", ".")
