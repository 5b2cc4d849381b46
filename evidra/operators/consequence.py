"""From a variant's gene to its effect on the protein: symbol, transcript, structure, sequence, codon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import sequence


def placed_exons(exons: DataFrame) -> DataFrame:
    """exons (acc, strand, st, en) with before: the transcript's length up to each, in the strand's order."""
    own = Window.partitionBy("acc").orderBy(F.when(F.col("strand") == "-", -F.col("st")).otherwise(F.col("st"))).rowsBetween(Window.unboundedPreceding, -1)
    return exons.withColumn("before", F.coalesce(F.sum(F.col("en") - F.col("st") + 1).over(own), F.lit(0)))


def offset(pos: Column) -> Column:
    """The place from 0 in the transcript of a position inside a placed exon."""
    return F.col("before") + F.when(F.col("strand") == "-", F.col("en") - pos).otherwise(pos - F.col("st"))


def coding_bounds(gff: DataFrame) -> DataFrame:
    """acc, cds_from, cds_len: where in the transcript the coding part begins, and its length, from exon and CDS rows."""
    cds = gff.where("kind = 'CDS'").groupBy("acc").agg(F.min("st").alias("cds_st"), F.max("en").alias("cds_en"), F.sum(F.col("en") - F.col("st") + 1).alias("cds_len"))
    first = F.when(F.col("strand") == "-", F.col("cds_en")).otherwise(F.col("cds_st"))
    exons = placed_exons(gff.where("kind = 'exon'")).join(cds, "acc").where(first.between(F.col("st"), F.col("en")))
    return exons.select("acc", offset(first).alias("cds_from"), "cds_len")


def protein_consequences(variants: DataFrame, symbols: DataFrame, gff: DataFrame, sequences: DataFrame) -> DataFrame:
    """vid, acc, number, kind, change of variants (vid, gene, pos, ref, alt) of one base in coding exons. symbols: gene,
    transcript; gff: acc, strand, kind, st, en; sequences: acc, seq. A variant whose gene, structure or sequence is missing, that lies
    outside the coding exons, or whose reference base is not the transcript's, has no row."""
    exons = placed_exons(gff.where("kind = 'exon'").select("acc", "strand", "st", "en"))
    v = variants.where((F.length("ref") == 1) & (F.length("alt") == 1)).join(symbols.select("gene", F.col("transcript").alias("acc")), "gene")
    v = v.join(exons, "acc").where(F.col("pos").between(F.col("st"), F.col("en"))).withColumn("tpos", offset(F.col("pos")))
    v = v.join(coding_bounds(gff), "acc").withColumn("cpos", F.col("tpos") - F.col("cds_from")).where("cpos >= 0 AND cpos < cds_len").join(sequences, "acc")
    v = v.withColumns({"b0": sequence.stranded(F.col("ref"), F.col("strand")), "b1": sequence.stranded(F.col("alt"), F.col("strand"))})
    v = v.where(F.substr("seq", (F.col("tpos") + 1).cast("int"), F.lit(1)) == F.col("b0")).withColumn("number", F.expr("cpos div 3 + 1"))
    codon = F.substr("seq", (F.col("cds_from") + (F.col("number") - 1) * 3 + 1).cast("int"), F.lit(3))
    v = v.withColumn("codon", codon).withColumn("mut", sequence.put_base(F.col("codon"), (F.col("cpos") % 3).cast("int"), F.col("b1")))
    v = v.withColumns({"aa0": sequence.amino_acid(F.col("codon")), "aa1": sequence.amino_acid(F.col("mut"))})
    return v.select("vid", "acc", "number", sequence.snv_class(F.col("aa0"), F.col("aa1")).alias("kind"), sequence.protein_change(F.col("aa0"), F.col("number"), F.col("aa1")).alias("change"))
