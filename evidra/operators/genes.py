"""Per-gene decisions: sweep statistics, recessive and compound patterns, phase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions.fields import known, zygosity


def profile(variants: DataFrame) -> DataFrame:
    """Per contig: records, PASS, single-base changes, indels, heterozygous, homozygous, phased."""
    z, snv = zygosity(F.col("gt")), (F.length("ref") == 1) & (F.length("alt") == 1)
    return variants.groupBy("chrom").agg(
        F.count("*").alias("n"), F.count_if(F.col("filt") == "PASS").alias("n_pass"), F.count_if(snv).alias("n_snv"), F.count_if(~snv).alias("n_indel"),
        F.count_if(z == "het").alias("n_het"), F.count_if(z == "hom_alt").alias("n_hom"), F.count_if(F.contains("gt", F.lit("|"))).alias("n_phased"),
    )


def balance_profile(rows: DataFrame) -> DataFrame:
    """Per contig: mean depth, and the share of sites whose allele balance lies outside 0.4 to 0.6; rows have dp, altdp."""
    out = ~(F.col("altdp") / F.col("dp")).between(0.4, 0.6)
    return rows.groupBy("chrom").agg((F.sum("dp") / F.count("*")).alias("mean_depth"), F.avg(out.cast("int")).alias("outside"))


def sweep_statistics(hits: DataFrame, panel: DataFrame) -> DataFrame:
    """Counts for every gene of the panel, also those without a hit; hits have gene, filt, gt, pid."""
    z = zygosity(F.col("gt"))
    stats = hits.groupBy("gene").agg(
        F.count("*").alias("n"), F.count_if(F.col("filt") == "PASS").alias("n_pass"), F.count_if(z == "het").alias("n_het"),
        F.count_if(z == "hom_alt").alias("n_hom"), F.count_distinct(known(F.col("pid"))).alias("n_blocks"),
    )
    counts = [c for c in stats.columns if c != "gene"]
    return panel.select("gene").distinct().join(stats, "gene", "left").select("gene", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def recessive(hits: DataFrame) -> DataFrame:
    """Genes with a homozygous hit or two heterozygous ones; hits have gene, zyg, kind."""
    found = hits.groupBy("gene").agg(F.count_if(F.col("zyg") == "hom_alt").alias("hom"), F.count_if(F.col("zyg") == "het").alias("het"), F.array_sort(F.collect_set("kind")).alias("_kinds"))
    return found.where("hom >= 1 OR het >= 2").select("gene", "hom", "het", F.concat_ws(",", "_kinds").alias("kinds"))


def compound(hits: DataFrame) -> DataFrame:
    """The first pattern that holds for a gene: homozygous loss of function, two heterozygous ones, or one with a
    heterozygous missense change; other genes drop out. hits have gene, zyg, kind."""
    lof, mis = F.col("kind").isin("frameshift", "nonsense"), F.col("kind") == "missense"
    hom, het = F.col("zyg") == "hom_alt", F.col("zyg") == "het"
    found = hits.groupBy("gene").agg(F.count_if(lof & hom).alias("lof_hom"), F.count_if(lof & het).alias("lof_het"), F.count_if(mis & het).alias("missense_het"))
    pattern = F.when(F.col("lof_hom") > 0, "hom_lof").when(F.col("lof_het") >= 2, "compound_lof").when((F.col("lof_het") > 0) & (F.col("missense_het") > 0), "lof_missense")
    return found.withColumn("pattern", pattern).where("pattern IS NOT NULL")


def phase_blocks(rows: DataFrame, by: str = "pid", pos: str = "pos") -> DataFrame:
    """Blocks of at least two phased variants with their span; a dot is no block."""
    return rows.where(known(F.col(by)).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), (F.max(pos) - F.min(pos)).alias("span")).where("n >= 2")


def phase_verdict(rows: DataFrame) -> DataFrame:
    """Per gene: trans if a block holds both phases, cis if a block holds two variants of one phase only, separate if
    there are blocks of one variant, unphased without blocks. A dot is no block."""
    pid, pgt = known(F.col("pid")), known(F.col("pgt"))
    blocks = rows.select("gene", F.when(pgt.isNotNull(), pid).alias("pid"), pgt.alias("pgt")).groupBy("gene", "pid").agg(F.count("*").alias("k"), F.count_distinct("pgt").alias("d"))
    phased = F.col("pid").isNotNull()
    found = blocks.groupBy("gene").agg(
        F.bool_or(phased & (F.col("d") > 1)).alias("trans"), F.bool_or(phased & (F.col("k") > 1)).alias("cis"), F.count_if(phased).alias("blocks"), F.sum("k").alias("n")
    )
    return found.select("gene", "n", "blocks", F.when(F.col("trans"), "trans").when(F.col("cis"), "cis").when(F.col("blocks") > 0, "separate").otherwise("unphased").alias("verdict"))


def survival(verdicts: DataFrame, impacts: DataFrame) -> DataFrame:
    """The recessive ladder: two variants in cis are discarded; without an impact weak; in trans strong; else open."""
    n = impacts.groupBy("gene").agg(F.count_if("impact").alias("impacts"))
    outcome = F.when(F.col("verdict") == "cis", "discarded").when(F.col("impacts") == 0, "weak").when(F.col("verdict") == "trans", "strong").otherwise("open")
    return verdicts.join(n, "gene").select("gene", "verdict", "impacts", outcome.alias("outcome"))
