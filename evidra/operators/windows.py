"""Positional windows: tumbling sums, normalisation by a global median, runs of consecutive windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.fields import AUTOSOME
from evidra.functions.ranks import ordered_statistic


def global_upper_median(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row, with null where df has none."""
    return ordered_statistic(df.select(F.lit(0).alias("_all"), value), ["_all"], value, F.expr("n div 2"), name).agg(F.first(name).alias(name))


def balance_windows(rows: DataFrame, width: int) -> DataFrame:
    """chrom, start, n, het, observed, expected, depth by window of width: rows have chrom, pos, dp, altdp, het. Over heterozygous
    rows observed sums |alt/dp - 1/2|, expected what chance alone gives, sqrt(2/pi) * 0.5 / sqrt(dp); depth sums all rows."""
    start = F.expr(f"pos div {width} * {width}").alias("start")
    obs = F.abs(F.col("altdp") / F.col("dp") - 0.5)
    exp = F.lit((2 / 3.141592653589793) ** 0.5 * 0.5) / F.sqrt("dp")
    return rows.groupBy("chrom", start).agg(F.count("*").alias("n"), F.count_if("het").alias("het"), F.sum(F.when(F.col("het"), obs)).alias("observed"), F.sum(F.when(F.col("het"), exp)).alias("expected"), F.sum("dp").alias("depth"))


def excess(windows: DataFrame, min_het: int, min_sites: int = 500) -> DataFrame:
    """Windows with enough sites: balance excess over the upper median of the autosomes' windows (1 if there is none), and mean depth
    over that of the autosomes' windows of at least min_sites (null if there is none). The medians are one row; no window is lost."""
    mean_dp = F.col("depth") / F.col("n")
    depths = windows.where(F.col("chrom").rlike(AUTOSOME) & (F.col("n") >= min_sites)).select(mean_dp.alias("mean_dp"))
    kept = windows.where((F.col("het") >= min_het) & (F.col("expected") > 0)).select("chrom", "start", "het", (F.col("observed") / F.col("expected")).alias("excess"), mean_dp.alias("mean_dp"))
    base = global_upper_median(kept.where(F.col("chrom").rlike(AUTOSOME)), "excess", "base_excess").crossJoin(global_upper_median(depths, "mean_dp", "base_dp"))
    over = F.col("excess") / F.coalesce("base_excess", F.lit(1.0))
    return kept.crossJoin(F.broadcast(base)).select("chrom", "start", "het", over.alias("excess_norm"), (F.col("mean_dp") / F.col("base_dp")).alias("cov_ratio"))


def mosaic_call(excess_: Column, cov: Column, min_excess: float = 1.25, band: float = 0.08) -> Column:
    """gain, loss or flat for windows with excess; null else."""
    return F.when(excess_ >= min_excess, F.when(cov >= 1 + band, "gain").when(cov <= 1 - band, "loss").otherwise("flat"))


def runs(df: DataFrame, by: list[str], index: Column, least: int, value: str | None = None) -> DataFrame:
    """Maximal runs of consecutive indices in each group, of at least a number of rows: by, first, last, n (and the sum
    and mean of value). Indices of a group are distinct."""
    rows = df.withColumn("_i", index)
    island = F.col("_i") - F.row_number().over(Window.partitionBy(*by).orderBy("_i"))
    extra = [F.sum(value).alias("total"), F.avg(value).alias("mean")] if value else []
    out = rows.withColumn("_island", island).groupBy(*by, "_island").agg(F.min("_i").alias("first"), F.max("_i").alias("last"), F.count("*").alias("n"), *extra)
    return out.where(F.col("n") >= least).drop("_island")


def dose_verdict(cov: Column, excess_: Column) -> Column:
    """Five classes that exclude each other: gain, loss, mosaic_gain, mosaic_loss, normal."""
    return (
        F.when(cov >= 1.35, "gain").when(cov <= 0.65, "loss").when((cov >= 1.08) & (excess_ >= 1.25), "mosaic_gain").when((cov <= 0.92) & (excess_ >= 1.25), "mosaic_loss").otherwise("normal")
    )


def cell_share(shift: Column, kind: Column) -> Column:
    """Share of cells with one copy more or less, from the allele balance's shift from one half; null outside 0 to 1."""
    share = F.when(kind == "gain", 4 * shift / (1 - 2 * shift)).when(kind == "loss", 4 * shift / (1 + 2 * shift))
    return F.when(share.between(0, 1), share)
