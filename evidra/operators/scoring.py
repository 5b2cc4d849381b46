"""Ranked lists: validation rules, rank points, the best F over thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.fields import known, normal_contig
from evidra.shared import cut


def best_f(scores: DataFrame) -> DataFrame:
    """threshold, precision, recall, f for the best F over score thresholds, of equal F the higher threshold. scores have
    item, score, truth; an item in several rows counts once, with its best score. Running sums go over distinct scores,
    in ranges whose totals are summed first, so no task sorts all rows; the ranges are written once, as they are read twice."""
    items = scores.where("score IS NOT NULL").groupBy("item").agg(F.max("score").alias("score"), F.max(F.col("truth").cast("int")).alias("truth"))
    by = items.groupBy("score").agg(F.sum("truth").alias("tp"), F.count("*").alias("k"))
    parts = cut(by.repartitionByRange(F.col("score").desc()).withColumn("_part", F.spark_partition_id()), "scores")
    totals = parts.groupBy("_part").agg(F.sum("tp").alias("t"), F.sum("k").alias("c"))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = totals.select("_part", F.coalesce(F.sum("t").over(order), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(order), F.lit(0)).alias("c0"))
    own = Window.partitionBy("_part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = parts.join(F.broadcast(before), "_part").select("score", (F.sum("tp").over(own) + F.col("t0")).alias("tp"), (F.sum("k").over(own) + F.col("c0")).alias("called"))
    positives = items.agg(F.sum("truth").alias("p"))
    f = run.crossJoin(F.broadcast(positives)).where("p > 0").select(
        F.col("score").alias("threshold"), (F.col("tp") / F.col("called")).alias("precision"), (F.col("tp") / F.col("p")).alias("recall"), (2 * F.col("tp") / (F.col("called") + F.col("p"))).alias("f")
    )
    return f.orderBy(F.col("f").desc(), F.col("threshold").desc()).limit(1)


def rank_points(rank: Column, overlap: Column, full: Column) -> Column:
    """100, 50, 25 or 10 points for ranks 1, 2-3, 4-5 and 6-10; half for a partial match; 0 beyond or without a match."""
    points = F.when(rank == 1, 100.0).when(rank <= 3, 50.0).when(rank <= 5, 25.0).when(rank <= 10, 10.0).otherwise(0.0)
    return F.when(full, points).when(overlap, points / 2).otherwise(0.0)


def ranked(df: DataFrame, by: str, score: str, tie: str, most: int) -> DataFrame:
    """The best rows of each group, by score, then tie."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), tie))
    return df.withColumn("rank", n).where(F.col("rank") <= most)


#: What a row may call its finding.
FINDINGS = ("primary", "secondary", "incidental")


def problems() -> Column:
    """All problems of a submitted row, as codes."""
    two = [known(F.col(c)).isNotNull() for c in ("chrom_2", "pos_2")]
    rules = {
        "contig_1": normal_contig(F.col("chrom_1")).isNull(),
        "position_1": F.coalesce(F.col("pos_1").try_cast("long"), F.lit(0)) < 1,
        "ref_1": ~F.coalesce(F.col("ref_1").rlike("^[ACGT]+$"), F.lit(False)),
        "alt_1": ~F.coalesce(F.col("alt_1").rlike("^[ACGT]+$"), F.lit(False)),
        "same_alleles": F.coalesce(F.col("ref_1") == F.col("alt_1"), F.lit(False)),
        "half_second": two[0] != two[1],
        "contig_2": two[0] & normal_contig(F.col("chrom_2")).isNull(),
        "score": ~F.coalesce((F.col("epcr") > 0) & (F.col("epcr") <= 1), F.lit(False)),
        "finding": ~F.coalesce(known(F.col("finding_type")), F.lit("primary")).isin(*FINDINGS),
    }
    return F.filter(F.array(*[F.when(bad, code) for code, bad in rules.items()]), lambda x: x.isNotNull())


def validate(rows: DataFrame, most: int = 10, group: str = "proband") -> DataFrame:
    """line, code for each problem of a row; then for each group too_many rows and tied_score warnings, line null."""
    each = rows.select(group, "line", F.explode(problems()).alias("code"))
    size = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > most).select(group, F.lit(None).cast("long").alias("line"), F.lit("too_many").alias("code"))
    ties = rows.groupBy(group, "epcr").agg(F.count("*").alias("n")).where("n > 1").select(group, F.lit(None).cast("long").alias("line"), F.lit("tied_score").alias("code"))
    return each.unionByName(size).unionByName(ties)
