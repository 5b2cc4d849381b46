"""Order statistics with the exact conventions in use, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.shared import cut, drop


#: Rows of a group up to which its values are put in order in one task; of larger groups, ranges that hold the place are sought first.
SMALL = 100_000
#: Groups up to which what is known of them is broadcast to their rows; beyond it they are joined by shuffle.
FEW_GROUPS = 10_000
#: Ranges into which a group is split, after the first split.
RANGES = 16
ACCURACY = 10_000


def narrowed(rows: DataFrame, by: list[str], value: str, q: float, first: Column, last: Column) -> tuple[DataFrame, DataFrame | None]:
    """Of groups with over SMALL rows, only those rows whose values may stand at places first to last (from 0, of n): by, value; and by,
    n (of the whole group), _less (rows below those kept). A group's approximate quantiles split it into ranges, whose rows are counted
    exactly; the ranges that hold the places are split again, until few rows are left or all have one value. Only a row for each group and
    range is shuffled. The second table is null where no group is large."""
    sizes = cut(rows.groupBy(*by).agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > SMALL)
    if large.isEmpty():
        drop(sizes)
        return rows, None
    state = cut(large.select(*by, "n", F.lit(0).cast("long").alias("_less"), F.col("n").alias("_in"), F.lit(None).cast(rows.schema[value].dataType).alias("_low"), F.lit(None).cast(rows.schema[value].dataType).alias("_high")), "ranges")
    drop(sizes)
    few = state.count() <= FEW_GROUPS
    near = [max(0.0, q - 3 / ACCURACY), min(1.0, q + 3 / ACCURACY)]
    within = (F.col("_low").isNull() | (F.col(value) >= F.col("_low"))) & (F.col("_high").isNull() | (F.col(value) <= F.col("_high")))
    side = lambda df: F.broadcast(df) if few else df
    while True:
        open_ = state.where((F.col("_in") > SMALL) & (F.col("_low").isNull() | (F.col("_low") < F.col("_high"))))
        if open_.isEmpty():
            break
        cur = rows.join(side(open_), by).where(within)
        splits = cut(cur.groupBy(*by).agg(F.percentile_approx(value, near, ACCURACY).alias("_splits")), "splits")
        # a split's own value is a range for itself, so each round leaves fewer rows or one value
        over = [(F.col(value) > F.get("_splits", F.lit(i))).cast("int") + (F.col(value) >= F.get("_splits", F.lit(i))).cast("int") for i in range(len(near))]
        cell = sum(over[1:], over[0])
        cells = cur.join(side(splits), by).groupBy(*by, "n", "_less", cell.alias("_cell")).agg(F.count("*").alias("_k"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        upto = F.sum("_k").over(Window.partitionBy(*by).orderBy("_cell"))  # a row for each range
        held = cells.withColumn("_upto", F.col("_less") + upto).where((F.col("_upto") > first) & (F.col("_upto") - F.col("_k") <= last))
        found = held.groupBy(*by, "n").agg(F.min(F.col("_upto") - F.col("_k")).alias("_less"), F.sum("_k").alias("_in"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        after = cut(found.unionByName(state.join(open_.select(*by), by, "left_anti")), "ranges")
        drop(state, splits)
        state, near = after, [i / RANGES for i in range(1, RANGES)]
    kept = rows.join(side(state), by, "left").where(F.col("n").isNull() | within).select(*by, value)
    return kept, state.select(*by, "n", "_less")


def ordered_statistic(df: DataFrame, by: list[str], value: str, index: Column, name: str, q: float = 0.5, upto: Column | None = None) -> DataFrame:
    """by, name: the value at a place (from 0, an expression of n) of each group's ascending order; upto: the mean of the values at both
    places. q: about where the place is, as a share of n. Nulls in value or by have no place. No task holds more than about SMALL
    distinct values of a group: large groups are narrowed to the range of the place first."""
    last = index if upto is None else upto
    rows = df.select(*by, value).na.drop(subset=[*by, value])
    rows, large = narrowed(rows, by, value, q, index, last)
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_k"))
    own = Window.partitionBy(*by)
    run = counts.withColumn("_upto", F.sum("_k").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_k").over(own))
    if large is not None:
        of = F.broadcast(large) if large.count() <= FEW_GROUPS else large
        run = run.withColumnRenamed("n", "_own").join(of, by, "left").withColumn("n", F.coalesce("n", "_own")).withColumn("_upto", F.col("_upto") + F.coalesce("_less", F.lit(0)))
    at = lambda i: (F.col("_upto") > i) & (F.col("_upto") - F.col("_k") <= i)
    if upto is None:
        return run.where(at(index)).select(*by, F.col(value).alias(name))
    times = at(index).cast("int") + at(last).cast("int")
    return run.where(at(index) | at(last)).groupBy(*by).agg((F.sum(F.col(value) * times) / 2).alias(name))


def median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Mean of the two middles."""
    return ordered_statistic(df, by, value, F.expr("(n - 1) div 2"), name, 0.5, F.expr("n div 2"))


def upper_median(df: DataFrame, by: list[str], value: str, name: str = "upper_median") -> DataFrame:
    """sorted[n // 2]"""
    return ordered_statistic(df, by, value, F.expr("n div 2"), name)


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """sorted[int(q * (n - 1))]"""
    return ordered_statistic(df, by, value, F.floor(F.lit(q) * (F.col("n") - 1)), name, q)


def histogram(df: DataFrame, by: list[str], bin_: Column, bins: int) -> DataFrame:
    """by, bin, n for every bin from 0 to bins - 1, empty ones too; values beyond fall into the end bins."""
    clamped = F.greatest(F.lit(0), F.least(F.lit(bins - 1), bin_)).cast("int")
    counts = df.where(bin_.isNotNull()).groupBy(*by, clamped.alias("bin")).agg(F.count("*").alias("n"))
    keys = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    dense = keys.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return dense.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def log_bin(c: Column, low: float, high: float, bins: int) -> Column:
    """The bin of the decimal logarithm (of 1 at least) between low and high, towards nought."""
    return ((F.log10(F.greatest(c.cast("double"), F.lit(1.0))) - low) / (high - low) * bins).cast("int")


def histogram_median(hist: DataFrame, by: list[str]) -> DataFrame:
    """The first bin at which the running count reaches half of all."""
    own = Window.partitionBy(*by)
    run = hist.withColumn("_upto", F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(own))
    return run.where((F.col("_upto") * 2 >= F.col("_all")) & (F.col("_all") > 0)).groupBy(*by).agg(F.min("bin").alias("median_bin"))
