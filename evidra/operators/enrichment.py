"""Set enrichment: overlaps, hypergeometric tails, empirical nulls, consensus."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_items(a: DataFrame, b: DataFrame, item: str = "gene", left: str = "a", right: str = "b") -> DataFrame:
    """left, right, k for the pairs of sets with k > 0 shared items."""
    return a.select(left, item).distinct().join(b.select(right, item).distinct(), item).groupBy(left, right).agg(F.count("*").alias("k"))


def overlaps(a: DataFrame, b: DataFrame, item: str = "gene", left: str = "a", right: str = "b") -> DataFrame:
    """left, right, k shared items, for every pair of sets, zeros too. Pairs come from an equi join on the item; the
    zero fill crosses the names of sets only."""
    every = a.select(left).distinct().crossJoin(b.select(right).distinct())
    return every.join(shared_items(a, b, item, left, right), [left, right], "left").select(left, right, F.coalesce("k", F.lit(0)).cast("long").alias("k"))


def log_factorial(n: Column) -> Column:
    """ln(n!) as an expression without branches, to within 1e-11: Stirling's series for n + 8, less the logarithm of the eight
    factors too many. n from 0."""
    z = n.cast("double") + 8.0
    r = 1 / (z * z)
    series = (z + 0.5) * F.log(z) - z + math.log(2 * math.pi) / 2 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z
    factors = z * (z - 1) * (z - 2) * (z - 3) * (z - 4) * (z - 5) * (z - 6) * (z - 7)
    return series - F.log(factors)


#: Populations up to which differences of log_factorial are exact to about 1e-9.
SMALL_POPULATION = 1_000_000
#: What Stirling's formula lacks of ln(n!), for n from 0 to 15 (of 0 it isn't used).
LACKING = [0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)]


def stirling_lack(n: Column) -> Column:
    """ln(n!) less Stirling's formula."""
    r = 1 / (n.cast("double") * n)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / n
    return F.when(n < 16, F.get(F.array(*[F.lit(x) for x in LACKING]), n.cast("int"))).otherwise(series)


def deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, without cancellation where x is near mean."""
    v = (x - mean) / (x + mean)
    near = (x - mean) * v + 2 * x * v * sum((v ** (2 * j) / (2 * j + 1) for j in range(2, 9)), v * v / 3)
    return F.when(F.abs(x - mean) < 0.1 * (x + mean), near).otherwise(x * F.log(x / mean) + mean - x)


def log_binomial(x: Column, n: Column, share: Column, other: Column) -> Column:
    """ln of the chance of x successes of n at a share (other is 1 - share), from deviances: exact however large n is."""
    d = lambda c: c.cast("double")
    inner = stirling_lack(n) - stirling_lack(x) - stirling_lack(n - x) - deviance(d(x), n * share) - deviance(d(n - x), n * other) + 0.5 * F.log(d(n) / (2 * math.pi * d(x) * (n - x)))
    return F.when(n == 0, F.lit(0.0)).when(x == 0, n * F.log1p(-share)).when(x == n, n * F.log1p(-other)).otherwise(inner)


#: Terms that are in a row at once.
TERMS = 1024


def hypergeometric_tail(tests: DataFrame, population: int) -> DataFrame:
    """tests (with k, marked, drawn) with p = P(X >= k) and log_p, its natural logarithm: X of drawn items are marked, where marked
    of population are. Only the largest term is computed by logarithms; from there each term follows from its neighbour's, up
    and down, within the row. So log_p holds where p is too small for a double. Terms further from the largest than reach are less than
    1e-20 of it together, by Hoeffding's bound for n draws, n the smaller of marked and drawn: a share of over
    sqrt(n * (ln(n + 1) + 46) / 2) / n more than expected has a chance of at most exp(-46) / (n + 1), and the largest term is 1 / (n + 1) at least.
    They are left out, and those within are taken in runs of TERMS, so a row holds no more of them whatever the sizes."""
    k, marked, drawn, n = F.col("k"), F.col("marked"), F.col("drawn"), F.lit(population)
    few = F.least(marked, drawn).cast("double")
    rows = tests.withColumns({"_most": F.least(marked, drawn), "_least": F.greatest(k, marked + drawn - n, F.lit(0)), "_reach": F.ceil(F.sqrt(few * (F.log(few + 1) + 46) / 2)) + 2})
    mode = F.floor((marked + 1) * (drawn + 1) / (n + 2))
    rows = rows.withColumn("_mode", F.greatest(F.col("_least"), F.least(F.col("_most"), mode)))
    i, lf = F.col("_mode"), log_factorial
    if population <= SMALL_POPULATION:
        top = lf(marked) + lf(drawn) + lf(n - marked) + lf(n - drawn) - lf(n) - lf(i) - lf(marked - i) - lf(drawn - i) - lf(n - marked - drawn + i)
    else:
        share, other = drawn / n, (n - drawn) / n
        top = log_binomial(i, marked, share, other) + log_binomial(drawn - i, n - marked, share, other) - log_binomial(drawn, n, share, other)
    ratio = lambda i: (marked - i + 1).cast("double") * (drawn - i + 1) / (i * (n - marked - drawn + i))  # noqa: E731  of term i to term i - 1

    def total(count: Column, place: Callable[[Column], Column], onward: Callable[[Column, Column], Column]) -> Column:
        """The sum of count terms that follow one another from 1 at the mode; place gives the j-th one's, j from 1."""
        step = lambda x, j: F.struct(onward(x["t"], place(j)).alias("t"), (x["s"] + onward(x["t"], place(j))).alias("s"))
        run = lambda r: F.sequence(r * TERMS + 1, F.least(count, (r + 1) * TERMS))
        runs = F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / TERMS))
        none = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
        return F.when(count > 0, F.aggregate(runs, none, lambda x, r: F.aggregate(run(r), x, step))["s"]).otherwise(0.0)

    up = total(F.least(F.col("_most") - i, F.col("_reach")).cast("long"), lambda j: i + j, lambda t, i: t * ratio(i))
    down = total(F.least(i - F.col("_least"), F.col("_reach")).cast("long"), lambda j: i - j + 1, lambda t, i: t / ratio(i))
    log_p = F.when(F.col("_least") <= F.col("_most"), F.least(F.lit(0.0), top + F.log(1 + up + down))).otherwise(F.lit(-math.inf))
    return rows.withColumn("log_p", log_p).withColumn("p", F.exp("log_p")).drop("_most", "_least", "_mode", "_reach")


def null_share(tests: DataFrame, by: str, value: str, name: str = "share") -> DataFrame:
    """For each row the share of its group's rows whose value is at most its own. Counts of distinct values are summed
    before the running total."""
    counts = tests.groupBy(by, value).agg(F.count("*").alias("_k"))
    own = Window.partitionBy(by)
    upto = counts.withColumn(name, F.sum("_k").over(own.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)) / F.sum("_k").over(own)).drop("_k")
    return tests.join(upto, [by, value])


def share_of_others(tests: DataFrame, by: str, value: str, name: str = "p") -> DataFrame:
    """For each row the share of its group's other rows whose value is at least its own; null for a row alone."""
    n = F.sum("_k").over(Window.partitionBy(by))
    counts = tests.groupBy(by, value).agg(F.count("*").alias("_k"))
    above = F.sum("_k").over(Window.partitionBy(by).orderBy(F.col(value).desc()).rangeBetween(Window.unboundedPreceding, 0))
    return tests.join(counts.select(by, value, F.when(n > 1, (above - 1) / (n - 1)).alias(name)), [by, value])


def consensus(sets: DataFrame, least: int | None = None, group: str = "grp", item: str = "gene") -> DataFrame:
    """Items in all groups, or in at least some number of them, with that number."""
    n = sets.groupBy(item).agg(F.count_distinct(group).alias("n"))
    if least is not None:
        return n.where(F.col("n") >= least)
    every = sets.agg(F.count_distinct(group).alias("all"))
    return n.crossJoin(F.broadcast(every)).where("n = all").select(item, "n")
