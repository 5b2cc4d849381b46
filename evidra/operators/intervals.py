"""Interval operators: one-winner interval joins, index bins, merging of spans.

Catalyst has no interval join. Here overlaps are resolved on the interval side first: each contig is cut into
segments, each with the one interval that wins there (a sweep by ranges of starts), so a point meets at most one segment and needs no shuffle to pick a
winner afterwards. Segments are spread over fixed bins, so the join is an equi join on (contig, bin) with a residual; it is
broadcast only where a bound of the segments, counted from the intervals, is low, and shuffled on (contig, bin) else.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.shared import cut
from evidra.ship import ship
from evidra.sources.regions import LEVELS

BIN = 1 << 14
#: Rows of the interval side up to which it is broadcast.
FEW = 500_000
#: Intervals that a task sweeps, more where that would be over so many ranges.
RANGE_ROWS, MOST_RANGES = 50_000, 4_096
#: Points that a task joins with all intervals that hold them.
MET = 250_000
#: Intervals, or points, whose stretches a task meets, and what names a stretch (its number sorts fastest).
SPANS, NODE = 50_000, ["_node", "_level", "chrom"]


def region_bins(start: Column, end: Column) -> Column:
    """All index bins that may hold records overlapping [start, end), 0-based."""
    last = end - 1
    return F.flatten(F.array(*[F.sequence(F.lit(first) + F.shiftright(start, shift), F.lit(first) + F.shiftright(last, shift)) for first, shift in LEVELS]))


def ranges(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own (chrom, s, e, ...) with range, as a table: stretches of each contig of about RANGE_ROWS intervals by their starts; and a row for each
    range: chrom, range, low (its first start), high (the next range's, or null)."""
    parts = max(1, min(MOST_RANGES, -(-own.count() // RANGE_ROWS)))
    if parts == 1:
        table = own.withColumn("range", F.lit(0))
        return table, table.groupBy("chrom", "range").agg(F.min("s").alias("low")).withColumn("high", F.lit(None).cast("long"))
    table = cut(own.repartitionByRange(parts, "chrom", "s").withColumn("range", F.spark_partition_id()), "intervals")
    lows = table.groupBy("chrom", "range").agg(F.min("s").alias("low"))
    # a row for each range
    return table, lows.withColumn("high", F.lead("low").over(Window.partitionBy("chrom").orderBy("low")))


def first_winners(own: DataFrame) -> DataFrame:
    """Where the smallest (s, e, name) wins. It wins wherever none before it in that order reaches, as those before start no later: from
    the greatest end before it on. Ends before a range are a running maximum over ranges."""
    table, bounds = ranges(own)
    tops = table.groupBy("chrom", "range").agg(F.max("e").alias("top")).join(bounds, ["chrom", "range"])
    before = tops.select("chrom", "range", F.max("top").over(Window.partitionBy("chrom").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)).alias("_upto"))
    inside = F.max("e").over(Window.partitionBy("chrom", "range").orderBy("s", "e", "name").rowsBetween(Window.unboundedPreceding, -1))
    rows = table.withColumn("_in", inside).join(F.broadcast(before), ["chrom", "range"])  # MOST_RANGES rows, and one for each contig
    rows = rows.withColumn("seg_st", F.greatest("s", F.coalesce(F.greatest("_in", "_upto") + 1, "s")))
    return rows.where("seg_st <= e").select("chrom", "seg_st", F.col("e").alias("seg_en"), "name")


def last_winners(own: DataFrame) -> DataFrame:
    """Where the greatest (s, e, name) wins, by a sweep of each range. Of one start only the greatest can win. Of those that start before a
    range, it meets those that end in it, of one end the greatest, and of those that go on beyond it the greatest only."""
    own = own.groupBy("chrom", "s").agg(F.max(F.struct("e", "name")).alias("w")).select("chrom", "s", "w.e", "w.name")
    table, bounds = ranges(own)
    lows = bounds.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("low", "range"))).alias("lows"))
    ends = table.join(F.broadcast(lows), "chrom").withColumn("_at", F.size(F.filter("lows", lambda x: x["low"] <= F.col("e"))))
    first = F.size(F.filter("lows", lambda x: x["low"] <= F.col("s")))
    ends = ends.withColumn("_from", first).withColumn("to", F.element_at("lows", F.col("_at"))["range"])
    key = F.max(F.struct("s", "e", "name")).alias("w")
    carried = ends.where("_at > _from").groupBy("chrom", F.col("to").alias("range"), F.col("e").alias("_e")).agg(key).select("chrom", "range", "w.*")
    spans = ends.where("_at > _from + 1").groupBy("chrom", "_from", "_at").agg(key, F.first("lows").alias("lows"))
    through = spans.select("chrom", "w", F.explode(F.slice("lows", F.col("_from") + 1, F.col("_at") - F.col("_from") - 1)).alias("l")).groupBy("chrom", F.col("l.range").alias("range")).agg(F.max("w").alias("w")).select("chrom", "range", "w.*")
    names = ["chrom", "range", "s", "e", "name"]
    rows = table.select(*names).unionByName(carried.select(*names)).unionByName(through.select(*names)).join(F.broadcast(bounds), ["chrom", "range"])
    out = T.StructType([table.schema["chrom"], T.StructField("seg_st", T.LongType()), T.StructField("seg_en", T.LongType()), table.schema["name"]])
    ship(own.sparkSession)
    return rows.groupBy("chrom", "range").applyInPandas(lambda pdf: swept(pdf), out)


def swept(pdf: pd.DataFrame) -> pd.DataFrame:
    """Segments of one range, each with the interval of the greatest (s, e, name) that holds it."""
    low, high = int(pdf["low"].iloc[0]), pdf["high"].iloc[0]
    last = int(pdf["e"].max()) if pd.isna(high) else int(high) - 1
    rows = sorted(zip(pdf["s"].tolist(), pdf["e"].tolist(), pdf["name"].tolist(), strict=True), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or ""))
    cuts = sorted({max(low, r[0]) for r in rows} | {r[1] + 1 for r in rows if r[1] < last})
    # starts only grow, so the greatest is the latest that is still open: a stack, whose ended tops go
    stack, at, found = [], 0, []
    for i, place in enumerate(cuts):
        while at < len(rows) and rows[at][0] <= place:
            stack.append(rows[at])
            at += 1
        while stack and stack[-1][1] < place:
            stack.pop()
        if stack:
            end = min(cuts[i + 1] - 1 if i + 1 < len(cuts) else last, stack[-1][1])
            found.append((place, end, stack[-1][2]))
    return pd.DataFrame({"chrom": [pdf["chrom"].iloc[0]] * len(found), "seg_st": [f[0] for f in found], "seg_en": [f[1] for f in found], "name": [f[2] for f in found]})


def winners(intervals: DataFrame, policy: str, name: str = "gene", start: str = "st", end: str = "en", chrom: str = "chrom") -> DataFrame:
    """Disjoint segments (chrom, seg_st, seg_en, name): of the intervals over a place, first_start takes the smallest
    (start, end, name) and last_start the greatest. However many intervals lie over a place, each is looked at a few times."""
    own = intervals.select(F.col(chrom).alias("chrom"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.col(name).alias("name")).where("s <= e AND chrom IS NOT NULL").distinct()
    found = {"first_start": first_winners, "last_start": last_winners}[policy](own)
    return found.withColumnRenamed("name", name)


def interval_join(points: DataFrame, intervals: DataFrame, policy: str = "first_start", how: str = "inner", name: str = "gene", pos: str = "pos", pad: int = 0, start: str = "st", end: str = "en") -> DataFrame:
    """points with the name of the winning interval that holds pos, both ends included, intervals widened by pad."""
    wide = intervals.withColumns({start: F.col(start) - pad, end: F.col(end) + pad})
    segments = winners(wide, policy, name, start, end)
    spread = segments.withColumn("_bin", F.explode(F.sequence(F.expr(f"seg_st div {BIN}"), F.expr(f"seg_en div {BIN}"))))
    # segments are disjoint: their rows by bin are at most the intervals' bins and three more for each interval
    most = wide.agg(F.sum(F.expr(f"greatest(0, {end} - {start}) div {BIN} + 3"))).first()[0] or 0
    if most <= FEW:
        spread = F.broadcast(spread)
    p = points.withColumn("_bin", F.expr(f"{pos} div {BIN}"))
    on = (p["chrom"] == spread["chrom"]) & (p["_bin"] == spread["_bin"]) & p[pos].between(F.col("seg_st"), F.col("seg_en"))
    return p.join(spread, on, how).select(*[p[c] for c in points.columns], spread[name])


def overlapping(points: DataFrame, intervals: DataFrame, name: str = "gene", pos: str = "pos", start: str = "st", end: str = "en") -> DataFrame:
    """points (a table, they are counted) with the name of each interval that holds pos, a row for each: an equi join on (contig, bin) with a
    residual. Both sides are dealt out by the number of points, as few become many, and merged: a task holds the intervals of a bin at most. A plan
    takes the rows by bin to be as few as the intervals and would broadcast them, and a hash table is slow where many share a bin."""
    spread = intervals.select(F.col("chrom").alias("_chrom"), F.col(start).alias("_st"), F.col(end).alias("_en"), name).where("_st <= _en")
    spread = spread.withColumn("_bin", F.explode(F.sequence(F.expr(f"_st div {BIN}"), F.expr(f"_en div {BIN}"))))
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, -(-points.count() // MET))
    p = points.withColumn("_at", F.expr(f"{pos} div {BIN}")).repartition(tasks, "chrom", "_at")
    spread = spread.repartition(tasks, "_chrom", "_bin").hint("merge")
    return p.join(spread, (p["chrom"] == spread["_chrom"]) & (p["_at"] == spread["_bin"]) & p[pos].between(F.col("_st"), F.col("_en"))).select(*[p[c] for c in points.columns], spread[name])


def node_counts(points: DataFrame, by: list[str], top: int, parts: int) -> DataFrame:
    """How many points (chrom, _pos, by, _k) of each group lie in each stretch of 1, 2, 4 ... 2^top places that holds any: chrom, _level, _node,
    by, _k, dealt out by stretch. Points are dealt out by bins first, within which a task counts whole stretches before they are shuffled."""
    rows = points.withColumn("_bin", F.expr(f"_pos div {BIN}")).repartition(parts, "chrom", "_bin").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    rows = rows.groupBy("chrom", "_bin", "_level", F.expr("shiftright(_pos, _level)").alias("_node"), *by).agg(F.sum("_k").alias("_k"))
    return rows.repartition(parts, *NODE).groupBy(*NODE, *by).agg(F.sum("_k").alias("_k"))


def overlap_counts(points: DataFrame, intervals: DataFrame, by: list[str], name: str = "gene", pos: str = "pos", start: str = "st", end: str = "en") -> DataFrame:
    """by, name, n: how many points of each group the intervals of a name hold, where any; a point in several intervals counts for each. The
    pairs are never made: an interval is put together from stretches of 1, 2, 4 ... places, at most two of a length, and these meet the
    counts of the points in them by an equi join. So a row of the result costs a few rows, however many points or intervals share a place.
    Both sides are dealt out by their number and merged: Catalyst takes the stretches to be as few as the intervals, and would broadcast them."""
    own = intervals.select("chrom", F.col(start).cast("long").alias("_st"), F.col(end).cast("long").alias("_en"), F.col(name).alias("_name")).where("_st <= _en")
    longest, n = own.agg(F.max(F.col("_en") - F.col("_st") + 1), F.count("*")).first()
    held = points.where(F.col("chrom").isNotNull() & F.col(pos).isNotNull()).groupBy("chrom", F.col(pos).cast("long").alias("_pos"), *by).agg(F.count("*").alias("_k"))
    held = cut(held, "points")
    tasks = max(own.sparkSession.sparkContext.defaultParallelism, -(-max(n, held.count()) // SPANS))
    # of a length, the first stretch is needed where its number is odd, as none twice as long begins there, and so is the last where the end's is
    rows = own.repartition(tasks).withColumn("_level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_en") - F.col("_st") + 1)).cast("int"))))
    rows = rows.select("chrom", "_name", "_level", F.expr("shiftright(_st - 1, _level) + 1").alias("_a"), F.expr("shiftright(_en + 1, _level)").alias("_b")).where("_a < _b")
    ends = F.array(F.when(F.col("_a") % 2 != 0, F.col("_a")), F.when(F.col("_b") % 2 != 0, F.col("_b") - 1))
    parts = rows.select("chrom", "_name", "_level", F.explode(ends).alias("_node")).where("_node IS NOT NULL").repartition(tasks, *NODE)
    met = parts.hint("merge").join(node_counts(held, by, (longest or 1).bit_length() - 1, tasks), NODE)
    return met.groupBy(*by, F.col("_name").alias(name)).agg(F.sum("_k").alias("n"))


def merged_spans(spans: DataFrame, gap: int, by: list[str], start: str = "st", end: str = "en") -> DataFrame:
    """Spans of a group whose gaps are at most gap, as one: by, start, end, n."""
    own = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    islands = islands.withColumn("_island", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")
