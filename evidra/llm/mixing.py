"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix is counted in blocks of BLOCK words. Blocks go to sources by the highest quotients target / (2 * given + 1), then in
the same way from each source to ranges of its shards and from each range to its shards; seats above what a shard can take go to
others. A shard is a hash class of a source's documents, of about SHARD_WORDS of its words, so a rare source has few shards,
and one that holds most words only has more. In a shard the documents of a source stand in a seeded order as one run of
words that is divided into equal blocks; its quota takes every block as often as it goes round. What is over is a seeded
choice of blocks, in stretches of STRETCH blocks, so that texts are not cut into single blocks: stretches are taken in an
order that a seeded step and start give, the last of them in part.

Targets: sources in code point order, null last, weigh WEIGHTS in turn and share SHARE of all words; a target stops at
MOST times its source's words, the excess is shared again by weight among the others.

Nothing grows on the driver: sources are a table, with targets by a few rounds of sums over it, and are dealt seats by CLASSES
ranges of them on the driver and within each range in a task.

Defined results: null or empty text: size 0, taken 0; null source: a source of its own; null doc_id: kept; repeated
rows are counted one by one, and rows that differ in other columns only are told apart by these; empty table: no rows; columns
of documents named like the plan's own come through unharmed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import WORD, cut, drop, map_batches, set_aside, slices
from evidra.ship import ship

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 16
STRETCH = 64
SHARD_WORDS = 1 << 16
#: Shards of a range, classes of sources, and sources up to which their numbers of shards are broadcast.
RANGE = 1024
CLASSES = 1024
FEW_SOURCES = 100_000
SEED = 20
#: Steps of the stretches' orders; primes, so that each has no divisor in common with a number of stretches.
STEPS = (2_147_483_647, 1_000_000_007, 1_073_741_789, 1_500_000_001, 998_244_353)
#: Names that the plan of a mix uses.
OWN = ("_size", "_source", "_order", "_tie", "_shard", "_shards", "_words", "_quota", "_before", "_blocks", "_times", "_over", "_full", "_step", "_start", "_runs", "source_size", "target", "taken")


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients weight / (2 * given + 1); equal quotients in order."""
    w = np.asarray(weights, float)
    given = np.zeros(len(w), np.int64)
    if seats <= 0 or w.sum() <= 0:
        return given
    low, high = 0.0, 2 * (seats + len(w)) / w.sum()
    for _ in range(200):  # the largest multiplier whose rounded shares do not exceed the seats
        mid = (low + high) / 2
        if np.floor(w * mid + 0.5).sum() <= seats:
            low = mid
        else:
            high = mid
    given = np.floor(w * low + 0.5).astype(np.int64)
    for _ in range(int(seats - given.sum())):
        given[np.argmax(w / (2 * given + 1))] += 1
    return given


def capped(weights: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """sainte_lague with at most caps seats each; what is above goes to the others."""
    w, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    given, open_ = np.zeros(len(w), np.int64), caps > 0
    while open_.any():
        given[open_] = sainte_lague(w[open_], int(seats - given[~open_].sum()))
        above = open_ & (given > caps)
        if not above.any():
            break
        given[above] = caps[above]
        open_ &= ~above
    return given


def sized(docs: DataFrame, seed: int = SEED, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with their size in words and the keys of the mix: source as a string that is never null, shard, order, tie."""
    h = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.withColumns({"_size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"), "_source": F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t"))})
    shards = cut(rows.groupBy("_source").agg(F.greatest(F.lit(1), F.ceil(F.sum("_size") / SHARD_WORDS)).cast("long").alias("_shards")), "sources")
    if shards.count() <= FEW_SOURCES:
        shards = F.broadcast(shards)
    rows = rows.join(shards, "_source").withColumns({"_order": h, "_tie": F.xxhash64(*plain), "_shard": F.pmod(h, F.col("_shards"))})
    return rows.select(*docs.columns, "_size", "_source", "_order", "_tie", "_shard")


def blocks_of(block: int) -> F.Column:
    return F.greatest(F.lit(1), F.round(F.col("_words") / block)).cast("long")


def placed(table: DataFrame, order: str) -> DataFrame:
    """table with place, its rows' numbers from 0 in the order of a column of distinct values; no task sorts all rows."""
    place = F.monotonically_increasing_id()  # the partition, then the row in it
    parts = table.sparkSession.sparkContext.defaultParallelism
    ranged = table.repartitionByRange(parts, order).sortWithinPartitions(order).select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    ranged = cut(ranged, "placed")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    out = ranged.join(before, "_part").withColumn("place", F.col("_earlier") + F.col("_row")).drop("_part", "_row", "_earlier")
    out._cut_path = ranged._cut_path  # for drop()
    return out


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes (_source, source_size) with place and target in words, as a table."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    numbered = placed(sizes, "_source")
    rows = cut(numbered.withColumn("_weight", weight), "weights")
    drop(numbered)
    full = most * F.col("source_size")
    rate, closed = 0.0, None
    all_ = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    while True:  # each round the targets that stop free some words for the others, until none more stops
        above = F.col("_weight") * rate > full
        r = rows.agg(F.sum(F.when(above, full)).alias("closed"), F.sum(F.when(~above, F.col("_weight"))).alias("open"), F.count_if(above).alias("n")).first()
        if not r.open or r.n == closed:
            break
        rate, closed = (all_ - (r.closed or 0.0)) / r.open, r.n
    found = cut(rows.withColumn("target", F.least(F.col("_weight") * rate, full).cast("double")).drop("_weight"), "targets")
    drop(rows)
    return found


def deal(df: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Seats of each group of df (the same in all its rows) to its rows, by weight w and at most cap each, in order of keep."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("seats", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keep)
        return pdf.assign(seats=capped(pdf["w"].to_numpy(float), pdf["cap"].to_numpy(), int(pdf["seats"].iloc[0])))[[*keep, "seats"]]

    ship(df.sparkSession)
    return df.groupBy(*by).applyInPandas(run, schema)


def quotas(rows: DataFrame, block: int = BLOCK, **shares) -> DataFrame:
    """(_source, _shard, _words, _quota in blocks, source_size, target), as a table."""
    spark = rows.sparkSession
    shards = rows.groupBy("_source", "_shard").agg(F.sum("_size").alias("_words")).withColumn("cap", F.when(F.col("_words") > 0, blocks_of(block) * MOST).otherwise(0))
    shards = cut(shards.withColumn("_range", F.expr(f"_shard div {RANGE}")), "shards")
    ranges = cut(shards.groupBy("_source", "_range").agg(F.sum("_words").alias("w"), F.sum("cap").alias("cap")), "ranges")
    sources = targets(ranges.groupBy("_source").agg(F.sum("w").alias("source_size")), **shares)
    wide = sources.count() // CLASSES + 1
    caps = ranges.groupBy("_source").agg(F.sum("cap").alias("cap"))
    goals = cut(sources.join(caps, "_source").select("_source", F.expr(f"place div {wide}").alias("class"), F.col("target").alias("w"), "cap"), "goals")
    classes = goals.groupBy("class").agg(F.sum("w").alias("w"), F.sum("cap").alias("cap")).orderBy("class").collect()  # CLASSES rows at most
    w = np.array([c.w for c in classes], float)
    seats = capped(w, np.array([c.cap for c in classes], np.int64), round(w.sum() / block)).tolist()
    of_class = spark.createDataFrame([(c["class"], n) for c, n in zip(classes, seats, strict=True)], "class long, seats long")
    of_source = cut(deal(goals.join(of_class, "class"), ["class"], ["_source"]), "seats")
    of_range = cut(deal(ranges.join(of_source, "_source"), ["_source"], ["_source", "_range"]), "seats")
    of_shard = deal(shards.withColumn("w", F.col("_words")).join(of_range, ["_source", "_range"]), ["_source", "_range"], ["_source", "_shard", "_words"])
    found = cut(of_shard.withColumnRenamed("seats", "_quota").join(sources.select("_source", "source_size", "target"), "_source"), "quotas")
    drop(shards, ranges, sources, goals, of_source, of_range)
    return found


def mix(rows: DataFrame, block: int = BLOCK, seed: int = SEED, key: str = "doc_id", **shares) -> DataFrame:
    """rows (of sized) with source_size, target, taken, and what to take: _times whole, then the words of _runs (lo, hi)."""
    dealt = quotas(rows.select("_source", "_shard", "_size"), block, **shares)
    # the shard's plan: rounds, blocks over, and of its whole stretches how many come whole
    h = F.xxhash64(F.lit(seed), "_source", "_shard")
    plan = (
        dealt.withColumn("_blocks", blocks_of(block)).withColumn("_times", F.expr("_quota div _blocks")).withColumn("_over", F.expr("_quota % _blocks")).withColumn("_full", F.expr(f"_blocks div {STRETCH}"))
        .withColumn("_step", F.element_at(F.array(*[F.lit(x) for x in STEPS]), (F.pmod(h, F.lit(len(STEPS))) + 1).cast("int"))).withColumn("_start", F.shiftrightunsigned(h, 8) % 1_000_003)
    )
    w = Window.partitionBy("_source", "_shard").orderBy("_order", F.col(key), "_size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0))).join(plan, ["_source", "_shard"])
    # stretch s is the (s * step + start mod full)-th to be taken; what is left behind the whole stretches comes last
    place = "IF(s < _full, (s * CAST(_step AS BIGINT) + _start) % _full, _full)"
    taken = f"least({STRETCH}, greatest(0, _over - {STRETCH} * ({place})))"
    word = "(_words * least(_blocks, {}) div _blocks)"
    run = f"struct(greatest(0, {word.format(f's * {STRETCH}')} - _before) AS lo, least(_size, {word.format(f's * {STRETCH} + {taken}')} - _before) AS hi)"
    at = f"(({{}}) * _blocks div _words) div {STRETCH}"
    near = f"sequence(greatest(0, {at.format('_before')} - 1), {at.format('_before + _size')} + 1)"
    runs = F.expr(f"IF(_size > 0 AND _over > 0, filter(transform({near}, s -> {run}), r -> r.hi > r.lo), array())")
    return whole.withColumn("_runs", runs).select(*rows.columns, "source_size", "target", "_times", "_runs").withColumn("taken", F.expr("_times * _size + aggregate(_runs, 0L, (t, r) -> t + r.hi - r.lo)"))


def mixed_texts(docs: DataFrame, seed: int = SEED, text: str = "text", source: str = "source", key: str = "doc_id", n_chars: str = "n_chars", **shares) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole copy of a document that the mix takes, then one
    for each run of words that it takes more. Nothing is left of documents that it does not take."""
    docs, back = set_aside(docs, *OWN)
    kept = docs.columns
    planned = mix(sized(docs, seed, text, source, key), seed=seed, key=key, **shares).select(*kept, "_size", "_times", "_runs")
    schema = T.StructType([docs.schema[c] for c in kept])
    word = re.compile(WORD)

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for some in slices(batch, 256):
                rows, texts, of = [], [], zip(*(some.column(c).to_pylist() for c in (text, "_size", "_times", "_runs")), strict=True)
                for i, (t, size, times, runs) in enumerate(of):
                    texts += [t] * (times if size else 0)
                    spans = None
                    for lo, hi in merged([(r["lo"], r["hi"]) for r in runs]):
                        if hi - lo == size:
                            texts.append(t)
                        else:
                            spans = spans or [m.span() for m in word.finditer(t)]
                            texts.append(t[spans[lo][0] : spans[hi - 1][1]])
                    rows += [i] * (len(texts) - len(rows))
                taken = some.take(pa.array(rows, pa.int64()))
                out = {c: taken.column(c) for c in kept} | {text: texts}
                yield out | ({n_chars: [len(t) if t is not None else None for t in texts]} if n_chars in kept else {})

    return back(map_batches(planned, schema, take))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs with those that follow on another as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in runs:
        if out and out[-1][1] == lo:
            out[-1] = out[-1][0], hi
        else:
            out.append((lo, hi))
    return out
