"""Long sequences as tables of chunks: read by file split, cut at fixed places, looked up by an equi join on the chunk.

A chunk table has acc, chunk (from 0), start (the place, from 1, of seq's first base), seq, own_start and own_end (the places that
are the chunk's own, both included). seq also holds up to halo bases of the neighbours on both sides, so whatever looks at most halo
bases around a place needs one row. No row and no task holds a whole sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.shared import cut
from evidra.sources.lines import AT, placed, with_splits

#: Bases of a chunk. A place in a string is found by walking it, so chunks are short.
LENGTH = 1024
HALO = 64


def assembled(pieces: DataFrame, length: int, halo: int) -> DataFrame:
    """The chunk table of pieces (acc, at, bases): bases that stand from place at (from 1) on. A piece goes to each chunk that it or
    its halo touches."""
    first = F.floor((F.col("at") - 1 - halo) / length)
    last = F.floor((F.col("at") - 2 + F.length("bases") + halo) / length)
    rows = pieces.where(F.length("bases") > 0).withColumn("chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    low, high = F.col("chunk") * length + 1 - halo, (F.col("chunk") + 1) * length + halo
    skip = F.greatest(low - F.col("at"), F.lit(0))
    rows = rows.withColumn("bases", F.substr("bases", (skip + 1).cast("int"), (high - F.col("at") - skip + 1).cast("int"))).withColumn("at", F.col("at") + skip).where(F.length("bases") > 0)
    # a chunk's pieces are at most its bases
    whole = rows.groupBy("acc", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "bases"))).alias("p"))
    seq = F.concat_ws("", F.transform("p", lambda x: x["bases"]))
    table = whole.select("acc", "chunk", F.get("p", F.lit(0))["at"].alias("start"), seq.alias("seq"))
    own_start = F.col("chunk") * length + 1
    table = table.withColumns({"own_start": own_start, "own_end": F.least(own_start + length - 1, F.col("start") + F.length("seq") - 1)})
    return table.where("own_start <= own_end")  # else only another chunk's halo


def read_chunks(spark: SparkSession, path: str, length: int = LENGTH, halo: int = HALO) -> DataFrame:
    """The chunk table of sequence files, plain or gzip, with one or more records; bases in upper case. acc is a header's first token;
    lines before any header are of the empty acc. The lines of plain files are read by split: each line's place is its split's running
    length plus its own, where lengths start anew at each header."""
    at = placed(spark.read.text(path))
    line = F.trim(F.col("value"))
    lines = at.select(*AT, "_id", F.when(line.startswith(">"), F.get(F.split(F.substr(line, F.lit(2), F.length(line)), r"\s+"), F.lit(0))).alias("head"), F.when(~line.startswith(">"), F.upper(F.regexp_replace(line, r"\s", ""))).alias("bases"))
    lines = lines.withColumn("n", F.coalesce(F.length("bases"), F.lit(0)).cast("long"))
    # a split's last header and what follows it, then the same over the splits of a file, a row each
    own = Window.partitionBy(*AT).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("part", F.count("head").over(own)).withColumn("acc", F.last("head", ignorenulls=True).over(own))
    lines = cut(lines.withColumn("upto", F.sum("n").over(Window.partitionBy(*AT, "part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))), "lines")
    splits = lines.groupBy(*AT).agg(F.max_by("acc", "_id").alias("acc"), F.max_by("upto", "_id").alias("left"), F.max("part").alias("parts"))
    before = Window.partitionBy("_file").orderBy("_block")
    splits = splits.withColumn("era", F.sum(F.when(F.col("parts") > 0, 1).otherwise(0)).over(before))
    era = Window.partitionBy("_file", "era").orderBy("_block")
    splits = splits.withColumn("total", F.sum("left").over(era)).withColumn("named", F.first("acc", ignorenulls=True).over(era))
    carried = splits.select(*AT, F.lag("named").over(before).alias("acc_before"), F.coalesce(F.lag("total").over(before), F.lit(0)).alias("n_before"))
    met = with_splits(lines.where("bases IS NOT NULL"), cut(carried, "carried"))
    first = F.col("part") == 0
    place = F.col("upto") - F.col("n") + 1 + F.when(first, F.col("n_before")).otherwise(0)
    return assembled(met.select(F.coalesce(F.when(first, F.col("acc_before")).otherwise(F.col("acc")), F.lit("")).alias("acc"), place.alias("at"), "bases"), length, halo)


def chunked(seqs: DataFrame, length: int = LENGTH, halo: int = HALO, acc: str = "acc", seq: str = "seq") -> DataFrame:
    """The chunk table of whole sequences in rows."""
    return assembled(seqs.select(F.col(acc).alias("acc"), F.lit(1).cast("long").alias("at"), F.upper(F.col(seq)).alias("bases")), length, halo)


def around(points: DataFrame, chunks: DataFrame, before: int, after: int, name: str = "window", length: int = LENGTH, pos: str = "pos") -> DataFrame:
    """points (acc, pos) with the bases from before to after around pos; fewer at a sequence's ends, null beyond it. before and after are
    at most the chunks' halo."""
    side = chunks.select("acc", F.col("chunk").alias("_chunk"), "start", "seq", "own_end")
    rows = points.withColumn("_chunk", F.floor((F.col(pos) - 1) / length)).join(side, ["acc", "_chunk"], "left")
    return rows.withColumn(name, F.when(F.col(pos) <= F.col("own_end"), bases(F.col("seq"), F.col("start"), F.col(pos) - before, F.col(pos) + after))).drop("_chunk", "start", "seq", "own_end")


def bases(seq: Column, start: Column, first: Column, last: Column) -> Column:
    """The bases at places first to last of a chunk's seq, as far as it has them."""
    from_ = F.greatest(first - start + 1, F.lit(1))
    return F.substr(seq, from_.cast("int"), F.greatest(last - start + 2 - from_, F.lit(0)).cast("int"))
