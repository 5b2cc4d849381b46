"""Line order of text read in parallel: a number for each row, over all files and splits of a read.

A file source knows of each row its file and where its split starts, and rows of a split come in order. So the number is
the split's running offset plus the row's place in its split. Only a row for each split is ordered, never the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.shared import cut

#: Splits up to which their offsets are broadcast; beyond it they are joined by shuffle.
FEW_SPLITS = 100_000
AT = ["_file", "_block"]


def placed(rows: DataFrame) -> DataFrame:
    """rows of a file source with _file, _block (where the row's split starts) and _id, which grows along a split without gaps."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def running(splits: DataFrame, *sums: str) -> DataFrame:
    """A table with a row for each split, with <name>_before: the sum of name over the splits before, files in order of their paths.
    Splits are summed within their file, then files."""
    own = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("_file").agg(*[F.sum(n).alias(n) for n in sums])
    order = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("_file", *[F.coalesce(F.sum(n).over(order), F.lit(0)).alias(f"_{n}_files") for n in sums])
    within = splits.withColumns({f"_{n}_own": F.coalesce(F.sum(n).over(own), F.lit(0)) for n in sums})
    out = within.join(files, "_file")
    return out.select(*splits.columns, *[(F.col(f"_{n}_files") + F.col(f"_{n}_own")).alias(f"{n}_before") for n in sums])


def with_splits(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """rows joined with their split's row of a cut table; a row whose split is not there is an error."""
    few = F.broadcast(splits) if splits.count() <= FEW_SPLITS else splits
    return rows.join(few.withColumn("_known", F.lit(True)), AT, "left").where(
        F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(F.lit("the files were split in another way meanwhile")).cast("boolean"))
    ).drop("_known")


def numbered(rows: DataFrame, name: str = "line") -> DataFrame:
    """rows, as read from files and not yet changed, with their number from 1, over files in order of their paths. The files are read
    once more to count their rows."""
    at = placed(rows)
    splits = at.groupBy(*AT).agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    splits = cut(running(splits, "n").select(*AT, "first", "n_before"), "splits")
    number: Column = F.col("n_before") + F.col("_id") - F.col("first") + 1
    return with_splits(at, splits).select(*rows.columns, number.cast("long").alias(name))
