"""What the operators of this subpackage share: reading inputs, cutting lineage, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.shared import cut, drop, new_path  # noqa: F401
from evidra.ship import ship

#: White space that separates words: the ASCII blanks only.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_batches(df: DataFrame, schema: T.StructType, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """mapInArrow whose function yields {column: list or Arrow array}; the columns come out in the schema's order."""
    names = schema.fieldNames()
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = arrow_schema(schema)
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := columns[n], pa.Array) else pa.array(c, to.field(n).type) for n in names], schema=to
            )

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of a few rows, so that what is held in Python at once stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def finite_vector(column: str) -> F.Column:
    """True for an array that is not null and holds neither null nor non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True))


def dealt(one: DataFrame, two: DataFrame, on: list[str], per: int, by: str) -> DataFrame:
    """All pairs of a row of one and a row of two with equal on, where few values of on have most rows: rows of two are dealt
    by their column by into shares of about per rows, and rows of one go to all shares."""
    shares = two.groupBy(*on).agg(F.ceil(F.count("*") / per).cast("int").alias("_shares"))
    all_ = one.join(shares, on).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    own = two.join(shares, on).withColumn("_share", F.pmod(F.xxhash64(by), F.col("_shares")).cast("int")).drop("_shares")
    return all_.join(own, [*on, "_share"]).drop("_share")


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but those that clash with an operator's added names; Spark does not tell letter cases apart."""
    return [c for c in df.columns if c.lower() not in names]


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns that clash with an operator's own names renamed, and what gives such rows their columns back."""
    own = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c.lower() in names}
    back = {new: old for old, new in own.items()}
    return docs.withColumnsRenamed(own), lambda df: df.select(*[own.get(c, c) for c in docs.columns]).withColumnsRenamed(back)
