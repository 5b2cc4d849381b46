"""Writers: headered text tables, JSON aggregates, appended logs, replaced state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame


def write_tsv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)


def write_submission(df: DataFrame, path: str) -> None:
    """One CSV file; the list is short by rule."""
    df.coalesce(1).write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_state(df: DataFrame, path: str) -> None:
    """Put df in a table's place: written aside whole, then renamed. Until then the old table stands, so df may read it, and a write that
    fails leaves it as it was."""
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(aside + ".new")
    context = df.sparkSession.sparkContext
    new, old, at = (context._jvm.org.apache.hadoop.fs.Path(p) for p in (aside + ".new", aside + ".old", path))
    store = at.getFileSystem(context._jsc.hadoopConfiguration())
    had = store.exists(at)
    if had and not store.rename(at, old):
        raise OSError(f"{path} can't be moved")
    if not store.rename(new, at):
        if had:
            store.rename(old, at)
        raise OSError(f"{path} can't be replaced")
    if had:
        store.delete(old, True)


def append_columns(table: DataFrame, path: str, **columns: Column) -> None:
    """Write a table with columns appended to those that it has, in order."""
    write_tsv(table.select("*", *[c.alias(n) for n, c in columns.items()]), path)
