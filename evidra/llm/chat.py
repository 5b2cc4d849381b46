"""Chat formatting with cumulative snapshots collapsed, in DataFrame functions only.

Logs often hold a conversation many times, once after each turn. Every turn gets the rolling hash of the turns up to it:
two 64-bit hashes of (position, role, text), each summed over the prefix in two halves. A conversation whose whole hash
is the hash of a shorter prefix of another one is left out by an anti-join, and of equal conversations the one with the
smallest conv_id stays. Prefix hashes are made distinct before the join, so a first turn that very many share is one
row. What is left is rendered turn by turn in ChatML; markers inside texts are broken up with a backslash.

Defined results: turns are in order of turn, then role, then text, nulls first; repeated turns count each; null role:
"unknown"; null text: empty; rows with a null conv_id are left out; an empty table gives no rows; other columns are not
carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PRINT = ["a", "b", "c", "d"]


def escaped(column: str) -> F.Column:
    return F.replace(F.replace(F.col(column), F.lit(START), F.lit("<\\|im_start|>")), F.lit(END), F.lit("<\\|im_end|>"))


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, k (position from 1), n (turns of the conversation), role, text, and the prefix's hash in PRINT."""
    rows = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("k", F.row_number().over(own))
    one, two = F.xxhash64("k", "role", "text"), F.xxhash64(F.lit("again"), "k", "text", "role")
    half = F.lit(0xFFFFFFFF)
    parts = {"a": one.bitwiseAND(half), "b": F.shiftrightunsigned(one, 32), "c": two.bitwiseAND(half), "d": F.shiftrightunsigned(two, 32)}
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(parts).withColumns({n: F.sum(n).over(upto) for n in PRINT})
    return rows.withColumn("n", F.max("k").over(Window.partitionBy("conv_id")))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: each maximal conversation once."""
    rows = with_prefix_hashes(turns)
    prefixes = rows.where("k < n").select(F.col("k").alias("n"), *PRINT).distinct()
    line = F.concat(F.lit(START), escaped("role"), F.lit("\n"), escaped("text"), F.lit(END + "\n"))
    whole = rows.where("k = n").groupBy("n", *PRINT).agg(F.min("conv_id").alias("conv_id"))
    maximal = whole.join(prefixes, ["n", *PRINT], "left_anti").select("conv_id")
    kept = rows.select("conv_id", F.struct("k", line.alias("line")).alias("turn")).join(maximal, "conv_id", "left_semi")
    chats = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("", F.transform("turns", lambda t: t["line"])).alias("text"))


#: The same in DuckDB: prefixes as whole strings in place of hashes.
SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
lines AS (
  SELECT conv_id, k, '<|im_start|>' || replace(replace(role, '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>') || chr(10)
         || replace(replace(text, '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>') || '<|im_end|>' || chr(10) AS line FROM turns),
runs AS (
  SELECT conv_id, k, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY k) AS run, count(*) OVER (PARTITION BY conv_id) AS n FROM lines),
whole AS (SELECT run, n, min(conv_id) AS conv_id FROM runs WHERE k = n GROUP BY run, n)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, run AS text FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.k < r.n AND r.k = w.n AND r.run = w.run)
"""
