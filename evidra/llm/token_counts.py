"""Token counts by a two-tier look-up on the map side.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast to all workers; tier two is each worker's
own bounded cache, which encodes what the table misses through the tokenizer's library. No document's pre-tokens are
shuffled: each is counted where it is read. The table only saves work. It comes from all documents: each task tallies its own
in bounded memory and gives its TASK_ENTRIES most frequent ones, fewer where there are many tasks; only these tallies are shuffled, and
their sums decide on TABLE_ENTRIES entries. Every
pre-token of every whole text is counted whether or not the table has it.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is kept; repeated rows are counted one
by one; an empty table gives an empty result; further columns of the input pass through unless their names, in whatever
case, clash with the added ones, which then replace them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import map_batches, slices, without
from evidra.llm.tokens import LONGEST_KEPT, default_path, encoder

TABLE_ENTRIES = 20_000
#: Entries of a task's tally that it gives, fewer where there are many tasks, so that all give GIVEN_ENTRIES at most or LEAST_ENTRIES
#: each; and entries that a task holds before the rarer half go.
TASK_ENTRIES, LEAST_ENTRIES, GIVEN_ENTRIES, HELD_ENTRIES = 8_192, 256, 1 << 26, 100_000
#: A text held in Python at once, in rows.
RUN = 256


def is_none(x: int | None) -> bool:
    return x is None


ADDED = T.StructType(
    [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
)


def frequent_lengths(docs: DataFrame, text: str, path: str) -> tuple[bytes, np.ndarray]:
    """The most frequent pre-tokens, as one byte string joined by zero bytes, and their lengths; long ones are left to the
    second tier."""

    rows = docs.select(F.col(text).alias("text")).where("text IS NOT NULL")
    given = max(LEAST_ENTRIES, min(TASK_ENTRIES, GIVEN_ENTRIES // max(1, rows.rdd.getNumPartitions())))

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        enc, n = encoder(path), Counter()
        for batch in batches:
            for some in slices(batch, RUN):
                for t in some.column(0).to_pylist():
                    n.update([p for p in enc.pieces(t) or () if len(p) <= LONGEST_KEPT])
                if len(n) > HELD_ENTRIES:
                    n = Counter(dict(n.most_common(HELD_ENTRIES // 2)))
        top = [(p, k) for p, k in n.most_common(given) if "\0" not in p]
        if top:
            yield {"piece": [p for p, _ in top], "n": [k for _, k in top]}

    of = T.StructType([T.StructField("piece", T.StringType()), T.StructField("n", T.LongType())])
    tallies = map_batches(rows, of, tally)
    pieces = [r.piece for r in tallies.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "piece").limit(TABLE_ENTRIES).collect()]
    lengths = [len(x) // 4 for x in encoder(path).encode(pieces)]
    return "\0".join(pieces).encode(), np.array(lengths, dtype="<u2")


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) for the tokenizer file at path."""
    path = path or default_path()
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, path))
    kept = without(docs, *ADDED.fieldNames())
    schema = T.StructType([docs.schema[c] for c in kept] + ADDED.fields)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        enc = encoder(path)
        pieces, lengths = table.value
        tier = dict(zip(pieces.decode().split("\0"), lengths.tolist(), strict=True)) if len(lengths) else {}
        for batch in batches:
            for some in slices(batch, RUN):
                texts = [t or "" for t in some.column(text).to_pylist()]
                lists = [enc.pieces(t) for t in texts]
                first = [list(map(tier.get, x)) if x else [] for x in lists]
                missed = [list(compress(x, map(is_none, f))) if x else [] for x, f in zip(lists, first, strict=True)]
                known = enc.learn(missed)
                whole = iter(enc.whole([t for t, x in zip(texts, lists, strict=True) if x is None] or [""]))
                n = [
                    sum(filter(None, f)) + sum(map(len, map(known.__getitem__, m))) // 4 if x is not None else len(next(whole))
                    for x, f, m in zip(lists, first, missed, strict=True)
                ]
                yield {c: some.column(c) for c in kept} | {
                    "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n],
                }

    return map_batches(docs.select(*kept), schema, count)
