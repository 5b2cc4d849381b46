"""Exact top-k search by block-at-a-time pruning.

Vectors are given as whole numbers, floor(SCALE * x), and score by inner product; a vector's components are its terms.
The index is a table of blocks: runs of BLOCK rows in vec_id order, each with its forward index (the rows' terms), its
ids, and each term's largest and smallest value in the block. For a query the block's bound is the sum over terms of the
query's weight times the value at that end which is larger. Blocks are taken by descending bound and scored
through their forward indexes, until a bound falls below the k-th score so far; a block whose bound equals it is still
scored, as it may hold a smaller id. Blocks form groups, queries form tiles. Tiles first meet the extremes of all groups, a
small part of the index; each tile is scored against the group of the highest bounds, which gives each query a lower bound of
its k-th score. Only where a query's bound in a group reaches that score do tile and group meet, and the search starts
from it. Each meeting gives k rows a query at most, and the best k of all are the result. Scores are exact: products are
summed in doubles only where all sums stay below 2^53, in whole numbers else; scores beyond 64 bits are set to the nearest
64-bit number.

Bounds are tight where a block's vectors are alike. Where they point anywhere, no bound is below a k-th score: all blocks are
scored, as by a plain scan in tiles.

Defined results: vectors that are null or empty or hold null or non-finite components, and null ids, take no part;
vectors of other lengths than the query's are no candidates for it; candidates with the query's own vec_id are left out;
repeated ids are separate candidates, and as queries give their rows each; ties go to the smaller vec_id; an empty table
gives no rows; other columns, whatever their names, are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import cut, dealt, drop, finite_vector, map_batches
from evidra.llm.embed_dedup import by_dim

SCALE = 256
BLOCK = 128
#: Blocks of a group, and queries of a tile.
GROUP_BLOCKS = 32
TILE = 256
#: Tiles that meet all packs under one key; groups whose extremes are a pack.
MEETING = 16
PACK = 256
EXACT = 2.0**53

L, B, I = T.LongType(), T.BinaryType(), T.IntegerType()
LEAST = -(2**63)
RUNS = T.StructType([T.StructField("dim", I), T.StructField("run", L), *[T.StructField(n, B) for n in ("ids", "terms", "high", "low")]])
FOUND = T.StructType([T.StructField("query", L), T.StructField("query_id", L), T.StructField("vec_id", L), T.StructField("score", L)])


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, which hold it exactly."""
    return np.floor(x * scale)


def product(terms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of terms with those of q, as 64-bit numbers; rows of terms are rows of the result."""
    if np.abs(terms).max(initial=0) * np.abs(q).max(initial=0) * q.shape[1] < EXACT:
        return (terms @ q.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(row, one, strict=True)) for one in q] for row in terms]
    return np.array([[max(LEAST, min(-LEAST - 1, s)) for s in row] for row in exact], np.int64)


def bounds(high: np.ndarray, low: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of each row of q (rows) with what lies between each low and high (columns); a rounding
    error in sums beyond 2^53 is allowed for."""
    sums = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    size = np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T
    return sums + np.where(size < EXACT, 0, size * 1e-12)


class Group:
    """Blocks with forward indexes, and the terms' extremes of each block."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray) -> None:
        self.ids = [ids[at : at + BLOCK] for at in range(0, len(ids), BLOCK)]
        self.terms = [terms[at : at + BLOCK] for at in range(0, len(ids), BLOCK)]
        self.high = np.array([t.max(0) for t in self.terms])
        self.low = np.array([t.min(0) for t in self.terms])

    def best(self, query_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each query ids and scores of its k best candidates that score least or more, and the number of blocks
        scored. Queries that come to the same block at the same time are scored together."""
        reach = bounds(self.high, self.low, q)
        order = np.argsort(-reach, axis=1, kind="stable")
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
        least, active, scored = least.copy(), np.arange(len(q)), 0
        for place in range(order.shape[1]):
            active = active[reach[active, order[active, place]] >= least[active]]
            if not len(active):
                break
            now = order[active, place]
            for block in np.unique(now):
                some = active[now == block]
                scored += len(some)
                got = product(self.terms[block], q[some])
                for i, column in zip(some.tolist(), got.T, strict=True):
                    ok = (column >= least[i]) & (self.ids[block] != query_ids[i])
                    if ok.any():
                        ids, scores = np.concatenate([found[i][0], self.ids[block][ok]]), np.concatenate([found[i][1], column[ok]])
                        best = np.lexsort([ids, ~scores])[:k]  # ~ turns the order of whole numbers round
                        found[i] = ids[best], scores[best]
                        if len(best) == k:
                            least[i] = max(least[i], scores[best[-1]])
        return found, scored


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & finite_vector("v") & (F.size("v") > 0))


def stacked(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Runs of size rows of one length of vectors in id order, as single rows."""
    order = ["dim", "id"]
    rows = rows.withColumn("dim", F.size("v"))
    ranged = rows.repartitionByRange(max(1, -(-rows.count() // size)), *order).sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        part, n, held, dim = TaskContext.get().partitionId(), 0, [], None

        def out() -> dict:
            ids, terms = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            return {"dim": [dim], "run": [part << 32 | n], "ids": [ids.tobytes()], "terms": [terms.tobytes()], "high": [terms.max(0).tobytes()], "low": [terms.min(0).tobytes()]}

        for batch in batches:
            for some, x in by_dim([batch], "v"):
                if held and dim != x.shape[1]:
                    yield out()
                    held, n = [], n + 1
                dim = x.shape[1]
                ids, terms = some.column("id").to_numpy(), whole(x, scale)
                while len(ids):
                    room = size - sum(len(h[0]) for h in held)
                    held.append((ids[:room], terms[:room]))
                    ids, terms = ids[room:], terms[room:]
                    if sum(len(h[0]) for h in held) == size:
                        yield out()
                        held, n = [], n + 1
        if held:
            yield out()

    return cut(map_batches(ranged.select("id", "v"), RUNS, run), "blocks")


def numbers(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, dim)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, as they hold much."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield from batch.slice(i, 1).to_pylist()


def packed(groups: DataFrame) -> DataFrame:
    """The extremes of PACK groups as one row."""
    of = T.StructType([T.StructField("dim", I), T.StructField("grps", B), T.StructField("high", B), T.StructField("low", B)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list[dict]] = {}
        out = lambda dim, rows: {"dim": [dim], "grps": [np.array([r["grp"] for r in rows], np.int64).tobytes()]} | {n: [b"".join(r[n] for r in rows)] for n in ("high", "low")}
        for r in rows_of(batches):
            own = held.setdefault(r["dim"], [])
            own.append(r)
            if len(own) == PACK:
                yield out(r["dim"], held.pop(r["dim"]))
        for dim, rows in held.items():
            yield out(dim, rows)

    return map_batches(groups.select("dim", "grp", "high", "low"), of, run)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of vectors with the highest scores for each of queries."""
    index, asked = stacked(valid(vectors, key, vector), GROUP_BLOCKS * BLOCK, scale), stacked(valid(queries, key, vector), TILE, scale)
    groups = index.withColumnRenamed("run", "grp")
    tiles = asked.select("dim", F.col("run").alias("tile"), F.col("ids").alias("q_ids"), F.col("terms").alias("q_terms"))

    def searched(r: dict, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return Group(np.frombuffer(r["ids"], np.int64), numbers(r["terms"], r["dim"])).best(np.frombuffer(r["q_ids"], np.int64), numbers(r["q_terms"], r["dim"]), k, least)[0]

    def begin(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for r in rows_of(batches):
            found = searched(r, np.full(len(r["q_ids"]) // 8, LEAST))
            least = [s[-1] if len(s) == k else LEAST for _, s in found]
            yield {"dim": [r["dim"]], "tile": [r["tile"]], "q_ids": [r["q_ids"]], "q_terms": [r["q_terms"]], "least": [np.array(least, np.int64).tobytes()]}

    def reach(r: dict) -> np.ndarray:
        return bounds(numbers(r["high"], r["dim"]), numbers(r["low"], r["dim"]), numbers(r["q_terms"], r["dim"]))

    def promise(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for r in rows_of(batches):
            total = reach(r).sum(0)
            yield {"tile": [r["tile"]], "grp": [int(np.frombuffer(r["grps"], np.int64)[total.argmax()])], "total": [float(total.max())]}

    packs = cut(packed(groups), "extremes")
    promised = T.StructType([T.StructField("tile", L), T.StructField("grp", L), T.StructField("total", T.DoubleType())])
    near = dealt(packs, tiles.select("dim", "tile", "q_terms"), ["dim"], MEETING, "tile")
    best = map_batches(near.select("dim", "tile", "q_terms", "grps", "high", "low"), promised, promise).groupBy("tile").agg(F.max_by("grp", "total").alias("grp"))
    chosen = cut(best, "first")
    # many tiles may promise one group: they are dealt into shares, to each of which the group goes
    named = cut(chosen.join(tiles, "tile"), "first")
    first = dealt(groups.select("grp", "ids", "terms"), named, ["grp"], MEETING, "tile")
    begun = T.StructType([*tiles.schema.fields, T.StructField("least", B)])
    ready = cut(map_batches(first.select("dim", "tile", "q_ids", "q_terms", "ids", "terms"), begun, begin), "tiles")

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for r in rows_of(batches):
            grps = np.frombuffer(r["grps"], np.int64)[(reach(r) >= np.frombuffer(r["least"], np.int64)[:, None]).any(0)]
            yield {"tile": [r["tile"]] * len(grps), "grp": grps.tolist()}

    names = T.StructType([T.StructField("tile", L), T.StructField("grp", L)])
    near = dealt(packs, ready.select("dim", "tile", "q_terms", "least"), ["dim"], MEETING, "tile")
    meet = cut(map_batches(near.select("dim", "tile", "q_terms", "least", "grps", "high", "low"), names, prune), "meetings")
    met = meet.join(ready, "tile").join(groups.select("grp", "ids", "terms"), "grp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for r in rows_of(batches):
            out: dict[str, list] = {"query": [], "query_id": [], "vec_id": [], "score": []}
            found = searched(r, np.frombuffer(r["least"], np.int64))
            for i, (query_id, (ids, scores)) in enumerate(zip(np.frombuffer(r["q_ids"], np.int64).tolist(), found, strict=True)):
                for n, v in zip(out, ([r["tile"] * TILE + i] * len(ids), [query_id] * len(ids), ids.tolist(), scores.tolist()), strict=True):
                    out[n] += v
            yield out

    found = cut(map_batches(met.select("tile", "q_ids", "q_terms", "least", "dim", "ids", "terms"), FOUND, run), "found")
    drop(index, asked, ready, meet, packs, chosen, named)
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
