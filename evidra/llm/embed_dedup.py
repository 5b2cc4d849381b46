"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the coordinates of the principal components, largest variance first.
The components come from sums over all vectors, added up in Spark. Vectors of one label are sorted by their first
coordinate and cut into tiles, which are rows of a table. Two tiles of a label meet unless their first coordinates lie
further apart than any linked pair's can; the names of tiles meet in buckets of the first coordinate, dealt out so that
no task pairs many, and only then do vectors move. In a pair of tiles products accumulate over leading coordinates, STEP at a time;
the rest of a product is at most the product of the suffix norms, so pairs that cannot reach the threshold drop out, and
the tile pair stops when none is left. What is left after the last step is confirmed by the plain cosine of the
given components in double precision.

Equal vectors of a label are one class with a count from the start, so copies never form pairs. A tile pair puts out
sums of links by class and the links that join its parts, not all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and null labels, link with
nothing: n_links 0, component the own vec_id, kept. Vectors of different lengths never link. A null vec_id links with
nothing and has a null component. Rows with one vec_id are one vector in components; each row counts for n_links, its
own row apart. An empty table gives no rows. Other columns, whatever their names, are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import cut, dealt, drop, finite_vector, map_batches
from evidra.llm.components import connected_components

THRESHOLD = 0.93
TILE = 1024
STEP = 8
#: Tiles of a label and bucket under one key, when the names of tiles meet.
MEETING = 32
#: More than double precision loses in a product of vectors of length one.
SLACK = 1e-9

L, D, B, I = T.LongType(), T.DoubleType(), T.BinaryType(), T.IntegerType()
TILES = T.StructType(
    [T.StructField("label", L), T.StructField("dim", I), T.StructField("tile", L), T.StructField("low", D), T.StructField("high", D), T.StructField("nodes", B), T.StructField("counts", B), T.StructField("given", B)]
)
PRINT = ["print_1", "print_2"]
FOUND = T.StructType([T.StructField("a", L), T.StructField("b", L), T.StructField("links", L)])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow or underflow of squares."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_dim(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches whose vectors have one length, with the matrix of the vectors."""
    for batch in batches:
        vectors = batch.column(column)
        lengths = np.diff(vectors.offsets.to_numpy())
        for dim in np.unique(lengths):
            rows = batch.take(pa.array(np.flatnonzero(lengths == dim)))
            yield rows, np.asarray(rows.column(column).flatten(), float).reshape(-1, dim)


def principal(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the matrix of principal components, largest variance first."""
    of = T.StructType([T.StructField("dim", I), T.StructField("i", I), T.StructField("j", I), T.StructField("s", D)])

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for _, x in by_dim(batches, "v"):
            x = np.hstack([unit(x), np.ones((len(x), 1))])
            total[x.shape[1] - 1] = total.get(x.shape[1] - 1, 0) + x.T @ x
        for dim, m in total.items():
            i, j = np.triu_indices(dim + 1)
            yield {"dim": np.full(len(i), dim), "i": i, "j": j, "s": m[i, j]}

    rows = map_batches(classes.select("v"), of, sums).groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect()  # dim * dim numbers
    axes = {}
    for dim in {r.dim for r in rows}:
        m = np.zeros((dim + 1, dim + 1))
        for r in rows:
            if r.dim == dim:
                m[r.i, r.j] = m[r.j, r.i] = r.s
        n = m[dim, dim]
        mean = m[dim, :dim] / n
        axes[dim] = np.linalg.eigh(m[:dim, :dim] / n - np.outer(mean, mean))[1][:, ::-1]
    return axes


def compare(a: np.ndarray, b: np.ndarray, threshold: float, axes: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all linked pairs of rows of a and b; same: a is b, and pairs count once."""
    p, q = unit(a) @ axes, unit(b) @ axes
    left = np.sqrt(np.maximum(0, np.cumsum((p * p)[:, ::-1], 1)[:, ::-1]))
    right = np.sqrt(np.maximum(0, np.cumsum((q * q)[:, ::-1], 1)[:, ::-1]))
    dim = p.shape[1]
    got = p[:, :STEP] @ q[:, :STEP].T
    alive = np.triu(np.ones_like(got, bool), 1) if same else np.ones_like(got, bool)
    i = j = None
    for at in range(STEP, dim + STEP, STEP):
        at = min(at, dim)
        if i is None:
            rest = np.outer(left[:, at], right[:, at]) if at < dim else 0
            alive &= got + rest >= threshold - SLACK
            if at < dim and alive.mean() > 0.2:
                got += p[:, at : at + STEP] @ q[:, at : at + STEP].T
                continue
            i, j = np.nonzero(alive)
            some = got[i, j]
        else:
            rest = left[i, at] * right[j, at] if at < dim else 0
            stay = some + rest >= threshold - SLACK
            i, j, some = i[stay], j[stay], some[stay]
        if not len(i):
            return i, j
        if at < dim:
            some = some + np.einsum("ij,ij->i", p[i, at : at + STEP], q[j, at : at + STEP])
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 15):
        x, y = a[i[at : at + (1 << 15)]], b[j[at : at + (1 << 15)]]
        keep[at : at + (1 << 15)] = cosine(x, y) >= threshold
    return i[keep], j[keep]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The links, as (member, smallest member), that connect what the pairs connect among 0 .. n - 1."""
    from_ = np.arange(n)
    while True:
        low = np.minimum(from_[i], from_[j])
        new = from_.copy()
        np.minimum.at(new, from_[i], low)
        np.minimum.at(new, from_[j], low)
        new = new[new]
        if (new == from_).all():
            return [(int(k), int(c)) for k, c in enumerate(new) if k != c]
        from_ = new


def meetings(names: DataFrame, reach: float) -> DataFrame:
    """(tile, other) of each two tiles of a label, tile <= other, whose first coordinates come within reach. A tile is named
    in each bucket of a width of reach or more that it touches, and meets what is named in it and its neighbours."""
    width = max(reach, 1 / 64)
    names = names.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    one = names.withColumn("bucket", F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)])))
    two = names.select("label", "dim", "bucket", F.col("tile").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    met = dealt(one, two, ["label", "dim", "bucket"], MEETING, "other")
    met = met.where((F.col("tile") <= F.col("other")) & (F.col("low2") <= F.col("high") + reach) & (F.col("low") <= F.col("high2") + reach))
    return met.select("tile", "other").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite_vector("v") & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("v", F.when(F.col("good"), F.transform("v", lambda x: x + F.lit(0.0))))
    # 128 bits stand for a vector from here on
    rows = cut(rows.select("*", *[F.when(F.col("good"), F.xxhash64(F.lit(n), "v")).alias(n) for n in PRINT]), "vectors")
    classes = cut(rows.where("good").groupBy("label", *PRINT).agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    axes = principal(classes)
    shared = vectors.sparkSession.sparkContext.broadcast(axes)  # dim * dim numbers

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for some, x in by_dim(batches, "v"):
            yield {c: some.column(c) for c in ("label", "node", "n")} | {"dim": [x.shape[1]] * len(x), "at": (unit(x) @ shared.value[x.shape[1]][:, :1])[:, 0], "given": [r.tobytes() for r in x]}

    placed = T.StructType([T.StructField("label", L), T.StructField("dim", I), T.StructField("at", D), T.StructField("node", L), T.StructField("n", L), T.StructField("given", B)])
    order = ["label", "dim", "at", "node"]
    count = classes.count()
    ranged = map_batches(classes, placed, project).repartitionByRange(max(1, -(-count // TILE)), *order).sortWithinPartitions(*order)

    def cut_tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        now, held, n_tile = None, [], 0

        def out() -> dict:
            nonlocal n_tile
            n_tile += 1
            low, high = held[0][0], held[-1][0]
            return {
                "label": [now[0]], "dim": [now[1]], "tile": [part << 32 | n_tile], "low": [low], "high": [high],
                "nodes": [np.array([h[1] for h in held], np.int64).tobytes()], "counts": [np.array([h[2] for h in held], np.int64).tobytes()], "given": [b"".join(h[3] for h in held)],
            }

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            for label, dim, at, node, n, given in zip(*(batch.column(c).to_pylist() for c in placed.fieldNames()), strict=True):
                if (label, dim) != now or len(held) == TILE:
                    if held:
                        yield out()
                    now, held = (label, dim), []
                held.append((at, node, n, given))
        if held:
            yield out()

    tiles = cut(map_batches(ranged, TILES, cut_tiles), "tiles")
    # two vectors of length one with cosine c are sqrt(2 - 2c) apart at most, and so are their first coordinates
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    meet = meetings(tiles.select("label", "dim", "tile", "low", "high"), reach)
    a = tiles.select("tile", "dim", "nodes", "counts", "given")
    b = tiles.select(F.col("tile").alias("other"), F.col("nodes").alias("nodes2"), F.col("counts").alias("counts2"), F.col("given").alias("given2"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: v[0] for c, v in batch.slice(k, 1).to_pydict().items()}
                same = r["tile"] == r["other"]
                nodes, counts = np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["counts"], np.int64)
                nodes2, counts2 = np.frombuffer(r["nodes2"], np.int64), np.frombuffer(r["counts2"], np.int64)
                x, y = np.frombuffer(r["given"]).reshape(-1, r["dim"]), np.frombuffer(r["given2"]).reshape(-1, r["dim"])
                i, j = compare(x, y, threshold, shared.value[r["dim"]], same)
                if not len(i):
                    continue
                one, two = np.bincount(i, counts2[j], len(nodes)).astype(np.int64), np.bincount(j, counts[i], len(nodes2)).astype(np.int64)
                both = nodes if same else np.concatenate([nodes, nodes2])
                tree = [(int(both[p]), int(both[q])) for p, q in forest(i, j if same else j + len(nodes), len(both))]
                sums = [(int(n), int(c)) for own, s in ((nodes, one), (nodes2, two)) for n, c in zip(own, s, strict=True) if c]
                yield {"a": [n for n, _ in sums] + [p for p, _ in tree], "b": [None] * len(sums) + [q for _, q in tree], "links": [c for _, c in sums] + [None] * len(tree)}

    found = cut(map_batches(meet.join(a, "tile").join(b, "other").select("tile", "other", "dim", "nodes", "counts", "given", "nodes2", "counts2", "given2"), FOUND, run), "links")
    sums = found.where("links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labels = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    by_class = classes.select("label", *PRINT, "node", "n").join(sums, "node", "left").join(labels, "node", "left")
    by_class = cut(by_class.select("label", *PRINT, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "linked")
    drop(classes, tiles, found, labels)
    out = rows.select("vec_id", "label", *PRINT).join(by_class, ["label", *PRINT], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
