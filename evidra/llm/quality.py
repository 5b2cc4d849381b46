"""Quality score of a document: a convolutional network over its bytes, in numpy.

Each byte has a fixed code: its class (capital, small letter, digit, blank, other ASCII, above ASCII) and four fixed
pseudo-random numbers. Learned filters of WIDTH bytes move over the whole document by STRIDE. Chunks of two units of UNIT
bytes overlap by half and cover the document from its first byte to its last; a filter's value in a chunk is its maximum
there. Means, maxima and minima over the chunks go through one hidden layer into one probability. Training runs on the driver on
at most TRAIN_ROWS labelled documents of at most TRAIN_BYTES each and TRAIN_ALL in all, a fixed number of steps; scoring is one
narrow pass that holds a few documents' bytes at a time and goes through a long one in runs of RUN_BYTES, keeping sums, maxima
and minima over its chunks. Labels, languages, sources and ids are never inputs.

Defined results: null and empty texts get the score of a document without bytes; without any labelled row the score is
0.5; with one class only, the network learns that class; null labels are left out; repeated rows are scored one by one;
an empty table gives no rows; further columns pass through unless their names, in whatever case, clash with score and
predicted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import map_batches, slices, without

WIDTH, STRIDE, UNIT, FILTERS, HIDDEN = 16, 8, 256, 32, 16
TRAIN_ROWS, TRAIN_BYTES, TRAIN_ALL = 2_000, 1 << 20, 64 << 20
STEPS, BATCH = 1200, 16
#: Bytes scored at once.
RUN_BYTES = 1 << 18
PAD = 256

ADDED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def codes() -> np.ndarray:
    b = np.arange(257)
    capital, small, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    blank, high = (b == 32) | ((b >= 9) & (b <= 13)), (b >= 128) & (b < 256)
    other = (b < 128) & ~(capital | small | digit | blank)
    table = np.column_stack([capital, small, digit, blank, other, high]).astype(np.float32)
    table = np.hstack([table, np.random.default_rng(7).standard_normal((257, 4)).astype(np.float32)])
    table[PAD] = 0
    return table


CODES = codes()


class Network:
    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "w": draw(WIDTH * CODES.shape[1], FILTERS), "b": np.zeros(FILTERS, np.float32),
            "v": draw(3 * FILTERS, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "u": draw(HIDDEN, 1), "d": np.zeros(1, np.float32),
        }

    def forward(self, texts: list[bytes], keep: bool = False) -> np.ndarray | tuple[np.ndarray, dict]:
        """Probabilities of class 1; with keep also what backward() needs."""
        p = self.p
        units = np.array([max(1, -(-len(t) // UNIT)) for t in texts])
        data = np.full(units.sum() * UNIT + WIDTH, PAD, np.int64)
        first = np.concatenate([[0], np.cumsum(units)[:-1]])
        for t, f in zip(texts, first, strict=True):
            data[f * UNIT : f * UNIT + len(t)] = np.frombuffer(t, np.uint8)
        windows = self.windows(data, units.sum())
        z = windows @ p["w"]
        # a document's last window ends beyond its units: it sees PAD there, not the next document
        ends = (first + units) * (UNIT // STRIDE) - 1
        tail = windows[ends]
        tail[:, STRIDE * CODES.shape[1] :] = 0
        z[ends] = tail @ p["w"]
        z = z.reshape(-1, UNIT // STRIDE, FILTERS)
        unit = z.max(1)
        last = np.zeros(len(unit), bool)
        last[first + units - 1] = True
        after = np.where(last, np.arange(len(unit)), np.minimum(np.arange(len(unit)) + 1, len(unit) - 1))
        right = unit[after] > unit
        chunk = np.maximum(np.where(right, unit[after], unit) + p["b"], 0)
        # a document of several units has one chunk fewer than units
        use = ~(last & (np.repeat(units, units) > 1))
        own = chunk[use]
        counts = np.maximum(1, units - 1)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        mean = np.add.reduceat(own, starts) / counts[:, None]
        top, low = np.maximum.reduceat(own, starts), np.minimum.reduceat(own, starts)
        f = np.hstack([mean, top, low]).astype(np.float32)
        h, out = self.head(f)
        if not keep:
            return out
        return out, {"windows": windows, "ends": ends, "tail": tail, "z": z, "unit": unit, "after": after, "right": right, "own": own, "use": use, "counts": counts, "top": top, "low": low, "f": f, "h": h}

    def windows(self, data: np.ndarray, units: int) -> np.ndarray:
        """The codes in each window of so many units; data goes on for a window's overhang."""
        x = CODES[data]
        e = x.shape[1]
        return np.lib.stride_tricks.as_strided(x, (units * UNIT // STRIDE, WIDTH * e), (STRIDE * e * 4, 4))

    def head(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(f @ self.p["v"] + self.p["c"], 0)
        return h, 1 / (1 + np.exp(-np.clip((h @ self.p["u"] + self.p["d"])[:, 0].astype(np.float64), -40, 40)))

    def long(self, text: bytes) -> float:
        """The probability for one text of two units or more, of which only RUN_BYTES at a time are turned into windows."""
        units, per = -(-len(text) // UNIT), RUN_BYTES // UNIT
        total, top, low, before = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), np.full(FILTERS, np.inf, np.float32), None
        for at in range(0, units, per):
            n = min(per, units - at)
            data = np.full(n * UNIT + WIDTH, PAD, np.int64)
            own = np.frombuffer(text[at * UNIT : (at + n) * UNIT + WIDTH - STRIDE], np.uint8)
            data[: len(own)] = own
            unit = (self.windows(data, n) @ self.p["w"]).reshape(-1, UNIT // STRIDE, FILTERS).max(1)
            unit = unit if before is None else np.vstack([before, unit])
            before = unit[-1:]
            chunk = np.maximum(np.maximum(unit[:-1], unit[1:]) + self.p["b"], 0)
            if len(chunk):
                total, top, low = total + chunk.sum(0, dtype=np.float64), np.maximum(top, chunk.max(0)), np.minimum(low, chunk.min(0))
        return float(self.head(np.hstack([total / (units - 1), top, low]).astype(np.float32)[None])[1][0])

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        out, k = self.forward(texts, keep=True)
        g = ((out - y) / len(y)).astype(np.float32)[:, None]
        grads = {"u": k["h"].T @ g, "d": g.sum(0)}
        gh = (g @ p["u"].T) * (k["h"] > 0)
        grads |= {"v": k["f"].T @ gh, "c": gh.sum(0)}
        gf = gh @ p["v"].T
        of = np.repeat(np.arange(len(texts)), k["counts"])
        at_top, at_low = k["own"] == k["top"][of], k["own"] == k["low"][of]
        gown = (gf[of, :FILTERS] / k["counts"][of][:, None] + gf[of, FILTERS : 2 * FILTERS] * at_top + gf[of, 2 * FILTERS :] * at_low) * (k["own"] > 0)
        grads["b"] = gown.sum(0)
        gunit = np.zeros_like(k["unit"])
        rows = np.flatnonzero(k["use"])
        right = k["right"][rows]
        gunit[rows] += gown * ~right
        np.add.at(gunit, k["after"][rows], gown * right)
        which = k["z"].argmax(1)
        gz = np.zeros_like(k["z"])
        np.put_along_axis(gz, which[:, None, :], gunit[:, None, :], 1)
        gz = gz.reshape(-1, FILTERS)
        at_end = gz[k["ends"]]
        gz[k["ends"]] = 0
        grads["w"] = k["windows"].T @ gz + k["tail"].T @ at_end
        return grads

    def fit(self, texts: list[bytes], labels: list[int], steps: int = STEPS, rate: float = 0.004, seed: int = 2) -> Network:
        rng = np.random.default_rng(seed)
        y = np.array(labels, np.float32)
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        s = {n: np.zeros_like(v) for n, v in self.p.items()}
        order: list[int] = []
        for step in range(1, steps + 1):
            while len(order) < BATCH:
                order += rng.permutation(len(texts)).tolist()
            some, order = order[:BATCH], order[BATCH:]
            now = rate * min(1, 2 * (1 - (step - 1) / steps))
            for n, g in self.gradients([texts[i] for i in some], y[some]).items():
                m[n] = 0.9 * m[n] + 0.1 * g
                s[n] = 0.999 * s[n] + 0.001 * g * g
                self.p[n] = (self.p[n] - now * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[bytes]) -> list[float]:
        out: list[float] = []
        run, held = [], 0
        for t in [*texts, None]:
            if t is None or held + len(t) > RUN_BYTES:
                out += self.forward(run).tolist() if run else []
                run, held = [], 0
            if t is not None and len(t) > RUN_BYTES:
                out.append(self.long(t))
            elif t is not None:
                run.append(t)
                held += len(t) + UNIT
        return out


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id") -> Network | None:
    """A network fitted on a bounded, seeded sample of the labelled documents that are not held out."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    order = [F.xxhash64("k"), "k", "y"]
    some = usable.orderBy(*order).limit(TRAIN_ROWS)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.octet_length("t") <= TRAIN_BYTES)
    # some has TRAIN_ROWS rows at most; a repeated key may join more documents, hence the second limit
    rows = texts.join(F.broadcast(some), "k").orderBy(*order, "t").limit(TRAIN_ROWS)
    size = F.sum(F.octet_length("t")).over(Window.orderBy(*order, "t").rowsBetween(Window.unboundedPreceding, 0))  # TRAIN_ROWS rows
    rows = rows.withColumn("_size", size).where(F.col("_size") <= TRAIN_ALL).orderBy(*order, "t").collect()
    return Network().fit([r.t.encode() for r in rows], [r.y for r in rows]) if rows else None


def score(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """docs with score and predicted (score >= 0.5)."""
    kept = without(docs, *ADDED.fieldNames())
    schema = T.StructType([docs.schema[c] for c in kept] + ADDED.fields)
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few ten thousand numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for some in slices(batch, 256):
                texts = [(t or "").encode() for t in some.column(text).to_pylist()]
                found = shared.value.score(texts) if shared.value else [0.5] * len(texts)
                yield {c: some.column(c) for c in kept} | {"score": found, "predicted": [int(x >= 0.5) for x in found]}

    return map_batches(docs.select(*kept), schema, run)
