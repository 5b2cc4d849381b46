"""Near-duplicate documents by HyperMinHash registers, banding, a collision-corrected estimate and an exact check.

A document is the set of its distinct word shingles, as 64-bit hashes. Each hash falls by its first bits into one of
BUCKETS buckets; a bucket keeps its smallest hash as a register of 16 bits: the number of leading zeros plus one, then
the MANTISSA bits after the leading one (0: empty bucket). Bands of ROWS registers give the keys under which documents
meet; bands of empty buckets only give none. With 32 bands of 4 and all buckets full, a pair of similarity 0.85 is missed with
probability (1 - 0.85^4)^32 < 1e-10, of 0.8 with 5e-8; small sets leave buckets empty and differ in few bands. The tests
measure the recall for sets of all sizes.

Documents with equal sets are one class from the start (its smallest doc_id stands for it), so copies cost one group-by.
Pairs of representatives that share a band key are estimated from their registers, less the expected collisions of
unequal minima, and those not six standard errors below the threshold are compared on their full sets. Keys are worked
off in two waves. The first takes few bands and costs in proportion to the key's members: members are dealt to tiles,
each tile meets itself and the first tile. The second takes every key, of any band, whose members are not yet all
connected: all members outside its largest component meet all others, tile by tile. In a tile pairs already connected
are skipped, likely ones come first, and a pair is compared under the first key it shares only. Registers travel to the
tiles; full sets only to those tiles in which a document has a pair to compare. Only links that join
two parts of a tile are put out, never all pairs, and no tile exceeds about 2 * TILE documents. So every pair that
shares a key and is similar ends in one component; there are no caps.

Defined results: null, empty and blank texts have no shingles and link with nothing; fewer words than a shingle: the
whole sequence is the one shingle; null doc_id: linked with nothing, component null, kept; rows with one doc_id are one
document, which links if any of its texts does; empty table: no rows; other columns, whatever their names, are not carried
along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import cut, drop, map_batches, slices
from evidra.llm.components import connected_components

BUCKET_BITS, MANTISSA, ROWS = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS
FIRST_WAVE = 4
TILE = 256
RUN = 256
KEPT_WORDS = 200_000
#: Words of 64 bits of the filter that texts pass before they move.
WORDS = 1 << 18
U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Link texts whose sets of n-word shingles have 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = _Words()


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: ASCII letters in lower case, words between ASCII blanks."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.empty(0, U)
    h = np.fromiter(map(_words.__getitem__, own), U, len(own))
    k = min(words, len(own))
    z = np.full(len(own) - k + 1, 0x9E3779B97F4A7C15 + k, U)
    for i in range(k):
        z = (z ^ h[i : len(own) - k + 1 + i]) * U(0xFF51AFD7ED558CCD)
        z ^= z >> U(32)
    z *= U(0xC4CEB9FE1A85EC53)
    return np.unique(z ^ (z >> U(29)))


STARTS = np.arange(BUCKETS, dtype=U) << U(64 - BUCKET_BITS)
NUMBERS = np.arange(BUCKETS)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The register of each bucket, from sorted hashes."""
    at = np.searchsorted(hashes, STARTS)
    least = hashes[np.minimum(at, len(hashes) - 1)] if len(hashes) else np.zeros(BUCKETS, U)
    full = (at < len(hashes)) & ((least >> U(64 - BUCKET_BITS)) == NUMBERS)
    rest = (least << U(BUCKET_BITS)) >> U(11)  # 53 bits, exact as doubles
    zeros = (53 - np.frexp(rest.astype(np.float64))[1]).clip(0, 52).astype(U)
    mantissa = ((rest << (zeros + U(12))) >> U(64 - MANTISSA)).astype(U)
    return np.where(full, (zeros + U(1)) << U(MANTISSA) | mantissa, U(0)).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A key for each band, with the band in it; 0 for a band of empty buckets."""
    r = regs.reshape(BANDS, ROWS).astype(U)
    z = np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        z = (z ^ r[:, i]) * U(0xFF51AFD7ED558CCD)
        z ^= z >> U(33)
    return np.where(r.any(1), z | U(1), U(0))


def zero_shares(n: np.ndarray) -> np.ndarray:
    """For sets of n elements, the chance that a bucket's smallest hash has 0, 1, 2, ... leading zeros."""
    t = 2.0 ** -np.arange(54)
    below = 1 - np.exp(-np.outer(n / BUCKETS, t))
    return below[:, :-1] - below[:, 1:]


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of each a with each b from their registers, and the buckets in use. Equal registers count
    less those expected of unequal minima: both the same number of zeros, and the same mantissa by chance."""
    same = ((a[:, None, :] == b[None, :, :]) & (a[:, None, :] > 0)).sum(-1)
    used = ((a[:, None, :] > 0) | (b[None, :, :] > 0)).sum(-1)
    chance = (zero_shares(na) @ zero_shares(nb).T) * 2.0**-MANTISSA * used
    return np.maximum(0, same - chance) / np.maximum(1, used - chance), used


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact rule on full sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


@dataclass
class Member:
    node: int
    component: int
    tile: int
    regs: np.ndarray
    n: int
    hashes: np.ndarray


def due(key: int | None, members: list[Member], across: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of members, as positions and estimates, that may link two components: sizes allow for it, the estimate too,
    and key, if given, is the first that they share. across: only pairs of different tiles are due."""
    regs = np.stack([m.regs for m in members])
    keys = np.stack([band_keys(r) for r in regs]) if key is not None else None
    sizes = np.array([m.n for m in members])
    tiles = np.array([m.tile for m in members])
    parts = np.unique([m.component for m in members], return_inverse=True)[1]
    split = [np.flatnonzero(tiles == t) for t in np.unique(tiles)]
    if across and len(split) < 2:
        return
    left, right = split if across else (np.arange(len(members)),) * 2
    threshold = percent / 100
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        ok = parts[some][:, None] != parts[right][None, :]
        ok &= 100 * np.minimum.outer(sizes[some], sizes[right]) >= percent * np.maximum.outer(sizes[some], sizes[right])
        if not across:
            ok &= some[:, None] < right[None, :]
        if not ok.any():
            continue
        if keys is not None:
            shared = (keys[some][:, None, :] == keys[right][None, :, :]) & (keys[some][:, None, :] > 0)
            ok &= shared.any(-1) & (keys[some][np.arange(len(some))[:, None], shared.argmax(-1)] == U(key))
        like, used = estimate(regs[some], regs[right], sizes[some], sizes[right])
        ok &= like >= threshold - 6 * np.sqrt(threshold * (1 - threshold) / np.maximum(1, used))
        i, j = np.nonzero(ok)
        yield some[i], right[j], like[i, j]


def wanted(key: int | None, members: list[Member], across: bool, percent: int) -> list[int]:
    """Positions of the members with a pair that is due."""
    return sorted({int(x) for i, j, _ in due(key, members, across, percent) for x in (*i, *j)})


def links(key: int | None, members: list[Member], across: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join components among members that meet under key."""
    root, first = list(range(len(members))), {}
    for i, m in enumerate(members):
        root[i] = first.setdefault(m.component, i)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    found = []
    pairs = [x for i, j, like in due(key, members, across, percent) for x in zip((-like).tolist(), i.tolist(), j.tolist(), strict=True)]
    for _, i, j in sorted(pairs):
        a, b = find(i), find(j)
        if a != b and similar(members[i].hashes, members[j].hashes, percent):
            root[max(a, b)] = min(a, b)
            found.append((members[i].node, members[j].node))
    return found


SIGNED = T.LongType()
SETS = T.StructType([T.StructField("node", SIGNED), T.StructField("hashes", T.BinaryType())])
SIGNATURES = T.StructType([T.StructField("doc_id", SIGNED), T.StructField("text_hash", SIGNED), T.StructField("n_shingles", SIGNED), T.StructField("print", T.BinaryType()), T.StructField("regs", T.BinaryType())])
KEYS = T.StructType([T.StructField("node", SIGNED), T.StructField("key", SIGNED)])
LINKS = T.StructType([T.StructField("a", SIGNED), T.StructField("b", SIGNED)])


def signatures(docs: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """doc_id, xxhash64 of the text, number of shingles, 128-bit print of the set, registers (both null without shingles)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for some in slices(batch, RUN):
                sets = [shingles(t, words) for t in some.column("t").to_pylist()]
                yield {
                    "doc_id": some.column("doc_id"), "text_hash": some.column("text_hash"), "n_shingles": [len(s) for s in sets], "print": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "regs": [registers(s).tobytes() if len(s) else None for s in sets],
                }
        _words.clear()  # its memory is for the worker's next task, of whatever kind

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t")), SIGNATURES, run)


def with_keys(stand: DataFrame) -> DataFrame:
    """node, key: a row for each band key of a node's registers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for some in slices(batch, RUN):
                keys = [k[k > 0] for r in some.column("regs").to_pylist() for k in [np.unique(band_keys(np.frombuffer(r, np.uint16)))]]
                yield {"node": np.repeat(some.column("node").to_numpy(), [len(k) for k in keys]), "key": np.concatenate([*keys, np.empty(0, U)]).view(np.int64)}

    return map_batches(stand.select("node", "regs"), KEYS, run)


def sieved(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """texts whose node is among nodes, and few others: nodes set bits of a filter of 64 * WORDS bits, whose WORDS words are broadcast. So
    most texts that an exact join would drop don't move for it."""
    bit = F.pmod(F.xxhash64(F.lit("sieve"), "node"), F.lit(64 * WORDS))
    marked = lambda df: df.withColumn("_bit", bit).withColumns({"_w": F.shiftright("_bit", 6), "_mark": F.expr("shiftleft(1L, int(_bit & 63))")})
    words = marked(nodes).groupBy("_w").agg(F.bit_or("_mark").alias("_set"))
    return marked(texts).join(F.broadcast(words), "_w").where(F.col("_set").bitwiseAND(F.col("_mark")) != 0).select(*texts.columns)


class Sets:
    """Full sets of nodes, made from the texts when a node first needs its own; tables that are kept until done()."""

    def __init__(self, docs: DataFrame, rule: Rule, text: str, key: str) -> None:
        self.texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("t")).where("node IS NOT NULL")
        self.rule, self.tables = rule, []

    def of(self, chosen: DataFrame) -> DataFrame:
        """node, hashes of at least the nodes of chosen, a cut table."""
        nodes = chosen.select("node").distinct()
        for t in self.tables:
            nodes = nodes.join(t.select("node"), "node", "left_anti")
        nodes = cut(nodes, "nodes")
        words = self.rule.words

        def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for some in slices(batch, RUN):
                    yield {"node": some.column("node"), "hashes": [shingles(t, words).tobytes() for t in some.column("t").to_pylist()]}
            _words.clear()

        self.tables.append(cut(map_batches(sieved(self.texts, nodes).join(nodes, "node"), SETS, sets).where("length(hashes) > 0"), "sets"))
        drop(nodes)
        found = self.tables[0]
        for t in self.tables[1:]:
            found = found.unionByName(t)
        return found

    def done(self) -> None:
        drop(*self.tables)


def groups(batches: Iterable[pa.RecordBatch], full: bool) -> Iterator[tuple[tuple[int, int, int], list[Member]]]:
    """Runs of rows with one (key, i, j), as members, if there are several components."""
    now, members, none = None, [], np.empty(0, U)
    columns = ["key", "i", "j", "tile", "node", "component", "regs", "n", *["hashes"] * full]
    for batch in batches:
        for some in slices(batch, RUN):
            for k, i, j, tile, node, component, regs, n, *hashes in zip(*(some.column(c).to_pylist() for c in columns), strict=True):
                if (k, i, j) != now:
                    if len({m.component for m in members}) > 1:
                        yield now, members
                    now, members = (k, i, j), []
                members.append(Member(node, component, tile, np.frombuffer(regs, np.uint16), n, np.frombuffer(hashes[0], U) if full else none))
    if len({m.component for m in members}) > 1:
        yield now, members


def compare(meeting: DataFrame, brief: DataFrame, sets: Sets, once: bool) -> DataFrame:
    """Links, as a table, of meeting (key, i, j, tile, node, component): who meets under (key, i, j). First registers (brief: node,
    regs, n) decide which members have a pair to compare; only of these sets are made, and only these bring them. once: a pair is compared
    under its first key only."""
    percent = sets.rule.percent
    names = ["key", "i", "j", "tile", "node", "component"]
    unsigned = lambda k: k & (2**64 - 1) if once else None
    together = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for (k, i, j), members in groups(batches, False):
            if some := [members[x] for x in wanted(unsigned(k), members, i != j, percent)]:
                of = {"key": k, "i": i, "j": j}
                yield {n: [of[n]] * len(some) if n in of else [getattr(m, n) for m in some] for n in names}

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for (k, i, j), members in groups(batches, True):
            if found := links(unsigned(k), members, i != j, percent):
                yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

    schema = T.StructType([T.StructField(n, T.IntegerType() if n in ("i", "j", "tile") else SIGNED) for n in names])
    chosen = cut(map_batches(together(meeting.join(brief, "node")).select(*names, "regs", "n"), schema, choose), "chosen")
    rows = together(chosen.join(brief, "node").join(sets.of(chosen), "node")).select(*names, "regs", "n", "hashes")
    found = cut(map_batches(rows, LINKS, join), "links")
    drop(chosen)
    return found


def tiles(n: str) -> F.Column:
    return F.ceil(F.col(n) / TILE).cast("int")


def linear_wave(members: DataFrame) -> DataFrame:
    """Each tile of a key meets itself and the key's first tile."""
    m = members.withColumn("tiles", tiles("n")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    pairs = F.expr("IF(tile = 0, transform(sequence(0, tiles - 1), t -> struct(0 AS i, t AS j)), array(struct(0 AS i, tile AS j), struct(tile AS i, tile AS j)))")
    return m.withColumn("component", F.col("node")).select("key", "tile", "node", "component", F.inline(pairs))


def full_wave(m: DataFrame, keys: DataFrame) -> DataFrame:
    """Of each key whose members (key, node, component) are in several components: those outside its largest one meet all."""
    m = m.join(keys, "key").withColumn("few", tiles("minor")).withColumn("many", tiles("major"))
    h = F.xxhash64("node")
    m = m.withColumn("tile", F.when(F.col("component") == F.col("top"), F.col("few") + F.pmod(h, F.col("many"))).otherwise(F.pmod(h, F.col("few"))).cast("int"))
    pairs = F.expr(
        "IF(tile >= few, transform(sequence(0, few - 1), t -> struct(t AS i, tile AS j)),"
        " transform(sequence(0, few + many - 1), t -> struct(least(t, tile) AS i, greatest(t, tile) AS j)))"
    )
    return m.select("key", "tile", "node", "component", F.inline(pairs))


def open_keys(m: DataFrame) -> DataFrame:
    """Keys whose members (key, node, component) are in several components: the largest one, its members and the others."""
    parts = m.groupBy("key", "component").agg(F.count("*").alias("k"))
    keys = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("k").alias("all"), F.max(F.struct("k", "component")).alias("top")).where("parts > 1")
    return keys.select("key", F.col("top.component").alias("top"), F.col("top.k").alias("major"), (F.col("all") - F.col("top.k")).alias("minor"))


def near_duplicates(docs: DataFrame, rule: Rule | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id (smallest
    doc_id reachable by links), kept, text_hash (xxhash64 of the text)."""
    # what is joined with many rows a key is a table first, so that neither side of the join is an aggregate: then a large key can
    # be split over tasks
    rule = rule or Rule()
    signed = cut(signatures(docs, rule.words, text, key), "signatures")
    usable = signed.where("print IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(usable.groupBy("print").agg(F.min("doc_id").alias("node")), "classes")
    stand = usable.join(classes, [usable["print"] == classes["print"], usable["doc_id"] == classes["node"]]).select("node", "regs", F.col("n_shingles").alias("n"))
    brief = cut(stand.distinct(), "brief")
    meet = cut(with_keys(brief), "keys")
    counts = cut(meet.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    members = cut(meet.join(counts, "key"), "members")
    drop(meet, counts)
    sets = Sets(docs, rule, text, key)
    # the first wave's keys: FIRST_WAVE in BANDS of all, taken by the key's hash, the same for all who meet under it
    some = members.where(F.pmod(F.xxhash64("key"), F.lit(BANDS)) < FIRST_WAVE)
    first = compare(linear_wave(some), brief, sets, once=False)
    labels = connected_components(first)
    labelled = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    labelled = cut(labelled, "labelled")
    drop(members, labels)
    keys = cut(open_keys(labelled), "open")
    second = compare(full_wave(labelled, keys), brief, sets, once=True)
    sets.done()
    drop(brief, labelled, keys)
    labels = connected_components(first.unionByName(second))
    linked = cut(classes.join(labels, "node", "left").select("print", "node", F.coalesce("component", "node").alias("component")), "linked")
    drop(first, second, classes, labels)
    found = signed.join(linked, "print", "left")
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", F.when(known, F.coalesce("node", "doc_id")).alias("class_id"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash")
