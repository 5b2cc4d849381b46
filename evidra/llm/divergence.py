"""Source divergence audit: what sources of a language say more often than it does as a whole, by sorted pointers to word starts.

Counting. A task takes the documents it reads in shards of about SHARD bytes. A shard is the texts' bytes as Arrow holds them, A-Z put
in lower case by a table; the places where a term starts are found from the byte classes, so no string is made for any word.
These pointers are sorted by multikey quicksort: a slice of pointers is split in three by the next eight bytes of its
terms (below, at, above a pivot), the middle part goes on with the eight bytes after; small slices are sorted as a whole. Where the
terms under neighbouring pointers are equal they form a run: one term, its documents and occurrences by language and source come
out, and only that is a string. Spark adds up (lang, source, term) over the shards.

Comparing. p of a term in a group is 1 + floor(10^9 * (count + 1) / (N + V)); two groups of a language differ in a term by
f = floor((p - q)^2 / q). Sums over all V terms are split by what is rare: terms that neither group has differ by one constant, terms
that only one has depend on its count alone, so a histogram of counts does for them; only terms that both have are
joined, and their share replaces the two others'. All sums are decimals, so nothing overflows or is rounded.

Defined results: null text, lang and source are empty strings; each row is a document, so repeated rows count each; a document's
null or repeated doc_id doesn't matter; a group without terms has all terms at count 0; a language without kept terms (V = 0) has
pairs of value 0 and no terms; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.common import cut, drop, map_batches

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, RANKS, UNIT = 3, 200, 1_000_000_000
#: Bytes of text that are sorted together; a longer text is a shard of its own.
SHARD = 8 << 20
#: Slices of pointers up to this size are sorted as a whole.
SMALL = 1 << 12
U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_TERM = np.array([c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])
COUNTS = T.StructType([T.StructField(n, T.StringType()) for n in ("lang", "source", "term")] + [T.StructField(n, T.LongType()) for n in ("n", "docs")])


def term_pointers(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms start and how long they are; no term goes beyond its text. offsets: the texts' starts and the last end."""
    inside = IS_TERM[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def next_bytes(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from depth on of each term as a number that sorts like them; bytes beyond the term are 0, which no term holds."""
    key = np.zeros(len(starts), U)
    for i in range(8):
        key |= np.where(lengths > depth + i, padded[starts + depth + i], 0).astype(U) << U(56 - 8 * i)
    return key


def goes_on(run: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Members of runs of several, of which one at least has bytes left to compare."""
    return (np.bincount(run)[run] > 1) & (np.bincount(run, longer)[run] > 0)


def multikey_sort(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their terms, and a mark where a term begins that differs from the one before."""
    n = len(starts)
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    work = [(0, n, 0, None)]
    while work:
        low, high, depth, key = work.pop()
        own = order[low:high].copy()
        if key is None:
            key = next_bytes(padded, starts[own], lengths[own], depth)
        if high - low > SMALL:
            pivot = np.sort(key[:: max(1, len(key) // 63)])[31 % max(1, len(key))]
            parts = [np.flatnonzero(m) for m in (key < pivot, key == pivot, key > pivot)]
            order[low:high] = own[np.concatenate(parts)]
            at = low
            for middle, part in zip((False, True, False), parts, strict=True):
                if len(part):
                    new[at] = True
                    if not middle:
                        work.append((at, at + len(part), depth, key[part]))
                    elif (lengths[own[part]] > depth + 8).any():  # equal so far, but not all at their end; those that are sort first
                        work.append((at, at + len(part), depth + 8, None))
                    at += len(part)
            continue
        # a small slice: all of it by the next bytes, then those that are still equal by those after, all at once
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        begin = np.ones(len(own), bool)
        begin[1:] = key[1:] != key[:-1]
        new[low:high] |= begin
        run = np.cumsum(begin)
        more = np.flatnonzero(goes_on(run, lengths[own] > depth + 8))
        while len(more):
            depth += 8
            mine = own[more]
            key = next_bytes(padded, starts[mine], lengths[mine], depth)
            by = np.lexsort((key, run[more]))  # runs are stretches of the slice, so what is moved stays within its run
            own[more] = mine = mine[by]
            key, group = key[by], run[more]
            begin = np.ones(len(more), bool)
            begin[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
            new[low + more] |= begin
            run[more] = stretch = np.cumsum(begin)
            more = more[goes_on(stretch, lengths[mine] > depth + 8)]
        order[low:high] = own
    return order, new


def shard_counts(texts: pa.Array, groups: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's texts, each of a group: terms; and for each term and group that has it: the term's place in that list, the group,
    occurrences, documents."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, lengths = term_pointers(raw, offsets)
    padded = np.concatenate([LOWER[raw], np.zeros(8 + int(lengths.max(initial=0)), np.uint8)])
    order, new = multikey_sort(padded, starts, lengths)
    starts, lengths = starts[order], lengths[order]
    run = np.cumsum(new) - 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    # one entry for each run and document, then for each run and group
    pairs, hits = np.unique(run * len(texts) + doc, return_counts=True)
    of, at = np.unique((pairs // len(texts)) * (int(groups.max(initial=0)) + 1) + groups[pairs % len(texts)], return_inverse=True)
    n, docs = np.bincount(at, hits).astype(np.int64), np.bincount(at)
    firsts = np.flatnonzero(new)
    terms = [padded[s : s + k].tobytes().decode() for s, k in zip(starts[firsts].tolist(), lengths[firsts].tolist(), strict=True)]
    span = int(groups.max(initial=0)) + 1
    return terms, of // span, of % span, n, docs


def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in stretches of about SHARD bytes of text."""
    held, size = [], 0
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column("text")), np.int64)
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(np.cumsum(sizes[at:]) + size, SHARD, "right")) + at
            upto = min(batch.num_rows, max(upto, at + (not held)))  # one row at least
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(sizes[at:upto].sum())
            if upto < batch.num_rows or size >= SHARD:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            at = upto
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it), a row a shard and group and term."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        import pyarrow.compute  # noqa: F401

        for shard in shards(batches):
            names: dict[tuple[str, str], int] = {}
            groups = np.array([names.setdefault(g, len(names)) for g in zip(shard.column("lang").to_pylist(), shard.column("source").to_pylist(), strict=True)], np.int64)
            terms, term, group, n, count = shard_counts(shard.column("text"), groups)
            if not len(n):
                continue
            own = list(names)
            taken = pa.array(group)
            yield {
                "lang": pa.array([g[0] for g in own], pa.string()).take(taken), "source": pa.array([g[1] for g in own], pa.string()).take(taken),
                "term": pa.array(terms, pa.string()).take(pa.array(term)), "n": n, "docs": count.astype(np.int64),
            }

    return map_batches(rows, COUNTS, run)


def share(count: Column, total: Column) -> Column:
    """p of a count, total being N + V."""
    return 1 + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def differ(p: Column, q: Column) -> Column:
    """f of two shares; their difference is at most 10^9, so its square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def times(f: Column, n: Column) -> Column:
    return f.cast("decimal(19,0)") * n.cast("decimal(18,0)")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: for each group the other sources of its language by how far its shares
    are from theirs, all of them; and the terms it has more often than the language, the first RANKS."""
    counts = cut(term_counts(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    whole = cut(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs"), "kept")
    kept = cut(counts.drop("docs").join(whole, ["lang", "term"]), "counts")
    drop(counts)
    # a row for each source of a language, those without terms too
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source))]).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("has"))
    langs = whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("total"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("own", "has", "v", "total")])
    groups = cut(groups.withColumn("none", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("own") + F.col("v")))), "groups")
    out = pairs(kept, groups).unionByName(over_terms(kept, groups))
    return cut_and_drop(out, whole, kept, groups)


def cut_and_drop(out: DataFrame, *tables: DataFrame) -> DataFrame:
    found = cut(out, "audit")
    drop(*tables)
    return found


def over_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Terms by how far the group's share is above the language's."""
    both = kept.join(groups.select("lang", "source", "own", "v", "total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("own") + F.col("v")), share(F.col("all"), F.col("total") + F.col("v"))
    above = both.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").withColumn("value", differ(F.col("p"), F.col("q")))
    own = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = above.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= RANKS)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Each two sources of a language, by the sum of their differences over all kept terms."""
    shares = kept.join(groups.select("lang", "source", "own", "v", "none"), ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("own") + F.col("v")).alias("p"), "none")
    shares = cut(shares, "shares")
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("none2"), F.col("has").alias("has2"))
    two = groups.select("lang", "source", "none", "has", "v").join(other, "lang").where("source <> item")
    # terms that one source has, by count, as if the other had none of them
    grades = cut(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k")), "grades")
    left = grades.join(other.select("lang", "item", "none2"), "lang").where("source <> item")
    left = left.groupBy("lang", "source", "item").agg(F.sum(times(differ(F.col("p"), F.col("none2")), F.col("k"))).alias("left"))
    right = grades.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "k").join(groups.select("lang", "source", "none"), "lang").where("source <> item")
    right = right.groupBy("lang", "source", "item").agg(F.sum(times(differ(F.col("none"), F.col("q")), F.col("k"))).alias("right"))
    # terms that both have: in place of what was counted for them as if one had none
    again = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("none2"))
    met = shares.drop("n").join(again, ["lang", "term"]).where("source <> item")
    less = lambda f: f.cast("decimal(19,0)")
    mend = less(differ(F.col("p"), F.col("q"))) - less(differ(F.col("p"), F.col("none2"))) - less(differ(F.col("none"), F.col("q")))
    met = met.groupBy("lang", "source", "item").agg(F.sum(mend).alias("mend"), F.count("*").alias("both"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(38,0)"))
    by = ["lang", "source", "item"]
    found = two.join(left, by, "left").join(right, by, "left").join(met, by, "left").withColumn("both", F.coalesce("both", F.lit(0)))
    neither = F.coalesce(times(differ(F.col("none"), F.col("none2")), F.col("v") - F.col("has") - F.col("has2") + F.col("both")), F.lit(0).cast("decimal(38,0)"))
    found = found.withColumn("value", (zero("left") + zero("right") + zero("mend") + neither).cast("long"))
    own = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(own).alias("rank"))


#: The same in DuckDB: every group with every kept term.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
x AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS total FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(CAST(n AS HUGEINT)) AS own, sum(CAST(total AS HUGEINT)) AS whole, count(*) AS v FROM x GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT x.lang, x.source, term, n, 1 + CAST({UNIT} AS HUGEINT) * (n + 1) // (own + v) AS p, 1 + CAST({UNIT} AS HUGEINT) * (total + 1) // (whole + v) AS q
  FROM x JOIN s ON s.lang = x.lang AND s.source = x.source),
two AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(two.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
over AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM over) q)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {RANKS}
"""
