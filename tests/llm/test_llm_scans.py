"""License scan, source divergence and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SF

from evidra.llm import centroids, divergence, licenses, queries

FOLD = str.maketrans(licenses.UPPER, licenses.LOWER)

# ---------------------------------------------------------------- license scan


def brute_scan(text, templates):
    """n_words, n_base, first, last, base labels, labels, score by looking at every block with every template."""
    words = re.findall(licenses.WORD, (text or "").translate(FOLD))
    base, labels, places, score = set(), set(), [], 0.0
    for t in templates:
        own, need = set(t.words), t.need
        for start in range(0, len(words) + 1, t.width):
            held = len(own & set(words[start : start + 2 * t.width]))
            if held < need:
                continue
            at = [i for i in range(start, start + t.width) if words[i : i + len(t.words)] == t.words]
            if t.phrase and not at:
                continue
            labels.add(t.label)
            score = max(score, held / len(own))
            if t.phrase:
                base.add(t.label)
                places += at
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def scanned(spark, rows, templates=licenses.PHRASES + licenses.NOTICES):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in licenses.scan(df, templates).collect()), key=str)


def test_license_scan_equals_brute_force(spark):
    rng, all_ = random.Random(1), licenses.PHRASES + licenses.NOTICES
    rows = [(0, None), (1, ""), (2, " .,! "), (3, "MIT LICENSE"), (4, "mit, license; the MIT\nLicense"), (5, "cc by cc by"), (6, "ccby cc-by"), (7, "Apache Licénse apache license"), (None, "GNU General Public License"), (3, "MIT LICENSE"), (3, "MIT LICENSE")]
    filler = [w for t in all_ for w in t.words] + ["lorem", "ipsum", "été", "Größe"] * 40
    for i in range(8, 90):
        words = [rng.choice(filler) for _ in range(rng.choice([0, 3, 15, 16, 17, 40, 130, 600]))]
        for _ in range(rng.randrange(3)):
            t, at = rng.choice(all_), rng.randrange(len(words) + 1)
            own = list(t.words)
            for _ in range(rng.randrange(0, 1 + len(own) // 4)):
                own[rng.randrange(len(own))] = "changed"
            words[at:at] = own
        rows.append((i, rng.choice([" ", "\n", ", "]).join(words)))
    want = sorted([(d, *brute_scan(t, all_)) for d, t in rows], key=str)
    assert scanned(spark, rows) == want
    assert sum(w[2] for w in want) > 10 and len({w[6] for w in want}) > 8
    assert scanned(spark, []) == []


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.8, 1.0])
def test_the_join_loses_no_block(spark, threshold):
    """Random templates over few words, so that very many blocks are near the threshold."""
    rng = random.Random(int(10 * threshold))
    alphabet = [f"t{i}" for i in range(25)]
    templates = tuple(licenses.Template(f"l{i}", " ".join(rng.sample(alphabet, rng.randint(1, 14))), threshold) for i in range(12))
    rows = [(i, " ".join(rng.choice(alphabet[: rng.randint(3, 25)]) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    assert scanned(spark, rows, templates) == sorted([(d, *brute_scan(t, templates)) for d, t in rows], key=str)


def test_license_blocks_come_once_each(spark):
    words = list(licenses.NOTICES[9].words)
    docs = spark.createDataFrame([(1, " ".join(["x"] * 200 + words)), (2, " ".join(words + words))], "doc_id long, text string").withColumnsRenamed({}).selectExpr("doc_id", "text", "1 AS words", "2 AS part", "3 AS n_words")
    got = licenses.blocks(docs).where("label = 'mit' AND places IS NULL AND size > 20").collect()
    assert len({(r.doc_id, r.template, r.start) for r in got}) == len(got) and {r.doc_id for r in got} == {1, 2}
    assert all(r.held >= licenses.NOTICES[9].need for r in got)


def test_license_scan_has_no_python(spark):
    df = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = licenses.scan(df.selectExpr("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)
    table = queries.op11_license_scan(spark, SF)
    assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()


def test_a_megabyte_text_is_scanned_whole(spark):
    text = "word " * 300_000 + "Released under the MIT License."
    assert scanned(spark, [(1, text)]) == [(1, *brute_scan(text, licenses.PHRASES + licenses.NOTICES))]


# ---------------------------------------------------------------- source divergence


def brute_audit(rows):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(FOLD) for w in re.findall(divergence.TERM, text or "")]
        groups.add((lang, source))
        count[lang, source].update(words)
        df[lang].update(set(words))
    out = set()
    for lang, source in groups:
        kept = [t for t, k in df[lang].items() if k >= 3]
        sources = sorted(s for x, s in groups if x == lang)
        share = {s: {t: 1 + 10**9 * (count[lang, s][t] + 1) // (sum(count[lang, s][x] for x in kept) + len(kept)) for t in kept} for s in sources}
        all_ = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        whole = {t: 1 + 10**9 * (all_[t] + 1) // (sum(all_.values()) + len(kept)) for t in kept}
        p = share[source]
        pairs = [(sum((p[t] - share[s][t]) ** 2 // share[s][t] for t in kept), s) for s in sources if s != source]
        terms = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if count[lang, source][t] > 0 and p[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked[: None if part == "pair" else 200])}
    return out


def audit_rows(rng, n):
    words = [f"{w}{rng.choice(['', 'er', 'ung', 'é'])}" for w in ("alpha", "Beta", "gamma", "delta", "straße", "naïve", "x", "abcdefgh", "abcdefghi", "abcdefghijklmnopq")] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice(["hot"] * 6 + ["s1", "s2", "S2", "ß", None, ""])
        rows.append((lang, source, rng.choice([None, "", "12 34", " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))])))
    return [*rows, ("xx", "a", "only once"), ("xx", "b", None), ("yy", "one", "aa aa"), ("yy", "one", "aa"), ("yy", "one", "aa")]


@pytest.mark.parametrize(("small", "shard"), [(4096, 8 << 20), (8, 900), (1, 1)])
def test_divergence_equals_brute_force(spark, monkeypatch, small, shard):
    rows = audit_rows(random.Random(small), 400)
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS term", "2 AS n", "3 AS docs", "4 AS item")
    counted = divergence.term_counts

    def patched(*a):  # the tasks' own constants
        return counted(*a)

    monkeypatch.setattr(divergence, "SMALL", small)
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "term_counts", patched)
    got = {tuple(r) for r in divergence.audit(df).collect()}
    assert got == brute_audit(rows)
    assert divergence.audit(df.where("false")).count() == 0


@pytest.mark.parametrize("small", [4096, 64, 8, 1])
def test_pointers_are_sorted(monkeypatch, small):
    monkeypatch.setattr(divergence, "SMALL", small)
    rng = random.Random(small)
    for _ in range(40):
        words = ["".join(rng.choice(["ab", "A", "é", "ﬀ", "zzzzzzzz"]) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 40))]
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(1, 9))]
        want = Counter((w.translate(FOLD), i) for i, t in enumerate(texts) for w in re.findall(divergence.TERM, t))
        array = pa.array(["skipped", *texts], pa.string()).slice(1)
        terms, term, group, n, docs = divergence.shard_counts(array, np.arange(len(texts)))
        assert terms == sorted(set(terms), key=str.encode) and set(docs.tolist()) <= {1}
        assert {(terms[a], int(b)): int(k) for a, b, k in zip(term, group, n, strict=True)} == dict(want)


def test_terms_end_with_their_text():
    terms, *_ = divergence.shard_counts(pa.array(["ab", "cd", "", "e"], pa.string()), np.zeros(4, np.int64))
    assert terms == ["ab", "cd", "e"]
    assert divergence.shard_counts(pa.array(["", ""], pa.string()), np.zeros(2, np.int64))[0] == []


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total = 3 * 10**12 + 7, 9 * 10**12
    r = spark.range(1).select(divergence.share(F.lit(n), F.lit(total)).alias("p"), divergence.differ(F.lit(10**9).cast("long"), F.lit(3).cast("long")).alias("f")).first()
    assert r.p == 1 + 10**9 * (n + 1) // total and r.f == (10**9 - 3) ** 2 // 3


# ---------------------------------------------------------------- centroid clustering


def brute_nearest(x, c):
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("spread", [3, 50, 100_000])
def test_orchard_finds_the_nearest(spread):
    rng = np.random.default_rng(spread)
    for k in (1, 2, 8, 40):
        c = rng.integers(-spread, spread + 1, (k, 5))
        c[rng.integers(k)] = c[0]  # equal centroids
        x = np.vstack([rng.integers(-2 * spread, 2 * spread + 1, (500, 5)), c, (c[:1] + c[-1:]) // 2])
        now, best = centroids.Orchard(c).nearest(x)
        want = brute_nearest(x, c)
        assert (now == want[0]).all() and (best == want[1]).all()
    assert len(centroids.Orchard(c).nearest(x[:0])[0]) == 0


def test_orchard_looks_at_few_centroids():
    rng = np.random.default_rng(1)
    c = rng.integers(-10**6, 10**6, (64, 3))
    x = c[rng.integers(64, size=5000)] + rng.integers(-1000, 1000, (5000, 3))
    search = centroids.Orchard(c)
    assert (search.nearest(x)[0] == brute_nearest(x, c)[0]).all() and search.looked < len(x) * 16


def brute_clusters(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(scale * float(np.float64(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    c = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds if c else 0):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else old for j, old in enumerate(c)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, j, d in placed:
        sums[j] += d
    return sorted([(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in placed], key=str)


def clustered(spark, rows, **o):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS distance", "3 AS v")
    return sorted((tuple(r) for r in centroids.with_inertia(*centroids.cluster(df, **o)).collect()), key=str)


@pytest.mark.parametrize(("n", "k", "rounds", "seed"), [(120, 8, 10, 3), (120, 5, 1, 9), (5, 8, 10, 3), (40, 8, 0, 3), (1, 1, 10, 3)])
def test_clusters_equal_brute_force(spark, n, k, rounds, seed):
    rng = random.Random(n + k)
    rows = [(i, [rng.choice([-1.5, -0.001, 0.0, 0.25, rng.random()]) for _ in range(4)]) for i in range(n)]
    rows += [(2, rows[0][1]), (2, rows[0][1]), (None, [0.1] * 4)] if n > 5 else []
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0]), (902, [float("nan")] * 4), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, [1.0] * 3), (905, [1.0] * 5), (906, [])]
    assert clustered(spark, rows + odd, k=k, rounds=rounds, dim=4, seed=seed) == brute_clusters(rows, k, rounds, 4, 1024, seed)


def test_clusters_of_nothing_and_too_large_vectors(spark):
    assert clustered(spark, [], dim=4) == [] and clustered(spark, [(1, [1.0])], dim=4) == []
    assert len(clustered(spark, [(i, [7.0] * 4) for i in range(20)], dim=4)) == 20  # all centroids are equal, most empty
    with pytest.raises(Exception, match="beyond"):
        clustered(spark, [(1, [1e300] * 4)], dim=4)


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_source_divergence", "op13_centroid_clustering"])
def test_scans_equal_sql(spark, name):
    import compare

    assert compare.differences(queries.QUERIES[name](spark, SF), compare.connect(SF), queries.ORACLES[name]) is None
