"""Literal cases of the operators: rules, traps, ties, nulls and empty inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidra.functions import fields, ranks, sequence
from evidra.operators import annotate, enrichment, genes, intervals, motifs, nested, scoring, tasks, text, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "want"), [("15", "chr15"), ("chr15", "chr15"), ("X", "chrX"), ("MT", "chrM"), ("chrM", "chrM"), ("Chr7", "chr7"), ("23", None), ("GL000", None), ("", None)])
def test_contigs(spark, name, want):
    assert one(spark, fields.normal_contig(F.lit(name))) == want


@pytest.mark.parametrize(("acc", "want"), [("NC_000001.11", "1"), ("NC_000023.11", "X"), ("NC_000024.10", "Y"), ("NC_012920.1", "MT"), ("NT_1.1", None)])
def test_accessions(spark, acc, want):
    assert one(spark, fields.accession_chrom(F.lit(acc))) == want


@pytest.mark.parametrize(("gt", "want"), [("0/0", "hom_ref"), ("1|1", "hom_alt"), ("0|1", "het"), ("1/2", "het"), ("./.", "missing"), ("0/.", "missing"), ("1", "missing"), (None, "missing")])
def test_zygosity(spark, gt, want):
    assert one(spark, fields.zygosity(F.lit(gt).cast("string"))) == want


def test_info_and_sample_bags(spark):
    info = F.lit("XAF=9;AF=.;AN=12;FLAG;AC=")
    assert one(spark, fields.info_number(info, "AF")) is None and one(spark, fields.info_number(info, "AN", "int")) == 12
    assert one(spark, fields.info_text(info, "AC")) is None and one(spark, fields.info_text(info, "NO")) is None
    got = [one(spark, fields.sample_value(F.lit("GT:AD:DP"), F.lit(s), k)) for s, k in (("0/1:3,4:7", "AD"), ("0/1", "AD"), ("0/1:.:7", "AD"), ("0/1:3,4:7", "GQ"), ("0/1:3,4:7", "DP"))]
    assert got == ["3,4", None, None, None, "7"]


def test_sequences(spark):
    assert one(spark, sequence.reverse_complement(F.lit("ACgtN"))) == "NacGT"
    assert [one(spark, sequence.amino_acid(F.lit(c))) for c in ("ATG", "taa", "TGG", "NNN", "AT")] == ["M", "*", "W", None, None]
    kinds = [one(spark, sequence.snv_class(F.lit(a), F.lit(b))) for a, b in (("A", "A"), ("A", "*"), ("*", "A"), ("A", "G"))]
    assert kinds == ["synonymous", "nonsense", "stop_loss", "missense"]
    lengths = [one(spark, sequence.length_class(F.lit(r), F.lit(a))) for r, a in (("A", "AT"), ("A", "ATTT"), ("ACG", "A"), ("A", "<DEL>"), ("A", "*"), ("A", "G"))]
    assert lengths == ["frameshift", "inframe", "frameshift", None, None, None]
    changes = [one(spark, sequence.protein_change(F.lit(a), F.lit(n), F.lit(b))) for a, n, b in (("M", 1, "V"), ("A", 7, "A"), ("R", 12, "*"))]
    assert changes == ["p.Met1?", "p.Ala7=", "p.Arg12Ter"]
    assert one(spark, sequence.donor_score(F.lit("CAGGTAAGT"))) == 9 and one(spark, motifs.motif_places(F.lit("GTGTGT"), "GTG")) == [1, 3]
    assert one(spark, motifs.motif_places(F.lit("G"), "GT")) == []


def test_interval_policies_against_brute_force(spark):
    rows = [("1", 10, 50, "a"), ("1", 10, 20, "b"), ("1", 15, 60, "c"), ("1", 40, 45, "d"), ("2", 5, 5, "e"), ("1", 70, 60, "bad"), ("1", 10, 20, "b"), ("1", 100000, 200000, "f")]
    iv = spark.createDataFrame(rows, "chrom string, st long, en long, gene string")
    points = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate([("1", p) for p in range(0, 70)] + [("2", p) for p in (4, 5, 6)] + [("1", 150000), ("3", 1), (None, 5)])], "vid long, chrom string, pos long")
    for policy, pick in (("first_start", min), ("last_start", max)):
        for pad in (0, 3):
            got = {(r.vid, r.gene) for r in intervals.interval_join(points, iv, policy, pad=pad).collect()}
            want = set()
            for p in points.collect():
                over = [(s, e, g) for c, s, e, g in rows if c == p.chrom and s - pad <= p.pos <= e + pad and s - pad <= e + pad and g != "bad"]
                if over:
                    want.add((p.vid, pick(over)[2]))
            assert got == want
    assert intervals.interval_join(points, iv.where("false")).count() == 0


@pytest.mark.parametrize("rows_", [7, 50_000])
@pytest.mark.parametrize("policy", ["first_start", "last_start"])
def test_winners_of_dense_intervals(spark, monkeypatch, policy, rows_):
    import random

    monkeypatch.setattr(intervals, "RANGE_ROWS", rows_)
    rng, rows = random.Random(rows_), []
    for c in "12":
        rows += [(c, i, 200 - i, f"nested{i}") for i in range(0, 60, 3)] + [(c, 1, 300, "whole")]
        rows += [(c, a, a + rng.choice([0, 2, 9, 40, 150]), f"g{rng.randrange(9)}") for a in (rng.randrange(250) for _ in range(40))]
    rows += [("3", 5, 5, "one"), ("3", 5, 5, None), ("3", 9, 2, "none"), (None, 1, 9, "no contig")]
    segments = intervals.winners(spark.createDataFrame(rows, "chrom string, st long, en long, gene string"), policy).collect()
    held = {}
    for r in segments:
        for x in range(r.seg_st, r.seg_en + 1):
            assert (r.chrom, x) not in held  # disjoint
            held[r.chrom, x] = r.gene
    pick = min if policy == "first_start" else max
    for c in "123":
        for x in range(0, 420):
            over = [(s, e, g is not None, g or "", g) for d, s, e, g in rows if d == c and s <= x <= e]
            assert held.get((c, x), "-") == (pick(over)[-1] if over else "-"), (c, x)


@pytest.mark.parametrize("policy", ["first_start", "last_start"])
def test_very_many_intervals_over_one_place(spark, policy):
    import time

    iv = spark.range(100_000).selectExpr("'1' AS chrom", "id AS st", "400000 - id AS en", "concat('g', id) AS gene")
    began = time.time()
    found = intervals.winners(iv, policy).collect()
    assert time.time() - began < 60
    assert len(found) == (1 if policy == "first_start" else len(found)) and sum(r.seg_en - r.seg_st + 1 for r in found) == 400_001
    assert policy == "first_start" or {r.gene for r in found if r.seg_st <= 150_000 <= r.seg_en} == {"g99999"}


def test_interval_join_left_and_plan(spark, monkeypatch):
    iv = spark.createDataFrame([("1", 10, 50, "a")], "chrom string, st long, en long, gene string")
    points = spark.createDataFrame([(1, "1", 10), (2, "1", 51)], "vid long, chrom string, pos long")
    assert {(r.vid, r.gene) for r in intervals.interval_join(points, iv, how="left").collect()} == {(1, "a"), (2, None)}
    monkeypatch.setattr(intervals, "FEW", 0)  # no broadcast hint
    joined = intervals.interval_join(points, iv)
    assert "Cartesian" not in joined._jdf.queryExecution().toString() and joined.count() == 1


def test_merged_spans(spark):
    df = spark.createDataFrame([("1", 0, 10), ("1", 12, 20), ("1", 30, 31), ("1", 5, 6), ("2", 0, 1)], "chrom string, st long, en long")
    assert sorted(map(tuple, intervals.merged_spans(df, 2, ["chrom"]).collect())) == [("1", 0, 20, 3), ("1", 30, 31, 1), ("2", 0, 1, 1)]


def test_alleles_of_one_site_do_not_hide_each_other(spark):
    v = spark.createDataFrame([("1", 5, "A", "C"), ("1", 5, "A", "G"), ("1", 6, "A", "G")], "chrom string, pos long, ref string, alt string")
    c = spark.createDataFrame([("1", 5, "A", "C", "P"), ("1", 5, "A", "G", "B"), ("1", 5, "A", "T", "U")], "chrom string, pos long, ref string, alt string, sig string")
    assert {(r.alt, r.exact, r.others) for r in annotate.site_matches(v, c).collect()} == {("C", "P", 2), ("G", "B", 2), ("G", None, 0)}


def test_merge_and_fail_closed(spark):
    s = "chrom string, pos long, ref string, alt string, src string, af double, an long"
    sources = spark.createDataFrame([("1", 1, "A", "C", "genome", 0.1, 5), ("1", 1, "A", "C", "exome", 0.2, 5), ("1", 2, "A", "C", "genome", None, 7), ("1", 2, "A", "C", "exome", 0.5, None)], s)
    best = annotate.priority_merge(sources)
    assert {(r.pos, r.src) for r in best.collect()} == {(1, "exome"), (2, "genome")}
    v = spark.createDataFrame([("g", "1", 1), ("g", "1", 2), ("g", "1", 3), ("h", "1", 3)], "gene string, chrom string, pos long").withColumns({"ref": F.lit("A"), "alt": F.lit("C")})
    got = annotate.fail_closed(v, best, spark.createDataFrame([("h",)], "gene string"))
    assert {(r.gene, r.pos, r["class"]) for r in got.collect()} == {("g", 1, "common"), ("g", 2, "rare"), ("g", 3, "absent"), ("h", 3, "unannotated")}


def test_last_row_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z")], "k string, n int, v string")
    assert {tuple(r) for r in annotate.last_by(df, ["k"], "n").select("k", "v").collect()} == {("a", None), ("b", "z")}


def test_phase_ignores_dots(spark):
    rows = [("a", ".", "."), ("a", ".", "."), ("b", "p", "0|1"), ("b", "p", "1|0"), ("c", "p", "0|1"), ("c", "p", "0|1"), ("d", "q", "0|1"), ("e", None, None)]
    got = genes.phase_verdict(spark.createDataFrame(rows, "gene string, pid string, pgt string"))
    assert {(r.gene, r.verdict) for r in got.collect()} == {("a", "unphased"), ("b", "trans"), ("c", "cis"), ("d", "separate"), ("e", "unphased")}


def test_statistics(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", 5.0), ("b", None), ("c", None)], "k string, x double")
    assert {(r.k, r.upper_median) for r in ranks.upper_median(df, ["k"], "x").collect()} == {("a", 3.0), ("b", 5.0)}
    assert {(r.k, r.q) for r in ranks.nearest_rank(df, ["k"], "x", 0.5, "q").collect()} == {("a", 2.0), ("b", 5.0)}
    hist = ranks.histogram(df.where("k = 'a'"), ["k"], F.floor("x"), 3)
    assert [(r.bin, r.n) for r in hist.orderBy("bin").collect()] == [(0, 0), (1, 1), (2, 3)]
    assert ranks.histogram_median(hist, ["k"]).first().median_bin == 2


def test_order_statistics_of_large_groups(spark, monkeypatch):
    import random

    monkeypatch.setattr(ranks, "SMALL", 40)
    rng = random.Random(1)
    of = {"most": [rng.gauss(0, 1) * 10 ** rng.randint(-5, 5) for _ in range(2500)], "few values": [float(rng.randint(0, 2)) for _ in range(500)], "one low": [0.0] + [1.0] * 300, "small": [1.0, 2.0, 3.0, 4.0], "one value": [7.0] * 99}
    df = spark.createDataFrame([(k, x) for k, own in of.items() for x in own] + [("none", None), (None, 1.0)], "k string, x double").cache()
    got = lambda f: {r.k: r.r for r in f.collect()}
    assert got(ranks.upper_median(df, ["k"], "x", "r")) == {k: sorted(v)[len(v) // 2] for k, v in of.items()}
    assert got(ranks.nearest_rank(df, ["k"], "x", 0.99, "r")) == {k: sorted(v)[int(0.99 * (len(v) - 1))] for k, v in of.items()}
    assert got(ranks.median(df, ["k"], "x", "r")) == {k: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2 for k, v in of.items()}
    # what is put in order is at most about SMALL values of a group, though one group has most rows
    kept, known = ranks.narrowed(df.na.drop(), ["k"], "x", 0.5, F.expr("n div 2"), F.expr("n div 2"))
    assert {r.k: r.n for r in kept.groupBy("k").agg(F.count_distinct("x").alias("n")).collect()}["most"] <= 40 and known.count() == 4
    plan = ranks.median(df, ["k"], "x", "r")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan
    df.unpersist()


def test_excess_keeps_windows_without_a_baseline(spark):
    schema = "chrom string, start long, n long, het long, observed double, expected double, depth long"
    some = [("1", 0, 100, 9, 2.0, 1.0, 3000), ("1", 1, 100, 9, 3.0, 1.0, 4000)]
    got = lambda rows, **o: {(r.chrom, r.start): (r.excess_norm, r.cov_ratio) for r in windows.excess(spark.createDataFrame(rows, schema), 2, **o).collect()}
    assert got(some) == {("1", 0): (pytest.approx(2 / 3), None), ("1", 1): (1.0, None)}  # no window of 500 sites
    assert got(some, min_sites=5) == {("1", 0): (pytest.approx(2 / 3), pytest.approx(0.75)), ("1", 1): (1.0, 1.0)}
    assert got([("X", 0, 900, 9, 2.0, 1.0, 900), ("Y", 0, 900, 9, 0.5, 1.0, 900), ("1", 5, 900, 0, None, None, 1800)]) == {("X", 0): (2.0, 0.5), ("Y", 0): (0.5, 0.5)}  # the autosome has no excess
    assert got([]) == {}


def test_runs(spark):
    df = spark.createDataFrame([("1", "g", i) for i in (1, 2, 3, 7, 8)] + [("1", "l", 4), ("2", "g", 5)], "chrom string, call string, i long")
    assert [tuple(r) for r in windows.runs(df, ["chrom", "call"], F.col("i"), 3).collect()] == [("1", "g", 1, 3, 3)]


def test_dose_and_cells(spark):
    assert [one(spark, windows.dose_verdict(F.lit(c), F.lit(e))) for c, e in ((1.5, 1.0), (0.5, 1.0), (1.1, 1.3), (0.9, 1.3), (1.0, 1.0))] == ["gain", "loss", "mosaic_gain", "mosaic_loss", "normal"]
    assert one(spark, windows.cell_share(F.lit(0.1), F.lit("gain"))) == pytest.approx(0.5) and one(spark, windows.cell_share(F.lit(0.4), F.lit("gain"))) is None


SUB = "line long, proband long, chrom_1 string, pos_1 string, ref_1 string, alt_1 string, chrom_2 string, pos_2 string, epcr double, finding_type string"


def sub(spark, *rows):
    base = (1, 1, "1", "5", "A", "C", "", "", 0.5, "")
    names = SUB.replace(",", "").split()[::2]
    return spark.createDataFrame([tuple(r.get(n, b) for n, b in zip(names, base, strict=True)) for r in rows], SUB)


@pytest.mark.parametrize(("row", "codes"), [({}, set()), ({"epcr": 0.0}, {"score"}), ({"chrom_2": "3"}, {"half_second"}), ({"chrom_1": "99"}, {"contig_1"}), ({"pos_1": "x"}, {"position_1"}), ({"alt_1": "A"}, {"same_alleles"}), ({"alt_1": "<DEL>"}, {"alt_1"}), ({"finding_type": "odd"}, {"finding"}), ({"chrom_2": "77", "pos_2": "1"}, {"contig_2"})])
def test_validation(spark, row, codes):
    assert {r.code for r in scoring.validate(sub(spark, row)).collect()} == codes


def test_validation_of_lists(spark):
    assert {r.code for r in scoring.validate(sub(spark, *[{"line": i, "epcr": (i + 1) / 20} for i in range(11)])).collect()} == {"too_many"}
    assert {r.code for r in scoring.validate(sub(spark, {"line": 1}, {"line": 2})).collect()} == {"tied_score"}


@pytest.mark.parametrize(("rank", "points"), [(1, 100), (2, 50), (3, 50), (4, 25), (5, 25), (6, 10), (10, 10), (11, 0)])
def test_points(spark, rank, points):
    assert one(spark, scoring.rank_points(F.lit(rank), F.lit(True), F.lit(True))) == points
    assert one(spark, scoring.rank_points(F.lit(rank), F.lit(True), F.lit(False))) == points / 2
    assert one(spark, scoring.rank_points(F.lit(rank), F.lit(False), F.lit(False))) == 0


@pytest.mark.parametrize(("rows", "f"), [([("a", 0.9, 1), ("b", 0.9, 1)], 1.0), ([("a", 0.9, 1), ("b", None, 1), ("b", 0.0, 1)], 1.0), ([("a", 0.9, 1), ("b", 0.9, 1)] + [(f"x{i}", 0.1, 0) for i in range(9)], 1.0), ([("w", 0.95, 0), ("a", 0.9, 1), ("b", 0.9, 1)], 0.8), ([("a", 0.9, 1), ("a", 0.2, 1), ("n", 0.5, 0)], 1.0)])
def test_best_f(spark, rows, f):
    assert scoring.best_f(spark.createDataFrame(rows, "item string, score double, truth int")).first().f == pytest.approx(f)


def test_enrichment(spark):
    from math import comb

    tests = spark.createDataFrame([(3, 5, 6), (0, 5, 6), (6, 5, 6), (4, 18, 18)], "k long, marked long, drawn long")
    got = {r.k: r.p for r in enrichment.hypergeometric_tail(tests, 20).collect()}
    tail = lambda k, m, d: sum(comb(m, i) * comb(20 - m, d - i) for i in range(k, min(m, d) + 1) if 0 <= d - i <= 20 - m) / comb(20, d)
    assert got == pytest.approx({3: tail(3, 5, 6), 0: 1.0, 6: 0.0, 4: 1.0})


def exact_log_tail(k, marked, drawn, n):
    """ln P(X >= k) with logarithms of forty digits, and the terms' ratios summed from the largest."""
    from decimal import Decimal, getcontext

    import numpy as np

    getcontext().prec = 45
    pi = Decimal("3.14159265358979323846264338327950288419716939937510")

    def lf(x):
        if x < 200:
            return sum((Decimal(i).ln() for i in range(2, x + 1)), Decimal(0))
        d = Decimal(x)
        return d * d.ln() - d + (2 * pi * d).ln() / 2 + 1 / (12 * d) - 1 / (360 * d**3) + 1 / (1260 * d**5) - 1 / (1680 * d**7)

    least, most = max(k, marked + drawn - n, 0), min(marked, drawn)
    i = max(least, min(most, (marked + 1) * (drawn + 1) // (n + 2)))
    top = lf(marked) + lf(drawn) + lf(n - marked) + lf(n - drawn) - lf(n) - lf(i) - lf(marked - i) - lf(drawn - i) - lf(n - marked - drawn + i)
    up = np.arange(i + 1, min(most, i + 1_000_000) + 1, dtype=float)
    down = np.arange(i, max(least, i - 1_000_000), -1, dtype=float)
    log_ratio = lambda x: np.log(marked - x + 1) + np.log(drawn - x + 1) - np.log(x) - np.log(n - marked - drawn + x)
    return float(top) + float(np.log(1 + np.exp(np.cumsum(log_ratio(up))).sum() + np.exp(np.cumsum(-log_ratio(down))).sum()))


def test_tails_of_large_populations(spark):
    cases = {
        10**9: [(10**7, 10**8, 10**8), (10**7 + 9000, 10**8, 10**8), (10**7 - 5000, 10**8, 10**8), (3, 5, 10**8), (0, 10, 10), (10**6, 10**6, 10**8 * 9), (40, 10**5, 10**5)],
        10**5: [(700, 5000, 9000), (450, 5000, 9000), (1, 3, 99_999), (0, 50_000, 60_000)],
    }
    for population, own in cases.items():
        got = enrichment.hypergeometric_tail(spark.createDataFrame(own, "k long, marked long, drawn long"), population).collect()
        assert len(got) == len(own)
        for r in got:
            want = exact_log_tail(r.k, r.marked, r.drawn, population)
            assert r.log_p == pytest.approx(min(0.0, want), rel=1e-9, abs=2e-9), (population, r)


def test_sets_that_share_nothing_are_not_crossed(spark):
    gs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "z")], "grp string, gene string")
    k = enrichment.shared_items(gs.withColumnRenamed("grp", "a"), gs.withColumnRenamed("grp", "b"))
    assert {tuple(r) for r in k.where("a < b").collect()} == {("a", "b", 1)}
    plan = k._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_panels_keep_their_order(spark):
    panel = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "gene string, place long")
    known = spark.createDataFrame([("a", 5, "x")], "gene string, n int, kind string")
    got = annotate.panel_join(panel, known, "gene", "place", n=0).orderBy("place").collect()
    assert [tuple(r) for r in got] == [("b", 1, 0, None), ("a", 2, 5, "x"), ("c", 3, 0, None)]


def test_signs_never_hide_what_a_detector_finds(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(egress_cases())] + [(-1, None), (-2, "x, \t12345,7"), (-3, "7 -   123456"), (-4, "chrX : 123456"), (-5, "m.\n5"), (-6, "c. *9")], "i int, t string")
    got = text.scan(docs, text="t")
    for name, p in text.DETECTORS.items():
        assert got.where(~F.col(f"has_{name}").eqNullSafe(F.coalesce(F.col("t").rlike(p), F.lit(False)))).count() == 0


def test_nested(spark):
    rows = [("t", [0.0, -2.0, None, -3.0], [("m", True), ("n", False)]), ("u", [], []), ("v", [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "symbol string, effects array<double>, tractability array<struct<modality string, value boolean>>")
    got = {r.symbol: (r.n, r.median_effect, r.dependent, r.tractable) for r in nested.target_summary(df).collect()}
    assert got == {"t": (3, -2.0, pytest.approx(2 / 3), True), "u": (0, None, None, False), "v": (2, 1.5, 0.0, None)}


def test_task_graph(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x"), ("e", None)], "task string, dep string")
    t = spark.createDataFrame([("a", True, 1), ("b", False, 1), ("c", False, 2), ("d", False, 3), ("e", False, 4)], "task string, done boolean, priority int")
    assert [tuple(r) for r in tasks.orphans(edges, t).collect()] == [("d", "x")]
    assert {r.task for r in tasks.ready(edges, t).collect()} == {"b", "e"}
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5)], "task long, dep long")
    assert {(r.task, r.length) for r in tasks.cyclic(spark, loop).collect()} == {(1, 3), (2, 3), (3, 3), (5, 1)}


def test_long_chains_and_cycles(spark):
    chain = [(i, i - 1) for i in range(2, 102)]
    got = {r.task: (r.root, r.depth) for r in tasks.ancestors(spark, spark.createDataFrame(chain, "task long, dep long")).collect()}
    assert got == {i: (1, i - 1) for i in range(2, 102)}
    ring = [(i, i % 30 + 1) for i in range(1, 31)]
    got = {r.task: r.length for r in tasks.cyclic(spark, spark.createDataFrame([*ring, (40, 3), (41, 40), (5, 50)], "task long, dep long")).collect()}
    assert got == dict.fromkeys(range(1, 31), 30)


def tables_left(spark):
    from pathlib import Path

    from evidra.shared import shared_dir

    return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}


def test_a_ladder_takes_rounds_by_the_logarithm_of_its_depth(spark, monkeypatch):
    rounds, real = [], tasks.cut
    monkeypatch.setattr(tasks, "cut", lambda df, what: rounds.append(what) or real(df, what))
    steps = 5000
    edges = spark.range(2, 2 * steps).selectExpr("explode(array(struct(id AS task, (id div 2 - 1) * 2 AS dep), struct(id AS task, (id div 2 - 1) * 2 + 1 AS dep))) AS e").select("e.*")
    before = tables_left(spark)
    got = tasks.ancestors(spark, edges)
    assert len(rounds) < 60 and got.where("depth <> task div 2 OR root <> 1").count() == 0 and got.count() == 2 * steps - 2
    assert len(tables_left(spark) - before) == 1  # the result


@pytest.mark.parametrize("growth", [16, 0])
def test_ways_of_different_lengths(spark, monkeypatch, growth):
    monkeypatch.setattr(tasks, "GROWTH", growth)
    edges = [(i, j) for i in range(1, 14) for j in range(i) if (i * 7 + j) % 3] + [(20, 21), (21, 22), (22, 21), (23, 1), (23, 20), (30, 30)]
    out = {}
    for t, d in edges:
        out.setdefault(t, set()).add(d)
    before = tables_left(spark)
    got = {r.task: (r.depth, r.root) for r in tasks.ancestors(spark, spark.createDataFrame(edges, "task long, dep long")).collect()}

    def far(t, path=()):
        if t in path:
            return None
        ways = [far(d, (*path, t)) if d in out else (0, d) for d in out[t]]
        return None if None in ways else max((k + 1, r) for k, r in ways)

    assert got == {t: far(t) or (None, None) for t in out}
    assert len(tables_left(spark) - before) == 1
    assert {r.task for r in tasks.cyclic(spark, spark.createDataFrame(edges, "task long, dep long")).collect()} == {21, 22, 30}
    assert len(tables_left(spark) - before) == 2


def test_graphs_against_brute_force(spark):
    import random

    rng, edges = random.Random(3), []
    for g in range(24):  # many small graphs at once
        n = rng.randint(2, 9)
        edges += [(100 * g + rng.randrange(n), 100 * g + rng.randrange(n)) for _ in range(rng.randint(1, 2 * n))]
    out = {}
    for t, d in edges:
        out.setdefault(t, set()).add(d)

    def length(t):
        seen, front, k = set(), {t}, 0
        while front:
            front, k = {d for x in front for d in out.get(x, ())} - seen, k + 1
            if t in front:
                return k
            seen |= front

    def far(t, path=()):
        """Depth and greatest root of the longest ways, or nothing where one runs into a cycle."""
        if t in path:
            return None
        ways = [far(d, (*path, t)) if d in out else (0, d) for d in out[t]]
        return None if None in ways else max((k + 1, r) for k, r in ways)

    df = spark.createDataFrame(edges, "task long, dep long")
    assert {r.task: r.length for r in tasks.cyclic(spark, df).collect()} == {t: k for t in out if (k := length(t))}
    assert {r.task: (r.depth, r.root) for r in tasks.ancestors(spark, df).collect()} == {t: far(t) or (None, None) for t in out}


def egress_cases():
    """By rule: texts that hold one thing of the kind, and near misses of it, with made-up values."""
    import random

    rng = random.Random(20)
    place = lambda: rng.randrange(10_000, 200_000_000)
    contig = lambda: rng.choice([str(rng.randint(1, 22)), "X", "Y"])
    wraps = ["the report says {}", "{}", "compare ({}) with the last run", "note: {}, to be confirmed"]
    of = {
        "coordinate": (lambda: f"{rng.choice(['', 'chr'])}{contig()}{rng.choice(':-')}{place()}", lambda: f"{rng.randint(1, 22)}:{rng.randrange(10, 60)}"),
        "spaced coordinate": (lambda: f"chr{rng.choice(['4', '17', 'X', 'M'])} {place()}", lambda: f"chromosome {contig()} has {place()} rows"),
        "record": (lambda: f"{contig()} {place() % 10**8 + 10**4} . {rng.choice('ACGT')} {rng.choice('ACGT')}", lambda: f"{contig()} {place() % 10**8 + 10**4} items and more"),
        "rsid": (lambda: f"{rng.choice(['rs', 'RS'])}{rng.randrange(100, 10**8)}", lambda: f"rs{rng.randrange(10, 99)}"),
        "accession": (lambda: f"{rng.choice(['NM', 'NC', 'XR', 'NP'])}_{rng.randrange(10**4, 10**7)}", lambda: f"NQ_{rng.randrange(10**4)}"),
        "coding change": (lambda: f"c.{rng.choice(['', '-', '*'])}{rng.randint(1, 4000)}{rng.choice(['', '+2', '-11'])}{rng.choice(['A>T', 'del', 'dup', 'insAC'])}", lambda: f"vol. c. {rng.randint(1, 4000)}"),
        "protein change": (lambda: f"p.{rng.choice(['', '('])}{rng.choice(['Ala', 'Trp', 'Lys'])}{rng.randint(1, 3000)}Ser", lambda: f"p = 0.{rng.randint(1, 99)}"),
        "sample": (lambda: f"{rng.choice(['sample', 'Patient', 'proband'])}{rng.choice(['_', '-', ': ', ' = '])}Q{rng.randint(1, 999)}", lambda: "samples of all patients"),
        "genotype": (lambda: rng.choice([f"GT {rng.choice(['0/1', '1|1', './.'])}", f"genotype={rng.choice(['0|1', '1/1'])}", f"0/1:{rng.randint(1, 60)},{rng.randint(1, 60)}"]), lambda: f"odds of {rng.randint(2, 9)} to 1"),
        "path": (lambda: f"{rng.choice(['cp', 'upload', 'tar czf -'])} {rng.choice(['data', 'work'])}/{rng.choice(['a.tsv', 'sub/b.json', ''])}", lambda: f"cp {rng.choice(['mydata', 'network', 'homework'])}/a.tsv ."),
        "genomic file": (lambda: f"f{rng.randint(1, 99)}.{rng.choice(['vcf', 'bam', 'fastq.gz', 'vcf.gz.tbi', 'cram', 'bcf'])}", lambda: f"f{rng.randint(1, 99)}.{rng.choice(['txt', 'md', 'csv'])}"),
        "named sample": (lambda: rng.choice(["ZK-31", "MAPLE4"]), lambda: rng.choice(["ZK-3", "MAPLE 4"])),
    }
    for kind, (bad, good) in of.items():
        for _ in range(8):
            yield kind, rng.choice(wraps).format(bad()), True
            yield kind, rng.choice(wraps).format(good()), False


def test_egress(spark):
    cases = list(egress_cases())
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(cases)] + [(-1, None)], "i int, t string")
    got = {r.i: r.b for r in df.select("i", text.blocked(F.col("t"), ("ZK-31", "MAPLE4")).alias("b")).collect()}
    assert [c for i, c in enumerate(cases) if got[i] != c[2]] == [] and got[-1] is False


def test_text(spark):
    assert one(spark, text.mask_identifiers(F.lit("id 12345 a.b@c.d 123"))) == "id #### ***@c.d 123"
    docs = spark.createDataFrame([(1, "a.\nb.\nc"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in text.line_hits(docs, "[.]$", 2).collect()] == [(1, 2)]
    for n in (0, 5, 1023, 1024, 1280, 1792, 1075, 1076, 1048575, 5 * 1024**2, 3 * 1024**3, 7 * 1024**4):
        unit = min(3, next(k for k in range(9) if n < 1024 ** (k + 1)))
        assert one(spark, fields.size_text(F.lit(n).cast("long"))) == f"{n / 1024**unit:.1f} {('B', 'KB', 'MB', 'GB')[unit]}"


def test_overlaps_are_counted_without_their_pairs(spark):
    import random
    from collections import Counter

    rng = random.Random(9)
    points = [(rng.choice(["1", "2", None]), rng.choice([5, rng.randrange(1, 400), rng.randrange(-3, 3000)]), rng.choice(["x", "y", None])) for _ in range(800)]
    spans = [("1", 0, 2999, "all"), ("1", 5, 5, "one"), ("2", 9, 8, "none"), ("2", -2, 0, "low"), (None, 1, 9, "lost"), ("1", 7, 7, "one")]
    spans += [(rng.choice("12"), a := rng.randrange(0, 2900), a + rng.randrange(0, 1 << rng.randrange(11)), f"g{i % 40}") for i in range(90)]
    table = spark.createDataFrame(spans, "chrom string, st long, en long, gene string")
    got = intervals.overlap_counts(spark.createDataFrame(points, "chrom string, pos long, kind string"), table, ["kind"])
    want = Counter((k, g) for c, p, k in points for d, a, b, g in spans if c is not None and c == d and a <= p <= b)
    assert {(r.kind, r.gene): r.n for r in got.collect()} == dict(want)
    # 20,000 points in 20,000 spans over one place: 400,000,000 pairs
    many = spark.range(20_000)
    got = intervals.overlap_counts(many.selectExpr("'1' AS chrom", "500 + id % 10 AS pos", "id % 2 AS kind"), many.selectExpr("'1' AS chrom", "id % 100 AS st", "1000 + id % 77 AS en", "id AS gene"), ["kind"])
    assert got.count() == 40_000 and got.where("n <> 10000").isEmpty()


def test_stretches_are_dealt_out_and_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(intervals, "SPANS", 100)
    points = spark.range(3000).selectExpr("CAST(id % 2 AS string) AS chrom", "id * 37 % 90000 AS pos", "id % 3 AS kind")
    table = spark.range(900).selectExpr("CAST(id % 2 AS string) AS chrom", "id * 91 % 80000 AS st", "id * 91 % 80000 + id * 13 % 9000 AS en", "id AS gene")
    got = intervals.overlap_counts(points, table, ["kind"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    # few bytes of intervals become many stretches, which a plan takes to be as few
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    # a number of tasks for the points, which are more than the intervals here
    assert plan.count(", 30), REPARTITION_BY_NUM") == 3 and "RoundRobinPartitioning(30)" in plan
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in intervals.overlapping(points, table).groupBy("kind", "gene").agg(F.count("*").alias("n")).collect()}


def test_points_that_meet_many_intervals_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(intervals, "MET", 100, raising=False)
    points = spark.range(3000).selectExpr("CASE WHEN id % 7 < 6 THEN CAST(id % 2 AS string) END AS chrom", "id * 37 % 90000 AS pos", "id AS n")
    table = spark.range(300).selectExpr("CAST(id % 3 AS string) AS chrom", "id * 91 % 80000 AS st", "id * 91 % 80000 + id * 1300 % 90000 - 9 AS en", "concat('g', id) AS gene")
    got = intervals.overlapping(points, table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count(", 30), REPARTITION_BY_NUM") == 2
    points.createOrReplaceTempView("dealt_points")
    table.createOrReplaceTempView("dealt_intervals")
    want = spark.sql("SELECT p.*, gene FROM dealt_points p, dealt_intervals i WHERE p.chrom = i.chrom AND pos BETWEEN st AND en").collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 9000


@pytest.mark.parametrize("name", ["gene_class_counts", "gene_disease_counts"])
def test_counts_in_genes_broadcast_nothing(spark, name):
    from evidra.plans import queries

    assert "Broadcast" not in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_cycles_are_sought_where_peeling_leaves_them(spark, monkeypatch):
    tree = [(i, i // 2) for i in range(2, 5000)] + [(1, 12), (77, 77)]
    seen = []
    monkeypatch.setattr(tasks, "branches", lambda edges, old=tasks.branches: seen.append(edges.count()) or old(edges))
    got = tasks.cyclic(spark, spark.createDataFrame(tree, "task long, dep long"))
    assert {r.task: r.length for r in got.collect()} == {1: 4, 3: 4, 6: 4, 12: 4, 77: 1}
    assert seen[0] < 20  # all 5,000 edges before
    chain = [(i, i + 1) for i in range(60)] + [(61, 60), (60, 61), (5, 3)]
    got = tasks.cyclic(spark, spark.createDataFrame(chain, "task long, dep long"))
    assert {r.task: r.length for r in got.collect()} == {3: 3, 4: 3, 5: 3, 60: 2, 61: 2}


def test_depths_are_taken_from_a_row_once(spark):
    from evidra.plans import queries

    plan = queries.QUERIES["depth_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") <= 10  # five for each of two keys; more where the filter and each column write them out


def test_sites_are_dealt_out_by_their_number(spark, monkeypatch):
    from evidra.plans import queries

    monkeypatch.setattr(queries, "SITES", 1000, raising=False)
    plan = queries.QUERIES["region_class"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [acc" in plan and ", 6" in plan.split("RepartitionByExpression [acc")[1].split("\n")[0]
