"""Line order and chunked sequences against plain reads, over many splits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidra.operators import motifs
from evidra.sources import lines, sequences, tables


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("few", [lines.FEW_SPLITS, 0])
def test_line_numbers(spark, tmp_path, small_splits, monkeypatch, few):
    monkeypatch.setattr(lines, "FEW_SPLITS", few)
    rng, want = random.Random(1), []
    for name in ("a.txt", "b.txt", "c.txt"):
        own = [f"{name} {i} {'x' * rng.randrange(60)}" for i in range(rng.choice([0, 90, 200]))] + [f"{name} end"]
        (tmp_path / name).write_text("\n".join(own) + "\n")
        want += own
    rows = spark.read.text(str(tmp_path))
    assert rows.rdd.getNumPartitions() > 5
    got = lines.numbered(rows).orderBy("line").collect()
    assert [r.value for r in got] == want and [r.line for r in got] == list(range(1, len(want) + 1))


def test_the_last_row_of_a_summary_wins(spark, tmp_path, small_splits):
    rng, last = random.Random(2), {}
    head = "symbol\tGRCh38_chr\tchr_start\tchr_end\tRefSeq_nuc\n"
    for name in ("1.tsv", "2.tsv"):
        rows = []
        for i in range(120):
            gene = f"G{rng.randrange(40)}"
            last[gene] = (len(last) + i) * 7 + rng.randrange(5)
            rows.append(f"{gene}\t1\t{last[gene]}\t9\tT\n")
        (tmp_path / name).write_text(head + "".join(rows))
    got = tables.read_gene_summary(spark, str(tmp_path))
    assert {r.gene: r.st for r in got.collect()} == last


def records(rng):
    alphabet = "ACGTacgtN"
    return {f"r{i}": "".join(rng.choice(alphabet) for _ in range(n)) for i, n in enumerate((5000, 1, 63, 64, 65, 0, 1300))}


@pytest.mark.parametrize(("length", "halo"), [(64, 10), (100, 100), (1 << 20, 64), (7, 20)])
def test_chunks_equal_the_sequence(spark, tmp_path, small_splits, length, halo):
    seqs = records(random.Random(3))
    for k, name in enumerate(("one.fa", "two.fa")):
        with open(tmp_path / name, "w") as f:
            for acc, s in list(seqs.items())[k::2]:
                f.write(f">{acc} some words\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) + "\n" * (acc == "r3"))
    raw = spark.read.text(str(tmp_path))
    assert length > 1000 or raw.rdd.getNumPartitions() > 5
    got = sequences.read_chunks(spark, str(tmp_path), length, halo).collect()
    found = {}
    for r in got:
        s = seqs[r.acc].upper()
        assert r.seq == s[r.start - 1 : r.own_end + halo] and r.start == max(1, r.own_start - halo) and r.own_start == r.chunk * length + 1
        found.setdefault(r.acc, []).append((r.own_start, r.own_end))
    for acc, s in seqs.items():
        own = sorted(found.get(acc, []))
        assert own == [(i + 1, min(i + length, len(s))) for i in range(0, len(s), length)]


def test_look_ups_and_scans_over_chunks(spark):
    rng = random.Random(4)
    seqs = {"a": "".join(rng.choice("ACGT") for _ in range(900)), "b": "GTAAGTCAGGTAAGT"}
    rows = spark.createDataFrame(list(seqs.items()), "acc string, seq string")
    chunks = sequences.chunked(rows, 50, 20)
    points = spark.createDataFrame([(acc, p) for acc, s in seqs.items() for p in (1, 2, 50, 51, len(s), len(s) + 1, 899)] + [("c", 1), (None, 5)], "acc string, pos long")
    for r in sequences.around(points, chunks, 7, 9, length=50).collect():
        s = seqs.get(r.acc, "")
        assert r.window == (s[max(0, r.pos - 8) : r.pos + 9] if r.pos <= len(s) else None), r
    got = {(r.acc, r["at"], r.score) for r in motifs.chunk_donor_sites(chunks).collect()}
    assert got == {(r.acc, r["at"], r.score) for r in motifs.donor_sites(rows).select("acc", "at", "score").collect()} and len(got) > 20
    made = {(r.acc, r.pos, r.base) for r in motifs.site_table(chunks.where("acc = 'a'"), 18).collect()}
    s, want = seqs["a"], set()
    places = [("a", s[p - 19 : p + 18], 19, b, p) for p in range(19, 900 - 17) for b in "ACGT" if s[p - 1] != b]
    one = motifs.created_sites(spark.createDataFrame(places, "acc string, seq string, at int, base string, pos long")).where(F.size("sites") > 0)
    want = {(r.acc, r.pos, r.base) for r in one.collect()}
    assert made == want and want


def test_a_change_is_applied_once_a_row(spark):
    rows = spark.createDataFrame([(i, "CTCTCTCTCTCTCTCTCAGGTAAGTCA"[: 27 - i % 3], 4 + i % 20, "ACGT"[i % 4]) for i in range(400)], "sid long, seq string, at int, base string")
    found = motifs.created_sites(rows)
    plan = found.select("sid", F.explode("sites").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(") == 1  # a step that names it many times would hold as many
    for r in found.collect():
        new, want = r.seq[: r.at - 1] + r.base + r.seq[r.at :], []
        for i in (r.at - 1, r.at):
            two, before = new[i - 1 : i + 1], new[max(0, i - 21) : i - 1]
            if i >= 1 and i < len(new) and two != r.seq[i - 1 : i + 1]:
                if two == "GT" and 3 < i <= len(new) - 5 and (k := sum(b in c for b, c in zip(new[i - 4 : i + 5], ("AC", "A", "G", "G", "T", "AG", "A", "G", "T"), strict=True))) >= 6:
                    want.append(("donor", i, float(k)))
                if two == "AG" and len(before) >= 12 and sum(b in "CT" for b in before) / len(before) >= 0.65:
                    want.append(("acceptor", i, sum(b in "CT" for b in before) / len(before)))
        assert [(x.kind, x.at, x.score) for x in r.sites] == want


def test_donors_of_chunks_are_sought_by_many_tasks(spark, monkeypatch):
    rng = random.Random(8)
    rows = spark.createDataFrame([("a", "".join(rng.choice("GTAC") for _ in range(3000)))], "acc string, seq string")
    monkeypatch.setattr(motifs, "DONOR_PLACES", 500, raising=False)
    found = motifs.chunk_donor_sites(sequences.chunked(rows, 100, 20))
    assert found.rdd.getNumPartitions() == 6
    assert {tuple(r) for r in found.collect()} == {(r.acc, r["at"], r.score) for r in motifs.donor_sites(rows).collect()}


def test_draws_of_the_null_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(3)
    chunks = sequences.chunked(spark.createDataFrame([("a", "".join(rng.choice("CTAGG") for _ in range(900)))], "acc string, seq string"), 100, 40)
    changes = spark.createDataFrame([(i, "a", 1 + 9 * i, "ACGT"[i % 4]) for i in range(100)], "sid long, acc string, pos long, base string")
    whole = motifs.motif_null(changes, chunks, "sid", 300, 200, 7, 30, 100).collect()
    dealt = []
    monkeypatch.setattr(motifs, "cut", lambda df, what, old=motifs.cut: dealt.append(df._jdf.queryExecution().optimizedPlan().toString()) or old(df, what))
    for name, value in (("BLOCK", 64), ("SHARE", 3), ("AT_ONCE", 2)):
        monkeypatch.setattr(motifs, name, value, raising=False)
    assert sorted(motifs.motif_null(changes, chunks, "sid", 300, 200, 7, 30, 100).collect()) == sorted(whole) and any(r.share > 0 for r in whole)
    assert "sequence(1, 300" not in dealt[-1] and "explode([1,2,3" not in dealt[-1]
