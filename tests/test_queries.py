"""Every registered query against DuckDB over the same tables."""

from __future__ import annotations

import compare
import pytest
from pyspark.sql import functions as F

from evidra.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_written_folders_go_when_a_query_fails_too(spark):
    import os

    from evidra.plans import file_queries
    from evidra.shared import shared_dir

    shared_dir(spark)
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    with pytest.raises(ValueError, match="on purpose"), file_queries.folders(spark, "one", "two") as at:
        spark.range(3).write.parquet(at.one)
        raise ValueError("on purpose")
    found = file_queries.queue_state(spark, SF)
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert {f.rpartition("/")[2] for f in (found._cut_path,)} == left


def test_motif_null_against_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    from evidra.operators import motifs
    from evidra.sources import sequences

    rng, flank, draws, reach, length = random.Random(5), 30, 400, 150, 64
    seqs = {"a": "".join(rng.choice("CTCTAGG") for _ in range(700)), "b": "".join(rng.choice("ACGT") for _ in range(300)), "c": "ACGT" * 9}
    seqs["a"] = seqs["a"][:200] + "N" * 5 + seqs["a"][205:]
    chunks = sequences.chunked(spark.createDataFrame(list(seqs.items()), "acc string, seq string"), length, 40)
    places = [("a", 1), ("a", 31), ("a", 190), ("a", 203), ("a", 420), ("a", 700), ("b", 150), ("b", 300), ("c", 18)]
    rows = [(10 * i + j, acc, p, b) for i, (acc, p) in enumerate(places) for j, b in enumerate("ACGT")]
    changes = spark.createDataFrame(rows, "sid long, acc string, pos long, base string")
    got = {r.sid: (r.created, r.share) for r in motifs.motif_null(changes, chunks, "sid", draws, reach, 7, flank, length).collect()}
    consensus = ("AC", "A", "G", "G", "T", "AG", "A", "G", "T")

    def made(seq, p, base):
        old = seq[max(0, p - flank - 1) : p + flank]
        if p <= flank or len(old) < 2 * flank + 1 or "N" in old or old[flank] == base:
            return False
        new = old[:flank] + base + old[flank + 1 :]
        for i in range(len(new) - 1):
            two, before = new[i : i + 2], new[max(0, i - 20) : i]
            if two != old[i : i + 2]:
                if two == "GT" and sum(b in c for b, c in zip(new[i - 3 : i + 6], consensus, strict=True)) >= 6:
                    return True
                if two == "AG" and len(before) >= 12 and sum(b in "CT" for b in before) / len(before) >= 0.65:
                    return True
        return False

    offsets = {}
    for sid, i, o in spark.createDataFrame([(r[0],) for r in rows], "sid long").select("sid", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("i")).select("sid", "i", motifs.draw(F.col("sid"), F.col("i"), reach, 7)).collect():
        offsets.setdefault(sid, []).append(o)
    assert {abs(o) <= reach for own in offsets.values() for o in own} == {True} and len({o for own in offsets.values() for o in own}) > 1.9 * reach
    some = 0
    for sid, acc, p, base in rows:
        hits = sum(made(seqs[acc], p + o, base) for o in offsets[sid])
        some += hits
        assert got[sid] == (made(seqs[acc], p, base), pytest.approx(hits / draws)), (acc, p, base)
    assert some > 0


def test_sources_are_merged_by_as_many_tasks_as_there_are_variants_for(spark, con, monkeypatch):
    """Without a second shuffle, whose tasks would hold the more the larger the tables are; also where a key or number is missing."""
    from collections import Counter

    from evidra.plans import fixtures

    monkeypatch.setattr(fixtures, "DEALT", 250, raising=False)
    merged = queries.QUERIES["priority_merge"](spark, SF)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    held = merged.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(held) == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 250) and max(held) <= 2 * 250
    assert compare.differences(merged, con, queries.ORACLES["priority_merge"]) is None
    odd = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr(
        "nullif(l_orderkey, 7) * IF(l_linenumber = 2, -1, 1) AS l_orderkey", "nullif(l_partkey, 9) AS l_partkey", "nullif(l_suppkey, 3) AS l_suppkey", "nullif(l_linenumber, 3) AS l_linenumber", "l_quantity", "l_returnflag"
    )
    as_given = fixtures.view
    monkeypatch.setattr(fixtures, "view", lambda s, sf, name: odd.unionAll(odd) if name == "lineitem" else as_given(s, sf, name))
    rows = lambda df: Counter(tuple(r) for r in df.select("chrom", "pos", "ref", "alt", "src", "af", "an").collect())
    assert rows(fixtures.frequencies(spark, SF)) == rows(fixtures.view(spark, SF, "fr"))


def test_columns_are_appended_to_files_of_like_sizes_without_sorts(spark, con, monkeypatch):
    """A second shuffle of the rows, or sorts of them, took most of the first pass; with few files the later passes had few tasks."""
    from pathlib import Path

    from evidra.plans import file_queries, fixtures

    plans, files = [], {}
    write, read = file_queries.sinks.write_tsv, file_queries.tables.read_tsv

    def written(df, path, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, path, *more)

    def found(spark, path, *more):
        files[path.rpartition("/")[2].partition("-")[0]] = [f.stat().st_size for f in Path(path.removeprefix("file:")).glob("part-*")]
        return read(spark, path, *more)

    monkeypatch.setattr(fixtures, "DEALT", 250, raising=False)
    monkeypatch.setattr(file_queries.sinks, "write_tsv", written)
    monkeypatch.setattr(file_queries.tables, "read_tsv", found)
    few = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = file_queries.appended_columns(spark, SF)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", few)
    assert not [p for p in plans if "SortMergeJoin" in p] and "Exchange" not in plans[0]
    assert len(files["curated"]) == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 250) and max(files["curated"]) <= 2 * sum(files["curated"]) / len(files["curated"])
    assert compare.differences(got, con, queries.ORACLES["appended_columns"]) is None


def test_repeated_rows_are_appended_to_once_and_a_failed_pass_leaves_no_files(spark, monkeypatch):
    import os

    from evidra.plans import file_queries, fixtures
    from evidra.shared import shared_dir

    as_given = fixtures.view
    twice = lambda s, sf, name: as_given(s, sf, name).unionAll(as_given(s, sf, name)) if name == "lineitem" else as_given(s, sf, name)
    want = sorted(map(str, file_queries.appended_columns(spark, SF).collect()))
    monkeypatch.setattr(fixtures, "view", twice)
    monkeypatch.setattr(file_queries, "view", lambda s, sf, name: fixtures.view(s, sf, name))
    assert sorted(map(str, file_queries.appended_columns(spark, SF).collect())) == want
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    monkeypatch.setattr(file_queries.fields, "normal_contig", lambda c: F.raise_error(F.concat(F.lit("on purpose"), c)).cast("string"))
    with pytest.raises(Exception, match="on purpose"):
        file_queries.appended_columns(spark, SF)
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) == before


def test_normal_contigs(spark):
    from evidra.functions import fields

    names = {"1": "chr1", " chr22 ": "chr22", "CHRx": "chrX", "y": "chrY", "mt": "chrM", "chrM": "chrM", "0": None, "23": None, "01": None, "chrchr1": None, "": None, "chr": None, "chr1_alt": None, "1\n": None, None: None}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", fields.normal_contig(F.col("n")).alias("c"))
    assert {r.n: r.c for r in df.collect()} == names
