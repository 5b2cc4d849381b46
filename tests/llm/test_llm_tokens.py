"""Token counts, shards and packing against the tokenizer's library itself."""

from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

import pytest
from conftest_llm import SF, docs_frame

from evidra.llm import packing, queries, sstable, token_counts
from evidra.llm.tokens import Encoder, default_path

ODD = [None, "", " ", "a", "<|endoftext|> x<|endoftext|>", "é\xa0ß \x1c\x85", "日本語 👍🏽 ok", "word " * 30000, "x" * 5000, "\n\n  \t", "same", "same"]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_encoder_equals_library_on_random_texts():
    rng = random.Random(5)
    chars = " \n\t\r'sdtmlrev12.!<|endoftext|>é ßA$_’\x85\xa0\x1c\x0b¼ªÿĀ中‍"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    assert Encoder(default_path()).encode(texts) == [packed(x) for x in library(texts)]


def test_encoder_takes_other_files():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["Some words, and éa", "", "a  b"]
    own = public_tokenizers.path("piece_bpe_32k.model")
    assert Encoder(own).encode(texts) == [packed(x) for x in sentencepiece.SentencePieceProcessor(model_file=own).encode(texts)]
    own = public_tokenizers.path("word_bpe_49k.json")
    assert Encoder(own).encode(texts) == [packed(e.ids) for e in Tokenizer.from_file(own).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("source", ["table", "odd", "empty"])
def test_counts(spark, source):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if source == "table" else docs_frame(spark, ODD if source == "odd" else [])
    got = sorted(map(tuple, token_counts.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))
    rows = docs.select("doc_id", "text").collect()
    want = sorted((d, len((t or "").encode()), len(i), len(i) > 1024) for (d, t), i in zip(rows, library(t or "" for _, t in rows), strict=True))
    assert got == want


def test_very_long_pre_tokens_are_counted(spark):
    rng = random.Random(4)
    text = "".join(rng.choices("ACGT", k=200_000))
    pieces, lengths = token_counts.frequent_lengths(docs_frame(spark, [text, "a b"]), "text", default_path())
    assert len(lengths) and text.encode() not in pieces
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs_frame(spark, [text, "a b"])).collect()}
    assert got[0] > 65_535 and got[0] == len(library([text])[0])


def test_the_table_holds_what_is_frequent_in_all_documents(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_ENTRIES", 3)
    monkeypatch.setattr(token_counts, "HELD_ENTRIES", 50)
    texts = [" the of" * 40 + "".join(f" w{i}x{k}" for k in range(30)) for i in range(60)] + [" late" * 3000]
    pieces, lengths = token_counts.frequent_lengths(docs_frame(spark, texts).repartition(5), "text", default_path())
    assert set(pieces.decode().split("\0")) == {" the", " of", " late"} and len(lengths) == 3


def test_counts_keep_other_columns_and_replace_clashing_ones(spark):
    docs = spark.createDataFrame([(1, "a b", "old", None)], "doc_id long, text string, N_Tokens string, extra int")
    out = token_counts.count_tokens(docs)
    assert out.columns == ["doc_id", "text", "extra", "n_bytes", "n_tokens", "over_limit"]
    assert out.first().n_tokens == 2


@pytest.mark.parametrize("source", ["table", "odd", "empty"])
def test_shards_round_trip(spark, source, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if source == "table" else docs_frame(spark, ODD if source == "odd" else [])
    manifest = sstable.write_shards(docs, str(tmp_path / "s"), shard_bytes=50_000 if source == "table" else 100)
    assert source == "empty" or manifest.count() > 3
    got = sorted((tuple(r) for r in sstable.read_shards(manifest).collect()), key=lambda r: r[1])
    rows = docs.select("doc_id", "text").collect()
    want = defaultdict(list)
    for (d, _), i in zip(rows, library(t or "" for _, t in rows), strict=True):
        want[d].append(packed([*i, 0]))
    at = 0
    for _, start, ids in got:
        assert start == at
        at += len(ids) // 4
    assert [d for d, *_ in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    assert {d: sorted(x for e, _, x in got if e == d) for d in want} == {d: sorted(x) for d, x in want.items()}
    for s in manifest.collect():
        reader = sstable.Reader(s["path"])
        for d, ids in reader:
            assert ids in reader.get(d)
        assert reader.get(987654321) == []


def test_starts_run_over_ranges_of_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "RANGE", 2)
    monkeypatch.setattr(sstable, "partitions", lambda *_: 7)
    docs = docs_frame(spark, [f"w{i} " * (i % 9) for i in range(120)])
    manifest = sorted(sstable.write_shards(docs, str(tmp_path / "s"), shard_bytes=200).collect(), key=lambda s: (s.part, s.shard))
    assert len({s.part for s in manifest}) > 4 and max(s.shard for s in manifest) > 0
    assert [s.start for s in manifest] == [sum(r.ids for r in manifest[:k]) for k in range(len(manifest))]
    assert [s.first_doc for s in manifest] == sorted(s.first_doc for s in manifest)


def test_filter_passes_few_absent_keys(tmp_path):
    writer = sstable.Writer(str(tmp_path / "s.sst"))
    for i in range(0, 40_000, 2):
        writer.add(i, b"")
    writer.close()
    reader = sstable.Reader(str(tmp_path / "s.sst"))
    head = reader.read(reader.bloom[0], reader.bloom[1])
    reader.read = lambda at, length: head[at - reader.bloom[0] : at - reader.bloom[0] + length]
    assert all(reader.may_hold(sstable.to_key(i)) for i in range(0, 40_000, 20))
    assert sum(reader.may_hold(sstable.to_key(i)) for i in range(1, 40_000, 2)) < 0.0115 * 20_000  # 0.8 % are expected


def test_partitions_go_by_bytes():
    gb = 1 << 30
    assert sstable.partitions(10**6, gb // 2) == 32 and sstable.partitions(10**9, 1000 * gb) == 20_000 and sstable.partitions(10**12, 100_000 * gb) == 20_000 and sstable.partitions(3, 0) == sstable.partitions(0, 0) == 1


def test_null_and_negative_keys_sort_first(spark, tmp_path):
    docs = spark.createDataFrame([(5, "a"), (None, "b"), (-7, "c"), (5, "d")], "doc_id long, text string")
    manifest = sstable.write_shards(docs, str(tmp_path / "s"))
    assert [d for d, *_ in sorted(sstable.read_shards(manifest).collect(), key=lambda r: r[1])] == [None, -7, 5, 5]


@pytest.mark.parametrize("source", ["table", "odd", "empty"])
def test_packing(spark, source):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if source == "table" else docs_frame(spark, ODD if source == "odd" else [])
    rows = docs.select("doc_id", "text").collect()
    ids = {d: [*i, 2] for (d, _), i in zip(rows, library(t or "" for _, t in rows), strict=True)}
    pieces = packing.pack(docs).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_bin[p.sequence_id].append((p.offset, p.length))
    for d, want in ids.items():
        own = sorted(by_doc[d], key=lambda p: p.piece)
        assert b"".join(p.ids for p in own) == packed(want)
        assert [p.length for p in own] == packing.cuts(len(want), 1024)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    if source == "table":
        assert len(by_bin) <= 1.05 * sum(map(len, ids.values())) / 1024 + 1


def test_bounded_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    a, b, c = bins.place(4)[0], bins.place(7)[0], bins.place(8)[0]  # the third opens; the fullest of the open ones closes
    assert len({a, b, c}) == 3 and bins.open == 2
    assert bins.place(6) == (a, 4)


def test_queries_give_the_digests(spark):
    crc = {r.doc_id: r.ids_crc32 for r in queries.op9_token_shards(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    some = list(texts)[:50]
    assert [crc[d] for d in some] == [zlib.crc32(packed([*i, 0])) for i in library(texts[d] for d in some)]
    assert queries.op1_token_counts(spark, SF).count() == len(texts)


def test_queries_have_the_contracts_types(spark):
    want = {
        "op1_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
        "op3_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
        "op4_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
        "op5_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
        "op8_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op9_token_shards": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
        "op10_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, sequence_id bigint, offset bigint, ids_crc32 bigint",
    }
    for name, types in want.items():
        assert ", ".join(f"{n} {t}" for n, t in queries.QUERIES[name](spark, SF).dtypes) == types
    near = dict(queries.op7_minhash_near_dedup(spark, SF).dtypes)
    assert {n: near[n] for n in ("doc_id", "n_shingles", "component_id", "kept")} == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}


def test_shards_and_packing_take_megabytes_and_clashing_columns(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(250_000)), "a b", None]
    docs = docs_frame(spark, texts).selectExpr("*", "1 AS ids", "2 AS part", "3 AS h", "4 AS start", "5 AS piece", "6 AS sequence_id", "7 AS offset", "8 AS length")
    want = {i: x for i, x in enumerate(library(t or "" for t in texts))}
    assert len(texts[0]) > 1 << 20
    manifest = sstable.write_shards(docs, str(tmp_path / "s"))
    assert {r.doc_id: bytes(r.ids) for r in sstable.read_shards(manifest).collect()} == {d: packed([*i, 0]) for d, i in want.items()}
    pieces = sorted(packing.pack(docs).collect(), key=lambda r: (r.doc_id, r.piece))
    got = defaultdict(bytes)
    for r in pieces:
        assert r.length <= 1024 and r.start * 4 == len(got[r.doc_id])
        got[r.doc_id] += bytes(r.ids)
    assert got == {d: packed([*i, 2]) for d, i in want.items()}


def test_few_rows_of_many_bytes_are_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_BYTES", 1000)
    docs = docs_frame(spark, ["x" * 900] * 10).repartition(10)
    assert packing.tasks(docs) == 9 and packing.pack(docs).rdd.getNumPartitions() == 9
    assert packing.tasks(docs_frame(spark, ["x"] * 10)) == packing.tasks(docs_frame(spark, [])) == 1
