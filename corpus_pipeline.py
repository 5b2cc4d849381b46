"""From raw documents to packed training sequences: five stages, each an operator of evidra.llm on the documents that
its predecessor kept. Every stage but the last returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm import minhash, mixing, packing, pii, quality
from evidra.llm.common import cut, drop, set_aside, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    network = quality.train(docs, table(spark, sf_dir, "labels"))
    docs, back = set_aside(docs, "score", "predicted")
    return back(quality.score(docs, network).where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id. Rows with one doc_id and text are one
    document, of which the first in order of its other columns stays; rows without doc_id stay."""
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id", F.col("text_hash").alias("_h")).distinct()
    docs, back = set_aside(docs, "_n", "_h")
    first = F.row_number().over(Window.partitionBy("doc_id", "_h").orderBy(*[F.col(c) for c in ("text", *[c for c in docs.columns if c not in ("doc_id", "text")])]))
    rows = docs.where("doc_id IS NOT NULL").withColumn("_h", F.xxhash64("text")).withColumn("_n", first).where("_n = 1")
    found = rows.join(kept, ["doc_id", "_h"], "left_semi")
    return back(found.select(*docs.columns).unionByName(docs.where("doc_id IS NULL")))


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of private data, n_chars to match."""
    docs, back = set_aside(docs, "entities", "n_entities")
    found = pii.surrogates(docs, key=pii.KEY)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at its target weights; a document that is taken twice is two rows."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", replace_private_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; what a stage put out goes when its successor's result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        after = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained network and a keyed permutation are not for SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None
