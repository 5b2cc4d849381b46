"""Aggregates over nested API answers kept as JSON or structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_median(values: Column) -> Column:
    """Mean of the two middles of an array's numbers, nulls left out; null if there are none."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    middle = lambda i: F.get(s, F.floor(i).cast("int"))
    return F.when(n > 0, (middle((n - 1) / 2) + middle(n / 2)) / 2)


def target_summary(targets: DataFrame) -> DataFrame:
    """Per target: number of effects, their median, share below -1, whether any modality is tractable. targets has
    symbol, effects array<double>, tractability array<struct<modality,value>>."""
    e = F.filter("effects", lambda x: x.isNotNull())
    return targets.select(
        "symbol", F.size(e).cast("long").alias("n"), array_median(F.col("effects")).alias("median_effect"),
        F.when(F.size(e) > 0, F.size(F.filter(e, lambda x: x < -1)) / F.size(e)).alias("dependent"), F.exists("tractability", lambda t: t["value"]).alias("tractable"),
    )


def interaction_counts(answers: DataFrame) -> DataFrame:
    """Per gene and type of interaction: count and approved drugs, sorted. answers has gene, interactions
    array<struct<drug,approved,types array<string>>>."""
    i = answers.select("gene", F.explode("interactions").alias("i")).select("gene", "i.*")
    by = i.select("gene", "drug", "approved", F.explode("types").alias("type")).groupBy("gene", "type")
    return by.agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("approved"), F.col("drug"))))).alias("approved_drugs"))


def compound_name(desc: Column, id_: Column) -> Column:
    """A compound's name in small letters; its id where it has no name. Fixed value: -666 stands for none."""
    name = F.trim(desc)
    return F.lower(F.when(name.isNull() | name.isin("", "-666"), F.coalesce(id_, F.lit("?"))).otherwise(name))


def clinical_phases(hits: DataFrame, molecules: DataFrame) -> DataFrame:
    """compound, n (hits), phase: the highest phase among the molecules known under its name, 0 for molecules without a phase,
    unknown without any, unnamed for ids. hits: pert_desc, pert_id; molecules: query, molecules array<struct<max_phase>>."""
    names = hits.groupBy(compound_name(F.col("pert_desc"), F.col("pert_id")).alias("compound")).agg(F.count("*").alias("n"))
    found = F.filter("molecules", lambda m: m.isNotNull())
    phases = F.transform(found, lambda m: m["max_phase"].try_cast("double"))
    answers = molecules.select(F.col("query").alias("compound"), F.array_max(phases).cast("int").cast("string").alias("best"), (F.size(found) > 0).alias("some"))
    phase = F.when(F.startswith("compound", F.lit("brd-")), "unnamed").when(F.col("best").isNotNull(), F.col("best")).when(F.col("some"), "0").otherwise("unknown")
    return names.join(answers, "compound", "left").select("compound", "n", phase.alias("phase"))
