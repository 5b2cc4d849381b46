"""Look-ups that add evidence to variants: exact and same-site joins, source merging, fail-closed classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.fields import starts_with_any

#: The review states that do not carry a finding, by their beginnings.
WEAK = ("no_assertion", "no_classification", "no_interpretation")
KEY = ["chrom", "pos", "ref", "alt"]


def last_by(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row a key: that with the greatest order (later rows win)."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def exact_match(variants: DataFrame, curated: DataFrame, order: str | None = None) -> DataFrame:
    """Inner join on the full variant key. curated is unique by key, or of repeated keys the row last in order counts."""
    return variants.join(last_by(curated, KEY, order) if order else curated, KEY)


def strong(filter_: Column, sig: Column, review: Column, quality: Column, least: int = 50) -> Column:
    """Passing, of good genotype quality, curated as pathogenic or likely so, and not of weak review."""
    return filter_.isin("PASS", ".") & starts_with_any(sig, "Pathogenic", "Likely_pathogenic") & ~starts_with_any(F.coalesce(review, F.lit("")), *WEAK) & F.coalesce(quality.try_cast("int") >= least, F.lit(False))


def site_matches(variants: DataFrame, curated: DataFrame, value: str = "sig") -> DataFrame:
    """variants with the curated value of the same allele (exact, or null) and how many other alleles of the site are
    curated (others); one equi join on the site, keyed by the full variant, so alleles of a site do not hide another."""
    c = curated.select("chrom", "pos", F.col("ref").alias("c_ref"), F.col("alt").alias("c_alt"), F.col(value).alias("_v"))
    sites = c.groupBy("chrom", "pos").agg(F.collect_list(F.struct("c_ref", "c_alt", "_v")).alias("_site"))
    same = lambda x: (x["c_ref"] == F.col("ref")) & (x["c_alt"] == F.col("alt"))
    found = variants.join(sites, ["chrom", "pos"], "left")
    hits = F.filter("_site", same)
    return found.withColumns({"exact": F.when(F.size(hits) > 0, hits[0]["_v"]), "others": F.coalesce(F.size("_site") - F.size(hits), F.lit(0)).cast("long")}).drop("_site")


def priority_merge(sources: DataFrame, order: tuple[str, ...] = ("exome", "genome"), by: list[str] | None = None, weight: str = "an", source: str = "src") -> DataFrame:
    """Of each key's records the one with the greatest weight (null counts 0); equal weights: the source first in order.
    Weight and place in order are packed in one number, so that fixed-width columns are picked by hash aggregates."""
    by = by or KEY
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(source)).cast("long")
    rank = F.coalesce(weight, F.lit(0)).cast("long") * (len(order) + 1) - F.when(place > 0, place).otherwise(len(order) + 1) + len(order) + 1
    rest = [c for c in sources.columns if c not in (*by, source)]
    ranked = sources.withColumn("_rank", rank)
    best = ranked.groupBy(*by).agg(F.max("_rank").alias("_rank"), *[F.max_by(c, "_rank").alias(c) for c in rest])
    named = F.get(F.array(*[F.lit(x) for x in order]), (len(order) - F.pmod(F.col("_rank"), F.lit(len(order) + 1))).cast("int"))
    return best.withColumn(source, named).select(*sources.columns)


def fail_closed(variants: DataFrame, frequencies: DataFrame, failed: DataFrame, limit: float = 0.001, group: str = "gene") -> DataFrame:
    """variants with af, an, src and class. No record and the group's source failed: unannotated, never rare; no record
    else: absent; a record without frequency or at most limit: rare; else common. failed holds distinct groups."""
    found = variants.join(frequencies, KEY, "left").join(failed.select(group, F.lit(True).alias("_failed")), group, "left")
    status = (
        F.when(F.col("src").isNull() & F.col("_failed"), "unannotated").when(F.col("src").isNull(), "absent")
        .when(F.col("af").isNull() | (F.col("af") <= limit), "rare").otherwise("common")
    )
    return found.withColumn("class", status).drop("_failed")


def group_spans(df: DataFrame, group: str = "gene", pos: str = "pos") -> DataFrame:
    return df.groupBy(group).agg(F.min(pos).alias("lo"), F.max(pos).alias("hi"), F.count("*").alias("n"))


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Wanted keys that have lacks."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def exploded_counts(df: DataFrame, by: list[str], column: str, separator: str = r"\|", name: str = "item") -> DataFrame:
    """Counts by group and by the values of a separated list."""
    return df.select(*by, F.explode(F.split(column, separator)).alias(name)).groupBy(*by, name).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Each group's most frequent value; of equally frequent ones that which comes first in order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.groupBy(*by).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("k"), "_first")).alias("m")).select(*by, F.col(f"m.{value}").alias(value), F.col("m.n").alias("n"))


def panel_join(panel: DataFrame, known: DataFrame, key: str, order: str, **defaults) -> DataFrame:
    """Every row of a panel, order column included, with what is known of it; columns named in defaults have those values where nothing
    is. Rows are put in order where they are shown or written: sort by order."""
    rows = panel.join(known, key, "left")
    return rows.select(*panel.columns, *[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else c for c in known.columns if c != key])
