"""The registered queries of the variant analytics, and their SQL in DuckDB over the same derived views.

ROUND rounds what sums of doubles in another order may change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions import fields, ranks, sequence
from evidra.operators import annotate, consequence, enrichment, genes, intervals, motifs, nested, scoring, tasks, text, windows
from evidra.functions.sequence import AMINO
from evidra.plans import file_queries  # noqa: F401  registers its own
from evidra.plans.fixtures import frequencies, view
from evidra.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from evidra.shared import cut, new_path, once, remove
from evidra.sources import blocks, regions, sequences, sinks, tables

L = "BIGINT"


def r9(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


ZYG = """CASE WHEN gt = './.' THEN 'missing' WHEN gt = '0/0' THEN 'hom_ref' WHEN gt = '1/1' THEN 'hom_alt' ELSE 'het' END"""
CONTIG_ORDER = "coalesce(try_cast(chrom AS INT), CASE chrom WHEN 'X' THEN 23 ELSE 24 END)"

# ---------------------------------------------------------------- scans and predicates


@query(
    """ SELECT chrom, count(*) AS n, count(*) FILTER (filt = 'PASS') AS n_pass, count(*) FILTER (length(alt) = 1) AS n_snv, count(*) FILTER (length(alt) > 1) AS n_indel,
  count(*) FILTER (gt IN ('0|1', '0/1')) AS n_het, count(*) FILTER (gt = '1/1') AS n_hom, count(*) FILTER (gt = '0|1') AS n_phased FROM v GROUP BY chrom""",
    "v",
)
def variant_profile(spark, sf):
    return genes.profile(view(spark, sf, "v"))


@query(f" SELECT chrom, {ZYG} AS zyg, count(*) AS n FROM v GROUP BY 1, 2", "v")
def genotype_zygosity(spark, sf):
    return view(spark, sf, "v").groupBy("chrom", fields.zygosity(F.col("gt")).alias("zyg")).agg(F.count("*").alias("n"))


@query(
    """ SELECT vid, try_cast(regexp_extract(info, '(?:^|;)AF=([^;]*)', 1) AS DOUBLE) AS af, try_cast(nullif(regexp_extract(info, '(?:^|;)AN=([^;]*)', 1), '') AS BIGINT) AS an,
  regexp_extract(info, 'GENEINFO=([^:]*)', 1) AS gene, regexp_extract(info, 'CLNSIG=([^;]*)', 1) AS sig, regexp_matches(info, 'CLNSIG=(Pathogenic|Likely_pathogenic)') AS is_plp FROM info""",
    "info",
)
def info_extract(spark, sf):
    i, sig = F.col("info"), fields.info_text(F.col("info"), "CLNSIG")
    return view(spark, sf, "info").select(
        "vid", fields.info_number(i, "AF").alias("af"), fields.info_number(i, "AN", "bigint").alias("an"), fields.first_gene(i).alias("gene"), sig.alias("sig"),
        fields.starts_with_any(sig, "Pathogenic", "Likely_pathogenic").alias("is_plp"),
    )


@query(
    """, f AS (SELECT *, string_split(format, ':') AS k, string_split(sample, ':') AS s FROM sample),
a AS (SELECT *, string_split(s[list_position(k, 'AD')], ',') AS ad FROM f),
d AS (SELECT *, try_cast(ad[1] AS INT) + try_cast(ad[2] AS INT) AS depth, try_cast(ad[2] AS INT) AS alt_depth FROM a)
SELECT chrom, count(*) AS n, CAST(sum(depth) AS BIGINT) AS depth, CAST(sum(alt_depth) AS BIGINT) AS alt_depth, count(*) FILTER (list_position(k, 'GQ') > 0) AS with_gq
FROM d WHERE filt IN ('PASS', '.') AND length(ref) = 1 AND length(alt) = 1 AND depth >= 20 GROUP BY chrom""",
    "sample",
)
def depth_filter(spark, sf):
    """PASS single-base variants on canonical contigs with depth from the AD key of each row's own FORMAT."""
    s = view(spark, sf, "sample").where(F.col("filt").isin("PASS", ".") & F.col("chrom").rlike(fields.CANONICAL) & fields.is_snv(F.col("ref"), F.col("alt")))
    get = lambda key: fields.sample_value(F.col("format"), F.col("sample"), key)
    part = lambda i: F.get("_ad", F.lit(i)).try_cast("int")
    d = once(s.select("chrom", "format", "sample"), "_ad", F.split(get("AD"), ",")).select("chrom", "format", "sample", (part(0) + part(1)).alias("depth"), part(1).alias("alt_depth"))
    d = once(d.where("depth >= 20"), "gq", get("GQ"))
    return d.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("depth").alias("depth"), F.sum("alt_depth").alias("alt_depth"), F.count("gq").alias("with_gq"))


@query(
    f""", c AS (SELECT chrom, count(*) AS n FROM v GROUP BY chrom) SELECT CAST(row_number() OVER (ORDER BY {CONTIG_ORDER}) AS INTEGER) AS place, chrom, n FROM c""", "v"
)
def natural_contig_order(spark, sf):
    counts = view(spark, sf, "v").groupBy("chrom").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(*fields.contig_order(F.col("chrom")))))  # a row for each contig


@query(
    """, b AS (SELECT *, [0] || range(1 + (pos - 1 >> 26), 2 + (pos + 19999 >> 26)) || range(9 + (pos - 1 >> 23), 10 + (pos + 19999 >> 23)) || range(73 + (pos - 1 >> 20), 74 + (pos + 19999 >> 20))
  || range(585 + (pos - 1 >> 17), 586 + (pos + 19999 >> 17)) || range(4681 + (pos - 1 >> 14), 4682 + (pos + 19999 >> 14)) AS bins FROM v)
SELECT vid, list_aggregate(bins, 'sum') AS bins_sum, CAST(len(bins) AS INTEGER) AS n_bins FROM b""",
    "v",
)
def region_bin_enumeration(spark, sf):
    """Index bins of the 20 kb after each variant."""
    bins = intervals.region_bins(F.col("pos") - 1, F.col("pos") + 20000)
    return view(spark, sf, "v").select("vid", F.aggregate(bins, F.lit(0).cast("long"), lambda a, b: a + b).alias("bins_sum"), F.size(bins).alias("n_bins"))


@query(
    """, s AS (SELECT chrom, st, en, max(en) OVER (PARTITION BY chrom ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR st > before + 65536 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT chrom, min(st) AS st, max(en) AS en, count(*) AS n FROM i GROUP BY chrom, island""",
    "g",
)
def span_coalesce(spark, sf):
    return intervals.merged_spans(view(spark, sf, "g").select("chrom", "st", "en"), 65536, ["chrom"])


# ---------------------------------------------------------------- interval joins

#: Several rows may share a vid, so SQL numbers the rows.
NUMBERED = ", vr AS (SELECT *, row_number() OVER () AS rid FROM v)"
JOINED = NUMBERED + """ SELECT vid, gene FROM (SELECT vid, gene, row_number() OVER (PARTITION BY rid ORDER BY {order}) AS r
  FROM vr v JOIN g ON v.chrom = g.chrom AND v.pos BETWEEN g.st - {pad} AND g.en + {pad}) j WHERE r = 1"""


@query(JOINED.format(order="st, en, gene", pad=2000), "v", "g")
def panel_first_start(spark, sf):
    return intervals.interval_join(view(spark, sf, "v"), view(spark, sf, "g"), "first_start", pad=2000).select("vid", "gene")


@query(JOINED.format(order="st DESC, en DESC, gene DESC", pad=2), "v", "g")
def genome_last_start(spark, sf):
    return intervals.interval_join(view(spark, sf, "v"), view(spark, sf, "g"), "last_start", pad=2).select("vid", "gene")


def hits(spark, sf) -> DataFrame:
    return intervals.interval_join(view(spark, sf, "v"), view(spark, sf, "g"), "first_start", pad=2000)


HITS = NUMBERED + ", j AS (SELECT v.*, gene, row_number() OVER (PARTITION BY rid ORDER BY st, en, gene) AS r FROM vr v JOIN g ON v.chrom = g.chrom AND v.pos BETWEEN g.st - 2000 AND g.en + 2000), hits AS (SELECT * FROM j WHERE r = 1)"


@query(
    HITS
    + """ SELECT g.gene, count(h.vid) AS n, count(*) FILTER (filt = 'PASS') AS n_pass, count(*) FILTER (gt IN ('0|1', '0/1')) AS n_het, count(*) FILTER (gt = '1/1') AS n_hom,
  count(DISTINCT CASE WHEN l_linenumber % 4 = 0 THEN l_orderkey % 11 END) AS n_blocks FROM g LEFT JOIN hits h ON g.gene = h.gene GROUP BY g.gene""",
    "v",
    "g",
)
def gene_sweep_stats(spark, sf):
    pid = F.when(F.col("l_linenumber") % 4 == 0, (F.col("l_orderkey") % 11).cast("string")).otherwise(".")
    return genes.sweep_statistics(hits(spark, sf).withColumn("pid", pid), view(spark, sf, "g"))


# ---------------------------------------------------------------- look-ups


@query(" SELECT v.vid, c.sig, c.dn FROM v JOIN cvr c ON v.chrom = c.chrom AND v.pos = c.pos AND v.ref = c.ref AND v.alt = c.alt", "v", "cvr")
def exact_key_join(spark, sf):
    return annotate.exact_match(view(spark, sf, "v"), view(spark, sf, "cvr")).select("vid", "sig", "dn")


@query(
    NUMBERED + """ SELECT vid, max(CASE WHEN v.ref = c.ref AND v.alt = c.alt THEN sig END) AS exact, count(c.sig) FILTER (v.ref <> c.ref OR v.alt <> c.alt) AS others
FROM vr v LEFT JOIN cvr c ON v.chrom = c.chrom AND v.pos = c.pos GROUP BY rid, vid""",
    "v",
    "cvr",
)
def same_site_other_allele(spark, sf):
    return annotate.site_matches(view(spark, sf, "v"), view(spark, sf, "cvr")).select("vid", "exact", "others")


MERGED = ", fm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref, alt ORDER BY coalesce(an, 0) DESC, src) AS r FROM fr) q WHERE r = 1)"


@query(MERGED + " SELECT chrom, pos, ref, alt, src, af, an FROM fm", "fr")
def priority_merge(spark, sf):
    return annotate.priority_merge(frequencies(spark, sf)).select("chrom", "pos", "ref", "alt", "src", "af", "an")


CLASSED = HITS + MERGED + """, classed AS (SELECT h.*, fm.af, fm.src, CASE WHEN fm.src IS NULL AND CAST(substr(h.gene, 2) AS BIGINT) % 10 = 0 THEN 'unannotated' WHEN fm.src IS NULL THEN 'absent'
  WHEN fm.af IS NULL OR fm.af <= 0.001 THEN 'rare' ELSE 'common' END AS class
  FROM hits h LEFT JOIN fm ON h.chrom = fm.chrom AND h.pos = fm.pos AND h.ref = fm.ref AND h.alt = fm.alt)"""


def classed(spark, sf) -> DataFrame:
    failed = view(spark, sf, "g").where("p_partkey % 10 = 0").select("gene").distinct()
    return annotate.fail_closed(hits(spark, sf), annotate.priority_merge(frequencies(spark, sf)), failed)


@query(CLASSED + " SELECT vid, gene, class, af, src FROM classed", "v", "g", "fr")
def fail_closed_class(spark, sf):
    return classed(spark, sf).select("vid", "gene", "class", "af", "src")


@query(CLASSED + """ SELECT gene, count(*) AS n, count(*) FILTER (class = 'rare') AS rare, count(*) FILTER (class = 'absent') AS absent, count(*) FILTER (class = 'unannotated') AS unannotated,
  CASE WHEN count(*) FILTER (class = 'unannotated') > 0 THEN 'incomplete' WHEN count(*) FILTER (class IN ('rare', 'absent')) >= 2 THEN 'candidate' ELSE 'cleared' END AS decision FROM classed GROUP BY gene""", "v", "g", "fr")  # fmt: skip
def class_decision(spark, sf):
    n = lambda *k: F.count_if(F.col("class").isin(*k))
    decision = F.when(n("unannotated") > 0, "incomplete").when(n("rare", "absent") >= 2, "candidate").otherwise("cleared")
    return classed(spark, sf).groupBy("gene").agg(F.count("*").alias("n"), n("rare").alias("rare"), n("absent").alias("absent"), n("unannotated").alias("unannotated"), decision.alias("decision"))


@query(CLASSED + """, s AS (SELECT l_linenumber AS sample, gene, count(*) FILTER (class IN ('rare', 'absent')) AS rare FROM classed GROUP BY 1, 2)
SELECT sample, CAST(sum(rare) AS BIGINT) AS rare, count(*) FILTER (rare >= 1) AS genes_1, count(*) FILTER (rare >= 2) AS genes_2 FROM s GROUP BY sample""", "v", "g", "fr")  # fmt: skip
def sample_metrics(spark, sf):
    s = classed(spark, sf).groupBy(F.col("l_linenumber").alias("sample"), "gene").agg(F.count_if(F.col("class").isin("rare", "absent")).alias("rare"))
    return s.groupBy("sample").agg(F.sum("rare").alias("rare"), F.count_if(F.col("rare") >= 1).alias("genes_1"), F.count_if(F.col("rare") >= 2).alias("genes_2"))


@query(HITS + " SELECT gene, min(pos) AS lo, max(pos) AS hi, count(*) AS n FROM hits GROUP BY gene", "v", "g")
def region_bounded_spans(spark, sf):
    return annotate.group_spans(hits(spark, sf))


@query(" SELECT DISTINCT 'G' || CAST(l_partkey AS VARCHAR) AS gene FROM lineitem WHERE 'G' || CAST(l_partkey AS VARCHAR) NOT IN (SELECT gene FROM g WHERE p_partkey % 3 <> 0)", "g")
def missing_genes_anti(spark, sf):
    wanted = view(spark, sf, "lineitem").select(F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene"))
    return annotate.missing(wanted, view(spark, sf, "g").where("p_partkey % 3 <> 0"), "gene")


@query(" SELECT p.gene, count(*) AS n FROM ph p WHERE gene IN (SELECT gene FROM g WHERE p_partkey % 5 = 0) GROUP BY p.gene", "ph", "g")
def panel_members(spark, sf):
    panel = view(spark, sf, "g").where("p_partkey % 5 = 0").select("gene")
    return view(spark, sf, "ph").join(panel, "gene", "left_semi").groupBy("gene").agg(F.count("*").alias("n"))


@query(", x AS (SELECT sig, unnest(string_split(dn, '|')) AS disease FROM cvr) SELECT sig, disease, count(*) AS n FROM x GROUP BY sig, disease", "cvr")
def disease_counts(spark, sf):
    return annotate.exploded_counts(view(spark, sf, "cvr"), ["sig"], "dn", name="disease")


@query(" SELECT c_mktsegment, c_nationkey, n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, f) AS r FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY 1, 2) a) b WHERE r = 1")
def mode_first_seen(spark, sf):
    return annotate.most_common(view(spark, sf, "customer"), ["c_mktsegment"], "c_nationkey", "c_custkey")


# ---------------------------------------------------------------- gene decisions

KINDS = """, rare AS (SELECT c.gene, c.gt, CASE WHEN length(ref) <> length(alt) THEN CASE WHEN (length(alt) - length(ref)) % 3 <> 0 THEN 'frameshift' ELSE 'inframe' END
  WHEN vid % 7 = 0 THEN 'nonsense' WHEN vid % 3 = 0 THEN 'synonymous' ELSE 'missense' END AS kind FROM classed c
  WHERE c.filt = 'PASS' AND c.gt NOT IN ('0/0', './.') AND c.class IN ('rare', 'absent'))"""


def rare_kinds(spark, sf) -> DataFrame:
    """Rare or absent, passing, called variants of the panel with zygosity and consequence."""
    c = classed(spark, sf).where((F.col("filt") == "PASS") & fields.non_reference(F.col("gt")) & F.col("class").isin("rare", "absent"))
    indel = sequence.length_class(F.col("ref"), F.col("alt"))
    kind = F.coalesce(indel, F.when(F.col("vid") % 7 == 0, "nonsense").when(F.col("vid") % 3 == 0, "synonymous").otherwise("missense"))
    return c.select("vid", "gene", fields.zygosity(F.col("gt")).alias("zyg"), kind.alias("kind"))


@query(CLASSED + KINDS + """ SELECT gene, count(*) FILTER (gt = '1/1') AS hom, count(*) FILTER (gt <> '1/1') AS het, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds
FROM rare WHERE kind IN ('frameshift', 'nonsense') GROUP BY gene HAVING count(*) FILTER (gt = '1/1') >= 1 OR count(*) FILTER (gt <> '1/1') >= 2""", "v", "g", "fr")  # fmt: skip
def recessive_genes(spark, sf):
    return genes.recessive(rare_kinds(spark, sf).where(F.col("kind").isin("frameshift", "nonsense")))


COMPOUND = CLASSED + KINDS + """, k AS (SELECT gene, count(*) FILTER (kind IN ('frameshift', 'nonsense') AND gt = '1/1') AS lof_hom, count(*) FILTER (kind IN ('frameshift', 'nonsense') AND gt <> '1/1') AS lof_het,
  count(*) FILTER (kind = 'missense' AND gt <> '1/1') AS missense_het FROM rare GROUP BY gene),
p AS (SELECT *, CASE WHEN lof_hom > 0 THEN 'hom_lof' WHEN lof_het >= 2 THEN 'compound_lof' WHEN lof_het > 0 AND missense_het > 0 THEN 'lof_missense' END AS pattern FROM k)"""


@query(COMPOUND + " SELECT gene, lof_hom, lof_het, missense_het, pattern FROM p WHERE pattern IS NOT NULL", "v", "g", "fr")
def compound_patterns(spark, sf):
    """Flagship: interval join, source merge, fail-closed class, consequence, pattern for each gene."""
    return genes.compound(rare_kinds(spark, sf))


@query(COMPOUND + """ SELECT CAST(row_number() OVER (ORDER BY CASE pattern WHEN 'hom_lof' THEN 0 WHEN 'compound_lof' THEN 1 ELSE 2 END, lof_hom + lof_het + missense_het DESC, gene) AS INTEGER) AS place, gene, pattern
FROM p WHERE pattern IS NOT NULL ORDER BY place LIMIT 30""", "v", "g", "fr")  # fmt: skip
def ranked_genes(spark, sf):
    """The best thirty genes; the limit is the report's."""
    order = [F.when(F.col("pattern") == "hom_lof", 0).when(F.col("pattern") == "compound_lof", 1).otherwise(2), (F.col("lof_hom") + F.col("lof_het") + F.col("missense_het")).desc(), F.col("gene")]
    top = genes.compound(rare_kinds(spark, sf)).orderBy(*order).limit(30)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "gene", "pattern")


@query(CLASSED + KINDS + " SELECT kind, count(*) AS n, count(*) FILTER (gt = '1/1') AS hom, count(DISTINCT gene) AS genes FROM rare GROUP BY kind", "v", "g", "fr")
def consequence_tallies(spark, sf):
    return rare_kinds(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("zyg") == "hom_alt").alias("hom"), F.count_distinct("gene").alias("genes"))


@query(" SELECT pid, count(*) AS n, max(pos) - min(pos) AS span FROM ph WHERE pid <> '.' GROUP BY pid HAVING count(*) >= 2", "ph")
def phase_blocks(spark, sf):
    return genes.phase_blocks(view(spark, sf, "ph"))


VERDICT = """, b AS (SELECT gene, nullif(pid, '.') AS pid, count(*) AS k, count(DISTINCT nullif(pgt, '.')) AS d FROM ph GROUP BY 1, 2),
w AS (SELECT gene, CAST(sum(k) AS BIGINT) AS n, count(pid) AS blocks, CASE WHEN bool_or(pid IS NOT NULL AND d > 1) THEN 'trans' WHEN bool_or(pid IS NOT NULL AND k > 1) THEN 'cis' WHEN count(pid) > 0 THEN 'separate' ELSE 'unphased' END AS verdict FROM b GROUP BY gene)"""


@query(VERDICT + " SELECT gene, n, blocks, verdict FROM w", "ph")
def phase_verdict(spark, sf):
    return genes.phase_verdict(view(spark, sf, "ph"))


@query(VERDICT + """, i AS (SELECT gene, count(*) FILTER (impact) AS impacts FROM ph GROUP BY gene)
SELECT gene, verdict, impacts, CASE WHEN verdict = 'cis' THEN 'discarded' WHEN impacts = 0 THEN 'weak' WHEN verdict = 'trans' THEN 'strong' ELSE 'open' END AS outcome FROM w JOIN i USING (gene)""", "ph")  # fmt: skip
def recessive_survival(spark, sf):
    ph = view(spark, sf, "ph")
    return genes.survival(genes.phase_verdict(ph), ph)


# ---------------------------------------------------------------- sequences


@query(" SELECT sid, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM dna", "dna")
def revcomp(spark, sf):
    return view(spark, sf, "dna").select("sid", sequence.reverse_complement(F.col("seq")).alias("rc"))


AA = "substr('" + AMINO + "', 16 * (instr('TCAG', substr({c}, 1, 1)) - 1) + 4 * (instr('TCAG', substr({c}, 2, 1)) - 1) + instr('TCAG', substr({c}, 3, 1)), 1)"
TRANSLATED = f""", s AS (SELECT *, CASE WHEN strand = '-' THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS b0, CASE WHEN strand = '-' THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS b1 FROM codon),
m AS (SELECT *, substr(codon, 1, CAST(off AS INT)) || b1 || substr(codon, CAST(off AS INT) + 2) AS mut FROM s WHERE substr(codon, CAST(off AS INT) + 1, 1) = b0 AND o < cds_len),
t AS (SELECT *, {AA.format(c="codon")} AS aa0, {AA.format(c="mut")} AS aa1, o // 3 + 1 AS number FROM m)"""
SNV_CLASS = "CASE WHEN aa0 = aa1 THEN 'synonymous' WHEN aa1 = '*' THEN 'nonsense' WHEN aa0 = '*' THEN 'stop_loss' ELSE 'missense' END"


def translated(spark, sf) -> DataFrame:
    """Codons inside the coding length whose base is the strand's reference, with both amino acids."""
    c = view(spark, sf, "codon").withColumns({"b0": sequence.stranded(F.col("ref"), F.col("strand")), "b1": sequence.stranded(F.col("alt"), F.col("strand")), "off": F.col("off").cast("int")})
    c = c.where((F.col("o") < F.col("cds_len")) & (F.substr("codon", F.col("off") + 1, F.lit(1)) == F.col("b0")))
    c = c.withColumn("mut", sequence.put_base(F.col("codon"), F.col("off"), F.col("b1")))
    return c.withColumns({"aa0": sequence.amino_acid(F.col("codon")), "aa1": sequence.amino_acid(F.col("mut")), "number": F.expr("o div 3 + 1")})


@query(TRANSLATED + f" SELECT vid, gene, codon, mut, aa0, aa1, {SNV_CLASS} AS kind FROM t", "codon")
def codon_consequence(spark, sf):
    return translated(spark, sf).select("vid", "gene", "codon", "mut", "aa0", "aa1", sequence.snv_class(F.col("aa0"), F.col("aa1")).alias("kind"))


THREE = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sequence.THREE.items()) + " END"


@query(TRANSLATED + f" SELECT vid, CASE WHEN number = 1 AND aa0 <> aa1 THEN 'p.Met1?' WHEN aa0 = aa1 THEN 'p.' || {THREE.format(c='aa0')} || number || '=' ELSE 'p.' || {THREE.format(c='aa0')} || number || {THREE.format(c='aa1')} END AS change FROM t", "codon")
def protein_change(spark, sf):
    return translated(spark, sf).select("vid", sequence.protein_change(F.col("aa0"), F.col("number"), F.col("aa1")).alias("change"))


@query(" SELECT vid, CASE WHEN length(ref) <> length(alt) THEN CASE WHEN (length(alt) - length(ref)) % 3 <> 0 THEN 'frameshift' ELSE 'inframe' END END AS kind FROM v", "v")
def lof_consequence(spark, sf):
    return view(spark, sf, "v").select("vid", sequence.length_class(F.col("ref"), F.col("alt")).alias("kind"))


OFFSETS = """, e AS (SELECT acc, strand, st, en, sum(en - st + 1) OVER (PARTITION BY acc ORDER BY CASE WHEN strand = '-' THEN -st ELSE st END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tx)
SELECT s.vid, s.acc, CAST(coalesce(e.before, 0) + CASE WHEN e.strand = '-' THEN e.en - s.pos ELSE s.pos - e.st END AS BIGINT) AS tpos FROM site s JOIN e ON s.acc = e.acc AND s.pos BETWEEN e.st AND e.en"""


@query(OFFSETS, "site", "tx")
def transcript_offset(spark, sf):
    """Genomic to transcript positions (from 0): running exon lengths in the strand's order, then an interval match."""
    tx = view(spark, sf, "tx")
    e = consequence.placed_exons(tx)
    return view(spark, sf, "site").join(e, "acc").where(F.col("pos").between(F.col("st"), F.col("en"))).select("vid", "acc", consequence.offset(F.col("pos")).alias("tpos"))


#: Sites that a task meets with their exons.
SITES = 250_000


@query(""", d AS (SELECT vid, s.acc, bool_or(pos BETWEEN st AND en) AS exonic, bool_or(pos BETWEEN st AND en AND pos BETWEEN cds_st AND cds_en) AS coding, min(least(abs(pos - st), abs(pos - en))) AS dist FROM site s JOIN tx ON s.acc = tx.acc GROUP BY vid, s.acc)
SELECT vid, acc, CASE WHEN coding THEN 'CDS' WHEN exonic THEN 'UTR' WHEN dist <= 2 THEN 'splice_2' WHEN dist <= 8 THEN 'splice_8' ELSE 'intronic' END AS region, CAST(dist AS BIGINT) AS distance FROM d""", "site", "tx")  # fmt: skip
def region_class(spark, sf):
    sites = view(spark, sf, "site")
    j = sites.repartition(max(1, -(-sites.count() // SITES)), "acc").join(view(spark, sf, "tx"), "acc")
    exonic = F.col("pos").between(F.col("st"), F.col("en"))
    d = j.groupBy("vid", "acc").agg(
        F.bool_or(exonic).alias("exonic"), F.bool_or(exonic & F.col("pos").between(F.col("cds_st"), F.col("cds_en"))).alias("coding"),
        F.min(F.least(F.abs(F.col("pos") - F.col("st")), F.abs(F.col("pos") - F.col("en")))).alias("distance"),
    )
    region = F.when(F.col("coding"), "CDS").when(F.col("exonic"), "UTR").when(F.col("distance") <= 2, "splice_2").when(F.col("distance") <= 8, "splice_8").otherwise("intronic")
    return d.select("vid", "acc", region.alias("region"), "distance")


@query(""", p AS (SELECT sid, i FROM dna, unnest(range(1, 48)) t(i) WHERE substr(seq, CAST(i AS INT), 2) = 'GT')
SELECT d.sid, count(p.i) AS n, CAST(min(p.i) AS INTEGER) AS first, CAST(max(p.i) AS INTEGER) AS last FROM dna d LEFT JOIN p ON d.sid = p.sid GROUP BY d.sid""", "dna")  # fmt: skip
def motif_scan(spark, sf):
    return motifs.motif_counts(view(spark, sf, "dna"), "GT").select("sid", "n", "first", "last")


DONOR_SQL = " + ".join(f"CASE WHEN instr('{b}', substr(seq, CAST(i AS INT) - 3 + {k}, 1)) > 0 THEN 1 ELSE 0 END" for k, b in enumerate(sequence.DONOR))


@query(f" SELECT sid, CAST(i AS INTEGER) AS at, CAST({DONOR_SQL} AS INTEGER) AS score, round(length(regexp_replace(substr(seq, 1, CAST(i AS INT) - 1), '[^CT]', '', 'g')) * 1.0E0 / (i - 1), 9) AS pyrimidine FROM dna, unnest(range(4, 44)) t(i) WHERE substr(seq, CAST(i AS INT), 2) = 'GT'", "dna")
def donor_sites(spark, sf):
    d = motifs.donor_sites(view(spark, sf, "dna"))
    return d.select("sid", "at", "score", r9(sequence.pyrimidine_share(F.substr("seq", F.lit(1), F.col("at") - 1))).alias("pyrimidine"))


def base_changes(spark, sf) -> DataFrame:
    """A change of one base in each sequence."""
    return view(spark, sf, "dna").select("sid", "seq", (F.col("sid") % 48 + 1).cast("int").alias("at"), F.substr(F.lit("ACGT"), (F.col("sid") % 4 + 1).cast("int"), F.lit(1)).alias("base"))


ONE_SITE = f"""SELECT sid, CASE WHEN two = 'GT' AND i > 3 AND i + 5 <= length(new) AND {DONOR_SQL.replace('seq', 'new')} >= 6 THEN 'donor'
    WHEN two = 'AG' AND length(upper_) >= 12 AND length(regexp_replace(upper_, '[^CT]', '', 'g')) >= 0.65 * length(upper_) THEN 'acceptor' END AS kind, i
  FROM (SELECT *, substr(new, i, 2) AS two, substr(new, greatest(1, i - 20), least(i - 1, 20)) AS upper_ FROM (SELECT sid, seq, substr(seq, 1, p - 1) || b || substr(seq, p + 1) AS new, p - {{d}} AS i FROM c) x
        WHERE i >= 1 AND i < length(seq) AND substr(new, i, 2) <> substr(seq, i, 2)) y"""


@query(f""", c AS (SELECT sid, seq, CAST(sid % 48 + 1 AS INTEGER) AS p, substr('ACGT', CAST(sid % 4 + 1 AS INTEGER), 1) AS b FROM dna), s AS ({ONE_SITE.format(d=1)} UNION ALL {ONE_SITE.format(d=0)})
SELECT sid, kind, CAST(i AS INTEGER) AS at FROM s WHERE kind IS NOT NULL""", "dna")  # fmt: skip
def created_splice_sites(spark, sf):
    """Donors and acceptors, above their floors, that a change creates."""
    return motifs.created_sites(base_changes(spark, sf)).select("sid", F.explode("sites").alias("s")).select("sid", "s.kind", "s.at")


def chromosome_chunks(spark, sf) -> DataFrame:
    """Long sequences, each the pieces of many rows in order."""
    return sequences.assembled(view(spark, sf, "chrpart").select("acc", (F.col("k") * 48 + 1).alias("at"), F.col("seq").alias("bases")), sequences.LENGTH, sequences.HALO)


CHROMOSOMES = ", chr AS MATERIALIZED (SELECT acc, string_agg(seq, '' ORDER BY k) AS s FROM chrpart GROUP BY acc)"


@query(CHROMOSOMES + f""", c AS (SELECT acc, s, unnest(range(0, (length(s) + {sequences.LENGTH - 1}) // {sequences.LENGTH})) AS chunk FROM chr),
e AS (SELECT *, greatest(1, chunk * {sequences.LENGTH} + 1 - {sequences.HALO}) AS start FROM c)
SELECT acc, chunk, start, chunk * {sequences.LENGTH} + 1 AS own_start, least((chunk + 1) * {sequences.LENGTH}, length(s)) AS own_end,
  md5(substr(s, start, least((chunk + 1) * {sequences.LENGTH} + {sequences.HALO}, length(s)) - start + 1)) AS bases FROM e""", "chrpart")  # fmt: skip
def sequence_chunks(spark, sf):
    """Sequence files, one a chromosome, written line by line to the shared folder and read by split into chunks."""
    parts = view(spark, sf, "chrpart").select("acc", "k", F.col("seq").alias("value"))
    heads = parts.groupBy("acc").agg(F.lit(-1).cast("long").alias("k"), F.concat(F.lit(">"), F.col("acc"), F.lit(" derived")).alias("value"))
    at = new_path(spark, "chromosomes")
    rows = heads.unionByName(parts.withColumn("k", F.col("k").cast("long"))).repartition("acc").sortWithinPartitions("acc", "k")
    rows.select(F.col("acc").alias("file"), "value").write.partitionBy("file").text(at)
    found = cut(sequences.read_chunks(spark, at).select("acc", "chunk", "start", "own_start", "own_end", F.md5("seq").alias("bases")), "chunks")
    remove(spark, at)
    return found


LONG_DONORS = " + ".join(f"CASE WHEN instr('{b}', substr(w, {k + 1}, 1)) > 0 THEN 1 ELSE 0 END" for k, b in enumerate(sequence.DONOR))


@query(CHROMOSOMES + f""", p AS (SELECT acc, i AS at, substr(s, i - 3, 9) AS w FROM chr, unnest(range(4, length(s) - 4)) t(i) WHERE substr(s, i, 2) = 'GT')
SELECT acc, "at", CAST({LONG_DONORS} AS INTEGER) AS score FROM p WHERE length(w) = 9""", "chrpart")  # fmt: skip
def chromosome_donor_sites(spark, sf):
    """Donor scores along long sequences, chunk by chunk."""
    return motifs.chunk_donor_sites(chromosome_chunks(spark, sf))


def chromosome_changes(spark, sf) -> DataFrame:
    """A change of one base in each piece of the long sequences."""
    base = F.substr(F.lit("ACGT"), (F.col("sid") % 4 + 1).cast("int"), F.lit(1))
    return view(spark, sf, "chrpart").select("sid", "acc", (F.col("k") * 48 + F.col("sid") % 48 + 1).alias("pos"), base.alias("base"))


MADE = " OR ".join(
    f"(substr(new, {i}, 2) = 'GT' AND substr(w, {i}, 2) <> 'GT' AND {' + '.join(f'CASE WHEN instr({b!r}, substr(new, {i - 3 + k}, 1)) > 0 THEN 1 ELSE 0 END' for k, b in enumerate(sequence.DONOR))} >= 6)"
    f" OR (substr(new, {i}, 2) = 'AG' AND substr(w, {i}, 2) <> 'AG' AND length(regexp_replace(substr(new, {i - 20}, 20), '[^CT]', '', 'g')) >= 0.65 * 20)"
    for i in (motifs.FLANK, motifs.FLANK + 1)
)
STEP = f"({{x}} * {{x}} % {motifs.MODULUS} * {motifs.FACTOR} + {{add}}) % {motifs.MODULUS}"


@query(CHROMOSOMES + f""", w AS (SELECT acc, i AS pos, substr(s, i - 30, 61) AS w FROM chr, unnest(range(31, length(s) - 29)) t(i)),
sites AS MATERIALIZED (
  SELECT acc, pos, base FROM (SELECT *, substr(w, 1, 30) || base || substr(w, 32) AS new FROM w, (VALUES ('A'), ('C'), ('G'), ('T')) b(base)) x
  WHERE instr(w, 'N') = 0 AND substr(w, 31, 1) <> base AND ({MADE})),
c AS (SELECT sid, acc, k * 48 + sid % 48 + 1 AS pos, substr('ACGT', CAST(sid % 4 + 1 AS INTEGER), 1) AS base FROM chrpart),
d0 AS (SELECT c.*, (sid % {motifs.MODULUS} * {motifs.FACTOR} + i * 16807 + 20260912) % {motifs.MODULUS} AS x FROM c, unnest(range(1, 2001)) t(i)),
d1 AS (SELECT *, {STEP.format(x="x", add=11)} AS y FROM d0), d2 AS (SELECT *, {STEP.format(x="y", add=7)} AS z FROM d1),
h AS (SELECT d2.sid, count(*) AS n FROM d2 JOIN sites s ON s.acc = d2.acc AND s.base = d2.base AND s.pos = d2.pos + z % 10001 - 5000 GROUP BY d2.sid)
SELECT c.sid, s.pos IS NOT NULL AS created, coalesce(h.n, 0) / 2000 AS share FROM c LEFT JOIN sites s ON s.acc = c.acc AND s.pos = c.pos AND s.base = c.base LEFT JOIN h ON h.sid = c.sid""", "chrpart")  # fmt: skip
def motif_null(spark, sf):
    """Whether each change makes a splice site, and the share of 2,000 seeded random places within 5,000 bases at which its base would."""
    return motifs.motif_null(chromosome_changes(spark, sf), chromosome_chunks(spark, sf), "sid").select("sid", "created", "share")


# ---------------------------------------------------------------- order statistics, histograms, windows


@query(" SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 9) AS med, round(sum(CASE WHEN l_discount BETWEEN 0.02 AND 0.08 THEN 0 ELSE 1 END) * 1.0E0 / count(*), 9) AS outside FROM lineitem GROUP BY 1, 2")
def median_by_group(spark, sf):
    by, rows = ["l_returnflag", "l_linestatus"], view(spark, sf, "lineitem")
    out = rows.groupBy(*by).agg(r9(F.avg((~F.col("l_discount").between(0.02, 0.08)).cast("int"))).alias("outside"))
    return out.join(ranks.median(rows, by, "l_extendedprice", "med"), by, "left").withColumn("med", r9("med"))


@query(" SELECT o_orderpriority, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS upper_median FROM orders GROUP BY 1")
def upper_median(spark, sf):
    return ranks.upper_median(view(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")


@query(" SELECT o_orderpriority, list_sort(list(o_totalprice))[CAST(floor(0.99 * (count(*) - 1)) AS BIGINT) + 1] AS p99 FROM orders GROUP BY 1")
def nearest_rank_q(spark, sf):
    return ranks.nearest_rank(view(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", 0.99, "p99")


HIST = """, h AS (SELECT l_returnflag, CAST(least(19, greatest(0, CAST(l_quantity AS INT) * 20 // 45)) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
dense AS (SELECT k.l_returnflag, CAST(b AS INTEGER) AS bin, CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) k CROSS JOIN unnest(range(20)) t(b) LEFT JOIN h ON h.l_returnflag = k.l_returnflag AND h.bin = b)"""


def quantity_histogram(spark, sf) -> DataFrame:
    return ranks.histogram(view(spark, sf, "lineitem"), ["l_returnflag"], F.expr("CAST(l_quantity AS INT) * 20 div 45"), 20)


@query("WITH x AS (SELECT 1)" + HIST + " SELECT * FROM dense")
def histogram_dense(spark, sf):
    return quantity_histogram(spark, sf)


@query("WITH x AS (SELECT 1)" + HIST + """, c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM dense)
SELECT l_returnflag, min(bin) AS median_bin FROM c WHERE upto * 2 >= total GROUP BY l_returnflag""")  # fmt: skip
def median_from_hist(spark, sf):
    return ranks.histogram_median(quantity_histogram(spark, sf), ["l_returnflag"])


WINDOWS = """, w AS (SELECT chrom, pos // 100000 * 100000 AS start, count(*) AS n, count(*) FILTER (het) AS het, sum(abs(altdp * 1.0E0 / dp - 0.5)) FILTER (het) AS obs, sum(sqrt(2 / pi()) * 0.5 / sqrt(dp)) FILTER (het) AS exp, sum(dp) AS depth FROM win GROUP BY 1, 2),
k AS (SELECT chrom, start, het, obs / exp AS excess, depth * 1.0E0 / n AS mean_dp FROM w WHERE het >= 2),
a AS (SELECT list_sort(list(excess))[count(*) // 2 + 1] AS be FROM k WHERE chrom NOT IN ('X', 'Y')), b AS (SELECT list_sort(list(depth * 1.0E0 / n))[count(*) // 2 + 1] AS bd FROM w WHERE n >= 5 AND chrom NOT IN ('X', 'Y')),
n AS (SELECT chrom, start, het, round(excess / be, 9) AS excess_norm, round(mean_dp / bd, 9) AS cov_ratio FROM k, a, b)"""


def window_table(spark, sf) -> DataFrame:
    """Windows of 100 kb with two heterozygous sites, against autosomal windows of five sites: the derived rows are sparse."""
    e = windows.excess(windows.balance_windows(view(spark, sf, "win"), 100_000), 2, 5)
    return e.select("chrom", "start", "het", r9("excess_norm").alias("excess_norm"), r9("cov_ratio").alias("cov_ratio"))


@query(WINDOWS + " SELECT * FROM n", "win")
def window_excess(spark, sf):
    return window_table(spark, sf)


@query(WINDOWS + """, f AS (SELECT chrom, start // 100000 AS i, CASE WHEN cov_ratio >= 1.08 THEN 'gain' WHEN cov_ratio <= 0.92 THEN 'loss' ELSE 'flat' END AS call, excess_norm FROM n WHERE excess_norm >= 1.05 AND chrom NOT IN ('X', 'Y')),
r AS (SELECT *, i - row_number() OVER (PARTITION BY chrom, call ORDER BY i) AS island FROM f)
SELECT chrom, call, min(i) AS first, max(i) AS last, count(*) AS n, round(avg(excess_norm), 6) AS mean FROM r GROUP BY chrom, call, island HAVING count(*) >= 2""", "win")  # fmt: skip
def mosaic_runs(spark, sf):
    called = window_table(spark, sf).where(F.col("chrom").rlike(fields.AUTOSOME)).withColumn("call", windows.mosaic_call(F.col("excess_norm"), F.col("cov_ratio"), 1.05)).where("call IS NOT NULL")
    found = windows.runs(called, ["chrom", "call"], F.expr("start div 100000"), 2, "excess_norm")
    return found.select("chrom", "call", "first", "last", "n", F.round("mean", 6).alias("mean"))


@query(WINDOWS + """ SELECT chrom, start, CASE WHEN cov_ratio >= 1.35 THEN 'gain' WHEN cov_ratio <= 0.65 THEN 'loss' WHEN cov_ratio >= 1.08 AND excess_norm >= 1.25 THEN 'mosaic_gain' WHEN cov_ratio <= 0.92 AND excess_norm >= 1.25 THEN 'mosaic_loss' ELSE 'normal' END AS verdict FROM n""", "win")
def dose_verdicts(spark, sf):
    return window_table(spark, sf).select("chrom", "start", windows.dose_verdict(F.col("cov_ratio"), F.col("excess_norm")).alias("verdict"))


@query("""WITH b AS (SELECT user_id, CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS k, count(*) * 1.0E0 AS kk FROM events GROUP BY 1, 2),
r AS (SELECT *, bucket - row_number() OVER (PARTITION BY user_id ORDER BY bucket) AS island FROM b WHERE k >= 3)
SELECT user_id, min(bucket) AS first, max(bucket) AS last, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM r GROUP BY user_id, island HAVING count(*) >= 3""")  # fmt: skip
def event_runs(spark, sf):
    b = view(spark, sf, "events").groupBy("user_id", F.floor(F.col("value") / 10).alias("bucket")).agg(F.count("*").alias("k")).where("k >= 3")
    return windows.runs(b, ["user_id"], F.col("bucket"), 3, "k").select("user_id", "first", "last", "n", "total")


# ---------------------------------------------------------------- scoring


@query("""WITH i AS (SELECT d.doc_id AS item, CAST(max(n_chars) AS DOUBLE) AS score, max(quality) AS truth FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1),
s AS (SELECT score, sum(truth) AS tp, count(*) AS k FROM i GROUP BY score), r AS (SELECT score, sum(tp) OVER (ORDER BY score DESC) AS tp, sum(k) OVER (ORDER BY score DESC) AS called, (SELECT sum(truth) FROM i) AS p FROM s)
SELECT score AS threshold, round(tp * 1.0E0 / called, 9) AS precision, round(tp * 1.0E0 / p, 9) AS recall, round(2.0E0 * tp / (called + p), 9) AS f FROM r ORDER BY 2.0E0 * tp / (called + p) DESC, score DESC LIMIT 1""")  # fmt: skip
def fmax(spark, sf):
    s = view(spark, sf, "documents").join(view(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("item"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("truth"))
    return scoring.best_f(s).select("threshold", *[r9(c).alias(c) for c in ("precision", "recall", "f")])


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders),
p AS (SELECT *, CASE WHEN rank = 1 THEN 100.0 WHEN rank <= 3 THEN 50.0 WHEN rank <= 5 THEN 25.0 WHEN rank <= 10 THEN 10.0 ELSE 0.0 END AS pts FROM r WHERE rank <= 12)
SELECT o_orderkey, rank, CAST(CASE o_orderstatus WHEN 'F' THEN pts WHEN 'P' THEN pts / 2 ELSE 0 END AS DOUBLE) AS points FROM p""")  # fmt: skip
def rank_points(spark, sf):
    r = scoring.ranked(view(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 12)
    full = F.col("o_orderstatus") == "F"
    return r.select("o_orderkey", "rank", scoring.rank_points(F.col("rank"), full | (F.col("o_orderstatus") == "P"), full).alias("points"))


CONTIG = "CASE WHEN regexp_matches(b{i}, '^([1-9]|1[0-9]|2[0-2]|X|Y)$') THEN 'chr' || b{i} WHEN b{i} IN ('M', 'MT') THEN 'chrM' END"


@query(f", x AS (SELECT line, chrom_1, upper(regexp_replace(chrom_1, '^chr', '')) AS b1 FROM sub) SELECT line, {CONTIG.format(i=1)} AS contig FROM x", "sub")
def contig_normalise(spark, sf):
    return view(spark, sf, "sub").select("line", fields.normal_contig(F.col("chrom_1")).alias("contig"))


@query(f""", x AS (SELECT *, upper(regexp_replace(chrom_1, '^chr', '')) AS b1, upper(regexp_replace(chrom_2, '^chr', '')) AS b2 FROM sub),
e AS (SELECT proband, line, unnest(list_filter([
  CASE WHEN ({CONTIG.format(i=1)}) IS NULL THEN 'contig_1' END, CASE WHEN coalesce(try_cast(pos_1 AS BIGINT), 0) < 1 THEN 'position_1' END,
  CASE WHEN NOT regexp_matches(ref_1, '^[ACGT]+$') THEN 'ref_1' END, CASE WHEN NOT regexp_matches(alt_1, '^[ACGT]+$') THEN 'alt_1' END, CASE WHEN ref_1 = alt_1 THEN 'same_alleles' END,
  CASE WHEN (chrom_2 <> '') <> (pos_2 <> '') THEN 'half_second' END, CASE WHEN chrom_2 <> '' AND ({CONTIG.format(i=2)}) IS NULL THEN 'contig_2' END,
  CASE WHEN NOT (epcr > 0 AND epcr <= 1) THEN 'score' END, CASE WHEN finding_type NOT IN ('', 'primary', 'secondary', 'incidental') THEN 'finding' END], lambda z: z IS NOT NULL)) AS code FROM x)
SELECT proband, line, code FROM e
UNION ALL SELECT proband, NULL, 'too_many' FROM sub GROUP BY proband HAVING count(*) > 10
UNION ALL SELECT proband, NULL, 'tied_score' FROM (SELECT proband, epcr FROM sub GROUP BY proband, epcr HAVING count(*) > 1) q""", "sub")  # fmt: skip
def submission_validate(spark, sf):
    return scoring.validate(view(spark, sf, "sub"))


# ---------------------------------------------------------------- sets


@query(", p AS (SELECT a, b, count(*) AS k FROM ps GROUP BY a, b) SELECT x.a, y.b, CAST(coalesce(k, 0) AS BIGINT) AS k FROM (SELECT DISTINCT a FROM ps) x CROSS JOIN (SELECT DISTINCT b FROM ps) y LEFT JOIN p ON p.a = x.a AND p.b = y.b", "ps")
def set_overlap(spark, sf):
    ps = view(spark, sf, "ps")
    return enrichment.overlaps(ps.select("a", "item"), ps.select("b", "item"), "item")


HYPER = """, k AS (SELECT a, b, count(*) AS k FROM ps GROUP BY a, b), ca AS (SELECT a, count(*) AS ka FROM ps GROUP BY a), cb AS (SELECT b, count(*) AS kb FROM ps GROUP BY b), t AS (SELECT (SELECT count(*) FROM ps) AS pop),
x AS (SELECT ca.a, cb.b, coalesce(k.k, 0) AS k, ka, kb, pop FROM ca CROSS JOIN cb CROSS JOIN t LEFT JOIN k ON k.a = ca.a AND k.b = cb.b),
e AS (SELECT a, b, k, unnest(range(CAST(greatest(k, ka + kb - pop, 0) AS BIGINT), CAST(least(ka, kb) + 1 AS BIGINT))) AS i, ka, kb, pop FROM x),
p AS (SELECT a, b, sum(exp(lgamma(ka + 1) - lgamma(i + 1) - lgamma(ka - i + 1) + lgamma(pop - ka + 1) - lgamma(kb - i + 1) - lgamma(pop - ka - kb + i + 1) + lgamma(kb + 1) + lgamma(pop - kb + 1) - lgamma(pop + 1))) AS p FROM e GROUP BY a, b)"""


def enriched(spark, sf) -> DataFrame:
    ps = view(spark, sf, "ps")
    k = enrichment.overlaps(ps.select("a", "item"), ps.select("b", "item"), "item")
    tests = k.join(ps.groupBy("a").agg(F.count("*").alias("marked")), "a").join(ps.groupBy("b").agg(F.count("*").alias("drawn")), "b")
    return enrichment.hypergeometric_tail(tests, ps.count())


@query(HYPER + " SELECT x.a, x.b, CAST(x.k AS BIGINT) AS k, round(least(1.0, p.p), 7) AS p, round(least(0.0, ln(p.p)), 6) AS log_p FROM x LEFT JOIN p ON p.a = x.a AND p.b = x.b", "ps")
def hypergeom_enrich(spark, sf):
    return enriched(spark, sf).select("a", "b", "k", F.round("p", 7).alias("p"), F.round("log_p", 6).alias("log_p"))


@query("WITH d AS (SELECT source, doc_id, n_chars FROM documents) SELECT doc_id, round((SELECT count(*) FROM d y WHERE y.source = x.source AND y.n_chars <= x.n_chars) * 1.0E0 / (SELECT count(*) FROM d y WHERE y.source = x.source), 9) AS share FROM d x")
def null_percentile(spark, sf):
    d = view(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return enrichment.null_share(d, "source", "n_chars").select("doc_id", r9("share").alias("share"))


@query(" SELECT gene, count(DISTINCT grp) AS n FROM gs GROUP BY gene HAVING count(DISTINCT grp) = (SELECT count(DISTINCT grp) FROM gs)", "gs")
def consensus_all(spark, sf):
    return enrichment.consensus(view(spark, sf, "gs"))


@query(" SELECT gene, count(DISTINCT grp) AS n FROM gs GROUP BY gene HAVING count(DISTINCT grp) >= 3", "gs")
def consensus_three(spark, sf):
    return enrichment.consensus(view(spark, sf, "gs"), 3)


@query(""", n AS (SELECT gene, count(DISTINCT grp) AS k FROM gs GROUP BY gene), u AS (SELECT gene FROM gs WHERE grp = '1-URGENT'), o AS (SELECT gene FROM gs WHERE grp = '5-LOW')
SELECT 'union' AS op, count(*) AS n FROM (SELECT gene FROM u UNION SELECT gene FROM o) a UNION ALL SELECT 'intersect', count(*) FROM (SELECT gene FROM u INTERSECT SELECT gene FROM o) b
UNION ALL SELECT 'left_only', count(*) FROM (SELECT gene FROM u EXCEPT SELECT gene FROM o) c UNION ALL SELECT 'right_only', count(*) FROM (SELECT gene FROM o EXCEPT SELECT gene FROM u) d""", "gs")  # fmt: skip
def set_operations(spark, sf):
    gs = view(spark, sf, "gs")
    u, o = (gs.where(F.col("grp") == g).select("gene") for g in ("1-URGENT", "5-LOW"))
    ops = {"union": u.union(o).distinct(), "intersect": u.intersect(o), "left_only": u.exceptAll(o).distinct(), "right_only": o.exceptAll(u).distinct()}
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("op"), "n") for n, d in ops.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH f AS (SELECT l_partkey, count(DISTINCT l_orderkey % 40) AS df FROM lineitem GROUP BY l_partkey) SELECT df, count(*) AS n FROM f GROUP BY df""")
def document_frequency(spark, sf):
    """In how many of forty signatures each compound is."""
    f = view(spark, sf, "lineitem").select((F.col("l_orderkey") % 40).alias("signature"), "l_partkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("df"))
    return f.groupBy("df").agg(F.count("*").alias("n"))


@query(HYPER + """, z AS (SELECT p.a, p.b, round(least(0.0, ln(p.p)), 6) AS p FROM p), w AS (SELECT *, (SELECT count(*) FROM z y WHERE y.b = z.b AND y.p <= z.p) * 1.0E0 / (SELECT count(*) FROM z y WHERE y.b = z.b) AS share FROM z)
SELECT a, b, round(share, 9) AS share FROM w WHERE share <= 0.2""", "ps")  # fmt: skip
def null_frequency_filter(spark, sf):
    """Pairs whose tail probability is among the lowest fifth of their group's."""
    e = enriched(spark, sf).select("a", "b", F.round("log_p", 6).alias("p"))
    return enrichment.null_share(e, "b", "p").where("share <= 0.2").select("a", "b", r9("share").alias("share"))


# ---------------------------------------------------------------- nested data and text


@query("""WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT event_type, count(*) AS n, median(k) AS med, round(count(*) FILTER (k < 20) * 1.0E0 / count(k), 9) AS low FROM e GROUP BY event_type""")  # fmt: skip
def nested_json_agg(spark, sf):
    k = F.from_json("props", "k double")["k"]
    e = view(spark, sf, "events").select("event_type", k.alias("k"))
    counts = e.groupBy("event_type").agg(F.count("*").alias("n"), r9(F.count_if(F.col("k") < 20) / F.count("k")).alias("low"))
    return counts.join(ranks.median(e, ["event_type"], "k", "med"), "event_type", "left")


@query(""" SELECT 'P' || CAST(l_partkey AS VARCHAR) AS symbol, count(*) AS n, round(median(l_quantity - 25), 9) AS median_effect, round(count(*) FILTER (l_quantity - 25 < -1) * 1.0E0 / count(*), 9) AS dependent,
  bool_or(l_returnflag = 'R') AS tractable FROM lineitem GROUP BY l_partkey""")  # fmt: skip
def target_landscape(spark, sf):
    """Answers as nested rows, a part's own each, summarised inside the row."""
    t = view(spark, sf, "lineitem").groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol")).agg(
        F.collect_list((F.col("l_quantity") - 25).cast("double")).alias("effects"), F.collect_set(F.struct(F.col("l_linestatus").alias("modality"), (F.col("l_returnflag") == "R").alias("value"))).alias("tractability")
    )
    s = nested.target_summary(t)
    return s.select("symbol", "n", r9("median_effect").alias("median_effect"), r9("dependent").alias("dependent"), "tractable")


@query(""" , x AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS gene, l_linestatus AS type, 'D' || CAST(l_linenumber AS VARCHAR) AS drug, l_linenumber % 2 = 0 AS approved FROM lineitem)
SELECT gene, type, count(*) AS n, coalesce(array_to_string(list_sort(list_distinct(list(drug) FILTER (approved))), ','), '') AS approved_drugs FROM x GROUP BY gene, type""".replace(" , x AS", "WITH x AS"))  # fmt: skip
def interaction_counts(spark, sf):
    i = F.struct(F.concat(F.lit("D"), F.col("l_linenumber").cast("string")).alias("drug"), (F.col("l_linenumber") % 2 == 0).alias("approved"), F.array("l_linestatus").alias("types"))
    answers = view(spark, sf, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("gene"), "l_orderkey").agg(F.collect_list(i).alias("interactions"))
    return nested.interaction_counts(answers)


@query("SELECT split_part(url, '/', 3) AS plate, count(*) AS n, count(DISTINCT split_part(url, '/', 4)) AS cells FROM pages GROUP BY 1")
def plate_cells(spark, sf):
    """Parts of a separated identifier, counted."""
    part = lambda i: F.split_part("url", F.lit("/"), F.lit(i))
    return view(spark, sf, "pages").groupBy(part(3).alias("plate")).agg(F.count("*").alias("n"), F.count_distinct(part(4)).alias("cells"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\w.%+-]+@[A-Za-z\d.-]+\.[A-Za-z][A-Za-z]+')) > 0 AS has_email, len(regexp_extract_all(text, '\(\d\d\d\) \d\d\d-\d\d\d\d')) > 0 AS has_phone,
  len(regexp_extract_all(text, '\brs\d\d\d+\b')) > 0 AS has_rsid, len(regexp_extract_all(text, '\b(chr)?(2[0-2]|1\d|[1-9]|X|Y|M|MT)[ \t\r\n\f\v]*[:-][ \t\r\n\f\v]*\d\d\d\d\d+\b')) > 0 AS has_coordinate FROM documents""")  # fmt: skip
def pii_scan(spark, sf):
    found = text.scan(view(spark, sf, "documents").select("doc_id", "text"), {k: text.DETECTORS[k] for k in ("email", "phone", "rsid", "coordinate")})
    return found.drop("text")


@query(""" SELECT line, kind IN (0, 1, 2) AS has_coordinate, kind IN (3, 4) AS has_column_coordinate, kind = 5 AS has_rsid, kind IN (7, 8) AS has_hgvs, kind IN (10, 11) AS has_genotype, kind = 14 AS has_email, kind = 15 AS has_phone
FROM notes""", "notes")  # fmt: skip
def content_detectors(spark, sf):
    """All detectors over notes whose kind says what they hold; the SQL knows no pattern."""
    return text.scan(view(spark, sf, "notes")).drop("kind", "text")


@query(" SELECT line, kind IN (0, 2, 5, 10, 11, 17, 19, 20, 21, 22) AS blocked FROM notes", "notes")
def egress_of_notes(spark, sf):
    """Outgoing notes that are stopped; the SQL knows no pattern."""
    return view(spark, sf, "notes").select("line", text.blocked(F.col("text")).alias("blocked"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@', '***@', 'g'), '[0-9]{4,}', '####', 'g')) AS masked FROM documents")
def mask_ids(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.md5(text.mask_identifiers(F.col("text"))).alias("masked"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[.]$'))) AS BIGINT) AS hits FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[.]$'))) >= 5")
def line_hit_threshold(spark, sf):
    return text.line_hits(view(spark, sf, "documents"), "[.]$", 5)


#: The rules once more for RE2, which has no look-behind.
STOPPED = " OR ".join("regexp_matches(text, '" + p.replace("'", "''").replace(r"(?<![0-9.])\b", "(^|[^0-9A-Za-z_.])").replace("(?<![0-9/])", "(^|[^0-9/])") + "')" for p in text.EGRESS.values())


@query(f"SELECT doc_id, {STOPPED} AS blocked FROM documents")
def egress_classifier(spark, sf):
    return view(spark, sf, "documents").select("doc_id", text.blocked(F.col("text")).alias("blocked"))


@query("""WITH d AS (SELECT doc_id, CAST(n_chars AS BIGINT) * CASE WHEN doc_id % 7 = 0 THEN 1000003 WHEN doc_id % 5 = 0 THEN 4099 ELSE 1 END AS n FROM documents),
u AS (SELECT *, CASE WHEN n < 1024 THEN 1 WHEN n < 1048576 THEN 1024 WHEN n < 1073741824 THEN 1048576 ELSE 1073741824 END AS unit FROM d),
t AS (SELECT *, n * 10 // unit + CASE WHEN n * 10 % unit * 2 > unit OR n * 10 % unit * 2 = unit AND n * 10 // unit % 2 = 1 THEN 1 ELSE 0 END AS tenths FROM u)
SELECT doc_id, (tenths // 10) || '.' || (tenths % 10) || CASE unit WHEN 1 THEN ' B' WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' ELSE ' GB' END AS size, replace(format('{:,}', n), ',', '.') AS dotted FROM t""")  # fmt: skip
def size_text(spark, sf):
    """Sizes of all documents, some of them as many times as large, so that every unit occurs."""
    times = F.when(F.col("doc_id") % 7 == 0, 1000003).when(F.col("doc_id") % 5 == 0, 4099).otherwise(1)
    n = F.col("n_chars") * times
    return view(spark, sf, "documents").select("doc_id", fields.size_text(n).alias("size"), fields.thousands(n).alias("dotted"))


@query("""WITH f AS (SELECT replace(url, '://', '/') || '/' || page_id || CASE WHEN page_id % 3 = 0 THEN '.vcf.gz' ELSE '.html' END AS path, CAST(length(html) AS BIGINT) AS length FROM pages WHERE url IS NOT NULL),
d AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS folder FROM f WHERE length % 5 = 0
  UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) FROM f WHERE length % 7 = 0)
SELECT 'folder' AS kind, folder AS path, CAST(sum(length) AS BIGINT) AS length, count(*) AS n FROM d JOIN f ON starts_with(path, folder || '/') GROUP BY folder
UNION ALL SELECT 'file', path, length, 1 FROM f WHERE path LIKE '%.vcf.gz' AND NOT EXISTS (SELECT 1 FROM d WHERE starts_with(path, folder || '/'))""")  # fmt: skip
def folder_sweep(spark, sf):
    """Pages as files by their addresses: listed folders with all below them, and files of a kind that lie below none."""
    name = F.concat(F.replace("url", F.lit("://"), F.lit("/")), F.lit("/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".vcf.gz").otherwise(".html"))
    files = view(spark, sf, "pages").where("url IS NOT NULL").select(name.alias("path"), F.length("html").cast("long").alias("length"))
    upper = lambda n, every: files.where(F.col("length") % every == 0).select(F.substring_index("path", "/", n).alias("folder"))
    return tables.swept_files(files, upper(2, 5).unionByName(upper(3, 7)), text.GENOMIC_FILE)


# ---------------------------------------------------------------- task graphs


def graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    dag = view(spark, sf, "dag")
    return dag, view(spark, sf, "orders").select(F.col("o_orderkey").alias("task"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_orderpriority").alias("priority"))


@query(" SELECT task, dep FROM dag WHERE dep NOT IN (SELECT o_orderkey FROM orders)", "dag")
def dag_orphans(spark, sf):
    edges, tasks_ = graph(spark, sf)
    return tasks.orphans(edges, tasks_)


@query(""", t AS (SELECT o_orderkey AS task, o_orderstatus = 'F' AS done, o_orderpriority AS priority FROM orders)
SELECT task, priority FROM t WHERE NOT done AND task NOT IN (SELECT d.task FROM dag d LEFT JOIN t u ON d.dep = u.task WHERE NOT coalesce(u.done, false))""", "dag")  # fmt: skip
def dag_ready(spark, sf):
    edges, tasks_ = graph(spark, sf)
    return tasks.ready(edges, tasks_)


@query(""", up AS (SELECT task, dep AS top, 1 AS depth FROM dag UNION ALL SELECT u.task, d.dep, u.depth + 1 FROM up u JOIN dag d ON u.top = d.task)
SELECT task, arg_max(top, depth) AS root, CAST(max(depth) AS INTEGER) AS depth FROM up GROUP BY task""", "dag", recursive=True)  # fmt: skip
def dag_depth(spark, sf):
    return tasks.ancestors(spark, view(spark, sf, "dag").select("task", "dep"))


CYCLE = "SELECT task, dep FROM dag UNION ALL SELECT 1 AS task, 12 AS dep UNION ALL SELECT o_orderkey AS task, o_orderkey AS dep FROM orders WHERE o_orderkey % 1001 = 0"


@query(f""", e AS ({CYCLE}), up AS (SELECT task, dep AS top, 1 AS depth FROM e UNION ALL SELECT u.task, e.dep, u.depth + 1 FROM up u JOIN e ON u.top = e.task WHERE u.depth < 12 AND u.top <> u.task)
SELECT task, CAST(min(depth) AS INTEGER) AS length FROM up WHERE top = task GROUP BY task""", "dag", recursive=True)  # fmt: skip
def dag_cycles(spark, sf):
    """Tasks on cycles. The SQL looks no further than twelve steps, which these cycles don't exceed."""
    edges = spark.sql(CYCLE.replace("FROM dag", "FROM {dag}").replace("FROM orders", "FROM {orders}"), dag=view(spark, sf, "dag"), orders=view(spark, sf, "orders"))
    return tasks.cyclic(spark, edges)


@query("WITH t AS (SELECT * FROM (VALUES ('audit', 1), ('review', 2)) q(role, priority)) SELECT role || '-' || n_name AS task_id, role, n_name AS item, priority FROM t CROSS JOIN nation")
def queue_generation(spark, sf):
    template = spark.sql("SELECT * FROM VALUES ('audit', 1), ('review', 2) AS t(role, priority)")
    return tasks.generated(template, view(spark, sf, "nation").select(F.col("n_name").alias("item")))


# ---------------------------------------------------------------- more rules


@query(HITS + MERGED + """ SELECT h.gene, count(*) AS n, count(*) FILTER (fm.src IS NULL) AS absent FROM hits h LEFT JOIN fm ON h.chrom = fm.chrom AND h.pos = fm.pos AND h.ref = fm.ref AND h.alt = fm.alt
WHERE coalesce(fm.af, 0.0) <= 0.001 GROUP BY h.gene""", "v", "g", "fr")  # fmt: skip
def rarity_filter(spark, sf):
    """Hits at most 0.001 frequent; what has no frequency counts as nought."""
    found = hits(spark, sf).join(annotate.priority_merge(frequencies(spark, sf)), annotate.KEY, "left").where(F.coalesce("af", F.lit(0.0)) <= 0.001)
    return found.groupBy("gene").agg(F.count("*").alias("n"), F.count_if(F.col("src").isNull()).alias("absent"))


@query(""", f AS (SELECT *, string_split(format, ':') AS k, string_split(sample, ':') AS s FROM sample)
SELECT s.chrom, c.sig, count(*) AS n FROM f s JOIN cvr c ON s.chrom = c.chrom AND s.pos = c.pos AND s.ref = c.ref AND s.alt = c.alt
WHERE s.filt = 'PASS' AND regexp_matches(c.sig, '^(Pathogenic|Likely_pathogenic)') AND try_cast(s.s[list_position(k, 'GQ')] AS INT) >= 50 GROUP BY 1, 2""", "sample", "cvr")  # fmt: skip
def strong_hits(spark, sf):
    """Passing variants of good genotype quality whose curated class is pathogenic or likely so."""
    gq = fields.sample_value(F.col("format"), F.col("sample"), "GQ").try_cast("int")
    found = annotate.exact_match(view(spark, sf, "sample"), view(spark, sf, "cvr")).where((F.col("filt") == "PASS") & fields.starts_with_any(F.col("sig"), "Pathogenic", "Likely_pathogenic") & (gq >= 50))
    return found.groupBy("chrom", "sig").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey, p_name, p_brand FROM part), l AS (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS supp FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_partkey, p_brand, CAST(row_number() OVER (ORDER BY p_brand, p_partkey) AS BIGINT) AS place, coalesce(n, 0) AS n, coalesce(supp, 0) AS suppliers FROM p LEFT JOIN l ON p_partkey = l_partkey""")  # fmt: skip
def landscape_join(spark, sf):
    """Every member of the panel in its order, with what is known of it or noughts. The panel is a list in a file."""
    known = view(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))
    at, part = new_path(spark, "panel"), view(spark, sf, "part")
    part.repartitionByRange("p_brand", "p_partkey").sortWithinPartitions("p_brand", "p_partkey").select(F.concat("p_partkey", F.lit(" # one")).alias("value")).write.text(at)
    panel = tables.read_names(spark, at).select(F.col("gene").cast("long").alias("p_partkey"), "place").join(part.select("p_partkey", "p_brand"), "p_partkey")
    found = cut(annotate.panel_join(panel, known, "p_partkey", "place", n=0, suppliers=0), "landscape")
    remove(spark, at)
    return found


@query(""", b AS (SELECT max(span) AS longest FROM (SELECT max(pos) - min(pos) AS span FROM ph WHERE pid <> '.' GROUP BY pid HAVING count(*) >= 2) q)
SELECT gene, max(pos) - min(pos) AS separation, round((max(pos) - min(pos)) * 1.0E0 / max(longest), 9) AS ratio FROM ph, b GROUP BY gene HAVING count(*) >= 2""", "ph")  # fmt: skip
def candidate_separation(spark, sf):
    """How far a gene's variants lie apart, and that over the longest phase block."""
    ph = view(spark, sf, "ph")
    longest = genes.phase_blocks(ph).agg(F.max("span").alias("longest"))  # one row
    apart = ph.groupBy("gene").agg(F.count("*").alias("n"), (F.max("pos") - F.min("pos")).alias("separation")).where("n >= 2")
    return apart.crossJoin(F.broadcast(longest)).select("gene", "separation", r9(F.col("separation") / F.col("longest")).alias("ratio"))


@query(" SELECT chrom, count(*) AS n, count(*) FILTER (sig IN ('Pathogenic', 'Likely_pathogenic')) AS pathogenic, round(count(*) FILTER (sig IN ('Pathogenic', 'Likely_pathogenic')) * 1.0E0 / count(*), 9) AS share FROM cvr GROUP BY chrom", "cvr")
def curated_share(spark, sf):
    plp = F.count_if(fields.starts_with_any(F.col("sig"), "Pathogenic", "Likely_pathogenic"))
    return view(spark, sf, "cvr").groupBy("chrom").agg(F.count("*").alias("n"), plp.alias("pathogenic"), r9(plp / F.count("*")).alias("share"))


@query("SELECT lower(trim(coalesce(nullif(p_name, ''), p_brand))) AS compound, max(p_size) AS phase, count(*) AS n FROM part GROUP BY 1")
def compound_names(spark, sf):
    """Names in one spelling, with the highest phase of each."""
    name = F.lower(F.trim(F.coalesce(F.nullif(F.col("p_name"), F.lit("")), F.col("p_brand"))))
    return view(spark, sf, "part").groupBy(name.alias("compound")).agg(F.max("p_size").alias("phase"), F.count("*").alias("n"))


@query("SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR) || '-2026') AS draw FROM part ORDER BY draw, p_partkey LIMIT 40")
def control_sample(spark, sf):
    """Forty controls by seeded hash order; the limit is the sample's size."""
    draw = F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("-2026")))
    return view(spark, sf, "part").select("p_partkey", draw.alias("draw")).orderBy("draw", "p_partkey").limit(40)


@query(""", n AS (SELECT grp, count(*) AS size FROM gs GROUP BY grp HAVING count(*) >= 15), own AS (SELECT DISTINCT grp FROM gs WHERE gene IN ('C1', 'C2', 'C4', 'C5', 'C7'))
SELECT n.grp, n.size FROM n JOIN own ON n.grp = own.grp""", "gs")  # fmt: skip
def verified_sets(spark, sf):
    """Sets of at least fifteen members that hold one of their targets."""
    gs = view(spark, sf, "gs")
    size = gs.groupBy("grp").agg(F.count("*").alias("size"), F.bool_or(F.col("gene").isin("C1", "C2", "C4", "C5", "C7")).alias("verified"))
    return size.where("size >= 15 AND verified").select("grp", "size")


@query(""", a AS (SELECT DISTINCT grp, gene FROM gs), k AS (SELECT x.grp AS a, y.grp AS b, count(*) AS k FROM a x JOIN a y ON x.gene = y.gene WHERE x.grp < y.grp GROUP BY 1, 2), n AS (SELECT grp, count(*) AS n FROM a GROUP BY grp)
SELECT k.a, k.b, k.k, k.k = p.n AND k.k = q.n AS equal FROM k JOIN n p ON p.grp = k.a JOIN n q ON q.grp = k.b""", "gs")  # fmt: skip
def set_equality(spark, sf):
    """Pairs of sets with shared members, and whether they are equal."""
    gs = view(spark, sf, "gs").distinct()
    n = gs.groupBy("grp").agg(F.count("*").alias("n"))
    k = enrichment.shared_items(gs.select(F.col("grp").alias("a"), "gene"), gs.select(F.col("grp").alias("b"), "gene"), "gene").where("a < b")
    both = k.join(n.select(F.col("grp").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("grp").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "k", ((F.col("k") == F.col("na")) & (F.col("k") == F.col("nb"))).alias("equal"))


# ---------------------------------------------------------------- counters, chains, bounded look-ups


@query(""" SELECT c.sig, g.gene, count(*) AS n, count(*) FILTER (c.sig IN ('Pathogenic', 'Likely_pathogenic')) AS pathogenic FROM cvr c JOIN g ON c.chrom = g.chrom AND c.pos BETWEEN g.st AND g.en GROUP BY 1, 2""", "cvr", "g")
def gene_class_counts(spark, sf):
    """Curated records by gene and class; a record in several genes counts for each."""
    found = intervals.overlap_counts(view(spark, sf, "cvr"), view(spark, sf, "g"), ["sig"])
    plp = fields.starts_with_any(F.col("sig"), "Pathogenic", "Likely_pathogenic")
    return found.select("sig", "gene", "n", F.when(plp, F.col("n")).otherwise(0).alias("pathogenic"))


@query(", x AS (SELECT g.gene, unnest(string_split(c.dn, '|')) AS disease FROM cvr c JOIN g ON c.chrom = g.chrom AND c.pos BETWEEN g.st AND g.en) SELECT gene, disease, count(*) AS n FROM x GROUP BY gene, disease", "cvr", "g")
def gene_disease_counts(spark, sf):
    listed = view(spark, sf, "cvr").select("chrom", "pos", F.explode(F.split("dn", r"\|")).alias("disease"))
    return intervals.overlap_counts(listed, view(spark, sf, "g"), ["disease"]).select("gene", "disease", "n")


@query(""" SELECT g.gene, f.chrom, f.pos, f.ref, f.alt, f.src, f.an FROM g JOIN fr f ON f.chrom = g.chrom AND f.pos BETWEEN g.st AND g.en WHERE g.p_partkey % 20 = 0""", "fr", "g")
def gene_bounded_lookup(spark, sf):
    """The frequency records within the panel genes' own spans, from indexed block-gzip files of which only the spans' byte ranges are
    read: a look-up never goes by where the sample's variants lie."""
    panel, at = view(spark, sf, "g").where("p_partkey % 20 = 0"), new_path(spark, "frequencies")
    dot = F.lit(".")
    records = frequencies(spark, sf).select("chrom", "pos", F.col("src").alias("id"), "ref", "alt", dot.alias("qual"), F.lit("PASS").alias("filter"), F.concat(F.lit("AN="), "an").alias("info"), dot.alias("format"), dot.alias("sample"))
    files = regions.write_indexed(records, at)
    read = regions.read_regions(files, panel.select("chrom", "st", "en"))
    remove(spark, at, files._cut_path)
    found = read.select("chrom", "pos", "ref", "alt", F.col("id").alias("src"), fields.info_number(F.col("info"), "AN", "bigint").alias("an"))
    return intervals.overlapping(found, panel).select("gene", "chrom", "pos", "ref", "alt", "src", "an")


@query("""WITH h AS (SELECT o_orderstatus, least(59, greatest(0, CAST(trunc((log10(greatest(o_totalprice, 1)) - 2) / 4 * 60) AS INTEGER))) AS bin FROM orders), k AS (SELECT o_orderstatus, bin, count(*) AS n FROM h GROUP BY 1, 2)
SELECT s.o_orderstatus, CAST(b AS INTEGER) AS bin, CAST(coalesce(k.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN unnest(range(60)) t(b) LEFT JOIN k ON k.o_orderstatus = s.o_orderstatus AND k.bin = b""")  # fmt: skip
def log_histogram(spark, sf):
    """Sixty bins of the decimal logarithm from 2 to 6; values beyond fall into the end bins."""
    return ranks.histogram(view(spark, sf, "orders"), ["o_orderstatus"], ranks.log_bin(F.col("o_totalprice"), 2, 6, 60), 60)


@query(""" SELECT chrom, round(sum(dp) * 1.0E0 / count(*), 9) AS mean_depth, round(count(*) FILTER (altdp * 1.0E0 / dp NOT BETWEEN 0.4 AND 0.6) * 1.0E0 / count(*), 9) AS outside FROM win WHERE het GROUP BY chrom""", "win")
def balance_profile(spark, sf):
    """Mean depth of heterozygous sites, and the share of them out of balance."""
    return genes.balance_profile(view(spark, sf, "win").where("het")).select("chrom", r9("mean_depth").alias("mean_depth"), r9("outside").alias("outside"))


@query(" SELECT vid, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNV' ELSE 'indel' END AS type FROM v", "v")
def variant_types(spark, sf):
    return view(spark, sf, "v").select("vid", fields.variant_type(F.col("ref"), F.col("alt")).alias("type"))


@query(CLASSED + """, s AS (SELECT l_linenumber AS sample, c.gene, count(*) AS n, count(*) FILTER (cv.sig IN ('Pathogenic', 'Likely_pathogenic')) AS plp FROM classed c LEFT JOIN cvr cv ON c.chrom = cv.chrom AND c.pos = cv.pos AND c.ref = cv.ref AND c.alt = cv.alt
  WHERE c.class IN ('rare', 'absent') GROUP BY 1, 2)
SELECT sample, CAST(sum(n) AS BIGINT) AS rare, count(*) AS genes_1, count(*) FILTER (n >= 2) AS genes_2, CAST(sum(plp) AS BIGINT) AS pathogenic FROM s GROUP BY sample""", "v", "g", "fr", "cvr")  # fmt: skip
def sample_metric_rows(spark, sf):
    """For each sample its rare variants, the genes with one or two of them, and how many are curated as pathogenic."""
    rare = classed(spark, sf).where(F.col("class").isin("rare", "absent")).join(view(spark, sf, "cvr").select(*annotate.KEY, "sig"), annotate.KEY, "left")
    plp = F.count_if(F.coalesce(fields.starts_with_any(F.col("sig"), "Pathogenic", "Likely_pathogenic"), F.lit(False)))
    by = rare.groupBy(F.col("l_linenumber").alias("sample"), "gene").agg(F.count("*").alias("n"), plp.alias("plp"))
    return by.groupBy("sample").agg(F.sum("n").alias("rare"), F.count("*").alias("genes_1"), F.count_if(F.col("n") >= 2).alias("genes_2"), F.sum("plp").alias("pathogenic"))


REVIEWED = """ r AS (SELECT v.chrom, v.pos, v.ref, v.alt, arg_max(CASE l_partkey % 4 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_pathogenic' ELSE 'Benign' END, vid * 10 + l_partkey % 10) AS sig,
  arg_max(CASE l_partkey % 3 WHEN 0 THEN 'no_assertion_criteria_provided' WHEN 1 THEN 'criteria_provided' ELSE 'reviewed_by_expert_panel' END, vid * 10 + l_partkey % 10) AS review FROM v WHERE l_orderkey % 5 = 0 GROUP BY 1, 2, 3, 4)"""


@query("," + REVIEWED + """, f AS (SELECT *, string_split(format, ':') AS k, string_split(sample, ':') AS s FROM sample)
SELECT s.vid, r.sig, r.review FROM f s JOIN r ON s.chrom = r.chrom AND s.pos = r.pos AND s.ref = r.ref AND s.alt = r.alt
WHERE s.filt IN ('PASS', '.') AND r.sig IN ('Pathogenic', 'Likely_pathogenic') AND r.review NOT LIKE 'no_assertion%' AND try_cast(s.s[list_position(k, 'GQ')] AS INT) >= 50""", "sample")  # fmt: skip
def reviewed_hits(spark, sf):
    """Passing, well called variants whose last curated record is pathogenic and not of weak review."""
    by = lambda n, *names: F.get(F.array(*[F.lit(x) for x in names]), F.least((F.col("l_partkey") % n).cast("int"), F.lit(len(names) - 1)))
    curated = view(spark, sf, "v").where("l_orderkey % 5 = 0").select(
        *annotate.KEY, by(4, "Pathogenic", "Likely_pathogenic", "Benign").alias("sig"), by(3, "no_assertion_criteria_provided", "criteria_provided", "reviewed_by_expert_panel").alias("review"),
        (F.col("vid") * 10 + F.col("l_partkey") % 10).alias("line"),
    )
    found = annotate.exact_match(view(spark, sf, "sample"), curated, order="line")
    return found.where(annotate.strong(F.col("filt"), F.col("sig"), F.col("review"), fields.sample_value(F.col("format"), F.col("sample"), "GQ"))).select("vid", "sig", "review")


@query(""", e AS (SELECT acc, strand, cds_st, cds_en, st, en, sum(en - st + 1) OVER (PARTITION BY acc ORDER BY CASE WHEN strand = '-' THEN -st ELSE st END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tx),
r AS (SELECT s.vid, s.acc, CASE WHEN bool_or(pos BETWEEN st AND en AND pos BETWEEN cds_st AND cds_en) THEN 'CDS' WHEN bool_or(pos BETWEEN st AND en) THEN 'UTR' WHEN min(least(abs(pos - st), abs(pos - en))) <= 8 THEN 'splicing' ELSE 'intronic' END AS region FROM site s JOIN tx ON s.acc = tx.acc GROUP BY 1, 2)
SELECT vid, acc, region FROM r WHERE region LIKE '%splicing%'""", "site", "tx")  # fmt: skip
def splicing_regions(spark, sf):
    """Variants whose region's name holds a word."""
    named = region_class(spark, sf).withColumn("region", F.when(F.col("region").startswith("splice"), "splicing").otherwise(F.col("region")))
    return named.where(fields.mentions(F.col("region"), "splicing")).select("vid", "acc", "region")


CHAIN = f""", e AS (SELECT *, coalesce(sum(en - st + 1) OVER (PARTITION BY acc ORDER BY CASE WHEN strand = '-' THEN -st ELSE st END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tx),
b AS (SELECT acc, min(before + CASE WHEN strand = '-' THEN en - cds_en ELSE cds_st - st END) FILTER (CASE WHEN strand = '-' THEN cds_en ELSE cds_st END BETWEEN st AND en) AS cds_from, sum(greatest(0, least(en, cds_en) - greatest(st, cds_st) + 1)) AS cds_len FROM e GROUP BY acc),
p AS (SELECT c.*, e.acc, e.strand, e.before + CASE WHEN e.strand = '-' THEN e.en - c.pos ELSE c.pos - e.st END AS tpos FROM change c JOIN e ON c.gene = e.gene AND CAST(substr(e.acc, 2) AS BIGINT) % 2 = 0 AND c.pos BETWEEN e.st AND e.en),
k AS (SELECT p.*, q.seq, b.cds_from, p.tpos - b.cds_from AS cpos, CASE WHEN strand = '-' THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS b0, CASE WHEN strand = '-' THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS b1
  FROM p JOIN b USING (acc) JOIN txseq q USING (acc) WHERE p.tpos - b.cds_from >= 0 AND p.tpos - b.cds_from < b.cds_len),
m AS (SELECT *, cpos // 3 + 1 AS number, substr(seq, CAST(cds_from + cpos // 3 * 3 + 1 AS BIGINT), 3) AS codon FROM k WHERE substr(seq, CAST(tpos + 1 AS BIGINT), 1) = b0),
n AS (SELECT *, substr(codon, 1, CAST(cpos % 3 AS BIGINT)) || b1 || substr(codon, CAST(cpos % 3 + 2 AS BIGINT)) AS mut FROM m),
t AS (SELECT vid, acc, CAST(number AS BIGINT) AS number, {AA.format(c="codon")} AS aa0, {AA.format(c="mut")} AS aa1 FROM n)
SELECT vid, acc, number, {SNV_CLASS} AS kind, CASE WHEN number = 1 AND aa0 <> aa1 THEN 'p.Met1?' WHEN aa0 = aa1 THEN 'p.' || {THREE.format(c="aa0")} || number || '=' ELSE 'p.' || {THREE.format(c="aa0")} || number || {THREE.format(c="aa1")} END AS change FROM t"""


@query(CHAIN, "change", "tx", "txseq")
def consequence_chain(spark, sf):
    """Gene to transcript to structure to sequence to consequence, all from text files: variant, summary, GFF and FASTA files are
    written from the derived rows to the shared folder and read by their readers."""
    lines = {
        "vcf": view(spark, sf, "change").selectExpr("concat_ws('\t', 'chr1', pos, vid, ref, alt, '.', 'PASS', concat('GENE=', gene), 'GT', '0/1') AS value"),
        "gff": view(spark, sf, "tx").selectExpr("inline(array(struct('exon' AS kind, st AS a, en AS b, acc, gene, strand), struct('CDS' AS kind, greatest(st, cds_st) AS a, least(en, cds_en) AS b, acc, gene, strand)))")
        .where("a <= b").selectExpr("concat_ws('\t', 'NC_000001.11', 'x', kind, a, b, '.', strand, '.', concat('ID=e;Parent=rna-', acc, ';gene=', gene)) AS value"),
        "fasta": view(spark, sf, "txseq").selectExpr("concat('>', acc, ' derived\n', substr(seq, 1, 60), '\n', substr(seq, 61)) AS value"),
    }
    at = {name: new_path(spark, name) for name in (*lines, "summary")}
    for name, rows in lines.items():
        rows.write.text(at[name])
    summary = view(spark, sf, "tx").where("CAST(substr(acc, 2) AS BIGINT) % 2 = 0 AND exon = 0").selectExpr("gene AS symbol", "'1' AS GRCh38_chr", "st AS chr_start", "en AS chr_end", "acc AS RefSeq_nuc")
    sinks.write_tsv(summary, at["summary"])
    variants = tables.read_vcf(spark, at["vcf"]).select(F.col("id").cast("long").alias("vid"), fields.info_text(F.col("info"), "GENE").alias("gene"), "pos", "ref", "alt")
    gff = tables.read_gff(spark, at["gff"]).select("acc", "strand", "kind", "st", "en")
    summary = tables.read_gene_summary(spark, at["summary"]).select("gene", "transcript")
    found = cut(consequence.protein_consequences(variants, summary, gff, tables.read_fasta(spark, at["fasta"])), "consequences")
    remove(spark, *at.values())
    return found


@query(""" SELECT chrom, pos, ref, alt, count(*) AS n, count(*) FILTER (filt = 'PASS') AS passed FROM v GROUP BY 1, 2, 3, 4""", "v")
def block_gzip_scan(spark, sf):
    """All variants written as block-gzip files to the shared folder and read back by byte ranges, many to a file."""
    at = new_path(spark, "blocks")
    lines = view(spark, sf, "v").selectExpr("concat_ws('\t', concat('chr', chrom), pos, vid, ref, alt, '.', filt, 'X=1', 'GT', gt) AS value")
    cut(blocks.write_lines(lines, at), "written")
    rows = tables.read_vcf(spark, at, split_bytes=1 << 20)
    found = cut(rows.groupBy("chrom", "pos", "ref", "alt").agg(F.count("*").alias("n"), F.count_if(F.col("filter") == "PASS").alias("passed")), "scanned")
    remove(spark, at)
    return found


@query(""", a AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '-666' ELSE p_name END AS d FROM part), n AS (SELECT p_partkey, lower(CASE WHEN d IS NULL OR trim(d) IN ('', '-666') THEN 'BRD-' || p_partkey ELSE trim(d) END) AS compound FROM a)
SELECT compound, count(*) AS n, CASE WHEN compound LIKE 'brd-%' THEN 'unnamed' WHEN max(CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 5 END) IS NOT NULL THEN CAST(max(CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 5 END) AS VARCHAR)
  WHEN count(*) FILTER (p_partkey % 2 = 0) > 0 THEN '0' ELSE 'unknown' END AS phase FROM n GROUP BY compound""".replace(", a AS", "WITH a AS", 1))  # fmt: skip
def cached_answers(spark, sf):
    """Cached answers of services, kept as JSON files: hits of a signature with their compounds' names in one spelling, and the
    highest clinical phase that a second service knows for each."""
    hits_at, molecules_at = new_path(spark, "hits"), new_path(spark, "molecules")
    part = view(spark, sf, "part")
    desc = F.when(F.col("p_partkey") % 11 == 0, "-666").otherwise(F.col("p_name"))
    sinks.write_json(part.select(F.col("p_partkey").cast("string").alias("sig_id"), desc.alias("pert_desc"), F.concat(F.lit("BRD-"), F.col("p_partkey").cast("string")).alias("pert_id")), hits_at)
    hits_ = tables.read_signature_hits(spark, hits_at)
    phase = F.when(F.col("p_partkey") % 3 > 0, (F.col("p_partkey") % 5).cast("string"))
    known = part.withColumn("compound", nested.compound_name(desc, F.concat(F.lit("BRD-"), F.col("p_partkey").cast("string")))).groupBy("compound")
    molecule = F.when(phase.isNotNull() | (F.col("p_partkey") % 2 == 0), F.struct(phase.alias("max_phase")))
    sinks.write_json(known.agg(F.collect_list(molecule).alias("molecules")).withColumnRenamed("compound", "query"), molecules_at)
    found = cut(nested.clinical_phases(hits_, tables.read_molecules(spark, molecules_at)), "phases")
    remove(spark, hits_at, molecules_at)
    return found


@query(""", k AS (SELECT a, b, count(*) AS k FROM ps GROUP BY a, b), x AS (SELECT u.a, w.b, CAST(coalesce(k.k, 0) AS BIGINT) AS k FROM (SELECT DISTINCT a FROM ps) u CROSS JOIN (SELECT DISTINCT b FROM ps) w LEFT JOIN k ON k.a = u.a AND k.b = w.b)
SELECT a, b, k, round((SELECT count(*) FROM x y WHERE y.a = x.a AND y.b <> x.b AND y.k >= x.k) * 1.0E0 / ((SELECT count(DISTINCT b) FROM ps) - 1), 9) AS p FROM x""", "ps")  # fmt: skip
def overlap_against_others(spark, sf):
    """For each two sets how many of the first one's other overlaps are at least as large."""
    ps = view(spark, sf, "ps")
    k = enrichment.overlaps(ps.select("a", "item"), ps.select("b", "item"), "item")
    return enrichment.share_of_others(k, "a", "k").select("a", "b", "k", r9("p").alias("p"))


@query(HYPER + """, z AS (SELECT p.a, p.b, round(least(0.0, ln(p.p)), 6) AS p FROM p), w AS (SELECT *, (SELECT count(*) FROM z y WHERE y.b = z.b AND y.p <= z.p) * 1.0E0 / (SELECT count(*) FROM z y WHERE y.b = z.b) AS share FROM z),
f AS (SELECT p_brand AS a, max(p_size) % 5 AS phase FROM part WHERE p_partkey % 9 = 0 GROUP BY 1)
SELECT w.a, w.b, CAST(x.k AS BIGINT) AS replicates, CAST(f.phase AS BIGINT) AS phase, round(w.share, 9) AS share FROM w JOIN x ON w.a = x.a AND w.b = x.b JOIN f ON f.a = w.a WHERE w.share <= 0.2 AND x.k > 0 AND f.phase = 4""", "ps")  # fmt: skip
def specificity_table(spark, sf):
    """Rare under the null, seen in a replicate, and in the last clinical phase."""
    e = enriched(spark, sf).select("a", "b", F.col("k").alias("replicates"), F.round("log_p", 6).alias("p"))
    phase = view(spark, sf, "part").where("p_partkey % 9 = 0").groupBy(F.col("p_brand").alias("a")).agg((F.max("p_size") % 5).cast("long").alias("phase"))
    found = enrichment.null_share(e, "b", "p").where("share <= 0.2 AND replicates > 0").join(phase.where("phase = 4"), "a")
    return found.select("a", "b", "replicates", "phase", r9("share").alias("share"))


@query(" SELECT chrom, start, CASE WHEN cov_ratio > 1 THEN 4 * s / (1 - 2 * s) ELSE 4 * s / (1 + 2 * s) END AS share FROM (SELECT chrom, pos AS start, 1 + dp % 3 - 1.0E0 AS cov_ratio, (dp % 11) / 40.0E0 AS s FROM v) q WHERE CASE WHEN cov_ratio > 1 THEN 4 * s / (1 - 2 * s) ELSE 4 * s / (1 + 2 * s) END BETWEEN 0 AND 1", "v")
def cell_shares(spark, sf):
    """Share of cells with one copy more or less, where it is one."""
    kind = F.when(F.col("dp") % 3 > 1, "gain").otherwise("loss")
    s = view(spark, sf, "v").select("chrom", F.col("pos").alias("start"), windows.cell_share((F.col("dp") % 11) / 40, kind).alias("share"))
    return s.where("share IS NOT NULL")
