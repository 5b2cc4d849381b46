"""Queries of the readers and writers: rows derived from the driver's tables are written as files of each format to the shared
folder, read back by the reader, worked on, and the files removed. Their SQL never sees a file."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import fields
from evidra.operators import annotate, nested, text
from evidra.plans.fixtures import dealt_tasks, frequencies, view
from evidra.plans.registry import query
from evidra.shared import cut, new_path, remove
from evidra.sources import regions, sinks, tables


@contextmanager
def folders(spark: SparkSession, *names: str, kept: str | None = None) -> Iterator[SimpleNamespace]:
    """New folders of the shared folder, which go at the end, whether all went well or not; results have to be cut before. If all went well
    the kept one stays: its files are the result."""
    at = {name: new_path(spark, name) for name in names}
    try:
        yield SimpleNamespace(**at)
        at.pop(kept, None)
    finally:
        remove(spark, *at.values())


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select("value").write.text(path)


# ---------------------------------------------------------------- variant files


@query(
    """, lines AS (
  SELECT 'contig' AS kind, 'chr' || chrom AS value FROM g
  UNION ALL SELECT 'INFO', 'B' || p_size FROM part
  UNION ALL SELECT 'FORMAT', 'F' || c_nationkey FROM customer
  UNION ALL SELECT 'reference', 'file://' || s_name || '/x=y' FROM supplier
  UNION ALL SELECT 'source', 'caller ' || n_name FROM nation
  UNION ALL SELECT 'samples', CAST(s_nationkey AS VARCHAR) FROM supplier)
SELECT kind, value, count(*) AS n FROM lines GROUP BY kind, value""",
    "g",
)
def header_lines(spark, sf):
    """Contigs, fields, sources and numbers of samples that the headers of variant files name; records and other headers are
    among the lines and count for nothing."""
    lines = [
        view(spark, sf, "g").selectExpr("concat('##contig=<ID=chr', chrom, ',length=', en, '>') AS value"),
        view(spark, sf, "part").selectExpr("concat('##INFO=<ID=B', p_size, ',Number=1,Type=String,Description=\"of ID=', p_brand, '\">') AS value"),
        view(spark, sf, "customer").selectExpr("concat('##FORMAT=<ID=F', c_nationkey, '>') AS value"),
        view(spark, sf, "supplier").selectExpr("concat('##reference=file://', s_name, '/x=y') AS value"),
        view(spark, sf, "nation").selectExpr("concat('##source=caller ', n_name) AS value"),
        view(spark, sf, "supplier").selectExpr("concat('#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT', repeat('\tS', s_nationkey)) AS value"),
        view(spark, sf, "nation").selectExpr("concat('##filedate=', n_name) AS value"),
        view(spark, sf, "v").selectExpr("concat_ws('\t', chrom, pos, '##source=no', ref, alt, '.', filt, '.', 'GT', gt) AS value"),
    ]
    with folders(spark, "headers") as at:
        for rows in lines:
            rows.write.mode("append").text(at.headers)
        return cut(tables.vcf_header(spark, at.headers).groupBy("kind", "value").agg(F.count("*").alias("n")), "header")


@query(
    """, a AS (SELECT chrom, CASE WHEN vid % 9 = 0 THEN 0 WHEN vid % 4 = 0 THEN 2 WHEN vid % 25 = 1 THEN 3 ELSE 1 END AS alleles FROM v)
SELECT chrom, CAST(sum(greatest(alleles, 1)) AS BIGINT) AS split, count(*) FILTER (alleles = 0) AS none, count(*) FILTER (alleles = 1) AS single FROM a GROUP BY chrom""",
    "v",
)
def allele_policies(spark, sf):
    """Records with none, one, two or three alternate alleles under both policies: a row for each allele, or only records with one."""
    alt = "CASE WHEN vid % 9 = 0 THEN '.' WHEN vid % 4 = 0 THEN concat(alt, ',', alt, 'T') WHEN vid % 25 = 1 THEN concat('G,', alt, 'C,*') ELSE alt END"
    lines = view(spark, sf, "v").selectExpr(f"concat_ws('\t', concat('chr', chrom), pos, vid, ref, {alt}, '.', filt, '.', 'GT', gt) AS value")
    with folders(spark, "alleles") as at:
        write_lines(lines, at.alleles)
        split = tables.read_vcf(spark, at.alleles).groupBy("chrom").agg(F.count("*").alias("split"), F.count_if(F.col("alt") == ".").alias("none"))
        single = tables.read_vcf(spark, at.alleles, split_alleles=False).groupBy("chrom").agg(F.count("*").alias("single"))
        found = split.join(single, "chrom", "left").select("chrom", "split", "none", F.coalesce("single", F.lit(0)).alias("single"))
        return cut(found, "policies")


#: Of each contig: two that share places, one inside another, one of one place, one beyond the end. A fixed list for each contig.
SCANNED = ((200_000, 900_000), (700_000, 1_500_000), (800_000, 800_100), (2_000_000, 2_000_000), (4_000_000, 9_000_000))


@query(
    f""" SELECT chrom, pos, ref, alt, src, an FROM fr WHERE {" OR ".join(f"(pos <= {b} AND pos + length(ref) - 1 >= {a})" for a, b in SCANNED)}""",
    "fr",
)
def indexed_region_scan(spark, sf):
    """Regions of every contig by the batch source: each contig's block-gzip file is read where its bin index says, and records that
    lie in several of the regions come once."""
    dot = F.lit(".")
    records = frequencies(spark, sf).select(
        "chrom", "pos", F.col("src").alias("id"), "ref", "alt", dot.alias("qual"), F.lit("PASS").alias("filter"), F.concat(F.lit("AN="), "an").alias("info"), dot.alias("format"), dot.alias("sample"),
    )
    with folders(spark, "scanned") as at:
        regions.register(spark)
        files = regions.write_indexed(records, at.scanned)
        named = files.select("chrom", "path").collect()  # a row for each 500,000 records or stretch of 16,777,216 places of a contig
        wanted = ";".join(f"{chrom}:{a}-{b}" for chrom in sorted({f["chrom"] for f in named}) for a, b in SCANNED)
        found = spark.read.format("variant_regions").option("regions", wanted).load([f["path"] for f in named])
        out = found.select("chrom", "pos", "ref", "alt", F.col("id").alias("src"), fields.info_number(F.col("info"), "AN", "bigint").alias("an"))
        out = cut(out, "scan")
        remove(spark, files._cut_path)
        return out


@query(
    """WITH a AS (SELECT c_custkey % 30 AS k FROM customer), n AS (
  SELECT CASE WHEN k BETWEEN 1 AND 22 THEN CAST(k AS VARCHAR) WHEN k = 23 THEN 'X' WHEN k = 24 THEN 'Y' WHEN k = 25 THEN 'MT' END AS chrom FROM a)
SELECT chrom, CASE WHEN chrom = 'MT' THEN 'chrM' WHEN chrom IS NOT NULL THEN 'chr' || chrom END AS contig, count(*) AS n FROM n GROUP BY 1, 2"""
)
def accession_contigs(spark, sf):
    """Chromosomes of sequence accessions in any version; names of other kinds have none."""
    named = """CASE WHEN c_custkey % 30 BETWEEN 1 AND 24 THEN concat('NC_', lpad(CAST(c_custkey % 30 AS STRING), 6, '0'), '.', 1 + c_custkey % 12) WHEN c_custkey % 30 = 25 THEN 'NC_012920.1'
      WHEN c_custkey % 30 = 26 THEN 'NC_000025.1' WHEN c_custkey % 30 = 27 THEN concat('NT_', c_custkey, '.1') WHEN c_custkey % 30 = 28 THEN 'NC_000007' END AS acc"""
    chrom = fields.accession_chrom(F.col("acc"))
    return view(spark, sf, "customer").selectExpr(named).groupBy(chrom.alias("chrom"), fields.normal_contig(chrom).alias("contig")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- text tables and lists


@query(
    """ SELECT s.s_suppkey AS supplier, s.s_name || ', "the"' AS name, CAST(count(c.c_custkey) AS BIGINT) AS customers
FROM supplier s LEFT JOIN customer c ON c.c_nationkey = s.s_nationkey GROUP BY 1, 2"""
)
def sniffed_tables(spark, sf):
    """One reader for a table with commas, of which values hold commas and quotes, and one with tabs, of which values hold commas."""
    supplier = view(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "the"')).alias("name"), "s_nationkey")
    customer = view(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(", x")).alias("c_name"), "c_nationkey")
    with folders(spark, "commas", "tabs") as at:
        supplier.write.option("header", True).csv(at.commas)
        sinks.write_tsv(customer, at.tabs)
        s, c = tables.read_sniffed(spark, at.commas), tables.read_sniffed(spark, at.tabs)
        n = c.where("c_name LIKE '%, x'").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"))
        found = s.join(n, "s_nationkey", "left").select(F.col("s_suppkey").cast("long").alias("supplier"), "name", F.coalesce("n", F.lit(0)).alias("customers"))
        return cut(found, "sniffed")


@query(
    """, a AS (SELECT row_number() OVER (ORDER BY p_partkey) AS place, p_partkey AS k FROM part),
l AS (SELECT place, 'G' || CAST(CASE WHEN k % 13 = 0 THEN -k ELSE k END AS VARCHAR) AS gene FROM a WHERE k % 7 <> 0 AND k % 11 <> 0)
SELECT place, l.gene, st, g.gene IS NOT NULL AS known FROM l LEFT JOIN g ON g.gene = l.gene""",
    "g",
)
def name_list(spark, sf):
    """A list of names over many files, with comments and blank lines, in the list's own order, and where each name lies."""
    value = "CASE WHEN p_partkey % 7 = 0 THEN concat('  # G', p_partkey) WHEN p_partkey % 11 = 0 THEN '   ' ELSE concat(' G', IF(p_partkey % 13 = 0, -p_partkey, p_partkey), IF(p_partkey % 3 = 0, ' # a note # G1', '')) END"
    with folders(spark, "names") as at:
        view(spark, sf, "part").orderBy("p_partkey").selectExpr(f"{value} AS value").write.text(at.names)
        g = view(spark, sf, "g").select("gene", "st", F.lit(True).alias("known"))
        found = tables.read_names(spark, at.names).join(g, "gene", "left")
        return cut(found.select("place", "gene", "st", F.coalesce("known", F.lit(False)).alias("known")), "names_found")


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey AS o, 'P' || l_partkey AS gene FROM lineitem WHERE l_linenumber <> 3), s AS (SELECT o, count(*) AS size FROM m GROUP BY o)
SELECT gene, count(*) AS sets, max(size) AS largest FROM m JOIN s USING (o) GROUP BY gene"""
)
def set_library(spark, sf):
    """A library of sets, an order's parts each, with weights, repeats and blanks among the members; in how many sets each member is, and
    the size of the largest."""
    member = F.when(F.col("l_linenumber") == 3, " ,1").otherwise(F.concat(F.lit(" p"), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ",0.5").otherwise("")))
    sets = view(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("\t", F.collect_list(member)).alias("members"))
    with folders(spark, "library") as at:
        write_lines(sets.select(F.concat_ws("\t", F.concat(F.lit(" O"), F.col("l_orderkey").cast("string")), F.lit("an order"), "members").alias("value")), at.library)
        library = tables.read_gene_sets(spark, at.library).select(F.array_distinct("genes").alias("genes"))
        members = library.select(F.size("genes").alias("size"), F.explode("genes").alias("gene"))
        return cut(members.groupBy("gene").agg(F.count("*").alias("sets"), F.max("size").cast("long").alias("largest")), "library_sizes")


@query(
    """ SELECT 'O' || l_orderkey AS symbol, count(*) AS n, median(l_quantity - 25) AS median_effect, round(count(*) FILTER (l_quantity - 25 < -1) * 1.0E0 / count(*), 9) AS dependent,
  bool_or(l_returnflag = 'R') AS tractable, count(*) FILTER (l_linestatus = 'F') AS inhibitors, count(*) FILTER (l_linestatus = 'F' AND l_linenumber % 2 = 0) AS approved FROM lineitem GROUP BY l_orderkey"""
)
def cached_target_answers(spark, sf):
    """Cached nested answers on targets: effects summarised in the row, interactions by type counted."""
    line = view(spark, sf, "lineitem").withColumn("symbol", F.concat(F.lit("O"), F.col("l_orderkey").cast("string")))
    effects = F.collect_list((F.col("l_quantity") - 25).cast("double")).alias("effects")
    tractability = F.collect_list(F.struct(F.col("l_linestatus").alias("modality"), (F.col("l_returnflag") == "R").alias("value"))).alias("tractability")
    types = F.array(F.when(F.col("l_linestatus") == "F", "inhibitor").otherwise("other"))
    interactions = F.collect_list(F.struct(F.concat(F.lit("D"), F.col("l_linenumber").cast("string")).alias("drug"), (F.col("l_linenumber") % 2 == 0).alias("approved"), types.alias("types"))).alias("interactions")
    answers = line.groupBy("symbol").agg(effects, tractability, interactions)  # an answer is an order's few lines
    with folders(spark, "answers") as at:
        sinks.write_json(answers, at.answers)
        read = tables.read_targets(spark, at.answers)
        known = read.select("symbol", F.explode("interactions").alias("i")).where(F.array_contains("i.types", "inhibitor")).groupBy("symbol").agg(F.count("*").alias("inhibitors"), F.count_if("i.approved").alias("approved"))
        out = nested.target_summary(read).join(known, "symbol", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return cut(out.select("symbol", "n", "median_effect", F.round("dependent", 9).alias("dependent"), "tractable", zero("inhibitors"), zero("approved")), "targets")


# ---------------------------------------------------------------- contents


@query(
    """WITH d AS (SELECT sha256(coalesce(text, '')) AS blob, coalesce(source, '') || '/' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text FROM documents)
SELECT blob, min(path) AS path, count(*) AS n, bool_or(regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')) AS has_email,
  bool_or(regexp_matches(text, '[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}')) AS has_phone FROM d GROUP BY blob"""
)
def content_history(spark, sf):
    """Each distinct content once, under its first path, with the number of its copies and what detectors find in it: texts are told apart by
    their hashes, so only those that stay are moved and searched."""
    docs = view(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("text"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    docs = docs.withColumn("blob", F.sha2("text", 256))
    first = tables.distinct_blobs(docs.select("blob", "path"))
    texts = docs.join(first, ["blob", "path"], "left_semi").dropDuplicates(["blob"])
    found = text.scan(texts, {k: text.DETECTORS[k] for k in ("email", "phone")})
    return first.join(found.select("blob", "has_email", "has_phone"), "blob")


# ---------------------------------------------------------------- writers


@query(
    """, one AS (SELECT vid, chrom, pos, ref, alt, max(sig) AS sig FROM (SELECT v.*, c.sig FROM v LEFT JOIN cvr c ON v.chrom = c.chrom AND v.pos = c.pos AND v.ref = c.ref AND v.alt = c.alt) j GROUP BY 1, 2, 3, 4, 5)
SELECT vid, chrom, pos, ref, alt, sig, CASE WHEN length(alt) = 1 THEN 'SNV' ELSE 'indel' END AS type, 'chr' || chrom AS contig FROM one""",
    "v",
    "cvr",
)
def appended_columns(spark, sf):
    """Three passes over a table of files, each of which appends a column to those that it finds; a value that is none stays none. The first
    deals rows out by their key, drops repeats and looks the values up in a hash table of its share of the curated, so rows are shuffled once
    and never sorted; its files have about as many rows each, so that the later passes' tasks are alike. The last
    pass's files are the result."""
    tasks = dealt_tasks(spark, sf)
    curated = view(spark, sf, "cvr").select(*annotate.KEY, "sig").repartition(tasks, *annotate.KEY).hint("shuffle_hash")
    with folders(spark, "base", "curated", "typed", "placed", kept="placed") as at:
        sinks.write_tsv(view(spark, sf, "v").select("vid", *annotate.KEY), at.base)
        rows = tables.read_tsv(spark, at.base).withColumn("pos", F.col("pos").cast("long")).repartition(tasks, *annotate.KEY).distinct()
        sinks.write_tsv(rows.join(curated, annotate.KEY, "left").select("vid", *annotate.KEY, "sig"), at.curated)
        sinks.append_columns(tables.read_tsv(spark, at.curated), at.typed, type=fields.variant_type(F.col("ref"), F.col("alt")))
        sinks.append_columns(tables.read_tsv(spark, at.typed), at.placed, contig=fields.normal_contig(F.col("chrom")))
        read = tables.read_tsv(spark, at.placed)
        out = read.select(F.col("vid").cast("long").alias("vid"), "chrom", F.col("pos").cast("long").alias("pos"), "ref", "alt", "sig", "type", "contig")
        out._cut_path = at.placed
        return out


@query(""" SELECT line, chrom_1, pos_1, nullif(chrom_2, '') AS chrom_2, epcr, nullif(finding_type, '') AS finding_type FROM sub ORDER BY epcr DESC, line LIMIT 100""", "sub")
def submission_file(spark, sf):
    """The best hundred lines as one file, read back, where an empty value is none; the limit is the submission's."""
    best = view(spark, sf, "sub").orderBy(F.col("epcr").desc(), "line").limit(100)
    with folders(spark, "submission") as at:
        sinks.write_submission(best.select("line", "chrom_1", "pos_1", "chrom_2", "epcr", "finding_type"), at.submission)
        read = tables.read_sniffed(spark, at.submission)
        return cut(read.select(F.col("line").cast("long").alias("line"), "chrom_1", "pos_1", "chrom_2", F.col("epcr").cast("double").alias("epcr"), "finding_type"), "submitted")


ROUNDS = 3
STEP = """s{i} AS (SELECT t.task, t.dep, t.done OR t.dep < 0 OR coalesce(d.done, false) AS done, CASE WHEN NOT t.done AND (t.dep < 0 OR coalesce(d.done, false)) THEN {i} ELSE t.round END AS round
  FROM s{before} t LEFT JOIN s{before} d ON t.dep = d.task)"""


@query(
    ", s0 AS (SELECT task, dep, done, CAST(NULL AS INTEGER) AS round FROM dag), "
    + ", ".join(STEP.format(i=i, before=i - 1) for i in range(1, ROUNDS + 1))
    + f" SELECT task, done, CAST(round AS INTEGER) AS round, round IS NOT NULL AS logged FROM s{ROUNDS}",
    "dag",
)
def queue_state(spark, sf):
    """Three rounds of a queue: each reads the state, replaces it by one in which tasks are done whose dependency was done or is outside,
    and appends those to the log. The state that is replaced is the one that is read."""
    with folders(spark, "state", "log") as at:
        sinks.replace_state(view(spark, sf, "dag").select("task", "dep", "done"), at.state)
        for i in range(1, ROUNDS + 1):
            now = spark.read.parquet(at.state)
            over = now.where("done").select(F.col("task").alias("dep"), F.lit(True).alias("free"))
            after = cut(now.join(over, "dep", "left").select("task", "dep", "done", (~F.col("done") & (F.coalesce("free", F.lit(False)) | (F.col("dep") < 0))).alias("now")), "round")
            sinks.append_log(after.where("now").select("task", F.lit(i).alias("round")), at.log)
            sinks.replace_state(after.select("task", "dep", (F.col("done") | F.col("now")).alias("done")), at.state)
            remove(spark, after._cut_path)
        log = tables.read_json_lines(spark, at.log, "task long, round int")
        found = spark.read.parquet(at.state).join(log, "task", "left")
        return cut(found.select("task", "done", "round", F.col("round").isNotNull().alias("logged")), "queue")
