"""Genomic views derived from the driver's tables by whole-number arithmetic, the same text for Spark and DuckDB.

@S stands for the string type, @D for whole-number division. The views hold no real coordinate."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CHROM = "CASE WHEN {c} = 23 THEN 'X' WHEN {c} = 24 THEN 'Y' ELSE CAST({c} AS @S) END"


def base(o: str, key: str = "p_partkey") -> str:
    """Number 1 to 4 of the base at offset o of a part's sequence, in TCAG."""
    return f"(1 + (((({key} + 1) * (({o}) + 3) * 7919 + ({o}) * ({o}) * 104729) @D 7) % 4))"


VIEWS: dict[str, str] = {
    "v": f"""
SELECT l_orderkey * 10 + l_linenumber AS vid, {CHROM.format(c="(1 + l_suppkey % 24)")} AS chrom,
       1 + (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 5000000 AS pos,
       substr('ACGT', CAST(1 + l_partkey % 4 AS INT), 1) AS ref,
       concat(substr('ACGT', CAST(1 + (l_partkey + 1 + l_linenumber % 3) % 4 AS INT), 1),
              CASE WHEN l_partkey % 10 = 0 THEN substr('AAA', 1, CAST(1 + l_orderkey % 3 AS INT)) ELSE '' END) AS alt,
       CASE WHEN l_returnflag = 'R' THEN 'LowQual' ELSE 'PASS' END AS filt,
       CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN '0/0' WHEN 1 THEN '1/1' WHEN 2 THEN '0|1' WHEN 3 THEN '0/1' ELSE './.' END AS gt,
       CAST(l_quantity AS INT) AS dp, l_orderkey, l_partkey, l_suppkey, l_linenumber
FROM lineitem""",
    "g": f"""
SELECT concat('G', CAST(p_partkey AS @S)) AS gene, {CHROM.format(c="(1 + p_partkey % 24)")} AS chrom,
       (p_partkey * 2399) % 5000000 AS st, (p_partkey * 2399) % 5000000 + 5000 + p_size * 800 AS en, p_partkey
FROM part""",
    "fr": """
SELECT chrom, pos, ref, alt, src, max(af) AS af, max(an) AS an FROM (
  SELECT chrom, pos, ref, alt, 'exome' AS src, CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE (l_partkey % 200) / 100000.0E0 END AS af,
         1000 + l_orderkey % 5000 AS an FROM v WHERE l_orderkey % 3 < 2 AND l_partkey % 5 <> 0
  UNION ALL
  SELECT chrom, pos, ref, alt, 'genome' AS src, CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE (l_partkey % 200) / 100000.0E0 END AS af,
         1000 + (l_orderkey * 7) % 5000 AS an FROM v WHERE l_orderkey % 3 > 0 AND l_partkey % 5 <> 0) s
GROUP BY chrom, pos, ref, alt, src""",
    "cvr": """
SELECT chrom, pos, ref, alt,
       CASE min(l_partkey) % 4 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_pathogenic' WHEN 2 THEN 'Uncertain_significance' ELSE 'Benign' END AS sig,
       concat('D', CAST(min(l_partkey) % 5 AS @S), '|D', CAST(min(l_suppkey) % 7 AS @S)) AS dn
FROM v WHERE l_orderkey % 17 = 0 GROUP BY chrom, pos, ref, alt""",
    "info": """
SELECT vid, concat('AC=2;AF=', CASE WHEN l_partkey % 13 = 0 THEN '.' WHEN l_partkey % 11 = 0 THEN 'bad' ELSE concat('0.', CAST(1000 + l_partkey % 9000 AS @S)) END,
       CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE concat(';AN=', CAST(1000 + l_orderkey % 5000 AS @S)) END,
       ';GENEINFO=G', CAST(l_partkey AS @S), ':', CAST(l_suppkey AS @S), '|H', CAST(l_suppkey AS @S), ':1;CLNSIG=',
       CASE l_partkey % 3 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_pathogenic/other' ELSE 'Benign' END) AS info
FROM v""",
    "sample": """
SELECT vid, chrom, pos, ref, alt, filt, CASE WHEN l_linenumber % 3 = 0 THEN 'GT:AD:DP:GQ' ELSE 'GT:DP:AD' END AS format,
       CASE WHEN l_linenumber % 3 = 0 THEN concat(gt, ':', CAST(dp AS @S), ',', CAST(l_partkey % 40 AS @S), ':', CAST(dp + l_partkey % 40 AS @S), ':', CAST(l_suppkey % 99 AS @S))
            WHEN l_linenumber % 5 = 0 THEN concat(gt, ':', CAST(dp AS @S))
            WHEN l_linenumber % 7 = 0 THEN concat(gt, ':', CAST(dp AS @S), ':.,.')
            ELSE concat(gt, ':', CAST(dp AS @S), ':', CAST(dp AS @S), ',', CAST(l_partkey % 40 AS @S)) END AS sample
FROM v""",
    "ph": """
SELECT vid, concat('G', CAST(l_partkey % 600 AS @S)) AS gene, CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_orderkey % 11 AS @S) WHEN l_linenumber % 4 = 1 THEN '.' END AS pid,
       CASE WHEN l_linenumber % 4 = 0 THEN CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN '1|0' ELSE '0|1' END WHEN l_linenumber % 4 = 1 THEN '.' END AS pgt,
       pos, vid % 3 = 0 AS impact
FROM v WHERE gt = '0|1'""",
    "dna": "SELECT p_partkey AS sid, concat(" + ", ".join(f"substr('TCAG', CAST({base(str(o))} AS INT), 1)" for o in range(48)) + ") AS seq FROM part",
    "chrpart": """
SELECT concat('C', CAST((sid - 1) % 24 AS @S)) AS acc, (sid - 1) @D 24 AS k, sid, CASE WHEN sid % 50 = 0 THEN 'NNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNNN' ELSE seq END AS seq FROM dna""",
    "tx": """
SELECT concat('T', CAST(p_partkey AS @S)) AS acc, concat('G', CAST(p_partkey @D 2 AS @S)) AS gene, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
       k AS exon, (p_partkey * 2399) % 5000000 + k * 400 AS st, (p_partkey * 2399) % 5000000 + k * 400 + 59 + (p_partkey + k) % 90 AS en,
       (p_partkey * 2399) % 5000000 + 20 AS cds_st, (p_partkey * 2399) % 5000000 + 830 AS cds_en
FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) e""",
    "site": """
SELECT vid, concat('T', CAST(l_partkey AS @S)) AS acc, (l_partkey * 2399) % 5000000 + (l_orderkey * 7 + l_linenumber * 13) % 1000 AS pos FROM lineitem_v""",
    "txseq": "SELECT concat('T', CAST(sid AS @S)) AS acc, repeat(seq, 10) AS seq FROM dna",
    "change": """
SELECT s.vid, t.gene, s.pos, substr('ACGT', CAST(1 + s.vid % 4 AS INT), 1) AS ref, substr('ACGT', CAST(1 + (s.vid + 1 + s.pos % 3) % 4 AS INT), 1) AS alt FROM site s JOIN (SELECT DISTINCT acc, gene FROM tx) t ON s.acc = t.acc""",
    "codon": f"""
SELECT vid, gene, ref, alt, strand, cds_len, o, concat({", ".join("substr('TCAG', CAST(" + base(f"o - o % 3 + {i}") + " AS INT), 1)" for i in range(3))}) AS codon, o % 3 AS off
FROM (SELECT vid, concat('G', CAST(l_partkey AS @S)) AS gene, ref, substr(alt, 1, 1) AS alt, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
             l_partkey AS p_partkey, 600 + 3 * (l_partkey % 90) AS cds_len, (l_orderkey * 13 + l_linenumber) % 900 AS o FROM v WHERE length(alt) = 1) c""",
    "win": """
SELECT chrom, pos, dp, (dp * (20 + vid % 61)) @D 100 AS altdp, gt IN ('0|1', '0/1') AS het, vid FROM v WHERE filt = 'PASS' AND dp >= 20""",
    "gs": "SELECT DISTINCT o_orderpriority AS grp, concat('C', CAST(o_custkey AS @S)) AS gene FROM orders",
    "ps": "SELECT DISTINCT p_brand AS a, p_type AS b, p_partkey AS item FROM part",
    "dag": """
SELECT o_orderkey AS task, CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey ELSE o_orderkey @D 2 END AS dep, o_orderstatus = 'F' AS done, o_orderpriority AS priority
FROM orders WHERE o_orderkey > 1""",
    "notes": """
SELECT o_orderkey AS line, CAST(o_orderkey % 24 AS INT) AS kind, concat(CASE WHEN o_orderkey % 48 < 24 THEN 'see ' ELSE 'the entry, ' END, CASE o_orderkey % 24
  WHEN 0 THEN concat('7:', CAST(100000 + o_orderkey AS @S)) WHEN 1 THEN concat('chrX - ', CAST(100000 + o_orderkey AS @S)) WHEN 2 THEN concat('MT:', CAST(10000 + o_orderkey % 6000 AS @S))
  WHEN 3 THEN concat('a', chr(9), '12', chr(9), CAST(100000 + o_orderkey AS @S), chr(9), 'b') WHEN 4 THEN concat('a,chr3,', CAST(100000 + o_orderkey AS @S), ',b') WHEN 5 THEN concat('rs', CAST(100 + o_orderkey % 900 AS @S))
  WHEN 6 THEN concat('rs', CAST(o_orderkey % 90 + 10 AS @S)) WHEN 7 THEN concat('m.', CAST(o_orderkey AS @S), 'A>G') WHEN 8 THEN concat('n. -', CAST(o_orderkey AS @S)) WHEN 9 THEN concat('p.', CAST(o_orderkey AS @S))
  WHEN 10 THEN concat('0/1:', CAST(o_orderkey % 30 AS @S), ',8:20:99') WHEN 11 THEN concat('15 ', CAST(100000 + o_orderkey AS @S), ' . A G') WHEN 12 THEN '0/1 or 1/1' WHEN 13 THEN concat('25:', CAST(100000 + o_orderkey AS @S))
  WHEN 14 THEN concat('a.b', CAST(o_orderkey AS @S), '@example.org') WHEN 15 THEN concat('(555) 555-', CAST(1000 + o_orderkey % 9000 AS @S)) WHEN 16 THEN concat('at ', CAST(o_orderkey % 24 AS @S), ':30 on day ', CAST(o_orderkey % 28 AS @S))
  WHEN 17 THEN 'work/out.tsv' WHEN 18 THEN 'network/out.tsv' WHEN 19 THEN 'x.bam' WHEN 20 THEN 'p.Ala123Val' WHEN 21 THEN 'sample_id=S1' WHEN 22 THEN concat('chr7 ', CAST(100000 + o_orderkey AS @S)) ELSE 'nothing of note' END, ' there') AS text
FROM orders""",
    "sub": """
SELECT o_orderkey AS line, CASE WHEN o_orderkey % 29 = 0 THEN 'Z9' WHEN o_orderkey % 3 = 0 THEN concat('chr', CAST(1 + o_custkey % 22 AS @S)) WHEN o_orderkey % 5 = 0 THEN 'MT' ELSE CAST(1 + o_custkey % 24 AS @S) END AS chrom_1,
       CASE WHEN o_orderkey % 31 = 0 THEN 'x' ELSE CAST(1 + o_orderkey % 900000 AS @S) END AS pos_1, substr('ACGT', CAST(1 + o_custkey % 4 AS INT), 1) AS ref_1,
       CASE WHEN o_orderkey % 37 = 0 THEN '<DEL>' ELSE substr('ACGT', CAST(1 + (o_custkey + 1) % 4 AS INT), 1) END AS alt_1,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(1 + o_custkey % 22 AS @S) ELSE '' END AS chrom_2, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 = 0 THEN '77' ELSE '' END AS pos_2,
       CAST((o_orderkey * 7) % 1001 AS DOUBLE) / 1000.0E0 AS epcr, o_custkey % 50 AS proband, CASE WHEN o_orderkey % 41 = 0 THEN 'odd' WHEN o_orderkey % 2 = 0 THEN 'primary' ELSE '' END AS finding_type
FROM orders""",
}
VIEWS["site"] = VIEWS["site"].replace("lineitem_v", "v")

NEEDS = {n: [o for o in VIEWS if o != n and re.search(rf"(FROM|JOIN) {o}\b", text)] for n, text in VIEWS.items()}


def ordered(*names: str) -> list[str]:
    """The views with what they need, each after its needs."""
    out: list[str] = []
    for n in names:
        for m in [*ordered(*NEEDS[n]), n]:
            if m not in out:
                out.append(m)
    return out


def duck(*names: str, recursive: bool = False) -> str:
    """WITH clause that defines the views in DuckDB."""
    body = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered(*names)).replace("@S", "VARCHAR").replace("@D", "//")
    return f"WITH {'RECURSIVE ' * recursive}{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; a driver's table under its own name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("@S", "STRING").replace("@D", "DIV")
    needs = [t for t in (*TABLES, *VIEWS) if re.search(rf"(FROM|JOIN) {t}\b", text)]
    return spark.sql(re.sub(rf"(FROM|JOIN) ({'|'.join(needs)})\b", r"\1 {\2}", text), **{n: view(spark, sf_dir, n) for n in needs})


#: Variants that a task takes where they are dealt out by their key.
DEALT = 250_000


def dealt_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks take the variants by their key: the more variants, the more tasks; on small tables one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-view(spark, sf_dir, "lineitem").count() // DEALT))


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the view fr. Variants are read once and dealt out by their key, and a task makes both sources' records of its own, so
    aggregates by the key, or by the key and more, shuffle nothing else. A union of two reads would be shuffled for each of them."""
    v = view(spark, sf_dir, "v").where("l_partkey % 5 <> 0").select("chrom", "pos", "ref", "alt", "l_orderkey", "l_partkey")
    v = v.repartition(dealt_tasks(spark, sf_dir), "chrom", "pos", "ref", "alt")
    exome = F.expr("struct('exome' AS src, l_orderkey % 3 < 2 AS here, 1000 + l_orderkey % 5000 AS an)")
    genome = F.expr("struct('genome' AS src, l_orderkey % 3 > 0 AS here, 1000 + (l_orderkey * 7) % 5000 AS an)")
    af = F.expr("CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE (l_partkey % 200) / 100000.0E0 END AS af")
    records = v.select("chrom", "pos", "ref", "alt", af, F.inline(F.array(exome, genome))).where("here")
    return records.groupBy("chrom", "pos", "ref", "alt", "src").agg(F.max("af").alias("af"), F.max("an").alias("an"))
