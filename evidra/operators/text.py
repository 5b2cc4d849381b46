"""Content scanners in JVM regular expressions: coordinates, identifiers, genotype tables, outgoing text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How contigs are written, and the rules of the first four detectors.
CONTIG = r"(?:chr)?(?:[1-9]|1[0-9]|2[0-2]|X|Y|MT?)"
DETECTORS = {
    "coordinate": rf"\b{CONTIG}\s*[:-]\s*[0-9]{{5,}}\b",
    "column_coordinate": rf"(?m)(?:^|[,\t]){CONTIG}[,\t]\s*[0-9]{{5,}}(?:[,\t]|$)",
    "rsid": r"\brs[0-9]{3,}\b",
    "hgvs": r"\b[cgmn]\.\s*-?\*?[0-9]+",
    "genotype": rf"\b[0-9][/|][0-9]:[0-9]+,[0-9]+:[0-9]+\b|\b{CONTIG}\s+[0-9]{{4,9}}\s+\S+\s+[ACGTN]+\s+[ACGTN,]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "phone": r"[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}",
}
GENOMIC_FILE = r"(?i)\.(vcf|bcf|bam|cram|fastq|fq|gvcf|bai|crai|csi|tbi|bgz)(\.(gz|bgz|tbi|csi|bai))*$"

#: What may not leave, as text or as a command.
EGRESS = {
    "coordinate": rf"\b{CONTIG}[:-][0-9]{{5,}}|\bchr([0-9]{{1,2}}|X|Y|M)\s+[0-9]{{5,}}",
    "record": rf"(?<![0-9.])\b{CONTIG}\s+[0-9]{{5,9}}\s+\S+\s+[ACGTN]+\s+[ACGTN,]+",
    "rsid": r"(?i)\brs[0-9]{3,}\b",
    "hgvs": r"\b[NX][MPRC]_[0-9]+|\b[cg]\.[*-]?[0-9]+([+-][0-9]+)?([ACGT]>[ACGT]|del|dup|ins)|\bp\.\(?[A-Z][a-z]{2}[0-9]+",
    "sample": r"(?i)\b(proband|sample|patient)[_-]?(id)?\s*[:=#_-]\s*[A-Za-z0-9]*[0-9]",
    "genotype": r"\b(GT|genotype)\s*[:=]?\s*[01.][/|][01.]|(?<![0-9/])[0-9.][/|][0-9.]:[0-9]+",
    "data_path": r"(^|[\s\"'=@/])(data|work)/",
    "genomic_file": r"(?i)\S+\.(vcf|bcf|bam|cram|fastq|fq)(\.gz|\.bgz)?(\.tbi|\.csi|\.bai)?\b",
}


#: What a text has to hold for a detector to be tried: tests that are much cheaper than its expression.
SIGNS = {
    "coordinate": lambda t: F.contains(t, F.lit(":")) & t.rlike("[0-9]{5}") | t.rlike("-\\s*[0-9]{5}"),
    "column_coordinate": lambda t: t.rlike("[,\t]\\s*[0-9]{5}"),
    "rsid": lambda t: F.contains(t, F.lit("rs")),
    "hgvs": lambda t: t.rlike("[cgmn][.]"),
    "email": lambda t: F.contains(t, F.lit("@")),
    "phone": lambda t: F.contains(t, F.lit("(")),
}


def scan(docs: DataFrame, detectors: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """docs with one boolean column for each detector; null texts match nothing."""
    t = F.col(text)
    found = {k: t.rlike(p) for k, p in (detectors or DETECTORS).items()}
    signs = {k: SIGNS[k](t) if k in SIGNS and p == DETECTORS.get(k) else F.lit(True) for k, p in (detectors or DETECTORS).items()}
    return docs.withColumns({f"has_{k}": F.coalesce(F.when(signs[k], c), F.lit(False)) for k, c in found.items()})


def blocked(text: Column, samples: tuple[str, ...] = ()) -> Column:
    """Whether outgoing text holds anything of EGRESS, or one of the samples' names."""
    hits = [F.coalesce(text.rlike(p), F.lit(False)) for p in EGRESS.values()] + [F.coalesce(F.contains(text, F.lit(s)), F.lit(False)) for s in samples]
    return F.array_contains(F.array(*hits), True)


def mask_identifiers(text: Column) -> Column:
    """Numbers of four digits or more and the local parts of addresses masked."""
    return F.regexp_replace(F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@", "***@"), "[0-9]{4,}", "####")


def line_hits(docs: DataFrame, pattern: str, least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with at least so many lines that match. Lines are counted in the row, none is put out."""
    n = F.size(F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(pattern)))
    return docs.select(key, n.cast("long").alias("hits")).where(F.col("hits") >= least)
