"""Expressions over nucleotide strings: complement, codons, protein notation, consequence classes, motif scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amino acids of the 64 codons in TCAG order, and their three-letter names.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
THREE = {
    "A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu",
    "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "Ter",
}
#: The donor consensus, one set of allowed bases for each of the three exon and six intron positions.
DONOR = ("AC", "A", "G", "G", "T", "AG", "A", "G", "T")


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    """Keeps letter case; other characters stay as they are."""
    return complement(F.reverse(s))


def amino_acid(codon: Column) -> Column:
    """One-letter amino acid of a codon; null unless it is three of ACGT."""
    at = [F.instr(F.lit("TCAG"), F.substring(F.upper(codon), i, 1)) - 1 for i in (1, 2, 3)]
    index = at[0] * 16 + at[1] * 4 + at[2] + 1
    return F.when(F.upper(codon).rlike("^[ACGT]{3}$"), F.substr(F.lit(AMINO), index.cast("int"), F.lit(1)))


def three_letter(amino: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv]), amino)


def put_base(codon: Column, at: Column, base: Column) -> Column:
    """codon with the base at offset at (from 0) replaced."""
    return F.concat(F.substr(codon, F.lit(1), at), base, F.substr(codon, at + 2, F.lit(3)))


def stranded(base: Column, strand: Column) -> Column:
    return F.when(strand == "-", complement(base)).otherwise(base)


def snv_class(before: Column, after: Column) -> Column:
    """nonsense, stop_loss, synonymous or missense, from one-letter amino acids."""
    return (
        F.when(before.isNull() | after.isNull(), None).when(before == after, "synonymous").when(after == "*", "nonsense").when(before == "*", "stop_loss").otherwise("missense")
    )


def length_class(ref: Column, alt: Column) -> Column:
    """frameshift or inframe for plain alleles of different lengths; null for equal lengths and symbolic alleles."""
    plain = ref.rlike("^[ACGTN]+$") & alt.rlike("^[ACGTN]+$") & (F.length(ref) != F.length(alt))
    return F.when(plain, F.when((F.length(alt) - F.length(ref)) % 3 != 0, "frameshift").otherwise("inframe"))


def protein_change(before: Column, number: Column, after: Column) -> Column:
    """p.XaaNYaa, = for no change; the start codon's loss is p.Met1?."""
    name = F.concat(F.lit("p."), three_letter(before), number.cast("string"))
    return F.when((number == 1) & (before != after), "p.Met1?").when(before == after, F.concat(name, F.lit("="))).otherwise(F.concat(name, three_letter(after)))


def donor_score(window: Column) -> Column:
    """How many of the nine donor positions of a window (three exon, six intron bases) are as in the consensus."""
    parts = [F.substring(window, i + 1, 1).isin(*bases).cast("int") for i, bases in enumerate(DONOR)]
    return sum(parts[1:], parts[0])


def pyrimidine_share(window: Column) -> Column:
    """Share of C and T; null for an empty window."""
    n = F.length(window)
    return F.when(n > 0, F.length(F.regexp_replace(window, "[^CTct]", "")) / n)


def motif_places(s: Column, motif: str) -> Column:
    """Positions (from 1) at which the motif starts, overlaps included."""
    last = F.length(s) - len(motif) + 1
    return F.when(last >= 1, F.filter(F.sequence(F.lit(1), last), lambda i: F.substr(s, i, F.lit(len(motif))) == motif)).otherwise(F.array().cast("array<int>"))
