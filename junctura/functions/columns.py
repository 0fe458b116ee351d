"""Column functions over strands, coordinates, CIGAR strings, flags and sequences; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "([0-9]+[MIDNSHP=XB])"


def strand(c: Column) -> Column:
    """+ and - stay, all else (null too) is "."."""
    first = F.substring(c, 1, 1)
    return F.when(first.isin("+", "-"), first).otherwise(F.lit("."))


def region(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_region(c: Column) -> Column:
    """struct(chrom, start, end) of "chrom:start-end", cut at the first colon and the first dash after it; null if malformed."""
    parts = [F.regexp_extract(c, r"^([^:]+):([0-9]+)-([0-9]+)$", i) for i in (1, 2, 3)]
    made = F.struct(parts[0].alias("chrom"), parts[1].try_cast("long").alias("start"), parts[2].try_cast("long").alias("end"))
    return F.when(parts[0] != "", made)


def junction_name(chrom: Column, start: Column, end: Column, strand_: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("("), strand_, F.lit(")"))


def cigar_ops(cigar: Column) -> Column:
    return F.regexp_extract_all(cigar, F.lit(OPS), F.lit(1))


def introns(pos: Column, cigar: Column) -> Column:
    """array<struct<start, end>>: reference intervals of the N operations, by one fold over the operations."""

    def step(acc: Column, op: Column) -> Column:
        n, kind = F.left(op, F.length(op) - 1).cast("long"), F.right(op, F.lit(1))
        after = acc["at"] + F.when(kind.isin("M", "D", "N", "=", "X"), n).otherwise(F.lit(0).cast("long"))
        found = F.when(kind == "N", F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), after.alias("end"))))).otherwise(acc["found"])
        return F.struct(after.alias("at"), found.alias("found"))

    start = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("found"))
    return F.aggregate(cigar_ops(cigar), start, step)["found"]


def reference_length(cigar: Column) -> Column:
    kinds = F.filter(cigar_ops(cigar), lambda op: F.right(op, F.lit(1)).isin("M", "D", "N", "=", "X"))
    return F.aggregate(kinds, F.lit(0).cast("long"), lambda a, op: a + F.left(op, F.length(op) - 1).cast("long"))


def is_mapped(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(4)) == 0


def is_paired(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(1)) != 0


def pair_order(flag: Column) -> Column:
    return F.when(flag.bitwiseAND(F.lit(0x40)) != 0, 1).when(flag.bitwiseAND(F.lit(0x80)) != 0, 2).otherwise(0)


def hamming(a: Column, b: Column) -> Column:
    """Differing places; -1 if the lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) != F.length(b), F.lit(-1)).when(F.length(a) == 0, F.lit(0)).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def middle(seq: Column, n: int) -> Column:
    """The middle n characters (all, if fewer)."""
    return F.when(F.length(seq) <= n, seq).otherwise(F.substring(seq, F.floor((F.length(seq) - n) / 2).cast("int") + 1, F.lit(n)))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def rescored(cigar: Column, r: Column, q: Column, r_st: Column, q_st: Column, scoring) -> Column:
    """Score of an alignment from its CIGAR (M, I, D) and the two sequences from r_st and q_st (0-based) on: matches less mismatches, each gap at the cheaper of the two affine costs. One fold over the operations."""

    def step(acc: Column, op: Column) -> Column:
        n, kind = F.left(op, F.length(op) - 1).cast("int"), F.right(op, F.lit(1))
        differ = hamming(F.upper(F.substring(r, acc["i"] + 1, n)), F.upper(F.substring(q, acc["j"] + 1, n)))
        gap = F.least(scoring.gap_open + n * scoring.gap_extend, scoring.gap_open_long + n * scoring.gap_extend_long)
        gain = F.when(kind == "M", (n - differ) * scoring.match - differ * scoring.mismatch).when(kind.isin("I", "D"), -gap).otherwise(F.lit(0))
        return F.struct(
            (acc["i"] + F.when(kind.isin("M", "D"), n).otherwise(F.lit(0))).alias("i"),
            (acc["j"] + F.when(kind.isin("M", "I"), n).otherwise(F.lit(0))).alias("j"),
            (acc["total"] + gain).alias("total"),
        )

    start = F.struct(r_st.cast("int").alias("i"), q_st.cast("int").alias("j"), F.lit(0).alias("total"))
    return F.aggregate(cigar_ops(cigar), start, step)["total"]
