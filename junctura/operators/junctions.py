"""From alignments to junctions: filters, CIGAR explosion, counting per sample, merging, region scans, ordered merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..params import DEFAULT, KEYS


def spliced(alignments: DataFrame) -> DataFrame:
    """Mapped alignments to a named contig with an N operation."""
    return alignments.where(C.is_mapped(F.col("flag")) & F.col("chrom").isNotNull() & F.col("cigar").contains("N"))


def events(alignments: DataFrame) -> DataFrame:
    """The alignment's columns, and start, end, strand of each of its introns; no shuffle."""
    rows = spliced(alignments).withColumn("strand", C.strand(F.col("xs")))
    return rows.withColumn("_j", F.explode(C.introns(F.col("pos"), F.col("cigar")))).select("*", F.col("_j.start").alias("start"), F.col("_j.end").alias("end")).drop("_j")


def weight(kind: str | None) -> Column:
    """None: every alignment counts one; "yc": as its YC tag says, one at least."""
    if kind is None:
        return F.lit(1).cast("long")
    if kind == "yc":
        return F.greatest(F.coalesce(F.col("yc").cast("long"), F.lit(1)), F.lit(1))
    raise ValueError(f"weight {kind!r}")


def counts(alignments: DataFrame, weigh: str | None = None) -> DataFrame:
    """keys, sample, score: alignments that support a junction."""
    return events(alignments).groupBy(*KEYS, "sample").agg(F.sum(weight(weigh)).alias("score"))


def merged(per_sample: DataFrame) -> DataFrame:
    """keys, total_score, samples (array of sample and score, by name): scores of a sample add up first."""
    per = per_sample.groupBy(*KEYS, "sample").agg(F.sum("score").alias("score"))
    return per.groupBy(*KEYS).agg(F.sum("score").alias("total_score"), F.sort_array(F.collect_list(F.struct("sample", "score"))).alias("samples"))


def append_samples(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two junction tables as one: totals add up, sample lists are joined without adding up equal names."""
    both = a.select(*KEYS, "total_score", "samples").unionByName(b.select(*KEYS, "total_score", "samples"))
    return both.groupBy(*KEYS).agg(F.sum("total_score").alias("total_score"), F.flatten(F.collect_list("samples")).alias("samples"))


def overlapping(alignments: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Mapped alignments that overlap a region (0-based, half-open); simple comparisons on chrom and pos reach the scan."""
    rows = alignments.where((F.col("chrom") == chrom) & (F.col("pos") < end) & C.is_mapped(F.col("flag")))
    return rows.where(F.col("pos") + F.greatest(C.reference_length(F.col("cigar")), F.lit(1)) > start)


def in_region(alignments: DataFrame, region: str | None) -> DataFrame:
    """Mapped alignments that overlap a region "chrom:start-end" (1-based, inclusive); a malformed region gives none."""
    import re

    m = re.fullmatch(r"([^:]+):([0-9]+)-([0-9]+)", region or "")
    return overlapping(alignments, m[1], int(m[2]) - 1, int(m[3])) if m else alignments.limit(0)


def region_counts(alignments: DataFrame, region: str | None) -> DataFrame:
    """Counts of one region."""
    return counts(in_region(alignments, region))


def by_tile(alignments: DataFrame, tile: int = DEFAULT.scan_tile) -> DataFrame:
    """Alignments with the tile that owns them (that of their pos), so that each counts once however many tiles it spans."""
    return alignments.withColumn("tile", F.floor(F.col("pos") / tile))


def overlap_join(reads: DataFrame, regions: DataFrame, width: int = 10_000) -> DataFrame:
    """reads (chrom, pos, cigar, ...) x regions (region, chrom, start, end): pairs that overlap. An equi-join on bins; a pair counts in the first bin it shares."""
    stop = F.col("pos") + F.greatest(C.reference_length(F.col("cigar")), F.lit(1))
    left = reads.withColumn("_stop", stop).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor((F.col("_stop") - 1) / width))))
    right = regions.where("start < end").select(F.col("region"), F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")).withColumn("_rbin", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor((F.col("_e") - 1) / width))))
    both = left.join(right, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_rbin")) & (F.col("pos") < F.col("_e")) & (F.col("_s") < F.col("_stop")))
    return both.where(F.col("_bin") == F.floor(F.greatest("pos", "_s") / width)).drop("_c", "_s", "_e", "_bin", "_rbin", "_stop")


def merge_order(alignments: DataFrame) -> DataFrame:
    """Alignments of several coordinate-sorted files in one order: contig, position, file."""
    return alignments.orderBy("tid", "pos", "file_idx")


def require_sorted(header: str) -> None:
    """An ordered merge needs files that say they are sorted by coordinate."""
    if "SO:coordinate" not in header:
        raise ValueError("the file is not sorted by coordinate")


def merge_files(spark, paths: list[str]) -> DataFrame:
    """Alignments of several sorted BAM files in one order, with file_idx, the place of each file in the list."""
    from ..sources import bam

    out: DataFrame | None = None
    for i, path in enumerate(paths):
        with bam.opened(path) as f:
            require_sorted(bam.header(bam.Stream(f))[0])
        got = bam.read_bam(spark, [path]).withColumn("file_idx", F.lit(i))
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no file is given")
    return merge_order(out)


def without(junctions: DataFrame, others: DataFrame) -> DataFrame:
    """Junctions whose key is not among others (trusted or spurious): an anti join, broadcast only where Spark knows the set to be small."""
    return junctions.join(others.select(*KEYS).distinct(), KEYS, "left_anti")
