"""The whole flows: junctions from any input, detection, and what comes out of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filtering, junctions as J, spurious as S
from ..params import DEFAULT, KEYS, Params
from ..shared import cut as settle
from ..shared import discard


def aligned_flanks(found: DataFrame, genome: DataFrame, sizes: DataFrame, trusted: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """Junctions with a self-alignment; trusted ones never get so far."""
    rows = J.without(found, trusted) if trusted is not None else found
    return S.self_aligned(S.flank_sequences(rows, genome, sizes, p), p)


def by_score(aligned: DataFrame, is_bam: bool, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Of junctions with a self-alignment (whose score becomes align_score): those whose score is too low to need a search in the genome (of alignments only), and the rest."""
    rows = aligned.withColumn("align_score", F.col("hit.score"))
    low = F.lit(is_bam) & (F.col("total_score") <= p.min_junc_score)
    return rows.where(low), rows.where(~low)


def spurious(scarce: DataFrame, counted: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The union of those with too low a score and of those that the rules find spurious by their counts, with reason."""
    for t in ("seq1_count", "seq2_count", "seqh_count"):
        scarce = scarce.withColumn(t, F.lit(0).cast("long"))
    judged = counted.where(S.verdict(p)).withColumn("reason", F.lit("repeat"))
    return judged.unionByName(scarce.withColumn("reason", F.lit("low score")), allowMissingColumns=True)


def detect(found: DataFrame, genome: DataFrame, sizes: DataFrame, trusted: DataFrame | None = None, is_bam: bool = True, p: Params = DEFAULT) -> DataFrame:
    """Spurious junctions with align_score, counts and reason."""
    scarce, rest = by_score(settle(aligned_flanks(found, genome, sizes, trusted, p), "aligned"), is_bam, p)
    return spurious(scarce, S.with_counts(rest, S.match_counts(S.probes(rest, p), genome, p)), p)


@dataclass
class Result:
    original: DataFrame
    removed: DataFrame
    kept: DataFrame
    alignments: DataFrame | None = None  # with fates

    @property
    def filtered(self) -> DataFrame | None:
        return None if self.alignments is None else self.alignments.where("fate is null").drop("fate")

    @property
    def removed_alignments(self) -> DataFrame | None:
        return None if self.alignments is None else self.alignments.where("fate is not null")


def _result(found: DataFrame, removed: DataFrame) -> Result:
    return Result(found, removed, J.without(found, removed))


def from_alignments(alignments: DataFrame, genome: DataFrame, sizes: DataFrame, trusted: DataFrame | None = None, weigh: str | None = None, p: Params = DEFAULT, remove_mate: bool = True) -> Result:
    found = settle(J.merged(J.counts(alignments, weigh)))
    got = _result(found, settle(detect(found, genome, sizes, trusted, True, p)))
    got.alignments = filtering.filtered(alignments, got.removed, remove_mate)
    return got


def from_junctions(found: DataFrame, genome: DataFrame, sizes: DataFrame, trusted: DataFrame | None = None, p: Params = DEFAULT) -> Result:
    """BED or GTF input: no rule on scores."""
    found = settle(found)
    return _result(found, settle(detect(found, genome, sizes, trusted, False, p)))


def build_genome(spark: SparkSession, fasta: str, out: str, p: Params = DEFAULT, patience: float = 3600) -> tuple[DataFrame, DataFrame]:
    """Tiles and sizes of a FASTA file as Parquet; what is there already is used again, and a folder is complete once Spark's success marker is in it. Of two that would build it, the one that makes the lock file does, and the other waits for it (for `patience` seconds at most)."""
    import time

    from ..sources import text

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    done, lock = path(f"{out}/sizes/_SUCCESS"), path(f"{out}.lock")
    files = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    until = time.monotonic() + patience
    while not files.exists(done):
        if files.createNewFile(lock):
            try:
                if not files.exists(done):
                    parts = settle(text.parse_fasta(text.read_lines(spark, [fasta])), "fasta")
                    text.tiles(parts, p.tile, p.tile_overlap).write.mode("overwrite").parquet(f"{out}/tiles")
                    text.chrom_sizes(parts).write.mode("overwrite").parquet(f"{out}/sizes")
                    discard(parts)
            finally:
                files.delete(lock, False)
        elif time.monotonic() > until:
            raise OSError(f"{out} is being built by another run for too long; remove {out}.lock if there is none")
        else:
            time.sleep(1)
    return spark.read.parquet(f"{out}/tiles"), spark.read.parquet(f"{out}/sizes")


__all__ = ["KEYS", "Result", "aligned_flanks", "build_genome", "detect", "from_alignments", "from_junctions", "settle"]
