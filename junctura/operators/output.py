"""Junction tables as text rows. Junction tables are far smaller than alignments; only their numbering needs one order, which range-partitioned counting gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import KEYS
from ..shared import cut


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rank (from 1, in the given order) and _all, their number: range-partitioned, written once, counted per partition, each partition numbered from its offset, so that no task holds more than a partition."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    parts = placed.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.orderBy("_p")  # a row a partition
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    got = placed.withColumn("_in", within).join(parts.select("_p", before.alias("_before"), every.alias("_all")), F.col("_part") == F.col("_p"))
    return got.withColumn("rank", F.col("_before") + F.col("_in")).drop("_in", "_part", "_p", "_before")


def numbered(junctions: DataFrame, digits: int | None = None) -> DataFrame:
    """junctions with rank (from 1, by key) and name "JUNC" and the rank, padded to `digits` or to the digits of their number (0: not padded)."""
    rows = ranked(junctions, KEYS)
    number = F.col("rank").cast("string")
    width = F.length(F.col("_all").cast("string")) if digits is None else F.lit(digits)
    return rows.withColumn("name", F.concat(F.lit("JUNC"), F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, F.lit("0"))))).drop("_all")


def ordered_samples(samples: Column, order: list[str] | None) -> Column:
    """Samples in the given order, unknown ones last and by name."""
    if not order:
        return F.array_sort(samples)
    place = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), s["sample"]), F.lit(0).cast("long")), F.lit(1 << 40))
    keyed = F.transform(samples, lambda s: F.struct(place(s).alias("p"), s["sample"].alias("sample"), s["score"].alias("score")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["sample"].alias("sample"), s["score"].alias("score")))


def layout(junctions: DataFrame, kind: str, order: list[str] | None = None) -> DataFrame:
    """rank and the text columns of one row a junction; kind "bam", "bed" or "gtf"."""
    rows = numbered(junctions)
    score = F.coalesce(F.col("align_score"), F.lit(0)).cast("string") if "align_score" in junctions.columns else F.lit("0")
    key = [F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("name")]
    if kind == "gtf":
        cols = [*key, F.lit("."), F.col("strand"), score, F.concat_ws(";", F.col("gene_id"), F.array_join("transcript_ids", ";"))]
    else:
        pair = (lambda s: F.concat(s["sample"], F.lit(","), s["score"].cast("string"))) if kind == "bed" else (lambda s: F.concat(s["score"].cast("string"), F.lit(","), s["sample"]))
        listed = F.array_join(F.transform(ordered_samples(F.col("samples"), order), pair), ";")
        cols = [*key, F.col("total_score").cast("string"), F.col("strand"), *([score] if kind == "bam" else []), listed]
    return rows.select("rank", F.concat_ws("\t", *cols).alias("value"))


def by_sample(junctions: DataFrame) -> DataFrame:
    """A BED7 row for each junction and sample, numbered over all junctions: sample, rank, value."""
    rows = numbered(junctions).withColumn("_s", F.explode("samples"))
    score = F.coalesce(F.col("align_score"), F.lit(0)) if "align_score" in junctions.columns else F.lit(0)
    return rows.select(F.col("_s.sample").alias("sample"), "rank", F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "name", F.col("_s.score").cast("string"), "strand", score.cast("string")).alias("value"))


def bed6(junctions: DataFrame, digits: int = 0) -> DataFrame:
    rows = numbered(junctions, digits)
    return rows.select("rank", F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "name", F.col("total_score").cast("string"), "strand").alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    """rows: rank, value -> text files whose names sort in rank order; no task holds all rows."""
    rows.repartitionByRange("rank").sortWithinPartitions("rank").select("value").write.mode("overwrite").text(path)


def write_by_sample(rows: DataFrame, path: str) -> None:
    rows.repartition("sample").sortWithinPartitions("sample", "rank").select("sample", "value").write.mode("overwrite").partitionBy("sample").text(path)


__all__ = ["KEYS", "bed6", "by_sample", "layout", "numbered", "ordered_samples", "ranked", "write_by_sample", "write_text"]
