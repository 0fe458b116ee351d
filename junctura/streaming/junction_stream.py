"""Junctions from streams of coordinate-sorted alignments: a junction is emitted once every source has passed its end.

State is kept per contig: open junctions with their counts and each source's position. Where the order of the contigs is given, a micro-batch that
carries a source's later contig closes its earlier ones. The end of the streams is a row with `closed` set per source, or flush(), which reads what is
left in the state after the query has ended."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.junctions import events
from ..params import KEYS

OUT = "chrom string, start long, end long, strand string, total_score long"


def progress(alignments: DataFrame) -> DataFrame:
    """Rows for the stateful operator: each alignment's junctions (or none) with its source and position. Input: source, tid, chrom, pos, flag, cigar, xs."""
    from ..functions import columns as C

    mapped = alignments.where(C.is_mapped(F.col("flag")) & F.col("chrom").isNotNull())
    return mapped.select("source", "chrom", "pos", C.strand(F.col("xs")).alias("strand"), F.when(F.col("cigar").contains("N"), C.introns(F.col("pos"), F.col("cigar"))).otherwise(F.array()).alias("introns"), F.coalesce(F.col("closed"), F.lit(False)).alias("closed") if "closed" in alignments.columns else F.lit(False).alias("closed"))


def combined(rows: DataFrame, contigs: list[str] | None = None) -> DataFrame:
    """rows of progress(), combined in each partition before they are shuffled: a row (n = 0) for how far a source has come on a contig and whether it is closed, and one with the count n of each junction.
    Where `contigs` are given, those that lie before the latest one of a source are closed for it. A partition holds some 400,000 junctions at most; beyond that they go out in parts."""
    ordinal = {c: i for i, c in enumerate(contigs or [])}
    kind, junction, most = rows.schema["source"].dataType.simpleString(), ["chrom", "strand", "start", "end"], 1 << 18
    rows = rows.withColumn("j", F.explode_outer("introns")).select("source", "chrom", F.col("pos").cast("long").alias("pos"), "closed", "strand", F.col("j.start").alias("start"), F.col("j.end").alias("end"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        at: dict = {}
        held: list = []
        none = None

        def out(found):
            n = found.num_rows
            shape = {"source": pa.nulls(n, none), "chrom": found["chrom"], "pos": pa.repeat(pa.scalar(0, pa.int64()), n), "closed": pa.repeat(False, n)}
            return pa.table(shape | {c: found[c] for c in ("strand", "start", "end", "n")}).to_batches(max_chunksize=10_000)

        for batch in batches:
            part = pa.Table.from_batches([batch])
            none = part.schema.field("source").type
            seen = part.group_by(["source", "chrom"]).aggregate([("pos", "max"), ("closed", "any")])
            for source, chrom, pos, closed in zip(*[seen[c].to_pylist() for c in ("source", "chrom", "pos_max", "closed_any")], strict=True):
                before = at.get((source, chrom), (0, False))
                at[source, chrom] = max(before[0], pos or 0), before[1] or closed
            found = part.filter(pc.is_valid(part["start"])).group_by(junction).aggregate([([], "count_all")])
            held.append(found.rename_columns([*junction, "n"]))
            if sum(t.num_rows for t in held) > most:
                held = [pa.concat_tables(held).group_by(junction).aggregate([("n", "sum")]).rename_columns([*junction, "n"])]
                if held[0].num_rows > most // 2:
                    yield from out(held.pop())
        if held:
            yield from out(pa.concat_tables(held).group_by(junction).aggregate([("n", "sum")]).rename_columns([*junction, "n"]))
        latest: dict = {}
        for source, chrom in at:
            latest[source] = max(latest.get(source, 0), ordinal.get(chrom, 0))
        for source, last in latest.items():
            at |= {(source, c): (0, True) for c in (contigs or [])[:last]}
        if at:
            n = len(at)
            shape = {"source": pa.array([s for s, _ in at], none), "chrom": pa.array([c for _, c in at]), "pos": pa.array([p for p, _ in at.values()], pa.int64()), "closed": pa.array([c for _, c in at.values()])}
            far = pa.repeat(pa.scalar(-1, pa.int64()), n)
            yield from pa.table(shape | {"strand": pa.repeat(".", n), "start": far, "end": far, "n": pa.repeat(pa.scalar(0, pa.int64()), n)}).to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, f"source {kind}, chrom string, pos long, closed boolean, strand string, start long, end long, n long")


def completed(alignments: DataFrame, sources: int, contigs: list[str] | None = None) -> DataFrame:
    """A streaming DataFrame of completed junctions, each once. A source that is idle holds back what it may still support; a row with `closed` ends a source on that contig, as
    does its first row on a later one of `contigs` (in the order of the streams)."""

    def run(key: tuple, parts: Iterator, state) -> Iterator:
        import pandas as pd

        opened, at = json.loads(state.get[0]) if state.exists else ({}, {})
        for part in parts:
            for source, pos, closed, strand, start, end, n in zip(*[part[c] for c in ("source", "pos", "closed", "strand", "start", "end", "n")], strict=True):
                if n:
                    k = f"{start},{end},{strand}"
                    opened[k] = opened.get(k, 0) + int(n)
                else:
                    at[source] = 1 << 62 if closed else max(at.get(source, 0), int(pos))
        passed = min(at.values()) if len(at) >= sources else -1
        done = [(int(s), int(e), t, n) for (s, e, t), n in ((k.split(","), n) for k, n in opened.items()) if int(e) <= passed]
        for s, e, t, _ in done:
            opened.pop(f"{s},{e},{t}")
        state.update((json.dumps([opened, at]),))
        if done:
            done.sort()
            yield pd.DataFrame({"chrom": key[0], "start": [d[0] for d in done], "end": [d[1] for d in done], "strand": [d[2] for d in done], "total_score": [d[3] for d in done]})

    return combined(progress(alignments), contigs).groupBy("chrom").applyInPandasWithState(run, OUT, "state string", "append", "NoTimeout")


def observed(junctions: DataFrame, name: str | None = None):
    """junctions, and their number and total score as an observation: of a batch once it has run, of a stream (where a name must be given) with each progress report."""
    from pyspark.sql import Observation

    totals = [F.count(F.lit(1)).alias("junctions"), F.coalesce(F.sum("total_score"), F.lit(0)).alias("alignments")]
    if junctions.isStreaming:
        return junctions.observe(name or "junctions", *totals), None
    seen = Observation(name) if name else Observation()
    return junctions.observe(seen, *totals), seen


def flush(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The junctions that a query over completed(), ended and with this checkpoint, has counted and not emitted."""
    state = spark.read.format("statestore").load(checkpoint)
    text = F.get_json_object(F.col("value.groupState.state"), "$[0]")
    left = state.select(F.col("key.chrom").alias("chrom"), F.explode(F.from_json(text, "map<string,long>")).alias("k", "total_score"))
    part = F.split("k", ",")
    return left.select("chrom", part[0].cast("long").alias("start"), part[1].cast("long").alias("end"), part[2].alias("strand"), "total_score")


def completed_in_batch(alignments: DataFrame, sources: int) -> tuple[DataFrame, DataFrame]:
    """What a stream would have emitted over these rows, and what a flush would add: (completed, left)."""
    rows = progress(alignments)
    passed = rows.groupBy("chrom", "source").agg(F.max(F.when(F.col("closed"), F.lit(1 << 62)).otherwise(F.col("pos"))).alias("at")).groupBy("chrom").agg(F.min("at").alias("_passed"), F.count(F.lit(1)).alias("_n"))
    found = events(alignments).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total_score")).join(passed, "chrom")
    done = (F.col("_n") >= sources) & (F.col("end") <= F.col("_passed"))
    return found.where(done).drop("_passed", "_n"), found.where(~done).drop("_passed", "_n")


def detect_each(stream: DataFrame, detect: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True):
    """Runs detection over each micro-batch of completed junctions and appends the spurious ones to `out`; a batch that is run again overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        detect(batch).select(*KEYS, "total_score", "reason").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_alignments_stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet alignments as they arrive, in file order; the rate limit is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
