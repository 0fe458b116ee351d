"""Command line: one input kind, a reference, and the outputs wanted."""

from __future__ import annotations

import argparse
import sys

from .params import VERSION, Params, Scoring


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="junctura", description="Find spurious splice junctions and filter alignments by them.")
    kind = p.add_mutually_exclusive_group(required=True)
    for k in ("gtf", "bed", "bam"):
        kind.add_argument(f"--{k}")
    p.add_argument("--bed_list", action="store_true", help="the BED argument is a list of paths")
    p.add_argument("--bam_list", action="store_true", help="the BAM argument is a list of paths")
    p.add_argument("-r", "--reference", required=True, help="FASTA file")
    p.add_argument("-i", "--genome_index", "--bowtie2_index", dest="genome_index", help="folder of the tiled genome; built if it is missing")
    p.add_argument("--bt2_k", "--k_hits", dest="k_hits", type=int, default=10)
    p.add_argument("-o", dest="overhang", type=int, default=50)
    p.add_argument("-a", dest="anchor", type=int, default=7)
    p.add_argument("--min_duplicate_exon_length", type=int, default=27)
    p.add_argument("--min_junc_score", type=int, default=1)
    p.add_argument("-A", dest="match", type=int, default=3)
    p.add_argument("-B", dest="mismatch", type=int, default=4)
    for flag in ("-k", "-w"):
        p.add_argument(flag, type=int, help="accepted; the aligner has no minimizers")
    p.add_argument("-m", dest="min_score", type=int, default=25)
    for o in ("original_junctions", "removed_junctions", "kept_junctions", "filtered_bam"):
        p.add_argument(f"--out_{o}")
    p.add_argument("--filtered_bam_suffix", default="_filtered")
    p.add_argument("--removed_alignments_bam", action="store_true")
    p.add_argument("--trusted_bed")
    p.add_argument("-p", dest="threads", type=int, default=1)
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def params(a: argparse.Namespace) -> Params:
    return Params(overhang=a.overhang, anchor=a.anchor, min_duplicate_exon_length=a.min_duplicate_exon_length, min_junc_score=a.min_junc_score, k_hits=a.k_hits, min_score=a.min_score, scoring=Scoring(match=a.match, mismatch=a.mismatch), tile_overlap=max(200, 2 * a.overhang + 100))


def read_alignments(spark, files: list[str]):
    """Alignments of BAM and SAM files by their content, and each file's header and contigs."""
    from .detect import GZIP, magic
    from .sources import bam, text

    heads, found = {}, {}
    for f in files:
        start = magic(f, 4)
        if start == b"CRAM":
            raise ValueError(f"{f} is a CRAM file, which is not supported: convert it to BAM or SAM")
        kind = "bam" if start[:2] == GZIP and not f.endswith(".sam.gz") else "sam"
        found.setdefault(kind, []).append(f)
        if kind == "sam":
            heads[f] = text.sam_header(f)
        else:
            with bam.opened(f) as file:
                heads[f] = bam.header(bam.Stream(file))
    parts = [bam.read_bam(spark, found["bam"])] if "bam" in found else []
    parts += [text.read_sam(spark, found["sam"])] if "sam" in found else []
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows, heads


def reason(e: Exception) -> str:
    """The message of an error, without Spark's traces."""
    import re

    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    told = [m[1] for x in lines if (m := re.match(r"(?:ValueError|OSError|FileNotFoundError|[\w.]*UserRaisedException|java\.lang\.RuntimeException): (.+)", x))]
    return (told or lines or [type(e).__name__])[0]


def main(argv: list[str] | None = None) -> int:
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    try:
        return run(parser().parse_args(argv))
    except (OSError, ValueError, PySparkException, Py4JError) as e:
        print(f"error: {reason(e)}", file=sys.stderr)
        return 1


def run(a: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from . import naming
    from .detect import resolve_inputs
    from .operators import output
    from .operators.junctions import merged
    from .plans import engine
    from .sources import bam, text

    p, files = params(a), [a.gtf]
    kind = "bam" if a.bam else "bed" if a.bed else "gtf"
    if kind != "gtf":
        files = resolve_inputs(a.bam or a.bed, kind, a.bam_list if a.bam else a.bed_list)
    for path in (a.reference, a.trusted_bed, *(files if kind == "gtf" else ())):
        if path and not naming.os.path.exists(path):
            raise FileNotFoundError(f"no input {path}")
    order = None if kind == "gtf" else [naming.sample_name(f) for f in files]
    spark = SparkSession.builder.master(f"local[{a.threads}]").appName("junctura").config("spark.ui.enabled", "false").getOrCreate()
    home = naming.Target(a.out_filtered_bam or "").folder or naming.folder_of(a.reference) or "."
    genome, sizes = engine.build_genome(spark, a.reference, a.genome_index or f"{home}/{naming.genome_name(a.reference)}_tiles", p)
    trusted = text.key_set(text.read_bed(spark, [a.trusted_bed])) if a.trusted_bed else None
    heads: dict = {}
    if kind == "bam":
        rows, heads = read_alignments(spark, files)
        got = engine.from_alignments(engine.settle(rows, "alignments"), genome, sizes, trusted, p=p)
    else:
        found = merged(text.read_bed(spark, files)) if kind == "bed" else text.read_gtf(spark, a.gtf)
        got = engine.from_junctions(found, genome, sizes, trusted, p)
    for table, out in ((got.original, a.out_original_junctions), (got.removed, a.out_removed_junctions or (None if a.out_filtered_bam else "stdout")), (got.kept, a.out_kept_junctions)):
        if not out:
            continue
        # Junction tables are small beside their inputs and come partition by partition.
        lines = (r["value"] + "\n" for r in output.layout(table, kind, order).orderBy("rank").toLocalIterator())
        if out == "stdout":
            sys.stdout.writelines(lines)
        else:
            target = naming.Target(out).files(files, "", ".bed")[0]  # several inputs are one merged table
            naming.os.makedirs(naming.folder_of(target) or ".", exist_ok=True)
            with open(target, "w") as f:
                f.writelines(lines)
    if kind == "bam" and a.out_filtered_bam:
        for file, out in zip(files, naming.Target(a.out_filtered_bam).files(files, a.filtered_bam_suffix, ".bam"), strict=True):
            naming.os.makedirs(naming.folder_of(out) or ".", exist_ok=True)
            mine = got.alignments.where(got.alignments["sample"] == naming.sample_name(file))
            bam.save_bam(mine.where("fate is null"), out, *heads[file])
            if a.removed_alignments_bam:
                bam.save_bam(mine.where("fate is not null"), naming.beside(out, "_removed_alignments", ".bam"), *heads[file])
    return 0


if __name__ == "__main__":
    sys.exit(main())
