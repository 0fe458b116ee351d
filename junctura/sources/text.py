"""BED, GTF, SAM and FASTA texts as DataFrames. Lines keep their order as (block, line), which is stable across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..params import DEFAULT, KEYS


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, block, line, value. Gzip is decoded by suffix, and by content where the suffix is missing."""
    plain, hidden = [], []
    for p in paths:
        from ..detect import GZIP, magic

        (hidden if not p.endswith(".gz") and magic(p, 2) == GZIP else plain).append(p)
    parts = []
    if plain:
        text = spark.read.text(plain)
        parts.append(text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"))
    if hidden:

        def unzip(batches):
            import gzip

            import pandas as pd

            for b in batches:
                for path, content in zip(b["path"], b["content"], strict=True):
                    lines = gzip.decompress(bytes(content)).decode("utf-8", "replace").splitlines()
                    yield pd.DataFrame({"path": path, "block": 0, "line": range(len(lines)), "value": lines})

        parts.append(spark.read.format("binaryFile").load(hidden).select("path", "content").mapInPandas(unzip, "path string, block long, line long, value string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_order(lines: DataFrame) -> DataFrame:
    """lines with `at`: a number that grows along each file. A block's first line takes the block's place in bytes, each further line one more, which stays below the next block's place; so only a row a block is gathered, never a file."""
    first = lines.groupBy(F.col("path").alias("_path"), F.col("block").alias("_block")).agg(F.min("line").alias("_first"))
    return lines.join(first, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block"))).withColumn("at", F.col("block") + F.col("line") - F.col("_first")).drop("_path", "_block", "_first")


def with_sample(lines: DataFrame) -> DataFrame:
    name = F.element_at(F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/"), -1)
    return lines.withColumn("sample", F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name))


def _fail(condition, message, value):
    return F.when(condition, F.raise_error(F.concat(F.lit(message), F.col("value")))).otherwise(value)


def parse_bed(lines: DataFrame, dot_score: bool = False) -> DataFrame:
    """lines: sample, block, line, value -> keys, sample, name, score; one row per key and sample, the last line wins. Too few columns, a score that is no number and start > end are errors; dot_score reads "." as 0."""
    text = F.trim(F.regexp_replace("value", r"[\t\r\n\f\v]", " "))
    rows = lines.where((F.length(text) > 0) & ~F.col("value").startswith("#") & ~F.col("value").startswith("track")).withColumn("c", F.split(text, " +"))
    col = lambda i: F.get("c", F.lit(i))
    score = F.when(F.lit(dot_score) & (col(4) == "."), F.lit(0).cast("long")).otherwise(col(4).try_cast("long"))
    start, end = col(1).try_cast("long"), col(2).try_cast("long")
    bad = (F.size("c") < 6) | start.isNull() | end.isNull() | score.isNull()
    rows = rows.select("sample", "block", "line", "value", col(0).alias("chrom"), start.alias("start"), end.alias("end"), C.strand(col(5)).alias("strand"), col(3).alias("name"), score.alias("score"), bad.alias("bad"))
    rows = rows.withColumn("start", _fail(F.col("bad"), "no BED6 record: ", F.col("start"))).withColumn("start", _fail(F.col("start") > F.col("end"), "start beyond end: ", F.col("start")))
    last = F.max_by(F.struct("name", "score"), F.struct("block", "line")).alias("l")
    return rows.groupBy(*KEYS, "sample").agg(last).select(*KEYS, "sample", "l.name", "l.score")


def read_bed(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    return parse_bed(with_sample(read_lines(spark, paths)), **options)


def key_set(bed: DataFrame) -> DataFrame:
    """Trusted or spurious junctions: distinct keys."""
    return bed.select(*KEYS).distinct()


def gtf_attributes(attributes) -> tuple:
    """gene_id and transcript_id of the attribute column; the last of each name wins, null if there is none."""
    tokens = F.transform(F.split(attributes, ";"), lambda t: F.regexp_replace(t, r"^[ \t]+", ""))

    def value(name: str):
        mine = F.filter(tokens, lambda t: t.startswith(name + " "))
        raw = F.get(mine, F.size(mine) - 1)
        return F.regexp_replace(F.regexp_replace(F.substring(raw, len(name) + 2, 1 << 30), '^"', ""), '"$', "")

    return value("gene_id"), value("transcript_id")


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Exons: chrom, start (0-based), end, strand, gene_id, transcript_id, order. Malformed lines are skipped, a missing transcript_id and start > end are errors, a missing gene_id is NA."""
    field = lambda i: F.regexp_extract("value", r"^\s*(\S+)\s+(\S+)\s+(\S+)\s+([0-9]+)\s+([0-9]+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(.*)$", i)
    rows = lines.where(~F.col("value").startswith("#")).select("block", "line", "value", field(1).alias("chrom"), field(3).alias("feature"), field(4).try_cast("long").alias("s"), field(5).try_cast("long").alias("e"), C.strand(field(7)).alias("strand"), field(9).alias("attributes"))
    rows = rows.where((F.col("feature") == "exon") & F.col("s").isNotNull() & F.col("e").isNotNull())
    gene, transcript = gtf_attributes(F.col("attributes"))
    rows = rows.withColumn("gene_id", F.coalesce(F.when(gene != "", gene), F.lit("NA"))).withColumn("transcript_id", transcript)
    rows = rows.withColumn("transcript_id", _fail(F.col("transcript_id").isNull() | (F.col("transcript_id") == ""), "no transcript_id: ", F.col("transcript_id")))
    rows = rows.withColumn("s", _fail(F.col("s") > F.col("e"), "start beyond end: ", F.col("s")))
    return rows.select("chrom", (F.col("s") - 1).alias("start"), F.col("e").alias("end"), "strand", "gene_id", "transcript_id", F.struct("block", "line").alias("order"))


def exon_introns(exons: DataFrame) -> DataFrame:
    """keys, gene_id, transcript_id: gaps between exons of a transcript in (start, end) order; chrom, strand and gene are those of its first line."""
    first = Window.partitionBy("transcript_id").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    along = Window.partitionBy("transcript_id").orderBy("start", "end")
    rows = exons.select("transcript_id", *[F.first(c).over(first).alias(c) for c in ("chrom", "strand", "gene_id")], F.lag("end").over(along).alias("left"), F.col("start").alias("right"))
    return rows.where("left is not null").select("chrom", F.col("left").alias("start"), F.col("right").alias("end"), "strand", "gene_id", "transcript_id")


def gtf_junctions(exons: DataFrame) -> DataFrame:
    """keys, gene_id (of the smallest transcript), transcript_ids (sorted)."""
    got = exon_introns(exons).groupBy(*KEYS).agg(F.min_by("gene_id", "transcript_id").alias("gene_id"), F.sort_array(F.collect_list("transcript_id")).alias("transcript_ids"))
    return got.withColumn("total_score", F.lit(0).cast("long"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return gtf_junctions(parse_gtf(read_lines(spark, [path])))


def parse_sam(lines: DataFrame, contigs: list[str] | None = None) -> DataFrame:
    """sample, at (grows along the file), value -> alignments with the columns of BAM files. contigs: their names in header order, for tid and mtid (null without)."""
    from .bam import packed_quality, packed_tags

    c = F.split("value", "\t")
    tags = F.slice(c, 12, 10_000)
    tag = lambda name: F.substring(F.get(F.filter(tags, lambda t: t.startswith(name)), F.lit(0)), len(name) + 1, 1 << 20)
    rows = lines.where(~F.col("value").startswith("@") & (F.length("value") > 0))
    chrom = F.when(c[2] != "*", c[2])
    mate = F.when(c[6] == "=", chrom).when(c[6] != "*", c[6])
    ordinal = F.create_map(*[F.lit(x) for i, name in enumerate(contigs) for x in (name, i)]) if contigs else None
    number = lambda x: F.lit(None).cast("int") if ordinal is None else F.coalesce(F.get(F.map_values(F.map_filter(ordinal, lambda k, v: k == x)), F.lit(0)), F.lit(-1))
    return rows.select(
        "sample", F.col("at").alias("file_ord"), c[0].alias("qname"), c[1].cast("int").alias("flag"), number(chrom).alias("tid"), chrom.alias("chrom"),
        (c[3].cast("long") - 1).alias("pos"), c[4].cast("int").alias("mapq"), number(mate).alias("mtid"), (c[7].cast("long") - 1).alias("mpos"), c[8].cast("long").alias("tlen"), c[5].alias("cigar"),
        tag("XS:A:").alias("xs"), tag("NH:i:").cast("int").alias("nh"), tag("YC:i:").cast("int").alias("yc"),
        F.when(c[9] == "*", F.lit("")).otherwise(c[9]).alias("seq"), packed_quality(c[10]).alias("qual"), packed_tags(F.array_join(tags, "\t")).alias("tags"),
    )


def sam_header(path: str) -> tuple[str, list[tuple[str, int]]]:
    """The header's text and its contigs with their lengths; read on the driver, as headers are small."""
    import gzip

    from ..detect import GZIP, magic

    kept = []
    with (gzip.open if magic(path, 2) == GZIP else open)(path, "rt") as f:
        for line in f:
            if not line.startswith("@"):
                break
            kept.append(line)
    fields = [dict(x.split(":", 1) for x in line.rstrip("\n").split("\t")[1:]) for line in kept if line.startswith("@SQ")]
    return "".join(kept), [(x["SN"], int(x["LN"])) for x in fields]


def read_sam(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Alignments of SAM files, each with its own header."""
    out: DataFrame | None = None
    for path in paths:
        got = parse_sam(with_sample(file_order(read_lines(spark, [path]))), [name for name, _ in sam_header(path)[1]])
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no SAM file is given")
    return out


def probe_hits(sam_lines: DataFrame) -> DataFrame:
    """SAM text of an external aligner over named probes -> keys, type, hits (unmapped lines don't count)."""
    c = F.split("value", "\t")
    name = F.split(c[0], ",")
    rows = sam_lines.where(~F.col("value").startswith("@") & (F.length("value") > 0)).where(c[1].cast("int").bitwiseAND(F.lit(4)) == 0)
    rows = rows.select(name[0].alias("chrom"), name[1].cast("long").alias("start"), name[2].cast("long").alias("end"), name[3].alias("strand"), name[4].alias("type"))
    return rows.groupBy(*KEYS, "type").agg(F.count(F.lit(1)).alias("hits"))


def parse_fasta(lines: DataFrame) -> DataFrame:
    """lines: path, block, line, value -> chrom, at (0-based), part: the sequence lines, upper-cased, with their places. Each block of a file is numbered alone; what a block begins with (its contig, and how much of it there is before) comes from a table of a row a block and contig."""
    head = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S+)", 1))
    along = Window.partitionBy("path", "block").orderBy("line")
    rows = lines.select("path", "block", "line", "value", F.last(head, ignorenulls=True).over(along).alias("_own"))
    blocks = rows.groupBy("path", "block").agg(F.max_by("_own", "line").alias("_last"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    part = F.upper(F.trim("value"))
    rows = rows.where(~F.col("value").startswith(">") & (F.length(F.trim("value")) > 0)).join(blocks, ["path", "block"])
    rows = rows.select("path", "block", "line", F.coalesce("_own", "_carried").alias("chrom"), part.alias("part"))
    sums = rows.groupBy("path", "block", "chrom").agg(F.sum(F.length("part")).alias("_n"))
    ahead = Window.partitionBy("path", "chrom").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("path", "block", "chrom", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = Window.partitionBy("path", "block", "chrom").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(F.length("part")).over(within), F.lit(0)))
    rows = rows.join(sums.select(*[F.col(c).alias(f"_{c}") for c in ("path", "block", "chrom")], "_before"), (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")) & F.col("chrom").eqNullSafe(F.col("_chrom")))
    return rows.select("chrom", (F.col("_before") + F.col("_in")).cast("long").alias("at"), "part")


def tiles(parts: DataFrame, tile: int = DEFAULT.tile, overlap: int = DEFAULT.tile_overlap) -> DataFrame:
    """chrom, at, part -> chrom, tile, seq: fixed tiles of the genome, each with `overlap` characters of what follows, so that a short fetch meets one tile."""
    a, n = F.col("at"), F.length("part")
    # A part belongs to every tile [t * tile, (t + 1) * tile + overlap) that it meets.
    low = F.greatest(F.lit(0), F.floor((a - overlap) / tile))
    rows = parts.where(n > 0).withColumn("tile", F.explode(F.sequence(low, F.floor((a + n - 1) / tile))))
    start, end = F.greatest(a, F.col("tile") * tile), F.least(a + n, F.col("tile") * tile + tile + overlap)
    rows = rows.where(start < end).select("chrom", "tile", start.alias("s"), F.substring("part", (start - a + 1).cast("int"), (end - start).cast("int")).alias("p"))
    got = rows.groupBy("chrom", "tile").agg(F.sort_array(F.collect_list(F.struct("s", "p"))).alias("ps"))
    return got.select("chrom", "tile", F.array_join(F.transform("ps", lambda x: x["p"]), "").alias("seq"))


def chrom_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("chrom").agg(F.sum(F.length("part")).cast("long").alias("length"))


def read_genome(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Tiles and contig sizes of a FASTA file."""
    parts = parse_fasta(read_lines(spark, [path]))
    return tiles(parts, **options), chrom_sizes(parts)


def mask(parts: DataFrame, intervals: DataFrame, width: int = 100_000) -> DataFrame:
    """Sequence parts with N in the given intervals (chrom, start, end; 0-based, half-open): an equi-join on bins of `width`, then one fold over a part's intervals."""
    parts = parts.withColumn("_z", F.col("at") + F.length("part"))
    reach = lambda a, z: F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(z), F.col(a) + 1) - 1) / width))
    left = parts.select("chrom", "at", "_z", F.explode(reach("at", "_z")).alias("_bin"))
    holes = intervals.where("start < end").select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")).withColumn("_b", F.explode(reach("_s", "_e")))
    met = left.join(holes, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & (F.col("at") < F.col("_e")) & (F.col("_s") < F.col("_z")))
    found = met.groupBy(F.col("chrom").alias("_pc"), F.col("at").alias("_pa")).agg(F.collect_set(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"))).alias("ms"))
    rows = parts.join(found, (F.col("chrom") == F.col("_pc")) & (F.col("at") == F.col("_pa")), "left")

    def cover(seq, m):
        a, b = F.greatest(m["s"] - F.col("at"), F.lit(0)).cast("int"), F.least(m["e"] - F.col("at"), F.length("part")).cast("int")
        return F.concat(F.left(seq, a), F.repeat(F.lit("N"), b - a), F.substring(seq, b + 1, F.length("part")))

    return rows.select("chrom", "at", F.when(F.col("ms").isNull(), F.col("part")).otherwise(F.aggregate("ms", F.col("part"), cover)).alias("part"))
