"""One query per operator over genomic-shaped views of the given tables, and the same in DuckDB's SQL.

The views: alignments, pairs of alignments and exons from lineitem, contigs and junctions on them from documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions.aligner import align
from .operators import filtering, junctions as J, output, spurious as S
from .params import KEYS
from .plans import engine
from .shared import cut, fresh_path
from .sources import text
from .streaming import junction_stream as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# SQL that both engines run.
_ORD = "(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 2"
ALN = f"""select l_linestatus as sample, {_ORD} as file_ord, concat('r', l_orderkey) as qname, case when l_partkey % 11 = 0 then 4 else 0 end as flag, l_linenumber as tid,
 concat('chr', l_linenumber) as chrom, (l_partkey % 50) * 100 as pos, concat('20M', 50 + l_suppkey % 5, 'N2I10M', case when l_quantity > 25 then '3D5M30N7M' else '' end) as cigar,
 case l_returnflag when 'R' then '+' when 'A' then '-' else '?' end as xs, cast(l_suppkey % 4 as int) as yc from lineitem"""
PAIR = f"""select 's' as sample, {_ORD} + s - 1 as file_ord, concat('r', l_orderkey) as qname, case when s = 1 then 65 else 129 end as flag, concat('chr', l_linenumber % 2) as chrom,
 (l_orderkey % 100) * 1000 + (s - 1) * 200 as pos, (l_orderkey % 100) * 1000 + (2 - s) * 200 as mpos, case when s = 1 then concat('20M', 50 + l_suppkey % 5, 'N20M') else '40M' end as cigar,
 cast(3 + l_suppkey % 4 as int) as nh, cast(300 as bigint) as tlen, '.' as xs from lineitem, (select 1 as s union all select 2 as s) t"""
EXON = f"""select concat('chr', l_linenumber % 3) as chrom, (l_partkey % 500) * 10 as start, (l_partkey % 500) * 10 + 30 + l_suppkey % 40 as "end", case when l_suppkey % 2 = 0 then '+' else '-' end as strand,
 concat('g', l_suppkey % 10) as gene_id, concat('t', l_orderkey) as transcript_id, {_ORD} as o from lineitem"""
CLEAN = """select concat('d', doc_id) as chrom, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', ''{g}) as seq from documents"""
CONTIG = """select concat('d', doc_id) as chrom, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', 'N'{g}) as seq from documents"""
DOCJ = """select chrom, n {div} 3 as start, n {div} 3 + 20 + n % 400 as "end", case when n % 3 = 0 then '+' when n % 3 = 1 then '-' else '.' end as strand, cast(n % 4 as bigint) as total_score, n from (select chrom, length(seq) as n from contigs) t where n > 40"""
HITS = """select concat('c', l_orderkey) as chrom, file_ord as start, file_ord + 30 + l_partkey % 160 as "end", '+' as strand, cast(l_partkey % 70 as int) as r_st, cast(l_partkey % 70 + 15 + l_suppkey % 60 as int) as r_en,
 cast(l_suppkey % 71 as int) as q_st, cast(l_suppkey % 71 + 15 + l_partkey % 60 as int) as q_en, l_partkey % 13 as c1, l_suppkey % 13 as c2, l_orderkey % 3 as ch,
 left(repeat(case l_partkey % 4 when 0 then 'ACGTTGCA' when 1 then 'ACGTTGCC' when 2 then 'TTGACCAG' else 'ACGATGCA' end, 13), cast(100 - 50 * (case when l_linenumber = 7 then 1 else 0 end) as int)) as rseq,
 left(repeat(case l_suppkey % 3 when 0 then 'ACGTTGCA' when 1 then 'ACGTTGGA' else 'GGCATCAA' end, 13), 100) as qseq from (select *, {ord} as file_ord from lineitem) t""".replace("{ord}", _ORD)


def _sql(spark: SparkSession, sf_dir: str, sql: str, **views: str) -> DataFrame:
    """Runs a view's SQL over the tables it names."""
    for name in ("lineitem", "documents", "orders", "nation"):
        if f" {name}" in sql:
            sql = sql.replace(f"from {name}", "from {" + name + "}")
            views[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(sql.replace('"end"', "end").replace("{div}", "div"), **views)


def alignments(spark, sf_dir):
    return _sql(spark, sf_dir, ALN)


def pairs(spark, sf_dir):
    return _sql(spark, sf_dir, PAIR)


def contigs(spark, sf_dir):
    return _sql(spark, sf_dir, CONTIG.replace("{g}", ""))


def clean_contigs(spark, sf_dir):
    """Contigs without unknown characters."""
    return _sql(spark, sf_dir, CLEAN.replace("{g}", ""))


def genome(spark, sf_dir, of=contigs):
    parts = of(spark, sf_dir).select("chrom", F.lit(0).cast("long").alias("at"), F.col("seq").alias("part"))
    return text.tiles(parts), text.chrom_sizes(parts)


def doc_junctions(spark, sf_dir, of=contigs):
    return spark.sql(DOCJ.replace('"end"', "end").replace("{div}", "div").replace("from contigs", "from {contigs}"), contigs=of(spark, sf_dir)).drop("n")


def doc_flanks(spark, sf_dir, of=contigs):
    """Junctions, tiles and sizes of contigs, which are made once."""
    made = cut(of(spark, sf_dir), "contigs")
    once = lambda *_: made
    return doc_junctions(spark, sf_dir, once), *genome(spark, sf_dir, once)


def exons(spark, sf_dir):
    return _sql(spark, sf_dir, EXON).withColumnRenamed("o", "order")


def hits(spark, sf_dir):
    rows = _sql(spark, sf_dir, HITS)
    hit = F.struct(*["r_st", "r_en", "q_st", "q_en"])
    return rows.select(*KEYS, hit.alias("hit"), "rseq", "qseq", F.col("c1").alias("seq1_count"), F.col("c2").alias("seq2_count"), F.col("ch").alias("seqh_count"))


def bed_lines(spark, sf_dir):
    value = F.concat_ws("\t", "chrom", "pos", F.col("pos") + 60 + F.col("yc"), F.concat(F.lit("n"), F.col("qname")), F.col("yc") + 1, "xs")
    return alignments(spark, sf_dir).select("sample", F.lit(0).alias("block"), F.col("file_ord").alias("line"), value.alias("value"))


def text_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("rank").cast("long").alias("rank"), "value")


# The same as common table expressions of DuckDB.
_ALN = f"aln as ({ALN})"
_CONTIG = "contigs as (" + CONTIG.replace("{g}", ", 'g'") + ")"
_OPS = """ops as (select *, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=XB]')) as op, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=XB]'), 1) as i from aln where flag & 4 = 0),
steps as (select *, cast(op[:-2] as bigint) as n, op[-1] as kind from ops),
walk as (select *, pos + coalesce(sum(case when kind in ('M','D','N','=','X') then n else 0 end) over (partition by file_ord order by i rows between unbounded preceding and 1 preceding), 0) as ref_at from steps),
ev as (select sample, file_ord, chrom, cast(ref_at as bigint) as start, cast(ref_at + n as bigint) as "end", case when xs in ('+', '-') then xs else '.' end as strand, yc from walk where kind = 'N'),
per as (select chrom, start, "end", strand, sample, count(*) as score from ev group by all),
junc as (select chrom, start, "end", strand, cast(sum(score) as bigint) as total_score, string_agg(concat(sample, ',', score), ';' order by sample) as samples, string_agg(concat(score, ',', sample), ';' order by sample) as pairs from per group by chrom, start, "end", strand)"""
_J = f"with {_ALN}, {_OPS}"
_TRUSTED = "trusted as (select distinct chrom, start, \"end\", strand from junc where start % 300 = 120)"
_NAMED = """named as (select *, concat('JUNC', lpad(cast(rank as varchar), cast(length(cast(count(*) over () as varchar)) as int), '0')) as name from (select *, row_number() over (order by chrom, start, "end", strand) as rank from junc))"""
_BED = f"""with {_ALN}, lines as (select chrom, pos as start, pos + 60 + yc as "end", case when xs in ('+', '-') then xs else '.' end as strand, sample, concat('n', qname) as name, yc + 1 as score, file_ord from aln),
bed as (select * from (select *, row_number() over (partition by chrom, start, "end", strand, sample order by file_ord desc) as k from lines) where k = 1)"""
_PAIR = f"aln as ({PAIR})"
_PEV = """bad as (select * from aln where cigar like '%N%' and cast(regexp_extract(cigar, '20M([0-9]+)N', 1) as int) in (50, 53)),
removed as (select distinct qname, chrom, pos, mpos, cigar from bad),
quota as (select qname, chrom, pos, mpos, count(*) as q from bad group by all),
h as (select a.*, r.qname is not null as hit from aln a left join removed r on a.qname = r.qname and a.chrom = r.chrom and a.pos = r.pos and a.mpos = r.mpos and a.cigar = r.cigar),
m as (select h.*, q.q, not hit and flag & 1 = 1 and q.q is not null as asks from h left join quota q on h.qname = q.qname and h.chrom = q.chrom and h.mpos = q.pos and h.pos = q.mpos),
t as (select *, asks and row_number() over (partition by qname, chrom, mpos, pos, asks order by file_ord) <= q as within from m),
adj as (select qname, case when flag & 64 <> 0 then 1 when flag & 128 <> 0 then 2 else 0 end as po, count(*) as less from bad group by all)"""
_SPUR = "select distinct chrom, start, \"end\", strand from pev where \"end\" - start in (50, 53)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Sources.
@query(f"{_BED} select chrom, start, \"end\", strand, sample, name, cast(score as bigint) as score from bed")
def bed_parse_last_wins(spark, sf_dir):
    return text.parse_bed(bed_lines(spark, sf_dir))


@query(f"{_BED} select chrom, start, \"end\", strand, cast(sum(score) as bigint) as total_score, string_agg(concat(sample, ',', score), ';' order by sample) as samples from bed group by chrom, start, \"end\", strand")
def bed_multi_merge(spark, sf_dir):
    got = J.merged(text.parse_bed(bed_lines(spark, sf_dir)))
    return got.withColumn("samples", F.array_join(F.transform("samples", lambda s: F.concat(s["sample"], F.lit(","), s["score"].cast("string"))), ";"))


_ATTR = """concat('gene_id "g', o_custkey % 10, '"; transcript_id "t', o_orderkey, '"; note "x y"', case when o_orderkey % 3 = 0 then concat('; gene_id "h', o_custkey % 7, '";') else '' end)"""


@query("select o_orderkey, case when o_orderkey % 3 = 0 then concat('h', o_custkey % 7) else concat('g', o_custkey % 10) end as gene_id, concat('t', o_orderkey) as transcript_id from orders")
def gtf_attributes(spark, sf_dir):
    rows = _sql(spark, sf_dir, f"select o_orderkey, {_ATTR} as a from orders")
    gene, transcript = text.gtf_attributes(F.col("a"))
    return rows.select("o_orderkey", gene.alias("gene_id"), transcript.alias("transcript_id"))


_INTRON = f"""with e as ({EXON}), f as (select transcript_id, first_value(chrom) over w as chrom, first_value(strand) over w as strand, first_value(gene_id) over w as gene_id,
 lag("end") over (partition by transcript_id order by start, "end") as l, start as r from e window w as (partition by transcript_id order by o)),
introns as (select chrom, l as start, r as "end", strand, gene_id, transcript_id from f where l is not null)"""


@query(f"{_INTRON} select * from introns")
def gtf_introns(spark, sf_dir):
    return text.exon_introns(exons(spark, sf_dir))


@query(f"{_INTRON} select chrom, start, \"end\", strand, arg_min(gene_id, transcript_id) as gene_id, string_agg(transcript_id, ';' order by transcript_id) as transcript_ids, cast(0 as bigint) as total_score from introns group by chrom, start, \"end\", strand")
def gtf_junctions(spark, sf_dir):
    return text.gtf_junctions(exons(spark, sf_dir)).withColumn("transcript_ids", F.array_join("transcript_ids", ";"))


@query(f"with {_CONTIG} select chrom, cast(length(seq) as bigint) as length from contigs where length(seq) > 0")
def chrom_sizes(spark, sf_dir):
    return genome(spark, sf_dir)[1]


@query(f"with {_CONTIG} select chrom, cast(u as bigint) as tile, md5(substr(seq, cast(u * 1000 + 1 as bigint), 1200)) as seq_md5 from (select *, unnest(range((length(seq) - 1) // 1000 + 1)) as u from contigs where length(seq) > 0)")
def genome_tiles(spark, sf_dir):
    return genome(spark, sf_dir)[0].select("chrom", F.col("tile").cast("long").alias("tile"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query(f"with {_CONTIG} select chrom, md5(concat(substr(seq, 1, length(seq) // 4), repeat('N', least(37, length(seq) - length(seq) // 4)), substr(seq, length(seq) // 4 + 38))) as seq_md5 from contigs")
def par_mask(spark, sf_dir):
    parts = contigs(spark, sf_dir).select("chrom", F.lit(0).cast("long").alias("at"), F.col("seq").alias("part"))
    holes = parts.select("chrom", F.floor(F.length("part") / 4).alias("start"), (F.floor(F.length("part") / 4) + 37).alias("end"))
    return text.mask(parts, holes).select("chrom", F.md5(F.col("part").cast("binary")).alias("seq_md5"))


# Alignments to junctions.
@query(f"{_J} select sample, file_ord, chrom, start, \"end\", strand from ev")
def cigar_ops(spark, sf_dir):
    return J.events(alignments(spark, sf_dir)).select("sample", "file_ord", *KEYS)


@query(f"{_J} select * from per")
def junction_counts(spark, sf_dir):
    return J.counts(alignments(spark, sf_dir))


@query(f"{_J} select chrom, start, \"end\", strand, sample, cast(sum(greatest(yc, 1)) as bigint) as score from ev group by all")
def junction_counts_yc(spark, sf_dir):
    return J.counts(alignments(spark, sf_dir), "yc")


@query(f"""{_J}, py as (select chrom, start, "end", strand, sample, sum(greatest(yc, 1)) as score from ev group by all)
select chrom, start, "end", strand, cast(sum(score) as bigint) as total_score, string_agg(concat(sample, ',', score), ';' order by sample) as samples from py group by chrom, start, "end", strand""")
def junction_samples_yc(spark, sf_dir):
    return J.merged(J.counts(alignments(spark, sf_dir), "yc")).withColumn("samples", _joined())


@query(f"{_J} select sample, file_ord, chrom, start, \"end\", strand from ev where chrom <> 'chr3'")
def named_contigs(spark, sf_dir):
    """Alignments without a contig have no junctions."""
    rows = alignments(spark, sf_dir).withColumn("chrom", F.nullif(F.col("chrom"), F.lit("chr3")))
    return J.events(rows).select("sample", "file_ord", *KEYS)


@query(f"{_BED} select distinct chrom, start, \"end\", strand from bed")
def trusted_keys(spark, sf_dir):
    return text.key_set(text.parse_bed(bed_lines(spark, sf_dir)))


@query(f"with {_ALN} select qname as chrom, pos as start, pos + 30 as \"end\", case when yc = 0 then '+' else '-' end as strand, concat('seq', yc % 2 + 1) as type, count(*) as hits from aln where flag & 4 = 0 group by all")
def external_probe_hits(spark, sf_dir):
    """SAM lines of an external aligner over named probes."""
    name = F.concat_ws(",", "qname", F.col("pos").cast("string"), (F.col("pos") + 30).cast("string"), F.when(F.col("yc") == 0, "+").otherwise("-"), F.concat(F.lit("seq"), (F.col("yc") % 2 + 1).cast("string")))
    lines = alignments(spark, sf_dir).select(F.concat_ws("\t", name, F.col("flag").cast("string"), "chrom", F.lit("1"), F.lit("9"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*")).alias("value"))
    return text.probe_hits(lines)


def _joined(samples: str = "samples"):
    return F.array_join(F.transform(samples, lambda s: F.concat(s["sample"], F.lit(","), s["score"].cast("string"))), ";")


@query(f"{_J} select chrom, start, \"end\", strand, total_score, samples from junc")
def junction_samples(spark, sf_dir):
    return J.merged(J.counts(alignments(spark, sf_dir))).withColumn("samples", _joined())


@query(f"{_J} select chrom, start, \"end\", strand, total_score * 2 as total_score, concat(samples, ';', samples) as samples from junc")
def junction_append(spark, sf_dir):
    got = J.merged(J.counts(alignments(spark, sf_dir)))
    return J.append_samples(got, got).withColumn("samples", _joined())


def _junctions(spark, sf_dir):
    return J.merged(J.counts(alignments(spark, sf_dir)))


@query(f"{_J}, {_TRUSTED} select chrom, start, \"end\", strand, total_score from junc anti join trusted using (chrom, start, \"end\", strand)")
def trusted_anti(spark, sf_dir):
    got = _junctions(spark, sf_dir)
    return J.without(got, got.where("start % 300 = 120")).select(*KEYS, "total_score")


@query(f"{_J} select chrom, start, \"end\", strand, total_score from junc where not (total_score <= 3)")
def kept_junctions(spark, sf_dir):
    got = _junctions(spark, sf_dir)
    return J.without(got, got.where("total_score <= 3")).select(*KEYS, "total_score")


@query(f"{_J} select chrom, start, \"end\", strand, total_score, case when total_score <= 3 then 'low score' else 'searched' end as branch from junc")
def low_score_split(spark, sf_dir):
    got, low = _junctions(spark, sf_dir).select(*KEYS, "total_score"), F.col("total_score") <= 3
    return got.where(low).withColumn("branch", F.lit("low score")).unionByName(got.where(~low).withColumn("branch", F.lit("searched")))


_REFLEN = "reflen as (select file_ord, sum(case when kind in ('M','D','N','=','X') then n else 0 end) as len from steps group by file_ord)"
_REG = "regions as (select n_nationkey as region, concat('chr', n_nationkey % 7 + 1) as chrom, n_nationkey * 200 as start, n_nationkey * 200 + 450 as \"end\" from nation)"


@query(f"{_J}, {_REFLEN}, {_REG} select r.region, count(*) as n from aln a join reflen using (file_ord) join regions r on a.chrom = r.chrom and a.pos < r.\"end\" and r.start < a.pos + greatest(len, 1) group by r.region")
def region_range_join(spark, sf_dir):
    regions = _sql(spark, sf_dir, "select n_nationkey as region, concat('chr', n_nationkey % 7 + 1) as chrom, n_nationkey * 200 as start, n_nationkey * 200 + 450 as end from nation")
    reads = alignments(spark, sf_dir).where("flag & 4 = 0")
    return J.overlap_join(reads, regions, 1000).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_J}, {_REFLEN} select chrom, start, \"end\", strand, sample, count(*) as score from ev where file_ord in (select a.file_ord from aln a join reflen using (file_ord) where a.chrom = 'chr2' and pos < 2500 and pos + len > 1000) group by all")
def region_scan(spark, sf_dir):
    return J.region_counts(alignments(spark, sf_dir), "chr2:1001-2500")


@query(f"with {_ALN} select chrom, cast(pos // 1000 as bigint) as tile, count(*) as n from aln where flag & 4 = 0 group by all")
def tile_count(spark, sf_dir):
    rows = alignments(spark, sf_dir).where(C.is_mapped(F.col("flag")))
    return J.by_tile(rows, 1000).groupBy("chrom", F.col("tile").cast("long").alias("tile")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_ALN} select tid, pos, sample as file_idx, file_ord from aln")
def merge_order(spark, sf_dir):
    return J.merge_order(alignments(spark, sf_dir).select("tid", "pos", F.col("sample").alias("file_idx"), "file_ord"))


@query(f"{_J}, passed as (select chrom, min(m) as p, count(*) as k from (select chrom, sample, max(pos) as m from aln where flag & 4 = 0 group by all) group by chrom) select j.chrom, start, \"end\", strand, total_score from junc j join passed using (chrom) where k >= 2 and \"end\" <= p")
def completed_junctions(spark, sf_dir):
    rows = alignments(spark, sf_dir).withColumn("source", F.col("sample"))
    return stream.completed_in_batch(rows, 2)[0].select(*KEYS, "total_score")


@query(ORACLE["completed_junctions"])
def completed_junctions_stream(spark, sf_dir):
    from pyspark.errors import AnalysisException

    base = fresh_path(spark, "stream")
    lines = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema).parquet(f"{sf_dir}/lineitem.parquet*")
    rows = spark.sql(ALN.replace("from lineitem", "from {lineitem}"), lineitem=lines).withColumn("source", F.col("sample"))
    run = stream.completed(rows, 2).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    run.awaitTermination()
    try:
        return spark.read.parquet(f"{base}/out").select(*KEYS, "total_score")
    except AnalysisException:
        return spark.createDataFrame([], stream.OUT)


@query(f"{_J} select chrom, start, \"end\", strand, total_score from junc")
def all_junctions_stream(spark, sf_dir):
    """What completes, by position or by later contigs, and what the end of the streams leaves."""
    base = fresh_path(spark, "stream")
    lines = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema).parquet(f"{sf_dir}/lineitem.parquet*")
    rows = spark.sql(ALN.replace("from lineitem", "from {lineitem}"), lineitem=lines).withColumn("source", F.col("sample"))
    contigs = [r.chrom for r in alignments(spark, sf_dir).select("tid", "chrom").distinct().orderBy("tid").collect()]
    stream.completed(rows, 2, contigs).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.OUT).parquet(f"{base}/out").unionByName(stream.flush(spark, f"{base}/check")).select(*KEYS, "total_score")


@query(f"{_J} select chrom, start, \"end\", strand, total_score from junc")
def junctions_over_batches(spark, sf_dir):
    """The same over several micro-batches of sorted files: a source that has no alignments on a contig, contigs that later ones close, and a flush."""
    base = fresh_path(spark, "stream")
    rows = cut(alignments(spark, sf_dir).withColumn("source", F.col("sample")), "sorted")
    contigs = [r.chrom for r in rows.select("tid", "chrom").distinct().orderBy("tid").collect()]
    for low, high in ((0, 2), (2, 3), (3, 5), (5, 99)):
        # A file a task, each sorted; all that has arrived makes one micro-batch.
        rows.where((F.col("tid") > low) & (F.col("tid") <= high)).sortWithinPartitions("tid", "pos").write.mode("append").parquet(f"{base}/in")
        arriving = stream.read_alignments_stream(spark, f"{base}/in", rows.schema, 1 << 30)
        stream.completed(arriving, 2, contigs).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.OUT).parquet(f"{base}/out").unionByName(stream.flush(spark, f"{base}/check")).select(*KEYS, "total_score")


@query(f"{_J} select count(*) as junctions, cast(sum(total_score) as bigint) as alignments from junc")
def observed_totals(spark, sf_dir):
    """Totals that are observed while the junctions pass."""
    rows, totals = stream.observed(_junctions(spark, sf_dir))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(totals.get["junctions"], totals.get["alignments"])], "junctions long, alignments long")


# Flanks, probes, rules.
_DOCJ = f"with {_CONTIG}, dj as ({DOCJ.replace('{div}', '//')})"
_FLANK = """fl as (select *, greatest(start - 49, 1) as rstart, least(start + 50, n) as rend, greatest("end" - 49, 1) as qstart, least("end" + 50, n) as qend from dj where greatest(start - 49, 1) <= n and greatest("end" - 49, 1) <= n),
fs as (select fl.*, substr(seq, rstart, rend - rstart + 1) as rseq, substr(seq, qstart, qend - qstart + 1) as qseq from fl join contigs using (chrom))"""


@query(f"{_DOCJ}, {_FLANK} select chrom, start, \"end\", strand, total_score, cast(rstart as bigint) as rstart, cast(rend as bigint) as rend, cast(qstart as bigint) as qstart, cast(qend as bigint) as qend from fl")
def flank_regions(spark, sf_dir):
    got = S.flank_regions(doc_junctions(spark, sf_dir), genome(spark, sf_dir)[1])
    return got.select(*KEYS, "total_score", *[F.col(c).cast("long").alias(c) for c in ("rstart", "rend", "qstart", "qend")])


@query(f"{_DOCJ}, {_FLANK} select chrom, start, \"end\", strand, rseq, qseq from fs")
def flank_sequences(spark, sf_dir):
    return S.flank_sequences(*doc_flanks(spark, sf_dir)).select(*KEYS, "rseq", "qseq")


@query(f"{_DOCJ}, {_FLANK} select distinct chrom, concat(chrom, ':', rstart, '-', rend) as region, cast(rstart as bigint) as start, cast(rend as bigint) as \"end\", concat(chrom, ':', start, '-', \"end\", '(', strand, ')') as junction from fl")
def region_strings(spark, sf_dir):
    got = S.flank_regions(doc_junctions(spark, sf_dir), genome(spark, sf_dir)[1])
    named = got.select(C.region(F.col("chrom"), F.col("rstart"), F.col("rend")).alias("region"), C.junction_name(*[F.col(k) for k in KEYS]).alias("junction")).distinct()
    parsed = C.parse_region(F.col("region"))
    return named.select(parsed["chrom"].alias("chrom"), "region", parsed["start"].alias("start"), parsed["end"].alias("end"), "junction")


_H = f"with h as ({HITS})"
_HAM = "list_sum(list_transform(range(1, 8), lambda x: case when substr({a}, {o} + x, 1) <> substr({b}, {o} + x, 1) then 1 else 0 end))"
_DIST = f"case when length(rseq) >= 57 and length(qseq) >= 57 then {_HAM.format(a='rseq', b='qseq', o=43)} + {_HAM.format(a='rseq', b='qseq', o=50)} end"
_TWO = "(r_en >= 56 and r_st <= 43 and q_en >= 56 and q_st <= 43 and abs(r_st - q_st) <= 14)"


@query(f"{_H} select chrom, start, cast({_DIST} as int) as d from h")
def anchor_hamming(spark, sf_dir):
    return hits(spark, sf_dir).select("chrom", "start", S.anchor_distance(F.col("rseq"), F.col("qseq")).cast("int").alias("d"))


@query(f"{_H} select chrom, start, {_TWO} as two from h")
def two_anchor_predicate(spark, sf_dir):
    return hits(spark, sf_dir).select("chrom", "start", S.two_anchors(F.col("hit")).alias("two"))


@query(f"{_H} select chrom, start, \"end\" from h where not (100 >= \"end\" - start and case when r_st = \"end\" - start then true when 50 > \"end\" - start then r_st - q_st = \"end\" - start else r_st >= 50 and q_en <= 50 end)")
def self_overlap_filter(spark, sf_dir):
    return hits(spark, sf_dir).where(~S.overlaps_itself(F.col("hit"), F.col("start"), F.col("end"))).select("chrom", "start", "end")


_PROBE = """p as (
 select chrom, start, "end", strand, 'seq1' as type, substr(rseq, r_st + 1, r_en - r_st) as s from h where r_st < length(rseq) and r_en <= length(rseq) and r_st < r_en
 union all select chrom, start, "end", strand, 'seq2', substr(qseq, q_st + 1, q_en - q_st) from h where q_st < length(qseq) and q_en <= length(qseq) and q_st < q_en),
probe as (select chrom, start, "end", strand, type, case when length(s) <= 30 then s else substr(s, (length(s) - 30) // 2 + 1, 30) end as seq from p
 union all select chrom, start, "end", strand, 'seqh', concat(substr(rseq, 36, 15), substr(qseq, 51, 15)) from h where length(rseq) >= 50 and length(qseq) >= 65)"""


@query(f"{_H}, {_PROBE} select * from probe")
def probe_build(spark, sf_dir):
    return S.probes(hits(spark, sf_dir))


def _doc_probes(spark, sf_dir):
    rows = contigs(spark, sf_dir).where(F.length("seq") >= 200)
    return rows.select("chrom", F.lit(100).cast("long").alias("start"), F.lit(130).cast("long").alias("end"), F.lit("+").alias("strand"), F.lit("seqh").alias("type"), F.substring("seq", 101, 30).alias("seq"))


@query(f"""with {_CONTIG}, pr as (select chrom, substr(seq, 101, 30) as p from contigs where length(seq) >= 200), u as (select distinct p from pr where p not like '%N%'),
k as (select substr(seq, cast(i + 1 as bigint), 30) as w, count(*) as n from (select seq, unnest(range(length(seq) - 29)) as i from contigs where length(seq) >= 30) group by 1),
c as (select u.p, coalesce(a.n, 0) + coalesce(b.n, 0) as n from u left join k a on a.w = u.p left join k b on b.w = reverse(translate(u.p, 'ACGT', 'TGCA')))
select chrom, cast(least(coalesce(n, 0), 11) as bigint) as hits from pr left join c using (p)""")
def probe_exact_counts(spark, sf_dir):
    return S.match_counts(_doc_probes(spark, sf_dir), genome(spark, sf_dir)[0], mismatches=0).select("chrom", "hits")


@query(f"""with contigs as ({CLEAN.replace("{g}", ", 'g'")}), pr as (select chrom, cast(s as bigint) as start, substr(seq, cast(s + 1 as bigint), 30) as p from (select *, unnest(range(100, length(seq) - 29, 500)) as s from contigs)),
u as (select distinct p from pr), strands as (select p, p as s from u union all select p, reverse(translate(p, 'ACGT', 'TGCA')) from u),
w as (select row_number() over () as id, substr(seq, cast(i + 1 as bigint), 30) as w from (select seq, unnest(range(length(seq) - 29)) as i from contigs where length(seq) >= 30)),
ks as (select p, s, cast(b as bigint) as b, substr(s, cast(7 * b + 1 as bigint), 7) as k from strands, unnest(range(4)) as t(b)),
kw as (select id, w, cast(b as bigint) as b, substr(w, cast(7 * b + 1 as bigint), 7) as k from w, unnest(range(4)) as t(b)),
near as (select distinct ks.p, ks.s = ks.p as forward, id from ks join kw using (b, k) where hamming(ks.s, kw.w) <= 3),
twice as (select p, count(*) * (case when p = reverse(translate(p, 'ACGT', 'TGCA')) then 2 else 1 end) as n from near group by p)
select chrom, start, cast(least(n, 11) as bigint) as hits from pr join twice using (p)""")
def probe_mismatch_counts(spark, sf_dir):
    """Probes every 500 characters of contigs without N, with the default differences."""
    rows = clean_contigs(spark, sf_dir).where(F.length("seq") >= 130).withColumn("start", F.explode(F.sequence(F.lit(100), F.length("seq") - 30, F.lit(500))))
    made = rows.select("chrom", F.col("start").cast("long").alias("start"), (F.col("start") + 30).cast("long").alias("end"), F.lit("+").alias("strand"), F.lit("seqh").alias("type"), F.substring("seq", F.col("start") + 1, F.lit(30)).alias("seq"))
    return S.match_counts(made, genome(spark, sf_dir, clean_contigs)[0]).select("chrom", "start", "hits")


@query(f"""{_H} select chrom, start, case when {_TWO} then not ((c1 = 1 or c2 = 1) and ch = 0) when q_st - r_st >= 27 and ch = 0 then false when (c1 < 10 or c2 < 10) and ch = 0 then false
 when (c1 < 10 or c2 < 10) and coalesce({_DIST} > 2, false) then false else true end as spurious from h""")
def classify_rules(spark, sf_dir):
    return hits(spark, sf_dir).select("chrom", "start", S.verdict().alias("spurious"))


#: Pairs of sequences, and what the rules of the aligner give for them, cell by cell (tests hold these values to an implementation of their own).
VECTORS = [
    ("ACGTACGTTGCAACGTTAGC", "ACGTACGTTGCAACGTTAGC", 0, 20, 0, 20, 60, "20M"),
    ("TTTTTACGTACGTTGCAACGTTAGC", "ACGTACGTTGCAACGTTAGCAAAA", 5, 25, 0, 20, 60, "20M"),
    ("ACGTACGTTGCAACGTTAGC", "acgtacgttgcaacgttagc".upper()[:9] + "T" + "ACGTACGTTGCAACGTTAGC"[10:], 0, 20, 0, 20, 53, "20M"),
    ("GATTACAGATTACACCTGAAGGCTTAGCAT", "GATTACAGATTACACCTGACCGAAGGCTTAGCAT", 0, 30, 0, 34, 70, "17M4I13M"),
    ("ACGTACGTTG", "ACGTACGTTG", None, None, None, None, None, None),
    ("ACGTNCGTTGCAACGTTAGC", "ACGTNCGTTGCAACGTTAGC", 0, 20, 0, 20, 56, "20M"),
    ("CCCCCCCCCCCCCCCC", "GGGGGGGGGGGGGGGG", None, None, None, None, None, None),
]


def _vectors_sql() -> str:
    rows = [f"({i}, {', '.join('null' if x is None else repr(x) for x in v[2:])})" for i, v in enumerate(VECTORS)]
    return f"select id, cast(r_st as int) as r_st, cast(r_en as int) as r_en, cast(q_st as int) as q_st, cast(q_en as int) as q_en, cast(score as int) as score, cigar from (values {', '.join(rows)}) as t(id, r_st, r_en, q_st, q_en, score, cigar)"


@query(_vectors_sql())
def align_vectors(spark, sf_dir):
    rows = spark.createDataFrame([(i, v[0], v[1]) for i, v in enumerate(VECTORS)], "id int, rseq string, qseq string")
    return rows.select("id", align(F.col("rseq"), F.col("qseq")).alias("h")).select("id", "h.r_st", "h.r_en", "h.q_st", "h.q_en", "h.score", "h.cigar")


_CIG = "concat(10 + c1, 'M', 1 + ch * 20, case when c2 % 2 = 0 then 'I' else 'D' end, 5 + c2, 'M')"
_SAME = "list_sum(list_transform(range({n}), lambda x: case when substr(rseq, cast({a} + x + 1 as bigint), 1) = substr(qseq, cast({b} + x + 1 as bigint), 1) then 3 else -4 end))"


@query(f"""{_H}, g as (select *, 1 + ch * 20 as n, {_CIG} as cigar from h where length(rseq) = 100)
select chrom, start, cigar, cast({_SAME.format(n="10 + c1", a="0", b="0")} + {_SAME.format(n="5 + c2", a="10 + c1 + case when c2 % 2 = 0 then 0 else n end", b="10 + c1 + case when c2 % 2 = 0 then n else 0 end")} - least(12 + 2 * n, 32 + n) as int) as score from g""")
def cigar_rescore(spark, sf_dir):
    from .params import DEFAULT

    rows = _sql(spark, sf_dir, HITS).where("length(rseq) = 100").withColumn("cigar", F.expr(_CIG))
    return rows.select("chrom", "start", "cigar", C.rescored(F.col("cigar"), F.col("rseq"), F.col("qseq"), F.lit(0), F.lit(0), DEFAULT.scoring).alias("score"))


@query(f"""{_H}, a as (select *, l_orderkey % 4 as total from (select h.*, cast(substr(chrom, 2) as bigint) as l_orderkey from h) t)
select chrom, start, "end", case when total <= 1 then 0 else c1 end as seq1_count, case when total <= 1 then 0 else c2 end as seq2_count, case when total <= 1 then 0 else ch end as seqh_count, cast(r_en as int) as align_score, case when total <= 1 then 'low score' else 'repeat' end as reason from a
where total <= 1 or case when {_TWO} then not ((c1 = 1 or c2 = 1) and ch = 0) when q_st - r_st >= 27 and ch = 0 then false when (c1 < 10 or c2 < 10) and ch = 0 then false when (c1 < 10 or c2 < 10) and coalesce({_DIST} > 2, false) then false else true end""")
def detection_branches(spark, sf_dir):
    """Low scores, counts that come back to their junctions by key and type, the rules, and the union."""
    rows = hits(spark, sf_dir).withColumn("total_score", F.substring("chrom", 2, 30).cast("long") % 4).withColumn("hit", F.col("hit").withField("score", F.col("hit.r_en")))
    names = ("seq1", "seq2", "seqh")
    scarce, rest = engine.by_score(rows.drop(*[f"{t}_count" for t in names]), True)
    found = rows.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"{t}_count").cast("long").alias("hits")) for t in names])).alias("p")).select(*KEYS, "p.*").where("hits > 0")
    got = engine.spurious(scarce, S.with_counts(rest, found))
    return got.select("chrom", "start", "end", *[F.col(f"{t}_count").cast("long").alias(f"{t}_count") for t in names], "align_score", "reason")


@query(f"{_DOCJ}, {_FLANK}, reg as (select distinct chrom, cast(s as bigint) as start, cast(e as bigint) as \"end\" from (select chrom, rstart as s, rend as e from fl union all select chrom, qstart, qend from fl)) select row_number() over (order by chrom, start, \"end\") as rank, chrom, start, \"end\" from reg")
def region_order(spark, sf_dir):
    got = S.regions_to_fetch(S.flank_regions(doc_junctions(spark, sf_dir), genome(spark, sf_dir)[1]))
    return got.select(F.col("rank").cast("long").alias("rank"), "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(ORACLE["flank_sequences"])
def flank_sequences_lower(spark, sf_dir):
    """A genome in lower case gives upper-case flanks."""
    found, tiles, sizes = doc_flanks(spark, sf_dir)
    return S.flank_sequences(found, tiles.withColumn("seq", F.lower("seq")), sizes).select(*KEYS, "rseq", "qseq")


@query()
def self_align(spark, sf_dir):
    rows = S.flank_sequences(*doc_flanks(spark, sf_dir))
    return S.self_aligned(rows).select(*KEYS, "hit.*")


@query()
def align_pairs(spark, sf_dir):
    rows = S.flank_sequences(*doc_flanks(spark, sf_dir))
    return rows.select(*KEYS, align(F.col("rseq"), F.col("qseq")).alias("h")).select(*KEYS, F.col("h.score").alias("score"), F.col("h.cigar").alias("cigar"))


@query()
def spurious_end_to_end(spark, sf_dir):
    """Detection with default parameters over contigs without N."""
    found, tiles, sizes = doc_flanks(spark, sf_dir, clean_contigs)
    got = engine.detect(found, engine.settle(tiles), engine.settle(sizes))
    return got.select(*KEYS, "total_score", "align_score", "seq1_count", "seq2_count", "seqh_count", "reason")


# Outputs.
@query(f"{_J}, {_NAMED} select rank, concat(chrom, chr(9), start, chr(9), \"end\", chr(9), name, chr(9), total_score, chr(9), strand, chr(9), 0, chr(9), pairs) as value from named")
def junction_layout_bam(spark, sf_dir):
    return text_rows(output.layout(_junctions(spark, sf_dir), "bam"))


@query(f"{_J}, {_NAMED} select rank, concat(chrom, chr(9), start, chr(9), \"end\", chr(9), name, chr(9), total_score, chr(9), strand, chr(9), samples) as value from named")
def junction_layout_bed(spark, sf_dir):
    return text_rows(output.layout(_junctions(spark, sf_dir), "bed"))


@query(f"""{_INTRON}, junc as (select chrom, start, "end", strand, arg_min(gene_id, transcript_id) as gene_id, string_agg(transcript_id, ';' order by transcript_id) as ts from introns group by chrom, start, "end", strand), {_NAMED}
select rank, concat(chrom, chr(9), start, chr(9), "end", chr(9), name, chr(9), '.', chr(9), strand, chr(9), 0, chr(9), gene_id, ';', ts) as value from named""")
def junction_layout_gtf(spark, sf_dir):
    return text_rows(output.layout(text.gtf_junctions(exons(spark, sf_dir)), "gtf"))


@query(f"""{_J}, {_NAMED} select rank, concat(chrom, chr(9), start, chr(9), "end", chr(9), name, chr(9), total_score, chr(9), strand, chr(9), 0, chr(9),
 case when samples like '%;%' then concat(split_part(pairs, ';', 2), ';', split_part(pairs, ';', 1)) else pairs end) as value from named""")
def sample_order(spark, sf_dir):
    return text_rows(output.layout(_junctions(spark, sf_dir), "bam", ["O", "F"]))


@query(f"{_J}, {_NAMED} select sample, rank, concat(n.chrom, chr(9), n.start, chr(9), n.\"end\", chr(9), name, chr(9), score, chr(9), n.strand, chr(9), 0) as value from named n join per p on n.chrom = p.chrom and n.start = p.start and n.\"end\" = p.\"end\" and n.strand = p.strand")
def by_sample_export(spark, sf_dir):
    got = output.by_sample(_junctions(spark, sf_dir))
    return got.select("sample", F.col("rank").cast("long").alias("rank"), "value")


@query(ORACLE["by_sample_export"].replace("select sample, rank,", "select sample,"))
def sample_files(spark, sf_dir):
    """The per-sample files, written and read back."""
    path = fresh_path(spark, "samples")
    output.write_by_sample(output.by_sample(_junctions(spark, sf_dir)), path)
    return spark.read.schema("value string, sample string").text(path).select("sample", "value")


@query(f"{_J}, {_NAMED} select rank, concat(chrom, chr(9), start, chr(9), \"end\", chr(9), 'JUNC', lpad(cast(rank as varchar), 8, '0'), chr(9), total_score, chr(9), strand) as value from named")
def bed6_export(spark, sf_dir):
    return text_rows(output.bed6(_junctions(spark, sf_dir), 8))


@query(f"{_J}, {_NAMED} select rank, concat(chrom, chr(9), start, chr(9), \"end\", chr(9), 'JUNC', rank, chr(9), total_score, chr(9), strand) as value from named")
def bed6_plain(spark, sf_dir):
    return text_rows(output.bed6(_junctions(spark, sf_dir)))


# Filtering alignments.
def _bad_keys(spark, sf_dir):
    return J.events(pairs(spark, sf_dir)).where("end - start in (50, 53)").select(*KEYS).distinct()


@query(f"with {_PAIR}, {_PEV} select file_ord from bad")
def filter_flagged_reads(spark, sf_dir):
    return filtering.using(pairs(spark, sf_dir), _bad_keys(spark, sf_dir)).select("file_ord")


def _fates(spark, sf_dir, **options):
    return filtering.filtered(pairs(spark, sf_dir), _bad_keys(spark, sf_dir), **options)


@query(f"with {_PAIR}, {_PEV} select file_ord from t where hit")
def filter_removed(spark, sf_dir):
    return _fates(spark, sf_dir).where("fate = 'removed'").select("file_ord")


@query(f"with {_PAIR}, {_PEV} select file_ord from t where within")
def mate_quota(spark, sf_dir):
    return _fates(spark, sf_dir).where("fate = 'mate'").select("file_ord")


@query(f"""with {_PAIR}, {_PEV} select file_ord, cast(case when asks and nh - less > 0 then nh - less else nh end as int) as nh from t left join adj on t.qname = adj.qname and (case when flag & 64 <> 0 then 1 when flag & 128 <> 0 then 2 else 0 end) = po where not hit and not coalesce(within, false)""")
def nh_adjust(spark, sf_dir):
    return _fates(spark, sf_dir).where("fate is null").select("file_ord", "nh")


@query(f"""with {_PAIR}, {_PEV} select file_ord, cast(case when coalesce(within, false) then flag & ~11 else flag end as int) as flag, cast(case when coalesce(within, false) then 0 else tlen end as bigint) as tlen, case when coalesce(within, false) then pos else mpos end as mpos from t where not hit""")
def unpair_mates(spark, sf_dir):
    return _fates(spark, sf_dir, remove_mate=False).where("fate is null").select("file_ord", "flag", "tlen", "mpos")


@query(f"with {_PAIR}, {_PEV} select sample, count(*) as total, cast(sum(case when cigar like '%N%' then 1 else 0 end) as bigint) as spliced, cast(sum(case when hit or coalesce(within, false) then 1 else 0 end) as bigint) as removed from t group by sample")
def filter_stats(spark, sf_dir):
    return filtering.statistics(pairs(spark, sf_dir), _fates(spark, sf_dir))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
