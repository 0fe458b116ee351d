"""Inputs, paths, detection, alignment and whole flows on small hand-made cases."""

import gzip
import random
import re
from collections import Counter

import pytest

from junctura import detect, naming
from junctura.functions import aligner
from junctura.params import DEFAULT
from junctura.sources import bam, text


def write(path, content: str) -> str:
    path.write_text(content)
    return str(path)


def test_bed_records_comments_and_last_line(spark, tmp_path):
    f = write(tmp_path / "a.bed", "# comment\ntrack name=x\n\nchr1\t100\t200\tJ1\t5\t+\nchr1 300 400 J2 10 -\tmore\nchr2\t500\t600\tJ3\t3\t?\nchr1\t100\t200\tJ4\t7\t+\n")
    got = {tuple(r) for r in text.read_bed(spark, [f]).select("chrom", "start", "end", "strand", "name", "score", "sample").collect()}
    assert got == {("chr1", 100, 200, "+", "J4", 7, "a"), ("chr1", 300, 400, "-", "J2", 10, "a"), ("chr2", 500, 600, ".", "J3", 3, "a")}


@pytest.mark.parametrize("line", ["chr1\t5\t4\tj\t1\t+", "chr1\t1\t4\tj\t.\t+", "chr1\t1\t4\tj\t1", "chr1\tx\t4\tj\t1\t+"])
def test_bed_errors(spark, tmp_path, line):
    f = write(tmp_path / "a.bed", line + "\n")
    with pytest.raises(Exception, match="no BED6 record|start beyond end"):
        text.read_bed(spark, [f]).collect()


def test_bed_gzip_with_and_without_suffix(spark, tmp_path):
    members = gzip.compress(b"c\t1\t2\tj\t1\t+\n") + gzip.compress(b"c\t3\t4\tj\t1\t+\n")
    (tmp_path / "a.bed.gz").write_bytes(members)
    (tmp_path / "b.dat").write_bytes(members)
    for name in ("a.bed.gz", "b.dat"):
        assert {(r["start"], r["end"]) for r in text.read_bed(spark, [str(tmp_path / name)]).collect()} == {(1, 2), (3, 4)}


def test_gtf_introns(spark, tmp_path):
    rows = ["#header", "broken line"]
    for a, b, t in ((501, 600, "t1"), (101, 200, "t1"), (301, 400, "t1"), (101, 200, "t2"), (301, 400, "t2")):
        gene = 'gene_id "g1"; ' if t == "t1" else ""
        rows.append(f'chr1 t exon {a} {b} . + . {gene}transcript_id "{t}";')
    got = {(r["start"], r["end"]): (r["gene_id"], r["transcript_ids"]) for r in text.read_gtf(spark, write(tmp_path / "a.gtf", "\n".join(rows))).collect()}
    assert got == {(200, 300): ("g1", ["t1", "t2"]), (400, 500): ("g1", ["t1"])}
    with pytest.raises(Exception, match="no transcript_id"):
        text.read_gtf(spark, write(tmp_path / "b.gtf", 'chr1 t exon 1 2 . + . gene_id "g";')).collect()


def test_detection(tmp_path):
    for name, head in (("a.dat", b"\x1f\x8b\x08\x04BAM\x01"), ("b.dat", b"CRAM\x03"), ("c.dat", b"@HD\tVN:1.6")):
        (tmp_path / name).write_bytes(head)
        assert detect.is_alignment_file(str(tmp_path / name))
    listed = write(tmp_path / "list.txt", f"{tmp_path}/a.dat\n\n {tmp_path}/b.dat \n")
    assert not detect.is_alignment_file(listed) and not detect.is_bed_file(listed)
    assert detect.read_path_list(listed) == [f"{tmp_path}/a.dat", f"{tmp_path}/b.dat"]
    assert detect.is_bed_file(write(tmp_path / "d.dat", "# x\ntrack y\nchr1\t1\t2\tj\t1\t+\n"))
    with pytest.warns(DeprecationWarning):
        assert len(detect.resolve_inputs(listed, "bam")) == 2
    with pytest.raises(FileNotFoundError):
        detect.read_path_list(write(tmp_path / "bad.txt", "/no/such/file\n"))


def test_names(tmp_path):
    T = naming.Target
    assert T("out.bed").is_file and not T("results/").is_file and not T(str(tmp_path)).is_file and not T("").is_file
    assert (T("out.bed").folder, T("a/out.bed").folder, T("a/b").folder, T("").folder) == (None, "a", "a/b", None)
    assert T("results/out.bam").files(["x/a.bam", "y/b.bam"], "_f", ".bam") == ["results/a_f.bam", "results/b_f.bam"]
    assert T("results/out.bam").files(["x/a.bam"], "_f", ".bam") == ["results/out.bam"]
    assert T("out.bam").files(["x/a.bam", "b.bam"], "", ".bam") == ["./a.bam", "./b.bam"]
    assert T("dir").files(["x/a.bam"], "_f", ".bam") == ["dir/a_f.bam"]
    assert naming.beside("a.bam", "_removed_alignments", ".bam") == "a_removed_alignments.bam"
    assert naming.sample_name("d/x.bed.gz") == "x.bed" and naming.genome_name("d/g.fa.gz") == "g" and naming.genome_name("d\\g.v1.fasta") == "g.v1" and naming.sample_name("x") == "x"


def plain_hit(r: str, q: str):
    """Affine-gap local alignment cell by cell, with the traceback over best scores only: diagonal, then a gap in r, then a gap in q."""
    s, low = DEFAULT.scoring, -(10**6)
    h = [[0] * (len(q) + 1) for _ in range(len(r) + 1)]
    e = [[low] * (len(q) + 1) for _ in range(len(r) + 1)]
    f = [[low] * (len(q) + 1) for _ in range(len(r) + 1)]
    pair = lambda i, j: -s.ambiguous if "N" in (r[i - 1], q[j - 1]) else s.match if r[i - 1] == q[j - 1] else -s.mismatch
    best, at = 0, (0, 0)
    for i in range(1, len(r) + 1):
        for j in range(1, len(q) + 1):
            e[i][j] = max(e[i][j - 1] - s.gap_extend, h[i][j - 1] - s.gap_open - s.gap_extend)
            f[i][j] = max(f[i - 1][j] - s.gap_extend, h[i - 1][j] - s.gap_open - s.gap_extend)
            h[i][j] = max(0, h[i - 1][j - 1] + pair(i, j), e[i][j], f[i][j])
            if h[i][j] > best:
                best, at = h[i][j], (i, j)
    if best < DEFAULT.min_score:
        return None
    (i, j), ops = at, ""
    while i and j and h[i][j] > 0:
        if h[i][j] == h[i - 1][j - 1] + pair(i, j):
            ops, i, j = "M" + ops, i - 1, j - 1
        elif h[i][j] == e[i][j]:
            ops, j = "I" + ops, j - 1
        elif h[i][j] == f[i][j]:
            ops, i = "D" + ops, i - 1
        else:
            break
    span = min(at[0] - i, at[1] - j)
    return None if span < DEFAULT.min_span else (i, at[0], j, at[1], best, span, "".join(f"{len(m[0])}{m[1]}" for m in re.finditer(r"(.)\1*", ops)))


def test_aligner_against_cell_by_cell():
    rng = random.Random(3)
    pairs = []
    for _ in range(60):
        core = "".join(rng.choice("ACGT") for _ in range(rng.randrange(5, 60)))
        other = "".join(c if rng.random() > 0.08 else rng.choice(["", "A", "GT", "N", "ACGTA"]) for c in core)
        pairs.append(("".join(rng.choice("ACGT") for _ in range(rng.randrange(30))) + core, other + "".join(rng.choice("ACGTN") for _ in range(rng.randrange(30)))))
    pairs += [("ACAC" * 12, "CACA" * 12), ("", "A"), ("A" * 40, "A" * 30), ("N" * 30, "N" * 30)]
    got = aligner.batch(*zip(*pairs, strict=True))
    assert got == [plain_hit(r, q) if r and q else None for r, q in pairs] and sum(x is not None for x in got) > 20


def test_aligner_of_given_vectors():
    from junctura.queries import VECTORS

    for r, q, *want in VECTORS:
        hit = plain_hit(r, q)
        assert want == ([None] * 6 if hit is None else [*hit[:5], hit[6]])


def test_self_alignment_of_documents_against_cell_by_cell(spark):
    from junctura import queries

    where = "/root/testdata/sf0.001"
    flanks = {tuple(r)[:4]: (r["rseq"], r["qseq"]) for r in queries.queries()["flank_sequences"](spark, where).collect()}
    got = {tuple(r)[:4]: (r["score"], r["cigar"]) for r in queries.queries()["align_pairs"](spark, where).collect()}
    assert set(got) == set(flanks)
    for key in sorted(flanks)[:60]:
        hit = plain_hit(*flanks[key])
        assert got[key] == ((hit[4], hit[6]) if hit else (None, None))


READ = dict(sample="a", qname="r1", flag=99, tid=0, chrom="c", pos=50, mapq=60, mtid=0, mpos=200, tlen=10, cigar="10M100N20M", xs="+", nh=2, yc=None, seq="ACGT" * 7 + "AC", qual=bytes(30), tags=b"XSA+NHC\x02")


def test_bam_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.bam")
    assert bam.write_bam(path, "@HD\tVN:1.6\n", [("c", 1000)], [READ, READ | {"qname": "r2", "cigar": "30M", "pos": 60}]) == 2
    got = bam.read_bam(spark, [path]).orderBy("file_ord").collect()
    assert [(r["qname"], r["chrom"], r["pos"], r["cigar"], r["xs"], r["nh"], r["sample"], r["seq"]) for r in got] == [("r1", "c", 50, "10M100N20M", "+", 2, "a", READ["seq"]), ("r2", "c", 60, "30M", "+", 2, "a", READ["seq"])]


@pytest.fixture(scope="module")
def large_bam(tmp_path_factory):
    """Sorted alignments on three contigs; the second has none."""
    path = str(tmp_path_factory.mktemp("bam") / "big.bam")
    rng, rows = random.Random(8), []
    for tid in (0, 2):
        for i, pos in enumerate(sorted(rng.randrange(400_000) for _ in range(6000))):
            rows.append(READ | dict(qname=f"q{tid}.{i}", tid=tid, mtid=tid, pos=pos, cigar=rng.choice(["30M", "10M500N20M", "5M40000N25M"]), qual=bytes(rng.randrange(40) for _ in range(30))))
    contigs = [("x", 500_000), ("none", 10), ("y", 500_000)]
    bam.write_bam(path, "@HD\tVN:1.6\tSO:coordinate\n", contigs, rows)
    return path, rows, contigs


def test_indexed_bam_is_split_and_read_by_region(spark, large_bam):
    path, rows, contigs = large_bam
    whole = bam.read_bam(spark, [path]).select("qname", "file_ord").collect()
    assert [r["qname"] for r in sorted(whole, key=lambda r: r["file_ord"])] == [r["qname"] for r in rows]
    bam.write_index(path)
    split = bam.read_bam(spark, [path], split=50_000)
    assert split.rdd.getNumPartitions() > 3
    assert sorted(split.select("qname", "file_ord").collect()) == sorted(whole)
    names = [c for c, _ in contigs]
    for region, (c, a, z) in {"y:100001-101000": ("y", 100_000, 101_000), "x:1-5": ("x", 0, 5), "none:1-9": ("none", 0, 9), "y:399000-500000": ("y", 398_999, 500_000)}.items():
        want = sorted(r["qname"] for r in rows if names[r["tid"]] == c and r["pos"] < z and r["pos"] + bam.span(r["cigar"]) > a)
        assert sorted(r["qname"] for r in bam.read_bam(spark, [path], region).select("qname").collect()) == want
    assert bam.read_bam(spark, [path], "nonsense").count() == 0
    reader = bam.BamReader({"paths": path, "region": "y:100001-101000"})
    part = reader.partitions()[0]
    assert part.begin > 0 and sum(1 for _ in bam.records(path, "s", part.begin, part.end, part.region)) < 2000
    rest = bam.read_bam(spark, [path]).where("chrom = 'y' and pos < 1000")
    assert sorted(r["qname"] for r in rest.collect()) == sorted(r["qname"] for r in rows if r["tid"] == 2 and r["pos"] < 1000)


def test_cut_off_bam_is_an_error(spark, large_bam, tmp_path):
    data = open(large_bam[0], "rb").read()
    at = data.index(b"\x1f\x8b\x08\x04", len(data) // 2)  # at a block's border, and within one
    for n in (at, at + 100):
        (tmp_path / "cut.bam").write_bytes(data[:n])
        with pytest.raises(Exception, match="cut off"):
            bam.read_bam(spark, [str(tmp_path / "cut.bam")]).count()


def test_save_bam_from_many_tasks(spark, large_bam, tmp_path):
    path, rows, contigs = large_bam
    out = str(tmp_path / "out.bam")
    kept = bam.read_bam(spark, [path]).where("pos % 3 > 0").repartition(7)
    for _ in range(2):  # the second replaces the first
        bam.save_bam(kept, out, "@HD\tVN:1.6\tSO:coordinate\n", contigs)
    with open(out, "rb") as f:
        assert bam.header(bam.Stream(f)) == ("@HD\tVN:1.6\tSO:coordinate\n", contigs)
    assert [r[2] for r in bam.records(out, "s")] == [r["qname"] for r in rows if r["pos"] % 3 > 0]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["out.bam"]


def test_merge_of_sorted_files(spark, large_bam, tmp_path):
    from junctura.operators import junctions as J

    path, rows, contigs = large_bam
    got = J.merge_files(spark, [path, path]).select("tid", "pos", "file_idx").collect()
    assert [tuple(r) for r in got] == sorted((r["tid"], r["pos"], i) for r in rows for i in (0, 1))
    bam.write_bam(str(tmp_path / "u.bam"), "@HD\tSO:unsorted\n", contigs, rows[:1])
    with pytest.raises(ValueError, match="not sorted"):
        J.merge_files(spark, [str(tmp_path / "u.bam")])


def test_sam_is_read_as_bam_is(spark, large_bam, tmp_path):
    path, rows, contigs = large_bam
    head = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs)
    lines = ["\t".join(map(str, (r["qname"], r["flag"], contigs[r["tid"]][0], r["pos"] + 1, r["mapq"], r["cigar"], "=", r["mpos"] + 1, r["tlen"], r["seq"], "".join(chr(33 + x) for x in r["qual"]), "XS:A:+", "NH:i:2"))) for r in rows[:500]]
    (tmp_path / "big.sam").write_text(head + "\n".join(lines) + "\n")
    got = text.read_sam(spark, [str(tmp_path / "big.sam")]).orderBy("file_ord").collect()
    want = bam.read_bam(spark, [path]).orderBy("file_ord").limit(500).collect()
    for a, b in zip(got, want, strict=True):
        x, y = a.asDict(), b.asDict()
        assert {k: x[k] for k in y if k not in ("file_ord", "tags")} == {k: y[k] for k in y if k not in ("file_ord", "tags")}
        assert [v for *_, v in bam.tag_items(bytes(x["tags"]))] == ["+", 2]


def test_fasta_over_blocks(spark):
    rng = random.Random(4)
    genome = {f"c{i}": "".join(rng.choice("acgtACGTN") for _ in range(n)) for i, n in enumerate((300, 1, 0, 5000))}
    lines = [x for c, s in genome.items() for x in (f">{c} words", *[s[i : i + 37] for i in range(0, len(s), 37)], "")]
    rows = [("f", 100 * (i // 23), i % 23, x) for i, x in enumerate(lines)]  # blocks of 23 lines
    parts = text.parse_fasta(spark.createDataFrame(rows, "path string, block long, line long, value string").repartition(5))
    got = {}
    for r in sorted(parts.collect(), key=lambda r: (r["chrom"], r["at"])):
        assert r["at"] == len(got.get(r["chrom"], ""))
        got[r["chrom"]] = got.get(r["chrom"], "") + r["part"]
    assert got == {c: s.upper() for c, s in genome.items() if s}


def test_file_order_over_splits(spark, tmp_path):
    path = write(tmp_path / "long.txt", "".join(f"{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        lines = text.file_order(text.read_lines(spark, [path]))
        assert lines.select("block").distinct().count() > 5
        assert [r["value"] for r in lines.orderBy("at").collect()] == [str(i) for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def plain_places(probe, genome, most):
    flip = str.maketrans("ACGT", "TGCA")
    n = len(probe)
    both = (probe, probe[::-1].translate(flip))
    return min(11, sum("N" not in s[i : i + n] and sum(x != y for x, y in zip(q, s[i : i + n], strict=True)) <= most for q in both for s in genome.values() for i in range(len(s) - n + 1)))


def tile_rows(genome):
    return [(c, t, s[t * 1000 : t * 1000 + 1200]) for c, s in genome.items() for t in range(-(-len(s) // 1000))]


def test_probes_of_all_lengths_against_brute_force(spark):
    from junctura.operators import spurious

    rng = random.Random(16)
    genome = {c: "".join(rng.choice("ACGT") for _ in range(1300)) for c in "ab"}
    genome["c"] = "A" * 300 + "N" + genome["a"][:200] + "ACGTTGCATGCAACGT"
    probes = ["A" * 30, "A" * 17, genome["c"][-15:], "ACGTTGCATGCAACGT", genome["b"][-16:]]
    for n in range(15, 30):
        seq = list(genome["ab"[n % 2]][40 * n : 40 * n + n])
        for at in rng.sample(range(n), rng.randrange(3)):
            seq[at] = rng.choice("ACGT")
        probes.append("".join(seq))
    made = spark.createDataFrame([("a", i, i + 1, "+", "seq1", p) for i, p in enumerate(probes)] + [("a", 99, 100, "+", "seq1", "ACGTN" * 4)], "chrom string, start long, end long, strand string, type string, seq string")
    tiles = spark.createDataFrame(tile_rows(genome), "chrom string, tile long, seq string")
    got = {r["start"]: r["hits"] for r in spurious.match_counts(made, tiles).collect()}
    assert got == {i: plain_places(p, genome, spurious.allowed(len(p))) for i, p in enumerate(probes)} | {99: 0}


def test_detection_end_to_end_against_plain_rules(spark):
    """Flanks, self-alignment, scores, probes, counts and rules of whole junctions, against a sequential model of the rules."""
    from junctura.operators import spurious
    from junctura.plans import engine

    p, rng = DEFAULT, random.Random(21)
    base = "".join(rng.choice("ACGT") for _ in range(9000))
    genome, found = {"g": list(base)}, []
    for i in range(36):
        start = 120 + 230 * i
        end = start + rng.randrange(20, 200)
        if i % 4:  # the flanks resemble each other, more or less
            shift, n = rng.choice([0, 0, 3, 30]), rng.randrange(20, 100)
            for k in range(n):
                if rng.random() > 0.05 * (i % 3):
                    genome["g"][min(8999, end - 50 + k)] = genome["g"][start - 50 + (k + shift) % 100]
        found.append(("g", start, end, "+-."[i % 3], 1 + i % 5))
    genome = {"g": "".join(genome["g"]), "h": "".join(genome["g"][1000:4000]).lower()}
    found += [("unknown", 5, 50, "+", 9), ("g", 3, 8990, "+", 9)]
    genome["h"] = genome["h"].upper()
    junctions = spark.createDataFrame(found, "chrom string, start long, end long, strand string, total_score long")
    tiles = spark.createDataFrame(tile_rows(genome), "chrom string, tile long, seq string")
    sizes = spark.createDataFrame([(c, len(s)) for c, s in genome.items()], "chrom string, length long")
    trusted = junctions.limit(0).unionByName(junctions.where("start = 120 + 230 * 5"))
    want = {}
    for chrom, start, end, strand, total in found:
        if chrom not in genome or (chrom, start) == ("g", 120 + 230 * 5):
            continue
        seq, o, L = genome[chrom], p.overhang, end - start
        r, q = seq[max(start - o, 0) : start + o], seq[max(end - o, 0) : end + o]
        hit = plain_hit(r, q)
        if hit is None:
            continue
        r_st, r_en, q_st, q_en, score, _, _ = hit
        if 2 * o >= L and (r_st == L or (r_st - q_st == L if o > L else r_st >= o and q_en <= o)):
            continue
        if total <= p.min_junc_score:
            want[chrom, start, end, strand] = (score, 0, 0, 0, "low score")
            continue
        mid = lambda s: s if len(s) <= 30 else s[(len(s) - 30) // 2 :][:30]
        probes = [mid(r[r_st:r_en]), mid(q[q_st:q_en]), r[o - 15 : o] + q[o : o + 15] if len(r) >= o and len(q) >= o + 15 else ""]
        c1, c2, ch = (plain_places(x, genome, spurious.allowed(len(x))) if x else 0 for x in probes)
        a = p.anchor
        far = len(r) >= o + a and len(q) >= o + a and sum(x != y for x, y in zip(r[o - a : o + a], q[o - a : o + a], strict=True)) > 2
        if r_en >= o + a - 1 and r_st <= o - a and q_en >= o + a - 1 and q_st <= o - a and abs(r_st - q_st) <= 2 * a:
            bad = not ((c1 == 1 or c2 == 1) and ch == 0)
        else:
            bad = not ((q_st - r_st >= p.min_duplicate_exon_length and ch == 0) or ((c1 < 10 or c2 < 10) and (ch == 0 or far)))
        if bad:
            want[chrom, start, end, strand] = (score, c1, c2, ch, "repeat")
    rows = engine.detect(junctions, tiles, sizes, trusted).collect()
    got = {(r["chrom"], r["start"], r["end"], r["strand"]): (r["align_score"], r["seq1_count"], r["seq2_count"], r["seqh_count"], r["reason"]) for r in rows}
    assert got == want and {x[-1] for x in want.values()} == {"low score", "repeat"}


def test_command_line(spark, tmp_path, capsys, large_bam):
    from junctura import cli

    rng = random.Random(31)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    seq = seq[:1500] + seq[450:550] + seq[1600:]  # the flanks of [500, 1550) are alike
    fasta = write(tmp_path / "g.fa", ">x a contig\n" + "\n".join(seq[i : i + 60] for i in range(0, 3000, 60)) + "\n>y\n" + seq[::-1] + "\n")
    bed = write(tmp_path / "j.bed", "x\t500\t1550\tj\t3\t+\nx\t700\t900\tj\t5\t-\n")
    kept, removed = tmp_path / "kept.bed", tmp_path / "removed.bed"
    assert cli.main(["--bed", bed, "-r", fasta, "--out_kept_junctions", str(kept), "--out_removed_junctions", str(removed), "-k", "3", "-w", "2"]) == 0
    lines = (kept.read_text() + removed.read_text()).splitlines()
    assert sorted(x.split("\t")[1] for x in lines) == ["500", "700"] and all(x.split("\t")[3] == "JUNC1" for x in lines if len(lines) == 2)
    sam = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:x\tLN:3000", "@SQ\tSN:y\tLN:3000"]
    sam += [f"r{i}\t0\tx\t{491}\t60\t10M1050N20M\t*\t0\t0\t{'A' * 30}\t{'I' * 30}\tXS:A:+\tNH:i:1" for i in range(2)] + [f"s\t0\tx\t691\t60\t10M200N20M\t*\t0\t0\t{'A' * 30}\t*\tXS:A:-"]
    path = write(tmp_path / "reads.sam", "\n".join(sam) + "\n")
    out = tmp_path / "filtered.bam"
    assert cli.main(["--bam", path, "-r", fasta, "-i", str(tmp_path / "g_tiles"), "--out_removed_junctions", str(removed), "--out_original_junctions", str(kept), "--out_filtered_bam", str(out), "--removed_alignments_bam"]) == 0
    assert [x.split("\t")[1:3] for x in kept.read_text().splitlines()] == [["500", "1550"], ["700", "900"]]
    gone = {x.split("\t")[1] for x in removed.read_text().splitlines()}
    left = [r[2] for r in bam.records(str(out), "s")]
    other = [r[2] for r in bam.records(str(tmp_path / "filtered_removed_alignments.bam"), "s")]
    assert left == (["r0", "r1"] if "500" not in gone else []) + (["s"] if "700" not in gone else []) and sorted(left + other) == ["r0", "r1", "s"]
    (tmp_path / "a.cram").write_bytes(b"CRAM\x03")
    assert cli.main(["--bam", str(tmp_path / "a.cram"), "-r", fasta]) == 1 and "CRAM" in capsys.readouterr().err
    assert cli.main(["--bed", str(tmp_path / "none.bed"), "-r", fasta]) == 1 and "error: " in capsys.readouterr().err
    assert cli.main(["--bed", write(tmp_path / "bad.bed", "x\t5\t4\tj\t1\t+\n"), "-r", fasta]) == 1 and "start beyond end" in capsys.readouterr().err


def test_one_builder_of_a_genome_waits_for_the_other(spark, tmp_path):
    from junctura.plans import engine

    fasta = write(tmp_path / "g.fa", ">x\nACGT\n")
    (tmp_path / "t.lock").write_text("")
    with pytest.raises(OSError, match="built by another run"):
        engine.build_genome(spark, fasta, str(tmp_path / "t"), patience=0)
    (tmp_path / "t.lock").unlink()
    assert [tuple(r) for r in engine.build_genome(spark, fasta, str(tmp_path / "t"))[1].collect()] == [("x", 4)]
    assert not (tmp_path / "t.lock").exists()


def test_match_counts_at_three_mismatches_against_brute_force(spark):
    from junctura.operators import spurious

    rng = random.Random(6)
    genome = {c: "".join(rng.choice("ACGT") for _ in range(1500)) for c in ("a", "b")}
    flip = str.maketrans("ACGT", "TGCA")
    probes = []
    for i in range(24):
        seq = list(genome["ab"[i % 2]][60 * i : 60 * i + 30])
        for at in rng.sample(range(30), i % 5):
            seq[at] = rng.choice([x for x in "ACGT" if x != seq[at]])
        seq = "".join(seq)
        probes.append(seq[::-1].translate(flip) if i % 3 == 0 else seq)
    # Copies with two and three differences, one across the border of tiles.
    for at, n in ((985, 2), (300, 3)):
        copy = list(probes[1])
        for x in rng.sample(range(30), n):
            copy[x] = "ACGT"[("ACGT".index(copy[x]) + 1) % 4]
        genome["b"] = genome["b"][:at] + "".join(copy) + genome["b"][at + 30 :]
    tiles = [(c, t, s[t * 1000 : t * 1000 + 1200]) for c, s in genome.items() for t in range(2)]
    made = spark.createDataFrame([("a", i, i + 1, "+", "seqh", p) for i, p in enumerate(probes)], "chrom string, start long, end long, strand string, type string, seq string")

    def places(p, most):
        both = (p, p[::-1].translate(flip))
        return min(11, sum(sum(x != y for x, y in zip(q, s[i : i + 30], strict=True)) <= most for q in both for s in genome.values() for i in range(len(s) - 29)))

    got = {r["start"]: r["hits"] for r in spurious.match_counts(made, spark.createDataFrame(tiles, "chrom string, tile long, seq string")).collect()}
    assert got == {i: places(p, 3) for i, p in enumerate(probes)}
    assert got != {i: places(p, 1) for i, p in enumerate(probes)}


def test_registered_searches_use_the_default_mismatches(spark, monkeypatch):
    from junctura import queries
    from junctura.operators import spurious

    seen, search = [], spurious.match_counts

    def recorded(made, genome, p=DEFAULT, mismatches=None):
        seen.append(p.mismatches if mismatches is None else mismatches)
        return search(made, genome, p, mismatches)

    monkeypatch.setattr(spurious, "match_counts", recorded)
    for name in ("probe_mismatch_counts", "spurious_end_to_end"):
        queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert seen == [DEFAULT.mismatches] * 2 == [3, 3]


def test_streams_close_earlier_contigs_and_flush_the_rest(spark, tmp_path):
    from junctura.streaming import junction_stream as stream

    kind = "source string, tid int, chrom string, pos long, flag int, cigar string, xs string"
    # Both sources end on c1 before the junction 110-210 does; d has none of c3; c3 is never passed.
    batches = [
        [("a", 0, "c1", 100, 0, "10M100N10M", "+"), ("d", 0, "c1", 100, 0, "10M100N10M", "+")],
        [("a", 1, "c2", 100, 0, "10M50N10M", "-")],
        [("d", 1, "c2", 100, 0, "10M50N10M", "-"), ("d", 1, "c2", 400, 0, "20M", "+"), ("a", 2, "c3", 50, 0, "10M30N10M", "+")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        read = stream.read_alignments_stream(spark, str(tmp_path / "in"), kind)
        run = stream.completed(read, 2, ["c1", "c2", "c3"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination()
        done = {tuple(r) for r in spark.read.schema(stream.OUT).parquet(str(tmp_path / "out")).collect()} if i else set()
        left = {tuple(r) for r in stream.flush(spark, str(tmp_path / "check")).collect()}
        if i == 1:
            assert done == set() and left == {("c1", 110, 210, "+", 2), ("c2", 110, 160, "-", 1)}
    assert done == {("c1", 110, 210, "+", 2), ("c2", 110, 160, "-", 2)} and left == {("c3", 60, 90, "+", 1)}


def test_a_stream_shuffles_a_row_a_junction_and_partition_not_a_row_an_alignment(spark):
    from junctura.streaming import junction_stream as stream

    rows = spark.range(0, 60_000, 1, 3).selectExpr("if(id % 2 = 0, 'a', 'd') as source", "cast(0 as int) as tid", "concat('c', 1 + id % 2) as chrom", "id % 5 * 10 as pos", "0 as flag", "if(id % 10 = 7, '30M', '10M100N10M20N5M') as cigar", "'+' as xs")
    got = stream.combined(stream.progress(rows), ["c1", "c2"]).collect()
    assert len(got) <= 3 * (2 * 5 * 2 + 2 * 2 + 2)
    counts, places = {}, {(r.source, r.chrom, r.pos, r.closed) for r in got if not r.n}
    for r in (r for r in got if r.n):
        counts[r.chrom, r.start, r.end] = counts.get((r.chrom, r.start, r.end), 0) + r.n
    assert counts == {(f"c{c}", 10 * x + s, 10 * x + s + n): 6000 for c in (1, 2) for x in range(5) for s, n in ((10, 100), (120, 20)) if (c, x) != (2, 2)}
    # The source on the second contig has left the first, each in its own partition.
    assert places == {("a", "c1", 40, False), ("d", "c2", 40, False), ("d", "c1", 0, True)}


def test_search_sends_probes_in_passes_and_keeps_the_genome_where_it_is(spark, monkeypatch):
    """Odd characters, lengths of one to 70, several passes, repeats of a probe's blocks; and no row a place of the genome in the plan."""
    from junctura.operators import spurious

    monkeypatch.setattr(spurious, "PROBES_A_PASS", 9, raising=False)
    rng = random.Random(33)
    genome = {c: "".join(rng.choice("ACGT" if c != "z" else "ACGTRYNa") for _ in range(1400)) for c in "xyz"}
    genome["x"] = genome["x"][:700] + "ACG" * 60 + genome["x"][700:]
    probes = ["ACG" * 10, "A", "AC", "R" * 12, "CGACGACGACGACGACGACGAC", genome["z"][40:70].replace("N", "R"), genome["z"][100:130].replace("N", "Y"), "中CGTACGTACGTACGTACGT"]
    for n in (2, 3, 5, 9, 12, 15, 19, 20, 21, 29, 30, 31, 32, 33, 40, 64, 70):
        seq = list(genome["xyz"[n % 3]][13 * n : 14 * n])
        for at in rng.sample(range(n), min(3, n // 10)):
            seq[at] = rng.choice("ACGTR")
        probes.append("".join(seq))
    kind = "chrom string, start long, end long, strand string, type string, seq string"
    made = spark.createDataFrame([("a", i, i + 1, "+", "seq1", p) for i, p in enumerate(probes)], kind)
    counted = spurious.match_counts(made, spark.createDataFrame(tile_rows(genome), "chrom string, tile long, seq string"))
    got = {r["start"]: r["hits"] for r in counted.collect()}
    assert got == {i: 0 if "N" in p or len(p) < 2 or p[0] > "z" else plain_places(p, genome, spurious.allowed(len(p))) for i, p in enumerate(probes)}
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") >= 2


def test_fates_by_one_shuffle_of_the_alignments_against_plain_rules(spark):
    """Twins, quotas, mates at the same place, NH, and nulls, on random reads; the alignments are shuffled once, by name, and joined to nothing but the junctions."""
    from junctura.operators import filtering

    rng = random.Random(44)
    kind = "sample string, file_ord long, qname string, flag int, chrom string, pos long, mpos long, cigar string, nh int, tlen long, xs string"
    cigars = ["30M", "10M20N10M", "10M20N5M20N10M", "10M40N10M", "5M30N20M"]
    reads = [(rng.choice(["s", "t", None] if i % 9 == 0 else ["s"]), i, rng.choice(["a", "b", "c", None]), rng.choice([65, 129, 1, 0, 69, 129]), rng.choice(["c1", "c1", "c2", None]), rng.choice([0, 10]), rng.choice([0, 10, 10, None]), rng.choice(cigars), rng.randrange(1, 40), 300, "+") for i in range(600)]
    reads = [(*r[:5], r[5], r[6], r[7], r[8], r[9], rng.choice("+-")) for r in reads]
    spurious = [("c1", 10, 30, "+"), ("c1", 35, 55, "+"), ("c2", 20, 60, "-")]

    def uses(r):
        at, found = r[5], set()
        for n, op in re.findall(r"(\d+)(\w)", r[7].replace("N", "N ").replace("M", "M ")):
            if op == "N":
                found.add((r[4], at, at + int(n), r[10]))
            at += int(n)
        return not r[3] & 4 and r[4] is not None and r[0] is not None and bool(found & set(spurious))

    pair = lambda f: 1 if f & 64 else 2 if f & 128 else 0
    place = lambda r, a, b: (r[0], r[2], r[4] or "*", r[a], r[b])
    bad = [r for r in reads if uses(r)]
    hit = {(*place(r, 5, 6), r[7]) for r in bad if None not in place(r, 5, 6)}
    quota, less, turn = Counter(place(r, 5, 6) for r in bad), Counter((r[0], r[2], pair(r[3])) for r in bad), Counter()
    want = {True: {}, False: {}}
    for r in (r for r in reads if not r[3] & 4):
        gone, key = (*place(r, 5, 6), r[7]) in hit, place(r, 6, 5)
        asks = not gone and r[3] & 1 and None not in key and quota[key] > 0
        turn[key] += bool(asks)
        mate = bool(asks) and turn[key] <= quota[key]
        fewer = r[8] - less[r[0], r[2], pair(r[3])]
        for remove in want:
            fate = "removed" if gone else "mate" if mate and remove else None
            free = mate and not remove
            nh = fewer if fate is None and asks and fewer > 0 else r[8]
            want[remove][r[1]] = (fate, r[3] & ~11 if free else r[3], 0 if free else 300, r[5] if free else r[6], nh)
    rows = spark.createDataFrame(reads, kind)
    for remove in want:
        got = filtering.filtered(rows, spark.createDataFrame(spurious, "chrom string, start long, end long, strand string"), remove)
        assert got.columns == rows.columns + ["fate"]
        assert {r.file_ord: (r.fate, r.flag, r.tlen, r.mpos, r.nh) for r in got.collect()} == want[remove]
    assert len({f for f, *_ in want[True].values()}) == 3
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("RepartitionByExpression") == 1


def test_flanks_meet_the_genome_once_and_keep_every_row(spark):
    """Both flanks by one join with the tiles; repeated junctions, lists and nulls beside them stay, and what lies on no contig goes."""
    from junctura.operators import spurious

    rng = random.Random(55)
    genome = {"a": "".join(rng.choice("acgt") for _ in range(2500)), "b": "".join(rng.choice("ACGT") for _ in range(60))}
    found = [("a", 990, 1990, "+", [1, 2], None), ("a", 990, 1990, "+", [3], "x"), ("a", 990, 1990, None, None, "y"), ("a", 10, 2490, ".", [], "z"), ("b", 20, 45, "-", [4], "u"), ("b", 20, 500, "-", [5], "v"), ("c", 20, 45, "-", [6], "w")]
    rows = spark.createDataFrame(found, "chrom string, start long, end long, strand string, samples array<int>, note string")
    tiles = spark.createDataFrame(tile_rows(genome), "chrom string, tile long, seq string")
    sizes = spark.createDataFrame([(c, len(s)) for c, s in genome.items()], "chrom string, length long")
    got = spurious.flank_sequences(rows.select("samples", *rows.columns[:4], "note"), tiles, sizes)
    assert got.columns == ["samples", "chrom", "start", "end", "strand", "note", "rstart", "rend", "qstart", "qend", "rseq", "qseq"]

    def cut(c, at):
        return genome[c][max(at - 50, 0) : at + 50].upper()

    want = sorted((repr((*r, cut(r[0], r[1]), cut(r[0], r[2]))) for r in found[:5]))
    assert sorted(repr((r.chrom, r.start, r.end, r.strand, r.samples, r.note, r.rseq, r.qseq)) for r in got.collect()) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
