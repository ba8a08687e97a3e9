"""Readers and writers on small files, the annotation end to end, composite runs, streaming."""

import gzip
import struct
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from isospark.__main__ import parser
from isospark.model import Params, preset
from isospark.plans import annotate, suites
from isospark.sources import sam, text
from isospark.streaming import ends as streaming


@pytest.fixture(autouse=True)
def checkpoints(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="isospark-"))


FIVE = Params().five_adapter
SEQ = "".join("ACGTTGCAGGATCCTAAGCT"[(i * 7 + i // 3) % 20] for i in range(1200))


def sam_text():
    """Ten spliced reads of one isoform (introns 301..400 of the contig) and two without clips."""
    rows = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:1200"]
    body = SEQ[200:300] + SEQ[400:500]
    for i in range(10):
        rows.append(f"r{i}\t0\tchr1\t201\t60\t31S100M100N100M30S\t*\t0\t0\t{FIVE + body + 'A' * 30}\t*\tNM:i:0")
    rows.append(f"bare\t0\tchr1\t201\t60\t100M100N100M\t*\t0\t0\t{body}\t*")
    rows.append(f"un\t4\t*\t0\t0\t*\t*\t0\t0\t{body}\t*")
    rows.append("short\tline")
    return "\n".join(rows) + "\n"


def test_annotation_end_to_end(spark, tmp_path):
    (tmp_path / "a.sam").write_text(sam_text())
    (tmp_path / "g.fa").write_text(">chr1 test\n" + "\n".join(SEQ[i : i + 60] for i in range(0, 1200, 60)) + "\n>chr2\nACGT\n")
    genome = text.read_fasta(spark, str(tmp_path / "g.fa"))
    assert {(r.contig, r.seq) for r in genome.collect()} == {("chr1", SEQ), ("chr2", "ACGT")}
    reads = sam.read_sam(spark, str(tmp_path / "a.sam"))
    first = reads.where("qname = 'r0'").first()
    assert (reads.count(), first.start, first.end, first.tags) == (12, 201, 500, {"NM": "0"})
    p = Params(shs_for_ts=40)  # no base of either clip matches the genome by chance so far in
    a = annotate.annotate(reads, genome, p)
    assert [(r.contig, r.pos, r.strand, r.cnt) for r in a.tss.collect()] == [("chr1", 201, "+", 10)]
    assert [(r.contig, r.pos, r.strand, r.cnt) for r in a.tes.collect()] == [("chr1", 500, "+", 10)]
    assert [(r.left, r.right) for r in a.introns.collect()] == [(300, 401)]
    strand = a.introns.first().strand
    t = a.transcripts.collect()
    assert len(t) == (1 if strand in ("+", ".") else 0)
    if t:
        assert (t[0].ts, t[0].te, t[0].reads, t[0].qualified) == (201, 500, 10, True)
        table = annotate.transcript_table(a.transcripts).first()
        assert table.id == "tr1" and [tuple(e) for e in table.exons] == [(201, 300), (401, 500)]
    suites.run_annotation(spark, str(tmp_path / "a.sam"), str(tmp_path / "g.fa"), str(tmp_path / "out"), p)
    gff = text.read_gff(spark, str(tmp_path / "out" / "tss.gff3"))
    assert [(r.start, r.score) for r in gff.collect()] == [(201, 10.0)]
    back = sam.read_sam(spark, str(tmp_path / "out" / "reads.sam"))
    assert back.count() == 11 and back.where("qname = 'r3'").first().tags["l5"].endswith("correct")
    empty = annotate.annotate(reads.limit(0), genome, p)
    assert empty.tss.count() == empty.transcripts.count() == 0


def bgzf(data: bytes) -> bytes:
    out = b""
    for i in range(0, len(data), 100):
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = data[i : i + 100]
        body = z.compress(part) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(part), len(part))
    return out


def test_bam(spark, tmp_path):
    def record(name, ops, seq, flag, pos, tags=b""):
        n = len(seq)
        code = "=ACMGRSVTWYHKDBN"
        packed = bytes(code.index(seq[i]) << 4 | (code.index(seq[i + 1]) if i + 1 < n else 0) for i in range(0, n, 2))
        b = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, len(ops), flag, n, -1, -1, 0) + name.encode() + b"\0"
        b += b"".join(struct.pack("<I", k << 4 | "MIDNSHP=X".index(o)) for k, o in ops) + packed + b"\xff" * n + tags
        return struct.pack("<i", len(b)) + b

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    data = head + record("a", [(3, "S"), (7, "M")], "ACGTACGTAC", 0, 9, b"NMi" + struct.pack("<i", 2) + b"XZZhi\0" + b"XBBc" + struct.pack("<i2b", 2, 1, -2)) + record("b", [(5, "M")], "ACGTA", 16, 99)
    (tmp_path / "x.bam").write_bytes(bgzf(data))
    rows = {r.qname: r for r in sam.read_bam(spark, f"file://{tmp_path}/x.bam").collect()}
    assert (rows["a"].cigar, rows["a"].seq, rows["a"].start, rows["a"].end, rows["a"].tags) == ("3S7M", "ACGTACGTAC", 10, 16, {"NM": "2", "XZ": "hi", "XB": "c,1,-2"})
    assert (rows["b"].flag, rows["b"].seq, rows["b"].contig) == (16, "ACGTA", "chr1")


GFF = """##gff-version 3
chr1\ts\tmRNA\t10\t90\t5\t+\t.\tID=t1;gene_id=g1
chr1\ts\texon\t60\t90\t.\t+\t.\tParent=t1,t2
chr1\ts\texon\t10\t30\t.\t+\t.\tParent=t1
chr1\ts\tmRNA\t60\t90\t.\t-\t.\tID=t2;read_count=7
chr1\ts\tmRNA\t200\t100\t.\t?\t.\tID=t3
chr1\ts\tmRNA\tx\t100\t.\t+\t.\tID=bad
too\tshort
"""


def test_gff(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(GFF.replace("\n", "\r\n"))
    with gzip.open(tmp_path / "b.gff3.gz", "wt") as f:
        f.write(GFF)
    for name in ("a.gff3", "b.gff3.gz"):
        g = text.read_gff(spark, str(tmp_path / name))
        t = {r.id: r for r in text.transcripts_of_gff(g).collect()}
        assert set(t) == {"t1", "t2", "t3"}
        assert [tuple(e) for e in t["t1"].exons] == [(10, 30), (60, 90)] and t["t1"].reads == 5.0
        assert [tuple(e) for e in t["t2"].exons] == [(60, 90)] and t["t2"].reads == 7.0
        assert (t["t3"].start, t["t3"].end, t["t3"].strand, t["t3"].reads) == (100, 200, ".", 0.0)
    gtf = [r.info for r in text.gff3_to_gtf(g).where("feature = 'exon' and info like '%t1%'").collect()]
    assert gtf == ['gene_id "g1"; transcript_id "t1"; exon_number "1";', 'gene_id "g1"; transcript_id "t1"; exon_number "2";']


def test_tables(spark, tmp_path):
    (tmp_path / "b.bed").write_text("1\t9\t20\tn\t0\t+\nchr2 4 4 g . -\nbad\nchr3\tx\t4\tn\t0\t+\n")
    bed = text.read_bed(spark, str(tmp_path / "b.bed"), "add")
    assert {(r.contig, r.lo, r.hi) for r in text.bed_intervals(bed, 2).collect()} == {("chr1", 8, 22), ("chr2", 3, 6)}
    assert {(r.contig, r.lo, r.hi) for r in text.bed_points(bed, 10, "bed0_to_1based").collect()} == {("chr1", 1, 20), ("chr2", 1, 15)}
    (tmp_path / "m.tsv").write_text("Chem\tCell\tPath\r\nx\ty\tz\r\n\r\na b c\n")
    assert [tuple(r) for r in text.read_manifest(spark, str(tmp_path / "m.tsv"), ["chem", "cell", "path"]).collect()] == [("x", "y", "z"), ("a", "b", "c")]
    (tmp_path / "d.tsv").write_text("chr1\t5\t7\nchr1\tx\t7\n\nchr2\t1\nchr3\t1\t2\n")
    assert [tuple(r) for r in text.read_depth(spark, str(tmp_path / "d.tsv"), spark.createDataFrame([("chr1",)], "contig string")).collect()] == [("chr1", 5, 7)]
    (tmp_path / "t.tsv").write_text("﻿Transcript_ID\tStart\nq\t5\n")
    assert text.read_table(spark, str(tmp_path / "t.tsv"), {"id": ["name", "transcript_id"], "start": ["start"]}).first().id == "q"
    assert [p.rsplit("/", 1)[1] for p in text.find_tables(spark, str(tmp_path), ["Transcript_ID"])] == ["t.tsv"]
    assert suites.method_of("/x/toolA/1/") == "toolA_rep1" and suites.method_of("/x/toolA/chr5") == "toolA"


def tx(spark, rows):
    return spark.createDataFrame(rows, "sample string, contig string, strand string, start long, end long, exons array<struct<s:long,e:long>>, reads double")


def test_merge_and_evaluate(spark):
    a = [("s1", "c", "+", 10, 90, [(10, 30), (60, 90)], 3.0), ("s2", "c", "+", 12, 91, [(12, 30), (60, 91)], 4.0), ("s2", "c", "+", 12, 91, [(12, 31), (60, 91)], 1.0), ("s1", "c", "-", 5, 9, [(5, 9)], 1.0)]
    got = suites.merge_samples(tx(spark, a), ["s1", "s2"], window=5).orderBy("id").collect()
    assert [(r.id, r.start, r.end, r.s1, r.s2) for r in got] == [("TR_000001", 10, 91, 3.0, 4.0), ("TR_000002", 12, 91, 0.0, 1.0), ("TR_000003", 5, 9, 1.0, 0.0)]
    ref = tx(spark, a[:1] + a[3:]).select(F.concat("sample", F.col("start").cast("string")).alias("rid"), "contig", "strand", "start", "end", "exons")
    pred = tx(spark, a[1:3] + [("s2", "c", "-", 500, 600, [(500, 600)], 1.0), ("s2", "c", "-", 505, 600, [(505, 600)], 1.0)]).select(F.col("sample").alias("file"), F.concat(F.col("start").cast("string"), F.col("reads").cast("string")).alias("pid"), "contig", "strand", "start", "end", "exons")
    out = suites.evaluate_files(ref, pred)
    (s,) = out["stats"].collect()
    assert (s.file, s.tp, s.fp, s.fn, s.precision, s.recall) == ("s2", 1, 2, 1, pytest.approx(1 / 3), 0.5)
    assert [r.rid for r in out["not_found"].collect()] == ["s15"]
    assert len({r.seed for r in out["false_positives"].collect()}) == 1
    rows = tx(spark, a).withColumn("idx", F.monotonically_increasing_id()).withColumnRenamed("sample", "source")
    assert suites.cluster_tables(rows).select("component").distinct().count() == 2
    assert suites.cluster_tables(rows, greedy=True).select("component").distinct().count() == 3


def test_boundary_runs(spark):
    pred = spark.createDataFrame([("A", "c", "+", 10), ("A", "c", "+", 50), ("B", "c", "+", 11)], "run string, contig string, strand string, pos long")
    ref = spark.createDataFrame([(r, "c", "+", 5, 15) for r in "AB"] + [("B", "c", "-", 5, 15)], "run string, contig string, strand string, lo long, hi long")
    got = {r.run: (r.tp, r.fp, r.fn) for r in suites.boundary_benchmark(pred, ref, ["run"]).collect()}
    assert got == {"A": (1, 1, 0), "B": (1, 0, 1)}
    yes, no = suites.active_references(pred.where("run = 'A'"), ref.where("run = 'B'"), 2)
    assert (yes.count(), no.count()) == (1, 1)
    lines = spark.createDataFrame([('x\tgene_id "g"; transcript_id "t.1";',), ('x\tgene_id "g";',), ('x\tgene_id "h"; transcript_id "u.1";',), ('x\tgene_id "h";',)], "value string")
    assert suites.active_gtf(lines, spark.createDataFrame([("t.2",)], "id string"), strip=True).count() == 2


def test_streaming_counts_equal_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text(sam_text())
    q = streaming.count_stream(streaming.stream_sam(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("ends_so_far").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("ends_so_far").collect()))
    batch = streaming.count_stream(spark.read.text(str(tmp_path / "in"))).collect()
    assert got and got == sorted(map(tuple, batch))


def test_command_line():
    args = parser().parse_args(["annotate", "a", "g", "o", "--preset", "direct-rna", "--wobble", "12", "--no-drna"])
    assert args.wobble == 12 and args.drna is False and args.ratio is None
    assert preset("direct-rna").check_in_soft == 6 and preset("direct-rna", wobble=3).wobble == 3


def test_file_commands(spark, tmp_path):
    from isospark.__main__ import main

    (tmp_path / "s1.gff3").write_text(GFF)
    (tmp_path / "s2.gff3").write_text(GFF.replace("10\t90", "11\t90").replace("10\t30", "11\t30"))
    files = [str(tmp_path / f) for f in ("s1.gff3", "s2.gff3")]
    (tmp_path / "ref.tsv").write_text("Isoform\tChromosome\tStart\tEnd\tStrand\tExon_composition\tReads\tx_present\nq\tchr1\t90\t10\t+\t10-30;60-90\t1,000\t\nr\tchr1\tx\t5\t+\t\t1\t1\nu\tchr9\t5\t9\t-\t\t\t1\n")
    ref = text.read_transcript_table(spark, str(tmp_path / "ref.tsv"), "ref").collect()
    assert [(r.contig, r.start, r.end, r.reads, r.ref__x_present, [tuple(e) for e in r.exons]) for r in ref] == [("chr1", 10, 90, 1000.0, "0", [(10, 30), (60, 90)]), ("chr9", 5, 9, 0.0, "1", [(5, 9)])]
    main(["merge", str(tmp_path / "merged"), *files, "--window", "5"], spark)
    merged = text.read_table(spark, str(tmp_path / "merged" / "transcripts")).collect()
    assert [(r.start, r.end, r.s1, r.s2) for r in merged if ";" in r.exon_composition] == [("10", "90", "5", "5")]
    main(["evaluate", str(tmp_path / "eval"), str(tmp_path / "ref.tsv"), *files], spark)
    got = text.read_table(spark, str(tmp_path / "eval" / "stats")).collect()
    assert [(r.file, r.tp, r.fp, r.fn) for r in got] == [("s1", "1", "2", "1"), ("s2", "1", "2", "1")]
    main(["sum", str(tmp_path / "sum"), *files], spark)
    assert text.read_table(spark, str(tmp_path / "sum")).count() > 0
    assert {r.name for r in text.read_positions(spark, files[0]).collect()} == {"t1", "t2", ""}
    assert text.existing(spark, str(tmp_path / "s"), ["9.gff3", "2.gff3"]).endswith("s2.gff3")


def test_small_functions(spark):
    from isospark.functions import scalar as S

    df = spark.createDataFrame([(None, [1.0, None, 4.0], "/d/K562_ONT_bambu.txt"), (7.0, [], "/d/a.TSS.gtf"), (None, [], "x_tes.gff")], "score double, x array<double>, path string")
    got = df.select(*[S.support_count("score", "x", m).alias(m) for m in ("max", "mean", "sum", "first")], S.run_names("path").alias("run"), S.default_tag("path").alias("tag")).collect()
    assert [tuple(r)[:4] for r in got] == [(4.0, 2.5, 5.0, 1.0), (7.0,) * 4, (1.0,) * 4]
    assert tuple(got[0].run) == ("K562", "ONT", "bambu") and got[1].run.cell_line is None and [r.tag for r in got] == [None, "TSS", "TES"]
    one = spark.createDataFrame([([(1, 5), (8, 9)],), ([(1, 5)],)], "x array<struct<s:long,e:long>>").select(S.inner_signature("x").alias("i")).collect()
    assert [r.i for r in one] == [[5, 8], []]


def test_sam_round_trip(spark, tmp_path):
    """Header, order, qualities, mates and tags survive; new tags replace those of the same letters."""
    (tmp_path / "a.sam").write_text(
        "@HD\tVN:1.6\n@SQ\tSN:chr2\tLN:90\n"
        "q1\t99\tchr2\t30\t60\t5M\t=\t40\t15\tACGTA\tIIIII\tNM:i:0\tXA:Z:a:b c\tAS:f:1.5\tXB:B:c,1,2\n"
        "q2\t16\tchr1\t7\t9\t3S2M\t*\t0\t0\tACGTA\t#####\tl5:Z:old\n"
        "q3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"
    )
    reads = sam.read_sam(spark, str(tmp_path / "a.sam")).withColumn("mark", F.when(F.col("qname") == "q2", "new"))
    sam.write_sam(reads, str(tmp_path / "b.sam"), {"l5:Z": "mark"}, spark.createDataFrame([("chr1", 50), ("chr2", 90)], "contig string, length int"))
    parts = sorted(p for p in (tmp_path / "b.sam").iterdir() if p.name.startswith("part-"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[:4] == ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr1\tLN:50", "@SQ\tSN:chr2\tLN:90", "@PG\tID:isospark\tPN:isospark"]
    assert [x.split("\t")[0] for x in lines[4:]] == ["q2", "q1", "q3"]
    assert lines[5].split("\t")[:11] == ["q1", "99", "chr2", "30", "60", "5M", "=", "40", "15", "ACGTA", "IIIII"] and set(lines[5].split("\t")[11:]) == {"NM:i:0", "XA:Z:a:b c", "AS:f:1.5", "XB:B:c,1,2"}
    assert lines[4].split("\t")[11:] == ["l5:Z:new"]
    back = sam.read_sam(spark, str(tmp_path / "b.sam"))
    key = lambda df: {r.qname: r for r in df.drop("mark").collect()}
    old, new = key(reads), key(back)
    assert old["q1"] == new["q1"] and old["q3"] == new["q3"] and new["q2"].tags == {"l5": "new"}


def both_strands():
    """Two plus reads at 201 under very many minus reads that cover the same place."""
    rows = ["@SQ\tSN:chr1\tLN:1200"]
    turn = str.maketrans("ACGT", "TGCA")
    body = SEQ[200:400]
    plus = FIVE + body + "A" * 30
    minus = "T" * 30 + SEQ[100:600] + FIVE.translate(turn)[::-1]
    rows += [f"p{i}\t0\tchr1\t201\t60\t31S200M30S\t*\t0\t0\t{plus}\t*" for i in range(2)]
    rows += [f"m{i}\t0\tchr1\t101\t60\t30S500M31S\t*\t0\t0\t{minus}\t*" for i in range(2500)]
    return "\n".join(rows) + "\n"


def test_each_strand_has_its_own_depth(spark, tmp_path):
    (tmp_path / "a.sam").write_text(both_strands())
    genome = spark.createDataFrame([("chr1", SEQ)], "contig string, seq string")
    reads = sam.read_sam(spark, str(tmp_path / "a.sam"))
    p = Params(shs_for_ts=40, ratio=0.01, coverage_mode="inward")
    a = annotate.annotate(reads, genome, p)
    assert {(r.pos, r.strand, r.cnt, r.coverage) for r in a.tss.collect()} == {(201, "+", 2, 2.0), (600, "-", 2500, 2500.0)}
    assert {(r.pos, r.strand, r.cnt) for r in a.tes.collect()} == {(400, "+", 2), (101, "-", 2500)}
    depth = {(r.track, r.seg_start, r.seg_end, r.depth) for r in annotate.depth(a.reads).collect()}
    assert ("+", 201, 400, 2) in depth and ("-", 101, 600, 2500) in depth and ("all", 201, 400, 2502) in depth
    # On direct RNA flags stay whole, and secondary alignments do not count towards depth.
    drna = spark.createDataFrame([("a", 16 + 256, "chr1"), ("b", 2048, "chr1")], "qname string, flag int, contig string")
    from isospark.operators import ends

    assert {(r.qname, r.flag, r.mapq) for r in ends.assign_strand(drna, True).collect()} == {("a", 272, 9), ("b", 2048, 9)}
    assert [r.qname for r in ends.counted_in_depth(drna).collect()] == ["b"]


def test_stages_give_what_annotate_gives(spark, tmp_path):
    from isospark.__main__ import main

    (tmp_path / "a.sam").write_text(sam_text())
    (tmp_path / "g.fa").write_text(">chr1 test\n" + SEQ + "\n")
    d = lambda n: str(tmp_path / n)
    options = ["--shs_for_ts", "40"]
    main(["annotate", d("a.sam"), d("g.fa"), d("whole"), *options], spark)
    main(["label", d("a.sam"), d("labels"), *options], spark)
    main(["stats", d("labels"), d("g.fa"), d("stats"), *options], spark)
    main(["sites", d("stats"), d("features"), *options], spark)
    main(["transcripts", d("labels"), d("features"), d("tx"), *options], spark)
    lines = lambda p: sorted(r.value for r in spark.read.text(p).collect())
    for n in ("tss", "tes", "introns"):
        assert lines(d(f"features/{n}.gff3")) == lines(d(f"whole/{n}.gff3")) != []
    assert lines(d("tx/transcripts.gff3")) == lines(d("whole/transcripts.gff3"))
    tags = {r.qname: r.tags for r in sam.read_sam(spark, d("whole/transcripts.sam")).collect()}
    assert tags["r1"]["ts"] == "201" and tags["r1"]["te"] == "500" and tags["r1"]["NM"] == "0" and "in" in tags["r1"]
    assert {r.qname: r.tags.get("tr") for r in sam.read_sam(spark, d("tx/transcripts.sam")).collect()} == {q: t.get("tr") for q, t in tags.items()}


def test_merge_outputs_and_features(spark, tmp_path):
    from isospark.__main__ import main

    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "s1.gff3").write_text(GFF)
    (folder / "s2.gff3").write_text(GFF.replace("\t5\t", "\t2.5\t"))
    (folder / "empty.gff3").write_text("")
    out = str(tmp_path / "out")
    main(["merge", out, str(tmp_path / "in"), "--sample_attributes", "--collapse"], spark)
    table = {r.isoform: r for r in text.read_table(spark, f"{out}/transcripts").collect()}
    assert table["TR_000001"].exon_composition == "10-30;60-90" and (table["TR_000001"].s1, table["TR_000001"].s2) == ("5", "2.5")
    lines = [r.value for r in spark.read.text(f"{out}/transcripts.gff3").coalesce(1).collect()]
    assert lines[0] == "##gff-version 3" and lines[1].split("\t") == ["chr1", "merge", "mRNA", "10", "90", "7.5", "+", ".", "ID=TR_000001;Name=TR_000001;exon_count=2;exon_comp=10-30;60-90;s1=5;s2=2.5"]
    assert lines[2].endswith("ID=TR_000001.exon1;Parent=TR_000001") and lines[3].split("\t")[3:5] == ["60", "90"]
    introns = text.read_gff(spark, f"{out}/intron.gff3").collect()
    assert [(r.start, r.end, r.score, r.info) for r in introns] == [(31, 59, 7.5, "ID=INTRON_000001;Name=INTRON_000001")]
    sites = {(r.start, r.strand): r.score for r in text.read_gff(spark, f"{out}/tss.gff3").collect()}
    assert sites[10, "+"] == 7.5 and sites[90, "-"] == 2.0  # a transcript without any score counts as one
    (tmp_path / "ref.gff3").write_text("c\tx\tTSS\t10\t10\t.\t+\t.\t.\nc\tx\tintron\t20\t40\t.\t+\t.\t.\nc\tx\tintron\t20\t60\t.\t+\t.\t.\nc\tx\tgene\t1\t9\t.\t+\t.\t.\n")
    (tmp_path / "q1.gff3").write_text("c\tx\tTSS\t12\t12\t3\t+\t.\t.\nc\tx\tTSS\t8\t8\t.\t+\t.\t.\nc\tx\tintron\t21\t41\t5\t+\t.\t.\nc\tx\tTSS\t10\t10\t9\t-\t.\t.\n")
    main(["features", str(tmp_path / "cmp"), str(tmp_path / "ref.gff3"), str(tmp_path / "q1.gff3"), "--window", "2"], spark)
    got = {r.feature_id: (r.type, r.end, r.q1) for r in text.read_table(spark, str(tmp_path / "cmp" / "features")).collect()}
    assert got == {"FT_000001": ("TSS", "10", "4"), "FT_000002": ("intron", "40", "5"), "FT_000003": ("intron", "60", "0")}


def test_boundary_and_report_commands(spark, tmp_path):
    from isospark.__main__ import main

    rows = []
    for tool in ("bambu", "flair", "talon"):
        for cell, at in (("c1", 100), ("c2", 120), ("c3", 140)):
            gtf = tmp_path / f"{cell}_{tool}.gtf"
            n = {"bambu": 1, "flair": 2, "talon": 3}[tool]
            gtf.write_text("".join(f'chr1\ts\ttranscript\t{at + 500 * k}\t{at + 500 * k + 50}\t.\t+\t.\tgene_id "g"; transcript_id "t{k}";\n' for k in range(n)))
            bed = tmp_path / f"{cell}.bed"
            bed.write_text(f"chr1\t{at - 5}\t{at + 5}\tx\t0\t+\n")
            rows.append(f"ONT\t{cell}\t{gtf}\t{bed}\r\n")
    (tmp_path / "m.tsv").write_text("Chemistry\tCell-line\tGTF\tReference\r\n" + "".join(rows))
    main(["boundary", str(tmp_path / "b"), str(tmp_path / "m.tsv")], spark)
    scores = {(r.annotator, r.cell): (r.tp, r.fp, r.fn) for r in text.read_table(spark, str(tmp_path / "b" / "scores")).collect()}
    assert scores["bambu", "c1"] == ("1", "0", "0") and scores["FLAIR", "c2"] == ("1", "1", "0") and len(scores) == 9
    assert text.read_table(spark, str(tmp_path / "b" / "annotators")).count() == 3
    (tmp_path / "c.tsv").write_text("isoform\tstructural_category\tassociated_gene\tlength\ttool\n" + "".join(f"i{k}\t{c}\tg{k % 2}\t1,{k}00\tA\n" for k, c in enumerate(["fusion", "novel_in_catalog", "full-splice_match", "odd"])))
    main(["report", str(tmp_path / "r"), str(tmp_path / "c.tsv"), "--by", "tool"], spark)
    assert [r.category for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "r" / "categories")).collect()] == ["full_splice_match", "novel_in_catalog", "fusion", "ALL", "odd"]
    (tmp_path / "t1.tsv").write_text("Transcript_ID\tChromosome\tStart\tEnd\tStrand\tExon_composition\tx_present\na\tc\t10\t90\t+\t10-30;60-90\t1\nb\tc\t500\t600\t+\t\t\n")
    (tmp_path / "t2.tsv").write_text("Transcript_ID\tChromosome\tStart\tEnd\tStrand\tExon_composition\td\tc\nz\tc\t12\t91\t+\t12-30;60-91\t0\t0\n")
    main(["clusters", str(tmp_path / "cl"), str(tmp_path / "t1.tsv"), str(tmp_path / "t2.tsv")], spark)
    got = {r.Cluster_ID: r for r in text.read_table(spark, str(tmp_path / "cl")).collect()}
    assert (got["CLUST_000001"].Original_Transcript_ID, got["CLUST_000001"].Start, got["CLUST_000001"].End, got["CLUST_000001"].Introns, got["CLUST_000001"].t1__x_present) == ("a;z", "10", "91", "31-59", "1")
    assert got["CLUST_000002"].Original_Transcript_ID == "b" and len(got) == 2
    (tmp_path / "p.tsv").write_text("seqnames\tstrand\tstart\tend\nc\t+\t15\t20\nc\t-\t1\t12\n")
    (tmp_path / "q.tsv").write_text("seqnames\tstrand\tstart\tend\nc\t+\t10\t90\n")
    main(["positions", str(tmp_path / "po"), str(tmp_path / "q.tsv"), str(tmp_path / "p.tsv")], spark)
    assert text.read_table(spark, str(tmp_path / "po")).first().support == "1"
    (tmp_path / "x_tss.gff3").write_text("c\ts\ttss\t5\t5\t2\t+\t.\tp=1\n")
    main(["gtf", str(tmp_path / "g"), str(tmp_path / "x_tss.gff3")], spark)
    assert spark.read.text(str(tmp_path / "g")).first().value.split("\t")[8] == 'gene_id "gene_c_5_+"; transcript_id "tx_c_5_+"; tag "TSS";'


def test_categories_and_active_lines(spark, tmp_path):
    from isospark.functions import scalar as S

    words = ["Intergenic ncRNA ori", "asRNA x", "longer AT", "5' ext", "spliced one", "polycistronic", "complex canonic", "monocistronic", "nc", "zzz", None]
    got = [r.c for r in spark.createDataFrame([(w,) for w in words], "w string").select(S.transcript_class("w").alias("c")).collect()]
    assert got == ["ncRNA", "antisense", "TES isoform", "TSS isoform", "spliced", "polycistronic", "polycistronic", "canonic", "ncRNA", "other", None]
    codes = spark.createDataFrame([("Full-splice match",), ("odd",)], "c string").select(S.category_code("c").alias("k"), S.category_rank(S.category_code("c")).alias("r")).collect()
    assert [tuple(r) for r in codes] == [("FSM", 0), ("ODD", 999)]
    (tmp_path / "a.gtf").write_text('##head\nc\ts\ttranscript\t9\t20\t.\t+\t.\tgene_id "g"; transcript_id "t.1";\nc\ts\tgene\t5\t20\t.\t+\t.\tgene_id "g";\nc\ts\ttranscript\t1\t20\t.\t+\t.\tgene_id "h"; transcript_id "u.1";\n')
    text.write_active_gtf(spark, str(tmp_path / "a.gtf"), spark.createDataFrame([("t.1",)], "id string"), str(tmp_path / "o"))
    assert [r.value.split("\t")[2] if "\t" in r.value else r.value for r in spark.read.text(str(tmp_path / "o")).coalesce(1).collect()] == ["##head", "transcript", "gene"]  # in the order of the file
