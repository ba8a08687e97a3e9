"""Manifest commands from files to files, exact quantiles against percentile, and one scan for all files of a manifest."""

import csv
import gzip
import random
import statistics
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from isospark.__main__ import main
from isospark.operators import quantiles
from isospark.plans import tables
from isospark.sources import text


@pytest.fixture(autouse=True)
def checkpoints(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="isospark-"))


def rows_of(path):
    out = []
    for p in sorted(Path(path).glob("part-*.csv")):
        with p.open() as f:
            out += list(csv.DictReader(f, delimiter="\t"))
    return out


HEAD = "isoform\tchrom\tstructural_category\tassociated_gene\tassociated_transcript\tcoding\twithin_CAGE_peak\twithin_polyA_site\tpolyA_motif_found\tpolyA_dist\tdiff_to_gene_TSS\tiso_exp"
#: category, gene, transcript, coding, cap, site, motif, distance, shift, weight
RUNS = {
    ("cDNA", "H1", "flair"): [("full-splice_match", "g1", "T1.2", "coding", "TRUE", "TRUE", "TRUE", -20, 3, 2), ("incomplete-splice_match", "g1", "T1.2", "non_coding", "FALSE", "FALSE", "TRUE", -60, -9, 1), ("novel_in_catalog", "g2", "novel", "coding", "NA", "NA", "FALSE", "NA", 0, "NA")],
    ("cDNA", "H1", "bambu"): [("full-splice_match", "g1", "T1.2", "coding", "TRUE", "NA", "TRUE", -1, 1, 1), ("novel_not_in_catalog", "g3", "novel", "coding", "TRUE", "TRUE", "NA", "NA", 100, 1)],
    ("cDNA", "H2", "flair"): [("incomplete-splice_match", "g2", "T2.1", "coding", "FALSE", "NA", "NA", "NA", "NA", 1), ("full-splice_match", "g9", "NA", "coding", "TRUE", "NA", "NA", "NA", "NA", 1)],
    ("cDNA", "H2", "bambu"): [("genic", "g2", "T2.1", "coding", "FALSE", "NA", "NA", "NA", "NA", 1)],
}
GTF = [
    "##header", 'c\tx\tgene\t1\t9\t.\t+\t.\tgene_id "g2";', 'c\tx\ttranscript\t9\t20\t.\t+\t.\tgene_id "g1"; transcript_id "T1.2";', 'c\tx\tgene\t1\t90\t.\t+\t.\tgene_id "g1";',
    'c\tx\texon\t5\t6\t.\t+\t.\tgene_id "g1"; transcript_id "T1.2";', 'a\tx\ttranscript\t1\t2\t.\t-\t.\tgene_id "g2"; transcript_id "T2.1";', 'a\tx\ttranscript\t1\t2\t.\t-\t.\tgene_id "g7"; transcript_id "T7.1";',
]


@pytest.fixture
def files(tmp_path):
    lines, base = ["Chemistry\tCell-line\tGTF\tReference"], ["Annotator\tChemical\tCell\tClassification"]
    (tmp_path / "ref.gtf").write_text("\n".join(GTF) + "\n")
    for (chem, cell, tool), rows in RUNS.items():
        name = tmp_path / f"{tool}_{chem}_{cell}_classification.txt"
        head, extra = HEAD, "\t".join
        body = [extra([f"{tool}{i}", "c", *map(str, r)]) for i, r in enumerate(rows)]
        if tool == "bambu":  # another order of columns, in other case, with CRLF, compressed
            order = [11, 0, 2, 3, 4, 1, 5, 6, 7, 8, 9, 10]
            turn = lambda x, order=order: "\t".join(x.split("\t")[k] for k in order)
            name = Path(f"{name}.gz")
            with gzip.open(name, "wt") as f:
                f.write("\r\n".join([turn(head).upper(), *map(turn, body)]) + "\r\n")
        else:
            name.write_text("\n".join([head, *body]) + "\n")
        lines.append(f"{chem}\t{cell}\t{name}\t{tmp_path}/ref.gtf")
        base.append(f"{tool}\t{chem}\t{cell}\t{name}")
    (tmp_path / "manifest.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "database.tsv").write_text("\n".join(base) + "\n")
    return tmp_path


def test_active_references(spark, files):
    main(["active_references", f"{files}/out", f"{files}/manifest.tsv", f"{files}/ref.gtf"], spark)
    got = {d.name: "".join(p.read_text() for p in sorted(d.glob("part-*"))).splitlines() for d in (files / "out" / "chemistry=cDNA").iterdir()}
    assert got["cell_line=H1"] == [GTF[0], GTF[2], GTF[3], GTF[4]]  # in the order of the file
    assert got["cell_line=H2"] == [GTF[0], GTF[1], GTF[5]]
    with pytest.raises(ValueError, match="no transcript is active"):
        (files / "one.tsv").write_text(f"cDNA\tH9\t{files}/bambu_cDNA_H2_classification.txt.gz\n")
        tables.active_references(spark, f"{files}/none", f"{files}/one.tsv", f"{files}/ref.gtf", strict=True)


def test_recovery(spark, files):
    main(["recovery", f"{files}/out", f"{files}/manifest.tsv", "--strip", "--composition"], spark)
    got = {(r["cell_line"], r["annotator"]): (r["reference"], r["fsm"], r["ism"], r["either"]) for r in rows_of(files / "out" / "scores")}
    tools = {tool: text_name for tool in ("flair", "bambu") for text_name in {k[1] for k in got} if text_name.lower() == tool}
    assert got == {("H1", tools["flair"]): ("3", "1", "1", "1"), ("H1", tools["bambu"]): ("3", "1", "0", "1"), ("H2", tools["flair"]): ("3", "0", "1", "1"), ("H2", tools["bambu"]): ("3", "0", "0", "0")}
    means = {r["annotator"]: float(r["either_recall"]) for r in rows_of(files / "out" / "means")}
    assert means == pytest.approx({tools["flair"]: 1 / 3, tools["bambu"]: 1 / 6})
    assert sum(int(r["n"]) for r in rows_of(files / "out" / "composition")) == 8
    assert len(rows_of(files / "out" / "annotators")) == 1 and rows_of(files / "out" / "anova")


def test_weighted_and_endpoint_statistics(spark, files):
    main(["weighted_stats", f"{files}/w", f"{files}/database.tsv", "--weight", "iso_exp"], spark)
    got = {(r["annotator"], r["cell_line"], r["category"]): r for r in rows_of(files / "w")}
    assert len(got) == 8 and got["flair", "H1", "full_splice_match"]["coding_rate"] == "1.0" and got["flair", "H1", "incomplete_splice_match"]["site_motif_rate"] == "0.0"
    main(["endpoints", f"{files}/e", f"{files}/database.tsv"], spark)
    got = {(r["annotator"], r["cell_line"], r["category"]): r for r in rows_of(files / "e")}
    assert len(got) == 4 * 5
    r = got["flair", "H1", "ALL"]
    assert {c: r[c] for c in ("n", "cage_true", "cage_false", "cage_na", "motif_true", "motif_close", "supported", "tss_median")} == {"n": "3", "cage_true": "1", "cage_false": "1", "cage_na": "1", "motif_true": "2", "motif_close": "1", "supported": "1", "tss_median": "3.0"}
    assert float(r["cage_rate"]) == 0.5 and float(r["exact_rate"]) == pytest.approx(2 / 3)
    assert got["bambu", "H2", "NIC"]["n"] == "0" and got["bambu", "H2", "NIC"]["cage_rate"] == ""


def test_novelty(spark, files):
    rows = ["flair\tcDNA\tH1", "bambu\tcDNA\tH1"]
    junctions = []
    for k, run in enumerate(rows):
        name = files / f"{run.split(chr(9))[0]}_junctions.txt"
        name.write_text("isoform\tchrom\tstrand\tgenomic_start_coord\tgenomic_end_coord\tjunction_category\tsplice_site\tRTS_junction\n" + f"{run.split(chr(9))[0]}1\tc\t+\t10\t20\tnovel\tGTAG\tFALSE\n" + f"{run.split(chr(9))[0]}1\tc\t+\t{30 + k}\t40\tnovel\tCTTC\tTRUE\n" + "x\tc\t+\t1\t2\tknown\tGTAG\tFALSE\n")
        junctions.append(f"{run}\t{name}")
    (files / "junctions.tsv").write_text("\n".join(junctions) + "\n")
    main(["novelty", f"{files}/out", f"{files}/manifest.tsv", f"{files}/junctions.tsv"], spark)
    burden = {(r["annotator"].lower(), r["cell_line"]): (r["nic"], r["nnc"], r["ratio"]) for r in rows_of(files / "out" / "burden_by_condition")}
    assert burden["flair", "H1"] == ("1", "0", "0.0") and burden["bambu", "H1"] == ("0", "1", "")
    support = {r["annotator"]: (r["n"], r["cross_tool"]) for r in rows_of(files / "out" / "junction_support")}
    assert support == {"flair": ("2", "0.5"), "bambu": ("2", "0.5")}
    canon = rows_of(files / "out" / "isoform_canonicality")
    assert {(r["annotator"], r["all_canonical"], r["median_junctions"]) for r in canon} == {("flair", "0.0", "2.0"), ("bambu", "0.0", "2.0")}
    assert rows_of(files / "out" / "plausibility") and rows_of(files / "out" / "burden_long")


def test_one_scan_for_many_files(spark, tmp_path):
    """75 tables are one scan node; a table without the columns is an error."""
    lines = []
    for k in range(75):
        (tmp_path / f"t{k}.txt").write_text(f"{HEAD}\n" + "".join(f"i{i}\tc\tgenic\tg\tT{k}\n" for i in range(k % 4)))
        lines.append(("x", f"{tmp_path}/t{k}.txt"))
    m = spark.createDataFrame(lines, "tag string, file string")
    df = tables.scan_tables(spark, m, "file", tables.CLASSIFICATION, tables.MAY)
    assert df.count() == sum(k % 4 for k in range(75)) and set(df.columns) >= {"tag", "isoform", "iso_exp"}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text") == 1 and "Union" not in plan
    (tmp_path / "bad.txt").write_text("isoform\tother\na\tb\n")
    with pytest.raises(ValueError, match="bad.txt"):
        tables.scan_tables(spark, spark.createDataFrame([("x", f"{tmp_path}/bad.txt")], "tag string, file string"), "file", tables.CLASSIFICATION)


def test_quantiles_are_exact(spark):
    r = random.Random(8)
    rows = [("wide", r.choice([r.uniform(-1e9, 1e9), r.gauss(0, 1), 5.0])) for _ in range(3001)] + [("int", float(r.randrange(3_000_000))) for _ in range(2000)]
    rows += [("one", 7.5), ("two", 1.0), ("two", 2.0), ("same", 3.0), ("same", 3.0), (None, 1.0), (None, 4.0), ("none", None), ("tiny", 1e-300), ("tiny", 1e300), ("tiny", 0.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {b.k: b for b in quantiles.box(df, ["k"], "x", "x").collect()}
    want = {w.k: w for w in df.groupBy("k").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g.n, g.x_min, g.x_max) == (w.n, w.lo, w.hi)
        assert (g.x_q1, g.x_median, g.x_q3) == (pytest.approx(tuple(w.q), rel=1e-12) if w.q and w.q[0] is not None else (None, None, None))
    total = {(b.k, b.c): b.x_median for b in quantiles.box_with_total(df.withColumn("c", F.lit("c")), ["k"], "c", "x", "x").collect()}
    assert total["wide", "ALL"] == total["wide", "c"] == statistics.median(x for k, x in rows if k == "wide")
    plan = quantiles.box(df, ["k"], "x", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


TWO = """chr1\ts\tmRNA\t10\t90\t5\t+\t.\tID=t1
chr1\ts\texon\t60\t90\t.\t+\t.\tParent=t1
chr1\ts\texon\t10\t30\t.\t+\t.\tParent=t1
chr2\ts\texon\t500\t600\t.\t-\t.\tParent=t1
chr2\ts\texon\t700\t800\t.\t-\t.\tParent=t1
"""


def test_equal_ids_in_several_files_and_contigs(spark, tmp_path):
    """Exons meet the transcript of their file and contig, and make one where there is none."""
    (tmp_path / "a.gff3").write_text(TWO)
    (tmp_path / "b.gff3").write_text(TWO.replace("10\t30", "10\t20").replace("\t5\t", "\t7\t"))
    t = text.transcripts_of_gff(text.read_gff(spark, [f"{tmp_path}/a.gff3", f"{tmp_path}/b.gff3"]))
    got = {(r.path[-6], r.contig, r.strand, r.start, r.end, r.reads, tuple(map(tuple, r.exons))) for r in t.collect()}
    exons = ((500, 600), (700, 800))
    assert got == {("a", "chr1", "+", 10, 90, 5.0, ((10, 30), (60, 90))), ("b", "chr1", "+", 10, 90, 7.0, ((10, 20), (60, 90))), ("a", "chr2", "-", 500, 800, 0.0, exons), ("b", "chr2", "-", 500, 800, 0.0, exons)}


def test_false_positive_clusters(spark, tmp_path):
    (tmp_path / "ref.tsv").write_text("transcript_id\tseqnames\tstrand\tstart\tend\texon_composition\nr\tchr9\t+\t1\t50\t1-50\n")
    (tmp_path / "a.gff3").write_text(TWO)
    (tmp_path / "b.gff3").write_text(TWO.replace("\t10\t90\t5", "\t12\t90\t7").replace("10\t30", "12\t33").replace("ID=t1", "ID=t2").replace("Parent=t1", "Parent=t2"))
    main(["evaluate", f"{tmp_path}/out", f"{tmp_path}/ref.tsv", f"{tmp_path}/a.gff3", f"{tmp_path}/b.gff3"], spark)
    got = {r["contig"]: r for r in rows_of(tmp_path / "out" / "false_positive_clusters")}
    assert {c: got["chr1"][c] for c in ("tss", "tes", "n", "n_files", "a_count", "a_reads", "a_ids", "b_count", "b_reads", "b_ids")} == {"tss": "10", "tes": "90", "n": "2", "n_files": "2", "a_count": "1", "a_reads": "5.0", "a_ids": "t1", "b_count": "1", "b_reads": "7.0", "b_ids": "t2"}
    assert got["chr2"]["n"] == "2" and len(got) == 2


def test_order_of_an_active_gtf_and_found_tables(spark, tmp_path):
    (tmp_path / "ref.gtf").write_text("\n".join(GTF) + "\n")
    text.write_active_gtf(spark, f"{tmp_path}/ref.gtf", spark.createDataFrame([("T1.2",), ("T2.1",)], "id string"), f"{tmp_path}/out")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert lines == GTF[:6]
    for k, head in enumerate(["a\tb\tc", "b,c,a", "a\tb", ""]):
        (tmp_path / f"t{k}.txt").write_text(head + "\n1\t2\t3\n" if head else "")
    assert [p[-6:] for p in text.find_tables(spark, str(tmp_path), ["a", "c"])] == ["t0.txt", "t1.txt"]
