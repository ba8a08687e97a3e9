"""Comparison commands from tables to tables, prefix lists, and filtered copies of alignments."""

import csv
import tempfile
from pathlib import Path

import pytest

from isospark.__main__ import main
from isospark.sources import sam


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


BASE = "isoform\tchromosome\tstart\tend\tstrand\texon_composition\tnote\n" + "\n".join(["a\tc\t100\t300\t+\t100-150;200-300\tx", "b\tc\t100\t300\t-\t100-300\ty", "d\tc\t100\t300\t+\t100-150;200-300\tx", "e\tc\tNA\t300\t+\t1-300\tz"]) + "\n"
QUERY = "Transcript_ID\tchrom\tstart\tstop\tstrand\texon_comp\tCategory\ts1\ts2\n" + "\n".join(["q1\tc\t110\t290\t+\t110-155;195-290\tFSM\t2\t", "q2\tc\t95\t300\t+\t95-150;200-300\tNIC\t3.5\t1", "q3\tc\t100\t300\t+\t100-156;200-300\tNNC\t9\t9", "q4\tc\t105\t310\t-\t105-310\tISM\t1\t4", "q5\tx\t100\t300\t-\t100-300\tISM\t7\t7"]) + "\n"


def test_isoforms_and_categories(spark, tmp_path):
    (tmp_path / "base.tsv").write_text(BASE)
    (tmp_path / "query.tsv").write_text(QUERY)
    main(["compare_isoforms", f"{tmp_path}/values", f"{tmp_path}/base.tsv", f"{tmp_path}/query.tsv"], spark)
    got = rows_of(tmp_path / "values")
    assert [(r["isoform"], r["note"], float(r["s1"]), float(r["s2"])) for r in got] == [("a", "x", 5.5, 1.0), ("b", "y", 1.0, 4.0), ("d", "x", 5.5, 1.0), ("e", "z", 0.0, 0.0)]
    main(["compare_categories", f"{tmp_path}/names", f"{tmp_path}/base.tsv", f"{tmp_path}/query.tsv", "--windows", "4", "10", "5"], spark)
    assert [(r["isoform"], r["Matched_Transcript_IDs"], r["Matched_Categories"]) for r in rows_of(tmp_path / "names")] == [("a", "0", "0"), ("b", "0", "0"), ("d", "0", "0"), ("e", "0", "0")]
    main(["compare_categories", f"{tmp_path}/names", f"{tmp_path}/base.tsv", f"{tmp_path}/query.tsv"], spark)
    assert [(r["isoform"], r["Matched_Transcript_IDs"], r["Matched_Categories"]) for r in rows_of(tmp_path / "names")] == [("a", "q1,q2", "FSM,NIC"), ("b", "q4", "ISM"), ("d", "q1,q2", "FSM,NIC"), ("e", "0", "0")]


def test_prefix_lists(spark, tmp_path, capsys):
    line = "c\ts\t{f}\t{a}\t{a}\t{n}\t+\t.\tID=x\n"
    for tool, rep, at in (("one", "1", 100), ("one", "2", 104), ("two", "1", 300)):
        (tmp_path / tool).mkdir(exist_ok=True)
        (tmp_path / tool / f"{rep}_tss.gff3").write_text(line.format(f="tss", a=at, n=at // 100))
        (tmp_path / tool / f"{rep}_tes.gff3").write_text(line.format(f="tes", a=at + 1000, n=5))
    (tmp_path / "one" / "1_not_ts_tes.gff3").write_text(line.format(f="tes", a=2000, n=8))
    prefixes = [f"{tmp_path}/{x}" for x in ("one/1", "one/2", "two/1")]
    (tmp_path / "list.txt").write_text("\n".join(prefixes) + "/\n")
    main(["sum_prefixes", f"{tmp_path}/out", f"{tmp_path}/list.txt", "--show_methods"], spark)
    assert capsys.readouterr().out.splitlines() == [f"{m}\t{p}" for m, p in zip(["one_rep1", "one_rep2", "two_rep1"], prefixes, strict=True)]
    of = lambda p: {(r["start"], r["one_rep1"], r["one_rep2"], r["two_rep1"]) for r in rows_of(p)}
    main(["sum_prefixes", f"{tmp_path}/tss", f"{tmp_path}/list.txt"], spark)
    assert of(tmp_path / "tss") == {("100", "1.0", "1.0", "0.0"), ("300", "0.0", "0.0", "3.0")}
    main(["sum_prefixes", f"{tmp_path}/auto", f"{tmp_path}/list.txt", "--kind", "TES"], spark)
    assert of(tmp_path / "auto") == {("2000", "8.0", "0.0", "0.0"), ("1104", "0.0", "5.0", "0.0"), ("1300", "0.0", "0.0", "5.0")}
    main(["sum_prefixes", f"{tmp_path}/tes", f"{tmp_path}/list.txt", "--kind", "TES", "--tes_input", "tes", "--missing", "na"], spark)
    assert of(tmp_path / "tes") == {("1104", "5.0", "5.0", ""), ("1300", "", "", "5.0")}
    with pytest.raises(FileNotFoundError):
        main(["sum_prefixes", f"{tmp_path}/ts", f"{tmp_path}/list.txt", "--kind", "TES", "--tes_input", "ts"], spark)


def test_view_and_bam_output(spark, tmp_path):
    lines = ["@SQ\tSN:c\tLN:5000", *(f"r{i}\t{16 * (i % 2)}\tc\t{1 + 10 * i}\t{i % 60}\t10M\t*\t0\t0\tACGTACGTAC\t*\tNM:i:{i}" for i in range(200))]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    main(["view", f"{tmp_path}/a.sam", f"{tmp_path}/out", "--without_flags", "16", "--least_quality", "10"], spark)
    want = {f"r{i}" for i in range(0, 200, 2) if i % 60 >= 10}
    copy = f"{tmp_path}/out/reads.bam"
    assert {r.qname for r in sam.read_alignments(spark, copy).collect()} == want
    main(["view", copy, f"{tmp_path}/part", "--region", "c:1,001-1,100", "--form", "sam"], spark)
    got = {r.qname: r.tags for r in sam.read_sam(spark, f"{tmp_path}/part/reads.sam").collect()}
    assert set(got) == {f"r{i}" for i in range(200) if f"r{i}" in want and 1 + 10 * i <= 1100 and 10 + 10 * i >= 1001} and all(t == {"NM": q[1:]} for q, t in got.items())


def test_attribute_annotator_and_exon_dialects(spark):
    from isospark.functions import scalar as S

    infos = ["ID=a;Name= b ;junk;ID=c", 'gene_id "g 1"; transcript_id "t;1"; tag "x"; tag "y"; exon_number 3;', "", None, "note=key value"]
    got = [r.a for r in spark.createDataFrame([(i,) for i in infos], "info string").coalesce(1).select(S.attributes("info").alias("a")).collect()]
    assert got == [{"ID": "c", "Name": "b"}, {"gene_id": "g 1", "transcript_id": "t;1", "tag": "y", "exon_number": "3"}, {}, None, {"note": "key value"}]
    names = ["FLAIR", "IsoQuant", "bambu"]
    paths = ["/d/x_flair.gtf", "/d/BAMBU/x.gtf", "/d/isoquant-run/x.gtf", "/d/myflairrun.gtf", "/d/z.gtf"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").coalesce(1).select(*[S.annotator_in("p", names, d).alias(d) for d in ("name", "folder", "token")]).collect()
    assert [tuple(r) for r in rows] == [("FLAIR", None, "FLAIR"), ("bambu", "bambu", "bambu"), (None, "IsoQuant", "IsoQuant"), (None, None, "FLAIR"), (None, None, None)]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in ("FLAIR_x.gff3_match", "bambu_match", "Bambu", "IsoQuant.gff3_match")], "x string").coalesce(1).select(S.clean_annotator("x")).collect()] == ["FLAIR", "BAMBU", "BAMBU", "IsoQuant"]
    texts = spark.createDataFrame([("30-20;5-9;x;7",), ("1,000-2,500;10.0-3",), (None,)], "t string").coalesce(1)
    pairs = lambda **k: [[tuple(x) for x in r.e] for r in texts.select(S.exons_from_text("t", **k).alias("e")).collect()]
    assert pairs()[0] == [(5, 9), (20, 30)] and pairs(sort=False)[0] == [(20, 30), (5, 9)] and pairs(sort=False, swap=False)[0] == [(30, 20), (5, 9)]
    assert pairs(tolerant=True)[1:] == [[(3, 10), (1000, 2500)], []] and pairs()[2] == []


def test_merge_takes_exon_scores_and_gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text("".join(f'c\ts\t{f}\t{a}\t{b}\t{n}\t+\t.\tgene_id "g"; transcript_id "t";\n' for f, a, b, n in (("transcript", 10, 90, "."), ("exon", 10, 30, 2), ("exon", 60, 90, 6))) + 'c\ts\texon\t500\t600\t.\t-\t.\ttranscript_id "u";\n')
    for mode, want in (("max", "6"), ("mean", "4"), ("sum", "8"), ("first", "2")):
        main(["merge", f"{tmp_path}/{mode}", f"{tmp_path}/a.gtf", "--exon_score_mode", mode], spark)
        got = {(r["start"], r["end"], r["exon_composition"]): r["a"] for r in rows_of(tmp_path / mode / "transcripts")}
        assert got == {("10", "90", "10-30;60-90"): want, ("500", "600", "500-600"): "1"}
