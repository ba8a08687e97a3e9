"""Command line: python -m isospark COMMAND ...; every command reads files and writes a folder."""

from __future__ import annotations

import argparse
import dataclasses

from isospark.model import PRESETS, Params, preset


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="isospark")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("annotate", help="sites, introns and transcripts of an alignment")
    for name in ("alignments", "genome", "out"):
        a.add_argument(name)
    _params(a)
    for name, what, files in (
        ("label", "stage 1: reads with their end labels, counts and depth", ("alignments", "out")),
        ("stats", "stage 2: statistics of ends and introns", ("labels", "genome", "out")),
        ("sites", "stage 3: sites and introns as GFF3", ("stats", "out")),
        ("transcripts", "stage 4: transcripts of the labelled reads", ("labels", "features", "out")),
    ):
        s = sub.add_parser(name, help=what)
        for f in files:
            s.add_argument(f)
        _params(s)
    v = sub.add_parser("view", help="a filtered copy of alignments")
    for name in ("alignments", "out"):
        v.add_argument(name)
    v.add_argument("--region", help="such as chr1:100-200")
    for name in ("without_flags", "with_flags", "least_quality"):
        v.add_argument(f"--{name}", type=int, default=0)
    v.add_argument("--form", choices=("sam", "bam"), default="bam")
    m = sub.add_parser("merge", help="transcripts of several GFF files, merged")
    m.add_argument("out")
    m.add_argument("files", nargs="+")
    m.add_argument("--window", type=int, default=0)
    m.add_argument("--sample_attributes", action="store_true")
    m.add_argument("--exon_score_mode", choices=("max", "mean", "sum", "first"), default="max", help="support of a transcript without a score")
    m.add_argument("--collapse", action="store_true", help="equal sites and introns once, scores summed")
    f = sub.add_parser("features", help="features of several GFF files at those of a reference")
    for name in ("out", "reference"):
        f.add_argument(name)
    f.add_argument("files", nargs="+")
    f.add_argument("--window", type=int, default=0)
    f.add_argument("--sample_attributes", action="store_true")
    s = sub.add_parser("sum", help="sites of several GFF files, clustered")
    s.add_argument("out")
    s.add_argument("files", nargs="+")
    s.add_argument("--kind", choices=("TSS", "TES", "intron"), default="TSS")
    s.add_argument("--intron_agg", choices=("sum", "max", "first"), default="sum")
    s.add_argument("--missing", choices=("0", "na"), default="0")
    s.add_argument("--show_methods", action="store_true")
    s.add_argument("--wobble", type=int, default=10)
    e = sub.add_parser("evaluate", help="GFF predictions against a transcript table")
    e.add_argument("out")
    e.add_argument("reference")
    e.add_argument("files", nargs="+")
    e.add_argument("--windows", type=int, nargs=3, default=(10, 10, 10), metavar=("START", "END", "INTRONS"))
    b = sub.add_parser("boundary", help="precision and recall of sites against reference intervals, and tests of them")
    for name in ("out", "manifest"):
        b.add_argument(name)
    b.add_argument("--mode", choices=("TSS", "TES"), default="TSS")
    b.add_argument("--window", type=int, default=0)
    b.add_argument("--coords", choices=("bed0", "bed1"), default="bed0")
    b.add_argument("--point_mode", choices=("as_is", "bed0_to_1based"), default="as_is")
    b.add_argument("--chr_mode", choices=("keep", "add", "strip"), default="keep")
    b.add_argument("--adjust", choices=("bh", "holm", "none"), default="bh")
    b.add_argument("--annotators", nargs="+", default=[], help="names to look for in paths, in this order")
    r = sub.add_parser("report", help="summaries of a classification table")
    for name in ("out", "classification"):
        r.add_argument(name)
    r.add_argument("--by", nargs="+", default=[])
    c = sub.add_parser("clusters", help="transcript tables clustered by their ends and introns")
    c.add_argument("out")
    c.add_argument("files", nargs="+")
    c.add_argument("--windows", type=int, nargs=3, default=(10, 10, 10), metavar=("START", "END", "INTRONS"))
    c.add_argument("--greedy", action="store_true")
    c.add_argument("--no_within", action="store_true", help="only matches between tables")
    q = sub.add_parser("positions", help="how many positions lie near the start sites of a table")
    for name in ("out", "queries", "positions"):
        q.add_argument(name)
    q.add_argument("--window", type=int, default=10)
    q.add_argument("--unstranded", action="store_true")
    a = sub.add_parser("active_references", help="per chemistry and cell line, the lines of a GTF that its classified transcripts are on")
    for name in ("out", "manifest", "gtf"):
        a.add_argument(name)
    a.add_argument("--strip", action="store_true", help="names without their versions")
    a.add_argument("--strict", action="store_true")
    r = sub.add_parser("recovery", help="reference transcripts that classified runs find, and tests of that")
    for name in ("out", "manifest"):
        r.add_argument(name)
    r.add_argument("--strip", action="store_true")
    r.add_argument("--composition", action="store_true")
    r.add_argument("--adjust", choices=("bh", "holm", "none"), default="bh")
    r.add_argument("--annotators", nargs="+", default=[], help="names to look for in paths, in this order")
    n = sub.add_parser("novelty", help="burden and support of novel isoforms and junctions")
    for name in ("out", "classifications", "junctions"):
        n.add_argument(name)
    n.add_argument("--annotators", nargs="+", default=[], help="names to look for in paths, in this order")
    w = sub.add_parser("weighted_stats", help="weighted shares by run and category")
    for name in ("out", "manifest"):
        w.add_argument(name)
    w.add_argument("--weight", choices=("none", "iso_exp", "gene_exp"), default="none")
    e = sub.add_parser("endpoints", help="support of both ends by run and category")
    for name in ("out", "manifest"):
        e.add_argument(name)
    e.add_argument("--exact", type=int, default=5)
    e.add_argument("--close", type=int, default=40)
    for name, what in (("compare_isoforms", "values of one isoform table summed onto another, within windows"), ("compare_categories", "names and categories of one isoform table put onto another, within windows")):
        c = sub.add_parser(name, help=what)
        for f in ("out", "base", "query"):
            c.add_argument(f)
        c.add_argument("--windows", type=int, nargs=3, default=(10, 10, 5), metavar=("START", "END", "INTRONS"))
    x = sub.add_parser("sum_prefixes", help="features of the runs of a list of path prefixes, summed by method")
    for name in ("out", "prefixes"):
        x.add_argument(name)
    x.add_argument("--kind", choices=("TSS", "TES", "intron"), default="TSS")
    x.add_argument("--tes_input", choices=("auto", "not_ts", "tes", "ts"), default="auto")
    x.add_argument("--wobble", type=int, default=10)
    x.add_argument("--intron_agg", choices=("sum", "max", "first"), default="sum")
    x.add_argument("--missing", choices=("0", "na"), default="0")
    x.add_argument("--show_methods", action="store_true")
    g = sub.add_parser("gtf", help="a GFF3 file as GTF, transcripts or boundaries")
    for name in ("out", "gff"):
        g.add_argument(name)
    return p


def _params(a: argparse.ArgumentParser) -> None:
    """Options of the annotation, the same for all of its stages."""
    a.add_argument("--preset", choices=sorted(PRESETS), default="default")
    a.add_argument("--form", choices=("sam", "bam"), default="sam", help="of the reads that are written, and of labelled ones that are read")
    for f in dataclasses.fields(Params):
        kind = type(f.default)
        if kind is bool:
            a.add_argument(f"--{f.name}", action=argparse.BooleanOptionalAction, default=None)
        else:
            a.add_argument(f"--{f.name}", type=kind, default=None)


def main(argv: list[str] | None = None, spark=None) -> None:
    args = vars(parser().parse_args(argv))
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("isospark").getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{args['out']}/_checkpoints")
    from isospark.plans import compare, stages, suites, tables

    command, out = args["command"], args["out"]
    if command in ("annotate", "label", "stats", "sites", "transcripts"):
        params = preset(args["preset"], **{f.name: args[f.name] for f in dataclasses.fields(Params) if args[f.name] is not None})
        if command == "annotate":
            suites.run_annotation(spark, args["alignments"], args["genome"], out, params, args["form"])
        elif command == "label":
            stages.label(spark, args["alignments"], out, params, args["form"])
        elif command == "stats":
            stages.statistics(spark, args["labels"], args["genome"], out, params)
        elif command == "sites":
            stages.features(spark, args["stats"], out, params)
        else:
            stages.assemble(spark, args["labels"], args["features"], out, params, args["form"])
    elif command in ("compare_isoforms", "compare_categories", "sum_prefixes"):
        getattr(compare, command)(spark, **{k: v for k, v in args.items() if k != "command"})
    elif command == "view":
        from isospark.sources import sam

        sam.view(spark, **{k: v for k, v in args.items() if k != "command"})
    elif command in ("active_references", "recovery", "novelty", "weighted_stats", "endpoints"):
        getattr(tables, command)(spark, **{k: v for k, v in args.items() if k != "command"})
    elif command in ("merge", "sum", "features", "evaluate"):
        suites.run_files(spark, **args)
    else:
        getattr(suites, f"run_{command}")(spark, **{k: v for k, v in args.items() if k != "command"})


if __name__ == "__main__":
    main()
