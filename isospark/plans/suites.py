"""Composite runs over files: summing features, boundary benchmark, evaluation, merging, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.functions import scalar as S
from isospark.operators import cluster, match, quantiles, rangejoin, stats, summaries
from isospark.sources import text


def method_of(prefix: str) -> str:
    """The method a path prefix stands for: its last part that is no contig name; a bare number becomes
    a replicate of the part before."""
    parts = [p for p in prefix.replace("\\", "/").rstrip("/_").split("/") if p]
    named = [p for p in parts if not p.lower().startswith(("chr", "nc_", "contig"))] or parts
    if named[-1].isdigit() and len(named) > 1:
        return f"{named[-2]}_rep{named[-1]}"
    return named[-1]


def sum_sites(features: DataFrame, kind: str, methods: list[str], wobble: int = 10, missing: float | None = 0.0) -> DataFrame:
    """Sites of several methods (``contig, strand, start, score, method``) clustered, each cluster by its best
    site, one column of summed scores per method."""
    keys = ["contig", "strand"]
    c = cluster.gap_clusters(features, keys, "start", wobble)
    outer_left = F.col("strand") == ("+" if kind == "TSS" else "-")
    best = cluster.representatives(c, keys, outer_left).select(*keys, "cluster", "start")
    return best.join(cluster.method_matrix(c, [*keys, "cluster"], methods, missing=missing), [*keys, "cluster"]).drop("cluster")


def sum_introns(features: DataFrame, methods: list[str], how: str = "sum", missing: float | None = 0.0) -> DataFrame:
    return cluster.method_matrix(features, ["contig", "strand", "start", "end"], methods, how=how, missing=missing, order=["file", "line"])


def boundary_benchmark(predicted: DataFrame, reference: DataFrame, run: list[str]) -> DataFrame:
    """Precision, recall and F1 of each run: points against intervals, matched one to one per contig and strand.

    Both sides carry the ``run`` columns, so all runs are matched in one job.
    """
    per = match.interval_matches(predicted.select(*run, "contig", "strand", "pos").distinct(), reference.select(*run, "contig", "strand", "lo", "hi").distinct(), [*run, "contig", "strand"])
    return match.with_rates(per.groupBy(*run).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def boundary_statistics(scores: DataFrame, how: str = "bh") -> dict[str, DataFrame]:
    """Mean table, blocked analysis of variance, paired tests of annotators and of cell lines."""
    groups = ["mode", "chem"]
    return {
        "means": scores.groupBy(*groups, "annotator").agg(*[F.avg(c).alias(c) for c in ("f1", "precision", "recall")], *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]),
        "anova": stats.anova_blocked(scores, groups, "annotator", "cell", "f1"),
        "annotators": stats.paired_tests(scores, groups, ["cell"], "annotator", "f1", how),
        "cells": stats.paired_tests(scores, groups, ["annotator"], "cell", "f1", how),
    }


def active_references(points: DataFrame, reference: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Reference intervals of a sample that a point supports, and the others."""
    args = (reference, points, ["contig", "strand"], "lo", "hi", "pos", window)
    return rangejoin.active_intervals(*args), rangejoin.active_intervals(*args, active=False)


def active_gtf(gtf_lines: DataFrame, active: DataFrame, strip: bool = False, keep: list[str] = ()) -> DataFrame:
    """Lines of a GTF whose transcript is active, and rows without a transcript whose gene has one.

    ``gtf_lines(value)`` with the columns to ``keep``, ``active(id)``.
    """
    t = S.gtf_attribute("value", "transcript_id")
    rows = gtf_lines.withColumns({"id": S.strip_version(t) if strip else t, "gene": S.gtf_attribute("value", "gene_id")})
    ids = active.select((S.strip_version("id") if strip else F.col("id")).alias("id")).distinct()
    kept = rows.where("id is not null").join(ids, "id", "left_semi")
    genes = rows.where("id is null").join(kept.select("gene").distinct(), "gene", "left_semi")
    return kept.select(*keep, "value").unionByName(genes.select(*keep, "value"))


def transcripts_for_matching(tx: DataFrame) -> DataFrame:
    """Adds sites and introns to ``(contig, strand, start, end, exons)``."""
    return match.with_sites(tx).withColumn("introns", S.introns_of("exons", only_real=False))


def evaluate_files(reference: DataFrame, predicted: DataFrame, windows: tuple[int, int, int] = (10, 10, 10)) -> dict[str, DataFrame]:
    """All files' predictions (``file, pid, ...``) against one reference (``rid, ...``): matches, counts per file,
    seed-clustered false positives, references no file found."""
    predicted = predicted if "reads" in predicted.columns else predicted.withColumn("reads", F.lit(0.0))
    ref, pred = transcripts_for_matching(reference), transcripts_for_matching(predicted).withColumn("key", F.concat_ws("\t", "file", "pid"))
    pairs = match.transcript_pairs(ref, pred, "rid", "key", *windows).select("rid", "key")
    found = pairs.join(pred.select("key", "file", "pid"), "key")
    n_ref = ref.agg(F.countDistinct("rid").alias("n_ref"))
    tp = found.groupBy("file").agg(F.countDistinct("rid").alias("tp"))
    wrong = pred.join(pairs.select("key").distinct(), "key", "left_anti")
    fp = wrong.groupBy("file").agg(F.countDistinct("pid").alias("fp"))
    files = predicted.select("file").distinct()
    counts = files.join(tp, "file", "left").join(fp, "file", "left").na.fill(0).join(F.broadcast(n_ref)).withColumn("fn", F.col("n_ref") - F.col("tp"))
    w1, w2, w3 = windows
    near = lambda a, b: abs(a.tss - b.tss) <= w1 and abs(a.tes - b.tes) <= w2 and all(abs(x["s"] - y["s"]) <= w3 and abs(x["e"] - y["e"]) <= w3 for x, y in zip(a.introns, b.introns))
    seeds = cluster.seed_clusters(wrong.withColumn("n_introns", F.size("introns")).select("contig", "strand", "n_introns", "key", "file", "pid", "tss", "tes", "introns", "reads"), ["contig", "strand", "n_introns"], near, ["tss", "key"], "tss", w1)
    return {"matches": found, "stats": match.with_rates(counts), "false_positives": seeds, "not_found": ref.join(pairs.select("rid").distinct(), "rid", "left_anti")}


def false_positive_clusters(wrong: DataFrame, files: list[str]) -> DataFrame:
    """A row per seed cluster of false positives (``evaluate_files``): its seed's place, and per file how many
    predictions it has, their reads and their names."""
    keys = ["contig", "strand", "n_introns", "seed"]
    place = F.min_by(F.struct("tss", "tes", "introns"), F.struct("tss", "key")).alias("at")
    total = wrong.groupBy(*keys).agg(place, F.count("*").alias("n"), F.countDistinct("file").alias("n_files"))
    names = F.array_join(F.array_sort(F.collect_list("pid")), ",")
    wide = wrong.groupBy(*keys).pivot("file", files).agg(F.count(F.lit(1)).alias("count"), F.sum("reads").alias("reads"), names.alias("ids"))
    out = total.join(wide, keys).select("contig", "strand", "at.tss", "at.tes", "at.introns", "n", "n_files", *[F.coalesce(F.col(f"`{f}_{c}`"), F.lit("" if c == "ids" else 0)).alias(f"{f}_{c}") for f in files for c in ("count", "reads", "ids")])
    return cluster.numbered(out, "FP_", ["contig", "strand", "tss", "tes", F.col("introns").cast("string")])


def merge_samples(tx: DataFrame, samples: list[str], window: int = 0) -> DataFrame:
    """Transcripts of samples (``sample, contig, strand, start, end, exons, reads``) merged where their inner
    structure agrees and both ends lie within ``window`` of the group's first; one count column per sample."""
    inner = F.transform(S.inner_signature("exons"), lambda x, i: F.concat(x.cast("string"), F.when(i % 2 == 0, ";").otherwise("-")))
    shape = F.when(F.size("exons") > 1, F.concat(F.lit("-"), F.array_join(inner, ""))).otherwise(F.lit(""))
    rows = tx.withColumn("exons", S.normal_exons("exons")).withColumns({"shape": shape, "n_exons": F.size("exons")})
    led = cluster.leader_clusters(rows.select("sample", "contig", "strand", "start", "end", "shape", "n_exons", "reads"), ["contig", "strand", "shape", "n_exons"], "start", "end", window)
    keys = ["contig", "strand", "shape", "n_exons", "leader"]
    bounds = led.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    wide = bounds.join(cluster.method_matrix(led, keys, samples, "sample", "reads"), keys)
    return cluster.numbered(wide, "TR_", ["contig", "strand", "start", "end", "n_exons", "shape"]).drop("leader")


def _total(samples: list[str]):
    """The sum over samples as a score; null for 0."""
    return F.nullif(sum((F.coalesce(F.col(f"`{s}`"), F.lit(0.0)) for s in samples), F.lit(0.0)), F.lit(0.0))


def with_exon_text(merged: DataFrame) -> DataFrame:
    """Adds ``exon_composition`` and ``exons`` to the rows of ``merge_samples``."""
    start, end = F.col("start").cast("string"), F.col("end").cast("string")
    rows = merged.withColumn("exon_composition", F.when(F.col("n_exons") > 1, F.concat(start, "shape", end)).otherwise(F.concat_ws("-", start, end)))
    return rows.withColumn("exons", S.exons_from_text("exon_composition"))


def merged_gff(merged: DataFrame, samples: list[str], sample_attributes: bool = False) -> DataFrame:
    """mRNA and exon rows of merged transcripts, in the order of their ids (``id``, ``k``)."""
    info = F.concat(F.lit("ID="), "id", F.lit(";Name="), "id", F.lit(";exon_count="), F.size("exons").cast("string"), F.lit(";exon_comp="), "exon_composition")
    if sample_attributes:
        info = F.concat(info, *[F.concat(F.lit(f";{s}="), S.number_text(F.coalesce(F.col(f"`{s}`"), F.lit(0.0)))) for s in samples])
    row = lambda f, s, e, score, i, k: F.struct(F.lit(f).alias("feature"), s.cast("long").alias("start"), e.cast("long").alias("end"), score.cast("double").alias("score"), i.alias("info"), k.alias("k"))
    rows = with_exon_text(merged)
    whole = F.array(row("mRNA", F.col("start"), F.col("end"), _total(samples), info, F.lit(0)))
    exons = F.transform("exons", lambda x, i: row("exon", x["s"], x["e"], F.lit(None), F.concat(F.lit("ID="), F.col("id"), F.lit(".exon"), (i + 1).cast("string"), F.lit(";Parent="), F.col("id")), i + 1))
    each = rows.select("id", "contig", "strand", F.explode(F.concat(whole, exons)).alias("r"))
    return each.select("contig", F.lit("merge").alias("source"), "r.feature", "r.start", "r.end", "r.score", "strand", F.lit(".").alias("frame"), "r.info", "id", "r.k")


def merged_features(merged: DataFrame, samples: list[str], kind: str, collapse: bool = False) -> DataFrame:
    """Start sites, end sites or introns (``TSS``, ``TES``, ``intron``) of merged transcripts as GFF rows.

    One of each transcript, or, with ``collapse``, equal ones once with the sum of their scores.
    """
    rows = with_exon_text(merged).withColumn("score", _total(samples))
    if kind == "intron":
        at = rows.select("id", "contig", "strand", "score", F.posexplode(S.introns_of("exons")).alias("i", "x")).select("id", "contig", "strand", "score", F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.concat(F.lit("intron"), (F.col("i") + 1).cast("string")).alias("part"))
        at = at if collapse else at.withColumn("score", F.lit(None).cast("double"))
    else:
        pos = F.when((F.col("strand") == "+") == F.lit(kind == "TSS"), F.col("start")).otherwise(F.col("end"))
        at = rows.select("id", "contig", "strand", "score", pos.alias("start"), pos.alias("end"), F.lit(kind).alias("part"))
    if collapse:
        one = at.groupBy("contig", "strand", "start", "end").agg(F.nullif(F.sum(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("score"))
        at = cluster.numbered(one, f"{kind.upper()}_", ["contig", "strand", "start", "end"])
        info = F.concat(F.lit("ID="), "id", F.lit(";Name="), "id")
    else:
        name = F.concat_ws(".", "id", "part")
        info = F.concat(F.lit("ID="), name, F.lit(";Parent="), "id", F.lit(";Name="), name)
    return at.select("contig", F.lit("merge").alias("source"), F.lit(kind).alias("feature"), "start", "end", "score", "strand", F.lit(".").alias("frame"), info.alias("info"), "id")


def write_merged(merged: DataFrame, samples: list[str], out: str, sample_attributes: bool = False, collapse: bool = False) -> None:
    """Merged transcripts as a table and as GFF3, and their start sites, end sites and introns as GFF3."""
    from isospark.session import cut

    kept = cut(merged)
    table = with_exon_text(kept).select(F.col("id").alias("isoform"), F.col("contig").alias("chromosome"), "start", "end", "strand", "exon_composition", *[S.number_text(F.coalesce(F.col(f"`{s}`"), F.lit(0.0))).alias(s) for s in samples])
    text.write_tsv(table, f"{out}/transcripts", ["isoform"])
    text.write_gff(merged_gff(kept, samples, sample_attributes), f"{out}/transcripts.gff3", ["id", "k"], version=True)
    for kind in ("TSS", "TES", "intron"):
        text.write_gff(merged_features(kept, samples, kind, collapse), f"{out}/{kind.lower()}.gff3", ["id", "start"], version=True)


def compare_features(main: DataFrame, features: DataFrame, samples: list[str], window: int = 0) -> DataFrame:
    """Reference features (``contig, strand, feature, start, end`` of type TSS, TES or intron), numbered FT_ in
    order, with the sum of each sample's scores within ``window``; a feature counts for all that it matches.

    Sites are compared by their start, introns by both ends; a missing score counts 1.
    """
    keys = ["contig", "strand", "feature"]
    kinds = F.col("feature").isin("TSS", "TES", "intron")
    ref = cluster.numbered(main.where(kinds).select(*keys, "start", "end"), "FT_", [*keys, "start", "end"])
    other = features.where(kinds).select(*keys, F.col("start").alias("s2"), F.col("end").alias("e2"), F.coalesce("score", F.lit(1.0)).alias("value"), "sample")
    near = rangejoin.range_join(ref, other, keys, F.col("start") - window, F.col("start") + window, "s2", 2 * window + 1)
    near = near.where((F.col("feature") != "intron") | (F.abs(F.col("end") - F.col("e2")) <= window))
    wide = near.groupBy("id").pivot("sample", samples).agg(F.sum("value"))
    return ref.join(wide, "id", "left").na.fill(0.0, samples)


def write_features(compared: DataFrame, samples: list[str], out: str, sample_attributes: bool = False) -> None:
    """Compared features as a table and as GFF3, in the order of their ids."""
    from isospark.session import cut

    kept = cut(compared)
    counts = [S.number_text(F.col(f"`{s}`")).alias(s) for s in samples]
    text.write_tsv(kept.select(F.col("id").alias("feature_id"), F.col("feature").alias("type"), F.col("contig").alias("chromosome"), "start", "end", "strand", *counts), f"{out}/features", ["feature_id"])
    info = F.concat(F.lit("ID="), "id", F.lit(";Name="), "id", F.lit(";feature_type="), "feature", *[F.concat(F.lit(f";{s}="), S.number_text(F.col(f"`{s}`"))) for s in samples if sample_attributes])
    rows = kept.select("contig", F.lit("compare").alias("source"), "feature", "start", "end", _total(samples).alias("score"), "strand", F.lit(".").alias("frame"), info.alias("info"), "id")
    text.write_gff(rows, f"{out}/features.gff3", ["id"], version=True)


def cluster_report(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Clusters of ``cluster_tables`` as rows, numbered CLUST_ by their first input row.

    ``rows`` has ``original_id`` and the ``flags`` columns besides; bounds are the outer ones, exons and
    introns those of the first row, a flag is 1 where a member has 1.
    """
    first = F.struct("idx", S.exons_text("exons").alias("exons"), F.array_join(F.transform(S.introns_of("exons", only_real=False), lambda i: F.concat_ws("-", i["s"].cast("string"), i["e"].cast("string"))), ";").alias("introns"))
    flag = [F.when(F.max((F.col(f"`{f}`") == "1").cast("int")) == 1, "1").otherwise(F.coalesce(F.min_by(F.when(~F.col(f"`{f}`").isin("", "0"), F.col(f"`{f}`")), F.when(~F.col(f"`{f}`").isin("", "0"), F.col("idx"))), F.lit("0"))).alias(f) for f in flags]
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c).cast("string"), F.lit("")))), ";")
    each = rows.groupBy("component").agg(F.min("idx").alias("first"), joined("original_id").alias("Original_Transcript_ID"), joined("contig").alias("chrom"), F.min("start").alias("Start"), F.max("end").alias("End"), joined("strand").alias("Strand"), F.min(first).alias("lead"), *flag)
    named = cluster.numbered(each, "CLUST_", ["first"], out="Cluster_ID")
    return named.select("Cluster_ID", "Original_Transcript_ID", "chrom", "Start", "End", "Strand", F.col("lead.exons").alias("Exon_Composition"), F.col("lead.introns").alias("Introns"), *[F.col(f"`{f}`") for f in flags])


def cluster_tables(rows: DataFrame, windows: tuple[int, int, int] = (10, 10, 10), greedy: bool = False, within: bool = True) -> DataFrame:
    """Transcripts of several tables (``idx, source, contig, strand, start, end, exons``) clustered by matches of
    their ends and introns: all of them, or exclusive pairs between sources."""
    t = transcripts_for_matching(rows)
    other = t.withColumnRenamed("idx", "idx2").withColumnRenamed("source", "source2")
    pairs = match.transcript_pairs(t, other, "idx", "idx2", *windows).where("idx < idx2")
    pairs = pairs.join(t.select("idx", "source"), "idx").join(other.select("idx2", "source2"), "idx2")
    if greedy:
        far = F.aggregate(F.zip_with("a_inner", "b_inner", lambda a, b: F.abs(a["s"] - b["s"]) + F.abs(a["e"] - b["e"])), F.lit(0).cast("long"), lambda s, x: s + x)
        ordered = pairs.where("source <> source2").withColumns({"d1": F.abs(F.col("a_tss") - F.col("b_tss")), "d2": F.abs(F.col("a_tes") - F.col("b_tes")), "d3": far})
        pairs = cluster.greedy_pairs(ordered.select("source", "source2", "idx", "idx2", "d1", "d2", "d3"), ["source", "source2"], "idx", "idx2", ["d1", "d2", "d3", "idx", "idx2"])
    elif not within:
        pairs = pairs.where("source <> source2")
    comp = cluster.components(pairs, "idx", "idx2")
    return rows.join(comp.select(F.col("node").alias("idx"), "component"), "idx", "left").withColumn("component", F.coalesce("component", "idx"))


def position_support(queries: DataFrame, positions: DataFrame, window: int = 10, stranded: bool = True) -> DataFrame:
    """How many positions lie near each query's start site."""
    keys = ["contig", "strand"] if stranded else ["contig"]
    q = match.with_sites(queries)
    return rangejoin.range_count(q, positions, keys, "tss", "pos", window, "support")


def run_annotation(spark: SparkSession, alignments: str, genome: str, out: str, params, form: str = "sam") -> None:
    """Reads alignments and a genome, writes the sites, introns, transcripts (GFF3, TSV) and tagged reads."""
    from isospark.plans.annotate import annotate
    from isospark.sources import fasta, sam

    reads = sam.read_alignments(spark, alignments)
    sequences = fasta.read_genome(spark, genome)
    a = annotate(reads, sequences, params)
    write_sites(a.tss, f"{out}/tss.gff3", "tss")
    write_sites(a.tes, f"{out}/tes.gff3", "tes")
    write_introns(a.introns, f"{out}/introns.gff3")
    text.write_tsv(a.rejected_introns.select("contig", "left", "right", "cnt", "coverage", "ratio", "consensus", "strand", "ts_score", "is_picked"), f"{out}/introns_not_qualified", ["contig", "left", "right"])
    lengths = sequences.contigs
    labelled = label_tags(a.reads)
    sam.write_alignments(labelled, f"{out}/reads", READ_TAGS, lengths, form)
    write_transcripts(a.tagged, a.transcripts, labelled, out, READ_TAGS, lengths, form)


def write_sites(sites: DataFrame, path: str, name: str) -> None:
    rows = sites.select("contig", F.lit("isospark").alias("source"), F.lit(name).alias("feature"), F.col("pos").alias("start"), F.col("pos").alias("end"), F.col("cnt").cast("double").alias("score"), "strand", F.lit(".").alias("frame"), F.concat(F.lit(f"ID={name}_"), "contig", F.lit("_"), F.col("pos").cast("string"), F.lit(";p="), F.col("poisp").cast("string")).alias("info"))
    text.write_gff(rows, path)


def write_introns(introns: DataFrame, path: str) -> None:
    rows = introns.select("contig", F.lit("isospark").alias("source"), F.lit("intron").alias("feature"), (F.col("left") + 1).alias("start"), (F.col("right") - 1).alias("end"), F.col("cnt").cast("double").alias("score"), "strand", F.lit(".").alias("frame"), F.coalesce("consensus", F.lit("None")).alias("info"))
    text.write_gff(rows, path)


def write_transcripts(tagged: DataFrame, counted: DataFrame, reads: DataFrame, out: str, tags: dict | None = None, lengths: DataFrame | None = None, form: str = "sam") -> None:
    """Transcripts as GFF3 and as a table, and the stranded reads with their sites and transcript."""
    from isospark.operators.transcripts import gff_rows
    from isospark.plans.annotate import transcript_table
    from isospark.sources import sam

    t = transcript_table(counted)
    text.write_gff(gff_rows(t.where("qualified")), f"{out}/transcripts.gff3")
    text.write_tsv(t.select("id", "contig", "strand", "ts", "te", S.exons_text("exons").alias("exons"), "reads", "qualified"), f"{out}/transcripts", ["contig", "ts", "te"])
    names = t.select("contig", "strand", "ts", "te", "introns", F.col("id").alias("tr"))
    known = tagged.where(~F.col("gap")).join(names, ["contig", "strand", "ts", "te", "introns"], "left").select(F.col("read").alias("qname"), "tr")
    sites = tagged.select(F.col("read").alias("qname"), *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("ts", "te")])
    whole = reads.where(F.col("flag").bitwiseAND(512) == 0).join(sites, "qname", "left").join(known, "qname", "left")
    sam.write_alignments(whole, f"{out}/transcripts", (tags or {}) | {"ts:i": "ts", "te:i": "te", "tr:Z": "tr"}, lengths, form)


#: Tags of labelled reads: the last base, the ends as score, place and status, introns, and introns that were rejected.
READ_TAGS = {"re:i": "end", "l3:Z": "l3", "r3:Z": "r3", "l5:Z": "l5", "r5:Z": "r5", "in:Z": "in", "ga:Z": "ga"}


def label_tags(labelled: DataFrame) -> DataFrame:
    """Labelled reads with their labels and introns as texts."""
    from isospark.sources import sam

    return labelled.withColumns({k: sam.end_text(k) for k in ("l3", "r3", "l5", "r5")} | {"in": sam.introns_text("introns"), "ga": sam.introns_text("lost")})


def report(classification: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """Category summary, length boxes, isoforms per gene and category shares of a classification table."""
    rows = summaries.require_columns(classification, ["isoform", "structural_category", "associated_gene", "length"]).withColumn("category", S.category("structural_category"))
    return {
        "categories": summaries.with_total(rows, by, "category", [F.count("*").alias("n"), F.avg("length").alias("mean_length")]),
        "lengths": quantiles.box_with_total(rows, by, "category", "length", "length"),
        "isoforms_per_gene": summaries.isoforms_per_gene(rows.where(S.valid_id("associated_gene")), by, "associated_gene", "isoform"),
        "shares": summaries.fractions(rows, by, "category", F.countDistinct("isoform")),
    }


def run_files(spark: SparkSession, command: str, out: str, files: list[str], window: int = 0, kind: str = "TSS", wobble: int = 10, reference: str = "", windows=(10, 10, 10), sample_attributes: bool = False, collapse: bool = False, missing: str = "0", intron_agg: str = "sum", show_methods: bool = False, exon_score_mode: str = "max") -> None:
    """The file commands: merge, sum, features and evaluate.  A file's name stands for its sample; a folder for the GFF files in it."""
    files = [f for given in files for f in text.find_files(spark, given)]
    if show_methods:
        for f in files:
            print(stem_of(f), f, sep="\t")
        return
    gff = text.read_gff(spark, files, exact=command == "evaluate").withColumn("sample", S.file_stem("path"))
    names = sorted({stem_of(f) for f in files})
    if command == "features":
        write_features(compare_features(text.read_gff(spark, reference), gff, names, window), names, out, sample_attributes)
        return
    if command == "sum" and kind == "intron":
        rows = gff.select("contig", "strand", "start", "end", F.coalesce("score", F.lit(1.0)).alias("score"), F.col("sample").alias("method"), F.col("path").alias("file"), F.col("start").alias("line"))
        text.write_tsv(sum_introns(rows, names, intron_agg, None if missing == "na" else 0.0), out, ["contig", "strand", "start", "end"])
        return
    if command == "sum":
        rows = gff.select("contig", "strand", "start", F.coalesce("score", F.lit(1.0)).alias("score"), F.col("sample").alias("method"))
        text.write_tsv(sum_sites(rows, kind, names, wobble, None if missing == "na" else 0.0), out, ["contig", "strand", "start"])
        return
    tx = text.transcripts_of_gff(gff.drop("sample"), support=exon_score_mode if command == "merge" else None).withColumn("sample", S.file_stem("path")).drop("path")
    tx = tx.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long"), "exons": F.col("exons").cast("array<struct<s:long,e:long>>")})
    if command == "merge":
        write_merged(merge_samples(tx, names, window), names, out, sample_attributes, collapse)
        return
    ref = text.read_transcript_table(spark, reference, "reference").withColumn("rid", F.col("idx").cast("string"))
    done = evaluate_files(ref, tx.withColumnsRenamed({"sample": "file", "id": "pid"}), tuple(windows))
    text.write_tsv(done["stats"], f"{out}/stats", ["file"])
    text.write_tsv(done["matches"].select("file", "rid", "pid"), f"{out}/matches", ["file", "rid", "pid"])
    text.write_tsv(done["false_positives"].select("seed", "file", "pid", "contig", "strand", "tss", "tes"), f"{out}/false_positives", ["contig", "strand", "tss"])
    clusters = false_positive_clusters(done["false_positives"], names)
    text.write_tsv(clusters.withColumn("introns", S.exons_text("introns")), f"{out}/false_positive_clusters", ["id"])
    text.write_tsv(done["not_found"].select("rid", "contig", "strand", "start", "end", S.exons_text("exons").alias("exons")), f"{out}/reference_not_found", ["contig", "start"])


def stem_of(path: str) -> str:
    """``scalar.file_stem`` for a path on the driver."""
    import re

    name = re.sub(r"(?i)\.gz$", "", path.rsplit("/", 1)[-1])
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", re.sub(r"\.[^.]+$", "", name))


def run_boundary(spark: SparkSession, out: str, manifest: str, mode: str = "TSS", window: int = 0, coords: str = "bed0", point_mode: str = "as_is", chr_mode: str = "keep", adjust: str = "bh", annotators: list[str] = ()) -> None:
    """Scores of the runs of a manifest (chemistry, cell line, GTF, reference), their means and tests, as tables.

    A GTF's folder or name tells its annotator.  All files of a kind are one scan, and all runs are matched in one job.
    """
    from isospark.session import cut

    from isospark.plans.tables import path_key

    runs = text.read_manifest(spark, manifest, dialect="reference")
    tags = ["mode", "chem", "cell", "annotator"]
    tagged = cut(runs.select(F.lit(mode).alias("mode"), F.col("chemistry").alias("chem"), F.col("`cell-line`").alias("cell"), (F.coalesce(S.annotator_in("gtf", annotators), F.lit(".")) if annotators else S.annotator_of("gtf")).alias("annotator"), "gtf", "reference"))
    listed = tagged.select("gtf", "reference").collect()  # a line a run

    def of_runs(rows: DataFrame, file: str) -> DataFrame:
        return rows.withColumn("_path", path_key(F.col("path"))).join(F.broadcast(tagged.select(*tags, path_key(F.col(file)).alias("_path"))), "_path")

    gff = text.read_gff(spark, sorted({r.gtf for r in listed}))
    pred = of_runs(text.point_gtf(gff, mode, dedup=False), "gtf").select(*tags, S.contig_name("contig", chr_mode).alias("contig"), "strand", "pos")
    bed = of_runs(text.read_bed(spark, sorted({r.reference for r in listed}), chr_mode), "reference")
    ref = text.bed_intervals(bed, window, coords, tags) if mode == "TSS" else text.bed_points(bed, window, point_mode, tags)
    scores = cut(boundary_benchmark(pred, ref, ["mode", "chem", "cell", "annotator"]))
    text.write_tsv(scores, f"{out}/scores", ["mode", "chem", "cell", "annotator"])
    done = boundary_statistics(scores, adjust)
    text.write_tsv(done["means"], f"{out}/means", ["mode", "chem", "annotator"])
    text.write_tsv(done["anova"], f"{out}/anova", ["mode", "chem", "term"])
    for name in ("annotators", "cells"):
        text.write_tsv(stats.in_report_order(done[name], ["mode", "chem"]), f"{out}/{name}")


def run_report(spark: SparkSession, out: str, classification: str, by: list[str] = ()) -> None:
    """The summaries of ``report`` as tables; numbers are read tolerantly, categories come in their preferred order."""
    rows = text.read_table(spark, classification)
    rows = rows.withColumns({"length": S.tolerant_double("length"), "_all": F.lit("all")})
    groups = list(by) or ["_all"]
    for name, table in report(rows, groups).items():
        wanted = table if by else table.drop("_all")
        text.write_tsv(summaries.in_category_order(wanted, list(by)) if "category" in wanted.columns else wanted.orderBy(*by, "bin"), f"{out}/{name}")


def run_clusters(spark: SparkSession, out: str, files: list[str], windows=(10, 10, 10), greedy: bool = False, no_within: bool = False) -> None:
    """Transcript tables clustered, one row a cluster."""
    rows, flags = None, []
    for k, f in enumerate(files):
        one = text.read_transcript_table(spark, f, stem_of(f), with_id=True).withColumn("idx", F.col("idx") + F.lit(k << 50))
        mine = [c for c in one.columns if "__" in c and c.endswith("_present")]
        flags += [c for c in mine if c not in flags]
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    rows = rows.na.fill("0", flags) if flags else rows
    done = cluster_tables(rows, tuple(windows), greedy, not no_within)
    text.write_tsv(cluster_report(done, sorted(flags)), out, ["Cluster_ID"])


def run_positions(spark: SparkSession, out: str, queries: str, positions: str, window: int = 10, unstranded: bool = False) -> None:
    """A table of positions with the number of others near each start site."""
    q = text.read_positions(spark, queries)
    near = match.with_sites(text.read_positions(spark, positions)).select("contig", "strand", F.col("tss").alias("pos"))
    text.write_tsv(position_support(q, near, window, not unstranded), out, ["contig", "start", "end"])


def run_gtf(spark: SparkSession, out: str, gff: str) -> None:
    """A GFF3 file as GTF: its transcripts if it has any, else its start and end sites."""
    rows = text.read_gff(spark, gff)
    if rows.where(F.lower("feature").isin("mrna", "transcript")).isEmpty():
        text.write_gff(text.boundary_gtf(rows), out)
        return
    name = gff.rsplit("/", 1)[-1].upper()
    made = text.gff3_to_gtf(rows, "TSS" if "TSS" in name else "TES" if "TES" in name else None)
    text.write_gff(made.withColumns({"source": F.lit("isospark"), "score": F.lit(None).cast("double"), "frame": F.lit(".")}), out)
