"""Runs over the tables of a manifest: active references, recovery, novelty, weighted and endpoint statistics.

All files of a manifest are one scan: lines carry the path of their file, the header of each is found in
the scan itself, and tags are joined by path.  So plans are as long for ten runs as for ten thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.functions import scalar as S
from isospark.operators import reports, stats, summaries
from isospark.session import cut
from isospark.sources import text

#: Columns of classification and junction tables, with the names they go by; those of ``MAY`` may be missing.
CLASSIFICATION = {"isoform": ["isoform"], "structural_category": ["structural_category"], "associated_gene": ["associated_gene"], "associated_transcript": ["associated_transcript"]}
MAY = {
    "length": ["length"], "coding": ["coding"], "within_cage": ["within_cage_peak", "within_cage"], "within_polya": ["within_polya_site", "within_polya"], "motif_found": ["polya_motif_found", "motif_found"],
    "polya_dist": ["polya_dist"], "diff_tss": ["diff_to_gene_tss"], "iso_exp": ["iso_exp"], "gene_exp": ["gene_exp"],
}
JUNCTION = {
    "isoform": ["isoform"], "chrom": ["chrom"], "strand": ["strand"], "jstart": ["genomic_start_coord"], "jend": ["genomic_end_coord"], "junction_category": ["junction_category"], "splice_site": ["splice_site"],
}
MAY_JUNCTION = {"rts": ["rts_junction"]}


def path_key(path: Column) -> Column:
    """A path without its scheme, so that a manifest's and a scan's are the same."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), "/+", "/")


def scan_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, part, line, value)`` of all files at once; ``part`` and ``line`` give their order within a file."""
    rows = spark.read.text(paths).select(path_key(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("part"), F.regexp_replace("value", "\r$", "").alias("value"))
    return rows.select("path", "part", F.monotonically_increasing_id().alias("line"), "value")


def scan_tables(spark: SparkSession, manifest: DataFrame, path: str, wanted: dict[str, list[str]], may: dict[str, list[str]] | None = None, sep: str = "\t") -> DataFrame:
    """The rows of all tables of a manifest with its other columns and the wanted ones, as text.

    A table's header is its line that has all of the wanted columns, under one of their names in any case.
    Tables without such a line are an error; columns of ``may`` are null where a table lacks them.
    """
    runs = manifest.withColumn("_path", path_key(F.col(path))).drop(path)
    paths = [r[0] for r in manifest.select(path).distinct().collect()]  # a line a run
    lines = scan_lines(spark, paths).select("path", F.split("value", sep).alias("c"))
    names = F.transform("c", lambda x: F.lower(F.trim(F.regexp_replace(x, "^﻿", ""))))
    place = lambda aliases: F.coalesce(*[F.nullif(F.array_position("_names", a.lower()), F.lit(0).cast("long")) for a in aliases])
    places = {n: place(a) for n, a in {**wanted, **(may or {})}.items()}
    whole = lines.withColumn("_names", names)
    is_header = F.lit(True)
    for n in wanted:
        is_header = is_header & places[n].isNotNull()
    heads = cut(whole.where(is_header).groupBy("path").agg(F.first("_names").alias("_names")).select(F.col("path").alias("_path"), *[p.alias(f"_at_{n}") for n, p in places.items()]))
    lacking = [r[0] for r in runs.select("_path").distinct().join(heads, "_path", "left_anti").limit(5).collect()]
    if lacking:
        raise ValueError(f"tables without the columns {', '.join(wanted)}: {', '.join(lacking)}")
    body = whole.where(~is_header).drop("_names").withColumnRenamed("path", "_path").join(F.broadcast(heads), "_path")
    body = body.where(F.size("c") > 1).select("_path", *[F.trim(F.get("c", F.col(f"_at_{n}").cast("int") - 1)).alias(n) for n in places])
    return body.join(F.broadcast(runs), "_path").drop("_path")


def _runs(spark: SparkSession, manifest: str, dialect: str) -> DataFrame:
    m = text.read_manifest(spark, manifest, dialect=dialect)
    named = {"chemistry": "chemistry", "chemical": "chemistry", "cell-line": "cell_line", "cell": "cell_line", "annotator": "annotator"}
    return m.select(*[F.col(f"`{c}`").alias(named.get(c, c)) for c in m.columns])


def known_transcript(c: str = "associated_transcript", strip: bool = False) -> Column:
    """A transcript's name; null for the words that stand for none."""
    t = F.when(~F.upper(c).isin("", "NA", "NAN", "."), F.col(c))
    return S.strip_version(t) if strip else t


def active_references(spark: SparkSession, out: str, manifest: str, gtf: str, strip: bool = False, strict: bool = False) -> None:
    """For each chemistry and cell line the lines of a GTF that its classified transcripts (full or incomplete
    matches) are on, with gene rows of their genes and header lines, in the order of the file, as
    ``out/chemistry=.../cell_line=...``.  ``strict``: a group without any is an error."""
    runs = text.read_manifest(spark, manifest, ["chemistry", "cell-line", "gtf"]).withColumnRenamed("cell-line", "cell_line")
    groups = ["chemistry", "cell_line"]
    rows = reports.matched(scan_tables(spark, runs, "gtf", CLASSIFICATION)).select(*groups, known_transcript(strip=strip).alias("id"))
    active = cut(rows.where("id is not null").distinct())
    if strict and not (empty := runs.select(*groups).distinct().join(active, groups, "left_anti")).isEmpty():
        raise ValueError(f"no transcript is active in {tuple(empty.first())}")
    lines = scan_lines(spark, [gtf])
    t = S.gtf_attribute("value", "transcript_id")
    body = lines.where(~F.col("value").startswith("#")).withColumns({"id": S.strip_version(t) if strip else t, "gene": S.gtf_attribute("value", "gene_id")})
    kept = body.where("id is not null").join(active, "id")
    genes = kept.where("gene is not null").select(*groups, "gene").distinct()
    order = [*groups, "part", "line"]
    heads = lines.where(F.col("value").startswith("#")).join(F.broadcast(runs.select(*groups).distinct()))
    whole = kept.select(*order, "value").unionByName(body.where("id is null").join(genes, "gene").select(*order, "value")).unionByName(heads.select(*order, "value"))
    whole.orderBy(*order).select("chemistry", "cell_line", "value").write.mode("overwrite").partitionBy(*groups).text(out)


def recovery(spark: SparkSession, out: str, manifest: str, strip: bool = False, adjust: str = "bh", composition: bool = False, annotators: list[str] = ()) -> None:
    """How many transcripts of its reference each run finds, fully, in part and at all, with means and tests by chemistry.

    The manifest has chemistry, cell line, classification and reference; an annotator is told by the
    classification's path.  A run whose reference is empty has no recall.
    """
    tool = F.coalesce(S.annotator_in("gtf", annotators, "token"), F.lit(".")) if annotators else S.annotator_of("gtf")
    runs = text.read_manifest(spark, manifest, dialect="reference").withColumnRenamed("cell-line", "cell_line").withColumn("annotator", tool)
    by = ["chemistry", "cell_line", "annotator"]
    rows = cut(scan_tables(spark, runs.drop("reference"), "gtf", CLASSIFICATION))
    references = [r[0] for r in runs.select("reference").distinct().collect()]
    t = S.gtf_attribute("value", "transcript_id")
    ids = scan_lines(spark, references).where(~F.col("value").startswith("#")).select("path", (S.strip_version(t) if strip else t).alias("id")).where("id is not null").distinct()
    universe = cut(ids.join(F.broadcast(runs.select(*by, path_key(F.col("reference")).alias("path"))), "path").drop("path"))
    found = reports.matched(rows).select(*by, known_transcript(strip=strip).alias("id"), S.is_full_match("structural_category").alias("full")).where("id is not null")
    best = found.groupBy(*by, "id").agg(F.max("full").alias("full"), F.max(~F.col("full")).alias("part"))
    n = universe.join(best, [*by, "id"], "left").groupBy(*by).agg(F.count("*").alias("reference"), F.count_if("full").alias("fsm"), F.count_if("part").alias("ism"), F.count("full").alias("either"))
    shares = {f"{c}_recall": F.try_divide(F.col(c), F.col("reference")) for c in ("fsm", "ism", "either")}
    scores = cut(runs.select(*by).join(n, by, "left").na.fill(0, ["reference", "fsm", "ism", "either"]).withColumns(shares))
    text.write_tsv(scores, f"{out}/scores", by)
    text.write_tsv(scores.groupBy("chemistry", "annotator").agg(*[F.avg(c).alias(c) for c in shares]), f"{out}/means", ["chemistry", "annotator"])
    text.write_tsv(stats.anova_blocked(scores, ["chemistry"], "annotator", "cell_line", "either_recall"), f"{out}/anova", ["chemistry", "term"])
    tests = stats.paired_tests(scores, ["chemistry"], ["cell_line"], "annotator", "either_recall", adjust)
    text.write_tsv(stats.in_report_order(tests, ["chemistry"]), f"{out}/annotators")
    if composition:
        text.write_tsv(rows.groupBy(*by, "structural_category").agg(F.count("*").alias("n")), f"{out}/composition", [*by, "structural_category"])


def novelty(spark: SparkSession, out: str, classifications: str, junctions: str, annotators: list[str] = ()) -> None:
    """Novel isoforms and junctions of the runs of two manifests: burden, support by other tools and chemistries,
    plausibility, and how consistent isoforms and genes are."""
    tool = S.annotator_in("gtf", annotators, "folder") if annotators else S.annotator_of("gtf")
    runs = text.read_manifest(spark, classifications, ["chemistry", "cell-line", "gtf"]).withColumnRenamed("cell-line", "cell_line").withColumn("annotator", tool)
    if unknown := runs.where("annotator is null").select("gtf").limit(5).collect():
        raise ValueError(f"paths that tell no annotator: {', '.join(r[0] for r in unknown)}")
    c = cut(scan_tables(spark, runs, "gtf", CLASSIFICATION))
    j = scan_tables(spark, _runs(spark, junctions, "junctions"), "junctions", JUNCTION, MAY_JUNCTION)
    by = ["annotator", "chemistry", "cell_line"]
    condition = reports.novelty_burden(c, by)
    text.write_tsv(condition, f"{out}/burden_by_condition", by)
    text.write_tsv(reports.novelty_burden(c, ["annotator"]), f"{out}/burden_by_annotator", ["annotator"])
    text.write_tsv(reports.burden_long(condition, by), f"{out}/burden_long", [*by, "kind"])
    novel = cut(reports.novel_junctions(j))
    text.write_tsv(reports.support_shares(novel, by), f"{out}/junction_support", by)
    joined = cut(reports.with_classification(novel, c))
    text.write_tsv(reports.plausibility(joined, by), f"{out}/plausibility", [*by, "scope"])
    text.write_tsv(reports.isoform_canonicality(novel, by), f"{out}/isoform_canonicality", by)
    text.write_tsv(reports.locus_consistency(joined, by), f"{out}/locus_consistency", by)


def _classified(spark: SparkSession, manifest: str) -> DataFrame:
    rows = scan_tables(spark, _runs(spark, manifest, "database"), "classification", CLASSIFICATION, MAY)
    return rows.withColumns({n: S.tolerant_double(n) for n in ("length", "polya_dist", "diff_tss", "iso_exp", "gene_exp")})


def weighted_stats(spark: SparkSession, out: str, manifest: str, weight: str = "none") -> None:
    """By run and category: isoforms and the shares of them that are coding, near cap sites, and at poly(A) sites
    with a motif; weighted by ``iso_exp`` or ``gene_exp``, where a missing weight counts as one."""
    rows = _classified(spark, manifest).withColumn("category", S.category("structural_category"))
    by = ["annotator", "chemistry", "cell_line", "category"]
    text.write_tsv(reports.expression_rates(rows, by, None if weight == "none" else weight), out, by)


def endpoints(spark: SparkSession, out: str, manifest: str, exact: int = 5, close: int = 40) -> None:
    """Support of both ends by run, for all isoforms and the four main categories, those without any isoform too."""
    by = ["annotator", "chemistry", "cell_line"]
    done = reports.endpoint_support(reports.over_categories(_classified(spark, manifest)), [*by, "category"], exact, close)
    counts = [c for c, k in done.dtypes if k == "bigint"]
    grid = summaries.complete(done, by, {"category": ["ALL", *reports.FOUR.values()]}, {c: 0 for c in counts})
    text.write_tsv(grid, out, [*by, "category"])
