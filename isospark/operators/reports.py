"""Summaries of classification, junction and score tables, each a function of a table and its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isospark.functions import scalar as S
from isospark.session import cut

from . import match, quantiles, summaries

#: Columns that name an isoform across runs.
RUN = ("annotator", "chemistry", "cell_line", "isoform")


def expression_rates(rows: DataFrame, by: list[str], weight: str | None = "iso_exp", coding: str = "coding", cage: str = "within_cage", motif: str = "motif_found", polya: str = "within_polya") -> DataFrame:
    """Per group: rows, and the shares that are coding, near a cap site, and at a poly(A) site with a motif, weighted."""
    w = None if weight is None else F.col(weight)
    total = F.sum(F.lit(1.0) if weight is None else F.coalesce(w.cast("double"), F.lit(1.0)))
    r = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        total.alias("_w"),
        summaries.rate(F.coalesce(S.coding_class(coding) == "coding", F.lit(False)), w).alias("coding_rate"),
        summaries.rate(S.bool_or_false(cage), w).alias("cage_rate"),
        summaries.rate(S.bool_or_false(motif) & S.bool_or_false(polya), w).alias("site_motif_rate"),
    )
    return r.where("_w > 0").drop("_w")


def matched(rows: DataFrame, category: str = "structural_category") -> DataFrame:
    """Rows that match a reference transcript, fully or in part."""
    return rows.where(S.is_full_match(category) | S.is_incomplete_match(category))


def recall_of(rows: DataFrame, universe: DataFrame, by: list[str], transcript: str = "associated_transcript", category: str = "structural_category") -> DataFrame:
    """Per group: reference transcripts of ``universe(transcript)`` found fully, in part, at all, and the share found."""
    known = universe.select(transcript).distinct()
    total = known.agg(F.count("*").alias("total"))
    hit = matched(rows, category).join(known, transcript, "left_semi")
    full, part = F.when(S.is_full_match(category), F.col(transcript)), F.when(S.is_incomplete_match(category), F.col(transcript))
    n = hit.groupBy(*by).agg(F.countDistinct(full).alias("fsm"), F.countDistinct(part).alias("ism"), F.countDistinct(transcript).alias("either"))
    return n.join(F.broadcast(total)).withColumn("recall", F.col("either") / F.col("total")).drop("total")


def coding_share(rows: DataFrame, by: list[str], cell: str | None = None, coding: str = "coding") -> DataFrame:
    """The coding share of a group: of its rows, or as the mean of its cells' shares."""
    p = summaries.share(S.coding_class(coding) == "coding").alias("coding")
    if cell is None:
        return rows.groupBy(*by).agg(p)
    return rows.groupBy(*by, cell).agg(p).groupBy(*by).agg(F.avg("coding").alias("coding"))


def isoforms_over_cells(rows: DataFrame, by: list[str], cell: str, gene: str = "associated_gene", isoform: str = "isoform") -> DataFrame:
    """Mean isoforms per gene over cells, weighted by their genes, and the number of genes."""
    k = rows.groupBy(*by, cell, gene).agg(F.countDistinct(isoform).alias("k"))
    m = k.groupBy(*by, cell).agg(F.avg("k").alias("m"), F.count("*").alias("t"))
    return m.groupBy(*by).agg(summaries.weighted_mean("m", "t").alias("mean_isoforms"), F.sum("t").alias("total"))


def box_over_cells(rows: DataFrame, by: list[str], cell: str, value: str = "length", cap: float = 60000.0) -> DataFrame:
    """Medians and largest values of cells averaged; the latter capped for display."""
    q = quantiles.box(rows, [*by, cell], value, value)
    return q.groupBy(*by).agg(F.avg(f"{value}_median").alias("median"), F.least(F.avg(f"{value}_max"), F.lit(cap)).alias("top_capped"))


def structure_counts(rows: DataFrame, by: list[str], category: str = "structural_category") -> DataFrame:
    """Counts by group and category; empty or missing names are ``(empty)``."""
    named = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("(empty)")).alias(c) for c in by]
    return rows.groupBy(*named, category).agg(F.count("*").alias("n"))


def novel_junctions(junctions: DataFrame, contig: str = "chrom", strand: str = "strand", start: str = "jstart", end: str = "jend", category: str = "junction_category", site: str = "splice_site") -> DataFrame:
    """Junctions that are not known, with their ``junction`` key and whether the splice site is ``canonical``."""
    return junctions.where(S.category(category) != "known").withColumns({"junction": S.junction_key(contig, strand, start, end), "canonical": S.canonical_site(site)})


def support_shares(novel: DataFrame, by: list[str]) -> DataFrame:
    """Per group: different novel junctions, and the shares that several tools, or anything else, support."""
    d = novel.select(*by, "junction").distinct().join(summaries.junction_support(novel, []), "junction", "left")
    return d.groupBy(*by).agg(F.count("*").alias("n"), summaries.share(F.col("support") == "cross_tool").alias("cross_tool"), summaries.share(F.col("support") != "single").alias("supported"))


def with_classification(novel: DataFrame, classification: DataFrame, keys=RUN) -> DataFrame:
    """Junctions with the category and gene of their isoform; repeated rows of the classification count once."""
    return novel.join(classification.select(*keys, "structural_category", "associated_gene").distinct(), list(keys), "left")


def plausibility(classified: DataFrame, by: list[str], switching: str = "rts") -> DataFrame:
    """Per group, for all novel junctions and those of isoforms that are not in the catalogue: rows, the canonical
    share, and the share that template switching may explain."""
    y = classified.withColumn("scope", F.lit("all_novel")).unionByName(classified.where(S.category("structural_category") == "novel_not_in_catalog").withColumn("scope", F.lit("nnc_only")))
    return y.groupBy(*by, "scope").agg(F.count("*").alias("n"), summaries.share(F.col("canonical")).alias("canonical"), summaries.share(S.bool_missing_false(switching)).alias("rts"))


def isoform_canonicality(novel: DataFrame, by: list[str], isoform: str = "isoform") -> DataFrame:
    """Per group: isoforms, the share whose junctions are all canonical, and the median number of junctions."""
    i = cut(novel.groupBy(*by, isoform).agg(F.bool_and("canonical").alias("good"), F.count("*").alias("k")))
    out = i.groupBy(*by).agg(F.count("*").alias("n"), summaries.share(F.col("good")).alias("all_canonical"))
    return quantiles.with_median(out, i, by, "k", "median_junctions")


def locus_consistency(classified: DataFrame, by: list[str], gene: str = "associated_gene") -> DataFrame:
    """Per group: genes with novel junctions, the median number of those, and how many have two or three."""
    g = cut(classified.where(F.col(gene).isNotNull()).groupBy(*by, gene).agg(F.countDistinct("junction").alias("nj")))
    out = g.groupBy(*by).agg(
        F.countDistinct(gene).alias("n_genes"), F.count_if(F.col("nj") >= 2).alias("n2"), F.count_if(F.col("nj") >= 3).alias("n3"), summaries.share(F.col("nj") >= 2).alias("f2")
    )
    return quantiles.with_median(out, g, by, "nj", "median_size")


def metric_means(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per group: the mean F1 of its runs, summed counts, and precision and recall of the sums."""
    m = scores.groupBy(*by).agg(F.avg("f1").alias("mean_f1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return match.with_rates(m)


def side_by_side(scores: DataFrame, keys: list[str], name: str, names: tuple[str, str], value: str = "f1") -> DataFrame:
    """A score of two modes in one row; keys that lack one of them are left out."""
    a, b = (scores.where(F.col(name) == n).select(*keys, F.col(value).alias(f"{value}_{n}")) for n in names)
    return a.join(b, keys)


def endpoint_support(rows: DataFrame, by: list[str], exact: int = 5, close: int = 40, cage: str = "within_cage", site: str = "within_polya", motif: str = "motif_found", distance: str = "polya_dist", shift: str = "diff_tss") -> DataFrame:
    """Per group: how many ends are supported, by cap sites, poly(A) sites and motifs; a motif is close if it lies in the
    ``close`` bases before the end, a start exact if it lies within ``exact`` of the gene's.  Flags other than true and
    false are unknown."""
    x = rows.select(*by, S.bool_exact(cage).alias("_cage"), S.bool_exact(site).alias("_site"), S.bool_exact(motif).alias("_motif"), F.col(distance).alias("_dist"), F.abs(shift).alias("_shift"))
    near = F.col("_motif") & F.col("_dist").between(-close, 0)
    out = x.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if("_cage").alias("cage_true"),
        F.count_if(~F.col("_cage")).alias("cage_false"),
        F.count_if(F.col("_cage").isNull()).alias("cage_na"),
        summaries.share(F.col("_cage")).alias("cage_rate"),
        F.count_if("_site").alias("site_true"),
        F.count_if("_motif").alias("motif_true"),
        F.count_if(near).alias("motif_close"),
        F.try_divide(F.count_if(near), F.count_if("_motif")).alias("close_rate"),
        F.count_if(F.coalesce("_site", F.lit(False)) | near).alias("supported"),
        summaries.share(F.col("_shift") <= exact).alias("exact_rate"),
    )
    return quantiles.with_median(out, x, by, "_shift", "tss_median")


#: The categories that endpoint tables list beside all isoforms.
FOUR = {"full_splice_match": "FSM", "incomplete_splice_match": "ISM", "novel_in_catalog": "NIC", "novel_not_in_catalog": "NNC"}


def over_categories(rows: DataFrame, category: str = "structural_category", out: str = "category") -> DataFrame:
    """Each row once for all isoforms, and once for its category if that is one of the four."""
    four = F.create_map(*[F.lit(x) for kv in FOUR.items() for x in kv])
    return rows.withColumn(out, F.explode(F.array_compact(F.array(F.lit("ALL"), four[S.category(category)]))))


def novelty_burden(rows: DataFrame, by: list[str], category: str = "structural_category") -> DataFrame:
    """Per group: novel isoforms in and not in the catalogue, their ratio (null without any of the former) and share."""
    c = S.category(category)
    n = rows.groupBy(*by).agg(F.count_if(c == "novel_in_catalog").alias("nic"), F.count_if(c == "novel_not_in_catalog").alias("nnc"), F.count("*").alias("n"))
    return n.withColumns({"ratio": F.try_divide(F.col("nnc"), F.col("nic")), "novel_share": (F.col("nic") + F.col("nnc")) / F.col("n")})


def burden_long(burden: DataFrame, by: list[str]) -> DataFrame:
    """A burden table with a row per kind of novel isoforms, and the kind's share of them."""
    long = burden.unpivot(by, ["nic", "nnc"], "kind", "n")
    whole = F.sum("n").over(Window.partitionBy(*by))
    return long.withColumn("fraction", F.try_divide(F.col("n"), whole))


def turned_pairs(pairs: DataFrame, least: float = 0.10) -> DataFrame:
    """Differences of ``stats.paired`` turned to (later, earlier), with the symmetric limit of their colour scale."""
    limit = pairs.agg(F.greatest(F.lit(least), F.max(F.abs("mean_diff"))).alias("colour_limit"))
    return pairs.withColumns({"first": F.col("b"), "second": F.col("a"), "delta": -F.col("mean_diff")}).join(F.broadcast(limit))
