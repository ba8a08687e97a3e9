"""From alignments to isoforms: the whole annotation as one lazy plan with one materialised table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.model import Params
from isospark.operators import cluster, coverage, ends, introns, peaks, transcripts
from isospark.session import cut


@dataclass
class Annotation:
    reads: DataFrame
    tss: DataFrame
    tes: DataFrame
    introns: DataFrame
    rejected_introns: DataFrame
    tagged: DataFrame
    transcripts: DataFrame


def label_reads(reads: DataFrame, p: Params) -> DataFrame:
    """Mapped reads, one per stretch of a name, with end labels, strand, introns."""
    rows = ends.mapped(reads).withColumn("ord", F.struct("contig", "start", "end", "cigar"))
    one = cluster.suppress_overlaps(rows).withColumn("qname", F.when(F.col("n_parts") > 1, F.concat_ws("_", "qname", F.col("part").cast("string"))).otherwise(F.col("qname")))
    labelled = ends.find_introns(ends.label_ends(one.drop("ord", "part", "n_parts"), p), p)
    return ends.assign_strand(labelled, p.drna)


def depth(reads: DataFrame) -> DataFrame:
    """Depth as segments by (contig, track); tracks are the strands ``+`` and ``-``, and ``all``."""
    strand = F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")
    blocks = ends.counted_in_depth(reads).select("contig", strand.alias("strand"), F.explode(ends.match_blocks(F.col("start"), F.col("ops"))).alias("b"))
    return coverage.segments(blocks.select("contig", F.explode(F.array("strand", F.lit("all"))).alias("track"), F.col("b.s").alias("bstart"), F.col("b.e").alias("bend")), ["contig", "track"])


def site_stats(counts: DataFrame, depth_of: DataFrame, p: Params) -> DataFrame:
    """Statistics of the positions of every end kind: ``l5`` and ``r5`` are starts, ``l3`` and ``r3`` ends.

    ``counts`` are those of ``ends.end_counts``.  The kind gives the strand; a site's share is of the
    depth on its own strand.
    """
    kind = F.col("kind")
    counts = counts.where("status = 'correct'").select("contig", "kind", "pos", "cnt")
    called = peaks.call_peaks(counts, ["contig", "kind"], window=p.window, wobble=p.wobble, descending=kind.startswith("r"))
    called = called.withColumn("track", F.when(kind.isin("l5", "r3"), "+").otherwise("-"))
    covered = peaks.inward_coverage(called, depth_of, left_side=kind.startswith("l"), distance=p.distance, sample=p.cov_sample, mode=p.coverage_mode, keys=("contig", "track"))
    rows = peaks.qualify(covered.withColumn("ratio", peaks.ratio_of("cnt", "coverage")), p.minimum, p.ratio)
    return rows.withColumnRenamed("track", "strand")


def call_sites(reads: DataFrame, depth_of: DataFrame, p: Params) -> DataFrame:
    """Qualified sites of every end kind."""
    return site_stats(ends.end_counts(reads), depth_of, p).where("is_qualified")


def qualified_introns(n: DataFrame, depth_of: DataFrame, p: Params) -> DataFrame:
    """Introns with coverage and ``is_qualified``: no far more frequent neighbour, counted often enough, and a
    large enough share of the mean depth on both sides (on the left as on right ends, see ``coverage_mode``).

    ``n`` are the counts of ``ends.intron_counts``.  Both tables are read several times, so they are
    computed once here.
    """
    n, depth_of = cut(n), cut(depth_of)
    near = introns.neighbour_filter(n, ["contig"], "left", "right", "cnt", p.intron_wobble, p.rare_intron).select("contig", "left", "right").withColumn("is_picked", F.lit(True))
    rows = n.join(near, ["contig", "left", "right"], "left").withColumns({"is_picked": F.coalesce("is_picked", F.lit(False)), "track": F.lit("all")})
    sides = dict(distance=p.distance, sample=p.cov_sample, mode=p.coverage_mode, keys=("contig", "track"))
    rows = peaks.inward_coverage(rows, depth_of, "right", True, out="rcov", **sides)
    rows = peaks.inward_coverage(rows, depth_of, "left", False, out="lcov", **sides)
    rows = rows.withColumn("coverage", (F.col("lcov") + F.col("rcov")) / 2).drop("track")
    return peaks.qualify(rows.withColumn("ratio", peaks.ratio_of("cnt", "coverage")), p.minimum, p.ratio)


def call_introns(counts: DataFrame, depth_of: DataFrame, genome, p: Params) -> DataFrame:
    """All introns with their splice sites and ``is_qualified``."""
    sites = introns.with_splice_sites(qualified_introns(counts, depth_of, p), genome, p.shs_for_ts, p.match_score, p.mismatch_score)
    return sites.withColumn("is_qualified", F.col("is_qualified") & F.col("consensus").isNotNull()) if p.force_consensus else sites


def read_rows(labelled: DataFrame) -> DataFrame:
    """Stranded reads as ``transcripts.annotate_reads`` takes them."""
    minus = F.col("flag").bitwiseAND(16) != 0
    return ends.stranded(labelled).select(
        F.col("qname").alias("read"), "contig", F.when(minus, "-").otherwise("+").alias("strand"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "introns", "gap",
        F.when(minus, F.col("r5.status")).otherwise(F.col("l5.status")).alias("five"), F.when(minus, F.col("l3.status")).otherwise(F.col("r3.status")).alias("three"),
    )


def annotate(reads: DataFrame, genome, p: Params = Params()) -> Annotation:
    """Sites, introns and transcripts of ``reads`` (see ``model.READ``) on a genome, see ``introns.with_splice_sites``."""
    labelled = cut(label_reads(reads, p))  # read by every later step
    d = cut(depth(labelled))
    sites = cut(call_sites(labelled, d, p))
    tss, tes = sites.where("kind in ('l5', 'r5')"), sites.where("kind in ('l3', 'r3')")
    if p.significance:
        tss = peaks.significant(tss)
    all_introns = cut(call_introns(ends.intron_counts(labelled), d, genome, p))
    found = all_introns.where("is_qualified")
    site = lambda t: t.select("contig", "strand", F.col("pos").cast("long").alias("pos"))
    known = found.select("contig", "strand", F.col("left").alias("s"), F.col("right").alias("e"))
    tagged = cut(transcripts.annotate_reads(read_rows(labelled), site(tss), site(tes), known, p.wobble, p.drna, p.shift, p.tss_gate))
    return Annotation(labelled, tss, tes, found, all_introns.where("not is_qualified"), tagged, transcripts.count_transcripts(tagged, p.mintr_count))


def transcript_table(tx: DataFrame) -> DataFrame:
    """Counted transcripts with bounds, exons and sequential ids, for the GFF writer."""
    s, e = F.least("ts", "te"), F.greatest("ts", "te")
    t = tx.withColumns({"start": s, "end": e, "exons": transcripts.exons_between(s, e, F.col("introns")), "score": F.col("reads").cast("double")})
    return cluster.numbered(t, "tr", ["contig", "start", "end", "strand", F.col("introns").cast("string")], 1)
