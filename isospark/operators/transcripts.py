"""Transcripts from annotated reads, and their GFF rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .match import all_introns_accepted
from .rangejoin import first_in_window, shifted_first


def gff_rows(tx: DataFrame, source: str = "isospark") -> DataFrame:
    """One mRNA row and a row per exon of ``tx(id, contig, start, end, strand, score, exons)``."""
    row = lambda f, s, e, info: F.struct(F.lit(f).alias("feature"), s.cast("long").alias("start"), e.cast("long").alias("end"), info.alias("info"))
    whole = F.array(row("mRNA", F.col("start"), F.col("end"), F.concat(F.lit("ID="), F.col("id"))))
    exons = F.transform("exons", lambda x: row("exon", x["s"], x["e"], F.concat(F.lit("Parent="), F.col("id"))))
    rows = tx.select("contig", "strand", "score", F.explode(F.concat(whole, exons)).alias("r"))
    return rows.select("contig", F.lit(source).alias("source"), "r.feature", "r.start", "r.end", "score", "strand", F.lit(".").alias("frame"), "r.info")


def exons_between(start, end, introns):
    """Exons of a transcript from its bounds and its introns (last and first exonic base)."""
    s = F.concat(F.array(start.cast("long")), F.transform(introns, lambda i: i["e"].cast("long")))
    e = F.concat(F.transform(introns, lambda i: i["s"].cast("long")), F.array(end.cast("long")))
    return F.zip_with(s, e, lambda a, b: F.struct(a.alias("s"), b.alias("e")))


def annotate_reads(reads: DataFrame, tss: DataFrame, tes: DataFrame, introns: DataFrame, wobble: int = 10, drna: bool = False, shift: int = 30, tss_gate: str = "reference") -> DataFrame:
    """Adds ``ts``, ``te`` (sites, -1 without) and ``accepted`` to ``reads(read, contig, strand, start,
    end, introns, gap, five, three)``; ``five`` and ``three`` are the statuses of the true ends.

    Sites are ``(contig, strand, pos)``; introns ``(contig, strand, s, e)``.  On cDNA a start counts if
    its status is good, or, as the reference has it, if the end is out of place.
    """
    good = ("correct", "potential template switching")
    at = reads.withColumns({"_5": F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")), "_3": F.when(F.col("strand") == "+", F.col("end")).otherwise(F.col("start"))})
    keys = ["contig", "strand"]
    found = shifted_first(at, tss, keys, "_5", "pos", wobble, shift, out="ts") if drna else first_in_window(at, tss, keys, "_5", "pos", wobble, "ts")
    found = first_in_window(found, tes, keys, "_3", "pos", wobble, "te")
    five = F.lit(True) if drna else F.col("five").isin(*good) | (F.col("three" if tss_gate == "reference" else "five") == "out of place")
    three = F.col("three").isin(*good, "out of place")
    found = found.withColumns({"ts": F.when(five, F.col("ts")).otherwise(-1), "te": F.when(three, F.col("te")).otherwise(-1)}).drop("_5", "_3")
    return found.join(all_introns_accepted(found, introns, "read"), "read")


def count_transcripts(annotated: DataFrame, least: int = 1) -> DataFrame:
    """Reads per (contig, strand, ts, introns, te) of reads with both sites and accepted introns; all are
    listed, ``qualified`` says which have ``least`` reads."""
    whole = annotated.where((F.col("ts") > 0) & (F.col("te") > 0) & F.col("accepted") & ~F.col("gap"))
    n = whole.groupBy("contig", "strand", "ts", "introns", "te").agg(F.count("*").alias("reads"))
    return n.withColumn("qualified", F.col("reads") >= least)
