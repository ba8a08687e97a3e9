"""The annotation in four stages, each from files to files: labels, statistics, features, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.model import Params
from isospark.operators import ends, peaks, transcripts
from isospark.plans import annotate, suites
from isospark.sources import fasta, sam, text

COUNTS = "kind string, status string, contig string, pos int, cnt long"
INTRONS = "contig string, left int, right int, cnt long"
SEGMENTS = "contig string, track string, seg_start long, seg_end long, depth long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def label(spark: SparkSession, alignments: str, out: str, p: Params, form: str = "sam") -> None:
    """Labelled reads as SAM or BAM, counts of ends and introns, and depth per strand and of all reads as segments."""
    reads = sam.read_alignments(spark, alignments)
    labelled = annotate.cut(annotate.label_reads(reads, p))
    sam.write_alignments(suites.label_tags(labelled), f"{out}/reads", suites.READ_TAGS, form=form)
    text.write_tsv(ends.end_counts(labelled), f"{out}/ends", ["kind", "contig", "pos", "status"])
    text.write_tsv(ends.intron_counts(labelled), f"{out}/introns", ["contig", "left", "right"])
    text.write_tsv(annotate.depth(labelled), f"{out}/depth", ["track", "contig", "seg_start"])


def statistics(spark: SparkSession, labels: str, genome: str, out: str, p: Params) -> None:
    """Statistics of all end positions and introns that ``label`` has counted."""
    d = annotate.cut(_table(spark, f"{labels}/depth", SEGMENTS))
    text.write_tsv(annotate.site_stats(_table(spark, f"{labels}/ends", COUNTS), d, p), f"{out}/sites", ["kind", "contig", "pos"])
    i = annotate.call_introns(_table(spark, f"{labels}/introns", INTRONS), d, fasta.read_genome(spark, genome), p)
    text.write_tsv(i, f"{out}/introns", ["contig", "left", "right"])


def _stats_of(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    rows = text.read_table(spark, path)
    return rows.select(*[F.col(c).cast(k).alias(c) for c, k in wanted.items()])


_SITE = {"contig": "string", "kind": "string", "pos": "int", "cnt": "long", "strand": "string", "average": "double", "poisp": "double", "is_picked": "boolean", "coverage": "double", "ratio": "double", "is_qualified": "boolean"}
_INTRON = {"contig": "string", "left": "int", "right": "int", "cnt": "long", "strand": "string", "consensus": "string", "is_qualified": "boolean"}


def features(spark: SparkSession, stats: str, out: str, p: Params) -> None:
    """Qualified start sites (significant ones if asked), end sites and introns as GFF3."""
    sites = _stats_of(spark, f"{stats}/sites", _SITE).where("is_qualified")
    tss = sites.where("kind in ('l5', 'r5')")
    suites.write_sites(peaks.significant(tss) if p.significance else tss, f"{out}/tss.gff3", "tss")
    suites.write_sites(sites.where("kind in ('l3', 'r3')"), f"{out}/tes.gff3", "tes")
    i = _stats_of(spark, f"{stats}/introns", _INTRON).where("is_qualified")
    i = i.withColumn("consensus", F.nullif("consensus", F.lit("")))
    suites.write_introns(i.where("consensus is not null") if p.force_consensus else i, f"{out}/introns.gff3")


def labelled_rows(reads: DataFrame) -> DataFrame:
    """Stranded reads with tags of ``label`` as ``transcripts.annotate_reads`` takes them; missing tags count as missing."""
    tag = lambda k: F.col("tags")[k]
    status = lambda k: F.coalesce(F.get(F.split(tag(k), ","), F.lit(3)), F.lit("missing"))
    pairs = F.regexp_extract_all(F.coalesce(tag("in"), F.lit("")), F.lit(r"\((\d+), (\d+)\)"), F.lit(0))
    introns = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"(\d+),", 1).cast("int").alias("s"), F.regexp_extract(x, r", (\d+)", 1).cast("int").alias("e")))
    minus = F.col("flag").bitwiseAND(16) != 0
    return ends.stranded(reads).select(
        F.col("qname").alias("read"), "contig", F.when(minus, "-").otherwise("+").alias("strand"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        introns.alias("introns"), tag("ga").isNotNull().alias("gap"), F.when(minus, status("r5")).otherwise(status("l5")).alias("five"), F.when(minus, status("l3")).otherwise(status("r3")).alias("three"),
    )


def assemble(spark: SparkSession, labels: str, feature_folder: str, out: str, p: Params, form: str = "sam") -> None:
    """Transcripts of the labelled reads by the features of the last stage: GFF3, a table, and tagged reads."""
    reads = ends.mapped(sam.read_alignments(spark, f"{labels}/reads.{form}"))
    gff = {n: text.read_gff(spark, f"{feature_folder}/{n}.gff3") for n in ("tss", "tes", "introns")}
    site = lambda n: gff[n].select("contig", "strand", F.col("start").cast("long").alias("pos"))
    known = gff["introns"].select("contig", "strand", (F.col("start") - 1).alias("s"), (F.col("end") + 1).alias("e"))
    tagged = annotate.cut(transcripts.annotate_reads(labelled_rows(reads), site("tss"), site("tes"), known, p.wobble, p.drna, p.shift, p.tss_gate))
    suites.write_transcripts(tagged, transcripts.count_transcripts(tagged, p.mintr_count), reads, out, form=form)
