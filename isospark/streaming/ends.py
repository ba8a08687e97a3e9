"""Counting read ends as alignments arrive: the batch operators over a stream of SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.model import Params
from isospark.operators import ends


def stream_sam(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Lines of SAM files as they appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)


def label_stream(lines: DataFrame, p: Params = Params()) -> DataFrame:
    """Mapped reads of SAM lines with end labels and introns.  Per-read work only, so it needs no state;
    overlaps between alignments of one name are left to the batch run."""
    c = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@")).select(c.alias("c")).where(F.size("c") >= 11)
    reads = rows.select(F.get("c", F.lit(0)).alias("qname"), F.get("c", F.lit(1)).cast("int").alias("flag"), F.get("c", F.lit(2)).alias("contig"), F.get("c", F.lit(3)).cast("int").alias("start"), F.get("c", F.lit(4)).cast("int").alias("mapq"), F.get("c", F.lit(5)).alias("cigar"), F.get("c", F.lit(9)).alias("seq"))
    reads = reads.withColumn("end", F.col("start") + ends.aligned_length(ends.parse_cigar("cigar")) - 1)
    return ends.assign_strand(ends.find_introns(ends.label_ends(ends.mapped(reads), p), p), p.drna)


def count_stream(lines: DataFrame, p: Params = Params()):
    """End counts over the stream so far; state is one number per (kind, status, contig, position)."""
    return ends.end_counts(label_stream(lines, p))
