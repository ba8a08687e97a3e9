"""Alignments as SAM texts, read natively and split by Spark; ``read_alignments`` takes BAM as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.model import READ
from isospark.operators.ends import aligned_length, parse_cigar
from isospark.sources.bam import read_bam, write_bam

_COLUMNS = ("qname", "flag", "contig", "start", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a BAM file or folder of that name, else of SAM texts."""
    return read_bam(spark, path) if path.rstrip("/").endswith(".bam") else read_sam(spark, path)


def read_sam(spark: SparkSession, path) -> DataFrame:
    """Mapped and unmapped reads; header lines and lines of fewer than eleven columns are left out.

    Tags become a map of text values by their two letters, and one of their types.
    """
    c = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@")).select(c.alias("c")).where(F.size("c") >= 11)
    r = lines.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(_COLUMNS)], F.slice("c", F.lit(12), F.size("c")).alias("t"))
    tags = F.map_from_entries(F.transform("t", lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 30))))
    types = F.map_from_entries(F.transform("t", lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 4, 1))))
    numbers = {n: F.col(n).cast("int") for n in ("flag", "start", "mapq", "pnext", "tlen")}
    r = r.withColumns(numbers | {"tags": tags, "tag_types": types})
    r = r.withColumn("end", F.col("start") + aligned_length(parse_cigar("cigar")) - 1)
    return r.select(*[x.split()[0] for x in READ.split(", ")])


def sam_lines(reads: DataFrame, tags: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """SAM lines of reads: their columns, the tags they came with, and new ones.

    ``tags`` gives, by tag and type such as ``ts:i``, the column to write (nulls are left out); a tag
    of the same letters that was read gives way.  Columns that ``reads`` lacks are written as unknown.
    """
    known = {"qname": "*", "flag": "0", "contig": "*", "start": "0", "mapq": "255", "cigar": "*", "rnext": "*", "pnext": "0", "tlen": "0", "seq": "*", "qual": "*"}
    body = [F.coalesce(F.col(c).cast("string"), F.lit(v)) if c in reads.columns else F.lit(v) for c, v in known.items()]
    new = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))) for k, c in tags.items()]
    if "tags" not in reads.columns:
        return reads.select(*(keep or []), F.concat_ws("\t", *body, *new).alias("value"))
    ours = F.array(*[F.lit(k[:2]) for k in tags]).cast("array<string>")
    kept = F.filter(F.map_entries("tags"), lambda e: ~F.array_contains(ours, e["key"]))
    types = F.col("tag_types") if "tag_types" in reads.columns else F.lit(None).cast("map<string,string>")
    old = F.transform(kept, lambda e: F.concat_ws(":", e["key"], F.coalesce(types[e["key"]], F.lit("Z")), e["value"]))
    return reads.select(*(keep or []), F.concat_ws("\t", *body, F.coalesce(old, F.array().cast("array<string>")), *new).alias("value"))


def write_sam(reads: DataFrame, path: str, tags: dict[str, str], contigs: DataFrame | None = None, program: str = "isospark") -> None:
    """A coordinate-sorted SAM file in parts: joined in the order of their names they are one.

    The first part begins with the header: order, contigs and program.  ``contigs(contig, length)``
    gives lengths; without it the contigs of the reads are listed with the furthest end.  Unmapped
    reads come last.
    """
    spark = reads.sparkSession
    if contigs is None:
        contigs = reads.where("contig is not null and contig <> '*'").groupBy("contig").agg(F.max("end").alias("length"))
    line = lambda *x: F.concat_ws("\t", *x)
    mark = spark.createDataFrame([(0, "@HD\tVN:1.6\tSO:coordinate"), (2, f"@PG\tID:{program}\tPN:{program}")], "part int, value string").select("part", F.lit("").alias("name"), F.lit(0).cast("long").alias("at"), "value")
    listed = contigs.select(F.lit(1).alias("part"), F.col("contig").alias("name"), F.lit(0).cast("long").alias("at"), line(F.lit("@SQ"), F.concat(F.lit("SN:"), "contig"), F.concat(F.lit("LN:"), F.col("length").cast("string"))).alias("value"))
    mapped = F.coalesce(F.col("contig") != "*", F.lit(False))
    lines = sam_lines(reads.withColumns({"_part": F.when(mapped, 3).otherwise(4), "_name": F.coalesce("contig", F.lit("")), "_at": F.coalesce(F.col("start").cast("long"), F.lit(0))}), tags, ["_part", "_name", "_at"])
    mark.union(listed).union(lines).orderBy("part", "name", "at", "value").select("value").write.mode("overwrite").text(path)


def write_alignments(reads: DataFrame, path: str, tags: dict[str, str], contigs: DataFrame | None = None, form: str = "sam") -> None:
    """Reads as ``path.sam`` or as ``path.bam``, indexed parts of it."""
    if form == "bam":
        write_bam(reads, f"{path}.bam", tags, contigs)
    else:
        write_sam(reads, f"{path}.sam", tags, contigs)


def view(spark: SparkSession, alignments: str, out: str, region: str | None = None, without_flags: int = 0, with_flags: int = 0, least_quality: int = 0, form: str = "bam") -> None:
    """A filtered copy of alignments: by a region such as ``chr1:100-200`` (looked up in the index of a BAM file), by
    flags that no read or every read has, and by mapping quality."""
    reads = read_alignments(spark, alignments)
    if region:
        contig, _, places = region.rpartition(":") if ":" in region else (region, "", "")
        low, _, high = places.replace(",", "").partition("-")
        reads = reads.where((F.col("contig") == contig) & (F.col("end") >= int(low or 1)))
        reads = reads.where(F.col("start") <= int(high)) if high else reads
    flags = lambda n: F.col("flag").bitwiseAND(F.lit(n))
    reads = reads.where((flags(without_flags) == 0) & (flags(with_flags) == with_flags) & (F.coalesce("mapq", F.lit(0)) >= least_quality))
    write_alignments(reads, f"{out}/reads", {}, form=form)


def introns_text(introns: str):
    """Introns as ``(a, b),(c, d)``; null for none."""
    t = F.array_join(F.transform(introns, lambda i: F.format_string("(%d, %d)", i["s"], i["e"])), ",")
    return F.when(F.size(introns) > 0, t)


def end_text(label: str):
    """An end label as ``score,start,end,status``."""
    c = F.col(label)
    return F.concat_ws(",", F.regexp_replace(c["score"].cast("string"), r"\.0$", ""), c["s"].cast("string"), c["e"].cast("string"), c["status"])
