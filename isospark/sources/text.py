"""Readers and writers of annotation texts: GFF, GTF, BED, FASTA, depth tables, manifests, TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isospark.functions import scalar as S
from isospark.model import GFF


def read_lines(spark: SparkSession, path, **options) -> DataFrame:
    """``(value, path)`` of text files, gzip read by suffix, carriage returns dropped, comments and blanks left out."""
    lines = spark.read.options(**options).text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("path"))
    return lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))


def read_gff(spark: SparkSession, path, exact: bool = False, **options) -> DataFrame:
    """Nine columns and the file's path.  Lines with fewer columns (or, if ``exact``, more), or whose bounds
    are no integers, are dropped; a score of ``.`` is null; bounds in the wrong order are swapped."""
    c = F.split("value", "\t")
    n = F.size("c")
    rows = read_lines(spark, path, **options).withColumn("c", c).where(n == 9 if exact else n >= 9)
    g = rows.select(*[F.get("c", F.lit(i)).alias(name) for i, name in enumerate(["contig", "source", "feature", "a", "b", "score", "strand", "frame", "info"])], "path")
    g = g.withColumns({"a": F.col("a").try_cast("int"), "b": F.col("b").try_cast("int"), "score": F.col("score").try_cast("double")}).where("a is not null and b is not null")
    return g.select("contig", "source", "feature", F.least("a", "b").alias("start"), F.greatest("a", "b").alias("end"), "score", "strand", "frame", "info", "path")


def transcripts_of_gff(gff: DataFrame, tx_features=("mRNA", "transcript"), support: str | None = None) -> DataFrame:
    """``(id, contig, strand, start, end, exons, reads)``, and ``path`` where ``gff`` has it.

    Exons go by their ``Parent`` ids, within a file and contig.  A transcript without exons is one exon, one
    that only exons name spans them; reads are the score or the first numeric count attribute, else 0.  With
    ``support`` (max, mean, sum, first) they are the score, else that of the exons' scores in the order of their
    starts, else 1.  Attributes are GFF3's or GTF's.
    """
    rows = gff.withColumn("a", S.attributes("info"))
    keys = [*(["path"] if "path" in gff.columns else []), "contig", "id"]
    tx = rows.where(F.col("feature").isin(*tx_features)).withColumn("id", F.coalesce(F.col("a")["ID"], F.col("a")["transcript_id"], F.col("a")["Name"])).where("id is not null")
    reads = F.coalesce("score", *[F.col("a")[k].try_cast("double") for k in ("read_count", "reads", "count", "support", "coverage")], F.lit(0.0))
    tx = tx.select(*keys, S.clean_strand("strand").alias("strand"), "start", "end", (F.col("score") if support else reads).alias("reads"))
    parents = F.explode(F.split(F.coalesce(F.col("a")["Parent"], F.col("a")["transcript_id"]), ",")).alias("id")
    exons = rows.where("feature = 'exon'").select(*keys[:-1], parents, F.struct(F.col("start").alias("s"), F.col("end").alias("e")).alias("x"), S.clean_strand("strand").alias("_strand"), "score")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("x", "score"))), lambda y: y["score"])
    per = exons.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("exons"), F.min("_strand").alias("_strand"), *([scores.alias("_scores")] if support else []))
    whole = F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))
    low, high = F.array_min(F.transform("exons", lambda x: x["s"])), F.array_max(F.transform("exons", lambda x: x["e"]))
    out = tx.join(per, keys, "full")
    columns = ["id", "contig", F.coalesce("strand", "_strand").alias("strand"), F.coalesce("start", low).alias("start"), F.coalesce("end", high).alias("end"), F.coalesce("exons", whole).alias("exons"), (S.support_count("reads", F.coalesce("_scores", F.array().cast("array<double>")), support) if support else F.coalesce("reads", F.lit(0.0))).alias("reads")]
    return out.select(*columns, *keys[:-2])


def write_tsv(df: DataFrame, path: str, order: list | None = None, header: bool = True) -> None:
    """Tab-separated files, in order over all files if one is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("sep", "\t").option("header", header).option("emptyValue", "").option("nullValue", "").csv(path)


def write_gff(rows: DataFrame, path: str, order=("contig", "start", "end"), version: bool = False) -> None:
    """GFF rows in order; a null score as ``.``; ``version`` puts the version line first."""
    names = [c.split()[0] for c in GFF.split(", ")]
    out = rows.withColumn("score", F.coalesce(S.number_text("score"), F.lit(".")))
    value = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in names])
    lines = out.select(F.lit(1).alias("_k"), *order, value.alias("value"))
    if version:
        head = rows.sparkSession.createDataFrame([(0, "##gff-version 3")], "_k int, value string")
        lines = head.unionByName(lines, allowMissingColumns=True)
    lines.orderBy("_k", *order).select("value").write.mode("overwrite").text(path)


def find_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".gff3", ".gff", ".gtf", ".gff3.gz", ".gff.gz", ".gtf.gz")) -> list[str]:
    """Files below a folder that have one of the suffixes and are not empty, sorted; a file stands for itself.

    The listing is Spark's, so any store that it reads will do.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not any(c in path for c in "*?[{") and not system.getFileStatus(hadoop).isDirectory():
        return [path]
    # Spark wrote this folder as one file.
    if path.endswith(suffixes):
        return [path]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path")
    return sorted(r.path for r in found.collect() if r.path.lower().endswith(suffixes))


def boundary_gtf(gff: DataFrame) -> DataFrame:
    """Rows of type tss or tes as transcript rows of a GTF, tagged with their kind."""
    a = S.gff3_attributes("info")
    kind = F.lower("feature")
    rows = gff.where(kind.isin("tss", "tes")).withColumns({"a": a, "kind": F.upper("feature")})
    strand = S.clean_strand("strand")
    name = F.coalesce(F.col("a")["ID"], F.col("a")["Name"], F.concat_ws("_", "contig", F.col("start").cast("string"), strand))
    info = F.concat(F.lit('gene_id "gene_'), name, F.lit('"; transcript_id "tx_'), name, F.lit('"; tag "'), "kind", F.lit('";'))
    return rows.select("contig", "source", F.lit("transcript").alias("feature"), "start", "end", F.lit(None).cast("double").alias("score"), strand.alias("strand"), F.lit(".").alias("frame"), info.alias("info"))


def write_active_gtf(spark: SparkSession, gtf, active: DataFrame, path: str, strip: bool = False) -> None:
    """The lines of a GTF that belong to active transcripts, in the order of the file, header lines first."""
    from isospark.plans.suites import active_gtf

    lines = spark.read.text(gtf).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"))
    lines = lines.withColumn("line", F.monotonically_increasing_id())
    head = F.col("value").startswith("#")
    order = ["path", "part", "line"]
    body = active_gtf(lines.where(~head), active, strip, order)
    rows = lines.where(head).select(F.lit(0).alias("k"), *order, "value").unionByName(body.select(F.lit(1).alias("k"), *order, "value"))
    rows.orderBy("k", *order).select("value").write.mode("overwrite").text(path)


def gff3_to_gtf(gff: DataFrame, tag: str | None = None) -> DataFrame:
    """Transcript and exon rows in GTF attributes, exons numbered from the 5' end; ``tag`` (see
    ``scalar.default_tag``) marks the transcript rows."""
    tx = transcripts_of_gff(gff)
    names = gff.withColumn("a", S.gff3_attributes("info")).select(F.coalesce(F.col("a")["ID"], F.col("a")["transcript_id"], F.col("a")["Name"]).alias("id"), F.col("a")["gene_id"].alias("gene")).where("id is not null").dropDuplicates(["id"])
    t = tx.join(names, "id", "left").withColumn("gene", F.coalesce("gene", F.concat(F.lit("gene_"), F.col("id"))))
    ordered = F.when(F.col("strand") == "-", F.reverse("exons")).otherwise(F.col("exons"))
    base = F.concat(F.lit('gene_id "'), F.col("gene"), F.lit('"; transcript_id "'), F.col("id"), F.lit('";'))
    rows = F.concat(
        F.array(F.struct(F.lit("transcript").alias("feature"), "start", "end", (F.concat(base, F.lit(f' tag "{tag}";')) if tag else base).alias("info"))),
        F.transform(ordered, lambda x, i: F.struct(F.lit("exon").alias("feature"), x["s"].alias("start"), x["e"].alias("end"), F.concat(base, F.lit(' exon_number "'), (i + 1).cast("string"), F.lit('";')).alias("info"))),
    )
    return t.select("contig", "strand", F.explode(rows).alias("r")).select("contig", "r.feature", "r.start", "r.end", "strand", "r.info")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def point_gtf(gtf: DataFrame, kind: str = "TSS", dedup: bool = True) -> DataFrame:
    """Start or end points of the transcript rows on either strand, each position once (its first row)."""
    at = S.start_site if kind == "TSS" else S.end_site
    p = gtf.where("feature = 'transcript' and strand in ('+', '-')").withColumn("pos", at("start", "end", "strand"))
    p = p.withColumns({"start": F.col("pos"), "end": F.col("pos"), "info": F.concat(F.col("info"), F.lit(f' tag "{kind}";'))})
    return first_of(p, ["contig", "strand", "pos"], ["path", "info"]) if dedup else p


def bed_intervals(bed: DataFrame, window: int, coords: str = "bed0", keep: tuple = ()) -> DataFrame:
    """One-based inclusive intervals of BED rows, widened; 'bed0' counts starts from 0, 'bed1' from 1."""
    lo = F.greatest(F.col("start0") + (1 if coords == "bed0" else 0) - window, F.lit(1))
    return bed.select(*keep, "contig", "strand", lo.alias("lo"), (F.col("end") + window).alias("hi")).where("hi >= lo").distinct()


def bed_points(bed: DataFrame, window: int, coords: str = "as_is", keep: tuple = ()) -> DataFrame:
    """Points of BED rows as intervals of ``window`` on either side."""
    p = F.col("start0") + (1 if coords == "bed0_to_1based" else 0)
    return bed.select(*keep, "contig", "strand", F.greatest(p - window, F.lit(1)).alias("lo"), (p + window).alias("hi")).where("hi >= lo").distinct()


def read_bed(spark: SparkSession, path, chr_mode: str = "keep") -> DataFrame:
    c = F.split(F.trim("value"), r"\s+")
    rows = read_lines(spark, path).withColumn("c", c).where(F.size("c") >= 6)
    rows = rows.select(S.contig_name(F.get("c", F.lit(0)), chr_mode).alias("contig"), F.get("c", F.lit(1)).try_cast("int").alias("start0"), F.get("c", F.lit(2)).try_cast("int").alias("end"), F.get("c", F.lit(3)).alias("name"), F.get("c", F.lit(4)).alias("score"), F.get("c", F.lit(5)).alias("strand"), "path")
    return rows.where("start0 is not null and end is not null and strand in ('+', '-')")


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """``(contig, seq)`` of a small genome, a row a contig; ``fasta.read_genome`` gives large ones in pieces."""
    from isospark.sources.fasta import read_genome

    genome = read_genome(spark, path)
    whole = genome.pieces(0).groupBy("contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "bases"))), lambda x: x["bases"]), "").alias("seq"))
    return genome.contigs.select("contig").join(whole, "contig", "left").na.fill("", ["seq"])


def read_depth(spark: SparkSession, path, contigs: DataFrame | None = None) -> DataFrame:
    """Depth rows with integer columns; others are dropped.  With ``contigs(contig)``, only theirs."""
    c = F.split("value", "\t")
    d = read_lines(spark, path).select(F.get(c, F.lit(0)).alias("contig"), F.get(c, F.lit(1)).try_cast("int").alias("pos"), F.get(c, F.lit(2)).try_cast("int").alias("depth"))
    d = d.where("pos is not null and depth is not null")
    return d if contigs is None else d.join(contigs.select("contig").distinct(), "contig", "left_semi")


#: Columns of the manifest dialects, by name; 'runs' has no header line, the others may have one.
MANIFESTS = {
    "reference": ["chemistry", "cell-line", "gtf", "reference"],
    "runs": ["chemistry", "cell_line", "path"],
    "junctions": ["annotator", "chemical", "cell", "junctions"],
    "database": ["annotator", "chemical", "cell", "classification"],
}


def read_manifest(spark: SparkSession, path, columns: list[str] | None = None, dialect: str | None = None) -> DataFrame:
    """Rows of a manifest, white-space or tab separated, by its columns or its dialect.

    A first line that repeats the column names is its header; further columns of a line are left out.
    """
    columns = columns or MANIFESTS[dialect]
    c = F.split(F.trim("value"), r"\t" if dialect in ("junctions", "database") else r"\s+")
    rows = read_lines(spark, path).withColumn("c", c).where(F.size("c") >= len(columns))
    rows = rows.select(*[F.trim(F.get("c", F.lit(i))).alias(n) for i, n in enumerate(columns)])
    return rows if dialect == "runs" else rows.where(F.lower(F.col(f"`{columns[0]}`")) != columns[0].lower())


def read_table(spark: SparkSession, path, aliases: dict[str, list[str]] | None = None, sep: str = "\t") -> DataFrame:
    """A table with a header, columns found by their aliases whatever their case; a byte order mark is dropped."""
    from isospark.operators.summaries import resolve_column

    df = spark.read.option("sep", sep).option("header", True).option("mode", "PERMISSIVE").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df if aliases is None else df.select(*[F.col(f"`{resolve_column(df, a)}`").alias(n) for n, a in aliases.items()])


def find_tables(spark: SparkSession, path: str, required: list[str], pattern: str = "*.{txt,tsv,csv}") -> list[str]:
    """Files under a folder, not empty, whose first line holds all required column names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).where("length > 0").select("path")
    names = [r.path for r in files.collect()]  # a listing of files, not their rows
    if not names:
        return []
    lines = spark.read.text(names).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"), "value")
    first = lines.groupBy("path").agg(F.min_by("value", F.struct("part", "line")).alias("value"))
    columns = F.transform(F.split(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), ",", "\t"), "\t"), lambda c: F.trim(c))
    wanted = F.array(*[F.lit(c) for c in required]).cast("array<string>")
    return sorted(r.path for r in first.where(F.size(F.array_except(wanted, columns)) == 0).select("path").collect())


def read_transcript_table(spark: SparkSession, path, source: str, with_id: bool = False) -> DataFrame:
    """``(idx, source, contig, strand, start, end, exons, reads)`` of a transcript TSV with the usual names.

    Rows whose bounds are no numbers are dropped, bounds in the wrong order swapped; without an exon
    text the whole transcript is one exon; further columns that end in ``_present`` are kept as
    ``<source>__<column>``, empty ones as "0".  ``idx`` rises with the lines of a file that is not split.
    ``with_id`` adds the table's own names as ``original_id``.
    """
    from isospark.operators.summaries import resolve_column

    df = read_table(spark, path)

    def column(*aliases: str):
        try:
            return F.col(f"`{resolve_column(df, list(aliases))}`")
        except ValueError:
            return F.lit(None).cast("string")

    a, b = S.tolerant_int(column("start")), S.tolerant_int(column("end"))
    flags = [c for c in df.columns if c.endswith("_present")]
    rows = df.select(
        F.monotonically_increasing_id().alias("idx"),
        F.lit(source).alias("source"),
        *([F.coalesce(column("transcript_id", "isoform", "id"), F.lit("")).alias("original_id")] if with_id else []),
        column("chromosome", "seqid", "seqnames", "chrom").alias("contig"),
        S.clean_strand(column("strand")).alias("strand"),
        F.when(b.isNotNull(), F.least(a, b)).alias("start"),
        F.when(a.isNotNull(), F.greatest(a, b)).alias("end"),
        S.exons_from_text(column("exon_composition", "exons")).alias("exons"),
        F.coalesce(S.tolerant_double(column("reads", "read_count", "count")), F.lit(0.0)).alias("reads"),
        *[F.coalesce(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")), F.lit("0")).alias(f"{source}__{c}") for c in flags],
    ).where("start is not null and end is not null")
    whole = F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))
    return rows.withColumn("exons", F.when(F.size("exons") > 0, F.col("exons")).otherwise(whole))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """``(contig, strand, start, end, name)`` of a TSV or GFF file, told apart by suffix; rows on either strand only."""
    if path.lower().rstrip("gz").rstrip(".").endswith((".gff", ".gff3", ".gtf")):
        g = read_gff(spark, path).withColumn("a", S.gff3_attributes("info"))
        names = F.coalesce(F.col("a")["ID"], F.col("a")["transcript_id"], F.col("a")["Name"], F.col("a")["gene_id"], F.lit(""))
        rows = g.select("contig", "strand", "start", "end", names.alias("name"))
    else:
        t = read_table(spark, path, {"contig": ["seqnames"], "strand": ["strand"], "start": ["start"], "end": ["end"]})
        rows = t.select("contig", "strand", S.tolerant_int("start").alias("start"), S.tolerant_int("end").alias("end"), F.lit("").alias("name"))
    return rows.where(F.col("strand").isin("+", "-"))


def existing(spark: SparkSession, prefix: str, suffixes: list[str]) -> str:
    """The first of ``prefix + suffix`` that is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for s in suffixes:
        p = hadoop(prefix + s)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return prefix + s
    raise FileNotFoundError(f"none of {', '.join(prefix + s for s in suffixes)}")
