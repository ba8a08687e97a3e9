"""Tables of isoforms compared within windows, and features summed over a list of prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isospark.functions import scalar as S
from isospark.operators import match
from isospark.operators.summaries import resolve_column
from isospark.plans import suites
from isospark.plans.tables import path_key
from isospark.session import cut
from isospark.sources import text

#: The columns of an isoform table, by the names they go by; all others hold values.
COLUMNS = {"id": ["isoform", "transcript_id", "id"], "contig": ["chromosome", "chrom", "seqid"], "start": ["start"], "end": ["end", "stop"], "strand": ["strand"], "exons": ["exon_composition", "exon_comp"]}


def isoforms(spark: SparkSession, path: str, key: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """A table's rows numbered by ``key``, the same as ``match.transcript_pairs`` takes them, and its columns by meaning.

    Every strand but ``+`` counts as reverse here; rows whose bounds are no numbers match nothing.
    """
    df = text.read_table(spark, path)
    names = {}
    for what, aliases in COLUMNS.items():
        try:
            names[what] = resolve_column(df, aliases)
        except ValueError:
            if what != "id":
                raise
    rows = cut(df.withColumn(key, F.monotonically_increasing_id()))
    c = lambda what: F.col(f"`{names[what]}`")
    start, end, plus = S.tolerant_int(c("start")), S.tolerant_int(c("end")), F.trim(c("strand")) == "+"
    sides = rows.select(key, F.trim(c("contig")).alias("contig"), F.trim(c("strand")).alias("strand"), F.when(plus, start).otherwise(end).alias("tss"), F.when(plus, end).otherwise(start).alias("tes"), S.exons_from_text(c("exons")).alias("exons"))
    return rows, sides.where("tss is not null and tes is not null").withColumn("introns", S.introns_of("exons", only_real=False)), names


def compare_isoforms(spark: SparkSession, out: str, base: str, query: str, windows=(10, 10, 5)) -> None:
    """The base table with every value column of the query table: sums over all isoforms that match, 0 without any."""
    rows, a, _ = isoforms(spark, base, "_a")
    other, b, names = isoforms(spark, query, "_b")
    values = [c for c in other.columns if c != "_b" and c not in names.values()]
    pairs = match.transcript_pairs(a, b, "_a", "_b", *windows, by="boundaries").select("_a", "_b")
    named = {c: c if c not in rows.columns else f"query_{c}" for c in values}
    sums = pairs.join(other, "_b").groupBy("_a").agg(*[F.sum(F.coalesce(S.tolerant_double(f"`{c}`"), F.lit(0.0))).alias(n) for c, n in named.items()]) if values else pairs.select("_a").distinct()
    text.write_tsv(rows.join(sums, "_a", "left").na.fill(0.0, list(named.values())).orderBy("_a").drop("_a"), out)


def compare_categories(spark: SparkSession, out: str, base: str, query: str, windows=(10, 10, 5), category: str = "category", ids: str = "Matched_Transcript_IDs", categories: str = "Matched_Categories") -> None:
    """The base table with the names and categories of all isoforms of the query table that match, in its order; 0 without any."""
    rows, a, _ = isoforms(spark, base, "_a")
    other, b, names = isoforms(spark, query, "_b")
    if "id" not in names:
        raise ValueError(f"{query} has none of the columns {', '.join(COLUMNS['id'])}")
    labels = other.select("_b", F.col(f"`{names['id']}`").alias("_name"), F.col(f"`{resolve_column(other, [category, 'structural_category'])}`").alias("_category"))
    pairs = cut(match.transcript_pairs(a, b, "_a", "_b", *windows, by="boundaries").select("_a", "_b"))
    done = match.collect_labels(rows, pairs, labels, "_a", "_b", "_name", "_b", ids)
    done = match.collect_labels(done, pairs, labels, "_a", "_b", "_category", "_b", categories)
    text.write_tsv(done.orderBy("_a").drop("_a"), out)


#: Where the end sites of a prefix are looked for.
TES_FILES = {"auto": ["_not_ts_tes.gff3", "_tes.gff3"], "not_ts": ["_not_ts_tes.gff3"], "ts": ["_ts_tes.gff3"], "tes": ["_tes.gff3"]}


def sum_prefixes(spark: SparkSession, out: str, prefixes: str, kind: str = "TSS", tes_input: str = "auto", wobble: int = 10, intron_agg: str = "sum", missing: str = "0", show_methods: bool = False) -> None:
    """Sites or introns of the runs of a list of path prefixes, a line each, summed by the method that a prefix stands for.

    The files of all prefixes are one scan.  ``show_methods`` prints the methods alone.
    """
    listed = [r.value.strip().rstrip("/") for r in text.read_lines(spark, prefixes).select("value").collect()]  # a line a run
    methods = {p: suites.method_of(p) for p in listed if p}
    if show_methods:
        for p, m in methods.items():
            print(m, p, sep="\t")
        return
    suffixes = TES_FILES[tes_input] if kind == "TES" else [f"_{kind.lower()}.gff3"]
    files = {p: text.existing(spark, p, suffixes) for p in methods}
    known = spark.createDataFrame([(f, methods[p]) for p, f in files.items()], "file string, method string").select(path_key(F.col("file")).alias("_path"), "method")
    gff = text.read_gff(spark, sorted(set(files.values())))
    rows = gff.withColumn("_path", path_key(F.col("path"))).join(F.broadcast(known), "_path").withColumn("score", F.coalesce("score", F.lit(1.0)))
    names, empty = sorted(set(methods.values())), None if missing == "na" else 0.0
    if kind == "intron":
        done = suites.sum_introns(rows.select("contig", "strand", "start", "end", "score", "method", F.col("path").alias("file"), F.col("start").alias("line")), names, intron_agg, empty)
        text.write_tsv(done, out, ["contig", "strand", "start", "end"])
    else:
        text.write_tsv(suites.sum_sites(rows.select("contig", "strand", "start", "score", "method"), kind, names, wobble, empty), out, ["contig", "strand", "start"])
