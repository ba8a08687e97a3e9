"""Introns: neighbours, splice sites and template switching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.functions.scalar import centre_score, splice_consensus

from .rangejoin import range_join


def neighbour_filter(introns: DataFrame, keys: list[str], left: str, right: str, count: str, wobble: int = 15, rare: float = 0.05) -> DataFrame:
    """Introns whose count over ``rare`` reaches the largest count of an intron with both ends within ``wobble``."""
    a = introns.select(*keys, F.col(left).alias("_l"), F.col(right).alias("_r"), F.col(count).alias("_c"))
    b = introns.select(*keys, F.col(left).alias("_l2"), F.col(right).alias("_r2"), F.col(count).alias("_c2"))
    near = range_join(a, b, keys, F.col("_l") - wobble, F.col("_l") + wobble, "_l2", 2 * wobble + 1).where(F.abs(F.col("_r") - F.col("_r2")) <= wobble)
    top = near.groupBy(*keys, F.col("_l").alias(left), F.col("_r").alias(right)).agg(F.max("_c2").alias("_top"))
    return introns.join(top, [*keys, left, right]).where(F.col(count) / F.lit(rare) >= F.col("_top")).drop("_top")


#: Bases of a contig in one piece.
PIECE = 4096


def genome_pieces(genome: DataFrame, margin: int, size: int) -> DataFrame:
    """``(contig, piece, bases)``: contigs in pieces of ``size`` bases, each with the first ``margin`` of the next one."""
    cuts = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    with_next = F.transform("_cuts", lambda p, i: F.concat(p, F.coalesce(F.substring(F.get("_cuts", i + 1), 1, margin), F.lit(""))))
    return genome.select("contig", cuts.alias("_cuts")).select("contig", F.posexplode(with_next).alias("piece", "bases"))


def with_splice_sites(introns: DataFrame, genome, half: int = 3, match: float = 2.0, mismatch: float = -3.0, left: str = "left", right: str = "right") -> DataFrame:
    """Adds border windows, outer bases, consensus, strand and the template switching score.

    ``introns(contig, left, right)`` name the last base before and the first after; ``genome``, a
    ``sources.fasta.Genome`` or a small table ``(contig, seq)``, must know every contig.  Each border
    meets the one piece of its contig that holds its window, so no joined row holds a contig.  Windows
    are clamped to the contig.
    """
    table = isinstance(genome, DataFrame)
    contigs = genome if table else genome.contigs
    unknown = introns.select("contig").distinct().join(contigs.select("contig"), "contig", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"contigs without a sequence: {', '.join(r[0] for r in unknown)}")
    pieces = genome_pieces(genome, 2 * half, PIECE) if table else genome.pieces(2 * half, PIECE)
    g = introns
    for name, last in (("leftseq", F.col(left)), ("rightseq", F.col(right) - 1)):
        # The window around a border begins ``half`` bases before it; a contig's bases count from 0 here.
        first = F.greatest(last - half, F.lit(0))
        at = g.withColumns({"_at": first, "piece": F.floor(first / F.lit(PIECE)).cast("int")})
        g = at.join(pieces, ["contig", "piece"], "left").withColumn(name, F.coalesce(F.substring("bases", F.col("_at") - F.col("piece") * PIECE + 1, F.lit(2 * half)), F.lit(""))).drop("_at", "piece", "bases")
    g = g.withColumns({"left2": F.substring("leftseq", half + 1, 2), "right2": F.substring("rightseq", half - 1, 2)})
    consensus, strand = splice_consensus("left2", "right2")
    g = g.withColumns({"consensus": consensus, "strand": strand, "ts_score": centre_score("leftseq", "rightseq", half, match, mismatch)})
    return g.withColumn("is_potential_ts", F.col("ts_score") >= match * half)
