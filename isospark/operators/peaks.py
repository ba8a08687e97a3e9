"""Calling transcript ends from position counts: windowed means, local maxima, picks and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isospark.functions.scalar import poisson_tail

#: Positions of a contig that one window partition covers.
STRETCH = 1 << 16


def call_peaks(counts: DataFrame, keys: list[str], pos: str = "pos", count: str = "cnt", window: int = 50, wobble: int = 10, descending: bool | Column = False) -> DataFrame:
    """Adds ``average``, ``is_greatest``, ``is_picked`` and ``poisp`` to ``counts(keys, pos, count)``.

    ``average`` is the mean count over the ``2 * window + 1`` positions around; a position is the
    greatest if none within ``wobble`` has more; of greatest ones in a row no further apart than
    ``wobble`` the first is picked, in falling order of position if ``descending`` (a bool, or one per key).  ``poisp`` is the
    probability of more than the count under a Poisson law with the average as mean.
    """
    # Stretches of a contig are worked on apart, with a margin that holds all a position depends on:
    # the mean looks ``window`` away, a pick at a greatest position ``wobble`` away, and that one as far again.
    rows = stretches(counts, pos, max(window, 2 * wobble))
    part = [*keys, "_stretch"]
    by = Window.partitionBy(*part).orderBy(F.col(pos).cast("long"))
    mean = F.sum(count).over(by.rangeBetween(-window, window)) / F.lit(float(2 * window + 1))
    top = F.max(count).over(by.rangeBetween(-wobble, wobble))
    rows = rows.withColumns({"average": mean, "is_greatest": F.col(count) == top})
    # Greatest positions alone decide who is first: the nearest greatest one before.
    falling = F.lit(descending) if isinstance(descending, bool) else descending
    order = F.when(falling, -F.col(pos).cast("long")).otherwise(F.col(pos).cast("long"))
    before = F.last(F.when(F.col("is_greatest"), order), ignorenulls=True).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_gap", order - before)
    picked = F.col("is_greatest") & (F.col("_gap").isNull() | (F.col("_gap") > wobble))
    own = rows.withColumn("is_picked", picked).where("_stretch = _own").drop("_gap", "_stretch", "_own")
    return own.withColumn("poisp", poisson_tail(F.col(count), F.col("average")))


def stretches(rows: DataFrame, pos: str, margin: int, width: int = STRETCH) -> DataFrame:
    """Each row once for its own stretch (``_own``) and again for a neighbour (``_stretch``) within ``margin``."""
    bin_of = lambda c: F.floor(c / F.lit(width))
    near = F.array_distinct(F.array(bin_of(F.col(pos) - margin), bin_of(F.col(pos)), bin_of(F.col(pos) + margin)))
    return rows.withColumns({"_own": bin_of(F.col(pos)), "_stretch": F.explode(near)})


def ratio_of(count, coverage) -> Column:
    """Count over coverage; infinite where nothing covers."""
    return F.when(F.col(coverage) > 0, F.col(count) / F.col(coverage)).otherwise(F.lit(float("inf")))


def qualify(rows: DataFrame, minimum: int, ratio: float, count: str = "cnt", ratio_col: str | None = "ratio") -> DataFrame:
    """Adds ``is_qualified``: picked, counted often enough, and a large enough share of the coverage."""
    ok = F.col("is_picked") & (F.col(count) >= minimum)
    return rows.withColumn("is_qualified", ok & (F.col(ratio_col) >= ratio) if ratio_col else ok)


def significant(rows: DataFrame, level: float = 0.05) -> DataFrame:
    """Qualified rows below the level divided by their number, over all keys together.

    The number is one aggregate row, joined as such; nothing else is gathered.
    """
    q = rows.where("is_qualified")
    n = q.agg(F.count("*").alias("n_qualified"))
    return q.join(F.broadcast(n)).where(F.col("poisp") < F.lit(level) / F.col("n_qualified")).drop("n_qualified")


def inward_coverage(features: DataFrame, segments: DataFrame, pos: str = "pos", left_side: bool | Column = True, distance: int = 15, sample: int = 5, mode: str = "reference", keys: tuple[str, ...] = ("contig",), out: str = "coverage") -> DataFrame:
    """Adds ``out``: the mean depth of ``sample`` positions inside the transcript.

    Left ends look at ``pos + distance - sample`` onwards.  On right ends the 'reference' mode looks
    at no position, which gives 0, and 'inward' at the mirrored ones.  ``segments(keys, seg_start,
    seg_end, depth)`` holds stretches of equal depth; what they do not cover has depth 0.
    ``left_side`` holds for all features, or is a condition on each.
    """
    left = F.lit(left_side) if isinstance(left_side, bool) else left_side
    base = F.col(pos).cast("long")
    first = F.when(left, base + distance - sample).otherwise(base - distance + 1)
    asked = features.where(left) if mode == "reference" else features
    spots = asked.select(*keys, base.alias(pos), first.alias("_f")).distinct().withColumn("_p", F.explode(F.sequence("_f", F.col("_f") + sample - 1)))
    # The segment that begins last at or before a spot covers it or nothing does.  A segment is dealt
    # to every stretch that it reaches.
    bin_of = lambda c: F.floor(c / F.lit(STRETCH))
    w = Window.partitionBy(*keys, "_b").orderBy("_at", "_side")
    reach = segments.withColumn("_b", F.explode(F.sequence(bin_of(F.col("seg_start")), bin_of(F.col("seg_end")))))
    no = F.lit(None).cast("long")
    a = reach.select(*keys, "_b", F.col("seg_start").cast("long").alias("_at"), F.lit(0).alias("_side"), F.struct("seg_end", "depth").alias("_s"), no.alias("_pos"), no.alias("_f"))
    b = spots.select(*keys, bin_of(F.col("_p")).alias("_b"), F.col("_p").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_s"].dataType).alias("_s"), F.col(pos).alias("_pos"), "_f")
    seen = a.union(b).withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_side = 1")
    depth = F.when(F.col("_s.seg_end") >= F.col("_at"), F.col("_s.depth")).otherwise(0)
    mean = seen.groupBy(*keys, F.col("_pos").alias(pos), "_f").agg((F.sum(depth) / sample).alias(out))
    return features.withColumn("_f", first).join(mean, [*keys, pos, "_f"], "left").drop("_f").withColumn(out, F.when(F.lit(mode != "reference") | left, F.coalesce(out, F.lit(0.0))).otherwise(0.0))
