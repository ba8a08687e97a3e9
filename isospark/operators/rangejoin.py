"""Range joins as equi-joins on bins: the probe side is dealt to the bins that its window touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a contig that one window partition covers.
STRETCH = 1 << 20


def range_join(probe: DataFrame, build: DataFrame, keys: list[str], lo: Column, hi: Column, at: str, width: int, how: str = "inner") -> DataFrame:
    """Rows of ``probe`` with the rows of ``build`` whose ``at`` lies in ``[lo, hi]`` of the probe.

    ``keys`` are equal on both sides; ``width`` is about ``hi - lo + 1``, so a probe row has two
    bins, and a build row always one.  ``how`` is 'inner' or 'left'.  Columns of the sides other
    than the keys must differ.  A hot key is spread over its bins.
    """
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    p = probe.withColumns({"_lo": lo, "_hi": hi}).withColumn("_bin", F.explode(F.when(F.col("_lo") <= F.col("_hi"), F.sequence(bin_of(F.col("_lo")), bin_of(F.col("_hi")))).otherwise(F.array())))
    b = build.withColumn("_bin", bin_of(F.col(at)))
    found = p.join(b, [*keys, "_bin"]).where(F.col(at).between(F.col("_lo"), F.col("_hi")))
    if how == "inner":
        return found.drop("_bin", "_lo", "_hi")
    raise ValueError("a left range join needs a row key: use range_left")


def range_left(probe: DataFrame, build: DataFrame, keys: list[str], lo: Column, hi: Column, at: str, width: int, aggregates: list[Column]) -> DataFrame:
    """Each row of ``probe`` once, with aggregates over its partners (null or 0 without any).

    Only the distinct (keys, bounds) are joined; rows that share them share the result.
    """
    bounds = probe.withColumns({"_lo": lo, "_hi": hi})
    once = bounds.select(*keys, "_lo", "_hi").distinct()
    found = range_join(once.withColumns({"_l": F.col("_lo"), "_h": F.col("_hi")}), build, keys, F.col("_l"), F.col("_h"), at, width)
    agg = found.groupBy(*keys, F.col("_l").alias("_lo"), F.col("_h").alias("_hi")).agg(*aggregates)
    return bounds.join(agg, [*keys, "_lo", "_hi"], "left").drop("_lo", "_hi")


def first_in_window(probe: DataFrame, sites: DataFrame, keys: list[str], pos: str, site: str, wobble: int, out: str = "hit", step: int = 0, sign: Column | None = None) -> DataFrame:
    """The leftmost site within ``wobble`` of each probe position, -1 if none.

    One window over the union of both sides finds the first site at or after ``pos - wobble``.
    With ``step``, the window's centre moves by ``step * sign`` (not below 1).
    """
    centre = F.col(pos) if not step else F.greatest(F.lit(1), F.col(pos) + sign * step)
    bin_of = lambda c: F.floor(c / F.lit(STRETCH))
    p = probe.withColumn("_at", centre - wobble).withColumn("_b", bin_of(F.col("_at")))
    names = [c for c in p.columns if c not in keys and c not in ("_at", "_b")]
    left = p.select(*keys, "_b", "_at", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_site"), F.struct(*names).alias("_row"))
    # A site is also dealt to the stretch before it if a window that begins there reaches it.
    at = F.col(site).cast("long")
    right = sites.select(*keys, at.alias("_at")).distinct().withColumn("_b", F.explode(F.array_distinct(F.array(bin_of(F.col("_at") - 2 * wobble), bin_of(F.col("_at"))))))
    right = right.select(*keys, "_b", "_at", F.lit(2).alias("_side"), F.col("_at").alias("_site"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    # Walked from the right, the last site seen is the first at or after a bound; one at the bound counts.
    w = Window.partitionBy(*keys, "_b").orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = left.unionByName(right).withColumn("_first", F.last("_site", ignorenulls=True).over(w)).where("_side = 1")
    hit = F.when(F.col("_first") <= F.col("_at") + 2 * wobble, F.col("_first")).otherwise(F.lit(-1))
    return found.select(*keys, "_row.*", hit.cast("long").alias(out))


def shifted_first(probe: DataFrame, sites: DataFrame, keys: list[str], pos: str, site: str, wobble: int, shift: int, strand: str = "strand", out: str = "hit") -> DataFrame:
    """``first_in_window`` around the position moved upstream by ``shift``; where that finds none, around the position."""
    sign = F.when(F.col(strand) == "+", -1).otherwise(1)
    moved = first_in_window(probe, sites, keys, pos, site, wobble, "_moved", shift, sign)
    both = first_in_window(moved, sites, keys, pos, site, wobble, "_plain")
    return both.withColumn(out, F.when(F.col("_moved") > 0, F.col("_moved")).otherwise(F.col("_plain"))).drop("_moved", "_plain")


def range_count(queries: DataFrame, positions: DataFrame, keys: list[str], q: str, at: str, window: int, out: str = "n") -> DataFrame:
    """How many positions lie within ``window`` of each query; 0 for a null query."""
    w = 2 * window + 1
    n = range_left(queries, positions, keys, F.col(q) - window, F.col(q) + window, at, w, [F.count("*").alias(out)])
    return n.withColumn(out, F.coalesce(out, F.lit(0)))


def points_in(intervals: DataFrame, points: DataFrame, keys: list[str], lo: Column, hi: Column, at: str, out: str = "n") -> DataFrame:
    """Each interval with the number of points in ``[lo, hi]``, however long it is: a difference of two ranks.

    An interval is two marks among the points, whose running count is kept by stretches, each of which
    begins with the sum of those before it.  So neither intervals nor points are repeated, and no pair of
    them is made.  Keys that are null meet nothing; an interval that ends before it begins holds nothing.
    """
    bounds = intervals.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long")})
    once = bounds.where("_hi >= _lo").select(*keys, "_lo", "_hi").distinct()
    mark = F.explode(F.array(F.struct((F.col("_lo") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("_hi").alias("at"), F.lit(1).alias("sign"))))
    marks = once.select(*keys, "_lo", "_hi", mark.alias("_m")).select(*keys, "_lo", "_hi", F.col("_m.at").alias("_at"), F.col("_m.sign").alias("_sign"), F.lit(0).cast("long").alias("_c"))
    none = F.lit(None).cast("long")
    held = points.groupBy(*keys, F.col(at).cast("long").alias("_at")).agg(F.count("*").alias("_c")).where("_at is not null")
    rows = marks.unionByName(held.select(*keys, none.alias("_lo"), none.alias("_hi"), "_at", F.lit(0).alias("_sign"), "_c")).withColumn("_b", F.floor(F.col("_at") / F.lit(STRETCH)))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s")).select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    here = F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumn("_here", here).where("_sign <> 0").join(sums, [*keys, "_b"])
    found = ranked.groupBy(*keys, "_lo", "_hi").agg(F.sum(F.col("_sign") * (F.col("_here") + F.col("_before"))).alias(out))
    return bounds.join(found, [*keys, "_lo", "_hi"], "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("_lo", "_hi")


def active_intervals(reference: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str, window: int, active: bool = True) -> DataFrame:
    """Reference intervals that a point within ``window`` supports, or those that none does."""
    n = points_in(reference, points, keys, F.col(start) - window, F.col(end) + window, at, "_n")
    return n.where(F.col("_n") > 0 if active else F.col("_n") == 0).drop("_n")
