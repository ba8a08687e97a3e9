"""Exact quantiles of groups by rank selection: no task holds the values of a group.

Different values are counted first.  A histogram of each group says in which bin a rank lies; the bin's own
least and largest value are the range of the next histogram, until they are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isospark.session import cut

#: Bins of a histogram.
BINS = 1024
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def counted(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``(_k, v, c)``: by group, a struct of its columns, the different values and how often each occurs; nulls are left out."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull()).groupBy(F.struct(*[F.col(g) for g in groups]).alias("_k"), v.alias("v")).agg(F.count("*").alias("c"))


def order_statistics(values: DataFrame, targets: DataFrame, bins: int = BINS) -> DataFrame:
    """``(_k, r, v)``: of each group of ``values(_k, v, c)`` the value of every rank in ``targets(_k, r)``, counted from 0.

    A round is one pass over the values inside the ranges that are left.  A range is split wherever its least
    and largest value differ, so rounds end; whole numbers up to a million take two.
    """
    ends = values.groupBy("_k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    left = cut(targets.join(ends, "_k").select("_k", "r", "lo", "hi", F.lit(0).cast("long").alias("below")))
    while not left.where("lo < hi").isEmpty():
        ranges = left.where("lo < hi").select("_k", "lo", "hi", "below").distinct()
        width = (F.col("hi") / bins) - (F.col("lo") / bins)
        at = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))
        inside = values.join(ranges, "_k").where("v between lo and hi").withColumn("bin", F.when(F.col("v") == F.col("hi"), F.lit(bins - 1)).when(F.col("v") == F.col("lo"), F.lit(0)).otherwise(F.coalesce(at, F.lit(0))))
        held = inside.groupBy("_k", "lo", "hi", "below", "bin").agg(F.sum("c").alias("n"), F.min("v").alias("l"), F.max("v").alias("u"))
        upto = F.sum("n").over(Window.partitionBy("_k", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        held = held.withColumn("end", F.col("below") + upto).withColumn("begin", F.col("end") - F.col("n")).drop("below", "n")
        hit = left.where("lo < hi").drop("below").join(held, ["_k", "lo", "hi"]).where("begin <= r and r < end")
        left = cut(left.where("lo = hi").unionByName(hit.select("_k", "r", F.col("l").alias("lo"), F.col("u").alias("hi"), F.col("begin").alias("below"))))
    return left.select("_k", "r", F.col("lo").alias("v"))


def of_groups(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``(_k, n, least, largest, mean, ...)``: linear quantiles by name, of the groups of ``counted`` values."""
    values = cut(values)
    base = values.groupBy("_k").agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("largest"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares.values()])))
    at = order_statistics(values, base.select("_k", F.explode(ranks).alias("r")))
    held = base.join(at.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("_at")), "_k")

    def between(p: float) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return F.when(low == high, a).otherwise(a * (high - place(p)) + b * (place(p) - low))

    return held.select("_k", "n", "least", "largest", "mean", *[between(p).alias(n) for n, p in shares.items()])


def box(rows: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """Per group: exact linear quartiles, ends, mean and count of a column; a group without a value has 0 of them."""
    q = of_groups(counted(rows, groups, value), QUARTILES)
    return _named(rows, groups, q, name)


def _named(rows: DataFrame, groups: list[str], q: DataFrame, name: str) -> DataFrame:
    all_groups = rows.select(F.struct(*[F.col(g) for g in groups]).alias("_k")).distinct()
    out = all_groups.join(q, "_k", "left").na.fill(0, ["n"])
    return out.select(*[F.col("_k")[g].alias(g) for g in groups], "n", F.col("least").alias(f"{name}_min"), *[F.col(c).alias(f"{name}_{c}") for c in QUARTILES], F.col("largest").alias(f"{name}_max"), F.col("mean").alias(f"{name}_mean"))


def box_with_total(rows: DataFrame, groups: list[str], over: str, value: str, name: str, total: str = "ALL") -> DataFrame:
    """``box`` by (groups, over), and by groups alone with ``over`` = total, from one count of the values."""
    keys = [*groups, over]
    v = cut(counted(rows, keys, value))
    whole = F.struct(*[F.col("_k")[g].alias(g) for g in groups], F.lit(total).alias(over))
    both = v.unionByName(v.select(whole.alias("_k"), "v", "c").groupBy("_k", "v").agg(F.sum("c").alias("c")))
    named = rows.select(*groups, F.explode(F.array(F.col(over), F.lit(total))).alias(over))
    return _named(named, keys, of_groups(both, QUARTILES), name)


def with_median(summary: DataFrame, rows: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """``summary``, a row per group, with the exact median of a column of ``rows``; null for a group without a value."""
    q = of_groups(counted(rows, groups, value), {"median": 0.5}).select("_k", F.col("median").alias(out))
    return summary.withColumn("_k", F.struct(*[F.col(g) for g in groups])).join(q, "_k", "left").drop("_k")
