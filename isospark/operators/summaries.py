"""Summaries of classification, junction and score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isospark.operators import quantiles
from isospark.session import cut


def rate(flag: Column, weight: Column | None = None) -> Column:
    """The weighted share of true flags; null without weight."""
    w = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))
    return F.try_divide(F.sum(F.when(flag, w).otherwise(0.0)), F.sum(w))


def share(condition: Column) -> Column:
    """The share of rows for which a condition holds; rows where it is null do not count."""
    return F.avg(condition.cast("int"))


def with_total(rows: DataFrame, groups: list[str], over: str, aggregates: list[Column], total: str = "ALL") -> DataFrame:
    """Aggregates by (groups, over), and by groups alone with ``over`` = total, in one pass of grouping sets."""
    sets = [[*groups, over], groups]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*groups, over]]).agg(F.grouping(over).alias("_g"), *aggregates)
    return out.withColumn(over, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(over))).drop("_g")


def complete(rows: DataFrame, groups: list[str], values: dict[str, list], fill: dict) -> DataFrame:
    """All combinations of the groups there are with the listed values; missing ones filled."""
    grid = rows.select(*groups).distinct()
    for c, vs in values.items():
        grid = grid.withColumn(c, F.explode(F.array(*[F.lit(v) for v in vs])))
    return grid.join(rows, [*groups, *values], "left").na.fill(fill)


def isoforms_per_gene(rows: DataFrame, groups: list[str], gene: str, isoform: str) -> DataFrame:
    """Genes by number of isoforms (1, 2-3, 4-5, >=6) with zeros, and mean and median of that number."""
    n = cut(rows.groupBy(*groups, gene).agg(F.countDistinct(isoform).alias("k")))
    bin_of = F.when(F.col("k") == 1, "1").when(F.col("k") <= 3, "2-3").when(F.col("k") <= 5, "4-5").otherwise(">=6")
    counts = complete(n.groupBy(*groups, bin_of.alias("bin")).agg(F.count("*").alias("n_genes")), groups, {"bin": ["1", "2-3", "4-5", ">=6"]}, {"n_genes": 0})
    centre = n.groupBy(*groups).agg(F.round(F.avg("k"), 3).alias("mean_isoforms"), F.count("*").alias("total"))
    centre = quantiles.with_median(centre, n, groups, "k", "median_isoforms").withColumn("median_isoforms", F.round("median_isoforms", 3))
    return counts.join(centre, groups).withColumn("fraction", F.col("n_genes") / F.col("total"))


def fractions(rows: DataFrame, groups: list[str], over: str, n: Column) -> DataFrame:
    """Counts by (groups, over) and their share of the group."""
    c = rows.groupBy(*groups, over).agg(n.alias("n"))
    return c.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*groups)))


def collapse(rows: DataFrame, groups: list[str], over: str, cell: str, n: str = "n", weighted: bool = True) -> DataFrame:
    """Composition over cells: shares of the summed counts, or the mean of the cells' shares, renormalised."""
    if weighted:
        c = rows.groupBy(*groups, over).agg(F.sum(n).alias("w"))
    else:
        s = rows.withColumn("w", F.col(n) / F.sum(n).over(Window.partitionBy(*groups, cell)))
        c = s.groupBy(*groups, over).agg(F.avg("w").alias("w"))
    return c.withColumn("fraction", F.col("w") / F.sum("w").over(Window.partitionBy(*groups))).drop("w")


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def junction_support(junctions: DataFrame, by: list[str], key: str = "junction") -> DataFrame:
    """Per junction: distinct annotators, chemistries and cells, and the support class of the first that is plural."""
    counts = junctions.groupBy(*by, key).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in ("annotator", "chemistry", "cell_line") if c not in by])
    cls = None
    for c, name in (("annotator", "cross_tool"), ("chemistry", "cross_chemistry"), ("cell_line", "cross_cell")):
        if c not in by:
            cls = F.when(F.col(f"n_{c}") > 1, name) if cls is None else cls.when(F.col(f"n_{c}") > 1, name)
    return counts.withColumn("support", cls.otherwise(F.lit("single")))


def in_category_order(rows: DataFrame, groups: list[str], over: str = "category") -> DataFrame:
    """Rows by group and the preferred order of categories, others last."""
    from isospark.functions.scalar import category_code, category_rank

    return rows.orderBy(*groups, category_rank(category_code(over)), over)


def set_combinations(members: DataFrame, element: str, name: str, names: list[str], least: int = 1) -> DataFrame:
    """Exclusive intersections of sets: the names each element is in, counted and ranked; those of fewer
    than ``least`` elements are left out."""
    has = members.groupBy(element).agg(F.collect_set(name).alias("s"))
    combo = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(F.col("s"), n))
    c = has.select(F.array_join(combo, "&").alias("combo"), F.size(combo).alias("degree")).groupBy("combo", "degree").agg(F.count("*").alias("n")).where((F.col("degree") > 0) & (F.col("n") >= least))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("degree"), "combo")))


def merge_clusters(rows: DataFrame, cluster: list[str], start: str, end: str, ids: str, flags: list[str]) -> DataFrame:
    """Per cluster: outer bounds, member ids, and flags ("1" wins, else the greatest that is not "0")."""
    flag = [F.when(F.max((F.col(f) == "1").cast("int")) == 1, "1").otherwise(F.coalesce(F.max(F.when(F.col(f) != "0", F.col(f))), F.lit("0"))).alias(f) for f in flags]
    return rows.groupBy(*cluster).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.array_join(F.array_sort(F.collect_set(F.col(ids).cast("string"))), ";").alias("ids"), *flag)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve_column(df: DataFrame, aliases: list[str]) -> str:
    """The first alias that is a column, whatever its case."""
    by = {c.lower(): c for c in reversed(df.columns)}
    for a in aliases:
        if a.lower() in by:
            return by[a.lower()]
    raise ValueError(f"none of the columns {', '.join(aliases)}")
