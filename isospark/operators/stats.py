"""Statistics of score tables: p-value corrections, paired tests, blocked analysis of variance."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def adjust(rows: DataFrame, keys: list[str], p: str = "p", how: str = "bh", out: str = "p_adj", tie: str | None = None) -> DataFrame:
    """Adjusted p-values within each key: 'bh', 'holm' or 'none'.  Null p-values stay null and do not count."""
    if how == "none":
        return rows.withColumn(out, F.col(p))
    known = rows.withColumn("_n", F.count(p).over(Window.partitionBy(*keys)))
    order = [F.col(p).asc_nulls_last(), *([F.col(tie)] if tie else [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = known.withColumn("_k", F.row_number().over(w))
    if how == "bh":
        back = Window.partitionBy(*keys).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
        value = F.min(F.when(F.col(p).isNotNull(), F.col(p) * F.col("_n") / F.col("_k"))).over(back)
    elif how == "holm":
        value = F.max((F.col("_n") - F.col("_k") + 1) * F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        raise ValueError(how)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))).drop("_n", "_k")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz's method; the fraction converges in some square roots of a and b steps.
    f, c, d, i = 1.0, 1.0, 0.0, 0
    while True:
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d if abs(1 + num * d) > 1e-300 else 1e-300)
        c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
        i += 1
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    """The quantile of a t distribution above its median, by bisection."""
    lo, hi = 0.0, 1.0
    while 1 - t_two_sided(hi, df) / 2 < p:
        lo, hi = hi, 2 * hi
    while (mid := (lo + hi) / 2) not in (lo, hi):
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def paired(rows: DataFrame, groups: list[str], block: list[str], name: str, value: str) -> DataFrame:
    """Per group and pair of names (a < b): blocks that have both, mean and sd of the differences,
    t, and Cohen's dz (null for one block or no spread)."""
    means = rows.groupBy(*groups, *block, name).agg(F.avg(value).alias("v"))
    a = means.select(*groups, *block, F.col(name).alias("a"), F.col("v").alias("va"))
    b = means.select(*groups, *block, F.col(name).alias("b"), F.col("v").alias("vb"))
    d = a.join(b, [*groups, *block]).where("a < b").withColumn("d", F.col("va") - F.col("vb"))
    s = d.groupBy(*groups, "a", "b").agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"))
    ok = (F.col("n") > 1) & (F.col("sd_diff") > 0)
    return s.withColumns({"dz": F.when(ok, F.col("mean_diff") / F.col("sd_diff")), "t": F.when(ok, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n")))})


def paired_tests(rows: DataFrame, groups: list[str], block: list[str], name: str, value: str, how: str = "bh") -> DataFrame:
    """``paired`` with p-values, adjusted within each group."""
    p = paired(rows, groups, block, name, value)
    p = p.withColumn("p_raw", F.pandas_udf(_p_series, "double")(F.col("t"), F.col("n")))
    return adjust(p, groups, "p_raw", how, "p_adj", tie=None)


def in_report_order(tests: DataFrame, groups: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Tests as tables list them: by group, adjusted and raw p-value, and names; missing values last."""
    return tests.orderBy(*groups, F.col("p_adj").asc_nulls_last(), F.col("p_raw").asc_nulls_last(), a, b)


def _p_series(ts, ns):
    return pd.Series([t_two_sided(t, n - 1) if t == t and n > 1 else None for t, n in zip(ts, ns)], dtype="float64")


def anova_blocked(rows: DataFrame, groups: list[str], factor: str, block: str, value: str) -> DataFrame:
    """Per group: two-way analysis of variance without interaction, type II sums of squares.

    ``(groups, term, df, ss, f, p, eta2)`` for factor and block; groups without residual freedom give
    null F.  A group is a table of factor x block means, bounded by those, not by the rows.
    """
    cells = rows.groupBy(*groups, F.col(factor).cast("string").alias("_f"), F.col(block).cast("string").alias("_b")).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in groups)

    def run(pdf):
        import numpy as np

        n, s, q = (pdf[c].to_numpy(float) for c in ("_n", "_s", "_q"))
        f, b = (pd.get_dummies(pdf[c], dtype=float).to_numpy() for c in ("_f", "_b"))

        def rss(x):
            w = np.sqrt(n)
            fit = x @ np.linalg.lstsq(x * w[:, None], s / w, rcond=None)[0]
            return float(q.sum() - 2 * (fit * s).sum() + (n * fit * fit).sum())

        one = np.ones((len(pdf), 1))
        both, only_f, only_b = rss(np.hstack([f, b])), rss(np.hstack([one, f])), rss(np.hstack([one, b]))
        df_f, df_b = f.shape[1] - 1, b.shape[1] - 1
        rest = n.sum() - 1 - df_f - df_b
        out = []
        for term, df, ss in ((factor, df_f, only_b - both), (block, df_b, only_f - both)):
            fv = ss / df / (both / rest) if df > 0 and rest > 0 and both > 0 else None
            out.append([*pdf.iloc[0][groups], term, df, ss, fv, f_upper(fv, df, rest) if fv is not None else None, ss / (ss + both) if ss + both > 0 else None])
        return pd.DataFrame(out, columns=[*groups, "term", "df", "ss", "f", "p", "eta2"])

    return cells.groupBy(*groups).applyInPandas(run, f"{kinds}, term string, df long, ss double, f double, p double, eta2 double")


def mean_interval(rows: DataFrame, groups: list[str], value: str, level: float = 0.975) -> DataFrame:
    """Mean and t interval per group; null bounds for a group of one value.

    The quantile of every group is exact for its size; it is worked out on the aggregated rows.
    """

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        of = {k: t_quantile(level, k - 1) for k in n.unique() if k > 1}
        return n.map(of).astype("float64")

    s = rows.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.when(F.col("n") > 1, quantile("n") * F.col("sd") / F.sqrt("n"))
    return s.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})
