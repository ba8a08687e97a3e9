"""Depth of coverage as segments, never as single bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a contig that one window partition covers.
STRETCH = 1 << 16


def segments(blocks: DataFrame, keys: list[str], start: str = "bstart", end: str = "bend") -> DataFrame:
    """``(keys, seg_start, seg_end, depth)``: maximal stretches of equal, positive depth.

    ``blocks`` are aligned stretches, ends included.  Starts and ends become events, summed per
    position before they are ordered; a running sum gives the depth.
    """
    events = blocks.select(*keys, F.explode(F.array(F.struct(F.col(start).cast("long").alias("at"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).cast("long").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    change = events.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    # Stretches are summed apart: each begins with what the ones before it have left open, and its last
    # segment ends where the next one's first change is.
    part = change.withColumn("_b", F.floor(F.col("at") / F.lit(STRETCH)))
    each = part.groupBy(*keys, "_b").agg(F.sum("d").alias("_sum"), F.min("at").alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_b")
    each = each.select(*keys, "_b", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_open"), F.lead("_first").over(over).alias("_next"))
    w = Window.partitionBy(*keys, "_b").orderBy("at")
    run = part.withColumns({"_lead": F.lead("at").over(w), "_run": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))}).join(each, [*keys, "_b"])
    out = run.select(*keys, F.col("at").alias("seg_start"), (F.coalesce("_lead", "_next") - 1).alias("seg_end"), (F.col("_run") + F.col("_open")).alias("depth"))
    return out.where("depth > 0")
