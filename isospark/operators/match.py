"""Matching transcripts and features between tables, within windows."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isospark.functions.scalar import chains_within, end_site, inner_boundaries, positions_within, start_site
from isospark.session import cut

from .rangejoin import range_join


def with_sites(tx: DataFrame, unstranded: str = "plain") -> DataFrame:
    """Adds ``tss`` and ``tes`` to ``tx(contig, strand, start, end, ...)``."""
    return tx.withColumns({"tss": start_site("start", "end", "strand", unstranded), "tes": end_site("start", "end", "strand", unstranded)})


def transcript_pairs(a: DataFrame, b: DataFrame, id_a: str, id_b: str, tss: int, tes: int, chain: int, by: str = "introns") -> DataFrame:
    """Pairs of transcripts on the same contig and strand with as many exons, both ends and the inner
    structure within their windows.

    Sides are ``(id, contig, strand, tss, tes, exons, introns)``.  ``by`` is 'introns' (both ends of
    each intron) or 'boundaries' (inner exon ends in the given order).  Contig, strand, number and a
    bin of the start are the join key.
    """
    def side(df: DataFrame, key: str, p: str) -> DataFrame:
        inner = F.col("introns") if by == "introns" else inner_boundaries("exons")
        return df.select("contig", "strand", F.size(inner).alias("n_inner"), F.col(key), F.col("tss").alias(f"{p}_tss"), F.col("tes").alias(f"{p}_tes"), inner.alias(f"{p}_inner"))

    near = chains_within if by == "introns" else positions_within
    found = range_join(side(a, id_a, "a"), side(b, id_b, "b"), ["contig", "strand", "n_inner"], F.col("a_tss") - tss, F.col("a_tss") + tss, "b_tss", 2 * tss + 1)
    return found.where((F.abs(F.col("a_tes") - F.col("b_tes")) <= tes) & near("a_inner", "b_inner", chain))


def transfer_values(base: DataFrame, pairs: DataFrame, values: DataFrame, id_a: str, id_b: str, value: str, out: str) -> DataFrame:
    """Adds to each base row the sum of a value over all its partners; 0 without any."""
    total = pairs.select(id_a, id_b).join(values.select(id_b, value), id_b).groupBy(id_a).agg(F.sum(value).alias(out))
    return base.join(total, id_a, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def collect_labels(base: DataFrame, pairs: DataFrame, labels: DataFrame, id_a: str, id_b: str, label: str, order: str, out: str) -> DataFrame:
    """Adds the labels of all partners, comma-joined in the given order; "0" without any."""
    rows = pairs.select(id_a, id_b).join(labels.select(id_b, label, order), id_b)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, label))), lambda x: x[label]), ",")
    return base.join(rows.groupBy(id_a).agg(texts.alias(out)), id_a, "left").withColumn(out, F.coalesce(out, F.lit("0")))


def evaluate(reference: DataFrame, predicted: DataFrame, pairs: DataFrame, ref_id: str, pred_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts, false positives and references not found.

    True positives are references with a partner, false positives predictions without one.  The pairs'
    ids are kept, as all three read them.
    """
    pairs = cut(pairs.select(ref_id, pred_id))
    hit_ref, hit_pred = pairs.select(ref_id).distinct(), pairs.select(pred_id).distinct()
    missing = reference.join(hit_ref, ref_id, "left_anti")
    wrong = predicted.join(hit_pred, pred_id, "left_anti")
    counts = hit_ref.agg(F.count("*").alias("tp")).join(F.broadcast(wrong.agg(F.countDistinct(pred_id).alias("fp")))).join(F.broadcast(missing.agg(F.count("*").alias("fn"))))
    return with_rates(counts), wrong, missing


def with_rates(rows: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Adds precision, recall and F1; 0 where nothing is divided by."""
    p, r = F.coalesce(F.try_divide(F.col(tp), F.col(tp) + F.col(fp)), F.lit(0.0)), F.coalesce(F.try_divide(F.col(tp), F.col(tp) + F.col(fn)), F.lit(0.0))
    rows = rows.withColumns({"precision": p, "recall": r})
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def feature_sums(features: DataFrame, samples: DataFrame, keys: list[str], at: str, sample_at: str, window: int, value: Column, out: str) -> DataFrame:
    """Adds the sum of a value over all sample features within ``window``; 0 without any."""
    from .rangejoin import range_left

    s = samples.select(*keys, sample_at, value.alias("_v"))
    return range_left(features, s, keys, F.col(at) - window, F.col(at) + window, sample_at, 2 * window + 1, [F.sum("_v").alias(out)]).withColumn(out, F.coalesce(out, F.lit(0.0)))


def all_introns_accepted(reads: DataFrame, introns: DataFrame, read: str = "tid") -> DataFrame:
    """Per read, whether each of its introns is accepted on its strand or without one.

    ``reads(read, contig, strand, introns array<struct<s,e>>)``, ``introns(contig, strand, s, e)``; a
    read without introns is accepted.
    """
    each = reads.select(read, "contig", "strand", F.explode_outer("introns").alias("i")).select(read, "contig", "strand", "i.s", "i.e")
    known = introns.where("strand <> '.'").select("contig", "strand", "s", "e").distinct().withColumn("_a", F.lit(True))
    loose = introns.where("strand = '.'").select("contig", "s", "e").distinct().withColumn("_b", F.lit(True))
    seen = each.join(known, ["contig", "strand", "s", "e"], "left").join(loose, ["contig", "s", "e"], "left")
    return seen.groupBy(read).agg(F.bool_and(F.col("s").isNull() | F.col("_a").isNotNull() | F.col("_b").isNotNull()).alias("accepted"))


#: Positions of a key that one sweep covers.
STRETCH = 1 << 16

_OPEN = "array<struct<hi:long,n:long>>"
_SWEPT = f"struct<hits:long,open:{_OPEN}>"


def _sweep(rows: list[dict], entering: list[dict], end: int) -> dict:
    """Points of one stretch matched, each to the open interval that ends first, and what is still open at ``end``.

    ``rows`` are intervals and points with their numbers, in order, an interval before a point of its start.
    """
    held = {x["hi"]: x["n"] for x in entering}
    heap, hits = sorted(held), 0
    for r in rows:
        lo, hi, n = r["lo"], r["hi"], r["n"]
        if not r["point"]:
            if hi not in held:
                heapq.heappush(heap, hi)
            held[hi] = held.get(hi, 0) + n
            continue
        while heap and heap[0] < lo:
            del held[heapq.heappop(heap)]
        while n and heap:
            taken = min(n, held[heap[0]])
            hits, n, held[heap[0]] = hits + taken, n - taken, held[heap[0]] - taken
            if not held[heap[0]]:
                del held[heapq.heappop(heap)]
    return {"hits": hits, "open": [{"hi": hi, "n": held[hi]} for hi in sorted(held) if hi >= end]}


def interval_matches(points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "pos", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Per key: the size of a largest one-to-one matching of points to intervals that hold them.

    A sweep over the points gives each the open interval that ends first.  Stretches are swept side by
    side, first as if nothing came open into them; one that what its predecessor leaves open reaches
    otherwise is swept again, until all begin as the one before ends.  So a run without a gap is many
    tasks; a task holds the different places of one stretch and the ends that are open.  Rounds follow
    the stretches that a change is felt in, which intervals longer than a stretch prolong.  Rows without
    a position match nothing, but count.
    """
    import pyarrow as pa

    width = STRETCH
    key = F.struct(*[F.col(k) for k in keys]).alias("_k")
    a = points.select(key, F.col(at).cast("long").alias("lo"), F.col(at).cast("long").alias("hi"), F.lit(1).alias("point"))
    b = intervals.select(key, F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"), F.lit(0).alias("point"))
    counted = cut(a.union(b).groupBy("_k", "lo", "hi", "point").agg(F.count("*").alias("n")))
    placed = counted.where("lo is not null and hi is not null").withColumn("_seg", F.floor(F.col("lo") / F.lit(width)))
    following = placed.select("_k", "_seg").distinct().withColumn("_next", F.lead("_seg").over(Window.partitionBy("_k").orderBy("_seg")))
    rows = placed.groupBy("_k", "_seg").agg(F.array_sort(F.collect_list(F.struct("lo", "point", "hi", "n"))).alias("_rows"))
    stretches = cut(rows.join(following, ["_k", "_seg"]))

    left_open = pa.list_(pa.struct([("hi", pa.int64()), ("n", pa.int64())]))
    kind = pa.struct([("hits", pa.int64()), ("open", left_open)])
    run = F.arrow_udf(lambda r, e, end: pa.array([_sweep(*x) for x in zip(r.to_pylist(), e.to_pylist(), end.to_pylist(), strict=True)], kind), _SWEPT)
    swept = lambda df: df.select("_k", "_seg", "_next", "_enter", run("_rows", "_enter", (F.col("_seg") + 1) * width).alias("_x")).select("_k", "_seg", "_next", "_enter", "_x.*")
    nothing = F.array().cast(_OPEN)
    now = cut(swept(stretches.withColumn("_enter", nothing)))
    while True:
        come = now.where("_next is not null").select("_k", F.col("_next").alias("_seg"), F.col("open").alias("_come"))
        both = cut(now.join(come, ["_k", "_seg"], "left").withColumn("_come", F.coalesce("_come", nothing)))
        other = both.where(F.col("_come") != F.col("_enter"))
        if other.isEmpty():
            break
        again = stretches.join(other.select("_k", "_seg", F.col("_come").alias("_enter")), ["_k", "_seg"])
        now = cut(both.where(F.col("_come") == F.col("_enter")).drop("_come").unionByName(swept(again)))
    hits = now.groupBy("_k").agg(F.sum("hits").alias("tp"))
    totals = counted.groupBy("_k").agg(F.sum(F.col("n") * F.col("point")).alias("_points"), F.sum("n").alias("_all"))
    per = totals.join(hits, "_k", "left").select("_k.*", F.coalesce("tp", F.lit(0)).alias("tp"), "_points", "_all")
    return with_rates(per.select(*keys, "tp", (F.col("_points") - F.col("tp")).alias("fp"), (F.col("_all") - F.col("_points") - F.col("tp")).alias("fn")))
