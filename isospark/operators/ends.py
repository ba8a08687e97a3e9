"""Read ends: adapter alignment, placement, strand, and introns from the alignment string."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isospark.functions.scalar import complement
from isospark.model import Params

_ENDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ends", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))])


def local_alignments(seqs: list[str | None], adapter: str, match: float, mismatch: float, gap_open: float, gap_extend: float) -> tuple[np.ndarray, list[list[dict]]]:
    """Best local alignment scores of an adapter with each sequence, and where best ones lie.

    Smith-Waterman with affine gaps over all sequences of a batch at once: one step per adapter base
    and column.  Each place of the sequence where a best alignment ends is given once, with the least
    start among those; places count from 0, ends exclude theirs.
    """
    n, width = len(seqs), max((len(s) for s in seqs if s), default=0)
    text = np.zeros((n, width), np.uint8)
    for i, s in enumerate(seqs):
        if s:
            b = s.upper().encode("ascii", "replace")
            text[i, : len(b)] = np.frombuffer(b, np.uint8)
    low = -1e9
    h, start = np.zeros((width + 1, n)), np.repeat(np.arange(width + 1)[:, None], n, 1)
    down, down_start = np.full((width + 1, n), low), start.copy()
    best = np.zeros(n)
    where = np.full((width + 1, n), -1)  # the least start of a best alignment that ends here
    for base in adapter.upper().encode():
        new, new_start = np.zeros_like(h), np.repeat(np.arange(width + 1)[:, None], n, 1)
        right, right_start = np.full(n, low), np.zeros(n, int)
        opened, extended = h + gap_open, down + gap_extend
        take = (opened > extended) | ((opened == extended) & (start < down_start))
        down, down_start = np.where(take, opened, extended), np.where(take, start, down_start)
        for j in range(1, width + 1):
            opened, extended = new[j - 1] + gap_open, right + gap_extend
            take = (opened > extended) | ((opened == extended) & (new_start[j - 1] < right_start))
            right, right_start = np.where(take, opened, extended), np.where(take, new_start[j - 1], right_start)
            c = text[:, j - 1]
            cell = np.where(c == 0, low, h[j - 1] + np.where(c == base, match, mismatch))
            cell_start = start[j - 1]
            for other, other_start in ((down[j], down_start[j]), (right, right_start)):
                take = (other > cell) | ((other == cell) & (other_start < cell_start))
                cell, cell_start = np.where(take, other, cell), np.where(take, other_start, cell_start)
            alive = cell > 0
            new[j], new_start[j] = np.where(alive, cell, 0), np.where(alive, cell_start, j)
            better = alive & (new[j] > best)
            best[better] = new[j][better]
            where[:, better] = -1
            equal = alive & (new[j] == best)
            where[j] = np.where(equal & ((where[j] < 0) | (new_start[j] < where[j])), new_start[j], where[j])
        h, start = new, new_start
    return best, [[{"s": int(where[j, i]), "e": j} for j in range(1, width + 1) if where[j, i] >= 0] for i in range(n)]


def adapter_hits(windows: dict[str, tuple[Column, str]], p: Params) -> Column:
    """By name: (score, ends) of the best local alignments of a window with an adapter; score 0 and no ends without any.

    All windows of a read go to the tasks' workers at once, and equal ones are aligned once a batch.
    """
    names, adapters = list(windows), [adapter for _, adapter in windows.values()]
    kind = pa.struct([("score", pa.float64()), ("ends", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for seqs, adapter in zip(rows.flatten(), adapters):
            different = seqs.drop_null().unique()
            score, ends = local_alignments(different.to_pylist(), adapter, p.match_score, p.mismatch_score, p.gap_open_score, p.gap_extend_score)
            found = [{"score": float(s), "ends": e} for s, e in zip(score, ends)] + [{"score": 0.0, "ends": []}]
            at = pc.fill_null(pc.index_in(seqs, different), len(found) - 1)
            at = pc.if_else(seqs.is_null(), len(found) - 1, at)
            out.append(pa.array(found, kind).take(at))
        return pa.StructArray.from_arrays(out, names=names)

    made = T.StructType([T.StructField(n, _ENDS) for n in windows])
    return F.arrow_udf(run, made)(F.struct(*[c.alias(n) for n, (c, _) in windows.items()]))


def parse_cigar(cigar) -> Column:
    """An alignment string as an array of (op, len); ``=`` and ``X`` count as ``M``."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    op = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    n = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    return F.zip_with(op, n, lambda o, k: F.struct(F.translate(o, "=X", "MM").alias("op"), k.cast("int").alias("len")))


def aligned_length(ops: Column) -> Column:
    """Reference bases that an alignment spans."""
    return F.aggregate(ops, F.lit(0), lambda a, x: a + F.when(x["op"].isin("M", "D", "N"), x["len"]).otherwise(0))


def match_blocks(start: Column, ops: Column) -> Column:
    """Stretches of matched bases as (s, e)."""
    zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("b"))

    def step(a, x):
        take = F.when(x["op"] == "M", F.concat(a["b"], F.array(F.struct(a["at"].alias("s"), (a["at"] + x["len"] - 1).alias("e"))))).otherwise(a["b"])
        return F.struct((a["at"] + F.when(x["op"].isin("M", "D", "N"), x["len"]).otherwise(0)).alias("at"), take.alias("b"))

    return F.aggregate(ops, zero, step, lambda a: a["b"])


def _matched_before_intron(ops: Column) -> Column:
    """Matched bases before the first intron; null without one."""
    zero = F.struct(F.lit(0).alias("m"), F.lit(False).alias("n"))
    walked = F.aggregate(ops, zero, lambda a, x: F.struct((a["m"] + F.when(~a["n"] & (x["op"] == "M"), x["len"]).otherwise(0)).alias("m"), (a["n"] | (x["op"] == "N")).alias("n")))
    return F.when(walked["n"], walked["m"])


def end_windows(reads: DataFrame, p: Params) -> DataFrame:
    """Adds, per side, the clipped end with some matched bases (``left``, ``right``; null without a clip), the
    clipped bases in it, and the first matched bases; all read from the clip inwards.

    Windows that would begin before the read begin with it.
    """
    ops, seq = F.col("ops"), F.col("seq")
    first, last = ops[0], F.element_at(ops, -1)
    clip_l, clip_r = F.when(first["op"].isin("S", "H"), first["len"]), F.when(last["op"].isin("S", "H"), last["len"])
    from_l = F.greatest(clip_l - p.check_in_soft, F.lit(0))
    cis_l = F.least(clip_l, F.lit(p.check_in_soft))
    r0 = F.length(seq) - clip_r
    cis_r = F.when(clip_r - 1 > p.check_in_soft, p.check_in_soft).otherwise(clip_r)
    begin_r, begin_m = F.greatest(r0 - p.check_in_match, F.lit(0)), F.greatest(r0 - p.match_in_first, F.lit(0))
    return reads.withColumns({
        "left": F.substring(seq, from_l + 1, clip_l + p.check_in_match - from_l),
        "left_clip": cis_l,
        "left_match": F.substring(seq, clip_l + 1, F.lit(p.match_in_first)),
        "right": F.reverse(F.substring(seq, begin_r + 1, r0 + cis_r - begin_r)),
        "right_clip": cis_r,
        "right_match": F.reverse(F.substring(seq, begin_m + 1, r0 - begin_m)),
    })


def _placed(hit: Column, false_hit: Column, clip: Column, before_intron: Column, limit: float, p: Params) -> Column:
    """(score, s, e, status) of an end from its alignments."""
    inside = clip + p.check_in_match
    near = F.get(F.filter(hit["ends"], lambda x: x["e"].between(clip - p.check_from_alignment, inside)), F.lit(0))
    deep = F.get(F.filter(hit["ends"], lambda x: x["e"].between(clip + p.shs_for_ts, inside)), F.lit(0))
    first = F.get(hit["ends"], F.lit(0))
    short = (before_intron <= p.first_exon) & (false_hit["score"] >= 0.5 * p.match_in_first * p.match_score)

    def label(at: Column, status: str) -> Column:
        return F.struct(hit["score"].alias("score"), F.coalesce(at["s"], F.lit(0)).alias("s"), F.coalesce(at["e"], F.lit(0)).alias("e"), F.lit(status).alias("status"))

    return (
        F.when(clip.isNull(), F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("no softclip").alias("status")))
        .when(hit["score"] <= limit, label(first, "missing"))
        .when(near.isNull(), label(first, "out of place"))
        .when(F.coalesce(short, F.lit(False)), label(F.coalesce(deep, near), "false exon"))
        .when(deep.isNotNull(), label(deep, "potential template switching"))
        .otherwise(label(near, "correct"))
    )


def label_ends(reads: DataFrame, p: Params = Params()) -> DataFrame:
    """Adds ``l3``, ``l5``, ``r3``, ``r5``: (score, s, e, status) of each adapter at each end.

    On direct RNA the true 5' end is always correct and only the true 3' end is aligned.
    """
    r = end_windows(reads.withColumn("ops", parse_cigar("cigar")), p)
    before = {"l": _matched_before_intron(F.col("ops")), "r": _matched_before_intron(F.reverse("ops"))}
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("no softclip").alias("status"))
    sure = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("correct").alias("status"))
    reverse = F.col("flag").bitwiseAND(16) != 0
    windows, limits = {}, {}
    asked = lambda side, name: F.when(reverse == F.lit(side == "l"), F.col(name)) if p.drna else F.col(name)
    for side, name in (("l", "left"), ("r", "right")):
        for which, adapter, limit in (("3", p.three_adapter, p.three_score), ("5", p.five_adapter, p.five_score)):
            if p.drna and which == "5":
                continue
            # Read inwards, the 3' adapter shows complemented on the left and plain on the right.
            turn = complement if (side, which) in (("l", "3"), ("r", "5")) else (lambda c: c)
            window = asked(side, name)
            windows[side + which] = (turn(window), adapter)
            windows[side + which + "_false"] = (turn(F.when((before[side] <= p.first_exon) & window.isNotNull(), F.col(f"{name}_match"))), adapter)
            limits[side + which] = limit
    r = r.withColumn("_hits", adapter_hits(windows, p))
    for side, name in (("l", "left"), ("r", "right")):
        for key in (f"{side}3", f"{side}5"):
            if key not in limits:
                r = r.withColumn(key, F.when(reverse == F.lit(side == "r"), sure).otherwise(none))
                continue
            clip = F.when(asked(side, name).isNotNull(), F.col(f"{name}_clip"))
            r = r.withColumn(key, _placed(F.col("_hits")[key], F.col("_hits")[f"{key}_false"], clip, before[side], limits[key], p))
    return r.drop("left", "left_clip", "left_match", "right", "right_clip", "right_match", "_hits")


def assign_strand(reads: DataFrame, drna: bool = False) -> DataFrame:
    """New ``flag`` and ``mapq`` from the end labels: 16 or 0 where only one strand has evidence, else the
    old flag and 512; quality 0 for such reads, 9 for others.

    On direct RNA the mapper's flag is the strand: it stays whole, and every quality is 9.
    """
    if drna:
        return reads.withColumn("mapq", F.lit(9))
    seen = {k: ~F.col(f"{k}.status").isin("missing", "no softclip") for k in ("l3", "r3", "l5", "r5")}
    minus, plus = seen["l3"] | seen["r5"], seen["r3"] | seen["l5"]
    flag = F.when(minus & ~plus, 16).when(plus & ~minus, 0).otherwise(F.col("flag") + 512).cast("int")
    return reads.withColumn("flag", flag).withColumn("mapq", F.when(F.col("flag") <= 511, 9).otherwise(0))


def mapped(reads: DataFrame) -> DataFrame:
    return reads.where(F.col("flag").bitwiseAND(4) == 0)


def stranded(reads: DataFrame) -> DataFrame:
    return reads.where(F.col("flag").bitwiseAND(512) == 0)


def counted_in_depth(reads: DataFrame) -> DataFrame:
    """Reads that count towards depth: not unmapped, secondary, without a strand (512) or a duplicate."""
    return reads.where(F.col("flag").bitwiseAND(4 | 256 | 512 | 1024) == 0)


def find_introns(reads: DataFrame, p: Params = Params()) -> DataFrame:
    """Adds ``introns`` (s: last base before, e: first base after), ``gap`` (some were rejected) and ``lost``
    (those that were rejected last).

    An intron that follows a long insertion, or lies in a short first exon of a bad left end, rejects
    itself and all before; a short last exon of a bad right end rejects the last one.
    """
    reverse = F.col("flag").bitwiseAND(16) != 0
    bad = lambda k: F.col(f"{k}.status") != "correct"
    left = F.when(reverse, bad("l3")).otherwise(bad("l5")) if p.drna else bad("l3") | bad("l5")
    right = F.when(reverse, bad("r5")).otherwise(bad("r3")) if p.drna else bad("r3") | bad("r5")
    none = F.array().cast("array<struct<s:int,e:int>>")
    zero = F.struct(F.col("start").cast("int").alias("at"), F.lit(0).alias("seen"), F.lit(0).alias("since"), F.lit(0).alias("inserted"), F.lit(False).alias("gap"), none.alias("found"), none.alias("lost"))

    def step(a, x):
        is_n, is_m = x["op"] == "N", x["op"] == "M"
        here = F.struct((a["at"] - 1).alias("s"), (a["at"] + x["len"]).alias("e"))
        reject = is_n & ((a["inserted"] > p.insert_before_intron) | (F.col("_left") & (a["seen"] < p.first_exon)))
        found = F.when(reject, F.slice(a["found"], 1, 0)).when(is_n, F.concat(a["found"], F.array(here))).otherwise(a["found"])
        return F.struct(
            (a["at"] + F.when(x["op"].isin("M", "D", "N"), x["len"]).otherwise(0)).alias("at"),
            (a["seen"] + F.when(is_m, x["len"]).otherwise(0)).alias("seen"),
            F.when(is_n, 0).otherwise(a["since"] + F.when(is_m, x["len"]).otherwise(0)).alias("since"),
            F.when(x["op"] == "I", x["len"]).otherwise(0).alias("inserted"),
            (a["gap"] | reject).alias("gap"),
            found.alias("found"),
            F.when(reject, F.concat(a["found"], F.array(here))).otherwise(a["lost"]).alias("lost"),
        )

    r = reads.withColumns({"_left": left, "_right": right})
    r = r.withColumn("_w", F.aggregate("ops", zero, step))
    short = (F.col("_w.since") < p.first_exon) & F.col("_right") & (F.size("_w.found") > 0)
    introns = F.when(short, F.slice("_w.found", 1, F.greatest(F.size("_w.found") - 1, F.lit(0)))).otherwise(F.col("_w.found"))
    lost = F.when(short, F.slice("_w.found", -1, 1)).otherwise(F.col("_w.lost"))
    return r.withColumns({"introns": introns, "gap": F.col("_w.gap") | short, "lost": lost}).drop("_left", "_right", "_w")


def end_counts(reads: DataFrame) -> DataFrame:
    """``(kind, status, contig, pos, cnt)`` of ends that are correct or potential template switching."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}.status").alias("status"), F.col("start" if k[0] == "l" else "end").alias("pos")) for k in ("l3", "r3", "l5", "r5")]))
    e = reads.select("contig", kinds.alias("e")).where(F.col("e.status").isin("correct", "potential template switching"))
    return e.groupBy("e.kind", "e.status", "contig", "e.pos").agg(F.count("*").alias("cnt"))


def intron_counts(reads: DataFrame) -> DataFrame:
    i = reads.select("contig", F.explode("introns").alias("i"))
    return i.groupBy("contig", F.col("i.s").alias("left"), F.col("i.e").alias("right")).agg(F.count("*").alias("cnt"))
