"""Clusters along positions, ordered greedy clusters, and components."""

from __future__ import annotations

import collections

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from isospark.session import cut

#: Positions of a key that one window partition covers.
STRETCH = 1 << 20


def running_count(rows: DataFrame, keys: list[str], pos: str, flag: str, out: str) -> DataFrame:
    """Adds ``out``: how many rows up to and with this position have ``flag`` = 1, rows of one position alike.

    Positions are counted per stretch; each stretch begins with the sum of those before it.
    """
    part = rows.withColumn("_b", F.floor(F.col(pos) / F.lit(STRETCH)))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(*keys, "_b").agg(F.sum(flag).alias("_s")).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_b").alias("_b2"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_open"))
    here = F.sum(flag).over(Window.partitionBy(*keys, "_b").orderBy(pos).rangeBetween(Window.unboundedPreceding, 0))
    same = F.col("_b").eqNullSafe(F.col("_b2"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    joined = part.withColumn("_here", here).join(sums, same)
    return joined.withColumn(out, F.col("_here") + F.col("_open")).drop("_b", "_b2", "_here", "_open", *[f"_key{i}" for i in range(len(keys))])


def gap_clusters(rows: DataFrame, keys: list[str], pos: str = "start", wobble: int = 10, out: str = "cluster") -> DataFrame:
    """Numbers runs of positions whose neighbours are no further apart than ``wobble``, per key from 1.

    A position opens a run if none before it is near enough; that is seen within its stretch and a
    margin of the one before.
    """
    width = max(STRETCH, wobble)
    once = rows.select(*keys, pos).distinct()
    bin_of = lambda c: F.floor(c / F.lit(width))
    near = once.withColumns({"_own": bin_of(F.col(pos)), "_stretch": F.explode(F.array_distinct(F.array(bin_of(F.col(pos)), bin_of(F.col(pos) + wobble))))})
    gap = F.col(pos) - F.lag(pos).over(Window.partitionBy(*keys, "_stretch").orderBy(pos))
    new = near.withColumn("_new", F.when(gap.isNull() | (gap > wobble), 1).otherwise(0)).where("_stretch <=> _own").drop("_own", "_stretch")
    numbered_runs = running_count(new, keys, pos, "_new", out).drop("_new")
    same = F.lit(True)
    for c in [*keys, pos]:
        numbered_runs = numbered_runs.withColumnRenamed(c, f"_run_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"_run_{c}"))
    return rows.join(numbered_runs, same).drop(*[f"_run_{c}" for c in [*keys, pos]])


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], schema, fold) -> DataFrame:
    """Rows folded in order within each key, as a stream: a task sorts its keys and never holds one whole.

    ``fold()`` is called for each key and gives a function from a row (a named tuple) to the values
    that are put after it, those of ``schema`` beyond the columns of ``rows``.
    """
    columns = rows.columns
    at = [columns.index(k) for k in keys]

    def run(batches):
        import pandas as pd

        last, step = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(row[i] for i in at)
                if step is None or key != last:
                    last, step = key, fold()
                out.append(step(row))
            added = [f.name for f in schema.fields[len(columns) :]]
            yield pd.concat([pdf, pd.DataFrame(out, columns=added, index=pdf.index)], axis=1)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def representatives(rows: DataFrame, keys: list[str], outer_left: Column, pos: str = "start", score: str = "score", tie: str = "method", cluster: str = "cluster") -> DataFrame:
    """The row of the highest score of each cluster; of ties the leftmost where ``outer_left``, else the rightmost."""
    w = Window.partitionBy(*keys, cluster).orderBy(F.col(score).desc(), F.when(outer_left, F.col(pos)).otherwise(-F.col(pos)), F.col(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def method_matrix(rows: DataFrame, keys: list[str], methods: list[str], method: str = "method", value: str = "score", how: str = "sum", missing: float | None = 0.0, order: list[str] | None = None) -> DataFrame:
    """One column per method: ``sum``, ``max`` or ``first`` of the values (first by ``order``)."""
    agg = {"sum": F.sum(value), "max": F.max(value), "first": F.min_by(value, F.struct(*(order or [value])))}[how]
    wide = rows.groupBy(*keys).pivot(method, methods).agg(agg)
    return wide if missing is None else wide.na.fill(missing, methods)


def numbered(rows: DataFrame, prefix: str, order: list, digits: int = 6, out: str = "id", fixed: bool = False) -> DataFrame:
    """Ids such as TR_000001 in the given order; longer numbers have as many digits as they need.

    ``fixed`` cuts longer numbers to their first ``digits``, as SQL's ``lpad`` does, so ids repeat there.

    Rows are counted per range partition and offset, so no single task orders them all.  The ranges
    are cut once, so that rows and offsets see the same ones.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    number = (F.col("_k") + F.col("_b")).cast("string")
    padded = F.lpad(number, digits, "0")
    text = padded if fixed else F.when(F.length(number) >= digits, number).otherwise(padded)
    return local.join(F.broadcast(before), "_p").withColumn(out, F.concat(F.lit(prefix), text)).drop("_p", "_k", "_b")


def _with(df: DataFrame, name: str) -> T.StructType:
    """The schema of ``df`` and a long column."""
    return T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])


#: Positions of a segment of leader clustering.
SEGMENT = 1 << 16
_HEADS = "array<struct<s:long,e:long,to_s:long,to_e:long>>"


def _led_from(own: list[dict], head: dict | None, window: int, at: int) -> int:
    """The first row from ``at`` on that ``head`` does not lead; without a head that is the next one."""
    while head is not None and at < len(own) and abs(own[at]["s"] - head["s"]) <= window and abs(own[at]["e"] - head["e"]) <= window:
        at += 1
    return at


def _exits(rows: list[dict], window: int) -> list[dict]:
    """By the leader that a segment is entered with, the one that it is left with; rows of the margin before it, and none, can be that."""
    own = [r for r in rows if r["own"]]
    last = [0] * len(own)
    for i in range(len(own) - 1, -1, -1):
        j = _led_from(own, own[i], window, i + 1)
        last[i] = i if j == len(own) else last[j]
    out = []
    for head in (None, *(r for r in rows if not r["own"])):
        j = _led_from(own, head, window, 0)
        to = head if j == len(own) else own[last[j]]
        out.append({"s": head and head["s"], "e": head and head["e"], "to_s": to["s"], "to_e": to["e"]})
    return out


def _entries(maps: list[dict], window: int, width: int) -> list[dict]:
    """The leader that each segment is entered with, from the first segment on."""
    out, state = [], (None, None)
    for m in maps:
        if state[0] is not None and state[0] < m["seg"] * width - window:
            state = (None, None)
        out.append({"seg": m["seg"], "s": state[0], "e": state[1]})
        state = next((x["to_s"], x["to_e"]) for x in m["map"] if (x["s"], x["e"]) == state)
    return out


def _labels(rows: list[dict], head: dict | None, window: int) -> list[dict]:
    out = []
    for r in rows:
        if r["own"]:
            if head is None or _led_from([r], head, window, 0) == 0:
                head = r
            out.append({"s": r["s"], "e": r["e"], "leader": f"{head['s']}.{head['e']}"})
    return out


def _each(f, to, *columns):
    """``f`` of the values of each row as an array of type ``to``; one row at a time is held as Python objects, never a batch."""
    import pyarrow as pa

    done = [pa.array([f(*[x.as_py() for x in row])], to) for row in zip(*columns, strict=True)]
    return pa.concat_arrays(done) if done else pa.array([], to)


def leader_clusters(rows: DataFrame, keys: list[str], start: str, end: str, window: int, out: str = "leader", segment: int = SEGMENT) -> DataFrame:
    """Leader clustering along (start, end): a row joins the current cluster if both ends lie within
    ``window`` of the cluster's first member, else it leads a new one.  ``out`` names the leader.

    Whether a row leads depends on all before it, but only through the leader that a segment of positions is
    entered with, and that lies in the window before it.  Each segment gives the leader it is left with for
    every one it may be entered with; the maps of a key's segments are followed in order, and then each
    segment is labelled by itself.  So a run without any gap is many tasks; what meets in one is the rows
    in the windows between a key's segments.  Rows without a start or end are left out.
    """
    import pyarrow as pa

    width = max(segment, 2 * window)
    bin_of = lambda c: F.floor(c / F.lit(width))
    marked = rows.withColumns({"_k": F.struct(*keys), "_s": F.col(start).cast("long"), "_e": F.col(end).cast("long")}).where("_s is not null and _e is not null")
    dealt = marked.select("_k", "_s", "_e").distinct().withColumn("_seg", F.explode(F.array_distinct(F.array(bin_of(F.col("_s")), bin_of(F.col("_s") + window)))))
    own = bin_of(F.col("_s")) == F.col("_seg")
    segments = dealt.groupBy("_k", "_seg").agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"), own.alias("own")))).alias("_rows"), F.max(own).alias("_any"))
    segments = cut(segments.where("_any").drop("_any"))

    longs = lambda *names: pa.struct([(c, pa.int64()) for c in names])
    exits = F.arrow_udf(lambda a: _each(lambda r: _exits(r, window), pa.list_(longs("s", "e", "to_s", "to_e")), a), _HEADS)
    entries = F.arrow_udf(lambda a: _each(lambda m: _entries(m, window, width), pa.list_(longs("seg", "s", "e")), a), "array<struct<seg:long,s:long,e:long>>")
    led = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("leader", pa.string())]))
    labels = F.arrow_udf(lambda a, h: _each(lambda r, x: _labels(r, None if x["s"] is None else x, window), led, a, h), "array<struct<s:long,e:long,leader:string>>")
    maps = segments.select("_k", F.struct(F.col("_seg").alias("seg"), exits("_rows").alias("map")).alias("m"))
    states = maps.groupBy("_k").agg(F.array_sort(F.collect_list("m")).alias("m")).select("_k", F.explode(entries("m")).alias("h")).withColumn("_seg", F.col("h.seg"))
    named = segments.join(states, ["_k", "_seg"]).select("_k", F.explode(labels("_rows", F.struct("h.s", "h.e"))).alias("x"))
    named = named.select("_k", F.col("x.s").alias("_s"), F.col("x.e").alias("_e"), F.col("x.leader").alias(out))
    return marked.join(named, ["_k", "_s", "_e"]).drop("_k", "_s", "_e")


def seed_clusters(rows: DataFrame, keys: list[str], matches, order: list[str], pos: str, window: int, out: str = "seed") -> DataFrame:
    """Seed clustering: in order, each unused row takes every unused row that matches it.

    ``matches(a, b)`` compares two rows (named tuples) and must need ``pos`` within ``window``.
    ``order`` begins with ``pos``, so a row belongs to the first seed before it that matches, and only
    seeds within ``window`` are held.  Runs of ``pos`` with larger gaps are folded apart.
    """
    if order[0] != pos:
        raise ValueError("seeds are taken in order of their position")
    parts = gap_clusters(rows, keys, pos, window, "_part")
    p_at = parts.columns.index(pos)

    def fold():
        seeds: collections.deque = collections.deque()
        n = 0

        def step(row):
            nonlocal n
            while seeds and row[p_at] - seeds[0][1][p_at] > window:
                seeds.popleft()
            for k, seed in seeds:
                if matches(seed, row):
                    return (k,)
            n += 1
            seeds.append((n, row))
            return (n,)

        return step

    done = ordered_fold(parts, [*keys, "_part"], order, _with(parts, out), fold)
    return done.withColumn(out, F.concat_ws(".", F.col("_part").cast("string"), F.col(out).cast("string"))).drop("_part")


#: Rounds in which greedy pairs are taken everywhere at once, before chains of candidates are followed.
PAIR_ROUNDS = 3


def greedy_pairs(candidates: DataFrame, keys: list[str], a: str, b: str, order: list[str], rounds: int = PAIR_ROUNDS) -> DataFrame:
    """Exclusive pairs: candidates in order, taken if neither side is used yet; of ties any one goes first.

    A candidate that comes first for both of its sides is taken, and all others of those sides go.
    From the round ``rounds`` on chains are followed too: a candidate with one better one alone is
    taken if that is not, so the whole of a chain is known in rounds by the logarithm of its length.
    All are grouped minima and joins, so no side and no connected part is gathered.
    """
    side = lambda c: F.struct(*[F.col(k) for k in keys], F.col(c))
    numbered_rows = candidates.withColumns({"_u": side(a), "_v": side(b), "_n": F.monotonically_increasing_id()})
    left = cut(numbered_rows.withColumn("_r", F.struct(*order, "_n")))
    columns, taken = left.columns, left.limit(0)
    while not left.isEmpty():
        best = left.join(left.groupBy("_u").agg(F.min("_r").alias("_ru")), "_u").join(left.groupBy("_v").agg(F.min("_r").alias("_rv")), "_v")
        now = cut((best.where("_r = _ru and _r = _rv") if rounds > 0 else _along_chains(cut(best))).select(columns))
        taken, rounds = taken.unionByName(now), rounds - 1
        left = cut(left.join(now.select("_u"), "_u", "left_anti").join(now.select("_v"), "_v", "left_anti"))
    return taken.select(candidates.columns)


def _along_chains(best: DataFrame) -> DataFrame:
    """Rows taken for certain: those without a better one, and of those with just one those at even places after such a row.

    ``best`` has the best rank of either side of a row, ``_ru`` and ``_rv``.  Pointers to the better row
    are doubled until they reach a row that is known, or one with several better rows.
    """
    second_u = best.where("_r > _ru").groupBy("_u").agg(F.min("_r").alias("_su"))
    second_v = best.where("_r > _rv").groupBy("_v").agg(F.min("_r").alias("_sv"))
    ranked = best.join(second_u, "_u", "left").join(second_v, "_v", "left")
    better = F.expr("case when _r = _ru and _r = _sv then _rv._n when _r = _su and _r = _rv then _ru._n end")
    links = ranked.select("_n", better.alias("_p"), F.expr("case when _r = _ru and _r = _rv then 1 end").alias("_val"), F.lit(1).alias("_odd"))
    links = cut(links.where("_p is not null or _val is not null"))
    while True:
        seen = links.select(F.col("_n").alias("_p"), F.col("_p").alias("_pp"), F.col("_val").alias("_pval"), F.col("_odd").alias("_podd"))
        known = F.coalesce("_val", F.expr("_pval ^ _odd"))
        steps = links.join(seen, "_p", "left").withColumn("_moved", F.col("_val").isNull() & (F.col("_pval").isNotNull() | F.col("_pp").isNotNull()))
        steps = steps.select("_n", F.when(known.isNull(), F.coalesce("_pp", "_p")).alias("_p"), known.alias("_val"), F.expr("case when _pp is null then _odd else _odd ^ _podd end").alias("_odd"), "_moved")
        new = cut(steps)
        links = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return best.join(links.where("_val = 1").select("_n"), "_n", "left_semi")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the least node reachable, by spreading minima along edges and their labels."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = cut(e.union(e.select("v", "u")).distinct())
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")))
    while True:
        near = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("m"))
        low = label.join(near, "u").select("u", F.least("c", "m").alias("n"), "c")
        jump = low.join(low.select(F.col("u").alias("n"), F.col("n").alias("t")), "n", "left")
        new = cut(jump.select("u", F.least(F.coalesce("t", "n"), F.col("n")).alias("c"), (F.least(F.coalesce("t", "n"), F.col("n")) != F.col("c")).alias("changed")))
        label = new.select("u", "c")
        if new.where("changed").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("c").alias("component"))


def suppress_overlaps(reads: DataFrame, name: str = "qname", start: str = "start", end: str = "end", order: str = "ord") -> DataFrame:
    """Of the alignments of one read name, drops those whose start or end lies inside a longer one's range.

    Longer first (then by ``order``); dropped ones still count as longer.  ``part`` numbers what is
    kept, ``n_parts`` is its count.  Self-join on the name, so a name's rows are never gathered.
    """
    k = Window.partitionBy(name).orderBy((F.col(end) - F.col(start)).desc(), order)
    ranked = reads.withColumn("_k", F.row_number().over(k))
    other = ranked.select(name, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col("_k").alias("_j"))
    inside = F.col(start).between(F.col("_s"), F.col("_e")) | F.col(end).between(F.col("_s"), F.col("_e"))
    hit = ranked.join(other, name).where((F.col("_j") < F.col("_k")) & inside).select(name, "_k").distinct()
    kept = ranked.join(hit, [name, "_k"], "left_anti")
    part = F.row_number().over(Window.partitionBy(name).orderBy("_k"))
    return kept.withColumns({"part": part, "n_parts": F.count("*").over(Window.partitionBy(name))}).drop("_k")
