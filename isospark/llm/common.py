"""Helpers shared by the corpus operators: scratch space in the shared folder, and graph components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.session import cut, scratch_path, shared_dir, written

__all__ = ["connected_components", "cut", "free_name", "scratch_path", "shared_dir", "written"]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as ``edges(a long, b long)``.

    Returns ``(node, component)`` for every node with an edge, ``component`` being the
    smallest node reachable.  Alternates large-star and small-star steps, each a grouped
    minimum and a join, until the edge set is a fixed point (a star per component), which
    takes a number of rounds that grows with the logarithm of the nodes; a hub with very many
    leaves is only ever a join key whose rows AQE may split.  Loops, repeated edges and an
    empty input are allowed; edges with a null end are ignored.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    # Of a distinct set of edges: its size and two sums of hashes.
    mark_of = [F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(hash(v, u) as long))")]
    mark = e.agg(*mark_of).first()
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        new = e.agg(*mark_of).first()
        if new == mark:
            break
        mark = new
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
