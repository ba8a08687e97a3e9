"""Documents whose sets of word shingles have a Jaccard similarity of ``SIMILAR`` at least.

Each document has ``BANDS`` keys, each of ``ROWS`` minimum hashes of its shingle set; two documents of
similarity s share a key with probability 1 - (1 - s ** ROWS) ** BANDS, which is 0.99997 at 0.8.  Pairs
that share a key are candidates, and the exact similarity of their sets decides.

Sets are not kept: eight bytes a word are several times what the text takes.  The texts of candidates
are read again, and a pair's two texts meet in one row, from which both sets are made.

Pairs within a component need no comparing.  So in each key one document, the one that shares most keys,
is first held against all others (and so on with the next one, for ``ROUNDS``).  What is left in a key then are
mostly texts that are a little too far from all others.  They are told by the shingles that no other of
them has, which bounds how similar they can be; pairs from different components that the bound leaves are
compared, each in one of their keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, written

SHINGLE, BANDS, ROWS, ROUNDS = 5, 20, 4, 1
#: The least similarity, as numerator and denominator, so that it is compared in whole numbers.
SIMILAR = (4, 5)

_FACTOR, _FLIP = (np.random.default_rng(k).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for k in (1, 2))
#: Shingles that are hashed by all functions at once.
_CHUNK = 2048


def shingle_set(b: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted XXH64 hashes (seed 42) of the different word shingles, A-Z lower-cased; all words if there are fewer."""
    import xxhash

    w = b.lower().split() if b else []
    if not w:
        return np.zeros(0, np.uint64)
    grams = set(map(b" ".join, zip(*(w[i:] for i in range(shingle))))) if len(w) >= shingle else {b" ".join(w)}
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """Signed keys of the bands; none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        x = (hashes[at : at + _CHUNK] ^ _FLIP[:, None]) * _FACTOR[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    b = low.tobytes()
    keys = np.array([xxhash.xxh64_intdigest(b[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)], np.uint64)
    return keys.view(np.int64).tolist()


def _node_of(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), 7)


def shingle_table(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, **more: Column) -> DataFrame:
    """``(id_col, node, n, bands)`` and columns ``more``, one row per row of ``docs``: equal sets have one ``node``, ``n`` is their size."""

    def run(texts: pa.Array) -> pa.Array:
        node, n, bands = [], [], []
        for x in texts.cast(pa.binary()).to_pylist():
            s = shingle_set(x, shingle)
            node.append(_node_of(s))
            n.append(len(s))
            bands.append(band_keys(s))
        return pa.StructArray.from_arrays([pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["node", "n", "bands"])

    kind = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    rows = docs.select(F.col(id_col), F.arrow_udf(run, kind)(F.col(text_col)).alias("s"), *[c.alias(n) for n, c in more.items()])
    return written(rows.select(id_col, "s.*", *more), "shingles")


def candidate_texts(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(node, text)`` of ``nodes(node, id)``: rows of those ids are read again, and their node is worked out anew."""

    @F.arrow_udf(T.LongType())
    def node_of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([_node_of(shingle_set(x, shingle)) for x in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64))

    asked = nodes.select(F.col("id").alias("_id")).distinct()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    rows = rows.join(asked, rows["_id"].eqNullSafe(asked["_id"]), "left_semi").select(node_of(F.col("text")).alias("node"), "text")
    return written(rows.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]), "candidates")


def _like(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes ``a`` and ``b`` with ``common`` elements shared are similar enough."""
    return common * (SIMILAR[0] + SIMILAR[1]) >= (a + b) * SIMILAR[0]


def _alike(shingle: int):
    """Whether two texts are similar enough, by their sets."""

    @F.arrow_udf(T.BooleanType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last = [], (None, None)
        for x, y in zip(a.cast(pa.binary()).to_pylist(), b.cast(pa.binary()).to_pylist()):
            if y != last[0]:
                last = (y, shingle_set(y, shingle))
            s = shingle_set(x, shingle)
            both = len(np.intersect1d(s, last[1], assume_unique=True))
            out.append(both * sum(SIMILAR) >= (len(s) + len(last[1])) * SIMILAR[0])
        return pa.array(out, pa.bool_())

    return run


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs ``(a, b)`` that are similar enough by their texts, ``texts(node, text)``."""
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")), x)
    return cut(pairs.where(_alike(shingle)(F.col("text_a"), F.col("text_b"))).select("a", "b"))


def _hashes(shingle: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(x, shingle).view(np.int64) for x in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))

    return run


def _shared(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``(node, n, shared)`` of ``nodes(node, n)``: how many shingles of a set some other set of them holds.

    Shingles are counted before they are dealt out, so one that many sets hold is no large group.
    """
    own = texts.join(nodes.select("node"), "node", "left_semi").select("node", F.explode(_hashes(shingle)(F.col("text"))).alias("h"))
    own = own.groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("own"))
    return cut(nodes.join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).cast("int").alias("shared")))


def similar_links(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, rounds: int = ROUNDS) -> DataFrame:
    """Links ``(a, b)`` of similar nodes of a ``shingle_table`` of ``docs`` that span every component of the graph of all such pairs found."""
    nodes = table.groupBy("node").agg(F.min(id_col).alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    keys = nodes.select("id", "node", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    keys = cut(keys.join(shared, "key"))
    texts = candidate_texts(docs, keys.select("node", "id").distinct(), id_col, text_col, shingle)
    degree = keys.groupBy("node").agg(F.sum("m").alias("degree"))
    rows = keys.select("key", "node", "n").join(degree, "node").withColumn("component", F.col("node"))

    def near(most: Column, a: Column, b: Column) -> Column:
        return _like(most, a, b)

    links: DataFrame | None = None
    for k in range(rounds + 1):
        # Keys whose rows are all of one component are done.
        open_keys = rows.groupBy("key").agg(F.max(F.struct("degree", "node", "n", "component")).alias("top"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "top")
        left = cut(rows.join(open_keys, "key"))
        if left.isEmpty():
            break
        if k < rounds:
            found = left.where((F.col("component") != F.col("top.component")) & near(F.least("n", "top.n"), F.col("n"), F.col("top.n"))).select(F.col("node").alias("a"), F.col("top.node").alias("b"))
        else:
            nodes = left.select("node", "n").distinct()
            for _ in range(2):  # what has no partner left no longer counts for others
                told = _shared(nodes, texts, shingle)
                nodes = told.where(near(F.col("shared"), F.col("n"), F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]))).select("node", "n")
            told = told.where(near(F.col("shared"), F.col("n"), F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1])))
            all_keys = left.groupBy("node").agg(F.collect_set("key").alias("keys"))
            rest = cut(left.select("key", "node", "component").join(told, "node").join(all_keys, "node"))
            x, y = (rest.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "n", "shared", "component", "keys")]) for p in "ab")
            # A pair is made in the least of the keys that it shares.
            once = F.col("key") == F.array_min(F.array_intersect("a_keys", "b_keys"))
            apart = (F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component"))
            found = x.join(y, "key").where(apart & near(F.least("a_shared", "b_shared"), F.col("a_n"), F.col("b_n")) & once).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        held = _verified(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, shingle)
        links = held if links is None else links.union(held)
        if k < rounds:
            named = connected_components(links).select("node", F.col("component").alias("now"))
            rest = left.where(F.col("node") != F.col("top.node")).select("key", "node", "n", "degree", "component")
            rows = rest.join(named, "node", "left").select("key", "node", "n", "degree", F.coalesce("now", "component").alias("component"))
    return docs.sparkSession.createDataFrame([], "a long, b long") if links is None else links
