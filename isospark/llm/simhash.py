"""Operator 3, SimHash near-dedup: a binary trie of fingerprints joined with itself.

``fingerprints`` gives each document a 64-bit SimHash.  ``trie_links`` finds which distinct
fingerprints differ in at most ``max_bits`` bits by walking pairs of trie nodes together:
every level of the walk takes one more bit, adds a differing one to the pair's error, and
drops the pair once the error exceeds the budget.

To deal the walk out, the 64 bits are cut into ``blocks`` parts; whenever at most
``max_bits`` bits differ, some ``blocks - max_bits`` parts agree entirely.  For each choice of
such parts there is one trie with those parts first and no error allowed in them, so its
subtries below them are independent: they are the shuffle key.  A subtrie that holds more
than ``SUBTRIE`` fingerprints is cut again by the same rule on its remaining bits, as often as
needed, so none has to fit a task because of a group of near copies.  A walk reports a
spanning forest of what it finds, not all pairs; components follow from those links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_copies
from .common import connected_components, cut

#: Fingerprints of a subtrie above which it is cut again; node pairs that a walk handles at once.
SUBTRIE, FRONTIER = 1024, 1 << 20


# fingerprints


def simhash(b: bytes | None, shingle: int = 3, repeats: bool = True) -> int:
    """SimHash of a UTF-8 text over XXH64 (seed 42) of its word shingles, A-Z lower-cased."""
    import xxhash

    w = b.lower().split() if b else []
    if not w:
        return 0
    grams = list(map(b" ".join, zip(*(w[i:] for i in range(shingle))))) if len(w) >= shingle else [b" ".join(w)]
    if not repeats:
        grams = list(set(grams))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: bool = False) -> DataFrame:
    """``(id_col, fp[, word_fp])`` as signed longs, one row per row of ``docs``; a text without words has 0.

    ``words`` adds a fingerprint of the set of single words.
    """

    def run(texts: pa.Array) -> pa.Array:
        b = texts.cast(pa.binary()).to_pylist()
        a = [np.array([simhash(x, shingle) for x in b], np.uint64).view(np.int64)]
        if words:
            a.append(np.array([simhash(x, 1, repeats=False) for x in b], np.uint64).view(np.int64))
        return pa.StructArray.from_arrays([pa.array(x) for x in a], names=["fp", "word_fp"][: len(a)])

    kind = T.StructType([T.StructField(n, T.LongType(), False) for n in ["fp", "word_fp"][: 1 + words]])
    return docs.select(F.col(id_col), F.arrow_udf(run, kind)(F.col(text_col)).alias("f")).select(id_col, "f.*")


def _fingerprint(text_col: str, shingle: int = 3) -> Column:
    """The fingerprint of ``fingerprints`` as a column."""
    run = F.arrow_udf(lambda texts: pa.array(np.array([simhash(x, shingle) for x in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)), T.LongType())
    return run(F.col(text_col))


# the walk


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def walk(group: np.ndarray, value: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within one group whose values differ in at most ``max_bits`` bits.

    Rows are sorted by (group, value); each group is a trie, its nodes are ranges of rows.
    Values of a group are distinct.  Returns a spanning forest of the pairs of each group (as
    two arrays of places).
    """
    n = len(value)
    bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    label = np.arange(n)
    stack = [(b[:-1], b[1:], b[:-1], b[1:], np.zeros(len(b) - 1, np.int64), 63) for b in [bounds]]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    ones: dict[int, np.ndarray] = {}
    while stack:
        alo, ahi, blo, bhi, err, bit = stack.pop()
        if len(alo) > FRONTIER:  # depth first, in pieces, so that memory is bounded
            half = len(alo) // 2
            stack += [tuple(x[:half] for x in (alo, ahi, blo, bhi, err)) + (bit,), tuple(x[half:] for x in (alo, ahi, blo, bhi, err)) + (bit,)]
            continue
        # A pair of leaves is decided at once by its remaining bits.
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            ok = (popcount(value[a] ^ value[b]) <= max_bits) & (a != b)
            left.append(a[ok])
            right.append(b[ok])
            if sum(map(len, left)) > FRONTIER:
                left, right = _forest(label, left, right)
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((value >> np.uint64(bit) & np.uint64(1)).astype(np.int64))]
        c = ones[bit]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = alo == blo
        other = ~same
        pairs = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + 1),
            (amid[other], ahi[other], blo[other], bmid[other], err[other] + 1),
        ]
        joined = [np.concatenate(x) for x in zip(*pairs)]
        live = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= max_bits)
        live &= ~((joined[0] == joined[2]) & (joined[1] - joined[0] == 1))
        stack.append(tuple(x[live] for x in joined) + (bit - 1,))
    left, right = _forest(label, left, right)
    return left[0], right[0]


def _forest(label: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The links as one from each row to the least row of its component (``label`` is updated)."""
    a, b = np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        before = label.copy()
        for x in (a, b, la, lb):
            np.minimum.at(label, x, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped
        if (before == label).all():
            break
    here = np.flatnonzero(label != np.arange(len(label)))
    return [here], [label[here]]


# the walk, dealt out


def _cuts(bits: list[int], max_bits: int, blocks: int) -> list[list[int]]:
    """For each choice of parts without error: the places of their bits."""
    edge = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    parts = [bits[a:b] for a, b in zip(edge, edge[1:])]
    return [sum(chosen, []) for chosen in itertools.combinations(parts, blocks - max_bits)]


def _mask(places: list[int]) -> int:
    m = sum(1 << p for p in places)
    return m - (1 << 64) if m >> 63 else m


def _blocks_for(n: int, max_bits: int) -> int:
    """Parts such that those without error have a few bits more than ``n`` needs."""
    blocks = max_bits + 1
    while 64 * (blocks - max_bits) // blocks < np.log2(max(n, 2)) + 2 and blocks < max_bits + 4:
        blocks += 1
    return blocks


def _walk_task(max_bits: int):
    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            key = [table.column(c).to_numpy() for c in ("path", "key")]
            value = table.column("fp").to_numpy().view(np.uint64)
            group = np.cumsum(np.r_[0, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])])
            order = np.lexsort((value, group))
            a, b = walk(group[order], value[order], max_bits)
            a, b = order[a], order[b]
            node = table.column("node").to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        def last_key(batch):
            return batch.column(0)[batch.num_rows - 1].as_py(), batch.column(1)[batch.num_rows - 1].as_py()

        for batch in batches:
            if not batch.num_rows:
                continue
            # Hold back the last subtrie, which the next batch may continue.
            path, key = (batch.column(i).to_numpy() for i in (0, 1))
            end = last_key(batch)
            start = int(np.flatnonzero((path != end[0]) | (key != end[1]))[-1]) + 1 if not ((path == end[0]) & (key == end[1])).all() else 0
            if start:
                yield flush(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = [batch.slice(start)]
            elif held and last_key(held[-1]) != end:
                yield flush(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def trie_links(points: DataFrame, max_bits: int = 2, subtrie: int = SUBTRIE) -> DataFrame:
    """Links ``(a, b)`` between nodes whose fingerprints differ in at most ``max_bits`` bits.

    ``points(node long, fp long)`` holds distinct fingerprints.  The links span
    every component of the full link graph.
    """
    cols = ["node", "fp"]
    points = points.select(*cols)
    blocks = _blocks_for(points.count(), max_bits)
    found: DataFrame | None = None

    def dealt(rows: DataFrame, cuts: dict[int, list[int]]) -> DataFrame:
        masks = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(_mask(c)).cast("long").alias("mask")) for p, c in cuts.items()])
        return rows.select(*cols, F.explode(masks).alias("t")).select(F.col("t.path").alias("path"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"), *cols)

    # A path names the bits that are already without error below it.
    paths = {0: []}
    level = {}
    for c in _cuts(list(range(63, -1, -1)), max_bits, blocks):
        level[len(paths)] = c
        paths[len(paths)] = c
    rows = dealt(points, level)
    for depth in range(5):
        last = depth == 4 or all(len(paths[p]) >= 64 - 3 * max_bits - 6 for p in level)
        rows = rows.repartition("path", "key")
        size = rows.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        rows = rows.join(size, ["path", "key"])
        small = rows if last else rows.where(F.col("n") <= subtrie)
        walked = cut(
            small.select("path", "key", *cols).sortWithinPartitions("path", "key").mapInArrow(_walk_task(max_bits), "a long, b long")
        )
        found = walked if found is None else found.union(walked)
        if last:
            break
        large = rows.where(F.col("n") > subtrie)
        here = [r[0] for r in large.select("path").distinct().collect()]  # at most one per choice of parts
        if not here:
            break
        level, nexts = {}, []
        for p in here:
            free = [b for b in range(63, -1, -1) if b not in set(paths[p])]
            below = {}
            for c in _cuts(free, max_bits, max_bits + 1):
                below[len(paths)] = paths[p] + c
                paths[len(paths)] = paths[p] + c
            level |= below
            nexts.append(dealt(large.where(F.col("path") == p), below))
        rows = nexts[0]
        for x in nexts[1:]:
            rows = rows.union(x)
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``(id_col, fp, component_id)``, one row per row of ``docs``.

    Documents link when their fingerprints differ in at most ``max_bits`` bits; ``component_id``
    is the smallest id reachable.  Null and empty texts have fingerprint 0 and link like any
    other; a row with a null id belongs to its component without naming it (a component of such
    rows alone has a null id); repeated rows and ids keep a row each; an empty table gives none.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    return fps.join(_component_ids(fps, id_col, "fp", trie_links(fps.select(F.col("fp").alias("node"), "fp").distinct(), max_bits)), "fp").select(id_col, "fp", "component_id")


def _component_ids(fps: DataFrame, id_col: str, node: str, links: DataFrame) -> DataFrame:
    """``(node, component_id)`` for every node of ``fps``."""
    least = fps.groupBy(node).agg(F.min(id_col).alias("least"))
    components = connected_components(links)
    labelled = least.join(components.withColumnRenamed("node", node), node, "left").select(node, "least", F.coalesce("component", F.col(node)).alias("component"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return labelled.join(ids, "component").select(node, "component_id")


#: Bits of 64 in which the fingerprints of shingle sets differ, on average, at a Jaccard similarity
#: of 0.8: their cosine is 2 * 0.8 / 1.8, and a bit differs with probability angle / pi.
SIMILAR_BITS = round(64 * float(np.arccos(2 * 0.8 / 1.8)) / np.pi)


def _fingerprint_links(table: DataFrame, max_bits: int) -> DataFrame:
    """Links ``(a, b)`` of the nodes of ``table(node, fp)`` whose fingerprints differ in at most ``max_bits`` bits.

    A fingerprint stands in the trie by the least of its nodes, to which its other nodes are linked.
    """
    both = cut(table.select("node", "fp").distinct())
    least = both.groupBy("fp").agg(F.min("node").alias("least"))
    same = both.join(least, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return trie_links(least.select(F.col("least").alias("node"), "fp"), max_bits).where("a <> b").union(same)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = near_copies.SHINGLE, max_bits: int | None = None) -> DataFrame:
    """``(id_col, component_id)`` of documents similar by word shingles, for dropping near copies.

    With ``max_bits`` documents link as well as in ``near_duplicates``, by the trie over their fingerprints.

    A pair links if the exact Jaccard similarity of its sets of ``shingle``-word shingles is 0.8 or
    more; candidates are found by ``near_copies``, as a trie over 64 bits with a budget for that
    similarity does not prune.  Texts and ids are treated as by ``near_duplicates``.
    """
    more = {} if max_bits is None else {"fp": _fingerprint(text_col)}
    table = near_copies.shingle_table(docs, id_col, text_col, shingle, **more)
    fps = table.select(id_col, "node")
    links = near_copies.similar_links(docs, table, id_col, text_col, shingle)
    if max_bits is not None:
        links = links.select("a", "b").union(_fingerprint_links(table, max_bits))
    return fps.join(_component_ids(fps, id_col, "node", links), "node").select(id_col, "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group of near copies: those with its smallest id.

    Groups are those of the links of ``near_duplicates``, fingerprints that differ in at most ``max_bits`` bits by
    the trie, and of the pairs that ``similar_groups`` finds besides.

    ``docs`` is read three times, so it should be a table and not a long computation.

    Rows with a null id cannot be told apart and all stay; of repeated rows with one id, one stays.
    """
    groups = cut(similar_groups(docs.where(F.col(id_col).isNotNull()), id_col, text_col, max_bits=max_bits, **options))
    dropped = groups.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    kept = docs.join(dropped, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if groups.groupBy(id_col).count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).union(kept.where(F.col(id_col).isNull()))
