"""Operator 7, benchmark decontamination: an FM-index per training shard, searched by test phrases.

Phrases are the windows of ``WINDOW`` consecutive words of each benchmark item (an item of
fewer words is one phrase).  A training shard is a run of whole documents; every stretch of
a document whose words all occur in some phrase goes into the shard's FM-index (nothing
outside such a stretch can match, so leaving it out loses no occurrence).  All phrases are
searched backward at once through wavelet-matrix ranks, occurrences are located by sampled
suffix positions, and overlapping ones are merged to removal spans.

Shards are cut inside tasks at a size, so memory is bounded and nothing is shuffled.  The
benchmark goes to the tasks in blocks of bounded size, one pass over the documents per block.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .fm_index import FMIndex

WINDOW = 10
#: A shard is searched when it holds so many indexed words or bytes of text.
SHARD_WORDS, SHARD_BYTES = 1_000_000, 24 << 20
#: Benchmark text that one pass over the documents looks for.
BLOCK_BYTES = 8 << 20

#: Lower-cases A-Z and turns every ASCII character outside 0-9 and a-z into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(b: bytes | None) -> list[bytes]:
    return b.translate(_FOLD).split() if b else []


class Phrases:
    """The distinct windows of some items, as rows of word codes, and the items of each."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        self.code: dict[bytes, int] = {}
        parts, owner = [], []
        for item, text in items:
            w = np.fromiter((self.code.setdefault(x, len(self.code) + 1) for x in words(text)), np.int32)
            if not len(w):
                continue
            rows = np.zeros((max(1, len(w) - window + 1), window), np.int32)
            if len(w) < window:
                rows[0, : len(w)] = w
            else:
                rows[:] = np.lib.stride_tricks.sliding_window_view(w, window)
            parts.append(rows)
            owner.append((item, len(rows)))
        every = np.concatenate(parts) if parts else np.zeros((0, window), np.int32)
        self.matrix, which = np.unique(every, axis=0, return_inverse=True)
        self.lengths = (self.matrix != 0).sum(axis=1).astype(np.int64)
        self.shortest = int(self.lengths.min(initial=window))
        # Items of each phrase, each once; those with a null id are not named.
        ids = np.repeat(np.array([i or 0 for i, _ in owner], np.int64), [n for _, n in owner])
        named = np.repeat(np.array([i is not None for i, _ in owner], bool), [n for _, n in owner])
        pairs = np.unique(np.stack([which.ravel()[named], ids[named]], 1), axis=0) if len(ids) else np.zeros((0, 2), np.int64)
        self.owners = pairs[:, 1]
        self.owner_start = np.searchsorted(pairs[:, 0], np.arange(len(self.matrix) + 1))


def candidate_runs(doc_words: list[bytes], phrases: Phrases) -> list[tuple[int, np.ndarray]]:
    """Maximal stretches of phrase vocabulary, long enough to hold a phrase: (first word, codes)."""
    get = phrases.code.get
    codes = np.fromiter((get(x, 0) for x in doc_words), np.int64, len(doc_words))
    edge = np.flatnonzero(np.diff(np.r_[0, codes != 0, 0]))
    lo, hi = edge[::2], edge[1::2]
    long = hi - lo >= phrases.shortest
    return [(int(a), codes[a:b]) for a, b in zip(lo[long], hi[long])]


def search_shard(runs: list[list[tuple[int, np.ndarray]]], phrases: Phrases) -> dict[int, tuple[list[tuple[int, int]], list[int]]]:
    """Per document (by place in ``runs``) with a hit: merged word spans ``[start, end)`` and items."""
    flat = [(d, w0, r) for d, rs in enumerate(runs) for w0, r in rs]
    if not flat or not len(phrases.lengths):
        return {}
    index = FMIndex([r for _, _, r in flat], len(phrases.code))
    lo, hi = index.search(phrases.matrix, phrases.lengths)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    if not len(which):
        return {}
    rows = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(which))
    place = index.locate(rows)
    run_doc, run_word = np.array([d for d, _, _ in flat]), np.array([w for _, w, _ in flat])
    edge = np.zeros(index.n + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + phrases.lengths[which], -1)
    bound = np.flatnonzero(np.diff(np.r_[0, np.cumsum(edge) > 0, 0]))
    spans: dict[int, tuple[list, list]] = {}
    # Runs are parted by a separator that no phrase covers, so no span crosses one.
    for a, b in zip(bound[::2], bound[1::2]):
        r = np.searchsorted(index.starts, a, side="right") - 1
        spans.setdefault(int(run_doc[r]), ([], []))[0].append((int(a - index.starts[r] + run_word[r]), int(b - index.starts[r] + run_word[r])))
    hit_doc = run_doc[np.searchsorted(index.starts, place, side="right") - 1]
    pairs = np.unique(np.stack([hit_doc, which], 1), axis=0)
    count = np.diff(phrases.owner_start)[pairs[:, 1]]
    owner = np.repeat(phrases.owner_start[pairs[:, 1]] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    for d, item in np.unique(np.stack([np.repeat(pairs[:, 0], count), phrases.owners[owner]], 1), axis=0).tolist():
        spans[d][1].append(item)
    return spans


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _shards(batches, text: str, phrases: Phrases, size: tuple[int, int]) -> Iterator[tuple[list, list, list]]:
    """Whole Arrow batches, their texts and their candidate runs, cut to shards."""
    held, texts, runs, n_words, n_bytes = [], [], [], 0, 0
    for whole in batches:
        column = whole.column(whole.schema.get_field_index(text)).cast(pa.binary())
        at = 0
        for i, b in enumerate(column.to_pylist()):
            found = candidate_runs(words(b), phrases)
            texts.append(b)
            runs.append(found)
            n_words += sum(len(r) + 1 for _, r in found)
            n_bytes += len(b or b"")
            if n_words >= size[0] or n_bytes >= size[1]:
                yield held + [whole.slice(at, i + 1 - at)], texts, runs
                held, texts, runs, n_words, n_bytes, at = [], [], [], 0, 0, i + 1
        if at < whole.num_rows:
            held.append(whole.slice(at))
    if held:
        yield held, texts, runs


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of bounded text, read one partition at a time."""
    block: list[tuple] = []
    size = 0
    kind = benchmark.schema[item_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"items have integer ids here, and {item_col} is {kind.simpleString()}")
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator()
    for r in rows:
        block.append((r.i, bytes(r.t) if r.t is not None else None))
        size += len(r.t or b"")
        if size >= block_bytes:
            yield Phrases(block, window)
            block, size = [], 0
    yield Phrases(block, window)


_SPAN = "array<struct<start:long,end:long>>"


def _find(phrases, text: str, size: tuple[int, int]):
    """A pass that adds one block's spans and items to what earlier blocks found."""

    def run(batches):
        p = phrases.value
        for held, texts, runs in _shards(batches, text, p, size):
            found = search_shard(runs, p)
            at = 0
            for batch in held:
                spans, items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                for i in range(batch.num_rows):
                    if at + i in found:
                        s, o = found[at + i]
                        spans[i] = [{"start": a, "end": b} for a, b in merge_spans(s + [(x["start"], x["end"]) for x in spans[i] or ()])]
                        items[i] = sorted({*o, *(items[i] or ())})
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays(batch.columns[:-2] + [pa.array(spans, batch.schema.types[-2]), pa.array(items, batch.schema.types[-1])], schema=batch.schema)

    return run


def find_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard: tuple[int, int] = (SHARD_WORDS, SHARD_BYTES), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``hit_spans`` (merged word ranges, end exclusive) and ``hit_items`` (ids, ascending).

    Both are null where nothing is hit.  Null texts have no words; null or empty items have no
    phrases; ids of items are integers, and an item with a null id is searched for but cannot be named;
    very long texts are a shard of their own and searched whole; repeated rows of either
    table are treated alike; an empty benchmark or document table gives no hits.  Columns of
    ``docs`` named ``hit_spans`` or ``hit_items`` are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("hit_spans", "hit_items")]
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast(_SPAN).alias("hit_spans"), F.lit(None).cast("array<long>").alias("hit_items"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
    for k, block in enumerate(phrase_blocks(benchmark, item_col, item_text, window, block_bytes)):
        # Each pass is written before the next one, so that tasks hold one block at a time.
        out = (written(out, "spans") if k else out).mapInArrow(_find(spark.sparkContext.broadcast(block), text_col, shard), schema)
    return out


def _n_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(words(b)) for b in texts.cast(pa.binary()).to_pylist()], pa.int64())


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    n_words = F.arrow_udf(_n_words, T.LongType())
    hits = find_spans(docs.select(id_col, text_col), benchmark, text_col, **options)
    n_hit = F.coalesce(F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0).cast("long"))
    items = F.coalesce(F.col("hit_items"), F.array().cast("array<long>"))
    names = F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",")
    return hits.select(
        id_col,
        n_words(F.col(text_col)).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_spans(b: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(b.translate(_FOLD))]
    out, last = [], 0
    for s, e in spans:
        out.append(b[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join(out) + b[last:]


def _remove(block, text: str, mark: str, size: tuple[int, int]):
    """Cuts one block's phrases out of the texts, until none of them is left; ``mark`` is set where one was."""

    def run(batches):
        p = block.value
        for held, texts, runs in _shards(batches, text, p, size):
            todo, changed = list(range(len(texts))), set()
            # Joined ends can form a phrase anew, so what was cut is searched again.
            while todo:
                found = search_shard(runs, p)
                todo = [todo[k] for k in sorted(found)]
                for k, d in zip(sorted(found), todo):
                    texts[d] = cut_spans(texts[d], merge_spans(found[k][0]))
                changed |= set(todo)
                runs = [candidate_runs(words(texts[d]), p) for d in todo]
            at = 0
            for batch in held:
                k, c = batch.schema.get_field_index(text), batch.schema.get_field_index(mark)
                new = pa.array(texts[at : at + batch.num_rows], pa.binary()).cast(batch.schema.field(k).type)
                was = batch.column(c).to_pylist()
                marks = pa.array([w or at + i in changed for i, w in enumerate(was)], pa.bool_())
                yield batch.set_column(k, batch.schema.field(k), new).set_column(c, batch.schema.field(c), marks)
                at += batch.num_rows

    return run


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard: tuple[int, int] = (SHARD_WORDS, SHARD_BYTES), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, same columns, with every occurrence of a phrase cut out of the text, until none is left.

    Texts and items are treated as by ``find_spans``.  A benchmark of several blocks takes a pass for
    each, written before the next, and further rounds while a round has cut something, as what one
    block's cuts have joined may be a phrase of another.
    """
    spark = docs.sparkSession
    names = [F.col(f"`{c}`") for c in docs.columns]
    blocks = phrase_blocks(benchmark, item_col, item_text, window, block_bytes)
    first, second = next(blocks), next(blocks, None)
    mark = "_cut"
    while mark in docs.columns:
        mark += "_"
    rows = docs.select(*names, F.lit(False).alias(mark))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    if second is None:
        return rows.mapInArrow(_remove(spark.sparkContext.broadcast(first), text_col, mark, shard), schema).select(*names)
    while True:
        for block in itertools.chain([first, second], blocks):
            held = spark.sparkContext.broadcast(block)
            rows = written(rows.mapInArrow(_remove(held, text_col, mark, shard), schema), "without-spans")
            held.destroy()
        if rows.where(F.col(mark)).isEmpty():
            return rows.select(*names)
        rows = rows.withColumn(mark, F.lit(False))
        blocks = phrase_blocks(benchmark, item_col, item_text, window, block_bytes)
        first, second = next(blocks), next(blocks)
