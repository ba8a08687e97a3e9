"""Source divergence audit: how far the words of a language differ between its sources.

Single-pass in-memory indexing, as Spark jobs:

1. Each task builds block postings in memory: by language and term, the sources that hold it with
   occurrences and documents.  When the block is full it is written out as a term-sorted run, cut into
   chunks by hash shard, and a new block begins.
2. The chunks of a shard meet in one task, sorted by their first term, and a heap merges them: a chunk
   is opened when its first term is due and dropped at its last, so a task holds the chunks that
   overlap.  What comes out is one row per term with its frequencies by source.
3. Sources are numbered per language.  For two sources the sum over all terms is that of terms which
   neither has, a product, plus corrections of the terms that either has; tasks stream the merged rows
   and add corrections up in matrices of at most ``SIDE`` sources a side.

No group of rows is gathered: not a language nor a source, and of a term no more than one entry per source.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: A term is kept in a language if so many of its documents hold it; and what is added to each count.
MIN_DOCS, PRIOR = 30, 5
#: Shares are whole numbers of a billionth.
UNIT = 1_000_000_000
#: Terms of a source that are reported.
TOP = 50
#: Postings of a block in memory, and hash shards that its run is cut into.
BLOCK_POSTINGS, SHARDS = 400_000, 256
#: Postings that the open chunks of a shard have together.
OPEN_POSTINGS = 4_000_000
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 20
#: Sources of a block in the matrices of corrections, and matrices that a task holds.
SIDE, HELD = 256, 32

#: Terms are joined by blanks; ``docs`` and ``sizes`` are a number per term, ``ids`` (places in ``names``) and ``counts`` per posting.
CHUNK = "shard int, lang string, first binary, terms binary, docs binary, sizes binary, names array<string>, ids binary, counts binary"
_CHUNK = pa.schema([("shard", pa.int32()), ("lang", pa.string()), *((c, pa.binary()) for c in ("first", "terms", "docs", "sizes")), ("names", pa.list_(pa.string())), ("ids", pa.binary()), ("counts", pa.binary())])
MERGED = "lang string, term string, docs long, sources array<string>, counts array<long>"
_MERGED = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

#: Letters of terms in lower case, bytes of other code points as they are, everything else a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(text: str) -> Iterator[list[bytes]]:
    """The terms of a text as UTF-8, a list for each piece of it; a piece ends at a blank."""
    folded = text.encode().translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _run(block: dict, shards: int, most: int) -> Iterator[pa.RecordBatch]:
    """A block as its term-sorted run: a row per shard and language, or more of ``most`` postings."""
    rows = []
    for lang, (docs, groups) in block.items():
        terms = sorted(docs)
        place = dict(zip(terms, range(len(terms)), strict=True))
        names = sorted(groups)
        sizes = [len(groups[s]) for s in names]
        t = np.concatenate([np.fromiter(map(place.__getitem__, groups[s]), np.int64, n) for s, n in zip(names, sizes, strict=True)])
        n = np.concatenate([np.fromiter(groups[s].values(), np.int64, k) for s, k in zip(names, sizes, strict=True)])
        of = np.repeat(np.arange(len(names)), sizes)
        shard = np.fromiter((zlib.crc32(x) % shards for x in terms), np.int64, len(terms))
        df = np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms))
        order = np.lexsort((of, t, shard[t]))
        t, n, of = t[order], n[order], of[order]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        ends = np.r_[starts[1:], len(t)]
        term = t[starts]
        mine = shard[term]
        # A chunk ends with its shard, and where the next multiple of ``most`` postings is passed.
        within = starts - starts[np.searchsorted(mine, mine)]
        cuts = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]) | (within[1:] // most != within[:-1] // most), True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i, j = starts[a], ends[b - 1]
            used, ids = np.unique(of[i:j], return_inverse=True)
            words = [terms[k] for k in term[a:b]]
            rows.append({"shard": int(mine[a]), "lang": lang, "first": words[0], "terms": b" ".join(words), "docs": df[term[a:b]].tobytes(), "sizes": (ends[a:b] - starts[a:b]).tobytes(), "names": [names[k] for k in used], "ids": ids.astype(np.int32).tobytes(), "counts": n[i:j].tobytes()})
            if len(rows) == 256:
                yield pa.RecordBatch.from_pylist(rows, _CHUNK)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _CHUNK)


def _index(batches: Iterator[pa.RecordBatch], limit: int, shards: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of the blocks of a task.  The empty term counts the documents of a source, also of one without terms."""
    block: dict = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            docs, groups = block.setdefault(lang.as_py(), (Counter(), {}))
            counts = groups.setdefault(source.as_py(), Counter())
            held -= len(counts)
            different: set = {b""}
            for terms in pieces(text.as_py()):
                counts.update(terms)
                different.update(terms)
            counts[b""] += 1
            docs.update(different)
            held += len(counts)
            if held >= limit:
                yield from _run(block, shards, most)
                block, held = {}, 0
    yield from _run(block, shards, most)


def runs(docs: DataFrame, block_postings: int = BLOCK_POSTINGS, shards: int = SHARDS, most: int = OPEN_POSTINGS) -> DataFrame:
    """Step 1: chunks of the sorted runs of ``docs(lang, source, text)``, nulls as empty strings."""
    return docs.mapInArrow(lambda b: _index(b, block_postings, shards, most), CHUNK)


def _walk(chunk: dict) -> Iterator[tuple]:
    """``(term, documents, chunk, first posting, end of postings)`` of each term of a chunk."""
    end = np.cumsum(np.frombuffer(chunk["sizes"], np.int64)).tolist()
    held = (chunk["names"], np.frombuffer(chunk["ids"], np.int32).tolist(), np.frombuffer(chunk["counts"], np.int64).tolist())
    yield from zip(chunk["terms"].split(b" "), np.frombuffer(chunk["docs"], np.int64).tolist(), itertools.repeat(held), [0, *end[:-1]], end, strict=False)


def _summed(entries: list[tuple]) -> dict[str, int]:
    posts: dict = {}
    for (names, ids, counts), a, b in entries:
        for i in range(a, b):
            s = names[ids[i]]
            posts[s] = posts.get(s, 0) + counts[i]
    return posts


def merged_terms(chunks: Iterator[dict], min_docs: int) -> Iterator[tuple]:
    """``(lang, term, documents, {source: occurrences})`` of chunks in order of (shard, lang, first).

    The heap holds the next term of each open chunk; it runs up to the first term of the chunk that comes
    next.  Terms in fewer than ``min_docs`` documents are left out, but for the empty one.
    """
    for (_, lang), group in itertools.groupby(chunks, lambda c: (c["shard"], c["lang"])):
        heap: list = []
        now, docs, entries = None, 0, []
        for k, chunk in enumerate(itertools.chain(group, [None])):
            while heap and (chunk is None or heap[0][0] < chunk["first"]):
                term, _, d, held, a, b, rest = heap[0]
                if term != now:
                    if now == b"" or docs >= min_docs:
                        yield lang, now, docs, _summed(entries)
                    now, docs, entries = term, 0, []
                docs += d
                entries.append((held, a, b))
                following = next(rest, None)
                if following is None:
                    heapq.heappop(heap)
                else:
                    heapq.heapreplace(heap, (following[0], heap[0][1], *following[1:], rest))
            if chunk is not None:
                rest = _walk(chunk)
                first = next(rest)
                heapq.heappush(heap, (first[0], k, *first[1:], rest))
        if now == b"" or docs >= min_docs:
            yield lang, now, docs, _summed(entries)


def _merge(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    chunks = (row for batch in batches for i in range(0, batch.num_rows, 64) for row in batch.slice(i, 64).to_pylist())
    rows: list = []
    for lang, term, docs, posts in merged_terms(chunks, min_docs):
        sources = sorted(posts)
        rows.append({"lang": lang, "term": term.decode(), "docs": docs, "sources": sources, "counts": [posts[s] for s in sources]})
        if len(rows) == 2048:
            yield pa.RecordBatch.from_pylist(rows, _MERGED)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _MERGED)


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, block_postings: int = BLOCK_POSTINGS, shards: int = SHARDS, open_postings: int = OPEN_POSTINGS) -> DataFrame:
    """Steps 1 and 2: a row per language and kept term; the empty term has the documents of every source.

    A chunk of each run may be open at once, so chunks are the smaller the more tasks there are.
    """
    shards = max(shards, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = runs(docs, block_postings, shards, max(1, open_postings // (4 * max(1, docs.rdd.getNumPartitions()))))
    return chunks.repartition("shard").sortWithinPartitions("shard", "lang", "first").mapInArrow(lambda b: _merge(b, min_docs), MERGED)


def _corrections(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """Sums of corrections by pair of sources; a row is a term in two blocks of sources, see ``corrections``."""
    sums: dict = {}
    schema = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])

    def out():
        for (lang, x, y), m in sums.items():
            i, j = np.nonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i + x * side), pa.array(j + y * side), pa.array(m[i, j])], schema=schema)
        sums.clear()

    for batch in batches:
        for r in batch.to_pylist():
            key = (r["lang"], r["x"], r["y"])
            p0, q0 = np.array(r["p0"]), np.array(r["q0"])
            if key not in sums:
                if len(sums) >= HELD:
                    yield from out()
                sums[key] = np.zeros((len(p0), len(q0)), np.int64)
            total = sums[key]
            p, q = p0.copy(), q0.copy()
            i, j = np.array(r["i"], np.int64), np.array(r["j"], np.int64)
            p[i], q[j] = r["p"], r["q"]
            total[i] += np.abs(p[i][:, None] - q) - np.abs(p0[i][:, None] - q0)
            absent = np.ones(len(p0), bool)
            absent[i] = False
            total[:, j] += absent[:, None] * (np.abs(p[:, None] - q[j]) - np.abs(p0[:, None] - q0[j]))
    yield from out()


def corrections(shares: DataFrame, sources: DataFrame, side: int = SIDE) -> DataFrame:
    """Step 3: ``(lang, a, b, value)``, the summed corrections of the sources numbered ``a`` and ``b``.

    ``shares(lang, term, posts array<struct<k, p>>)`` has the shares of sources with a term, and
    ``sources(lang, k, p0)`` the share of one without.
    """
    cells = sources.withColumn("x", F.floor(F.col("k") / side)).groupBy("lang", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p0"))), lambda s: s["p0"]).alias("p0"))
    cells = written(cells, "source-blocks")
    blocks = F.transform(F.array_distinct(F.transform("posts", lambda s: F.floor(s["k"] / side))), lambda b: F.struct(b.alias("x"), F.filter("posts", lambda s: F.floor(s["k"] / side) == b).alias("posts")))
    held = shares.select("lang", "term", F.explode(blocks).alias("b")).select("lang", "term", "b.x", "b.posts")
    if cells.agg(F.max("x")).first()[0]:  # more than one block of sources in a language: every block meets every block, with or without the term
        mine = held.select("lang", "term", "x", F.col("posts").alias("mine"))
        other = cells.select("lang", F.col("x").alias("y"))
        ends = held.select("lang", "term", F.col("x").alias("y"), F.col("posts").alias("theirs"))
        known = mine.join(other, "lang").join(ends, ["lang", "term", "y"], "left")
        # Blocks without the term are met from the side that has it.
        turned = known.where("theirs is null").select("lang", "term", F.col("y").alias("x"), F.col("x").alias("y"), F.expr("slice(mine, 1, 0)").alias("mine"), F.col("mine").alias("theirs"))
        pairs = known.select("lang", "term", "x", "y", "mine", F.coalesce("theirs", F.expr("slice(mine, 1, 0)")).alias("theirs")).unionByName(turned)
    else:
        pairs = held.select("lang", "term", "x", F.col("x").alias("y"), F.col("posts").alias("mine"), F.col("posts").alias("theirs"))
    at = lambda c: F.transform(c, lambda s: (s["k"] % side).cast("int"))
    p = lambda c: F.transform(c, lambda s: s["p"])
    q = cells.select("lang", F.col("x").alias("y"), F.col("p0").alias("q0"))
    rows = pairs.join(cells, ["lang", "x"]).join(q, ["lang", "y"])
    rows = rows.select("lang", "x", "y", "p0", "q0", at("mine").alias("i"), p("mine").alias("p"), at("theirs").alias("j"), p("theirs").alias("q"))
    return rows.mapInArrow(lambda b: _corrections(b, side), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _share(count: str, total: str, terms: str) -> str:
    """A share in billionths, by exact division."""
    return f"1 + (cast({UNIT} * (cast({count} as decimal(19, 0)) + {PRIOR}) as decimal(38, 0)) div ({total} + {PRIOR} * {terms}))"


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, block_postings: int = BLOCK_POSTINGS, shards: int = SHARDS, side: int = SIDE) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair``: for each source of a language every other one, with the sum of differences of shares over
    all kept terms, 0 if there is none.  Part ``term``: the ``top`` terms that a source has beyond the
    language's share.  A term's share is 1 + floor(10^9 (n + 5) / (N + 5 V)), exact at any count; ties go by
    UTF-8 order.  Null languages, sources and texts count as empty strings; repeated rows count each; a very
    long text is one document, taken apart by pieces.  An empty table gives an empty one.  Columns beside
    the three are not read, whatever their names.
    """
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    merged = written(frequencies(docs, min_docs, block_postings, shards), "frequencies")
    terms = merged.where("term <> ''")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.expr("aggregate(counts, 0L, (x, y) -> x + y)")).alias("n_lang"))
    posts = terms.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c")).select("lang", "term", F.col("c.sources").alias("source"), F.col("c.counts").alias("n"))
    present = merged.where("term = ''").select("lang", F.explode("sources").alias("source"))
    totals = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = present.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "n_lang"])
    # Ids within a language by a window over its sources alone, not over its rows.
    numbered = numbered.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = written(numbered.withColumn("p0", F.when(F.col("v") > 0, F.expr(_share("0", "total", "v"))).otherwise(F.lit(1)).cast("long")), "sources")

    stats = groups.select("lang", "source", "k", "total", "v", "n_lang")
    shares = posts.join(stats, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "v")))
    of_lang = terms.select("lang", "term", F.expr("aggregate(counts, 0L, (x, y) -> x + y)").alias("n_all"))
    by_term = written(shares.groupBy("lang", "term").agg(F.collect_list(F.struct("k", "source", "p")).alias("posts"), F.first("v").alias("v"), F.first("n_lang").alias("n_lang")).join(of_lang, ["lang", "term"]), "shares")

    beyond = by_term.withColumn("q", F.expr(_share("n_all", "n_lang", "v"))).select("lang", "term", "q", F.explode("posts").alias("s")).where("s.p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    items = beyond.select("lang", "s.source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("s.p") - F.col("q")).alias("value"))
    ranked = items.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    fixed = corrections(by_term.select("lang", "term", "posts"), groups.select("lang", "k", "p0"), side)
    a = groups.select("lang", F.col("k").alias("a"), "source", "v", F.col("p0").alias("pa"))
    b = groups.select("lang", F.col("k").alias("b"), F.col("source").alias("item"), F.col("p0").alias("pb"))
    pairs = a.join(b, "lang").where("a <> b").join(fixed, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("v") * F.abs(F.col("pa") - F.col("pb")) + F.coalesce("value", F.lit(0))).cast("long").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(ranked)
