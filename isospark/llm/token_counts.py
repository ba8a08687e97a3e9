"""Operator 8, token counts: pieces counted once per distinct pre-token, summed per document.

The tokenizer drops white space and none of its rules looks across it, so the stretches
between ASCII white space are its pre-tokens at the coarsest: a text has as many tokens as
its pre-tokens have together.  (Special strings hold no white space, and stay whole.)

1. Each batch of documents becomes pre-token frequencies per document, packed into one row
   per vocabulary bucket: the bucket's distinct pre-tokens and, for each, the documents of
   the batch that hold it.  Rows are few and large, so the shuffle is a fraction of the text.
2. Rows of a bucket meet in one task, as the two sides of a hash join: every distinct
   pre-token of the bucket is encoded there once, and its count weighs the frequencies.
3. The buckets' partial sums of a batch meet again and are added per document.

No id list is ever stored or shuffled.  Buckets are a few for each shuffle partition, so a
task's vocabulary shrinks as the cluster grows; a pre-token in every document is one entry
per batch, whatever its frequency.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKED = "bucket int, part int, seq int, tokens binary, rows binary, docs binary, freqs binary"
#: Documents of a batch that are packed together at most, and bytes of their text.
BATCH_DOCS, BATCH_BYTES = 16_384, 12 << 20
#: Buckets for each shuffle partition, so that hashing spreads them evenly, and bytes of sums that a task holds.
BUCKETS_EACH, SUM_BYTES = 4, 16 << 20
#: Pre-tokens whose counts a task remembers at most; beyond, it forgets all and goes on.
KNOWN = 1 << 20


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pieces(path: str, pre_tokens: list[bytes]) -> list[int]:
    """Tokens of each pre-token as the library gives them."""
    return [len(e.ids) for e in _tokenizer(path).encode_batch_fast([b.decode("utf-8", "replace") for b in pre_tokens], add_special_tokens=False)]


def _chunks(batches, bounds=(BATCH_DOCS, BATCH_BYTES)) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts, cut at a number of documents and of bytes."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, b in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            b = b or b""
            if ids and (len(ids) >= bounds[0] or size + len(b) > bounds[1]):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(b)
            size += len(b)
    if ids:
        yield ids, texts


def _pack(buckets: int):
    """Frequencies of a batch, one row per bucket; bucket -1 - k carries the batch's ids and lengths to bucket k."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, (ids, texts) in enumerate(_chunks(batches)):
            vocab: dict[bytes, int] = {}
            where: list[np.ndarray] = []
            for d, b in enumerate(texts):
                w = b.split()
                if w:
                    where.append(np.fromiter((vocab.setdefault(x, len(vocab)) for x in w), np.int64, len(w)) << 16 | d)
            sums = {"bucket": [], "tokens": [], "rows": [], "docs": [], "freqs": []}
            if vocab:
                key = np.concatenate(where)
                key.sort()
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                freq = np.diff(np.r_[first, len(key)])
                key = key[first]
                token, doc = key >> 16, key & 0xFFFF
                names = list(vocab)
                home = np.fromiter((zlib.crc32(x) % buckets for x in names), np.int64, len(names))
                order = np.argsort(home[token], kind="stable")
                token, doc, freq = token[order], doc[order], freq[order]
                edges = np.searchsorted(home[token], np.arange(buckets + 1))
                for k in range(buckets):
                    lo, hi = edges[k], edges[k + 1]
                    if lo < hi:
                        t = token[lo:hi]
                        head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                        sums["bucket"].append(k)
                        sums["tokens"].append(b" ".join([names[x] for x in t[head]]))
                        sums["rows"].append(np.diff(np.r_[head, hi - lo]).astype(np.uint16).tobytes())
                        sums["docs"].append(doc[lo:hi].astype(np.uint16).tobytes())
                        f = freq[lo:hi]
                        # One byte each; larger ones follow in order where the byte is 255.
                        big = f >= 255
                        sums["freqs"].append(np.where(big, 255, f).astype(np.uint8).tobytes() + f[big].astype(np.int64).tobytes())
            sums["bucket"].append(-1 - (part + seq) % buckets)
            sums["tokens"].append(None)
            sums["rows"].append(np.array([i is not None for i in ids], np.uint8).tobytes())
            sums["docs"].append(np.array([i or 0 for i in ids], np.int64).tobytes())
            sums["freqs"].append(np.array([len(b) for b in texts], np.int64).tobytes())
            n = len(sums["bucket"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums["bucket"], pa.int32()), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32())]
                + [pa.array(sums[c], pa.binary()) for c in ("tokens", "rows", "docs", "freqs")],
                names=["bucket", "part", "seq", "tokens", "rows", "docs", "freqs"],
            )

    return run


def _weigh(path: str):
    """Partial sums of each packed row, every distinct pre-token of the task encoded once."""

    names = ("part", "seq", "valid", "ids", "lengths", "sums")
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))

    def run(batches):
        known: dict[bytes, int] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}  # of the buckets seen so far, by batch of documents
        size = 0
        for batch in batches:
            heads: list[tuple] = []
            for bucket, part, seq, tokens, rows, docs, freqs in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket < 0:
                    heads.append((part, seq, rows, docs, freqs, None))
                    continue
                words = tokens.split(b" ")
                if len(known) > KNOWN:
                    known.clear()
                new = [x for x in words if x not in known]
                known.update(zip(new, pieces(path, new)))
                n = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                d = np.frombuffer(docs, np.uint16)
                f = np.frombuffer(freqs, np.uint8, len(d)).astype(np.int64)
                f[f == 255] = np.frombuffer(freqs, np.int64, offset=len(d))
                n = np.repeat(n, np.frombuffer(rows, np.uint16))
                total = np.bincount(d, weights=n * f).astype(np.int64)
                held = sums.get((part, seq))
                if held is not None:
                    if len(held) < len(total):
                        held, total = total, held
                    held[: len(total)] += total
                    total = held
                else:
                    size += total.nbytes
                sums[part, seq] = total
                if size > SUM_BYTES:
                    yield made([(*k, None, None, None, v.tobytes()) for k, v in sums.items()])
                    sums, size = {}, 0
            if heads:
                yield made(heads)
        if sums:
            yield made([(*k, None, None, None, v.tobytes()) for k, v in sums.items()])

    return run


def _add(table: pa.Table) -> pa.Table:
    """Adds the partial sums of one batch: at most one row per bucket, and one with the ids."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    total = np.zeros(len(head["ids"]) // 8, np.int64)
    for r in rows:
        if r["sums"] is not None:
            s = np.frombuffer(r["sums"], np.int64)
            total[: len(s)] += s
    ids = pa.array(np.frombuffer(head["ids"], np.int64), mask=np.frombuffer(head["valid"], np.uint8) == 0)
    return pa.table({"id": ids, "n_bytes": np.frombuffer(head["lengths"], np.int64), "n_tokens": total})


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``(id_col, n_bytes, n_tokens)``, one row per row of ``docs``, whole texts.

    ``vocabulary`` is the path of a ``tokenizers`` JSON file on every worker, whose rules must
    drop white space; ids are integers of any width.  A null text counts as empty (no bytes, no tokens); null and repeated ids
    keep a row each; further columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids are integers here, and {id_col} is {kind.simpleString()}")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or BUCKETS_EACH * partitions
    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_pack(n), PACKED)
    home = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    sums = packed.repartition(partitions, home).mapInArrow(_weigh(vocabulary), "part int, seq int, valid binary, ids binary, lengths binary, sums binary")
    added = sums.groupBy("part", "seq").applyInArrow(_add, "id long, n_bytes long, n_tokens long")
    return added.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_tokens")
