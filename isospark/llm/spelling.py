"""Spelling variants: words one edit apart, each with the more frequent neighbour that it is a form of.

1. Words are counted: each task sums them in a bounded dictionary first.
2. The vocabulary is put into Bloom filters, sharded by length and blocked, so that all bits of a word
   lie in one cache line.  Filters are laid end to end and broadcast in ranges of bounded size, a pass
   over the vocabulary for each range.
3. Every word's edits are generated as hashes alone, by arithmetic on the hash of the word, and probed.
   Only for those that are found is the text made, and only those are shuffled: an exact join with the
   vocabulary removes what the filter let through wrongly.
4. Links become the number of neighbours and the best one; forms are followed to the root by doubling.

An edit is made once per pair of words: deletions lead from the longer word to the shorter one,
replacements from the smaller letter to the larger.  A word has at most some 180 neighbours a letter,
so no join key is hot.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written

#: Code points and occurrences that a word has at least, how many times as frequent a form is.
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 5, 3, 2
#: One in so many runs of letters of a document loses a letter.
THINNED = 97
#: Letters of words, as Latin-1: ASCII in lower case, and U+00C0 to U+00FF.
LETTERS = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint8)
#: Bits of a word in the filter, bits it sets, and bits of a block.
BITS_PER_WORD, BITS_SET, BLOCK = 16, 6, 512
#: Bits of the filters that are broadcast at once, 64 MB.
MAX_BITS = 1 << 29
#: Words that a task counts before it passes the counts on, and edits that are probed at once.
HELD, AT_ONCE = 200_000, 1 << 20
#: Letters from which on a word is long, and letters of long words that a task counts before it passes the counts on.
LONG, HELD_LETTERS = 64, 1 << 23
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 20

#: A-Z in lower case, other letters as they are, everything else a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: A number for each byte, and the base of positions, of the hash of a word.
_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(text: str) -> Counter:
    """Occurrences of each run of letters, ASCII in lower case, as Latin-1."""
    folded = text.encode("latin-1", "replace").translate(_FOLD)
    counts: Counter = Counter()
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def thinned(run: bytes, prefix: int | None) -> bytes:
    """The run without a letter, if 97 divides the checksum of ``<id>:<run>``; ``prefix`` is that of ``<id>:``."""
    if prefix is None:
        return run
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % THINNED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    letters = 0

    def out():
        items = iter(total.items())
        while part := list(islice(items, 1 << 14)):
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])
        total.clear()

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            doc = doc.as_py()
            prefix = None if doc is None else zlib.crc32(f"{doc}:".encode())
            for run, n in letter_runs(text.as_py() or "").items():
                if len(run) >= MIN_LENGTH and len(word := thinned(run, prefix)) >= MIN_LENGTH:
                    total[word] += n
                    if len(word) >= LONG:
                        letters += len(word)
            if len(total) >= HELD or letters >= HELD_LETTERS:
                yield from out()
                letters = 0
    yield from out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n, length)`` of the words that occur often enough."""
    words = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(_counted, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).withColumn("length", F.length("word"))


class Layout:
    """Where the filter of each length lies: its first block and its number of blocks."""

    def __init__(self, sizes: dict[int, int]):
        self.first, self.blocks, at = {}, {}, 0
        for length, words in sorted(sizes.items()):
            self.first[length], self.blocks[length] = at, -(-words * BITS_PER_WORD // BLOCK)
            at += self.blocks[length]
        self.total = at

    def bits(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash of a word of this length, and the number from which its bits are taken."""
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks[length])) >> np.uint64(32)
        rest = (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(10)
        return block + np.uint64(self.first[length]), rest


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``words`` and letters of words of one length, a matrix at a time."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        step = max(1, AT_ONCE // (len(LETTERS) * int(n)))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, np.frombuffer("".join(words[k] for k in part).encode("latin-1"), np.uint8).reshape(len(part), n)


def _filter_bits(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, masks = [], []
        for _, m in _by_length(batch.column(0).to_pylist()):
            block, rest = layout.bits((_CODE[m] * _powers(m.shape[1])).sum(1, dtype=np.uint64), m.shape[1])
            for k in range(BITS_SET):
                bit = (rest >> np.uint64(9 * k)) & np.uint64(BLOCK - 1)
                at.append(block * np.uint64(BLOCK // 64) + (bit >> np.uint64(6)))
                masks.append(np.uint64(1) << (bit & np.uint64(63)))
        if at:
            where, inverse = np.unique(np.concatenate(at), return_inverse=True)
            mask = np.zeros(len(where), np.uint64)
            np.bitwise_or.at(mask, inverse, np.concatenate(masks))
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int64)), pa.array(mask.view(np.int64))], names=["at", "bits"])


def _filter(vocab: DataFrame, layout: Layout, low: int, high: int) -> np.ndarray:
    """The filter's blocks from ``low`` to ``high``, of bounded size, as 64-bit words."""
    each = BLOCK // 64
    rows = vocab.select("word").mapInArrow(lambda b: _filter_bits(b, layout), "at long, bits long")
    table = rows.where(F.col("at").between(low * each, high * each - 1)).groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros((high - low) * each, np.uint64)
    out[table.column("at").to_numpy() - low * each] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _found(bits: np.ndarray, layout: Layout, low: int, h: np.ndarray, length: int) -> np.ndarray:
    """Which hashes may be of words of this length, among the blocks of ``bits``."""
    each = np.uint64(BLOCK // 64)
    block, rest = layout.bits(h, length)
    inside = (block >= low) & (block < low + len(bits) // int(each))
    left = np.flatnonzero(inside)
    for k in range(BITS_SET):
        bit = (rest[left] >> np.uint64(9 * k)) & np.uint64(BLOCK - 1)
        word = bits[((block[left] - np.uint64(low)) * each + (bit >> np.uint64(6))).astype(np.int64)]
        left = left[(word >> (bit & np.uint64(63))) & np.uint64(1) == 1]
    return left


def _edits(batches: Iterator[pa.RecordBatch], layout: Layout, bits: np.ndarray, low: int) -> Iterator[pa.RecordBatch]:
    """Edits of words that the filter knows: ``(word, n, edit)``."""
    high = low + len(bits) * 64 // BLOCK
    here = lambda n: n in layout.first and layout.first[n] < high and layout.first[n] + layout.blocks[n] > low
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        source, edits = [], []
        for rows, m in _by_length(words):
            n = m.shape[1]
            if not here(n) and not here(n - 1):
                continue
            powers = _powers(n)
            terms = _CODE[m] * powers
            h = terms.sum(1, dtype=np.uint64)
            if here(n - 1):  # a letter deleted; of a run of equal letters the first
                before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
                moved = _CODE[m[:, 1:]] * powers[: n - 1]
                after = np.concatenate([np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros((len(m), 1), np.uint64)], axis=1)
                first = np.concatenate([np.ones((len(m), 1), bool), m[:, 1:] != m[:, :-1]], axis=1)
                i, at = np.nonzero(first)
                for j in _found(bits, layout, low, (before + after)[i, at], n - 1):
                    w = words[rows[i[j]]]
                    source.append(rows[i[j]])
                    edits.append(w[: at[j]] + w[at[j] + 1 :])
            if here(n):
                step = max(1, AT_ONCE // (len(LETTERS) * len(m)))
                for a in range(0, n, step):  # letters replaced by larger ones, some positions at a time
                    i, at, c = np.nonzero(LETTERS > m[:, a : a + step, None])
                    at += a
                    changed = h[i] - terms[i, at] + _CODE[LETTERS[c]] * powers[at]
                    for j in _found(bits, layout, low, changed, n):
                        w = words[rows[i[j]]]
                        source.append(rows[i[j]])
                        edits.append(w[: at[j]] + chr(LETTERS[c[j]]) + w[at[j] + 1 :])
        for k in range(0, len(source), 1 << 13):
            part = source[k : k + (1 << 13)]
            yield pa.RecordBatch.from_arrays([pa.array([words[x] for x in part], pa.string()), pa.array([counts[x] for x in part], pa.int64()), pa.array(edits[k : k + (1 << 13)], pa.string())], names=["word", "n", "edit"])


def links(vocab: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(word, n, near, near_n)``: all pairs of words one edit apart, once, of a written vocabulary.

    The number of different lengths is collected; it is less than the root of twice the vocabulary's size.
    """
    spark = vocab.sparkSession
    layout = Layout({r["length"]: r["count"] for r in vocab.groupBy("length").count().collect()})
    step = max(1, max_bits // BLOCK)
    found = vocab.select("word", "n", F.lit("").alias("edit")).limit(0)
    for low in range(0, layout.total, step):
        bits = spark.sparkContext.broadcast(_filter(vocab, layout, low, min(low + step, layout.total)))
        found = found.unionByName(vocab.select("word", "n").mapInArrow(lambda b, low=low, bits=bits: _edits(b, layout, bits.value, low), "word string, n long, edit string"))
    exact = vocab.select(F.col("word").alias("edit"), F.col("n").alias("near_n"))
    return found.join(exact, "edit").select("word", "n", F.col("edit").alias("near"), "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for each word that has a form: forms followed to the last, twice as far each round.

    A form is at least twice as frequent as its word, so a chain has some 60 words at most.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, max_bits: int = MAX_BITS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of the documents.

    A word's form is its most frequent neighbour, of ties the first in code-point order, if that is at
    least twice as frequent; its root is the last form of the chain, or the word itself.  A null text has
    no words, and in documents with a null id no letter is left out; of repeated rows each counts.  Very
    long texts and words are taken whole.  An empty table gives an empty one; columns beside the two are
    not read, whatever their names.
    """
    vocab = written(vocabulary(docs, id_col, text_col, min_count), "vocabulary")
    once = written(links(vocab, max_bits), "links")
    both = once.unionByName(once.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = vocab.join(best, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.less") >= FORM_RATIO * F.col("n"), F.lit(False)))
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("best.near")).alias("form"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n")), "forms")
    out = rows.join(roots(rows.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
