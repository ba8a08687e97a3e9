"""Exact dedup: a Bloom filter of what occurs twice decides which rows meet, the others stay where they are.

First pass: every row's digest sets bits of a blocked Bloom filter, and only bits that two rows or more
set are kept.  Second pass: a row whose bits are all kept may be repeated; such rows alone are shuffled
and grouped by their digest, all others are their own group.  Functions only: no Python worker runs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, written

#: Bits of a row in the filter, and bits it sets: some 5 % of the rows that are alone pass for repeated ones.
BITS_PER_ROW = 8
BITS_SET = 2
#: Bits of a block; a row's bits lie in one, so that one lookup reads them.
BLOCK = 4096
#: Bits of the largest filter that is broadcast, 128 MB; more rows are taken in shards of the digest, one after the other.
MAX_BITS = 1 << 30
#: Rows of a task that deals digests to shards.
DEAL_ROWS = 1 << 24
#: Groups of at least a share of 1 / HOT of all rows are broadcast to their rows; there are HOT at most.
HOT = 4096


def normalised(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes; rows with equal ones count as equal."""
    return F.unhex(F.sha2(normalised(text), 256))


def _blocks(rows: int, bits_per_row: int) -> int:
    return max(1, -(-rows * bits_per_row // BLOCK))


def _probes(blocks: int) -> dict[str, Column]:
    """The block of a digest, and the offsets of its bits in it."""
    h = F.xxhash64("digest")
    bit = lambda i: F.shiftrightunsigned(h, 12 * i).bitwiseAND(F.lit(BLOCK - 1)).cast("int")
    return {"block": F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(blocks)), **{f"bit{i}": bit(i) for i in range(BITS_SET)}}


def repeated_bits(digests: DataFrame, blocks: int) -> DataFrame:
    """First pass: ``(block, words)``, the bits that at least two rows set, in blocks that have any.

    Rows are counted by bit, summed in the map tasks first, so equal rows send one number a task.
    """
    p = digests.select(*[c.alias(n) for n, c in _probes(blocks).items()])
    bits = p.select("block", F.explode(F.array(*[f"bit{i}" for i in range(BITS_SET)])).alias("bit"))
    twice = bits.groupBy("block", "bit").agg(F.count("*").alias("n")).where("n > 1")
    word = F.shiftright("bit", 6).alias("word")
    words = twice.groupBy("block", word).agg(F.expr("bit_or(shiftleft(1L, bit & 63))").alias("bits"))
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return held.select("block", dense.alias("words"))


def flagged(digests: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """Second pass: ``maybe`` says whether all bits of a row are kept; the filter is broadcast, no row moves."""
    probes = _probes(blocks)
    at = lambda b: F.getbit(F.get("words", F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1
    hit = F.col("words").isNotNull()
    for i in range(BITS_SET):
        hit = hit & at(F.col(f"bit{i}"))
    joined = digests.withColumns(probes).join(F.broadcast(bits), "block", "left")
    return joined.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("words", *probes)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(2)), F.lit(shards)).cast("int")


def _groups(rows: DataFrame, n_all: int) -> DataFrame:
    """Keeper and size of each row of ``(digest, doc_id, row)``; rows of a large group are not shuffled by it."""
    g = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    least = max(2, -(-n_all // HOT))
    large = g.where(F.col("group_size") >= least)
    small = g.where(F.col("group_size") < least)
    met = rows.join(F.broadcast(large), "digest", "left")
    mine = ["digest", "doc_id", "row"]
    found = met.where("group_size is not null")
    rest = met.where("group_size is null").select(*mine).join(small, "digest")
    return found.unionByName(rest).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.row") == F.col("row")).alias("kept"), "digest")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays; of rows that share text and id one stays, whichever,
    and a null id is smaller than all.  A null text counts as empty, and empty texts are equal.  Texts are
    read whole and once; later passes read 32 bytes a row.  An empty table gives an empty one, and other
    columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "digests")
    docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")).write.parquet(path)
    digests = spark.read.parquet(path)
    n = digests.count()
    shards = max(1, -(-n * bits_per_row // max_bits))
    if shards > 1:  # each task deals its rows to the folders of the shards
        dealt = scratch_path(spark, "digest-shards")
        digests.coalesce(max(1, n // DEAL_ROWS)).withColumn("shard", _shard(shards)).write.partitionBy("shard").parquet(dealt)
        digests = spark.read.parquet(dealt)
    blocks = _blocks(-(-n // shards), bits_per_row)
    out = scratch_path(spark, "duplicates")
    for s in range(shards):
        part = digests.where(F.col("shard") == s).drop("shard") if shards > 1 else digests
        marked = written(flagged(part, repeated_bits(part, blocks), blocks), "marked")
        alone = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
        alone.unionByName(_groups(marked.where("maybe").drop("maybe"), n)).write.mode("append").parquet(out)
    found = spark.read.parquet(out)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; see ``duplicates`` for which.

    Rows that the filter lets through are never shuffled; of the others a task sends on one per text.  More
    rows than one filter holds get several, and a row is looked up in that of its shard.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "digests")
    docs.select(digest(F.col(text_col)).alias("digest")).write.parquet(path)
    digests = spark.read.parquet(path)
    n = digests.count()
    shards = max(1, -(-n * bits_per_row // max_bits))
    blocks = _blocks(-(-n // shards), bits_per_row)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest(F.col(text_col)).alias("digest"))
    kept = []
    for s in range(shards):
        mine = lambda d: d.where(_shard(shards) == s)
        bits = scratch_path(spark, "filter")
        repeated_bits(mine(digests), blocks).write.parquet(bits)
        marked = flagged(mine(rows), spark.read.parquet(bits), blocks)
        key = F.col("row").getField(id_col)
        best = marked.where("maybe").groupBy("digest").agg(F.coalesce(F.max_by("row", key), F.first("row")).alias("row"))
        kept += [marked.where("not maybe").select("row"), best.select("row")]
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.select("row.*")
