"""Operator 9, quality rules: a ledger of rule bits, policies over it, and ablations.

``measure`` computes every measurement of a text once.  ``ledger`` turns the measurements
into one failure bit per rule and stores both.  A policy is a named, versioned bit mask:
``apply_policy`` keeps a row when no bit of the mask is set, so changing a policy reads the
ledger, never the texts.  ``ablation`` answers, from counts per bit pattern, how many rows
each rule rejects, rejects alone, and would give back if it were dropped.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals", "n_marks")
MEASURE_TYPE = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])

#: Rules in bit order: name and SQL condition (over the measurements) under which a text fails.
#: Written with integers only, so that every engine evaluates them alike.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 40 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("capitals", "n_letters >= 20 AND 100 * n_capitals > 60 * n_letters"),
    ("marks", "100 * n_marks > 40 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Policies by version: the rules each one enforces.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "prose-1": tuple(BIT),
}
BASE, DEFAULT = "base-1", "prose-1"

_SPACE = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))
_WINDOW = 8
_POWERS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(_WINDOW)], dtype=np.uint64)


def mask(policy: str) -> int:
    """The bits that a policy enforces."""
    return sum(BIT[r] for r in POLICIES[policy])


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of eight words that occurs twice or more in ``words``."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    code = (ids + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(29)
    code *= np.uint64(0x94D049BB133111EB)
    h = np.zeros(n, np.uint64)
    for j in range(_WINDOW):
        h += code[j : j + n] * _POWERS[j]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    # Equal hashes are only candidates: compare the windows themselves.
    view = np.lib.stride_tricks.sliding_window_view(ids, _WINDOW)
    left, right = order[:-1][same], order[1:][same]
    equal = (view[left] == view[right]).all(axis=1)
    if equal.all():
        hit = np.unique(np.concatenate([left, right]))
    else:
        _, inverse, counts = np.unique(view, axis=0, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(counts[inverse.ravel()] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + _WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure_bytes(b: bytes | None) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of ``MEASURES``."""
    if not b:
        return (0,) * len(MEASURES)
    words = b.split()
    bare = b.translate(None, _SPACE)
    lines = [x for x in b.split(b"\n") if x.strip()]
    return (
        len(words),
        len(bare.translate(None, _CONTINUATION)),
        len(b) - len(b.translate(None, b"#*$%&|<>")),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(bare) - len(bare.translate(None, _LETTERS)),
        len(bare) - len(bare.translate(None, _CAPITALS)),
        b.count(b"!") + b.count(b"?"),
    )


def measure(text: Column) -> Column:
    """A struct of ``MEASURES`` for a text column, computed by one pass over the whole text."""

    @F.arrow_udf(MEASURE_TYPE)
    def run(texts: pa.Array) -> pa.Array:
        rows = [measure_bytes(b) for b in texts.cast(pa.binary()).to_pylist()]
        columns = np.array(rows, dtype=np.int64).reshape(len(rows), len(MEASURES)).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(MEASURES))

    return run(text)


def failure_bits(measures: str = "") -> Column:
    """Bit ``i`` is set if rule ``i`` fails; ``measures`` may be a struct prefix such as ``m.``."""

    def bit(i: int, condition: str) -> str:
        condition = re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"{measures}\1", condition)
        return f"CASE WHEN {condition} THEN {1 << i}L ELSE 0L END"

    return F.expr(" | ".join(f"({bit(i, c)})" for i, (_, c) in enumerate(RULES)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, all measurements and ``failed_bits``.

    A null text has no words and measures zero throughout, as an empty one does; it fails
    ``few_words``.  Null ids and repeated rows pass through unchanged, other columns are not
    read (so their names cannot clash), and an empty table gives an empty ledger.  Texts are
    measured whole, one at a time, so memory follows the longest text and not the table.
    """
    m = docs.select(F.col(id_col), measure(F.col(text_col)).alias("_m"))
    return m.select(id_col, "_m.*").withColumn("failed_bits", failure_bits())


def apply_policy(rows: DataFrame, policy: str = DEFAULT, bits: str = "failed_bits") -> DataFrame:
    """The rows of a ledger with ``kept``: true where the policy finds no failed rule."""
    return rows.withColumn("kept", F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0)


def only_rule(policy: str = DEFAULT, bits: str = "failed_bits") -> Column:
    """The one rule of a policy that rejects a row, null where none or several do: what an ablation gives back."""
    left = F.col(bits).bitwiseAND(F.lit(mask(policy)))
    out = F.lit(None).cast("string")
    for r in POLICIES[policy]:
        out = F.when(left == BIT[r], r).otherwise(out)
    return out


def ablation(rows: DataFrame, policy: str = DEFAULT) -> DataFrame:
    """Per rule of a policy: rows it rejects, rows only it rejects, rows kept without it.

    Works on counts per bit pattern, of which there are at most ``2 ** len(RULES)``.
    """
    patterns = rows.groupBy((F.col("failed_bits").bitwiseAND(F.lit(mask(policy)))).alias("bits")).agg(F.count("*").alias("n"))
    per_rule = [
        F.struct(
            F.lit(r).alias("rule"),
            F.when(F.col("bits").bitwiseAND(F.lit(BIT[r])) != 0, F.col("n")).otherwise(0).alias("hit"),
            F.when(F.col("bits") == BIT[r], F.col("n")).otherwise(0).alias("alone"),
            F.when(F.col("bits").bitwiseAND(F.lit(mask(policy) & ~BIT[r])) == 0, F.col("n")).otherwise(0).alias("kept"),
        )
        for r in POLICIES[policy]
    ]
    return (
        patterns.select(F.explode(F.array(*per_rule)).alias("x"))
        .groupBy(F.col("x.rule").alias("rule"))
        .agg(F.sum("x.hit").alias("n_rejected"), F.sum("x.alone").alias("n_only_this"), F.sum("x.kept").alias("n_kept_without"))
    )


def keep_passing(docs: DataFrame, policy: str = DEFAULT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes the policy."""
    m = free_name(docs, "measures")
    bits = failure_bits(f"{m}.").bitwiseAND(F.lit(mask(policy)))
    return docs.withColumn(m, measure(F.col(text_col))).where(bits == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
