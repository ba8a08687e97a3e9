"""Operator 13 against grouping by text, with filters of several shards, hot groups and awkward rows."""

import collections
import hashlib
import re

import pytest

from isospark.llm import exact_dedup, queries

SF = "/root/testdata/sf0.001"
NULL = -(10**12)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(NULL if i is None else i)
    return {t: (None if max(g) == NULL else max(g), len(g)) for t, g in groups.items()}


def check(rows, got):
    want = plain(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.text_sha256) for r in got) == collections.Counter((i, hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)
    assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in got)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(by_sha) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(rows, queries.op13_exact_dedup(spark, SF).collect())


AWKWARD = [(1, None), (2, ""), (3, " "), (None, "null id"), (None, "Null ID"), (7, "tie"), (7, "TIE"), (7, "tie"), (8, "é"), (9, "É"), (10, "x" * 3_000_000), (11, "X" * 3_000_000), (12, "ÀB"), (13, "Àb"), (-5, "below"), (-6, "Below"), (14, "a\0b")]


@pytest.mark.parametrize("max_bits", [exact_dedup.MAX_BITS, 4096])
def test_awkward_rows_and_shards(spark, max_bits):
    rows = AWKWARD + [(100 + i, f"text {i % 700}") for i in range(1500)] + [(5000 + i, "hot") for i in range(800)]
    docs = spark.createDataFrame([(i, t, "row", i) for i, t in rows], "doc_id long, text string, digest string, words long").repartition(5)
    check(rows, exact_dedup.duplicates(docs, max_bits=max_bits).collect())
    kept = exact_dedup.keep_one(docs, max_bits=max_bits)
    assert kept.columns == docs.columns
    got = kept.collect()
    want = plain(rows)
    assert sorted(low(r.text) for r in got) == sorted(want)
    assert all(r.doc_id == want[low(r.text)][0] and r.digest == "row" and r.words == r.doc_id for r in got)


def test_empty_and_filter(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.duplicates(docs).collect() == [] and exact_dedup.keep_one(docs).collect() == []
    docs = spark.range(20_000).selectExpr("id as doc_id", "case when id < 400 then concat('twice ', id % 200) else concat('once ', id) end as text")
    d = docs.select("doc_id", exact_dedup.digest(docs.text).alias("digest"))
    blocks = exact_dedup._blocks(20_000, exact_dedup.BITS_PER_ROW)
    marked = exact_dedup.flagged(d, exact_dedup.repeated_bits(d, blocks), blocks)
    assert marked.where("doc_id < 400 and not maybe").count() == 0, "no repeated row is passed by"
    assert marked.where("doc_id >= 400 and maybe").count() < 0.1 * 20_000, "most others are"


def test_no_python_worker(spark):
    plan = queries.op13_exact_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
