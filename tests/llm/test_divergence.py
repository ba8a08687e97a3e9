"""Operator 12 against plain counting: blocks that spill, shards, blocks of sources, and awkward rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from isospark.llm import divergence

COLUMNS = "lang string, source string, text string, term string, value long, shard int"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def plain(rows, min_docs=3, top=5):
    docs = [(x or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t or ""))) for x, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, n, groups = Counter(), defaultdict(Counter), set()
        for x, s, w in docs:
            if x == lang:
                groups.add(s)
                df.update(set(w))
                n[s].update(w)
        kept = [t for t in df if df[t] >= min_docs]
        total = {s: sum(n[s][t] for t in kept) for s in groups}
        share = lambda c, m: 1 + 10**9 * (c + 5) // (m + 5 * len(kept))
        p = {(s, t): share(n[s][t], total[s]) for s in groups for t in kept}
        every = sum(total.values())
        q = {t: share(sum(n[s][t] for s in groups), every) for t in kept}
        order = lambda r: (-r[1], r[0].encode())
        for s in groups:
            pairs = sorted(((o, sum(abs(p[s, t] - p[o, t]) for t in kept)) for o in groups if o != s), key=order)
            terms = sorted(((t, p[s, t] - q[t]) for t in kept if n[s][t] and p[s, t] > q[t]), key=order)[:top]
            out += [(lang, s, "pair", i, v, k + 1) for k, (i, v) in enumerate(pairs)] + [(lang, s, "term", i, v, k + 1) for k, (i, v) in enumerate(terms)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2) for r in rows], COLUMNS).repartition(4)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("block_postings", "shards", "side"), [(divergence.BLOCK_POSTINGS, divergence.SHARDS, divergence.SIDE), (20, 3, 3)])
def test_against_plain(spark, block_postings, shards, side):
    r = random.Random(5)
    vocab = ["Alpha", "beta", "BETA", "straße", "日本", "x1y", "É", "é", "o'neil", "a", "b", "c", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "hot", "hot", "hot", None, "ü", "z", "\U0001f600"]), " ".join(r.choices(vocab, k=r.randrange(30)))) for _ in range(300)]
    rows += [("xx", "alone", "rare words"), ("yy", "p", None), ("yy", "q", ""), ("yy", "r", "12 34 ..."), ("en", "s1", "long text " * 300_000), ("en", "s9", "only new terms here")]
    rows += [("en", "hot", "same row")] * 40
    df = frame(spark, rows)
    out = divergence.audit(df, min_docs=3, top=5, block_postings=block_postings, shards=shards, side=side)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got(out) == plain(rows)


def test_pieces_and_large_counts(spark):
    text = "ab " * 5 + "c" * divergence.PIECE * 2 + " ab ÀB"
    counts = Counter(t for p in divergence.pieces(text) for t in p)
    assert counts == {b"ab": 6, b"c" * divergence.PIECE * 2: 1, "Àb".encode(): 1}
    n = 10**13
    share = spark.sql(f"select {divergence._share('n', 'total', 'v')} as p from (select {n}L as n, {3 * n}L as total, 7L as v)").first().p
    assert share == 1 + 10**9 * (n + 5) // (3 * n + 35)


def test_runs_merged_by_a_heap():
    r = random.Random(2)
    want, docs_of, chunks = defaultdict(Counter), defaultdict(Counter), []
    for _ in range(6):
        block = {}
        for lang in ("de", "en"):
            docs, groups = Counter({b"": 2}), {}
            for source in r.sample("stuv", 3):
                groups[source] = Counter({f"t{r.randrange(40)}".encode(): r.randrange(1, 9) for _ in range(25)})
                docs.update({t: 1 for t in groups[source]})
                for t, n in groups[source].items():
                    want[lang, t][source] += n
            groups[source][b""] = 2
            want[lang, b""][source] += 2
            block[lang] = (docs, groups)
            docs_of[lang].update(docs)
        chunks += [c for b in divergence._run(block, 3, 4) for c in b.to_pylist()]
    assert max(len(c["ids"]) // 4 for c in chunks) < 4 + 3
    chunks.sort(key=lambda c: (c["shard"], c["lang"], c["first"]))
    out = list(divergence.merged_terms(iter(chunks), 5))
    assert len(out) == len({(lang, t) for lang, t, _, _ in out})
    assert {(lang, t): Counter(p) for lang, t, _, p in out} == {(lang, t): p for (lang, t), p in want.items() if t == b"" or docs_of[lang][t] >= 5}
    assert all(d == docs_of[lang][t] for lang, t, d, _ in out)


def test_empty(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
