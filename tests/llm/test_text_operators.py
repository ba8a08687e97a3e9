"""Operators 3, 7, 8 and 9 against plain versions, and on awkward rows."""

import hashlib
import random
import re

import pytest
import xxhash

from isospark.llm import decontaminate, quality_rules, queries, simhash, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, fp long, bucket string"


def awkward(spark, texts, ids=None):
    """Rows whose further columns have names that the operators use inside."""
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", 7, "b") for i, t in enumerate(texts)], DOCS)


AWKWARD = [None, "", "   \n\t", "one", "a b c", "A B C", "x " * 50_000, "é ü ñ 日本 語", "same words here", "same words here", "s3 a\x1cb <|endoftext|> ÀB"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# 3


def plain_simhash(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(points, linked):
    parent = {p: p for p in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    points = sorted(points)
    for i, a in enumerate(points):
        for b in points[:i]:
            if linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in points}


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, SF).collect()}
    fp = {d.doc_id: plain_simhash(d.text) for d in docs}
    comp = plain_components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert got == {i: (f"{fp[i]:016x}", comp[i]) for i in fp}


@pytest.mark.parametrize("subtrie", [1024, 4])
def test_trie_links_in_a_dense_ball(spark, subtrie):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    points = {base} | {rng.getrandbits(64) for _ in range(40)}
    for _ in range(160):
        x = rng.choice(sorted(points))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(0, 64, 1 if subtrie > 4 else 7)
        points.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    links = simhash.trie_links(spark.createDataFrame([(p, p) for p in signed], "node long, fp long"), 2, subtrie=subtrie).collect()
    want = plain_components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    parent = {p: p for p in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {p: root(p) for p in signed} == want


def test_simhash_awkward(spark):
    rows = simhash.near_duplicates(awkward(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r.component_id for r in rows}
    assert by[0] == by[1] == by[2] == 0 and by[4] == by[5] == 4 and by[9] == 8
    nulls = simhash.near_duplicates(awkward(spark, ["a b c", "a b c", "d e f"], [None, 3, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in nulls) == [(-1, -1), (-1, 3), (3, 3)]
    assert simhash.near_duplicates(awkward(spark, [])).count() == 0


def test_keep_one_each(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near = base[:200] + ["changed"] + base[201:]
    far = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(x) for x in (base, near, far, base)]
    out = simhash.keep_one_each(awkward(spark, texts))
    assert out.columns == ["doc_id", "text", "lang", "fp", "bucket"]
    assert sorted(r.doc_id for r in out.collect()) == [0, 2]
    assert simhash.keep_one_each(awkward(spark, texts[:1] * 3, [4, 4, None])).count() == 2
    assert simhash.keep_one_each(awkward(spark, [])).count() == 0


# 7


def plain_contamination(docs, items):
    def folded(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for i, t in docs:
        w, hit, found = folded(t), set(), set()
        for item, s in items:
            v = folded(s)
            for g in [v[k : k + 10] for k in range(max(1, len(v) - 9))] if v else []:
                for k in range(len(w) - len(g) + 1):
                    if w[k : k + len(g)] == g:
                        hit |= set(range(k, k + len(g)))
                        found.add(item)
        sha = hashlib.sha256(",".join(sorted(map(str, found - {None}))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found - {None}), sha, bool(hit)))
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")


@pytest.mark.parametrize("shard,block", [((1_000_000, 1 << 24), 1 << 24), ((5, 40), 30)])
def test_contamination(spark, shard, block):
    rng = random.Random(3)
    vocab = ["a", "B", "cé", "d1", "e"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 13)))) for k in range(12)] + [(20, None), (21, "--"), (None, "zz z"), (2, "q q")]
    texts = ["; ".join(rng.choice(vocab + ["x"]) for _ in range(rng.randint(0, 60))) for _ in range(30)]
    texts += [items[0][1] * 2, "zz z", None, "", "q Q", "A-b"] + [items[5][1]] * 3
    got = decontaminate.contamination(awkward(spark, texts), bench(spark, items), shard=shard, block_bytes=block).collect()
    assert sorted(map(tuple, got), key=str) == plain_contamination(list(enumerate(texts)), items)


def test_contamination_empty_tables(spark):
    assert decontaminate.contamination(awkward(spark, []), bench(spark, [(1, "a b")])).count() == 0
    rows = decontaminate.contamination(awkward(spark, ["a b"]), bench(spark, [])).collect()
    assert [(r.n_words, r.contaminated) for r in rows] == [(2, False)]


def test_remove_spans_over_several_blocks(spark):
    """A cut of one block's phrase joins a phrase of a block before it."""
    a, b = [f"a{i}" for i in range(10)], [f"b{i}" for i in range(10)]
    texts = [" ".join(["x", *a[:4], *b, *a[4:], "y"]), " ".join([*b[:5], *a, *b[5:]]), "no phrase", None]
    docs, items = awkward(spark, texts), bench(spark, [(1, " ".join(a)), (2, " ".join(b))]).coalesce(1)
    for size in (1, 1 << 20):
        got = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items, block_bytes=size).collect()}
        assert [(got[i] or "").split() for i in range(4)] == [["x", "y"], [], ["no", "phrase"], []] and got[3] is None


def test_remove_spans_leaves_no_phrase(spark):
    phrase = [f"p{i}" for i in range(12)]
    texts = ["Before it. " + ", ".join(phrase).upper() + "! After.", " ".join(phrase[:6] + phrase + phrase[6:]), None, "untouched  text"]
    docs, items = awkward(spark, texts), bench(spark, [(1, " ".join(phrase))])
    out = decontaminate.remove_spans(docs, items)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns
    assert got[0] == "Before it. ! After." and got[2] is None and got[3] == texts[3]
    assert not any(r.contaminated for r in decontaminate.contamination(out, items).collect())


# 8


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = AWKWARD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["it's we'll 12 3x!?", "é ́x"]
    ids = [None if i == 4 else 1 if i == 5 else i for i in range(len(texts))]
    got = token_counts.token_counts(awkward(spark, texts, ids), path).collect()
    want = [(i, len((s or "").encode()), len(t.encode(s or "", add_special_tokens=False).ids)) for i, s in zip(ids, texts)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(awkward(spark, []), path).count() == 0


# 9


def plain_repeats(w):
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)})


def test_repeated_words():
    rng = random.Random(4)
    for _ in range(300):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        assert quality_rules.repeated_words([x.encode() for x in w]) == plain_repeats(w)


def test_ledger_awkward(spark):
    rows = {r.doc_id: r for r in quality_rules.apply_policy(quality_rules.ledger(awkward(spark, AWKWARD))).collect()}
    assert all(rows[i].n_words == 0 and not rows[i].kept for i in range(3))
    assert rows[6].n_words == 50_000 == rows[6].n_repeat_words
    assert rows[7].word_chars == 7 and rows[7].n_words == 4
    assert quality_rules.ledger(awkward(spark, [])).count() == 0
    docs = awkward(spark, AWKWARD + ["good words make a plain line of text that says one thing after another and then some more words follow here"], [*range(len(AWKWARD)), None])
    kept = quality_rules.keep_passing(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [None]


def test_ablation(spark):
    bit = quality_rules.BIT
    rows = spark.createDataFrame([(0,), (bit["symbols"],), (bit["symbols"] | bit["marks"],), (bit["few_words"],)], "failed_bits long")
    got = {r.rule: (r.n_rejected, r.n_only_this, r.n_kept_without) for r in quality_rules.ablation(rows).collect()}
    assert got["symbols"] == (2, 1, 2) and got["marks"] == (1, 0, 1) and got["few_words"] == (1, 1, 2)
    assert quality_rules.ablation(rows.limit(0)).count() == 0
