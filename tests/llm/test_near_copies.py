"""Near copies of the pipeline against brute-force Jaccard similarities."""

import random

import pytest

from isospark.llm import near_copies, simhash


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edits(rng, word):
    """A text and one copy of it for each kind of edit, similar by 0.8 to 0.95."""
    n = rng.randint(100, 600)
    w = [word() for _ in range(n)]
    k = max(1, int(n * rng.uniform(0.06, 0.18)))
    some = list(w)
    for i in rng.sample(range(n), max(1, n // 60)):
        some[i] = word()
    return [" ".join(x) for x in (w, w + [word() for _ in range(k)], w[: n - k], some)]


@pytest.mark.parametrize("rounds", [near_copies.ROUNDS, 0])
def test_groups_are_those_of_brute_force(spark, monkeypatch, rounds):
    rng = random.Random(4)
    texts = [t for _ in range(60) for t in edits(rng, lambda: f"w{rng.randrange(3000)}")]
    # A chain of copies, the ends of which are far from each other, and a group around one text.
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[i : i + 200]) for i in range(0, 200, 10)]
    for _ in range(40):
        x = [f"h{i}" for i in range(200)]
        for i in rng.sample(range(200), 3):
            x[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(x))
    rng.shuffle(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    monkeypatch.setattr(near_copies.similar_links, "__defaults__", (near_copies.SHINGLE, rounds))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert dict(simhash.similar_groups(docs).collect()) == {i: root(i) for i in range(len(texts))}


def test_threshold_is_exact(spark):
    a = " ".join(f"a{i}" for i in range(84))  # 80 shingles
    for more, alike in ((20, True), (21, False)):
        b = a + "".join(f" b{i}" for i in range(more))
        assert (jaccard(a, b) >= 0.8) == alike
        got = dict(simhash.similar_groups(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect())
        assert got == {1: 1, 2: 1 if alike else 2}


def test_equal_words_in_other_orders_are_not_paired_off(spark):
    # Texts of one and the same word set: all in one group of the former walk, which paired off its rows.
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.sample(words, 40))) for i in range(4000)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    table = near_copies.shingle_table(docs, "doc_id", "text")
    keys = table.selectExpr("explode(bands) AS key").groupBy("key").count()
    assert keys.selectExpr("coalesce(sum(count * (count - 1)), 0)").first()[0] < 4000
    assert near_copies.similar_links(docs, table, "doc_id", "text").count() == 0


def test_awkward_rows(spark):
    long = " ".join(f"w{i % 9000}x{i}" for i in range(200_000))
    same = " ".join(f"s{i}" for i in range(30))
    rows = [(5, same, "x"), (3, same, "y"), (3, same, "y"), (3, "another text of seven words it is", "z"), (None, same, "n"), (None, None, "n"), (7, None, "e"), (8, "", "e"), (9, long, "l"), (2, long + " more", "l"), (4, "short", "s"), (6, "SHORT", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect()), key=repr)
    want = [(5, 3), (3, 3), (3, 3), (3, 3), (None, 3), (None, 7), (7, 7), (8, 7), (9, 2), (2, 2), (4, 4), (6, 4)]
    assert got == sorted(want, key=repr)
    kept = [tuple(r) for r in simhash.keep_one_each(docs).collect()]
    assert sorted(r[0] for r in kept if r[0] is not None) == [2, 3, 4, 7] and sum(r[0] is None for r in kept) == 2
    assert simhash.keep_one_each(docs).columns == docs.columns
    assert simhash.keep_one_each(docs.limit(0)).count() == 0


def test_recall_by_kind_of_edit(spark):
    """Pairs at 0.8 or more that end in one group, of all such pairs, by kind of edit."""
    rng = random.Random(21)
    texts = [t for k in range(250) for t in edits(rng, lambda: f"w{rng.randrange(3000)}")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    group = dict(simhash.similar_groups(docs).collect())
    for kind in (1, 2, 3):
        pairs = [i for i in range(0, len(texts), 4) if jaccard(texts[i], texts[i + kind]) >= 0.8]
        assert len(pairs) > 50 and sum(group[i] == group[i + kind] for i in pairs) >= 0.999 * len(pairs)


def test_one_of_what_the_trie_links_is_kept(spark):
    """Texts whose fingerprints link go together in the pipeline's stage, though their sets are not similar by 0.8."""
    body = " ".join(f"w{i % 7}" for i in range(3000))  # few different shingles, repeated: they alone decide the fingerprint
    a, b = body, body + " " + " ".join(f"z{i}" for i in range(40))
    assert (simhash.simhash(a.encode()) ^ simhash.simhash(b.encode())).bit_count() <= 2 and jaccard(a, b) < 0.8
    docs = spark.createDataFrame([(1, a), (2, b), (3, " ".join(f"q{i}" for i in range(200)))], "doc_id long, text string")
    assert len(dict(simhash.similar_groups(docs).collect()).keys() & {1, 2, 3}) == 3 and dict(simhash.similar_groups(docs).collect())[2] == 2
    assert sorted(r.doc_id for r in simhash.keep_one_each(docs).collect()) == [1, 3]
