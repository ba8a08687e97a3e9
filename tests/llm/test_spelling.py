"""Operator 11 against all pairs of a small vocabulary, with filters in several ranges, and awkward rows."""

import random
import re
import tracemalloc
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from isospark import session
from isospark.llm import queries, spelling

COLUMNS = "doc_id long, text string, word string, n long, edit string"


def plain(rows, min_count=3):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= min_count}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, size = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        size[w] = len(close)
        best = min(close, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n[w], size[w], n[forms[w]] if forms[w] else None))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "w", 1, "e") for d, t in rows], COLUMNS).repartition(4)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


LETTERS = "abcdeéüß×÷ÿÀ"


def words(r):
    base = ["".join(r.choices(LETTERS, k=r.randrange(5, 9))) for _ in range(40)]
    for _ in range(160):
        w = r.choice(base)
        i = r.randrange(len(w))
        base.append(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(LETTERS) + w[i:], w[:i] + r.choice(LETTERS) + w[i + 1 :], w[:i] + w[i] + w[i:]]))
    return base


@pytest.mark.parametrize("max_bits", [spelling.MAX_BITS, 512])
def test_against_all_pairs(spark, max_bits):
    r = random.Random(3)
    base = words(r)
    rows = [(d, r.choice([" ", "\n", "1", "_", "日", "\U0001f600"]).join(w.capitalize() if r.random() < 0.2 else w for w in r.choices(base, k=40))) for d in range(60)]
    rows += [(None, " ".join(base[:60])), (None, None), (1, ""), (1, None), (2, "..."), (7, "hotword " * 20_000), (8, "hotwort hotwort hotwort"), (9, "x" * 3000), (9, "x" * 3000), (9, "x" * 2999 + "y"), (10, "x" * 3000 + " " + ("x" * 2999 + "y ") * 2)]
    rows += [(5, "zebra zebras")] * 5
    want = plain(rows)
    assert sum(f is not None for _, f, *_ in want) > 20
    assert got(spelling.variants(frame(spark, rows), max_bits=max_bits)) == want


def test_chains_and_ties(spark):
    counts = {"aaaaa": 64, "aaaab": 32, "aaabb": 16, "aabbb": 8, "abbbb": 4, "hello": 3, "helloa": 6, "hellob": 6, "jello": 5}
    rows = [(None, f"{w} " * n) for w, n in counts.items()]
    out = {r[0]: r for r in got(spelling.variants(frame(spark, rows)))}
    assert out["abbbb"][1:3] == ("aabbb", "aaaaa") and out["aaaaa"][1:3] == (None, "aaaaa")
    assert out["hello"] == ("hello", "helloa", "helloa", 3, 3, 6)
    assert list(out.values()) == plain(rows)


def test_pieces_keep_words_whole():
    text = "ab " + "c" * (spelling.PIECE + 5) + " DÀ " + "e" * 9
    assert spelling.letter_runs(text) == {b"ab": 1, b"c" * (spelling.PIECE + 5): 1, b"d\xc0": 1, b"e" * 9: 1}


def test_filter_lets_little_through(spark):
    r = random.Random(1)
    vocab = sorted({"".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(5000)})
    v = spark.createDataFrame([(w, 3, 9) for w in vocab], "word string, n long, length int")
    layout = spelling.Layout({9: len(vocab)})
    bits = spelling._filter(v, layout, 0, layout.total)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(vocab), pa.array([3] * len(vocab))], names=["word", "n"])
    edits = sum(b.num_rows for b in spelling._edits(iter([batch]), layout, bits, 0))
    assert edits < 0.01 * len(vocab) * 9 * 77


def test_batches_of_long_texts_are_bounded(spark, monkeypatch, tmp_path):
    """The query's batches to Python have a bounded number of bytes, however long the texts; the caller's session stays as it is."""
    before = spark.conf.getAll
    rows = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', repeat('letters ', 1000), id % 7, 'lettres letter') AS text")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    variants = spelling.variants
    monkeypatch.setattr(spelling, "variants", lambda docs: seen.append(docs) or variants(docs))
    out = got(queries.op11_spelling_variants(spark, str(tmp_path)))
    assert out == plain([(r["doc_id"], r["text"]) for r in rows.collect()])

    def sizes_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    sizes = seen[0].select("doc_id", "text").mapInArrow(sizes_of, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in sizes) == 3000
    assert max(r["bytes"] for r in sizes) < 1.1 * session.BATCH_BYTES + 10_000
    assert seen[0].sparkSession.conf.get("spark.sql.session.timeZone") == "UTC" and spark.conf.getAll == before


def test_long_words_are_passed_on():
    """Long words held for their counts are bounded in letters, not only in number."""
    word = lambda i: "x" * 3000 + "".join("abcdefghij"[int(c)] for c in f"{i:06}")
    texts = (" ".join(word(20 * k + i) for i in range(20)) for k in range(800))
    batches = (pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([t])], names=["i", "t"]) for t in texts)
    ends: Counter = Counter()
    tracemalloc.start()
    for b in spelling._counted(batches):
        ends.update({w.as_py()[-6:]: n.as_py() for w, n in zip(b.column(0), b.column(1), strict=True)})
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ends) == 16_000 and set(ends.values()) == {1}
    assert top < 4 * spelling.HELD_LETTERS


def test_empty(spark):
    assert spelling.variants(frame(spark, [])).collect() == []
