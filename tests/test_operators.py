"""Sequential operators against brute force, and awkward inputs."""

import itertools
import math
import random
import tempfile

import pytest

from isospark.functions import scalar as S
from isospark.model import Params
from isospark.operators import cluster, coverage, ends, introns, match, peaks, rangejoin, stats, summaries, transcripts
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def checkpoints(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="isospark-"))


def test_interval_matching_is_maximal(spark):
    rng = random.Random(0)
    points, intervals, want = [], [], {}
    for k in range(25):
        p = sorted({rng.randint(1, 40) for _ in range(rng.randint(0, 7))})
        i = [(a, a + rng.randint(0, 12)) for a in (rng.randint(1, 40) for _ in range(rng.randint(0, 7)))]
        points += [(f"c{k}", x) for x in p]
        intervals += [(f"c{k}", a, b) for a, b in i]
        owner = {}

        def seek(x, seen):
            for j, (a, b) in enumerate(i):
                if a <= x <= b and j not in seen:
                    seen.add(j)
                    if j not in owner or seek(owner[j], seen):
                        owner[j] = x
                        return True
            return False

        n = sum(seek(x, set()) for x in p)
        if p or i:
            want[f"c{k}"] = (n, len(p) - n, len(i) - n)
    got = match.interval_matches(spark.createDataFrame(points, "contig string, pos long"), spark.createDataFrame(intervals, "contig string, lo long, hi long"), ["contig"]).collect()
    assert {r.contig: (r.tp, r.fp, r.fn) for r in got} == want


@pytest.mark.parametrize("stretch", [40, 100, 1 << 16])
def test_interval_matches_of_a_run_without_gaps(spark, monkeypatch, stretch):
    """Dense intervals over many stretches, some longer than a stretch, against the sweep in order."""
    monkeypatch.setattr(match, "STRETCH", stretch)
    rng = random.Random(stretch)
    points = [("c", rng.randrange(0, 1000)) for _ in range(500)] + [(None, 5), ("c", None), ("p", 3)]
    intervals = [("c", s, s + rng.choice([0, 3, 30, 30, 250])) for s in (rng.randrange(0, 1000) for _ in range(450))] + [(None, 1, 9), (None, 1, 9), ("i", 1, 2)]
    want = {"p": (0, 1, 0), "i": (0, 0, 1)}
    for k in ("c", None):
        left, n = sorted((e, s) for c, s, e in intervals if c == k), 0
        ps = sorted(p for c, p in points if c == k and p is not None)
        for p in ps:
            hit = next((x for x in left if x[1] <= p <= x[0]), None)
            if hit:
                left.remove(hit)
                n += 1
        want[k] = (n, len(ps) + (k == "c") - n, len(left))
    got = match.interval_matches(spark.createDataFrame(points, "contig string, pos long"), spark.createDataFrame(intervals, "contig string, lo long, hi long"), ["contig"]).collect()
    assert {r.contig: (r.tp, r.fp, r.fn) for r in got} == want


@pytest.mark.parametrize(("segment", "window"), [(40, 7), (64, 30), (1 << 16, 10), (10, 0)])
def test_leaders_of_runs_without_gaps(spark, segment, window):
    """Dense rows over many segments, under keys that are arrays and nulls, against the fold in order."""
    rng = random.Random(segment)
    rows = []
    for k in (["a"], ["a", None], None):
        for _ in range(700):
            s = rng.randrange(1, 900) if k != ["a"] else rng.randrange(1, 12_000)
            rows.append((k, len(rows), s, s + rng.choice([50, 55, 60, 61, 300])))
    want = {}
    for k in ("['a']", "['a', None]", "None"):
        head = None
        for _, i, s, e in sorted((r for r in rows if str(r[0]) == k), key=lambda r: (r[2], r[3])):
            if head is None or abs(s - head[0]) > window or abs(e - head[1]) > window:
                head = (s, e)
            want[i] = f"{head[0]}.{head[1]}"
    df = spark.createDataFrame(rows, "k array<string>, id int, a int, b int").repartition(3)
    got = cluster.leader_clusters(df, ["k"], "a", "b", window, segment=segment)
    assert got.columns == ["k", "id", "a", "b", "leader"]
    assert {r.id: r.leader for r in got.collect()} == want
    assert cluster.leader_clusters(df.limit(0), ["k"], "a", "b", window).collect() == []


def test_points_in_intervals_of_any_length(spark):
    rng = random.Random(4)
    big = 400_000_000
    points = [("c", rng.choice([rng.randrange(1, 100), rng.randrange(1, big)])) for _ in range(400)] + [("c", 50)] * 30 + [("d", 7)]
    intervals = [("c", a, a + rng.choice([-1, 0, 3, 1000, 100_000_000])) for a in (rng.choice([rng.randrange(1, 100), rng.randrange(1, big)]) for _ in range(300))] + [("e", 1, 9), ("d", 1, 9), ("d", 8, 9), ("d", 1, 9)]
    p = spark.createDataFrame(points, "k string, at int")
    i = spark.createDataFrame(intervals, "k string, lo int, hi int")
    got = rangejoin.points_in(i, p, ["k"], F.col("lo"), F.col("hi"), "at")
    key = lambda r: (r[0], r[1], r[2], r[3])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((k, a, b, sum(q == k and a <= x <= b for q, x in points)) for k, a, b in intervals), key=key)
    active = rangejoin.active_intervals(i, p, ["k"], "lo", "hi", "at", 0).count()
    assert active + rangejoin.active_intervals(i, p, ["k"], "lo", "hi", "at", 0, active=False).count() == len(intervals)
    assert "Generate" in got._jdf.queryExecution().optimizedPlan().toString()  # two marks an interval, whatever its length


def test_leader_and_seed_clusters(spark):
    rng = random.Random(1)
    rows = [(f"k{i % 3}", i, s, s + rng.randint(5, 40)) for i, s in enumerate(rng.randint(1, 900) for _ in range(250))]
    df = spark.createDataFrame(rows, "k string, id long, a long, b long")
    got = {r.id: (r.k, r.leader) for r in cluster.leader_clusters(df, ["k"], "a", "b", 10).collect()}
    seeds = {r.id: (r.k, r.seed) for r in cluster.seed_clusters(df, ["k"], lambda x, y: abs(x.a - y.a) <= 10 and abs(x.b - y.b) <= 10, ["a", "id"], "a", 10).collect()}
    want, want_seed = {}, {}
    for k in ("k0", "k1", "k2"):
        head, n = None, 0
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3])):
            if head is None or abs(r[2] - head[2]) > 10 or abs(r[3] - head[3]) > 10:
                head, n = r, n + 1
            want[r[1]] = (k, n)
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(mine):
            if r[1] not in want_seed:
                for t in mine:
                    if t[1] not in want_seed and (t is r or (abs(t[2] - r[2]) <= 10 and abs(t[3] - r[3]) <= 10)):
                        want_seed[t[1]] = (k, r[1])

    def groups(x):
        out = {}
        for i, g in x.items():
            out.setdefault(g, set()).add(i)
        return sorted(map(sorted, out.values()))

    assert groups(got) == groups(want)
    assert groups(seeds) == groups(want_seed)


def test_greedy_pairs_and_components(spark):
    rng = random.Random(2)
    edges = sorted({(rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(90)})
    rows = [("k", a, b, rng.randint(0, 5)) for a, b in edges]
    df = spark.createDataFrame(rows, "k string, a long, b long, d int")
    got = {(r.a, r.b) for r in cluster.greedy_pairs(df, ["k"], "a", "b", ["d", "a", "b"]).collect()}
    used, want = set(), set()
    for _, a, b, d in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    assert got == want
    for rounds in (0, 1):
        assert {(r.a, r.b) for r in cluster.greedy_pairs(df, ["k"], "a", "b", ["d", "a", "b"], rounds).collect()} == want
    # A chain of ever worse candidates: every second one is taken.
    chain = spark.createDataFrame([("k", i // 2 + i % 2, 1000 + i // 2, i) for i in range(60)], "k string, a long, b long, d int")
    assert sorted(r.d for r in cluster.greedy_pairs(chain, ["k"], "a", "b", ["d"], 3).collect()) == list(range(0, 60, 2))
    # A long one is known in a few rounds, as is one that begins in the middle, or meets another one.
    n = 100_000
    long = spark.range(n).selectExpr("'k' as k", "id div 2 + id % 2 as a", "id div 2 as b", "id as d")
    taken = cluster.greedy_pairs(long, ["k"], "a", "b", ["d"])
    assert taken.agg({"d": "count"}).first()[0] == n // 2 and taken.where("d % 2 <> 0").isEmpty()
    valley = [("k", i // 2 + i % 2, i // 2, abs(i - 41) * 2 + (i > 41)) for i in range(120)] + [(None, 1, 1, 0), (None, 1, 2, 1), (None, 2, 2, 2)]
    hill = [("h", i // 2 + i % 2, i // 2, 100 - abs(i - 61) * 2 + (i > 61)) for i in range(101)]
    for rows in (valley + hill, [("k", *e, rng.randint(0, 9)) for e in sorted({(i + rng.randint(0, 3), i + rng.randint(0, 3)) for i in range(200)})]):
        used, want = set(), set()
        for k, a, b, d in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
            if not {(k, "a", a), (k, "b", b)} & used:
                want.add((k, a, b))
                used |= {(k, "a", a), (k, "b", b)}
        for rounds in (0, 2):
            pairs = cluster.greedy_pairs(spark.createDataFrame(rows, "k string, a long, b long, d int"), ["k"], "a", "b", ["d", "a", "b"], rounds)
            assert {(r.k, r.a, r.b) for r in pairs.collect()} == want and pairs.columns == ["k", "a", "b", "d"]
    comp = {r.node: r.component for r in cluster.components(df).collect()}
    assert set(comp) == {x for e in edges for x in e} and all(comp[a] == comp[b] <= a for a, b in edges)
    assert cluster.greedy_pairs(df.limit(0), ["k"], "a", "b", ["d"]).count() == 0
    assert cluster.components(df.limit(0)).count() == 0


def test_peaks_ties(spark):
    counts = [("c", 10, 5), ("c", 20, 5), ("c", 31, 5), ("c", 31 + 11, 4), ("c", 60, 1)]
    got = {r.pos: (r.is_greatest, r.is_picked) for r in peaks.call_peaks(spark.createDataFrame(counts, "contig string, pos long, cnt long"), ["contig"]).collect()}
    assert got[10] == (True, True) and got[20] == (True, False) and got[31] == (True, True) and got[42] == (True, True)
    down = {r.pos: r.is_picked for r in peaks.call_peaks(spark.createDataFrame(counts, "contig string, pos long, cnt long"), ["contig"], descending=True).collect()}
    assert down[20] and not down[10] and down[31]


def plain_tail(k, m):
    """P(X > k), every term that matters in logarithms, from the side of the smaller part."""
    if m <= 0:
        return 0.0
    reach = int(60 * math.sqrt(m) + 400)
    term = lambda i: math.exp(-m + i * math.log(m) - math.lgamma(i + 1))
    if k + 1 >= m:
        return math.fsum(term(i) for i in range(max(k + 1, 0), k + 1 + reach))
    return 1 - math.fsum(term(i) for i in range(max(k - reach, 0), k + 1))


def test_poisson_tail(spark):
    cases = [(0, 0.5), (3, 0.1), (10, 10.0), (200, 90.0), (50, 80.0), (5, 0.0), (1000, 1200.0), (-1, 3.0), (20, 2000.0), (50_000, 1e6), (0, 1e6), (1_000_000, 1e6), (1_002_000, 1e6), (999_000, 1e6), (10, 1e-9), (3_000_000, 1e6)]
    rng = random.Random(11)
    for _ in range(300):
        m = 10 ** rng.uniform(-3, 6)
        cases.append((max(0, round(m + rng.gauss(0, 1) * rng.choice([1, 3, 10, 100]) * math.sqrt(m))), m))
    got = [r.p for r in spark.createDataFrame(cases, "k int, m double").select(S.poisson_tail("k", "m").alias("p")).collect()]
    for (k, m), p in zip(cases, got):
        # lgamma itself is only good to some 1e-9 at a million
        assert p == pytest.approx(plain_tail(k, m), rel=1e-8 if m < 1e3 else 3e-8, abs=1e-300 if k + 1 >= m else 1e-9), (k, m)
    assert got[8] == got[9] == 1.0
    none = spark.createDataFrame([(None, 1.0), (1, None)], "k int, m double").select(S.poisson_tail("k", "m").alias("p")).collect()
    assert [r.p for r in none] == [None, None]


def test_weak_maxima_beside_strong_ones(spark):
    counts = spark.createDataFrame([("c", p, 100_000) for p in (100, 120, 140, 160)] + [("c", 180, 25), ("d", 7, 30)], "contig string, pos long, cnt long")
    rows = {(r.contig, r.pos): r for r in peaks.call_peaks(counts, ["contig"]).collect()}
    assert rows["c", 180].is_picked and rows["c", 180].poisp == 1.0 and rows["d", 7].poisp < 1e-6
    called = peaks.qualify(peaks.call_peaks(counts, ["contig"]), 20, 0.0, ratio_col=None)
    assert {(r.contig, r.pos) for r in peaks.significant(called).collect()} == {("c", 100), ("c", 120), ("c", 140), ("c", 160), ("d", 7)}


def test_coverage_and_depth_lookup(spark):
    rng = random.Random(3)
    blocks = [("c", s, s + rng.randint(0, 20)) for s in (rng.randint(1, 80) for _ in range(30))]
    seg = coverage.segments(spark.createDataFrame(blocks, "contig string, bstart long, bend long"), ["contig"])
    depth = {x: sum(a <= x <= b for _, a, b in blocks) for x in range(1, 130)}
    got = {}
    for r in seg.collect():
        got |= {x: r.depth for x in range(r.seg_start, r.seg_end + 1)}
    assert got == {x: d for x, d in depth.items() if d}
    spots = spark.createDataFrame([("c", x) for x in range(1, 100, 7)], "contig string, pos long")
    for r in peaks.inward_coverage(spots, seg).collect():
        assert r.coverage == pytest.approx(sum(depth.get(r.pos + k, 0) for k in range(10, 15)) / 5)
    assert {r.coverage for r in peaks.inward_coverage(spots, seg, left_side=False).collect()} == {0.0}
    for r in peaks.inward_coverage(spots, seg, left_side=False, mode="inward").collect():
        assert r.coverage == pytest.approx(sum(depth.get(r.pos - k, 0) for k in range(10, 15)) / 5)


def plain_local(adapter, seq, m=2.0, x=-3.0, go=-3.0, ge=-3.0):
    """All best local alignments by trying every pair of stretches (global alignment of each)."""
    best, where = 0.0, set()
    for s in range(len(seq)):
        for a in range(len(adapter)):
            h = {(0, 0): (0.0, 0)}
            score = {}
            for i, j in itertools.product(range(len(adapter) - a + 1), range(len(seq) - s + 1)):
                c = []
                if i and j:
                    c.append(max(score[i - 1, j - 1]) + (m if adapter[a + i - 1] == seq[s + j - 1] else x))
                d = max([score[i - 1, j][0] + go, score[i - 1, j][1] + ge, score[i - 1, j][2] + go]) if i else -1e9
                r = max([score[i, j - 1][0] + go, score[i, j - 1][2] + ge, score[i, j - 1][1] + go]) if j else -1e9
                score[i, j] = ((0.0 if (i, j) == (0, 0) else max(c, default=-1e9)), d, r)
                if i and j and c and seq[s + j - 1] and score[i, j][0] > 0:
                    v = score[i, j][0]
                    if v > best + 1e-9:
                        best, where = v, set()
                    if abs(v - best) < 1e-9:
                        where.add((s, s + j))
            assert h
    return best, where


def test_local_alignment_against_all_stretches():
    rng = random.Random(4)
    for _ in range(60):
        adapter = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 7)))
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 9)))
        score, found = ends.local_alignments([seq, None, ""], adapter, 2.0, -3.0, -3.0, -3.0)
        want, where = plain_local(adapter, seq)
        assert score[0] == pytest.approx(want) and score[1] == score[2] == 0 and found[1] == found[2] == []
        assert [x["e"] for x in found[0]] == sorted({e for _, e in where})


def read(cigar, seq, flag=0, start=100, name="r"):
    return (name, flag, "chr", start, 0, 60, cigar, seq, {})


READ = "qname string, flag int, contig string, start int, end int, mapq int, cigar string, seq string, tags map<string,string>"
FIVE, BODY = Params().five_adapter, "CATCATCGCTCGACTCGACGACTCGCATCAGCTCAGCATCGACTCAGCATCG" * 2


def test_end_labels(spark):
    """A read whose 5' adapter ends at the alignment and whose poly(A) begins at its other end."""
    clip = "G" * 5 + FIVE[:25]
    full = FIVE + BODY + "A" * 30
    rows = [
        read(f"31S{len(BODY)}M30S", full, name="plus"),
        read(f"{len(BODY)}M", BODY, name="bare"),
        read(f"30S{len(BODY)}M", clip[:30] + BODY, name="far"),
        read(f"31S20M500N{len(BODY) - 20}M30S", FIVE + FIVE[-15:] + BODY[15:] + "A" * 30, name="false"),
    ]
    got = {r.qname: r for r in ends.assign_strand(ends.find_introns(ends.label_ends(spark.createDataFrame(rows, READ)))).collect()}
    assert got["plus"].l5.status == "correct" and got["plus"].r3.status in ("correct", "potential template switching")
    assert got["plus"].l3.status == "missing" and got["plus"].flag == 0 and got["plus"].mapq == 9
    assert {got["bare"][k].status for k in ("l3", "l5", "r3", "r5")} == {"no softclip"} and got["bare"].flag == 512 and got["bare"].mapq == 0
    assert got["false"].l5.status == "false exon"
    drna = {r.qname: r for r in ends.label_ends(spark.createDataFrame(rows, READ), Params(drna=True)).collect()}
    assert drna["bare"].l5.status == "correct" and drna["bare"].r3.status == "no softclip" and drna["bare"].r5.status == "no softclip"
    assert ends.label_ends(spark.createDataFrame([], READ)).count() == 0


def plain_introns(cigar, start, left_bad, right_bad, first=30, insert=20):
    at, seen, since, prev, found, gap = start, 0, 0, (None, 0), [], False
    for op, n in cigar:
        if op == "N":
            found.append((at - 1, at + n))
            since = 0
            if (prev[0] == "I" and prev[1] > insert) or (left_bad and seen < first):
                found, gap = [], True
        if op == "M":
            seen, since = seen + n, since + n
        if op in "MDN":
            at += n
        prev = (op, n)
    if found and since < first and right_bad:
        found, gap = found[:-1], True
    return found, gap


def test_intron_fold(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(200):
        ops = [("S", 5)] + [(rng.choice("MMMIDN"), rng.choice([3, 12, 21, 40, 90])) for _ in range(rng.randint(1, 9))] + [("S", 5)]
        l, r = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, "chr", 50, 0, "".join(f"{n}{o}" for o, n in ops), "missing" if l else "correct", "missing" if r else "correct"))
        want[i] = plain_introns(ops, 50, l, r)
    df = spark.createDataFrame(rows, "id int, contig string, start int, flag int, cigar string, l string, r string")
    df = df.withColumns({k: F.struct(F.col(k[0]).alias("status")) for k in ("l3", "l5", "r3", "r5")}).withColumn("ops", ends.parse_cigar("cigar"))
    got = {x.id: ([(i.s, i.e) for i in x.introns], x.gap) for x in ends.find_introns(df).collect()}
    assert got == want


def test_same_name_suppression(spark):
    rows = [("a", 1, 100, 0), ("a", 10, 20, 1), ("a", 200, 300, 2), ("a", 15, 260, 3), ("b", 5, 6, 0)]
    got = {(r.qname, r.start): (r.part, r.n_parts) for r in cluster.suppress_overlaps(spark.createDataFrame(rows, "qname string, start int, end int, ord int")).collect()}
    assert got == {("a", 15): (1, 1), ("b", 5): (1, 1)}


def test_splice_sites_need_every_contig(spark):
    i = spark.createDataFrame([("c", 10, 31), ("x", 10, 31)], "contig string, left int, right int")
    with pytest.raises(ValueError):
        introns.with_splice_sites(i, spark.createDataFrame([("c", "A" * 50)], "contig string, seq string"))


def test_splice_windows_across_pieces(spark, monkeypatch):
    rng = random.Random(12)
    seqs = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("a", 500), ("b", 64), ("c", 63))}
    places = [(c, l, l + rng.randint(1, 30)) for c, s in seqs.items() for l in range(1, len(s) - 31)]
    genome = spark.createDataFrame(list(seqs.items()), "contig string, seq string")
    found = []
    for size in (introns.PIECE, 16):
        monkeypatch.setattr(introns, "PIECE", size)
        found.append({(r.contig, r.left, r.right): (r.leftseq, r.rightseq, r.consensus, r.ts_score) for r in introns.with_splice_sites(spark.createDataFrame(places, "contig string, left int, right int"), genome).collect()})
    assert found[0] == found[1] and len(found[0]) == len(set(places))
    for (c, l, r), (a, b, _, _) in found[0].items():
        assert (a, b) == (seqs[c][max(l - 3, 0) : max(l - 3, 0) + 6], seqs[c][max(r - 4, 0) : max(r - 4, 0) + 6])


def test_exons_between(spark):
    row = spark.createDataFrame([(10, 90, [(20, 31), (50, 61)]), (5, 9, [])], "s int, e int, i array<struct<s:int,e:int>>").select(transcripts.exons_between(F.col("s"), F.col("e"), F.col("i")).alias("x")).collect()
    assert [[tuple(e) for e in r.x] for r in row] == [[(10, 20), (31, 50), (61, 90)], [(5, 9)]]


def test_statistics():
    assert stats.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.f_upper(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-6)


def test_mean_interval_for_every_size(spark):
    known = {2: 12.706205, 5: 2.776445, 200: 1.971957, 201: 1.971896, 1000: 1.962341}
    rows = [(n, float(i % 2)) for n in known for i in range(n)] + [(1, 3.0)]
    got = {r.g: r for r in stats.mean_interval(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()}
    for n, t in known.items():
        assert (got[n].high - got[n].mean) / (got[n].sd / math.sqrt(n)) == pytest.approx(t, abs=2e-6)
    assert got[1].mean == 3.0 and got[1].low is None and got[1].high is None


def test_adjust_with_nulls(spark):
    df = spark.createDataFrame([("k", 0.01), ("k", 0.04), ("k", None), ("k", 0.03)], "k string, p double")
    bh = {r.p: r.p_adj for r in stats.adjust(df, ["k"]).collect()}
    assert bh[0.01] == pytest.approx(0.03) and bh[0.03] == pytest.approx(0.04) and bh[0.04] == pytest.approx(0.04) and bh[None] is None
    holm = {r.p: r.p_adj for r in stats.adjust(df, ["k"], how="holm").collect()}
    assert holm[0.01] == pytest.approx(0.03) and holm[0.03] == pytest.approx(0.06) and holm[0.04] == pytest.approx(0.06)
    assert {r.p_adj for r in stats.adjust(df, ["k"], how="none").collect()} == {0.01, 0.03, 0.04, None}


def test_range_helpers_on_hot_keys_and_nulls(spark):
    q = spark.createDataFrame([("c", 5), ("c", 5), ("c", None), ("d", 5)], "contig string, q long")
    p = spark.createDataFrame([("c", 4)] * 50 + [("c", 16)], "contig string, at long")
    got = sorted((r.contig, r.q or -1, r.n) for r in rangejoin.range_count(q, p, ["contig"], "q", "at", 10).collect())
    assert got == [("c", -1, 0), ("c", 5, 50), ("c", 5, 50), ("d", 5, 0)]


def test_booleans_and_columns(spark):
    df = spark.createDataFrame([("TRUE",), ("no",), ("????",), (None,), ("maybe",)], "x string")
    got = [tuple(r) for r in df.select(S.bool_or_false("x"), S.bool_or_null("x"), S.bool_exact("x"), S.bool_missing_false("x")).collect()]
    assert got == [(True, True, True, True), (False, False, None, False), (False, None, None, False), (False, None, None, None), (False, None, None, None)]
    assert summaries.resolve_column(df, ["nope", "X"]) == "x"
    with pytest.raises(ValueError):
        summaries.require_columns(df, ["x", "y"])


def test_stretches_change_nothing(spark, monkeypatch):
    """Short stretches, whose margins overlap many neighbours' rows, give the same peaks, sites and depths."""
    rng = random.Random(6)
    counts = spark.createDataFrame([("c", p, rng.randint(1, 6)) for p in sorted({rng.randint(1, 3000) for _ in range(500)})], "contig string, pos long, cnt long")
    probes = spark.createDataFrame([("c", rng.randint(1, 3000)) for _ in range(200)], "contig string, pos long")
    blocks = spark.createDataFrame([("c", s, s + rng.randint(0, 300)) for s in (rng.randint(1, 3000) for _ in range(80))], "contig string, bstart long, bend long")

    def all_of():
        p = [[sorted(map(tuple, peaks.call_peaks(counts, ["contig"], descending=d).drop("poisp").collect())) for d in (False, True)]]
        f = sorted(map(tuple, rangejoin.first_in_window(probes, counts, ["contig"], "pos", "pos", 10).collect()))
        seg = coverage.segments(blocks, ["contig"])
        c = sorted((r.pos, r.coverage) for r in peaks.inward_coverage(probes.distinct(), seg).collect())
        return p, f, sorted(map(tuple, seg.collect())), c

    whole = all_of()
    gaps = sorted(map(tuple, cluster.gap_clusters(counts, ["contig"], "pos", 10).collect()))
    pairs = match.interval_matches(probes.distinct(), blocks.selectExpr("contig", "bstart as lo", "bend as hi"), ["contig"]).first()
    monkeypatch.setattr(cluster, "STRETCH", 150)
    monkeypatch.setattr(match, "STRETCH", 150)
    assert sorted(map(tuple, cluster.gap_clusters(counts, ["contig"], "pos", 10).collect())) == gaps
    assert match.interval_matches(probes.distinct(), blocks.selectExpr("contig", "bstart as lo", "bend as hi"), ["contig"]).first() == pairs
    for m in (peaks, rangejoin, coverage):
        monkeypatch.setattr(m, "STRETCH", 150)
    monkeypatch.setattr(peaks.stretches, "__defaults__", (150,))
    assert all_of() == whole
