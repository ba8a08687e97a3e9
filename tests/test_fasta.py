"""Genomes by byte ranges: any cut, headers with '>' inside, CRLF, long lines, compressed files."""

import gzip
import random
import tempfile

import pyarrow as pa
import pytest

from isospark.sources import fasta


@pytest.fixture(autouse=True)
def checkpoints(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="isospark-"))


def contigs(seed=1):
    r = random.Random(seed)
    return {f"c{i}": "".join(r.choices("ACGTN", k=n)) for i, n in enumerate([0, 1, 7, 100, 333, 64, 2000, 5, 128])}


def written(seqs, width, end):
    heads = ["", " text", " a > b >c", "\tfrom>x" + " long" * 40]
    out = b""
    for i, (name, s) in enumerate(seqs.items()):
        out += f">{name}{heads[i % 4]}".encode() + end
        out += b"".join(s[k : k + width].encode() + end for k in range(0, len(s), width))
        out += end * (i % 2)
    return out


def whole(seqs, margin, size):
    return {(n, k // size): s[k : k + size + margin].encode() for n, s in seqs.items() for k in range(0, len(s), size)}


class Ranges:
    """The index of one file, as ``read_genome`` sums it up, without Spark."""

    def __init__(self, data, cuts):
        self.data, self.out, self.lengths = data, [], {}
        name, offset, tail = None, 0, 0
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            (_, first, end), (_, rest, _), *records = fasta.segments(pa.BufferReader(data), start, stop)
            if tail < stop:
                self.out.append((max(tail, start), stop, name, offset))
            offset += (0 if tail > start else first) + rest
            if records:
                if name is not None:
                    self.lengths[name] = offset
                self.lengths |= {n: k for n, k, _ in records[:-1]}
                name, offset = records[-1][:2]
            tail = max(tail, end)
        self.lengths[name] = offset

    def pieces(self, margin, size):
        rows = [p for r in self.out for p in fasta.pieces(pa.BufferReader(self.data), *r, margin, size)]
        assert len(rows) == len({r[:2] for r in rows})
        return {(n, k): b for n, k, b in rows}


@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
@pytest.mark.parametrize("width", [7, 60, 10_000])
def test_every_range(width, end):
    seqs = contigs()
    data = written(seqs, width, end)
    r = random.Random(2)
    cuts = [[0, c, len(data)] for c in range(1, len(data))] if width == 60 else []
    cuts += [sorted({0, len(data), *r.sample(range(1, len(data)), r.randrange(1, 40))}) for _ in range(40)] + [[*range(0, len(data), 3), len(data)]]
    for c in cuts:
        ranges = Ranges(data, c)
        assert ranges.lengths == {n: len(s) for n, s in seqs.items()}, c
        for margin, size in ((4, 32), (0, 10)) if len(c) > 3 else ((4, 32),):
            assert ranges.pieces(margin, size) == whole(seqs, margin, size), c


def test_read_genome(spark, tmp_path):
    a, b = contigs(3), {f"x{n}": s for n, s in contigs(4).items()}
    (tmp_path / "a.fa").write_bytes(written(a, 60, b"\r\n"))
    with gzip.open(tmp_path / "b.fa.gz", "wb") as f:
        f.write(written(b, 70, b"\n"))
    (tmp_path / "empty.fa").write_bytes(b"")
    genome = fasta.read_genome(spark, str(tmp_path / "*.fa*"), split_bytes=500)
    want = a | b
    assert {r.contig: r.length for r in genome.contigs.collect()} == {n: len(s) for n, s in want.items()}
    assert {(r.contig, r.piece): r.bases.encode() for r in genome.pieces(6, 100).collect()} == whole(want, 6, 100)


def test_a_contig_of_many_ranges_is_no_row(tmp_path):
    """A contig in one line of 40 MB: every range holds pieces of its own, none more than a fetch."""
    line = b"ACGT" * 10_000_000
    data = b">big\n" + line + b"\n"
    step = 5_000_000
    ranges = Ranges(data, [*range(0, len(data), step), len(data)])
    assert ranges.lengths == {"big": len(line)}
    n = 0
    for r in ranges.out:
        rows = 0
        for name, k, bases in fasta.pieces(pa.BufferReader(data), *r, 6, 4096):
            assert name == "big" and bases == line[k * 4096 : (k + 1) * 4096 + 6]
            rows += 1
        assert rows <= step // 4096 + 1
        n += rows
    assert n == -(-len(line) // 4096)
