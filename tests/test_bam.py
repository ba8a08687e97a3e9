"""BAM: splits at every cut point, round trips, the index, regions, and what a scan opens."""

import io
import random
import struct
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isospark.sources import bam, sam


@pytest.fixture(autouse=True)
def checkpoints(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="isospark-"))


CONTIGS = [("chr1", 3_000_000), ("chr2", 40_000)]


def made(n: int, seed: int = 4) -> list[dict]:
    """Sorted reads of very different lengths, some of many blocks, with all kinds of tags."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        length = r.choice([5, 80, 300, 900, 4000, 150_000 if i % 97 == 3 else 50])
        a = r.randrange(1, length)
        gap = r.choice([0, 0, 70, 20_000, 900_000])
        cigar = f"{a}M{gap}N{length - a}M" if gap and length - a else f"{length}M"
        contig = r.choice(["chr1", "chr1", "chr1", "chr2"]) if i % 20 else None
        start = 0 if contig is None else r.randrange(1, 2_000_000 if contig == "chr1" else 30_000)
        tags = {"NM": str(r.choice([0, -5, 200, 40_000, 3_000_000_000])), "XA": "x", "XZ": "text with = and ;", "XF": r.choice(["1.5", "0.1", "-3"]), "XB": "S,1,65535", "XH": "1AE3"}
        out.append({"qname": f"read{i}", "flag": 4 if contig is None else 16 * (i % 2), "contig": contig, "start": start, "mapq": i % 61, "cigar": "*" if contig is None else cigar, "seq": "".join(r.choices("ACGTN", k=length)),
                    "tags": tags, "rnext": r.choice([None, "=", "chr2"]) if contig else None, "pnext": 7, "tlen": -20, "qual": "*" if i % 3 else "".join(chr(r.randrange(33, 126)) for _ in range(length)),
                    "tag_types": {"NM": "i", "XA": "A", "XZ": "Z", "XF": "f", "XB": "B", "XH": "H"}})
    return sorted(out, key=lambda x: (x["contig"] is None, x["contig"] or "", x["start"]))


def file_of(rows: list[dict]) -> tuple[bytes, bytes]:
    held = io.BytesIO()
    held.close, close = lambda: None, held.close  # noqa: F841
    part = bam.Part(held, "@HD\tVN:1.6\n", CONTIGS)
    for row in rows:
        part.add(row)
    index = part.close()
    return held.getvalue(), index


def opened(data: bytes) -> bam.Blocks:
    return bam.Blocks(pa.BufferReader(data), len(data))


def test_every_cut_point():
    """Two splits of a file hold its records once, wherever it is cut, also in files whose records lie across blocks."""
    rows = made(40)
    data, _ = file_of(rows)
    header = bam.read_header(opened(data))
    whole = [v for v, _ in bam.records(opened(data), header, 0, len(data))]
    assert len(whole) == len(rows)
    blocks, at, starts = opened(data), 0, []
    while found := blocks.inflate(at):
        starts.append(at)
        at = found[1]
    cuts = sorted({*(s + d for s in starts for d in (-1, 0, 1, 17)), *random.Random(1).sample(range(len(data)), 60)} & set(range(1, len(data))))
    for cut in cuts:
        parts = [[v for v, _ in bam.records(opened(data), header, a, b)] for a, b in ((0, cut), (cut, len(data)))]
        assert parts[0] + parts[1] == whole, cut


def test_records_across_small_blocks():
    """Blocks of a hundred bytes, so that nearly every record lies across several."""
    rows = made(60, 9)
    data, _ = file_of([r for r in rows if len(r["seq"]) < 1000])
    blocks, at, inflated = opened(data), 0, b""
    while found := blocks.inflate(at):
        inflated, at = inflated + found[0], found[1]
    small = io.BytesIO()
    small.close = lambda: None
    part = bam.Part.__new__(bam.Part)
    part.out, part.at = small, 0
    for i in range(0, len(inflated), 100):
        part._block(inflated[i : i + 100])
    small.write(bam.END)
    data = small.getvalue()
    header = bam.read_header(opened(data))
    whole = [b for _, b in bam.records(opened(data), header, 0, len(data))]
    step = len(data) // 37
    parts = [b for a in range(0, len(data), step) for _, b in bam.records(opened(data), header, a, min(a + step, len(data)))]
    assert parts == whole and len(whole) > 40


def test_fields_of_a_record_survive():
    for row in made(60):
        b, ref, begin, end = bam.encode(row, {"chr1": 0, "chr2": 1})
        back = dict(zip(bam._NAMES, bam.decode(b[4:], ["chr1", "chr2"]), strict=True))
        want = row | {"rnext": "=" if row["rnext"] == row["contig"] and row["rnext"] else row["rnext"]}
        assert {k: back[k] for k in want} == want
        assert struct.unpack_from("<i", b)[0] == len(b) - 4 and (ref < 0 or end - begin == max(1, back["end"] - back["start"] + 1))
    many = {"qname": "m", "contig": "chr1", "start": 5, "cigar": "1M1D" * 40_000, "seq": "A" * 40_000}
    back = dict(zip(bam._NAMES, bam.decode(bam.encode(many, {"chr1": 0})[0][4:], ["chr1"]), strict=True))
    assert back["cigar"] == many["cigar"] and back["end"] == 5 + 80_000 - 1 and back["tags"] == {} and back["mapq"] == 255 and back["qual"] == "*"
    with pytest.raises(ValueError, match="32 bits"):
        bam.encode_tag("XX", "i", str(1 << 40))


def test_bins():
    assert bam.bin_of(0, 1) == 4681 and bam.bin_of(16_383, 16_385) == 585 and bam.bin_of(0, 1 << 29) == 0
    r = random.Random(2)
    for _ in range(300):
        a = r.randrange(1 << 26)
        b = a + r.choice([1, 100, 20_000, 3_000_000, 80_000_000])
        c = r.randrange(a - 1000, b + 1000)
        d = c + r.choice([1, 5000])
        if 0 <= c < b and a < d:
            assert bam.bin_of(a, b) in bam.bins_over(c, d)


def test_regions_open_their_blocks_alone():
    rows = made(1500)
    data, index = file_of(rows)
    assert bam.Index.decode(index).encode(2) == index
    total = opened(data)
    header = bam.read_header(total)
    everything = [bam.decode(b, header.contigs) for _, b in bam.records(total, header, 0, len(data))]
    few = 0
    for contig, low, high in [("chr1", 1, 1), ("chr1", 500_000, 500_400), ("chr1", 1_999_000, 3_000_000), ("chr2", 16_000, 17_000), ("chr2", 1, 40_000), ("chr3", 1, 9), ("chr1", 2_950_000, 2_990_000)]:
        region = bam.Region({contig}, low, high)
        want = [r for r in everything if r[2] == contig and r[4] >= low and r[3] <= high]
        for step in (len(data), 200_001):
            got = [r for a in range(0, len(data), step) for r in bam.scan(pa.BufferReader(data), len(data), a, min(a + step, len(data)), region, index)]
            assert got == want, (contig, low, high, step)
        blocks = opened(data)
        list(bam.scan(None, len(data), 0, len(data), region, index, blocks))
        chunks = region.chunks(bam.Index.decode(index), header.contigs)
        named = list(bam.records(opened(data), header, 0, len(data), chunks))
        spans = sum(len(b) // bam.BLOCK_BYTES + 1 for _, b in named)
        assert blocks.opened <= 2 + len({v >> 16 for v, _ in named}) + spans + 2 * len(chunks)
        few += blocks.opened < total.opened / 4
    assert few >= 3
    data, index = file_of([r for r in made(6000) if "N" not in r["cigar"] and len(r["seq"]) < 5000])
    everything, blocks = opened(data), opened(data)
    n = sum(1 for _ in bam.records(everything, bam.read_header(everything), 0, len(data)))
    got = list(bam.scan(None, len(data), 0, len(data), bam.Region({"chr1"}, 500_000, 510_000), index, blocks))
    assert 0 < len(got) < n / 50 and blocks.opened <= 5 < everything.opened / 6


def test_spark_round_trip_and_regions(spark, tmp_path):
    rows = made(300)
    names = ["qname", "flag", "contig", "start", "end", "mapq", "cigar", "seq", "tags", "rnext", "pnext", "tlen", "qual", "tag_types"]
    old = [bam.decode(bam.encode(r, {"chr1": 0, "chr2": 1})[0][4:], ["chr1", "chr2"]) for r in rows]
    from isospark.model import READ

    reads = spark.createDataFrame(old, READ).repartition(5).withColumn("mark", F.when(F.col("qname") == "read7", F.lit(12)))
    out = f"file://{tmp_path}/out.bam"
    bam.write_bam(reads, out, {"XZ:i": "mark"}, spark.createDataFrame(CONTIGS, "contig string, length int"))
    back = sam.read_alignments(spark, out)
    assert back.columns == names
    got = {r.qname: r for r in back.collect()}
    assert len(got) == 300
    for row in old:
        want = dict(zip(names, row, strict=True))
        want["tags"] = {k: v for k, v in want["tags"].items() if k != "XZ"} | ({"XZ": "12"} if row[0] == "read7" else {})
        want["tag_types"] = {k: "i" if k == "XZ" else v for k, v in want["tag_types"].items() if k in want["tags"]}
        assert got[row[0]].asDict() == want
    parts = sorted(p for p in (tmp_path / "out.bam").iterdir() if p.name.endswith(".bam"))
    order = [r for p in parts for r in bam.scan(pa.BufferReader(p.read_bytes()), p.stat().st_size, 0, p.stat().st_size, bam.Region(), None)]
    assert [(r[2] is None, r[2] or "", r[3]) for r in order] == sorted((r[2] is None, r[2] or "", r[3]) for r in order)
    assert all((tmp_path / "out.bam" / f"{p.name}.bai").exists() for p in parts)
    assert bam.read_bam(spark, out, split_bytes=30_000).count() == 300
    for contig, low, high in [("chr1", 400_000, 900_000), ("chr2", 1, 5000), ("none", 1, 5)]:
        want = sorted(r[0] for r in old if r[2] == contig and r[4] >= low and r[3] <= high)
        assert sorted(r.qname for r in bam.read_region(spark, out, contig, low, high).collect()) == want
        assert sorted(r.qname for r in bam.read_region(spark, out, contig, low, high, 30_000).collect()) == want
    # A filtered copy, over the first one: the old parts go.
    kept = spark.createDataFrame(back.where("flag & 16 = 16").collect(), READ)
    bam.write_bam(kept, out)
    assert {r.qname for r in bam.read_bam(spark, out).collect()} == {r[0] for r in old if r[1] & 16}
    bam.write_bam(kept.limit(0), f"file://{tmp_path}/none.bam")
    assert bam.read_bam(spark, f"file://{tmp_path}/none.bam").collect() == []
