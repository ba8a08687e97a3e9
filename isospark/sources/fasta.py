"""Genomes by byte ranges: no task reads a whole file, and no row is a whole contig.

A first pass makes an index: each range of a file reports its records and how many bases it has of each;
what a range begins with is known once the ranges before it are summed up.  Pieces of contigs are then
read by seeking: a range gives the pieces whose first base it holds, and reads on to the end of the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, and bytes that are fetched at once.
SPLIT_BYTES, FETCH = 32 << 20, 1 << 20
_WHITE = b" \t\r\n\v\f"

RANGES = "path string, k int, start long, stop long, size long"
SEGMENTS = "path string, k int, nth int, name string, bases long, tail long"


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if not path.endswith(".gz"):
        return system.open_input_file(inner)
    return _Inflated(system.open_input_stream(inner, compression="gzip"))


class _Inflated:
    """A compressed file, read in order."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def read_at(self, n: int, at: int) -> bytes:
        if at != self.at:
            raise ValueError("a compressed file is read in order")
        out = self.stream.read(n)
        self.at += len(out)
        return out


def events(file, begin: int, line_start: bool) -> Iterator[tuple]:
    """``(name, bytes, place, end)``: a header's name, where it begins and its line ends, or None with bytes of bases."""
    at, header, place = begin, None, begin
    while chunk := file.read_at(FETCH, at):
        k = 0
        while k < len(chunk):
            if header is not None:
                j = chunk.find(b"\n", k)
                header += chunk[k : j if j >= 0 else len(chunk)]
                k = j + 1 if j >= 0 else len(chunk)
                if j >= 0:
                    yield (header.split() or [b""])[0].decode(), b"", place, at + k
                    header, line_start = None, True
            elif line_start and chunk[k : k + 1] == b">":
                header, place, k = b"", at + k, k + 1
            else:
                j = chunk.find(b"\n>", k)
                stop = j + 1 if j >= 0 else len(chunk)
                yield None, chunk[k:stop], at + k, at + stop
                line_start, k = chunk[stop - 1 : stop] == b"\n", stop
        at += len(chunk)
    if header is not None:
        yield (header.split() or [b""])[0].decode(), b"", place, at


def _bases(b: bytes) -> bytes:
    return b.translate(None, _WHITE)


def _starts_line(file, start: int) -> bool:
    return start == 0 or file.read_at(1, start - 1) == b"\n"


def segments(file, start: int, stop: int) -> list[tuple[str | None, int, int]]:
    """``(name, bases, tail)`` of a range: up to its first line break, then up to its first header, then by
    record.  ``tail`` is where the bases go on that follow a header which the range's end cuts."""
    first, rest, out, tail = 0, 0, [], stop
    broken = _starts_line(file, start)
    for name, b, at, end in events(file, start, broken):
        if at >= stop:
            break
        b = b[: stop - at]
        if name is not None:
            out.append([name, 0])
            tail = max(stop, end)
        elif out:
            out[-1][1] += len(_bases(b))
        else:
            j = -1 if broken else b.find(b"\n")
            head = b"" if broken else b if j < 0 else b[: j + 1]
            broken = broken or j >= 0
            first += len(_bases(head))
            rest += len(_bases(b[len(head) :]))
    return [(None, first, tail), (None, rest, tail), *((n, k, tail) for n, k in out)]


def pieces(file, begin: int, stop: int, name: str | None, offset: int, margin: int, size: int) -> Iterator[tuple[str, int, bytes]]:
    """``(contig, piece, bases)`` of the pieces whose first base lies in bytes ``[begin, stop)``.

    ``name`` and ``offset`` say of which contig the first base is, and which of its bases.
    """
    held = bytearray()  # bases from ``at`` on, of pieces that are ours
    at = -(-offset // size) * size if name is not None else 0
    skip = at - offset if name is not None else 0
    ours = 0  # bases of ``held`` that were read inside the range

    def ready(ended: bool) -> Iterator[tuple[str, int, bytes]]:
        nonlocal at, ours
        while ours > 0 and (len(held) >= size + margin or ended):
            yield name, at // size, bytes(held[: size + margin])
            del held[:size]
            at, ours = at + size, ours - size

    for found, b, place, end in events(file, begin, _starts_line(file, begin)):
        if found is not None:
            if name is not None:
                yield from ready(True)
            held.clear()
            ours, at, skip, name = 0, 0, 0, found
            if end >= stop:
                return
            continue
        inside = _bases(b[: max(0, stop - place)])
        beyond = _bases(b[max(0, stop - place) :])
        if name is None:
            continue
        drop = min(skip, len(inside))
        skip -= drop
        held += inside[drop:]
        ours += len(inside) - drop
        if not beyond:
            yield from ready(False)
            continue
        if ours <= 0:
            return
        held += beyond
        yield from ready(False)
        if ours <= 0:
            return
    if name is not None:
        yield from ready(True)


@dataclass
class Genome:
    """Contigs with their lengths, and their bases in pieces."""

    spark: SparkSession
    #: ``(contig, length)``
    contigs: DataFrame
    #: By range: path, begin, stop, and which base of which contig is its first.
    ranges: list[tuple] = field(default_factory=list)

    def pieces(self, margin: int, size: int = 4096) -> DataFrame:
        """``(contig, piece, bases)``: contigs in pieces of ``size`` bases, each with the first ``margin`` of the next one."""

        def read(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    file = _open(r["path"])
                    rows = pieces(file, r["begin"], r["stop"], r["name"], r["offset"], margin, size)
                    held = []
                    for row in rows:
                        held.append(row)
                        if len(held) * size > FETCH:
                            yield _batch(held)
                            held = []
                    if held:
                        yield _batch(held)

        rows = self.spark.createDataFrame(self.ranges, "path string, begin long, stop long, name string, offset long")
        return rows.repartition(max(1, len(self.ranges))).mapInArrow(read, "contig string, piece int, bases string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].decode("latin-1") for r in rows], pa.string())], names=["contig", "piece", "bases"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            rows = [{"path": r["path"], "k": r["k"], "nth": i, "name": n, "bases": b, "tail": t} for i, (n, b, t) in enumerate(segments(_open(r["path"]), r["start"], r["stop"]))]
            for i in range(0, len(rows), 1 << 14):
                yield pa.RecordBatch.from_pylist(rows[i : i + (1 << 14)], pa.schema([("path", pa.string()), ("k", pa.int32()), ("nth", pa.int32()), ("name", pa.string()), ("bases", pa.int64()), ("tail", pa.int64())]))


def read_genome(spark: SparkSession, path, split_bytes: int = SPLIT_BYTES) -> Genome:
    """The index of FASTA files: names up to the first blank, any line lengths and line ends; ``>`` inside a header is part of it.

    What stands before a file's first header is left out.  A compressed file is one range.  The driver holds
    a row per range, as it does for a listing of files.
    """
    from isospark.session import cut

    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    whole = 1 << 62
    cuts = [(f.path, k, at, whole if f.path.endswith(".gz") else min(at + split_bytes, f.length), f.length) for f in files for k, at in enumerate([0] if f.path.endswith(".gz") else range(0, f.length, split_bytes))]
    ranges = spark.createDataFrame(cuts, RANGES).repartition(max(1, len(cuts)))
    found = cut(ranges.mapInArrow(_summed, SEGMENTS))
    last = found.groupBy("path", "k").agg(F.max("nth").alias("nth"))
    ends = {(r.path, r.k): r for r in found.join(last, ["path", "k", "nth"]).where("nth > 1").collect()}
    heads: dict = {}
    for r in found.where("nth < 2").collect():
        heads.setdefault((r.path, r.k), {})[r.nth] = r
    out, lengths = [], []
    name, offset, tail, file = None, 0, 0, None
    for path_, k, start, stop, _ in sorted(cuts):
        if path_ != file:
            if name is not None:
                lengths.append((name, offset))
            file, name, offset, tail = path_, None, 0, 0
        head = heads[path_, k]
        cut_header = tail > start  # this range begins inside a header
        if tail < stop:
            out.append((path_, max(tail, start), stop, name, offset))
        offset += (0 if cut_header else head[0].bases) + head[1].bases
        if (path_, k) in ends:
            if name is not None:
                lengths.append((name, offset))
            r = ends[path_, k]
            name, offset = r.name, r.bases
        tail = max(tail, head[0].tail)
    if name is not None:
        lengths.append((name, offset))
    held = found.where("nth > 1").join(last, ["path", "k", "nth"], "left_anti").select(F.col("name").alias("contig"), F.col("bases").alias("length"))
    contigs = held.unionByName(spark.createDataFrame(lengths, "contig string, length long"))
    return Genome(spark, contigs, out)
