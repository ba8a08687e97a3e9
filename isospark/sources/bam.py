"""BAM files as a Spark source and sink: split by byte ranges, indexed by coordinate, read by region.

A BAM file is a chain of compressed blocks of up to 64 kB, and its records are numbered by virtual
offsets: the place of a block in the file and the place in the block.  A split of a file reads the records
that begin in blocks of its bytes; where they begin is found by looking for a block, then for a chain of
records that are whole in every field.  ``write_bam`` writes a sorted folder of parts, each a BAM file with
its index (``.bai``): hierarchical bins of chunks of records, and the first record of every 16,384 positions.
Filters on ``contig``, ``start`` and ``end`` are pushed down to the index, so a region opens its blocks alone.
"""

from __future__ import annotations

import bisect
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from isospark.model import READ

#: Bytes of a file that a task reads, bytes that are fetched at once, and rows of a batch.
SPLIT_BYTES, FETCH, ROWS = 32 << 20, 1 << 20, 4096
#: Bytes of a block before compression, and the empty block that ends a file.
BLOCK_BYTES = 65_280
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Records in a row that must be whole before a place counts as the begin of one.
SURE = 3
#: Positions of the smallest bin and of a window of the linear index, as a power of two; positions an index can hold.
WINDOW_BITS, MAX_POSITION = 14, 1 << 29

_OPS = "MIDNSHP=X"
_BASES = "=ACMGRSVTWYHKDBN"
_TAG = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_SIZE = {k: struct.calcsize("<" + v) for k, v in _TAG.items()}
_PAIRS = [a + b for a in _BASES for b in _BASES]
_NIBBLE = bytes(_BASES.find(chr(c).upper()) if chr(c).upper() in _BASES else 15 for c in range(256))
_NAMES = [x.split()[0] for x in READ.split(", ")]
_MAP = pa.map_(pa.string(), pa.string())
_KINDS = {"int": pa.int32(), "string": pa.string(), "map<string": _MAP}
_SCHEMA = pa.schema([(x.split()[0], _KINDS[x.split()[1].split(",")[0]]) for x in READ.split(", ")])


# blocks


class Blocks:
    """Inflated blocks of a file, from a place on; ``opened`` counts them."""

    def __init__(self, file, size: int):
        self.file, self.size, self.opened = file, size, 0
        self.base, self.held = 0, b""

    def bytes_at(self, at: int, n: int) -> bytes:
        if not self.base <= at <= at + n <= self.base + len(self.held):
            self.base, self.held = at, self.file.read_at(min(max(n, FETCH), max(0, self.size - at)), at)
        return self.held[at - self.base : at - self.base + n]

    def length(self, at: int) -> int | None:
        """Bytes of the block that begins here, None if none does."""
        head = self.bytes_at(at, min(18, self.size - at)) if at < self.size else b""
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            return None
        extra = struct.unpack_from("<H", head, 10)[0]
        if head[12:16] == b"BC\2\0":
            n = struct.unpack_from("<H", head, 16)[0] + 1
        else:  # other fields come first
            fields, k, n = self.bytes_at(at + 12, extra), 0, 0
            while k + 4 <= len(fields):
                if fields[k : k + 4] == b"BC\2\0":
                    n = struct.unpack_from("<H", fields, k + 4)[0] + 1
                k += 4 + struct.unpack_from("<H", fields, k + 2)[0]
        return n if n > 12 + extra + 8 and at + n <= self.size else None

    def find(self, at: int) -> int | None:
        """The first block that begins at ``at`` or after: two more follow it, or the file ends."""
        while at < self.size:
            k = self.bytes_at(at, min(1 << 16, self.size - at)).find(b"\x1f\x8b\x08\x04")
            if k < 0:
                at += max(1, min(1 << 16, self.size - at) - 3)
                continue
            at += k
            after, seen = at, 0
            while seen < 3 and after < self.size and (n := self.length(after)):
                after, seen = after + n, seen + 1
            if seen == 3 or (seen and after == self.size):
                return at
            at += 1
        return None

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """A block's bytes and the place of the next one; None at the end of the file."""
        if at >= self.size:
            return None
        n = self.length(at)
        if n is None:
            raise ValueError(f"no block of a BAM file begins at byte {at}")
        self.opened += 1
        z = zlib.decompressobj(31)
        return z.decompress(self.bytes_at(at, n)), at + n


class Cursor:
    """A place in the inflated stream: a block, and a place in it."""

    def __init__(self, blocks: Blocks, virtual: int):
        self.blocks = blocks
        self.at, self.pos = virtual >> 16, virtual & 0xFFFF
        self.data, self.next = blocks.inflate(self.at) or (b"", self.at)

    def settle(self) -> bool:
        """Moves to the next block where this one is read; False at the end."""
        while self.pos >= len(self.data):
            found = self.blocks.inflate(self.next)
            if found is None:
                return False
            self.at, self.pos = self.next, self.pos - len(self.data)
            self.data, self.next = found
        return True

    @property
    def virtual(self) -> int:
        return self.at << 16 | self.pos

    def take(self, n: int) -> bytes:
        out = self.data[self.pos : self.pos + n]
        self.pos += len(out)
        parts, got = [out], len(out)
        while got < n and self.settle():
            out = self.data[self.pos : self.pos + n - got]
            self.pos += len(out)
            parts.append(out)
            got += len(out)
        return b"".join(parts) if len(parts) > 1 else parts[0]


@dataclass
class Header:
    text: str
    contigs: list[str]
    lengths: list[int]
    #: Where the first record is.
    first: int


def read_header(blocks: Blocks) -> Header:
    c = Cursor(blocks, 0)
    if c.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", c.take(4))[0]
    text = c.take(number()).rstrip(b"\0").decode()
    contigs, lengths = [], []
    for _ in range(number()):
        contigs.append(c.take(number())[:-1].decode())
        lengths.append(number())
    c.settle()
    return Header(text, contigs, lengths, c.virtual)


# records


def _whole(b: bytes, at: int, contigs: int) -> int | None:
    """Where the record that begins at ``at`` ends, -1 if ``b`` ends before it does; None if none begins there."""
    if at + 36 > len(b):
        return -1
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", b, at)
    if n_seq < 0 or not -1 <= ref < contigs or not -1 <= mate < contigs or pos < -1 or mate_pos < -1 or n_name < 1:
        return None
    body = at + 36 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq
    end = at + 4 + size
    if body > end or size > 1 << 28:
        return None
    if len(b) < min(end, at + 36 + n_name + 4 * n_ops):
        return -1
    name = b[at + 36 : at + 36 + n_name]
    if name[-1] != 0 or not all(33 <= x <= 126 for x in name[:-1]):
        return None
    query = 0
    for op in struct.unpack_from(f"<{n_ops}I", b, at + 36 + n_name):
        if op & 15 > 8:
            return None
        query += (op >> 4) * (op & 15 in (0, 1, 4, 7, 8))
    if n_ops and n_seq and query != n_seq:
        return None
    if len(b) < end:
        return -1
    qual = b[body - n_seq : body]
    if n_seq and qual[0] != 255 and max(qual) > 93:
        return None
    k = body
    while k < end:  # every tag in its length, the last one at the end
        if k + 3 > end:
            return None
        kind = chr(b[k + 2])
        k += 3
        if kind in "ZH":
            stop = b.find(0, k, end)
            if stop < 0:
                return None
            k = stop + 1
        elif kind == "B":
            sub = chr(b[k]) if k + 5 <= end else ""
            if sub not in "cCsSiIf" or not sub:
                return None
            n = struct.unpack_from("<i", b, k + 1)[0]
            if n < 0:
                return None
            k += 5 + n * _SIZE[sub]
        elif kind in _SIZE:
            k += _SIZE[kind]
        else:
            return None
    return end if k == end else None


def first_record(blocks: Blocks, at: int, contigs: int) -> int | None:
    """Virtual offset of the first record that begins in a block at byte ``at`` or after; None without any."""
    begin = blocks.find(at)
    if begin is None:
        return None
    places, buffer, after, ended = [], b"", begin, False

    def more() -> bool:
        nonlocal buffer, after, ended
        found = blocks.inflate(after)
        if found is None:
            ended = True
            return False
        places.append((len(buffer), after))
        buffer += found[0]
        after = found[1]
        return True

    u = 0
    while True:
        while len(buffer) < u + (1 << 16) and more():
            pass
        if u >= len(buffer):
            return None
        k, sure = u, 0
        while sure < SURE:
            end = _whole(buffer, k, contigs)
            if end == -1 and not ended:
                more()
                continue
            if end is None or end == -1:
                break
            k, sure = end, sure + 1
            if k == len(buffer) and not more():
                sure = SURE
        if sure >= SURE:
            i = bisect.bisect_right(places, (u, 1 << 62)) - 1
            return places[i][1] << 16 | u - places[i][0]
        u += 1


def records(blocks: Blocks, header: Header, start: int, end: int, chunks: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, bytes]]:
    """``(virtual offset, record)`` of records that begin in blocks of the bytes ``[start, end)``, of ``chunks`` alone if given."""
    for low, high in [(header.first, 1 << 62)] if chunks is None else chunks:
        if low >> 16 >= end:
            break
        if high <= start << 16:
            continue
        at = low if low >> 16 >= start else first_record(blocks, start, len(header.contigs))
        if at is None:
            continue
        c = Cursor(blocks, at)
        while c.settle() and c.at < end and (v := c.virtual) < high:
            size = struct.unpack("<i", c.take(4))[0]
            yield v, c.take(size)


def _number(x: float) -> str:
    """The shortest text of a 32-bit number."""
    t = str(np.float32(x))
    return t.removesuffix(".0")


def decode(b: bytes, contigs: list[str]) -> tuple:
    """A record as a row of ``READ``."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", b)
    at = 32
    name = b[at : at + n_name - 1].decode()
    at += n_name
    ops = struct.unpack_from(f"<{n_ops}I", b, at)
    at += 4 * n_ops
    seq = "".join([_PAIRS[x] for x in b[at : at + (n_seq + 1) // 2]])[:n_seq]
    at += (n_seq + 1) // 2
    qual = "*" if not n_seq or b[at] == 255 else bytes(x + 33 for x in b[at : at + n_seq]).decode("ascii")
    at += n_seq
    tags, types = {}, {}
    while at < len(b):
        key, kind = b[at : at + 2].decode(), chr(b[at + 2])
        at += 3
        types[key] = kind if kind in "AZHBf" else "i"
        if kind in "ZH":
            stop = b.index(0, at)
            tags[key] = b[at:stop].decode()
            at = stop + 1
        elif kind == "B":
            sub, n = chr(b[at]), struct.unpack_from("<i", b, at + 1)[0]
            vals = struct.unpack_from(f"<{n}{_TAG[sub]}", b, at + 5)
            if key == "CG" and sub == "I" and n_ops == 2 and ops[0] == n_seq << 4 | 4:
                ops = vals  # an alignment of more steps than its field can count
                del types[key]
            else:
                tags[key] = ",".join([sub, *map(_number if sub == "f" else str, vals)])
            at += 5 + n * _SIZE[sub]
        else:
            v = struct.unpack_from("<" + _TAG[kind], b, at)[0]
            tags[key] = v.decode() if kind == "A" else _number(v) if kind == "f" else str(v)
            at += _SIZE[kind]
    cigar = "".join([f"{x >> 4}{_OPS[x & 15]}" for x in ops]) or "*"
    span = sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8))
    name_of = lambda k: contigs[k] if k >= 0 else None
    rnext = None if mate < 0 else "=" if mate == ref else name_of(mate)
    return (name, flag, name_of(ref), pos + 1, pos + span, mapq, cigar, seq or "*", tags, rnext, mate_pos + 1, tlen, qual, types)


def _integer(v: int) -> bytes:
    for kind, low, high in (("c", -128, 127), ("C", 0, 255), ("s", -32768, 32767), ("S", 0, 65535), ("i", -(1 << 31), (1 << 31) - 1), ("I", 0, (1 << 32) - 1)):
        if low <= v <= high:
            return kind.encode() + struct.pack("<" + _TAG[kind], v)
    raise ValueError(f"a tag's whole number of more than 32 bits: {v}")


def encode_tag(key: str, kind: str, text: str) -> bytes:
    if kind in "ZH":
        return key.encode() + kind.encode() + text.encode() + b"\0"
    if kind == "A":
        return key.encode() + b"A" + text.encode()[:1]
    if kind == "f":
        return key.encode() + b"f" + struct.pack("<f", float(text))
    if kind == "B":
        sub, *vals = text.split(",")
        read = float if sub == "f" else int
        return key.encode() + b"B" + sub.encode() + struct.pack(f"<i{len(vals)}{_TAG[sub]}", len(vals), *map(read, vals))
    return key.encode() + _integer(int(text))


def bin_of(begin: int, end: int) -> int:
    """The smallest bin that holds positions ``[begin, end)``, counted from 0."""
    last = max(begin, end - 1)
    for level, shift in ((5, 14), (4, 17), (3, 20), (2, 23), (1, 26)):
        if begin >> shift == last >> shift:
            return ((1 << 3 * level) - 1) // 7 + (begin >> shift)
    return 0


def bins_over(begin: int, end: int) -> set[int]:
    """All bins that touch positions ``[begin, end)``."""
    last = max(begin, end - 1)
    return {0} | {((1 << 3 * level) - 1) // 7 + k for level, shift in ((1, 26), (2, 23), (3, 20), (4, 17), (5, 14)) for k in range(begin >> shift, (last >> shift) + 1)}


def bin_begin(k: int) -> int:
    """The first position of a bin."""
    level = next(n for n in range(5, -1, -1) if k >= ((1 << 3 * n) - 1) // 7)
    return (k - ((1 << 3 * level) - 1) // 7) << 29 - 3 * level


def encode(row: dict, ids: dict[str, int]) -> tuple[bytes, int, int, int]:
    """A record with its length before it, and the contig and positions ``[begin, end)`` it covers; missing fields as unknown."""
    text = lambda c: None if row.get(c) in (None, "*") else row[c]
    number = lambda c, other: other if row.get(c) is None else row[c]
    contig, name = text("contig"), text("qname") or "*"
    if len(name) > 254:
        raise ValueError(f"a read name of more than 254 characters: {name[:40]}...")
    ref = -1 if contig is None else ids[contig]
    mate = text("rnext")
    mate = -1 if mate is None else ref if mate == "=" else ids[mate]
    pos = number("start", 0) - 1
    ops = [int(n) << 4 | _OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", text("cigar") or "")]
    span = sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8))
    seq, qual = text("seq") or "", text("qual")
    kinds = dict(row.get("tag_types") or {})
    tags = b"".join(encode_tag(k, kinds.get(k, "Z"), v) for k, v in dict(row.get("tags") or {}).items() if v is not None)
    if len(ops) > 65535:
        tags += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | 4, span << 4 | 3]
    codes = np.frombuffer(seq.encode("latin-1").translate(_NIBBLE) + b"\0" * (len(seq) % 2), np.uint8)
    packed = (codes[::2] << 4 | codes[1::2]).tobytes()
    quality = bytes(x - 33 for x in qual.encode()) if qual is not None and len(qual) == len(seq) else b"\xff" * len(seq)
    begin, end = max(pos, 0), max(pos, 0) + max(span, 1)
    fixed = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, number("mapq", 255), bin_of(begin, end) if pos >= 0 else 4680, len(ops), number("flag", 0), len(seq), mate, number("pnext", 0) - 1, number("tlen", 0))
    body = fixed + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + quality + tags
    return struct.pack("<i", len(body)) + body, ref, begin, end


# the index


@dataclass
class Index:
    """By contig: chunks of each bin, and the least offset of a record in each window."""

    bins: dict[int, dict[int, list[list[int]]]] = field(default_factory=dict)
    linear: dict[int, dict[int, int]] = field(default_factory=dict)
    unplaced: int = 0

    def add(self, ref: int, begin: int, end: int, low: int, high: int) -> None:
        if ref < 0:
            self.unplaced += 1
            return
        if end > MAX_POSITION:
            raise ValueError(f"the index holds positions up to {MAX_POSITION}")
        chunks = self.bins.setdefault(ref, {}).setdefault(bin_of(begin, end), [])
        if chunks and chunks[-1][1] >> 16 == low >> 16:
            chunks[-1][1] = high
        else:
            chunks.append([low, high])
        windows = self.linear.setdefault(ref, {})
        for w in range(begin >> WINDOW_BITS, (end - 1 >> WINDOW_BITS) + 1):
            windows.setdefault(w, low)

    def encode(self, contigs: int) -> bytes:
        out = [b"BAI\1", struct.pack("<i", contigs)]
        for ref in range(contigs):
            bins = self.bins.get(ref, {})
            out.append(struct.pack("<i", len(bins)))
            for k, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", k, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            windows = self.linear.get(ref, {})
            n = max(windows, default=-1) + 1
            held, last = [], 0
            for w in range(n):
                last = windows.get(w, last)
                held.append(last)
            out.append(struct.pack(f"<i{n}Q", n, *held))
        return b"".join(out) + struct.pack("<Q", self.unplaced)

    @classmethod
    def decode(cls, b: bytes) -> Index:
        if b[:4] != b"BAI\1":
            raise ValueError("not a coordinate index")
        index, at = cls(), 8
        for ref in range(struct.unpack_from("<i", b, 4)[0]):
            n_bins = struct.unpack_from("<i", b, at)[0]
            at += 4
            for _ in range(n_bins):
                k, n = struct.unpack_from("<Ii", b, at)
                at += 8
                if k < 37450:  # the one beyond holds statistics
                    v = struct.unpack_from(f"<{2 * n}Q", b, at)
                    index.bins.setdefault(ref, {})[k] = [list(c) for c in zip(v[::2], v[1::2], strict=True)]
                at += 16 * n
            n = struct.unpack_from("<i", b, at)[0]
            index.linear[ref] = dict(enumerate(struct.unpack_from(f"<{n}Q", b, at + 4)))
            at += 4 + 8 * n
        index.unplaced = struct.unpack_from("<Q", b, at)[0] if at + 8 <= len(b) else 0
        return index

    def chunks(self, ref: int, begin: int, end: int) -> list[tuple[int, int]]:
        """Stretches of virtual offsets with all records that touch ``[begin, end)``, in order and apart."""
        end = min(end, MAX_POSITION)
        if end <= begin:
            return []
        bins, windows = self.bins.get(ref, {}), self.linear.get(ref, {})
        least = windows.get(begin >> WINDOW_BITS, 1 << 62 if windows else 0)
        wanted = bins_over(begin, end) if (end - begin) >> WINDOW_BITS < len(bins) else [k for k in bins if k in bins_over(begin, end)]
        # A bin that begins behind the region holds reads that start there, and so do all reads after its first.
        most = min((c[0][0] for k, c in bins.items() if c and bin_begin(k) >= end), default=1 << 62)
        out: list[list[int]] = []
        for low, high in sorted(c for k in wanted for c in bins.get(k, ()) if c[1] > least and c[0] < most):
            low, high = max(low, least), min(high, most)
            if out and low <= out[-1][1]:
                out[-1][1] = max(out[-1][1], high)
            else:
                out.append([low, high])
        return [tuple(c) for c in out]


# the source and the sink


@dataclass
class Region:
    """What pushed filters leave of contigs and of positions, counted from 1; None for no limit."""

    contigs: set[str] | None = None
    low: int | None = None
    high: int | None = None

    def narrow(self, f) -> None:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        value, kind = getattr(f, "value", None), type(f)
        if column == "contig" and kind in (D.EqualTo, D.In):
            mine = {value} if kind is D.EqualTo else set(value)
            self.contigs = mine if self.contigs is None else self.contigs & mine
        if column in ("start", "end") and isinstance(value, int):
            # A read that starts, or ends, at least here ends here or later; one that ends, or starts, at most here starts here or before.
            if kind in (D.EqualTo, D.GreaterThan, D.GreaterThanOrEqual):
                self.low = max(self.low or 0, value + (kind is D.GreaterThan))
            if kind in (D.EqualTo, D.LessThan, D.LessThanOrEqual):
                v = value - (kind is D.LessThan)
                self.high = v if self.high is None else min(self.high, v)

    def chunks(self, index: Index, contigs: list[str]) -> list[tuple[int, int]]:
        """Chunks of the index for this region, in order and apart."""
        begin, end = max((self.low or 1) - 1, 0), MAX_POSITION if self.high is None else self.high
        found = sorted(c for k, name in enumerate(contigs) if name in self.contigs for c in index.chunks(k, begin, end))
        out: list[list[int]] = []
        for low, high in found:
            if out and low <= out[-1][1]:
                out[-1][1] = max(out[-1][1], high)
            else:
                out.append([low, high])
        return [tuple(c) for c in out]

    def holds(self, row: tuple) -> bool:
        return self.contigs is None or row[2] in self.contigs and (self.low is None or row[4] >= self.low) and (self.high is None or row[3] <= self.high)


class BamSource(D.DataSource):
    """``format("bam")``; options ``path``, ``splitBytes``, and for writing ``header``."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return READ

    def reader(self, schema):
        return BamReader(dict(self.options))

    def writer(self, schema, overwrite):
        return BamWriter(dict(self.options), overwrite)


@dataclass
class Split(D.InputPartition):
    path: str
    start: int
    end: int
    size: int
    indexed: bool


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def scan(file, size: int, start: int, end: int, region: Region, index: bytes | None, blocks: Blocks | None = None) -> Iterator[tuple]:
    """Rows of a split of a file; of a region where an index is given and contigs are wanted."""
    blocks = blocks or Blocks(file, size)
    header = read_header(blocks)
    by_index = index is not None and region.contigs is not None
    chunks = region.chunks(Index.decode(index), header.contigs) if by_index else [(header.first, 1 << 62)]
    last = max((k for k, name in enumerate(header.contigs) if by_index and name in region.contigs), default=-1)
    for chunk in chunks:
        for _, b in records(blocks, header, start, end, [chunk]):
            ref, pos = struct.unpack_from("<ii", b)
            if by_index and (ref < 0 or (ref, pos) >= (last, MAX_POSITION if region.high is None else region.high)):
                break  # a file with an index is sorted
            row = decode(b, header.contigs)
            if region.holds(row):
                yield row


class BamReader(D.DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.region = Region()

    def pushFilters(self, filters):
        for f in filters:
            self.region.narrow(f)
            yield f  # Spark tests the rows that are left

    def partitions(self):
        from pyarrow import fs

        system, root = _system(self.path)
        info = system.get_file_info(root)
        if info.is_file:
            aside = system.get_file_info([info.path + ".bai", info.path.removesuffix(".bam") + ".bai"])
            files = [info, *(i for i in aside if i.is_file)]
        else:
            files = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and not posixpath.basename(i.path).startswith((".", "_"))]
        beside = {i.path.removesuffix(".bai").removesuffix(".bam") for i in files if i.path.endswith(".bai")}
        bams = [i for i in files if i.path.endswith(".bam") or info.is_file and i is info]
        out = [Split(i.path, at, min(at + self.step, i.size), i.size, i.path.removesuffix(".bam") in beside) for i in sorted(bams, key=lambda i: i.path) for at in range(0, i.size, self.step)]
        return out or [Split("", 0, 0, 0, False)]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = _system(self.path)
        index = None
        if partition.indexed and self.region.contigs is not None:
            names = [partition.path + ".bai", partition.path.removesuffix(".bam") + ".bai"]
            with system.open_input_stream(next(i.path for i in system.get_file_info(names) if i.is_file), compression=None) as s:
                index = s.read()
        with system.open_input_file(partition.path) as file:
            rows = []
            for row in scan(file, partition.size, partition.start, partition.end, self.region, index):
                rows.append(row)
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if k == _MAP else c, k) for c, k in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


@dataclass
class Written(D.WriterCommitMessage):
    files: list[str]


class Part:
    """A BAM file that is being written, and its index; a record begins a block if it does not fit."""

    def __init__(self, out, header: str, contigs: list[tuple[str, int]]):
        self.out, self.at, self.index = out, 0, Index()
        self.held = bytearray()
        self.ids = {name: k for k, (name, _) in enumerate(contigs)}
        text = header.encode()
        self.put(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs)))
        for name, length in contigs:
            self.put(struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\0" + struct.pack("<i", length))
        self.flush()

    def put(self, b: bytes) -> None:
        self.held += b
        while len(self.held) >= BLOCK_BYTES:
            self._block(bytes(self.held[:BLOCK_BYTES]))
            del self.held[:BLOCK_BYTES]

    def flush(self) -> None:
        if self.held:
            self._block(bytes(self.held))
            self.held.clear()

    def _block(self, data: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
        if len(body) > 65_000:  # what does not shrink is stored
            z = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = z.compress(data) + z.flush()
        self.out.write(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data)))
        self.at += len(body) + 26

    def add(self, row: dict) -> None:
        b, ref, begin, end = encode(row, self.ids)
        if self.held and len(self.held) + len(b) > BLOCK_BYTES:
            self.flush()
        low = self.at << 16 | len(self.held)
        self.put(b)
        self.index.add(ref, begin, end, low, self.at << 16 | len(self.held))

    def close(self) -> bytes:
        self.flush()
        self.out.write(END)
        self.out.close()
        return self.index.encode(len(self.ids))


def _contigs_of(header: str) -> list[tuple[str, int]]:
    lines = [dict(f.split(":", 1) for f in x.split("\t")[1:] if ":" in f) for x in header.splitlines() if x.startswith("@SQ")]
    return [(f["SN"], int(f["LN"])) for f in lines]


class BamWriter(D.DataSourceArrowWriter):
    """A part and its index for each partition, under names that only a commit makes visible."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.header, self.overwrite = options["path"], options["header"], overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bam"
        part = Part(system.open_output_stream(posixpath.join(root, f"_{name}"), compression=None), self.header, _contigs_of(self.header))
        for batch in iterator:
            for row in batch.to_pylist():
                part.add(row)
        index = part.close()
        with system.open_output_stream(posixpath.join(root, f"_{name}.bai"), compression=None) as s:
            s.write(index)
        return Written([name, f"{name}.bai"])

    def commit(self, messages):
        from pyarrow import fs

        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        ours = [f for m in messages if m for f in m.files]
        kept = {f"_{f}" for f in ours}
        if self.overwrite:
            for i in system.get_file_info(fs.FileSelector(root)):
                if i.is_file and i.path.endswith((".bam", ".bai")) and posixpath.basename(i.path) not in kept:
                    system.delete_file(i.path)
        for f in sorted(ours, key=lambda f: f.endswith(".bam")):  # an index is there before its part
            system.move(posixpath.join(root, f"_{f}"), posixpath.join(root, f))

    def abort(self, messages):
        system, root = _system(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(posixpath.join(root, f"_{f}"))


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads of a BAM file or of a folder of them, columns as ``model.READ``; ``path`` is absolute or a URI.

    Filters on ``contig`` (equal, in) with ``start`` and ``end`` are looked up in the index of a file that has
    one.  The frame keeps filters that a query pushed down: read anew for each region.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", str(split_bytes)).load(path)


def read_region(spark: SparkSession, path: str, contig: str, start: int = 1, end: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads that touch positions ``start`` to ``end`` of a contig, by the index where there is one."""
    rows = read_bam(spark, path, split_bytes).where((F.col("contig") == contig) & (F.col("end") >= start))
    return rows if end is None else rows.where(F.col("start") <= end)


def write_bam(reads: DataFrame, path: str, tags: dict[str, str] | None = None, contigs: DataFrame | None = None, program: str = "isospark") -> None:
    """A folder of coordinate-sorted BAM files that follow each other, each with its index.

    ``tags`` gives, by tag and type such as ``ts:i``, the column to write, as in ``sam.sam_lines``; tags of the
    same letters that were read give way.  ``contigs(contig, length)`` gives lengths; without it the contigs of
    the reads and of their mates are listed, with the furthest end.  Contigs are in the order of their names,
    unmapped reads come last.  The list of contigs, which every part holds, is collected.
    """
    spark = reads.sparkSession
    if contigs is None:
        mates = reads.select(F.col("rnext").alias("contig"), F.col("pnext").alias("at")) if "rnext" in reads.columns else None
        seen = reads.select("contig", F.col("end").alias("at"))
        seen = seen if mates is None else seen.unionByName(mates)
        contigs = seen.where("contig is not null and contig not in ('*', '=')").groupBy("contig").agg(F.greatest(F.max("at"), F.lit(1)).alias("length"))
    listed = sorted((r["contig"], r["length"]) for r in contigs.select("contig", "length").collect())
    header = "".join(["@HD\tVN:1.6\tSO:coordinate\n", *(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in listed), f"@PG\tID:{program}\tPN:{program}\n"])
    none = F.create_map().cast("map<string,string>")
    old = F.coalesce("tags", none) if "tags" in reads.columns else none
    kinds = F.coalesce("tag_types", none) if "tag_types" in reads.columns else none
    if tags:
        ours = {k[:2]: (k[3:], F.col(c).cast("string")) for k, c in tags.items()}
        given = F.map_filter(F.create_map(*[x for k, (_, c) in ours.items() for x in (F.lit(k), c)]), lambda _, v: v.isNotNull())
        typed = F.create_map(*[x for k, (kind, _) in ours.items() for x in (F.lit(k), F.lit(kind))])
        names = F.array(*[F.lit(k) for k in ours])
        old = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(names, k)), given)
        kinds = F.map_concat(F.map_filter(kinds, lambda k, _: ~F.array_contains(names, k)), typed)
    typed_null = {x.split()[0]: x.split()[1] for x in READ.split(", ") if "map<" not in x}
    columns = [F.col(c) if c in reads.columns else F.lit(None).cast(t).alias(c) for c, t in typed_null.items()]
    rows = reads.select(*columns, old.alias("tags"), kinds.alias("tag_types")).select(*_NAMES)
    mapped = F.coalesce(F.col("contig") != "*", F.lit(False))
    spark.dataSource.register(BamSource)
    rows.orderBy(~mapped, "contig", "start", "qname", "flag").write.format("bam").mode("overwrite").option("header", header).save(path)
