"""Operator 5, WARC: a Python data source that writes and reads web archives.

Writing: every task writes gzip members, one per record, to its own files in a shared folder;
the driver commits by naming the finished files in a manifest, so files of failed or repeated
attempts are never read.  Each member carries its compressed length in a ``sl`` extra field.

Reading: the manifests are the plan; small files are packed and large ones cut into byte ranges
of a set size.  Of each record only the headers are inflated at first; predicates on the record
type and other headers are pushed down to them, and the payload of a record that is not wanted,
or all payloads if the ``payload`` column is not in the schema, are skipped by that length.

Paths are URIs that ``pyarrow.fs`` opens (``file:``, ``hdfs:``, ``s3:``, ``gs:``), in a folder
that driver and executors share.
"""

from __future__ import annotations

import base64
import datetime
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as D
from pyspark.sql import types as T

HEADERS = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string"
SCHEMA = HEADERS + ", payload binary"
ROLL_BYTES, SPLIT_BYTES, BATCH_BYTES, HEAD_BYTES = 1 << 30, 128 << 20, 8 << 20, 4096
#: The gzip header of a member (flag 4: extra field) and its ``sl`` field's beginning.
_MAGIC = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = {"record_type": b"warc-type", "record_id": b"warc-record-id", "target_uri": b"warc-target-uri", "date": b"warc-date", "payload_digest": b"warc-payload-digest", "refers_to": b"warc-refers-to"}


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# records


def encode(record: dict) -> bytes:
    """One record as a gzip member.  Control characters of the target are percent-encoded."""
    payload = record.get("payload") or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % record["payload_bytes"]
    revisit = record["record_type"] == "revisit"
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {record['record_type']}", f"WARC-Record-ID: {record['record_id']}", f"WARC-Date: {record['date']}"]
    if record.get("target_uri") is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in record["target_uri"]))
    head.append(f"WARC-Payload-Digest: sha1:{record['payload_digest']}")
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record['refers_to']}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    raw = "\r\n".join(head).encode() + body + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = z.compress(raw) + z.flush()
    size = len(_MAGIC) + 8 + len(packed) + 8
    return _MAGIC + struct.pack("<II", size, len(raw) & 0xFFFFFFFF) + packed + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_head(raw: bytes) -> tuple[dict, int, int] | None:
    """Header columns, where the payload begins and its stored length; None if ``raw`` ends too early."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = raw[:end].split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    row = {c: fields[f].decode("utf-8", "replace") if f in fields else None for c, f in _FIELDS.items()}
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    at, length = end + 4, int(fields.get(b"content-length", 0))
    row["payload_bytes"] = length
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        inner = raw.find(b"\r\n\r\n", at)
        if inner < 0:
            return None
        for x in raw[at:inner].split(b"\r\n")[1:]:
            if x.lower().startswith(b"content-length:"):
                row["payload_bytes"] = int(x[15:])
        length -= inner + 4 - at
        at = inner + 4
    return row, at, length


class _Stats:
    """What a scan inflated and skipped, for tests."""

    def __init__(self):
        self.records = self.payloads = self.skipped_bytes = 0


def scan(file, start: int, end: int, wanted, payload: bool, stats: _Stats | None = None) -> Iterator[dict]:
    """Records of ``file`` whose member begins in ``[start, end)`` and whose headers are ``wanted``."""
    size = file.size()
    at = start if start == 0 else _next_member(file, start, min(end, size))
    while at is not None and at < min(end, size):
        file.seek(at)
        block = file.read(HEAD_BYTES)
        length = struct.unpack_from("<I", block, len(_MAGIC))[0] if block.startswith(_MAGIC) else None
        z = zlib.decompressobj(31)
        raw, tail = z.decompress(block), block
        while (head := parse_head(raw)) is None and not z.eof:
            tail = file.read(HEAD_BYTES)
            raw += z.decompress(tail)
        if head is None:
            raise ValueError(f"a record at {at} has no end of headers")
        row, begin, n = head
        keep = wanted(row)
        read = file.tell()
        if stats:
            stats.records += 1
            stats.payloads += keep and payload
            stats.skipped_bytes += length - (read - at) if length and not (keep and payload) and at + length > read else 0
        if keep and payload:
            parts = [raw]
            left = at + length - read if length else None
            while not z.eof:
                more = file.read(min(left, 1 << 20) if left else 1 << 16)
                if not more:
                    raise ValueError(f"a record at {at} is cut off")
                parts.append(z.decompress(more))
            raw = b"".join(parts)
            row["payload"] = raw[begin : begin + n]
            row["_end"] = file.tell() - len(z.unused_data)
        if keep:
            after = row.pop("_end", None)
            yield row
        else:
            after = None
        if length:
            at += length
        else:  # a foreign member: its end is only known once it is inflated
            while after is None and not z.eof:
                z.decompress(file.read(1 << 16))
            at = after if after is not None else file.tell() - len(z.unused_data)


def _next_member(file, at: int, end: int) -> int | None:
    """The first of our members that begins in ``[at, end)``."""
    while at < end:
        file.seek(at)
        block = file.read((1 << 20) + len(_MAGIC))
        k = block.find(_MAGIC)
        if k >= 0:
            return at + k if at + k < end else None
        at += 1 << 20
    return None


# the data source


@dataclass
class Piece(D.InputPartition):
    files: list

    def __init__(self, files):
        self.files = files


@dataclass
class Written(D.WriterCommitMessage):
    files: list


class WarcSource(D.DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; options ``path``, ``splitBytes``, ``rollBytes``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), schema, overwrite)


def _test(f) -> tuple[str, object] | None:
    """A pushed filter as (column, predicate), if it is on one header column."""
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if isinstance(f, D.Not) and (inner := _test(f.child)):
        # Only of tests that are never unknown; a comparison with null must stay with Spark.
        return (inner[0], lambda x: not inner[1](x)) if isinstance(f.child, (D.IsNull, D.IsNotNull, D.EqualNullSafe)) else None
    if column not in _FIELDS and column != "payload_bytes":
        return None
    value = getattr(f, "value", None)
    tests = {
        D.EqualTo: lambda x: x is not None and x == value,
        D.EqualNullSafe: lambda x: x == value,
        D.In: lambda x: x is not None and x in value,
        D.IsNull: lambda x: x is None,
        D.IsNotNull: lambda x: x is not None,
        D.GreaterThan: lambda x: x is not None and x > value,
        D.GreaterThanOrEqual: lambda x: x is not None and x >= value,
        D.LessThan: lambda x: x is not None and x < value,
        D.LessThanOrEqual: lambda x: x is not None and x <= value,
        D.StringStartsWith: lambda x: x is not None and x.startswith(value),
        D.StringEndsWith: lambda x: x is not None and x.endswith(value),
        D.StringContains: lambda x: x is not None and value in x,
    }
    return (column, tests[type(f)]) if type(f) in tests else None


class WarcReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.columns = schema
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            if t := _test(f):
                self.tests.append(t)
            else:
                yield f

    def partitions(self):
        """Committed files, or all ``.warc.gz`` files where no manifest is; packed or cut to ``splitBytes``."""
        from pyarrow import fs

        system, root = _filesystem(self.path)
        found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if i.is_file]
        manifests = [i.path for i in found if posixpath.basename(i.path).startswith("_manifest-")]
        named = None
        if manifests:
            named = set()
            for m in manifests:
                with system.open_input_stream(m) as s:
                    named |= set(json.loads(s.read()))
        files = sorted((i.path, i.size) for i in found if i.path.endswith(".warc.gz") and (named is None or posixpath.basename(i.path) in named))
        pieces, held, size = [], [], 0
        for path, n in files:
            ours = n > self.split  # only a file that may be cut is opened here
            if ours:
                with system.open_input_file(path) as file:
                    ours = file.read(len(_MAGIC)) == _MAGIC
            step = self.split if ours else max(n, 1)
            for at in range(0, max(n, 1), step):
                if held and size + min(step, n - at) > self.split:
                    pieces.append(Piece(held))
                    held, size = [], 0
                held.append((path, at, min(at + step, n)))
                size += min(step, n - at)
        return pieces + [Piece(held)] if held else pieces or [Piece([])]

    def read(self, partition):
        system, _ = _filesystem(self.path)
        names = self.columns.fieldNames()
        kinds = {f.name: pa.binary() if f.name == "payload" else pa.int64() if f.name == "payload_bytes" else pa.string() for f in self.columns.fields}
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[c]) for c in names], names=names)

        tests = self.tests
        for path, start, end in partition.files:
            with system.open_input_file(path) as file:
                for row in scan(file, start, end, lambda r: all(t(r[c]) for c, t in tests), "payload" in names):
                    rows.append(row)
                    size += 500 + len(row.get("payload") or b"")
                    if size > BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.roll, self.overwrite = options["path"], int(options.get("rollbytes", ROLL_BYTES)), overwrite

    def write(self, iterator):
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        out, files, size = None, [], 0
        for batch in iterator:
            for record in batch.to_pylist():
                record["date"] = record.get("date") or now
                if out is None or size >= self.roll:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(posixpath.join(root, files[-1]), compression=None), 0
                b = encode(record)
                out.write(b)
                size += len(b)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        from pyarrow import fs

        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for i in system.get_file_info(fs.FileSelector(root)):
                if posixpath.basename(i.path).startswith("_manifest-"):
                    system.delete_file(i.path)
        with system.open_output_stream(posixpath.join(root, f"_manifest-{uuid.uuid4().hex}.json"), compression=None) as s:
            s.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages):
        system, root = _filesystem(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(posixpath.join(root, f))


# pages


def base32(hex_digest: Column) -> Column:
    """The base32 form of a hexadecimal SHA-1: four characters for every five digits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    chars = []
    for g in range(8):
        v = F.conv(F.substring(hex_digest, 5 * g + 1, 5), 16, 10).cast("int")
        chars += [F.substring(alphabet, F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Pages as records: of equal payloads of at least ``least`` bytes, the one with the smallest id is
    the response and the others revisit it.  Payload equality is that of SHA-1 and length.

    Ids are integers.  A null payload is empty; a null id comes last among equals; rows that repeat the
    smallest id are all responses.
    """
    if not isinstance(pages.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"ids are integers here, and {id_col} is {pages.schema[id_col].dataType.simpleString()}")
    p = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), p.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    key = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(p).alias("sha"))
    # The hash side holds a row per distinct payload; a payload that many pages share makes a
    # partition of pages large, which AQE splits.
    first = key.groupBy("sha").agg(F.min("id").alias("first"))
    joined = rows.join(first.hint("shuffle_hash"), "sha")
    revisit = (F.col("payload_bytes") >= least) & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn("id").alias("record_id"),
        "target_uri",
        F.lit(None).cast("string").alias("date"),
        base32(F.col("sha")).alias("payload_digest"),
        "payload_bytes",
        F.when(revisit, urn("first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_id(urn: Column) -> Column:
    """The id in a record's URN; null for a page without one."""
    return F.regexp_extract(urn, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(records: DataFrame, path: str, mode: str = "append", **options) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode(mode).options(**options).save(path)


def read(spark: SparkSession, path: str, payload: bool = True, **options) -> DataFrame:
    """Records of an archive folder; without ``payload``, only headers are inflated.

    Call it anew for every query: Spark keeps the filters that one query pushed into a Python source
    with the DataFrame, and a later query on it that pushes none would see them.
    """
    register(spark)
    return spark.read.format("warc").schema(SCHEMA if payload else HEADERS).options(**options).load(path)
