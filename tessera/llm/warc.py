"""WARC archives as a Spark data source (``spark.read.format("warc")``, ``df.write.format("warc")``).

Archives are WARC/1.1. With gzip each record is a member of its own whose header carries the
standard's skip-length field (compressed and uncompressed length), so a reader steps from record to
record without decoding. Members without that field, as other tools write them, are inflated to their end, in
bounded pieces; they may hold several records or parts of one. Reading plans one partition per archive, so a single
large archive is one task. It parses a record's headers first, tests record type and header predicates on them, and
decodes the payload only of records that pass, and only when the payload column is wanted (without the
field, other payloads are inflated and dropped). Header names match in any case, with or without white space
after the colon; the column ``headers`` has them as written.

Predicates: equality (and IN) on ``record_type`` and on ``header_equals`` options reach the reader;
Spark pushes filters where ``spark.sql.python.filterPushdown.enabled`` is set, and the options
``recordTypes``, ``headerEquals`` (``Name=value``) and ``payload=false`` do the same without it.

Writing: every task writes archives below ``path`` under names of its own attempt; the commit writes the list
of committed archives, and readers read only listed ones, so lost or repeated tasks leave nothing behind
that counts. Paths are URIs of any store that Arrow's file systems open (file, hdfs, s3, gs).

Columns: record_id, record_type, target_uri, date, payload_digest, payload_length, refers_to, headers (map), payload.
Defined cases: a null payload is written empty; empty archives and empty tables read as no rows; a broken record
raises with its archive and position.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from . import common as C

SCHEMA = ("record_id string, record_type string, target_uri string, date string, payload_digest string, "
          "payload_length long, refers_to string, headers map<string,string>, payload binary")
LIST = "_ARCHIVES.json"
ROLL_BYTES = 64 << 20
_FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}


def open_fs(uri: str):
    """File system and path of a URI (a bare path is local)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def record_bytes(headers: list[tuple[str, str]], payload: bytes, gzip: bool) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(payload)}\r\n\r\n"
    raw = head.encode() + payload + b"\r\n\r\n"
    if not gzip:
        return raw
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8  # fixed header, extra length, "sl" field, data, trailer
    return (b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(raw) & 0xFFFFFFFF)
            + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF))


class Headers(dict):
    """Header lines as written; ``field`` finds a value by the name in any case."""

    def field(self, name: str, default: str | None = None) -> str | None:
        if name in self:
            return self[name]
        low = name.lower()
        return next((v for k, v in self.items() if k.lower() == low), default)


class Inflated:
    """The bytes of consecutive gzip members from ``at`` on; holds one piece at a time."""

    PIECE = 1 << 16

    def __init__(self, f, at: int, name: str):
        self.f, self.name = f, name
        self.next = at  # where the file is read next
        self.z, self.raw, self.data = zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        """Inflate a piece more into ``data``; False at the end of the last member."""
        while True:
            if self.z.eof:
                if not self._member():
                    return False
                self.z = zlib.decompressobj(31)
            if not self.raw:
                self.f.seek(self.next)
                self.raw = self.f.read(self.PIECE)
                self.next += len(self.raw)
                if not self.raw:
                    raise ValueError(f"{self.name}:{self.next}: a gzip member is cut short")
            try:
                got = self.z.decompress(self.raw, self.PIECE)
            except zlib.error as e:
                raise ValueError(f"{self.name}:{self.next - len(self.raw)}: {e}") from e
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.data += got
            if got:
                return True

    def _member(self) -> bool:
        """Whether another gzip member follows the one that ended."""
        if len(self.raw) < 2:
            self.f.seek(self.next)
            new = self.f.read(self.PIECE)
            self.raw, self.next = self.raw + new, self.next + len(new)
        return self.raw[:2] == b"\x1f\x8b"

    def ended(self) -> bool:
        """Whether the records read so far end with a member."""
        while not self.data and not self.z.eof:
            if not self._more():
                break
        return not self.data and self.z.eof

    def place(self) -> int:
        return self.next - len(self.raw)

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before ``mark``, which is passed; None where it does not come."""
        at = 0
        while (end := self.data.find(mark, at)) < 0:
            at = max(0, len(self.data) - len(mark) + 1)
            if not self._more():
                return None
        out, self.data = self.data[:end], self.data[end + len(mark):]
        return out

    def take(self, n: int, keep: bool) -> tuple[int, bytes]:
        """Pass ``n`` bytes: how many there were, and (with ``keep``) the bytes."""
        parts, left = [], n
        while left and (self.data or self._more()):
            part, self.data = self.data[:left], self.data[left:]
            left -= len(part)
            if keep:
                parts.append(part)
        return n - left, b"".join(parts)


class Records:
    """Records of an open archive: headers first, payload on demand, else skipped unread."""

    def __init__(self, f, name: str):
        self.f, self.name = f, name
        self.size = f.size()

    def __iter__(self):
        at = 0
        while at < self.size:
            self.f.seek(at)
            head = self.f.read(24)
            if head[:2] == b"\x1f\x8b":
                if len(head) < 24 or head[3] != 4 or head[10:16] != b"\x0c\x00sl\x08\x00":
                    at = yield from self._stream(at)
                    continue
                size = struct.unpack("<I", head[16:20])[0]
                yield from self._member(at, size)
                at += size
            else:
                at = yield from self._plain(at)

    def _parse(self, head: bytes, at: int) -> dict[str, str]:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{self.name}:{at}: no WARC record")
        out, last = Headers(), None
        for x in lines[1:]:
            if x[:1] in (" ", "\t") and last is not None:  # a folded line
                out[last] = f"{out[last]} {x.strip()}".strip()
            elif x:
                name, _, value = x.partition(":")
                last = name.strip()
                out[last] = value.strip(" \t")
        return out

    def _length(self, headers: Headers, at: int) -> int:
        n = headers.field("Content-Length", "")
        if not n.isdecimal():
            raise ValueError(f"{self.name}:{at}: no content length")
        return int(n)

    def _stream(self, at: int):
        """Records of gzip members without skip length; the place after the member that ends with a record."""
        data = Inflated(self.f, at, self.name)
        while True:
            place = data.place()
            head = data.until(b"\r\n\r\n")
            if head is None:
                raise ValueError(f"{self.name}:{place}: headers do not end")
            headers = self._parse(head, place)
            n, got = self._length(headers, place), []

            def payload() -> bytes:
                if not got:
                    got.append(data.take(n, True))
                if got[0][0] < n:
                    raise ValueError(f"{self.name}:{place}: payload cut short")
                return got[0][1]

            yield headers, payload
            if (got[0] if got else data.take(n, False))[0] < n or data.take(4, False)[0] < 4:
                raise ValueError(f"{self.name}:{place}: payload cut short")
            if data.ended():
                return data.place()

    def _member(self, at: int, size: int):
        z, raw, read = zlib.decompressobj(-15), b"", 24
        self.f.seek(at + 24)
        while (end := raw.find(b"\r\n\r\n")) < 0:  # decode no more than the headers need
            data = z.unconsumed_tail or self.f.read(min(4096, max(0, size - read)))
            if not data:
                raise ValueError(f"{self.name}:{at}: headers do not end")
            read += 0 if z.unconsumed_tail else len(data)
            raw += z.decompress(data, 1024)
        headers = self._parse(raw[:end], at)
        tail, body = z.unconsumed_tail, raw[end + 4:]

        def payload() -> bytes:
            self.f.seek(at + read)
            rest = body + z.decompress(tail + self.f.read(size - read)) + z.flush()
            n = self._length(headers, at)
            if len(rest) < n:
                raise ValueError(f"{self.name}:{at}: payload cut short")
            return rest[:n]

        yield headers, payload

    def _plain(self, at: int):
        self.f.seek(at)
        raw = b""
        while (end := raw.find(b"\r\n\r\n")) < 0:
            data = self.f.read(1024)
            if not data:
                raise ValueError(f"{self.name}:{at}: headers do not end")
            raw += data
        headers = self._parse(raw[:end], at)
        start, n = at + end + 4, self._length(headers, at)

        def payload() -> bytes:
            self.f.seek(start)
            data = self.f.read(n)
            if len(data) < n:
                raise ValueError(f"{self.name}:{at}: payload cut short")
            return data

        yield headers, payload
        return start + n + 4


@dataclass
class Archive(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.uri = options["path"]
        self.types = {x for x in options.get("recordtypes", options.get("recordTypes", "")).split(",") if x}
        self.want = dict(x.split("=", 1) for x in options.get("headerequals", options.get("headerEquals", "")).split(";") if x)
        self.no_payload = options.get("payload", "true").lower() == "false"
        self.tests: list[tuple[str, set]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            header = f.attribute[1] if len(getattr(f, "attribute", ())) == 2 and f.attribute[0] == "headers" else _FIELDS.get(name)
            if header and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.tests.append((header, {f.value}))
            elif header and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.tests.append((header, set(f.value)))
            else:
                yield f

    def partitions(self):
        fs, path = open_fs(self.uri)
        info = fs.get_file_info(f"{path}/{LIST}")
        if info.type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/{LIST}") as f:
                names = json.loads(f.read())
        else:
            root = fs.get_file_info(path)
            found = [root] if root.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
            names = [x.path for x in found if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]
        return [Archive(n) for n in sorted(names)] or [Archive("")]

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = open_fs(self.uri)
        with fs.open_input_file(partition.path) as f:
            for headers, payload in Records(f, partition.path):
                if self.types and headers.field("WARC-Type") not in self.types:
                    continue
                if any(headers.field(k) != v for k, v in self.want.items()) or any(headers.field(k) not in v for k, v in self.tests):
                    continue
                yield tuple(self._value(c, headers, payload) for c in self.columns)

    def _value(self, column, headers, payload):
        if column == "payload":
            return None if self.no_payload else payload()
        if column == "headers":
            return dict(headers)
        if column == "payload_length":
            return int(headers.field("X-Payload-Length") or headers.field("Content-Length"))
        return headers.field(_FIELDS[column])


@dataclass
class Written(WriterCommitMessage):
    paths: list


class WarcWriter(DataSourceWriter):
    """Rows of ``SCHEMA`` columns; ``headers`` adds header lines of the caller's."""

    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.uri = options["path"]
        self.gzip = options.get("compression", "gzip") == "gzip"

    def write(self, iterator):
        fs, path = open_fs(self.uri)
        fs.create_dir(path, recursive=True)
        paths, out, size = [], None, 0
        try:
            for row in iterator:
                if out is None or size > ROLL_BYTES:
                    if out is not None:
                        out.close()
                    paths.append(f"{path}/part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out, size = fs.open_output_stream(paths[-1], compression=None), 0
                r = dict(zip(self.columns, row, strict=True))
                head = [(h, str(r[c])) for c, h in _FIELDS.items() if r.get(c) is not None]
                if r.get("payload_length") is not None:
                    head.append(("X-Payload-Length", str(r["payload_length"])))
                head += [(k, v) for k, v in (r.get("headers") or {}).items() if k not in _FIELDS.values() and k != "Content-Length"]
                data = record_bytes([(k, v.replace("\r", " ").replace("\n", " ")) for k, v in head], bytes(r.get("payload") or b""), self.gzip)
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(paths)

    def commit(self, messages):
        fs, path = open_fs(self.uri)
        fs.create_dir(path, recursive=True)
        names = sorted(p for m in messages if m for p in m.paths)
        with fs.open_output_stream(f"{path}/{LIST}", compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        fs, _ = open_fs(self.uri)
        for m in messages:
            for p in m.paths if m else ():
                fs.delete_file(p)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    C.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


HOT_DIGESTS = 10_000
MIN_SHARED_BYTES = 100


def records_of(pages: DataFrame, least: int = MIN_SHARED_BYTES, hot: int = HOT_DIGESTS) -> DataFrame:
    """WARC rows of pages: of equal payloads of ``least`` bytes or more the smallest page_id is the
    response, the others are revisits without payload that refer to it; smaller ones are all responses.

    Payloads are compared by SHA-256. Digests are grouped without the payloads; those shared by a share of
    more than 1/``hot`` of all rows (so at most ``hot`` of them) are joined by broadcast, the rest by shuffle.
    Null ids are responses; rows of one id and payload are alike.
    """
    page = pages.select("page_id", "url", F.coalesce(pages["html"].cast("binary"), F.lit(b"")).alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    light = page.where((F.col("size") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = C.stored(light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1"), "digests")
    most = (groups.agg(F.sum("k")).first()[0] or 0) / hot
    common = groups.where(F.col("k") > most).select(F.col("digest").alias("d1"), F.col("first").alias("f1"))
    seldom = groups.where(F.col("k") <= most).select(F.col("digest").alias("d2"), F.col("first").alias("f2"))
    able = (F.col("size") >= least) & F.col("page_id").isNotNull()
    out = page.join(F.broadcast(common), able & (page["digest"] == F.col("d1")), "left")
    # rows that need no second look-up join on a key of their own instead of gathering at null
    key = F.when(able & F.col("d1").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest"))
    out = out.withColumn("key", key)
    # a shared payload is written once: the others travel without it
    out = out.join(seldom, out["key"] == F.col("d2"), "left").withColumn("first", F.coalesce("f1", "f2"))
    again = F.col("first").isNotNull() & (F.col("first") != F.col("page_id"))
    uri = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return out.select(
        F.coalesce(uri(F.col("page_id")), F.lit("urn:page:")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit("2026-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.col("size").alias("payload_length"),
        F.when(again, uri(F.col("first"))).alias("refers_to"),
        F.create_map(F.lit("Content-Type"), F.when(again, "message/http").otherwise("text/html; charset=utf-8")).alias("headers"),
        F.when(~again, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    register(pages.sparkSession)
    records_of(pages).write.format("warc").mode("append").option("compression", compression).save(path)


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_report(spark: SparkSession, path: str) -> DataFrame:
    """Per record read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are decoded and measured on the payload itself; revisits are read by their headers
    alone, through the record type predicate.
    """
    number = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3))
    full = read_records(spark, path).where("record_type = 'response'")
    head = read_records(spark, path, payload=False).where("record_type = 'revisit'")
    cols = lambda size, digest: [
        F.when(number("record_id") != "", number("record_id")).cast("long").alias("page_id"), size.cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"), "record_type", number("refers_to").cast("long").alias("refers_to")]
    return full.select(*cols(F.octet_length("payload"), F.sha2("payload", 256))).unionByName(
        head.select(*cols(F.col("payload_length"), F.substring_index("payload_digest", ":", -1))))
