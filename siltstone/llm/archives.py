"""WARC records in ZIP packages, written and range-read by the executors.

A package is a ZIP file with stored members: archives under ``archive/``, each record a gzip member of its
own, and indexes under ``indexes/`` with each record's archive and place, as lines of JSON that a sort key may
precede. The reader parses the end records, ZIP64 ones included, and the central directory, finds where the
stored members begin, reads all indexes, and then reads ranges of records straight from the package; an
archive that no index names is walked record by record. Nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.llm._io import materialize, work_path

ARCHIVES, INDEXES = "archive/", "indexes/"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
PAGE, NO_PAGE = "<urn:x-page:", "<urn:x-no-page>"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class Package:
    """The directory of a ZIP file that is read by ranges: ``read(offset, length)`` and its ``size``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\5\6")
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
            end = tail.rfind(b"PK\5\6", 0, end + 3)  # a comment may hold the signature
        if end < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        if count == 0xFFFF or 0xFFFFFFFF in (length, start):
            locator = read(tail_at + end - 20, 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("ZIP64 locator is missing")
            (at,) = struct.unpack("<Q", locator[8:16])
            count, length, start = struct.unpack("<QQQ", read(at, 56)[32:56])
        self.members: dict[str, Member] = {}
        directory, at = read(start, length), 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("central directory is damaged")
            flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
            packed, plain, name_len, extra_len, note_len = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
            (header,) = struct.unpack("<I", directory[at + 42 : at + 46])
            name = directory[at + 46 : at + 46 + name_len].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + name_len : at + 46 + name_len + extra_len]
            while len(extra) >= 4:
                tag, n = struct.unpack("<HH", extra[:4])
                if tag == 1:
                    wide = [x for (x,) in struct.iter_unpack("<Q", extra[4 : 4 + n // 8 * 8])]
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            self.members[name] = Member(name, method, packed, header)
            at += 46 + name_len + extra_len + note_len

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin; its local header has lengths of its own."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is compressed in the package; only stored members can be read by range")
        name_len, extra_len = struct.unpack("<HH", self.read(m.header, 30)[26:30])
        return m.header + 30 + name_len + extra_len

    def places(self) -> Iterator[tuple[str, int, int]]:
        """(archive member, offset, length) of all records, by the indexes; by a walk where none names the archive."""
        archives = [n for n in self.members if n.startswith(ARCHIVES) and n.endswith((".warc.gz", ".warc"))]
        listed: dict[str, set[tuple[int, int]]] = {n: set() for n in archives}
        for name in self.members:
            if name.startswith(INDEXES) and not name.endswith("/"):
                data = self.read(self.start(name), self.members[name].size)
                for line in (gzip.decompress(data) if name.endswith(".gz") else data).decode().splitlines():
                    found = json.loads(line[line.index("{") :]) if "{" in line else {}
                    if "offset" in found and (at := ARCHIVES + found.get("filename", "").removeprefix(ARCHIVES)) in listed:
                        listed[at].add((int(found["offset"]), int(found["length"])))
        for name in archives:
            yield from ((name, *x) for x in (sorted(listed[name]) if listed[name] else self.walk(name)))

    def walk(self, name: str, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """The bounds of an archive's records, from its bytes."""
        start, size, at = self.start(name), self.members[name].size, 0
        while at < size:
            if name.endswith(".gz"):
                one, end = zlib.decompressobj(31), at
                while not one.eof and end < size:
                    data = self.read(start + end, min(step, size - end))
                    one.decompress(data)
                    end += len(data) - len(one.unused_data)
            else:
                head = self.read(start + at, min(step, size - at)).partition(b"\r\n\r\n")[0]
                length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                end = at + len(head) + 4 + length + 4
            yield at, end - at
            at = end


def _head(lines: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines).encode()


def page_urn(page: str | None) -> str:
    return NO_PAGE if page is None else f"{PAGE}{quote(page, safe='')}>"


def page_of(urn: str | None) -> str | None:
    return unquote(urn[len(PAGE) : -1]) if urn and urn.startswith(PAGE) else None


def write_record(page: str | None, url: str, payload: bytes | None, size: int, digest: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One record as a gzip member; without payload, a revisit that keeps the HTTP head of the full response."""
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))]) + b"\r\n"
    block = http + (payload if refers_to is None else b"")
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) or "urn:x-unknown"
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", page_urn(page)), ("WARC-Date", date), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()), ("Content-Type", "application/http; msgtype=response")]
    lines += [] if refers_to is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", page_urn(refers_to))]
    record = b"WARC/1.1\r\n" + _head([*lines, ("Content-Length", str(len(block)))]) + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record, a gzip member or plain."""
    record = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class _Stream(io.RawIOBase):
    """An output stream for zipfile that cannot seek."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def decide_records(pages: DataFrame, least_bytes: int = 1000, broadcast_groups: int = 300_000) -> DataFrame:
    """page_id, url, html with payload_bytes, payload_digest and refers_to: of equal payloads of ``least_bytes``
    or more, that of the largest page_id stays a response and the others refer to it.

    Up to ``broadcast_groups`` groups of copies go to all tasks, so that no payload is shuffled; beyond that, a join by
    digest, whose hot groups adaptive execution splits.
    """
    html = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    groups = sized.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialize(groups, "copies")
    if groups.count() <= broadcast_groups:
        groups = F.broadcast(groups)
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper"))
    return sized.join(groups, "payload_digest", "left").withColumn("refers_to", F.when(F.col("keeper").isNotNull() & other, F.col("keeper"))).drop("keeper")


def write_packages(records: DataFrame, folder: str, package_bytes: int = 64 << 20) -> DataFrame:
    """Write packages under ``folder`` from the executors and return their manifest (path, records).

    A package has a name of its own, and only those in the manifest, which finished tasks have written,
    count: a task that is lost or run twice leaves a file that nothing refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")), strict=True))
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        row = next(rows, None)
        while row is not None:
            name, at, index = f"{uuid.uuid4().hex}.wacz", 0, []
            with fs.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                with package.open(ARCHIVE, "w", force_zip64=True) as member:
                    while row is not None and at < package_bytes:
                        page, url, html, size, digest, refers_to = row
                        data = write_record(None if page is None else str(page), url or "", html.encode(), size, bytes.fromhex(digest), None if refers_to is None else str(refers_to))
                        member.write(data)
                        index.append(json.dumps({"filename": ARCHIVE.removeprefix(ARCHIVES), "offset": at, "length": len(data)}))
                        at += len(data)
                        row = next(rows, None)
                package.writestr(INDEX, "\n".join(index))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], names=["path", "records"])

    return materialize(records.select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, "path string, records long"), "manifest")


def read_records(package: Package, read_bytes: int = 4 << 20) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """All records of a package; neighbours are read in one range of up to ``read_bytes``, larger ones by themselves."""
    places, starts, i = list(package.places()), {}, 0
    while i < len(places):
        name, first, length = places[i]
        j, end = i + 1, first + length
        while j < len(places) and places[j][0] == name and places[j][1] + places[j][2] - first <= read_bytes:
            end = max(end, places[j][1] + places[j][2])
            j += 1
        if name not in starts:
            starts[name] = package.start(name)
        run = package.read(starts[name] + first, end - first)
        for _, at, n in places[i:j]:
            yield parse_record(run[at - first : at - first + n])
        i = j


def read_packages(manifest: DataFrame, page_type: str = "long", most_tasks: int = 100_000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record in the packages
    of ``manifest``, a task for each package up to ``most_tasks``; payloads are held against their digests."""

    def rows(path: str) -> Iterator[tuple]:
        fs, name = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(name) as f:
            for fields, http, payload in read_records(Package(lambda at, n: f.read_at(n, at), f.size())):
                kind, size = fields["WARC-Type"], int(http["Content-Length"]) if "Content-Length" in http else len(payload)
                if kind not in ("response", "revisit"):
                    continue
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                if kind == "response" and (hashlib.sha1(payload).digest() != digest or len(payload) != size):
                    raise ValueError(f"a payload in {path} differs from its digest")
                yield page_of(fields["WARC-Record-ID"]), size, digest.hex(), kind, page_of(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        found = (r for b in batches for path in b["path"].to_pylist() for r in rows(path))
        while held := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    tasks = max(1, min(most_tasks, manifest.count()))
    read = manifest.select("path").repartition(tasks).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return read.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write every page as a WARC record into packages in the shared folder, and read all of them back.

    A null html is an empty payload, a null url the URI ``urn:x-unknown``. Repeated rows, of one page_id with equal
    payloads, stay responses if the id is the largest; a null page_id is smaller than any, and in a group
    without other ids all rows are responses. Ids may be numbers or text, compared as their type says. An empty
    table writes no package. Payloads of any length are one record. Other columns are not read.
    """
    return read_packages(write_packages(decide_records(pages), work_path(spark, "packages")), pages.schema["page_id"].dataType.simpleString())
