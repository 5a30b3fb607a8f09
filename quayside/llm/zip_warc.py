"""WARC records inside ZIP packages: written as stored members with an index, read back by ranges.

A package holds ``archive/data-N.warc.gz`` (one gzip member per record, stored without further compression) and
``indexes/index-N.cdxj`` (one line per record with its offset and length). The reader parses the central directory
(ZIP64 records where sizes or offsets need them), finds the stored members, lists their records from the indexes and
reads each record's bytes from the package itself: nothing is extracted. Packages of other writers are read too: CDXJ
and CDX indexes, plain or gzipped, that name an archive by its path or file name; archives without an index, compressed
or not, are walked once. Records without a page (``warcinfo``, ``request``, ``metadata``) are passed over; what is
damaged, or cannot be read by range, is refused with its name. Paths keep their scheme.

Of records with equal payloads the one with the largest page id is the response and the others are revisits of it;
payloads below ``least_bytes`` are all responses.

Cases: a null payload is empty; a null id is written as such, read back as null, and is a response only where no row
of its payload has an id; rows that repeat both id and payload have the same type; a null URL has no target header;
white space and control characters in URLs are escaped, and read back so; an empty table writes no package and reads no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import as_bytes, calls, in_workers
from quayside.storage import fresh_path, materialise

ID = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PACKAGE_BYTES = 256 << 20
MEMBER_BYTES = 64 << 20
# Neighbouring records read in one request.
READ_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"


# --- writing ---------------------------------------------------------------------------------------------------

def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def escape(url: str) -> str:
    """White space and control characters as percent escapes: they would break a header or an index line."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda x: "".join(f"%{b:02X}" for b in x[0].encode()), url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit holds the HTTP header only, whose Content-Length is that of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + escape(url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{'' if refers_to is None else refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# Schemes that Spark knows under another name than Arrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def place_of(uri: str) -> tuple[FileSystem, str]:
    """The Arrow file system of a path or URI as Spark writes it, and the path in it."""
    scheme, mark, rest = uri.partition(":")
    if mark and scheme in _SCHEMES:
        uri = f"{_SCHEMES[scheme]}:{rest}"
    elif mark and scheme == "file":
        return LocalFileSystem(), "/" + rest.lstrip("/")
    return FileSystem.from_uri(uri)


class Package:
    """One ZIP package being written; members and their index are rolled by size."""

    def __init__(self, folder: str, zip64: bool = False):
        self.system, root = place_of(folder)
        self.system.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.zip"
        # The package is listed as the caller names its folder, scheme and all: readers may run anywhere.
        self.path = f"{folder.rstrip('/')}/{name}"
        self.stream, self.zip64 = self.system.open_output_stream(f"{root.rstrip('/')}/{name}"), zip64
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = None
        self.members = self.records = self.size = 0

    def add(self, key: str, record: bytes) -> None:
        data = gzip.compress(record, 1, mtime=0)
        if self.member and self.offset + len(data) > MEMBER_BYTES:
            self.close_member()
        if not self.member:
            self.name = f"archive/data-{self.members:05d}.warc.gz"
            self.member = self.zip.open(zipfile.ZipInfo(self.name), "w", force_zip64=self.zip64)
            self.offset, self.lines = 0, []
        self.member.write(data)
        self.lines.append(f"{key} {json.dumps({'filename': self.name, 'offset': self.offset, 'length': len(data)})}\n")
        self.offset += len(data)
        self.size += len(data)
        self.records += 1

    def close_member(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(f"indexes/index-{self.members:05d}.cdxj"), "".join(sorted(self.lines)))
        self.member = None
        self.members += 1

    def close(self) -> dict:
        if self.member:
            self.close_member()
        self.zip.close()
        self.stream.close()
        return {"package": self.path, "records": self.records}


def write_packages(pages: DataFrame, folder: str, *, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES,
                   zip64: bool = False) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` below ``folder``; ``(package, records)`` of what was written.

    The payload travels only if revisits are too many to broadcast. A package of a lost attempt is never listed.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("sha").alias("shared_sha"), "keeper")
    shared = materialise(shared, "warc-shared-payloads")
    rows = rows.join(shared, rows["sha"] == shared["shared_sha"], "left").select(
        "page_id", "url", "html", "keeper",
        F.coalesce(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("shared_sha").isNotNull(), F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for cut in calls(batch, "html"):
                columns = [cut.column(x).to_pylist() for x in ("page_id", "url", "keeper", "revisit")]
                for page_id, url, keeper, revisit, payload in zip(*columns, as_bytes(cut.column("html"))):
                    package = package or Package(folder, zip64)
                    key = (escape(url) if url else "-") + " " + DATE[:10].replace("-", "") + "000000"
                    package.add(key, record_bytes(page_id, url, payload, keeper, revisit))
                    if package.size >= package_bytes:
                        done.append(package.close())
                        package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("package", pa.string()), ("records", pa.int64())]))

    written = in_workers(rows, run, "package string, records long")
    return materialise(written, "warc-packages")


# --- reading ---------------------------------------------------------------------------------------------------

def read_range(file, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"package ends early: {len(data)} of {length} bytes at {start}")
    return data


def directory(file, size: int) -> Iterator[tuple[str, int, int, int, int]]:
    """``(name, method, stored bytes, bytes, local header)`` of each entry in the central directory."""
    tail_at = max(0, size - 65557)
    tail = read_range(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    entries, length, start = struct.unpack("<H2I", tail[end + 10 : end + 20])
    if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = tail[end - 20 : end] if end >= 20 else read_range(file, tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("ZIP64 locator is missing")
        record = read_range(file, struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end record is missing")
        entries, length, start = struct.unpack("<3Q", record[32:56])
    data, at = read_range(file, start, length), 0
    for _ in range(entries):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory is damaged")
        flags, method = struct.unpack("<2H", data[at + 8 : at + 12])
        stored, full = struct.unpack("<2I", data[at + 20 : at + 28])
        n, extra, comment = struct.unpack("<3H", data[at + 28 : at + 34])
        local = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        more, i = data[at + 46 + n : at + 46 + n + extra], 0
        while i + 4 <= len(more):
            tag, length_ = struct.unpack("<2H", more[i : i + 4])
            if tag == 1:  # ZIP64: only the fields that overflow, in this order
                values = iter(struct.unpack(f"<{length_ // 8}Q", more[i + 4 : i + 4 + length_ // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                stored = next(values) if stored == 0xFFFFFFFF else stored
                local = next(values) if local == 0xFFFFFFFF else local
            i += 4 + length_
        yield name, method, stored, full, local
        at += 46 + n + extra + comment


def member_start(file, local: int) -> int:
    head = read_range(file, local, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("local header is damaged")
    return local + 30 + sum(struct.unpack("<2H", head[26:30]))


def index_entries(name: str, data: bytes) -> Iterator[tuple[str, int, int]]:
    """``(file name, offset, length)`` of the lines of an index: CDXJ, or CDX with its line of field letters.

    Lines that are no entry (headers of CDXJ) and entries without a place are passed over.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    fields: list[str] = []
    for line in data.decode("utf-8", "replace").splitlines():
        if line.startswith(" CDX "):
            fields = line.split()[1:]
        elif fields:
            entry = dict(zip(fields, line.split(" ")))
            if entry.get("V", "-") != "-" and entry.get("S", "-") != "-":
                yield entry["g"], int(entry["V"]), int(entry["S"])
        elif " {" in line and not line.startswith("!"):
            try:
                found = json.loads(line[line.index(" {") + 1 :])
                if "offset" in found and "length" in found:
                    yield found["filename"], int(found["offset"]), int(found["length"])
            except (ValueError, KeyError, TypeError) as error:
                raise ValueError(f"{name} has a damaged line: {line[:200]}") from error


def is_index(name: str) -> bool:
    return name.removesuffix(".gz").endswith((".cdxj", ".cdx"))


def is_archive(name: str) -> bool:
    return name.removesuffix(".gz").endswith(".warc")


def walked(file, name: str, start: int, size: int) -> Iterator[tuple[int, int]]:
    """``(offset, length)`` of the records of a stored archive that no index lists, from the archive itself.

    Compressed records are gzip members of their own; plain ones tell their length. A few MB are held at a time.
    """
    at = 0
    plain = size >= 5 and read_range(file, start, 5) == b"WARC/"
    while at < size:
        if plain:
            head = b""
            while b"\r\n\r\n" not in head:
                more = min(1 << 14, size - at - len(head))
                if more <= 0 or len(head) > 1 << 22:
                    raise ValueError(f"{name} has a damaged record at {at}")
                head += read_range(file, start + at + len(head), more)
            head = head[: head.index(b"\r\n\r\n") + 4]
            body = header_fields(head.decode("utf-8", "replace").split("\r\n"))["content-length"]
            length = len(head) + int(body) + 4
        else:
            reader, length = zlib.decompressobj(31), 0
            while not reader.eof:
                if at + length >= size:
                    raise ValueError(f"{name} ends inside a record at {at}")
                part = read_range(file, start + at + length, min(1 << 20, size - at - length))
                try:
                    rest = part
                    while rest and not reader.eof:   # what comes out is thrown away, a little at a time
                        reader.decompress(rest, 1 << 20)
                        rest = reader.unconsumed_tail
                    while not reader.eof and reader.decompress(b"", 1 << 20):
                        pass
                except zlib.error as error:
                    raise ValueError(f"{name} has a damaged record at {at}") from error
                length += len(part) - len(reader.unused_data)
        if at + length - (4 if plain else 0) > size:   # the blank lines after the last record may be missing
            raise ValueError(f"{name} ends inside a record at {at}")
        yield at, min(length, size - at)
        at += length


def record_ranges(path: str) -> Iterator[tuple[str, int, list[int], list[int]]]:
    """``(package, first byte, record starts from there, record lengths)``, a few MB of neighbouring records each.

    An index names an archive by its path in the package or by its file name alone. Archives that no index names are
    walked. What cannot be read by range is refused.
    """
    system, local = place_of(path)
    size = system.get_file_info(local).size
    with system.open_input_file(local) as file:
        found = {x[0]: x[1:] for x in directory(file, size)}
        listed: dict[str, list[tuple[int, int]]] = {x: [] for x in found if is_archive(x)}
        short = {x.rsplit("/", 1)[-1]: x for x in listed}
        for name, (method, stored, _, at) in found.items():
            if is_index(name):
                if method not in (0, 8):
                    raise ValueError(f"{name} in {path} is packed by a method that is not known: {method}")
                data = read_range(file, member_start(file, at), stored)
                for of, offset, length in index_entries(f"{name} in {path}", data if method == 0 else zlib.decompress(data, -15)):
                    archive = of if of in listed else short.get(of.rsplit("/", 1)[-1])
                    if archive is None:
                        raise ValueError(f"{name} in {path} lists {of}, which the package does not hold")
                    listed[archive].append((offset, length))
        for name in sorted(listed):
            method, stored, _, at = found[name]
            if method != 0:
                raise ValueError(f"{name} in {path} is compressed inside the package; only stored members can be read by range")
            start = member_start(file, at)
            records = sorted(set(listed[name])) or walked(file, f"{name} in {path}", start, stored)
            group: list[tuple[int, int]] = []
            for record in chain(records, [None]):
                if record and record[0] + record[1] > stored:
                    raise ValueError(f"a record of {name} in {path} lies beyond its end")
                if group and (record is None or record[0] + record[1] - group[0][0] > READ_BYTES):
                    yield path, start + group[0][0], [x - group[0][0] for x, _ in group], [n for _, n in group]
                    group = []
                if record:
                    group.append(record)


def header_fields(lines: list[str]) -> dict[str, str]:
    """Named fields of header lines, names in lower case; a line that goes on with white space belongs to the one before."""
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def own_number(uri: str | None) -> int | None:
    """The page id in a record id that this module wrote; None for any other."""
    text = (uri or "").strip("<>")
    return int(text[len(ID) :]) if text.startswith(ID) and text[len(ID) :].lstrip("-").isdigit() else None


def parse_record(data: bytes) -> dict | None:
    """Fields of one record; None for records that carry no page (``warcinfo``, ``request``, ``metadata`` and so on).

    The payload of a response is what follows the HTTP header, that of a resource the whole block. A SHA-1 digest
    in the record is checked.
    """
    whole = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    head, mark, block = whole.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/") or not mark:
        raise ValueError("not a WARC record")
    fields = header_fields(lines[1:])
    kind = fields.get("warc-type", "")
    if kind not in ("response", "revisit", "resource"):
        return None
    size = int(fields["content-length"])
    if len(block) < size:
        raise ValueError(f"record {fields.get('warc-record-id')} ends early")
    block = block[:size]
    http, _, payload = block.partition(b"\r\n\r\n") if kind != "resource" else (b"", b"", block)
    stated = header_fields(http.decode("latin-1").split("\r\n")[1:]).get("content-length", "")
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    url, revisit = fields.get("warc-target-uri"), kind == "revisit"
    if revisit:
        length = int(stated) if stated.isdigit() else None
    else:
        length, own = len(payload), base32_sha1(payload)
        chunked = b"chunked" in http.lower()   # such a digest may be that of the joined chunks
        if algorithm == "sha1" and len(digest) == 32 and digest.upper() != own and not chunked:
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
        digest = own
    if url and lines[0] == "WARC/1.0" and url[0] == "<" and url[-1] == ">":   # as some writers put it
        url = url[1:-1]
    return {"page_id": own_number(fields.get("warc-record-id")), "url": url,
            "payload_bytes": length, "payload_digest": digest or None, "record_type": kind,
            "refers_to": own_number(fields.get("warc-refers-to")) if revisit else None, "payload": None if revisit else payload}


READ_SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
               "refers_to long")


def read_packages(packages: DataFrame, *, payload: bool = True) -> DataFrame:
    """Records of ``packages(package)``: the directories are read first, then the record ranges, dealt evenly."""
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("package", pa.string()), ("start", pa.int64()), ("starts", pa.list_(pa.int64())),
                          ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for path in batch.column("package").to_pylist():
                rows = [dict(zip(kind.names, x)) for x in record_ranges(path)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    fields = READ_SCHEMA + (", payload binary" if payload else "")
    names = [x.split()[0] for x in fields.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        target = pa.schema([(x, kinds.get(x, pa.string())) for x in names])
        for batch in batches:
            for row in batch.to_pylist():
                system, local = place_of(row["package"])
                with system.open_input_file(local) as file:
                    data = read_range(file, row["start"], row["starts"][-1] + row["lengths"][-1])
                parsed = (parse_record(data[x : x + n]) for x, n in zip(row["starts"], row["lengths"]))
                records = [x for x in parsed if x is not None]
                if records:
                    yield pa.RecordBatch.from_pylist([{k: x[k] for k in names} for x in records], target)

    spark = packages.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = in_workers(packages.select("package").repartition(tasks),
        plan, "package string, start long, starts array<long>, lengths array<long>")
    return in_workers(ranges.repartition(tasks), read, fields)


def round_trip(pages: DataFrame, folder: str | None = None, *, least_bytes: int = 0) -> DataFrame:
    """Writes the packages and reads them back without payloads."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder, least_bytes=least_bytes), payload=False)
