"""WARC records in ZIP packages: written with duplicates as revisits, read back by ranges without extraction.

A package holds one stored member ``archive/data.warc.gz`` (each record a gzip member of its own) and one index
``indexes/index.cdxj`` with a line for every record. The reader parses the end record, the ZIP64 records and the
central directory, finds the data of the stored members behind their local headers, reads the index, and then reads
records by ranges: neighbours go together up to ``span_bytes``, and spans are dealt over all tasks, so that one large
package is read by many of them. Data without an index, or in a deflated member, is read as a stream by one task.

Files are reached through ``pyarrow.fs``, which knows local and mounted folders and the common object stores. Packages
are written under new names, and only those of finished tasks are in the manifest, so tasks can be lost and run again.

Defined results: a null payload is an empty one; a null id is an empty record id, larger than every id when the smallest
is chosen; rows that repeat the smallest id of a group are responses like it; a null url is left out of the record; empty tables give no records.
A package that can't be parsed stops the job, or with ``unreadable="report"`` gives one row of record type
``unreadable``. Other columns of the pages are never read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_ID = "urn:page:"
_BLOCK = 1 << 20
SPAN_BYTES = 4 << 20
#: Signatures of the ZIP format (fixed values).
_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


class Member(NamedTuple):
    """One entry of a central directory; ``header`` is where its local header starts."""

    name: str
    method: int
    header: int
    packed: int
    size: int


class Unreadable(ValueError):
    """A package, index or record that doesn't follow its format."""


# files


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[5:]
    return pafs.FileSystem.from_uri(path)


def read_range(f, start: int, n: int) -> bytes:
    """Exactly ``n`` bytes from ``start``."""
    f.seek(start)
    parts, left = [], n
    while left:
        part = f.read(left)
        if not part:
            raise Unreadable(f"{n} bytes from {start} aren't there")
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


# directories


def _end_of_directory(f, size: int) -> tuple[int, int, int, int]:
    """Number of entries, where the central directory starts and ends, and how far its offsets are shifted by bytes before the package."""
    n = min(size, 22 + 0xFFFF)
    tail = read_range(f, size - n, n)
    at = tail.rfind(_END)
    while at >= 0 and (at + 22 > n or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != n):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise Unreadable("no end record of a ZIP directory")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = size - n + at
    wide = 0xFFFF == entries or 0xFFFFFFFF in (length, start)
    where = end - 20
    locator = read_range(f, where, 20) if where >= 0 else b""
    if locator[:4] == _LOCATOR64:  # some writers add the ZIP64 records to packages whose sizes would fit
        for end64 in (struct.unpack_from("<Q", locator, 8)[0], where - 56):  # the second where something precedes the package
            record = read_range(f, end64, 56) if 0 <= end64 <= where - 56 else b""
            if record[:4] == _END64:
                entries, length, start = struct.unpack_from("<QQQ", record, 32)
                end, wide = end64, False
                break
    if wide:
        raise Unreadable("no ZIP64 end record of a large package")
    if end - length < start:
        raise Unreadable("the central directory starts before the file")
    return entries, end - length, end, end - length - start


def directory(f, size: int) -> Iterator[Member]:
    """The entries of the central directory, which is read in blocks."""
    entries, at, end, shift = _end_of_directory(f, size)
    block, pos, found = b"", 0, 0
    while found < entries:
        if len(block) - pos < 46 + 3 * 0xFFFF and at < end:
            n = min(_BLOCK, end - at)
            block, pos = block[pos:] + read_range(f, at, n), 0
            at += n
        if block[pos : pos + 4] != _CENTRAL or len(block) - pos < 46:
            raise Unreadable(f"entry {found} of {entries} isn't a directory entry")
        flags, method = struct.unpack_from("<HH", block, pos + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", block, pos + 20)
        header = struct.unpack_from("<I", block, pos + 42)[0]
        name = block[pos + 46 : pos + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = block[pos + 46 + n_name : pos + 46 + n_name + n_extra]
        pos += 46 + n_name + n_extra + n_note
        k = 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # only the fields that don't fit are here, in this order
                longs = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                plain = next(longs) if plain == 0xFFFFFFFF else plain
                packed = next(longs) if packed == 0xFFFFFFFF else packed
                header = next(longs) if header == 0xFFFFFFFF else header
            k += 4 + n
        found += 1
        yield Member(name, method, header + shift, packed, plain)


def data_start(f, member: Member) -> int:
    """Where a member's bytes start, behind its local header."""
    local = read_range(f, member.header, 30)
    if local[:4] != _LOCAL:
        raise Unreadable(f"no local header of {member.name}")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


def _bytes_of(f, member: Member) -> Iterator[bytes]:
    """A member's plain bytes in blocks, whether stored or deflated."""
    at, end = data_start(f, member), 0
    end = at + member.packed
    if member.method not in (0, 8):
        raise Unreadable(f"{member.name} has compression method {member.method}")
    inflate = zlib.decompressobj(-15) if member.method == 8 else None
    while at < end:
        part = read_range(f, at, min(_BLOCK, end - at))
        at += len(part)
        yield inflate.decompress(part) if inflate else part
    if inflate:
        yield inflate.flush()


# records


def record_bytes(kind: str, page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A WARC/1.1 record: a response with an HTTP block, or a revisit without one."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_ID}{page_id}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        lines.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_ID}{refers_to}>")]
        block = b""
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class Record(NamedTuple):
    kind: str
    record_id: str
    uri: str | None
    refers_to: str | None
    declared: str | None
    payload: bytes


def _bare(value: str | None, prefix: str = _ID) -> str | None:
    return value if value is None else value.strip().removeprefix("<").removesuffix(">").removeprefix(prefix)


def parse_record(data: bytes) -> tuple[Record, int]:
    """The record at the start of ``data`` and its length; its payload is what follows the HTTP header, if there is one."""
    at = data.find(b"\r\n\r\n")
    if at < 0 or not data.startswith(b"WARC/"):
        raise Unreadable("no WARC header")
    head: dict[str, str] = {}
    for line in data[:at].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        head[name.strip().lower()] = value.strip()
    n = int(head["content-length"])
    block = data[at + 4 : at + 4 + n]
    if len(block) < n:
        raise Unreadable("a record is cut off")
    if head.get("content-type", "").startswith("application/http"):
        _, gap, body = block.partition(b"\r\n\r\n")
        block = body if gap else b""
    found = Record(head.get("warc-type", ""), _bare(head.get("warc-record-id", "")), head.get("warc-target-uri"), _bare(head.get("warc-refers-to")), _bare(head.get("warc-payload-digest"), "sha256:"), block)
    return found, at + 4 + n + 4


def _records_of(data: bytes) -> Record:
    return parse_record(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)[0]


def stream_records(blocks: Iterator[bytes]) -> Iterator[tuple[int, Record]]:
    """Records of a whole archive in sequence, gzipped one by one or plain, with their offsets; one record is held at a time."""
    held, at, done = b"", 0, False

    def more() -> bool:
        nonlocal held, done
        part = next(blocks, None)
        done = part is None
        held += part or b""
        return not done

    while held or more():
        while len(held) < 2 and more():
            pass
        if not held:
            return
        if held[:2] == b"\x1f\x8b":
            unzip, plain = zlib.decompressobj(31), []
            taken = 0
            while True:
                plain.append(unzip.decompress(held))
                taken += len(held) - len(unzip.unused_data)
                held = unzip.unused_data
                if unzip.eof:
                    break
                if not more():
                    raise Unreadable("a gzip member is cut off")
            yield at, parse_record(b"".join(plain))[0]
            at += taken
        else:
            while True:
                end = held.find(b"\r\n\r\n")
                if end >= 0:
                    size = next((int(x.split(b":")[1]) for x in held[:end].lower().split(b"\r\n") if x.startswith(b"content-length:")), 0)
                    if len(held) >= end + 8 + size:
                        break
                if not more():
                    raise Unreadable("a record is cut off")
            found, n = parse_record(held)
            yield at, found
            at += n
            held = held[n:]


# writing


def with_revisits(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """id, url, payload (of responses alone), payload_digest and refers_to of every page.

    Digests are counted before they are shuffled, and only digests of several pages are joined back: a small table, or
    a join on the digest in which a hot digest's rows can be split.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= least).groupBy(F.col("payload_digest").alias("same")).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    out = rows.join(groups, F.col("payload_digest") == F.col("same"), "left")
    again = F.col("same").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return out.select(F.col("id").cast("string").alias("id"), "url", F.when(~again, F.col("payload")).alias("payload"), "payload_digest", F.when(again, F.col("first")).cast("string").alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, package_bytes: int = 256 << 20, package_records: int = 50_000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every page as a WARC record into ZIP packages in ``folder``; returns the staged manifest (path, records).

    Of pages with equal payloads of at least ``least`` bytes, the one with the smallest id is a response and the others revisit it.
    A package ends at ``package_bytes`` or ``package_records``, whichever comes first.
    """
    rows = with_revisits(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, least=least)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(folder)
        files.create_dir(base, recursive=True)
        rest = (dict(zip(b.schema.names, row, strict=True)) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(rest, None)
        while row is not None:
            name = f"{base.rstrip('/')}/{uuid.uuid4().hex}.zip"
            with files.open_output_stream(name) as out, zipfile.ZipFile(out, "w") as package:
                at, index = 0, []
                with package.open(DATA, "w", force_zip64=True) as data:
                    while row is not None and at < package_bytes and len(index) < package_records:
                        kind, page = "response" if row["refers_to"] is None else "revisit", row["id"] or ""
                        record = gzip.compress(record_bytes(kind, page, row["url"], row["payload"] or b"", row["payload_digest"], row["refers_to"], date), 6, mtime=0)
                        data.write(record)
                        index.append(json.dumps({"offset": at, "length": len(record), "recordDigest": f"sha256:{row['payload_digest']}", "type": kind, "filename": DATA.rpartition("/")[2]}))
                        at += len(record)
                        row = next(rest, None)
                stamp = "".join(x for x in date if x.isdigit())[:14]
                package.writestr(INDEX, "".join(f"{k} {stamp} {x}\n" for k, x in enumerate(index)))
                package.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": "data", "path": DATA, "bytes": at}, {"name": "index", "path": INDEX}]}))
            yield pa.RecordBatch.from_arrays([pa.array([name if folder.startswith(("/", "file:")) else f"{folder.rstrip('/')}/{name.rpartition('/')[2]}"]), pa.array([len(index)], pa.int64())], ["path", "records"])

    return stage(rows.mapInArrow(write, "path string, records long"), "warc-manifest")


# reading


def list_packages(spark: SparkSession, folder: str) -> DataFrame:
    """path of every ZIP file in a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path")


def members(packages: DataFrame) -> DataFrame:
    """The central directories of packages: path, name, method, data_start, packed and size of each member."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = _file_system(path)
                with files.open_input_file(name) as f:
                    found = [(m, data_start(f, m)) for m in directory(f, f.size())]
                yield pa.RecordBatch.from_pylist([{"path": path, "name": m.name, "method": m.method, "data_start": at, "packed": m.packed, "size": m.size} for m, at in found], schema=shape)

    shape = pa.schema([("path", pa.string()), ("name", pa.string()), ("method", pa.int32()), ("data_start", pa.int64()), ("packed", pa.int64()), ("size", pa.int64())])
    return packages.select("path").mapInArrow(find, "path string, name string, method int, data_start long, packed long, size long")


def _index_entries(f, member: Member) -> Iterator[dict]:
    rest = b""
    for block in _bytes_of(f, member):
        *lines, rest = (rest + block).split(b"\n")
        yield from (json.loads(x[x.index(b"{") :]) for x in lines if b"{" in x)
    if b"{" in rest:
        yield json.loads(rest[rest.index(b"{") :])


def _spans(path: str, span_bytes: int) -> Iterator[dict]:
    """What is to be read of a package: runs of indexed records by range, or a whole member as a stream (``member``)."""
    files, name = _file_system(path)
    with files.open_input_file(name) as f:
        found = [m for m in directory(f, f.size())]
        data = {m.name.rpartition("/")[2]: m for m in found if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))}
        entries: dict[str, list[tuple[int, int]]] = {}
        for m in found:
            if m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj")):
                for e in _index_entries(f, m):
                    entries.setdefault(e["filename"], []).append((int(e["offset"]), int(e["length"])))
        for file, m in sorted(data.items()):
            if file not in entries or m.method != 0:
                yield {"path": path, "member": m.name, "start": 0, "lengths": []}
                continue
            base = data_start(f, m)
            start, end, lengths = None, None, []
            for at, n in sorted(set(entries[file])):
                if at < 0 or at + n > m.packed:
                    raise Unreadable(f"an index entry lies outside {m.name}")
                if start is not None and (at != end or at + n - start > span_bytes):
                    yield {"path": path, "member": None, "start": base + start, "lengths": lengths}
                    start = None
                if start is None:
                    start, lengths = at, []
                lengths.append(n)
                end = at + n
            if start is not None:
                yield {"path": path, "member": None, "start": base + start, "lengths": lengths}


_OUT = pa.schema([("path", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read_records(packages: DataFrame, *, span_bytes: int = SPAN_BYTES, with_payload: bool = True, unreadable: str = "fail", tasks: int | None = None) -> DataFrame:
    """Every record of the packages in column ``path``; payload_bytes and payload_digest are those of the bytes that were read.

    A revisit has no payload of its own; ``resolve`` gives it that of the record it refers to.
    """
    if unreadable not in ("fail", "report"):
        raise ValueError("unreadable is 'fail' or 'report'")
    shape = pa.schema([*_OUT, ("payload", pa.binary())]) if with_payload else _OUT
    lost = {"record_type": "unreadable"}

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("member", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    rows = list(_spans(path, span_bytes))
                except (Unreadable, struct.error, KeyError, ValueError, OSError, zlib.error):
                    if unreadable == "fail":
                        raise
                    rows = [{"path": path, "member": None, "start": -1, "lengths": []}]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    def row(path: str, r: Record) -> dict:
        own = r.kind != "revisit"
        out = {"path": path, "record_type": r.kind, "record_id": r.record_id, "target_uri": r.uri, "refers_to": r.refers_to, "declared_digest": r.declared, "payload_bytes": len(r.payload) if own else None, "payload_digest": hashlib.sha256(r.payload).hexdigest() if own else None}
        return out | {"payload": r.payload if own else None} if with_payload else out

    def of_span(s: dict) -> Iterator[dict]:
        files, name = _file_system(s["path"])
        with files.open_input_file(name) as f:
            if s["member"] is not None:
                for m in directory(f, f.size()):
                    if m.name == s["member"]:
                        yield from (row(s["path"], r) for _, r in stream_records(_bytes_of(f, m)))
                return
            data, at = read_range(f, s["start"], sum(s["lengths"])), 0
            for n in s["lengths"]:
                yield row(s["path"], _records_of(data[at : at + n]))
                at += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                if s["start"] < 0:
                    yield pa.RecordBatch.from_pylist([{"path": s["path"], **lost}], schema=shape)
                    continue
                held, size = [], 0
                try:
                    for r in of_span(s):
                        held.append(r)
                        size += (r["payload_bytes"] or 0) + 500
                        if size >= span_bytes:
                            yield pa.RecordBatch.from_pylist(held, schema=shape)
                            held, size = [], 0
                except (Unreadable, struct.error, KeyError, ValueError, OSError, EOFError, zlib.error):
                    if unreadable == "fail":
                        raise
                    held.append({"path": s["path"], **lost})
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=shape)

    spans = packages.select("path").mapInArrow(locate, "path string, member string, start long, lengths array<long>")
    spans = spans.repartition(tasks or int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")  # a number, else small rows are put together again
    kinds = "path string, record_type string, record_id string, target_uri string, refers_to string, declared_digest string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return spans.mapInArrow(read, kinds)


def resolve(records: DataFrame) -> DataFrame:
    """The records with payload_bytes and payload_digest of revisits taken from the response they refer to, by its id and the digest that was read.

    A revisit whose response isn't there keeps nulls. The records are read three times: stage them first.
    """
    revisit = F.col("record_type").eqNullSafe("revisit")
    again, others = records.filter(revisit), records.filter(~revisit)
    wanted = again.select(F.col("refers_to").alias("w_id"), F.col("declared_digest").alias("w_digest")).distinct()
    own = others.join(wanted, (F.col("record_id") == F.col("w_id")) & (F.col("payload_digest") == F.col("w_digest")), "left_semi")
    own = own.groupBy(F.col("record_id").alias("own_id"), F.col("payload_digest").alias("own_digest")).agg(F.max("payload_bytes").alias("own_bytes"))
    found = again.join(own, (F.col("refers_to") == F.col("own_id")) & (F.col("declared_digest") == F.col("own_digest")), "left")
    found = found.withColumn("payload_bytes", F.col("own_bytes")).withColumn("payload_digest", F.col("own_digest"))
    return others.unionByName(found.select(others.columns))


def digest(records: DataFrame, id_type: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of resolved records."""
    back = lambda c: F.when(F.col(c) != "", F.col(c)).cast(id_type)
    return records.select(back("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"))
