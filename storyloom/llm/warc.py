"""Legacy archives to WARC: ARC files of version 1 or 2 are parsed by their header lines and declared lengths and
rewritten as WARC records with synthesised identifiers, timestamps, types and digests.

Archives are real files in a folder that Spark writes (gzip, one stream a file): a task puts records with the format's
separator one after another and begins a new archive once ``ARCHIVE_BYTES`` are full, so reading one whole keeps memory
bounded. Of records with equal payloads (same SHA-1 and length) the one of the smallest key stays a
response and the others become revisits; only digests are shuffled for that, and hot digests are salted.

Defined results: a null payload is empty; a null url is ``unknown:``; white space in a url is percent-encoded; a null
key comes back as null and is larger than any other; among equal keys the place in the archives decides. Extra columns
are ignored. A header line of the wrong form, a length beyond the file's end or an unknown version raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import discard, fresh_path, materialize

#: Bytes of an archive (the last record may go beyond), and copies of a digest that many records have.
ARCHIVE_BYTES, SALTS = 8 << 20, 16
#: Field names of the two versions' header lines (fixed values of the format).
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("5a1f0c56-4f0e-5d53-9a56-0d7f6f0f3f11")


@dataclass
class ArcRecord:
    """A record of an ARC file: its header fields by name, its offset in the uncompressed file, its bytes."""

    fields: dict[str, str]
    offset: int
    block: bytes


def unpacked(data: bytes) -> io.BufferedIOBase | io.BytesIO:
    """A reader of an archive's bytes, through gzip (of one or many members) where it has that."""
    if data[:2] != b"\x1f\x8b":
        return io.BytesIO(data)
    import gzip

    return gzip.GzipFile(fileobj=io.BytesIO(data))


def read_arc(stream) -> Iterator[ArcRecord]:
    """The records of an ARC stream, the version block first."""
    offset, names = 0, FIELDS[1].split()
    while line := stream.readline():
        begin, offset = offset, offset + len(line)
        if not line.strip():
            continue
        line = line.decode("utf-8", "replace").rstrip("\r\n")
        if begin == 0:
            # the version block's own line has the fields of either version
            names = FIELDS[2 if len(line.split(" ")) >= 10 else 1].split()
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"not a header line of {len(names)} fields at {begin}: {line[:100]!r}")
        block = stream.read(int(parts[-1]))
        if len(block) < int(parts[-1]):
            raise ValueError(f"the record at {begin} declares {parts[-1]} bytes; {len(block)} are left")
        offset += len(block)
        yield ArcRecord(dict(zip(names, parts)), begin, block)
        if begin == 0 and parts[0].startswith("filedesc:"):
            version = block.split(b"\n", 1)[0].split(b" ")[0]
            if version not in (b"1", b"2"):
                raise ValueError(f"an unknown ARC version: {version[:20]!r}")
            names = FIELDS[int(version)].split()


def arc_header(version: int, url: str, ip: str, date: str, kind: str, length: int, name: str) -> bytes:
    extra = f" 200 - - 0 {name}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{extra} {length}\n".encode()


def arc_version_block(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 storyloom\n{FIELDS[version]}\n\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(block), name) + block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The head (with its empty line) and the payload of an HTTP response."""
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if block[:5] == b"HTTP/" and m else (b"", block)


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: str) -> str:
    """An ARC date of 4 to 14 digits as a WARC timestamp; missing parts are the first month, day or second."""
    d = re.sub(r"\D", "", date)[:14]
    d = d + "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    """The identifier of the record at an archive's offset: the same each time it is converted."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{archive}#{offset}')}>"


def to_warc(record: ArcRecord, archive: str, refers: tuple[str, int, str] | None = None, key_header: str = "X-Record-Key") -> bytes:
    """A WARC record (without its closing separator). ``refers``: archive, offset and key of the record it revisits."""
    url, block = record.fields["URL"], record.block
    head, payload = split_http(block)
    lines = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(archive, record.offset)), ("WARC-Date", warc_date(record.fields["Archive-date"]))]
    if record.offset == 0 and url.startswith("filedesc:"):  # the version block; elsewhere it is a page's own url
        lines[0] = ("WARC-Type", "warcinfo")
        lines.append(("WARC-Filename", url[len("filedesc://") :]))
        block = f"software: storyloom\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC {block[:1].decode()}\r\n".encode()
        lines.append(("Content-Type", "application/warc-fields"))
    elif not head:
        lines[0] = ("WARC-Type", "resource")
        lines += [("WARC-Target-URI", url), ("WARC-IP-Address", record.fields["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "text/dns" if url.startswith("dns:") else record.fields["Content-type"])]
    else:
        lines += [("WARC-Target-URI", url), ("WARC-IP-Address", record.fields["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
        if refers is not None:
            lines[0] = ("WARC-Type", "revisit")
            lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers[0], refers[1])), (f"{key_header}-Refers-To", refers[2])]
            block = head
    lines += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC version line: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("a record is cut short")
        yield fields, block


# --- folders of archives ---


def _binary_rows(values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])


def _write(rows: DataFrame, path: str, separator: str) -> None:
    """One file of each row, which is a whole archive."""
    text = rows.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """``archive`` (the path below the folder) and ``content`` of every archive of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def write_arcs(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "20240101000000", key_header: str = "X-Record-Key") -> None:
    """Write rows as ARC archives in ``path``: every other task writes version 2, the others version 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, n, records, size = 1 + part % 2, 0, [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for k, u, data in zip(*(c.slice(i, 64).to_pylist() for c in batch.columns)):
                    if not records:
                        name = f"part-{part:05d}-{n:05d}.arc"
                        records, n = [arc_version_block(version, name, date)], n + 1
                    data = data or b""
                    where = quote(u, safe="!#$%&'()*+,/:;=?@[]~") if u else "unknown:"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key_header}: {'' if k is None else k}\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                    records.append(arc_header(version, where, "0.0.0.0", date, "text/html", len(head) + len(data), name) + head + data)
                    size += len(records[-1])
                    if size >= ARCHIVE_BYTES:
                        yield _binary_rows([b"\n".join(records)])
                        records, size = [], 0
        if records:
            yield _binary_rows([b"\n".join(records)])

    _write(pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(payload).cast("binary")).mapInArrow(run, "value binary"), path, "\n")


_INDEX = "archive string, offset long, key long, payload_bytes long, payload_digest string"


def arc_index(arcs: DataFrame, key_header: str = "X-Record-Key") -> DataFrame:
    """Place, key, payload length and payload digest of every response in the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = [[], [], [], [], []]
                for r in read_arc(unpacked(content.as_py())):
                    head, payload = split_http(r.block)
                    if head:
                        k = http_field(head, key_header)
                        for column, v in zip(out, (name, r.offset, int(k) if k else None, len(payload), digest(payload))):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[f.split()[0] for f in _INDEX.split(", ")])

    return arcs.mapInArrow(run, _INDEX)


def revisits(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``archive, again array<struct<offset, archive, first, key>>``: the records that revisit another, by archive."""
    order = F.struct(F.col("key").isNull().alias("none"), "key", "archive", "offset")
    groups = index.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1")
    salted = groups.select("payload_digest", "payload_bytes", "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = index.withColumn("salt", F.pmod(F.xxhash64("archive", "offset"), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "payload_bytes", "salt"])
    again = rows.where("NOT (f.archive = archive AND f.offset = offset)")
    return again.groupBy("archive").agg(F.collect_list(F.struct("offset", F.col("f.archive").alias("archive"), F.col("f.offset").alias("first"), F.col("f.key").alias("key"))).alias("again"))


def convert(arcs: DataFrame, path: str, again: DataFrame | None = None, key_header: str = "X-Record-Key") -> None:
    """Write the WARC archives of ARC archives (``archive, content``) in ``path``; ``again``: see ``revisits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                name = batch.column(0)[r].as_py()
                refers = {a["offset"]: (a["archive"], a["first"], "" if a["key"] is None else str(a["key"])) for a in batch.column(2)[r].as_py() or []}
                records = [to_warc(record, name, refers.get(record.offset), key_header) for record in read_arc(unpacked(batch.column(1)[r].as_py()))]
                yield _binary_rows([b"\r\n\r\n".join(records)])

    none = F.lit(None).cast("array<struct<offset: long, archive: string, first: long, key: long>>")
    rows = arcs.join(again, "archive", "left").select("archive", "content", "again") if again is not None else arcs.withColumn("again", none)
    _write(rows.mapInArrow(run, "value binary"), path, "\r\n\r\n")


_RECORDS = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def warc_records(warcs: DataFrame, key_header: str = "X-Record-Key") -> DataFrame:
    """Responses and revisits read back from WARC archives; digests and lengths of whole payloads are recomputed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                out = [[], [], [], [], []]
                for fields, block in read_warc(unpacked(content.as_py())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    own, declared = digest(payload), fields["warc-payload-digest"].partition(":")[2]
                    if kind == "response" and own != declared:
                        raise ValueError(f"a payload's digest is {own}, not {declared}")
                    k, to = http_field(head, key_header), fields.get(f"{key_header}-Refers-To".lower())
                    size = len(payload) if kind == "response" else int(http_field(head, "Content-Length"))
                    for column, v in zip(out, (int(k) if k else None, size, declared, kind, int(to) if to else None)):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=[f.split()[0] for f in _RECORDS.split(", ")])

    return warcs.mapInArrow(run, _RECORDS)


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write rows as ARC archives, convert these to WARC and read the records back."""
    spark = pages.sparkSession
    arc_path, warc_path = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arcs(pages, arc_path, key, url, payload)
    index, index_path = materialize(arc_index(archives(spark, arc_path)), "arc-index")
    convert(archives(spark, arc_path), warc_path, revisits(index, min_bytes))
    discard(spark, arc_path, index_path)
    return warc_records(archives(spark, warc_path))
