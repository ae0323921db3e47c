"""Legacy archive converter: ARC files to WARC records, WARC files and back.

An ARC file opens with a version block whose body names the version and the fields of the header
lines that follow; each header line ends with the declared length of its record. The converter
follows those declarations and gives every record the identifier, timestamp, type and digests that
a WARC record carries. Records of equal payload are written once: the one with the largest page id
is the response, the others are revisits that refer to it.

Defined cases: null html is an empty payload; a null url is written as "unknown:"; spaces and
control characters of a url are percent-encoded; a null page id is lower than any other and comes
back as null; repeated rows that tie for the largest page id are all responses, each with an identifier
of its own, as it comes from its place in its archive; a header line that
does not parse is skipped, and a record cut off by the end of its file keeps the bytes there are.
Only the id, url and html columns of pages are read. Payloads are UTF-8 text, as the files are
written by Spark's text writer (one gzip stream a file).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.llm.common import binary, broadcast_if_small, materialise, scratch_path, small_batches

#: Field names of the two versions of ARC header lines (fixed by the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_IDS = uuid.UUID("5d6ef8a2-8f2c-5b0e-9f59-1b6d0f6c7a31")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "unknown:"


def _arc_line(version: int, url: str, date: str, mime: str, length: int, status: int, digest: str, at: int, name: str) -> bytes:
    middle = f"{status} {digest} - {at} {name} " if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {mime} {middle}{length}\n".encode()


def arc_file(name: str, version: int, date: str, pages: list[tuple[int | None, str | None, bytes]]) -> bytes:
    """An ARC file of the version that holds the pages as captured HTTP responses."""
    about = f"{version} 0 quellwerk\n{ARC_FIELDS[version]}\n\n".encode()
    out = bytearray(_arc_line(version, f"filedesc://{name}", date, "text/plain", len(about), 200, "-", 0, name) + about)
    for page_id, url, html in pages:
        shown = "" if page_id is None else str(page_id)
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {shown}\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html
        out += b"\n" + _arc_line(version, _url(url), date, "text/html", len(body), 200, base32_sha1(html), len(out) + 1, name) + body
    return bytes(out + b"\n")


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by name, body) of each record after the version block, as declared."""
    at, fields = 0, ARC_FIELDS[1].split()
    while at < len(content):
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        line = content[at:end].decode("utf-8", "replace")
        at = end + 1
        if not line.strip():
            continue
        names = fields
        if line.startswith("filedesc:"):
            names = ARC_FIELDS[2 if len(line.split(" ")) >= 10 else 1].split()
        values = line.rsplit(" ", len(names) - 1)  # from the right: only a url may hold spaces
        if len(values) < len(names) or not values[-1].isdigit():
            continue
        header = dict(zip(names, values, strict=True))
        body = content[at : at + int(values[-1])]
        at += int(values[-1])
        if line.startswith("filedesc:"):
            declared = body.decode("utf-8", "replace").split("\n")
            if len(declared) > 1 and declared[1].split():
                fields = declared[1].split()
        else:
            yield header, body


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20200101000000", file_bytes: int = 1 << 20) -> DataFrame:
    """(name, content): ARC files of about file_bytes each, of versions 1 and 2 by turns."""
    plain = pages.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{url_col}`").cast("string").alias("u"), F.col(f"`{html_col}`").alias("h"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            held, size = [], 0
            for k, (i, u, h) in enumerate(zip(batch.column("i").to_pylist(), batch.column("u").to_pylist(), binary(batch.column("h")), strict=True)):
                held.append((i, u, h.as_py()))
                size += len(held[-1][2])
                if size >= file_bytes or k == batch.num_rows - 1:
                    turn += 1
                    name = f"capture-{part:06d}-{turn:05d}.arc"
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_file(name, 1 + turn % 2, date, held)], pa.binary())], ["name", "content"])
                    held, size = [], 0

    return plain.mapInArrow(pack, "name string, content binary")


RECORD_SCHEMA = "record_id string, url string, ip string, warc_date string, http_header string, payload string, payload_bytes long, payload_digest string, page_id long"


def warc_date(arc_date: str) -> str:
    """A 14-digit ARC date (shorter ones are filled up) as a WARC timestamp."""
    d = (re.sub(r"\D", "", arc_date) + "00000101000000"[len(re.sub(r"\D", "", arc_date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert_arc(archives: DataFrame) -> DataFrame:
    """RECORD_SCHEMA rows of the ARC files in archives (name, content)."""
    names = [f.split(" ")[0] for f in RECORD_SCHEMA.split(", ")]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for place, (header, body) in enumerate(arc_records(content.as_py())):
                    head, gap, payload = body.partition(b"\r\n\r\n")
                    if not (body.startswith(b"HTTP/") and gap):
                        head, gap, payload = b"", b"", body
                    page = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r?$", head + b"\r")
                    digest, date = base32_sha1(payload), warc_date(header["Archive-date"])
                    identity = uuid.uuid5(_IDS, f"{name} {place} {header['URL']} {date} {digest}")
                    rows.append((f"<urn:uuid:{identity}>", header["URL"], header["IP-address"], date, (head + gap).decode("utf-8", "replace"), payload, len(payload), digest, int(page[1]) if page else None))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                columns[5] = pa.array(columns[5], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return archives.mapInArrow(convert, RECORD_SCHEMA)


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


#: Text that one row of the writer holds at least, unless a file ends; a file has so many rows.
CHUNK_BYTES, CHUNKS_A_FILE = 4 << 20, 8
#: Payloads repeated more often are looked up in a broadcast table of at most MOST_FREQUENT rows.
LEAST_FREQUENT, MOST_FREQUENT = 1000, 1 << 18


def _render(records: DataFrame) -> DataFrame:
    """Rows of text, each of whole WARC records, of CHUNK_BYTES or of one longer record; a row opens
    with a warcinfo record. The last line end of a row is left to the text writer."""

    def head(r: dict) -> bytes:
        about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_IDS, 'info ' + r['record_id'])}>"), ("WARC-Date", r["warc_date"]), ("Content-Type", "application/warc-fields")]
        return warc_record(about, b"software: quellwerk\r\nformat: WARC File Format 1.1\r\n")

    def one(r: dict, payload: bytes) -> bytes:
        revisit = r["response_id"] is not None
        block = r["http_header"].encode() + (b"" if revisit else payload)
        kind = "revisit" if revisit else "response" if r["http_header"] else "resource"
        shown = "" if r["page_id"] is None else str(r["page_id"])
        headers = [("WARC-Type", kind), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["warc_date"]), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]), ("Content-Type", "application/http; msgtype=response" if r["http_header"] else "text/html"), ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("WARC-Payload-Digest", "sha1:" + r["payload_digest"]), ("X-Page-Id", shown), ("X-Payload-Length", str(r["payload_bytes"]))]
        if revisit:
            headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", r["response_record"]), ("X-Refers-To-Page-Id", str(r["response_id"]))]
        return warc_record(headers, block)

    def row(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary()).cast(pa.string())], ["value"])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "payload"}
            for i, payload in enumerate(binary(batch.column("payload"))):
                r = {n: c[i] for n, c in columns.items()}
                made = one(r, payload.as_py())
                if held and size + len(made) > CHUNK_BYTES:
                    yield row(held)
                    held, size = [], 0
                if not held:
                    held.append(head(r))
                held.append(made)
                size += len(made)
        if held:
            yield row(held)

    return records.mapInArrow(render, "value string")


def write_warc(records: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes RECORD_SCHEMA rows as gzipped WARC files. Payloads are compared by digest and length;
    their largest page ids are found first, from rows without payload, and payloads move once. A
    file holds CHUNKS_A_FILE rows of text, so its bytes are bounded but for longer records."""
    keys = materialise(records.select("payload_digest", "payload_bytes", "page_id", "record_id").filter(F.col("payload_bytes") >= min_bytes), "warc-keys")
    largest = keys.groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).agg(F.max(F.struct("page_id", "record_id")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    largest = materialise(largest.filter("_n > 1"), "warc-repeats")
    # The most repeated payloads are a broadcast table of bounded size; their records then need no
    # second look, and are dealt by their own ids.
    often = F.col("_n") > max(LEAST_FREQUENT, keys.count() // MOST_FREQUENT)
    same = (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    marked = records.join(F.broadcast(largest.filter(often)), same, "left").withColumnRenamed("_first", "_often").drop("_digest", "_bytes", "_n")
    key = F.when(F.col("_often").isNull(), F.col("payload_digest")).otherwise(F.col("record_id"))
    joined = marked.join(broadcast_if_small(largest.filter(~often), 160), (key == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    first = F.coalesce("_often", "_first")
    repeats = first.isNotNull() & ~F.col("page_id").eqNullSafe(first["page_id"])
    typed = joined.select(*records.columns, F.when(repeats, first["page_id"]).alias("response_id"), F.when(repeats, first["record_id"]).alias("response_record"))
    _render(typed).write.option("compression", "gzip").option("maxRecordsPerFile", CHUNKS_A_FILE).text(path)


class _Stream:
    """Bytes of a WARC file, plain or gzipped (any number of members), read piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.zip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = bytes(self.data[self.at : self.at + (1 << 20)])
        self.at += len(piece)
        while self.zip and piece:
            self.held += self.zip.decompress(piece)
            piece = self.zip.unused_data
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
        if not self.zip:
            self.held += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        return self._cut(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        return self._cut(n)

    def _cut(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        block = stream.take(int(headers["Content-Length"]))
        stream.take(4)
        yield headers, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, url, page_id, payload_bytes, payload_digest, record_type, refers_to) of the
    files under path. The digest of every stored payload is computed anew and held against the
    record's own; a difference is an error."""
    names = ["record_id", "url", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in warc_records(content.as_buffer().to_pybytes()):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] != "revisit":
                        payload = block.partition(b"\r\n\r\n")[2] if h["Content-Type"].startswith("application/http") else block
                        if (base32_sha1(payload), len(payload)) != (digest, size):
                            raise ValueError(f"{h['WARC-Record-ID']}: payload and digest differ")
                    rows.append((h["WARC-Record-ID"], h["WARC-Target-URI"], int(h["X-Page-Id"]) if h["X-Page-Id"] else None, size, digest, h["WARC-Type"], int(h["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in h else None))
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "record_id string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, schema)


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    small_batches(spark)
    path = scratch_path(spark, "warc")
    write_warc(convert_arc(pages_to_arc(pages)), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS n, body, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS top FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform(range(0, 4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * k + 1)::INT, 5))::INT >> (15 - 5 * j)::INT) & 31) + 1, 1)), '')), '') AS digest FROM h)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""
