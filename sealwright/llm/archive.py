"""Legacy web archives: ARC files, and their conversion to WARC.

An ARC file (version 1 or 2) begins with a `filedesc:` record that declares the version; each
record is a header line of space-separated fields that ends with the content's length in bytes, the
content, and a line feed. A WARC record has named fields, a block of declared length, and two
line ends. In the WARC files every record is a gzip member of its own; Spark's text writer writes a member a row, and
files of a bounded number of records are read member by member.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.llm.hot import hot_keys, join_hot
from sealwright.llm.scratch import kept

# The field names of ARC header lines, by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
# Fixed value: the profile of revisit records of identical payloads in WARC 1.0.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"
_STEP = 1 << 16  # bytes of a file given to the decompressor at once
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc").bytes[:6]


def arc_file_header(version: int, name: str, when: str) -> bytes:
    """The filedesc record an ARC file begins with: it declares the version and the fields of all header lines."""
    body = f"{version} 0 converter\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", when, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, ip: str, when: str, mime: str, content: bytes, status: int = 200, offset: int = 0, name: str = "-") -> bytes:
    """One ARC record. Spaces and line ends in the URL are escaped, since the header splits at them."""
    safe = (url or "-").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")
    fields = [safe, ip, when, mime]
    if version == 2:
        fields += [str(status), "-", "-", str(offset), name]
    return " ".join([*fields, str(len(content))]).encode() + b"\n" + content + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file after its filedesc record: header fields by name, and content.

    Only the file's first record declares it, whatever URLs the others have. Raises ValueError where a header line doesn't fit the declared version, or the data ends early.
    """
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":  # blank lines may stand between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line without end at byte {at}")
        parts = data[at:end].decode("utf-8").split(" ")
        size = int(parts[-1])
        content = data[end + 1 : end + 1 + size]
        if len(content) != size:
            raise ValueError(f"record at byte {at} declares {size} bytes, {len(content)} follow")
        at = end + 1 + size
        if names is None:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("the file doesn't begin with a filedesc record")
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            names = ARC_FIELDS[version]
            continue
        if len(parts) != len(names):
            raise ValueError(f"header line of {len(parts)} fields at byte {end}")
        yield dict(zip(names, parts)) | {"content": content, "version": 1 if len(names) == 5 else 2}


def record_uuid(number: int) -> str:
    """A record identifier made from a 64-bit number, from which the number can be read again."""
    n = (number & ((1 << 64) - 1)).to_bytes(8, "big")
    raw = bytearray(16)
    raw[0:6] = _SPACE
    raw[6], raw[7] = 0x80, n[0]  # version 8: the layout is our own
    raw[8], raw[9:16] = 0x80, n[1:]
    return str(uuid.UUID(bytes=bytes(raw)))


def number_of(identifier: str) -> int:
    """The number a record_uuid was made from."""
    raw = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).bytes
    return int.from_bytes(raw[7:8] + raw[9:16], "big", signed=True)


def warc_time(arc_date: str) -> str:
    """YYYYMMDDhhmmss (shorter dates count from their start) as ISO 8601 in UTC."""
    full = arc_date + "00000101000000"[len(arc_date) :]
    return datetime.strptime(full[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(number: int, url: str, when: str, mime: str, payload: bytes, status: str = "200", refers_to: int | None = None) -> bytes:
    """A response record of an HTTP reply, or a revisit record that names the record of the same payload."""
    digest = hashlib.sha1(payload).digest()
    head = f"HTTP/1.0 {status} OK\r\nContent-Type: {mime}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{record_uuid(number)}>",
        f"WARC-Date: {warc_time(when)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:uuid:{record_uuid(refers_to)}>", f"WARC-Profile: {SAME_PAYLOAD}"]
    return "\r\n".join([*fields, f"Content-Length: {len(block)}", "", ""]).encode() + block + RECORD_END


def gzip_members(data: bytes) -> Iterator[bytes]:
    """What each gzip member of a file holds; zero bytes may stand between members."""
    view, at = memoryview(data), 0
    while at < len(data):
        if not view[at]:
            at += 1
            continue
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(data):
                raise ValueError("the last gzip member doesn't end")
            part = view[at : at + _STEP]
            out.append(d.decompress(part))
            at += len(part) - len(d.unused_data)
        yield b"".join(out)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record; ValueError where the data breaks the format."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8").split("\r\n")[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where it declares")
        yield fields, block
        at = end + 8 + size


def pages_to_arc(pages: DataFrame, when: str = "20090102030405", version_of: str = "pmod(page_id, 2) + 1") -> DataFrame:
    """Pages (page_id, url, html) as ARC files, one for each batch and version: column arc (binary), and ids in record order.

    Null urls are written as `-`; a null html is an empty payload. The id travels beside the file,
    since ARC has no field for it.
    """

    def run(batches):
        for batch in batches:
            for version in (1, 2):
                ids, parts = [], [arc_file_header(version, "pages.arc", when)]
                for page_id, url, html, v in zip(*(c.to_pylist() for c in batch.columns)):
                    if v == version:
                        ids.append(page_id)
                        parts.append(arc_record(version, url, "0.0.0.0", when, "text/html", (html or "").encode()))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["arc", "ids"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.withColumn("version", F.coalesce(F.expr(version_of), F.lit(1)).cast("int")).mapInArrow(run, "arc binary, ids array<bigint>")


def read_arc(arcs: DataFrame) -> DataFrame:
    """Records of ARC files (columns arc, ids): page_id, url, arc_date, mime, status, payload, digest, payload_bytes."""

    def run(batches):
        names = ["page_id", "url", "arc_date", "mime", "status", "payload", "digest", "payload_bytes"]
        for batch in batches:
            for arc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for page_id, r in zip(ids, parse_arc(arc), strict=True):
                    c = r["content"]
                    rows.append((page_id, r["URL"], r["Archive-date"], r["Content-type"], r.get("Result-code", "200"), c, hashlib.sha1(c).hexdigest(), len(c)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), *[pa.string()] * 4, pa.large_binary(), pa.string(), pa.int64()])], names)

    return arcs.mapInArrow(run, "page_id long, url string, arc_date string, mime string, status string, payload binary, digest string, payload_bytes long")


def mark_revisits(digests: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, digest, payload_bytes) with refers_to: the largest page_id of equal payloads of at
    least least_bytes, null for that page itself and for all others. Null ids refer to nothing."""
    large = digests.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    groups = large.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1")
    marked = join_hot(large, groups.drop("n"), "digest", "page_id", hot_keys(groups, "digest")).where("page_id < newest")
    return marked.select("page_id", "digest", F.col("newest").alias("refers_to")).distinct()


def write_warc(records: DataFrame, path: str, file_records: int = 4096) -> None:
    """Writes records (with refers_to) as WARC files under path, each record a gzip member.

    The text writer ends every row with a zero byte. A member's last byte is the highest of its length, so zero under
    16 MB: the row is the member without it. After longer ones the zero is padding, which readers skip.
    """

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            members = (gzip.compress(warc_record(i or 0, u, d, m, p, s, ref), 3, mtime=0) for i, u, d, m, s, p, ref in rows)
            yield pa.RecordBatch.from_arrays([pa.array([m[:-1] if m[-1] == 0 else m for m in members], pa.large_binary())], ["value"])

    out = records.select("page_id", "url", "arc_date", "mime", "status", "payload", "refers_to").mapInArrow(run, "value binary")
    out.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", file_records).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Reads WARC files back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, warc_date.

    A revisit's payload is that of the record it refers to: its length is the one its own HTTP
    head declares. A response's digest is taken from its payload and must equal the declared one.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "warc_date"]

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for f, block in (record for member in gzip_members(content) for record in parse_warc(member)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    declared = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = int(head.rsplit(b"Content-Length: ", 1)[1])
                    if f["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != declared):
                        raise ValueError(f"the payload of {f['WARC-Record-ID']} isn't the one declared")
                    ref = f.get("WARC-Refers-To")
                    rows.append((number_of(f["WARC-Record-ID"]), size, declared, f["WARC-Type"], None if ref is None else number_of(ref), f["WARC-Target-URI"], f["WARC-Date"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()])], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string")


def convert(pages: DataFrame, path: str, least_bytes: int = 1000) -> DataFrame:
    """Pages to ARC, ARC to WARC files under path (which must not exist), and the files read back.

    Pages of null id are left out, since a record's identifier comes from it. Repeated rows give a
    record each. A null html is an empty payload, a null url is `-`; URLs may look like anything, as `filedesc:`. An empty table gives no rows. Files hold a bounded
    number of records; one task holds a file, or a record however large.
    """
    records = read_arc(pages_to_arc(pages.where(F.col("page_id").isNotNull())))
    # digests are kept without the payloads, which are parsed once more for the writing instead of being written twice
    marked = mark_revisits(kept(records.select("page_id", "digest", "payload_bytes"), "digests"), least_bytes)
    spark = pages.sparkSession
    write_warc(records.join(marked, ["page_id", "digest"], "left"), path)
    return read_warc(spark, path)
