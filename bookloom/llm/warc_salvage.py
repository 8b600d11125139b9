"""WARC archives: a writer with revisit records and a reader that salvages.

The writer makes one gzip member a record. The reader takes records of any type, with or
without digests, and checks every member and record (header, lengths, what digests there
are); after a failed check it searches for the next place where a whole member or an
uncompressed record starts, goes on there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.shared import attach, read, scratch_dir, written
from bookloom.runtime import ship

MIN_REVISIT_BYTES = 1000
#: Bytes of payload in an archive, about: a file is read by one task.
FILE_BYTES = 32 << 20
MAX_RECORDS_A_FILE = 20_000
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/(?:1\.[01]|0\.1[78])\r\n")
START = re.compile(rb"\x1f\x8b\x08|" + VERSION.pattern)
STEP = 1 << 16
#: A gzip member ends with the high byte of its length, 0 below this many bytes.
SMALL = 1 << 24


def record_bytes(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    """One uncompressed record; digest is the payload's SHA-1 in hex."""
    block = HTTP + (payload if record_type == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if record_type == "revisit":
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {len(payload)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as a gzip member that ends with a zero byte: a record so large that
    its length doesn't end so gets an empty member behind it."""
    out = gzip.compress(record, 6, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", mtime=0)


def with_record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, record_type and
    refers_to."""
    html = F.coalesce("html", F.lit(""))
    sums = pages.select("page_id", "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    groups = written(sums.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
                     .agg(F.max("page_id").alias("_newest"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    n_rows = pages.count()
    out = attach(sums, groups, "payload_digest", n_rows)
    again = F.col("_newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_newest"))
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest",
                      F.when(again, "revisit").otherwise("response").alias("record_type"),
                      F.when(again, F.col("_newest")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, compress: bool = True) -> None:
    """Write pages as WARC files under path, a record each.

    Spark's text writer puts out each record's bytes; the byte it adds after a row is
    the record's own last byte, so a file is its records one after another.
    """
    ship(pages.sparkSession)
    typed = with_record_types(pages.select("page_id", "url", "html"))
    mean = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit(""))))).first()[0] or 0
    records_a_file = int(min(MAX_RECORDS_A_FILE, max(1, FILE_BYTES // (mean + 500))))

    def records(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                payload = (x["html"] or "").encode("utf-8", "surrogatepass")
                one = record_bytes(x["page_id"], x["url"], payload, x["payload_digest"], x["record_type"], x["refers_to"])
                out.append((member(one) if compress else one)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (typed.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\0" if compress else "\n").option("maxRecordsPerFile", records_a_file).text(path))


def digest_of(text: str):
    """(algorithm, digest in hex) of sha1:..., in hex or base32; the algorithm is None
    where it is none of hashlib's or the digest has another length."""
    name, _, value = text.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None, value.strip().lower()
    size = hashlib.new(name, usedforsecurity=False).digest_size
    value = value.strip()
    if re.fullmatch(rf"[0-9A-Fa-f]{{{2 * size}}}", value):
        return name, value.lower()
    try:
        decoded = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None, value.lower()
    return (name if len(decoded) == size else None), decoded.hex()


def check_digest(fields: dict, name: str, data: bytes) -> None:
    algorithm, want = digest_of(fields[name]) if name in fields else (None, "")
    if algorithm and hashlib.new(algorithm, data, usedforsecurity=False).hexdigest() != want:
        raise ValueError(name.removeprefix("warc-").replace("-", " ") + " differs")


def parse_record(data, at: int = 0):
    """(fields, payload, end) of the uncompressed record at `at`; ValueError says what
    is wrong with it. The payload of an HTTP message is what stands behind its head, that
    of any other record its block."""
    match = VERSION.match(data, at)
    if not match:
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("header without end")
    fields, name = {}, ""
    for line in bytes(data[match.end():stop]).decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:  # a folded line
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without colon")
        name = name.strip().lower()
        fields[name] = value.strip()
    if not re.fullmatch("[0-9]{1,15}", fields.get("content-length", "")):
        raise ValueError("no content length")
    first = stop + 4
    end = first + int(fields["content-length"])
    if bytes(data[end:end + 4]) != b"\r\n\r\n":
        raise ValueError("record without end")
    block = bytes(data[first:end])
    check_digest(fields, "warc-block-digest", block)
    payload = block
    if fields.get("content-type", "").lower().startswith("application/http") or block[:5] == b"HTTP/":
        head, gap, body = block.partition(b"\r\n\r\n")
        payload = body if gap else b""
    if fields.get("warc-type") in ("response", "resource", "conversion") and "warc-segment-number" not in fields:
        check_digest(fields, "warc-payload-digest", payload)
    return fields, payload, end + 4


def inflate(data: bytes, at: int):
    """(content, end) of the gzip member at `at`."""
    reader, out, view = zlib.decompressobj(31), [], memoryview(data)
    while not reader.eof:
        part = view[at:at + STEP]
        if not len(part):
            raise ValueError("member without end")
        try:
            out.append(reader.decompress(part))
        except zlib.error as x:
            raise ValueError(f"member: {x}") from None
        at += len(part) - len(reader.unused_data)
    return b"".join(out), at


def salvage(data: bytes):
    """Yield ("record", offset, length, fields, payload) and ("gap", offset, length,
    reason, None) so that they cover data."""
    at, bad, reason = 0, None, ""

    def gap(until):
        return ("gap", bad, until - bad, reason, None)

    while at < len(data):
        try:
            if data[at:at + 3] == b"\x1f\x8b\x08":
                content, end = inflate(data, at)
                found = []
                inner = 0
                while inner < len(content):
                    fields, payload, inner = parse_record(content, inner)
                    found.append((fields, payload))
            else:
                fields, payload, end = parse_record(data, at)
                found = [(fields, payload)]
        except ValueError as x:
            if bad is None:
                bad, reason = at, str(x)
            later = START.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if bad is not None:
            yield gap(at)
            bad = None
        for fields, payload in found:
            yield ("record", at, end - at, fields, payload)
        at = end
    if bad is not None:
        yield gap(len(data))


READ_SCHEMA = ("path string, kind string, offset long, length long, reason string, record_type string, page_id long, url string, "
               "payload_bytes long, payload_digest string, refers_to long, payload binary")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of kind `record` and `gap` of every file under path. page_id is null where a
    record's id is none that write_archives makes; a missing payload digest is computed. A
    file is read by one task, which holds it: files of up to some hundred MB."""

    ship(spark)

    def number(text):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]

    def of_batches(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for kind, offset, length, fields, payload in salvage(data.as_py()):
                    row = dict.fromkeys(names) | {"path": name, "kind": kind, "offset": offset, "length": length}
                    if kind == "gap":
                        row["reason"] = fields
                    else:
                        size = fields.get("x-payload-length", "")
                        row |= {"record_type": fields.get("warc-type"), "page_id": number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
                                "payload_bytes": int(size) if size.isdigit() else len(payload), "refers_to": number(fields.get("warc-refers-to")),
                                "payload_digest": digest_of(fields["warc-payload-digest"])[1] if "warc-payload-digest" in fields else hashlib.sha1(payload, usedforsecurity=False).hexdigest(),
                                "payload": payload if payloads else None}
                    rows.append(row)
                    if len(rows) == 500:
                        yield to_batch(rows)
                        rows = []
                if rows:
                    yield to_batch(rows)

    def to_batch(rows):
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[x.split()[1]]) for n, x in zip(names, READ_SCHEMA.split(", "))], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(of_batches, READ_SCHEMA)


def op8_warc_salvage(spark, sf_dir: str) -> DataFrame:
    """Write every page, read the archives back.

    Defined cases: a null html has the empty payload, a null url no target; rows that
    repeat a page_id with the largest page_id of their payload are all responses; a null
    page_id comes back null; an empty table gives no rows.
    """
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    pages = read(spark, sf_dir, "pages")
    write_archives(pages, path)
    found = read_archives(spark, path, payloads=False)
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
