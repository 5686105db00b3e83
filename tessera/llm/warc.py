"""WARC: an archive writer and a salvage reader.

The writer makes one gzip member per record and lets Spark's text sink write the bytes, so the
output is committed by Spark and needs only Spark's file systems: members are joined by an empty
member, which is valid gzip. The reader checks every record (length, end mark, digest). After a
failed check it searches for the next gzip member or version line that holds a valid record, goes on
there, and logs the bytes between as a quarantined gap. The same search runs inside a member: of one
with a damaged record, or one that is cut off or fails its checksum, the records that can be read are kept.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import shared_dir, stage, table

#: Payloads of so many bytes at least are stored once.
MIN_REVISIT_BYTES = 100
#: Payloads that repeat, up to which their digests are broadcast (about 100 bytes each).
BROADCAST_DIGESTS = 100_000
#: Records in a file at most: the reader holds one file in memory.
RECORDS_PER_FILE = 2_000
#: Largest file that is read; a larger one fails the read with a message, it is never passed over.
MAX_FILE_BYTES = 1 << 30
#: Content of a gzip member at most; what a larger one holds beyond is quarantined, so a bomb can't fill a task.
MAX_MEMBER_BYTES = 1 << 28
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000002ff03000000000000000000")
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]+\.[0-9]+\r?\n")
_RECORDS = "file string, start bigint, end bigint, gap string, type string, record_id string, refers_to string, uri string, payload_bytes bigint, payload_digest string, header_digest string, payload binary"


def _urn(x) -> str:
    """A record id; percent signs keep line feeds and brackets out of the header and tell an empty id (%) from none."""
    return f"<urn:page:{'' if x is None else quote(str(x), safe='') or '%'}>"


def record(page_id, uri: str | None, digest: str, first, payload: bytes) -> bytes:
    """A WARC record: a response with its payload, or a revisit to the page ``first``."""
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if uri:
        head.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", uri)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    block = b""
    if first is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head += [("Content-Type", "application/http; msgtype=response")]
    else:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(first))]
    head += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_warc(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One record per row of df, below path. A null html is an empty payload, a null url has no target.

    Of the rows with equal payloads of MIN_REVISIT_BYTES or more, those with the smallest id are
    responses and the rest revisits to it; a row without an id is a revisit if any row with that
    payload has an id. Repeated rows are repeated records. An empty table writes no record. Other
    columns don't matter. Only ids and digests are shuffled unless very many payloads repeat.
    """
    bytes_ = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = df.select(F.col(page_id).alias("id"), F.col(url).alias("url"), bytes_.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.length("payload") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    large = stage(large, "warc-digests")
    if large.count() <= BROADCAST_DIGESTS:
        large = F.broadcast(large)
    first = F.when(F.col("first").eqNullSafe(F.col("id")), None).otherwise(F.col("first"))
    rows = rows.join(large.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left").select("id", "url", "digest", first.alias("first"), F.when(first.isNull(), F.col("payload")).alias("payload"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500).to_pydict()
                out = [gzip.compress(record(i, u, d, f, p or b""), 6, mtime=0) for i, u, d, f, p in zip(*(part[c] for c in ("id", "url", "digest", "first", "payload")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    packed = rows.mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class Damaged(Exception):
    pass


class _Blanks:
    """Places of blank lines, each looked for once as long as one asks from left to right."""

    _LINE = re.compile(rb"\r?\n\r?\n")

    def __init__(self, data: bytes) -> None:
        self.data, self.since, self.found = data, 0, self._LINE.search(data)

    def after(self, at: int) -> re.Match | None:
        if at < self.since or self.found and self.found.start() < at:
            self.since, self.found = at, self._LINE.search(self.data, at)
        return self.found


def _parse(data: bytes, at: int, blanks: _Blanks) -> tuple[int, dict, bytes]:
    """The record at a version line: its end, headers (lower case) and block. Raises Damaged.

    Headers are read up to the first bad line, and a version line is one: a run of them costs one look each."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    close = blanks.after(version.end() - 1)
    if not close:
        raise Damaged("headers don't end")
    head, pos = {}, version.end()
    while pos <= close.start():
        stop = data.find(b"\n", pos, close.start())
        stop = close.start() if stop < 0 else stop
        name, colon, value = data[pos:stop].partition(b":")
        if not colon:
            raise Damaged("bad header")
        head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        pos = stop + 1
    length = head.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    end = close.end() + int(length)
    mark = _Blanks._LINE.match(data, end)
    if end > len(data) or not mark:
        raise Damaged("block doesn't end where its length says")
    return mark.end(), head, data[close.end() : end]


def _payload(head: dict, block: bytes) -> bytes:
    """The block without its HTTP headers; raises Damaged if a digest in the headers (SHA-256, base 16) differs."""
    body = block
    if head.get("content-type", "").startswith("application/http"):
        cut = re.compile(rb"\r?\n\r?\n").search(block)
        body = block[cut.end() :] if cut else b""
    wanted = head.get("warc-block-digest", "")
    if wanted.startswith("sha256:") and wanted[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest differs")
    wanted = head.get("warc-payload-digest", "")
    if head.get("warc-type") != "revisit" and wanted.startswith("sha256:") and wanted[7:] != hashlib.sha256(body).hexdigest():
        raise Damaged("payload digest differs")
    return body


def _fed(d, chunk: bytes, out: list[bytes]) -> tuple[bool, str]:
    """Whether a chunk could be decompressed whole, and the fault; out gets what comes out before the byte that fails,
    which is found by halves."""
    while chunk:
        before = d.copy()
        try:
            out.append(d.decompress(chunk))
            return True, ""
        except zlib.error as e:
            fault, d = f"gzip: {e}", before
        half = chunk[: len(chunk) // 2]
        if not half:
            break
        trial = d.copy()
        try:
            out.append(trial.decompress(half))
            d, chunk = trial, chunk[len(half) :]
        except zlib.error:
            chunk = half
    return False, fault


def _member(data: bytes, at: int) -> tuple[int | None, bytes, str | None]:
    """End, content and fault of the gzip member at a place. With a fault there is no end, and the content
    is what comes out before it."""
    d, pos, out, size, step = zlib.decompressobj(31), at, [], 0, 64
    while not d.eof and pos < len(data):
        held = len(out)
        good, fault = _fed(d, data[pos : pos + step], out)
        size += sum(map(len, out[held:]))
        if not good:
            return None, b"".join(out), fault
        if size > MAX_MEMBER_BYTES:
            return None, b"".join(out)[:MAX_MEMBER_BYTES], f"gzip member of over {MAX_MEMBER_BYTES} bytes"
        pos, step = pos + step, min(65536, 4 * step)  # 64 KB give 64 MB at most
    if not d.eof:
        return None, b"".join(out), "gzip member doesn't end"
    return min(pos, len(data)) - len(d.unused_data), b"".join(out), None


def _record(data: bytes, at: int, blanks: _Blanks) -> tuple[int, dict, bytes]:
    end, head, block = _parse(data, at, blanks)
    return end, head, _payload(head, block)


def _inside(plain: bytes) -> list[tuple[str | None, dict, bytes]]:
    """Records of a member's content, and the reasons of the gaps between them."""
    pos, found, blanks = 0, [], _Blanks(plain)
    while pos < len(plain):
        lost, end, why = pos, None, None
        while end is None and pos < len(plain):
            try:
                end, head, body = _record(plain, pos, blanks)
            except Damaged as e:
                why = why or str(e)
                m = _VERSION.search(plain, pos + 1)
                pos = m.start() if m else len(plain)
        if why:
            found.append((f"{why}; decompressed bytes {lost} to {pos} of the member", {}, b""))
        if end is not None:
            found.append((None, head, body))
            pos = end
    return found


def _take(data: bytes, at: int, blanks: _Blanks) -> tuple[int | None, list[tuple[str | None, dict, bytes]], str | None]:
    """End, records (and gaps) and fault of the member or the record at a place. Raises Damaged if no record can be read."""
    if data[at : at + 2] != b"\x1f\x8b":
        end, head, body = _record(data, at, blanks)
        return end, [(None, head, body)], None
    end, plain, fault = _member(data, at)
    found = _inside(plain)
    if (found or fault) and all(why for why, _, _ in found):
        raise Damaged(fault or found[0][0])
    return end, found, fault


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict, bytes]]:
    """(start, end, reason, headers, payload) of every record, and of every gap: with a reason and without headers.

    Start and end are places in data. A record inside a member has those of the member; a gap inside one
    has them too, and its reason tells the decompressed bytes. Each candidate is decoded once."""
    at, blanks, known = 0, _Blanks(data), None
    while at < len(data):
        try:
            end, found, fault = known or _take(data, at, blanks)
        except Damaged as e:
            end, found, fault = None, [], str(e)
        known = None
        if end is None:
            end = at
            while known is None and (m := _START.search(data, end + 1)):
                end = m.start()
                try:
                    known = _take(data, end, blanks)
                except Damaged:
                    pass
            end = end if known else len(data)
        for why, head, body in found:
            yield at, end, why, head, body
        if fault:
            yield at, end, fault, {}, b""
        at = end


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records and gaps of the archives (plain or gzip) below path.

    Columns: file, start, end (bytes in the file), gap (why the bytes are quarantined; null for a
    record), type, record_id, refers_to, uri, payload_bytes, payload_digest, header_digest, payload (null
    unless asked for). Digest and length are of the bytes read; a revisit has those of its empty block, and
    header_digest is what the record says of its full payload. Damaged bytes never fail the job. A task holds
    one file at a time; a file of more than MAX_FILE_BYTES fails the read. Repeated records are repeated rows.
    """
    schema = to_arrow_schema(StructType.fromDDL(_RECORDS))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for k in range(b.num_rows):
                name = b.column(0)[k].as_py()
                for start, end, why, head, body in salvage(b.column(1)[k].as_py()):
                    if why is None:
                        digest = hashlib.sha256(body).hexdigest()
                        out.append((name, start, end, None, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-refers-to"), head.get("warc-target-uri"), len(body), digest, re.sub("^sha256:", "", head["warc-payload-digest"]) if "warc-payload-digest" in head else None, body if payload else None))
                        held += len(body) if payload else 0
                    else:
                        out.append((name, start, end, why, *[None] * 8))
                    if len(out) >= 1000 or held > 8_000_000:
                        yield full()
                        out, held = [], 0
        if out:
            yield full()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    large = F.raise_error(F.concat(F.lit(f"over {MAX_FILE_BYTES} bytes: "), "path"))
    files = files.select("path", F.when(F.col("length") > MAX_FILE_BYTES, large.cast("binary")).otherwise(F.col("content")).alias("content"))
    return files.mapInArrow(rows, _RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    urn = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1)
    number = lambda c: F.when(urn(c) == "%", "").when(urn(c) != "", F.try_url_decode(urn(c))).cast(kind)
    read = read_warc(spark, path, payload=False).where("gap IS NULL").select(number("record_id").alias("page_id"), "type", number("refers_to").alias("refers_to"), "payload_bytes", "payload_digest", "header_digest")
    full = read.where("type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    revisits = read.where("type = 'revisit'").join(full, (F.col("refers_to") == F.col("_id")) & (F.col("header_digest") == F.col("_digest"))).select("page_id", "type", "refers_to", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"))
    both = read.where("type = 'response'").drop("header_digest").unionByName(revisits)
    return both.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


QUERIES = {"op5_warc": op5_warc}
SQL = {
    "op5_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM m"""
}
