"""WARC archives: writing with revisit records, and a reader that salvages.

Writing.  Of pages with equal payloads (SHA-1 and length) the one with the
largest page id becomes a response record, the others revisit records that
refer to it; payloads below ``least`` bytes are always responses.  Records go
through Spark's text sink, so the files lie on whatever file system holds the
shared folder, and commits and retries are Spark's own.  Plain WARC/1.1 has the
record terminator as line separator; compressed archives have one gzip member a
record, so damage to one leaves the others, and an empty member as separator.

Reading.  A record counts only if its version line, headers, length,
terminator, block digest and (of a response) payload digest hold; digests may be
SHA-1, SHA-256, SHA-512 or MD5, in base32 or hexadecimal, and others are not
checked; folded header lines are joined.  After a
failed check the reader searches on for the next gzip member that opens with a
version line, or the next version line, and goes on there; of a damaged member
all that comes out ahead of the damage is read.  Each stretch of
bytes it had to pass over is logged as a gap with the reason.  Offsets in a
compressed archive are those of the member.

Nulls: a null html is an empty payload; a null url leaves the target URI out; a
null page id ranks lowest and reads back as null.  Repeated rows write repeated
records, all of the same type; if rows share the largest id, each of them is a
response.  Other columns are ignored.  An empty table reads back empty.
Control characters and blanks in URLs are percent-encoded.  One archive is
parsed in one task; it has as many records as make about ``FILE_BYTES`` at the
pages' mean size.  The query fails if its own archives read back with a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import in_batches, materialise, new_path

VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Records in one archive file at most, and their payload's bytes, about.
PER_FILE, FILE_BYTES = 20_000, 64_000_000
#: Digits of a length at most.
DIGITS = 18
_GZIP = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: five hex digits make four characters."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _keys(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"))


def _records(pages: DataFrame, least: int, date: str) -> DataFrame:
    """(record): one WARC record a page, without its terminator."""
    keyed = _keys(pages)
    small = keyed.select("page_id", "sha1", "bytes")
    firsts = small.where(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(F.max("page_id").alias("first"))
    # Only ids and digests meet by payload, so a payload that a third of the pages share moves no text.
    revisits = small.join(firsts, ["sha1", "bytes"]).where("not page_id <=> first").select(F.col("page_id").alias("id"), F.col("sha1").alias("of"), "first").distinct()
    rows = keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("of")), "left")
    again = F.col("of").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    crlf = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("bytes").cast("string"), F.lit(crlf * 2))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("url"), "[\x00-\x1f\x7f]", "%0A"), " ", "%20"), " | |\x85", "%20")
    rows = rows.select("page_id", "first", "sha1", url.alias("url"), again.alias("again"), block.alias("block"))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "),
        F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{crlf}WARC-Record-ID: "),
        urn(F.col("page_id")),
        F.lit(f"{crlf}WARC-Date: {date}"),
        F.coalesce(F.concat(F.lit(f"{crlf}WARC-Target-URI: "), F.col("url")), F.lit("")),
        F.when(F.col("again"), F.concat(F.lit(f"{crlf}WARC-Profile: {PROFILE}{crlf}WARC-Refers-To: "), urn(F.col("first")))).otherwise(F.lit("")),
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"),
        base32(F.col("sha1")),
        F.lit(f"{crlf}WARC-Block-Digest: sha1:"),
        base32(F.sha1(F.col("block").cast("binary"))),
        F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(crlf * 2),
        F.col("block"),
    )
    return rows.select(head.alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = DATE, codec: str = "gzip") -> None:
    """Write ``pages(page_id, url, html)`` as archives under ``path``."""
    rows, sep = _records(pages, least, date), _END
    mean = pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    per_file = int(max(1, min(PER_FILE, FILE_BYTES // max(mean, 1))))
    if codec == "gzip":
        rows, sep = in_batches(rows, _members, "record binary").select(F.col("record").cast("string")), gzip.compress(b"", mtime=0)
        codec = "none"
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", sep.decode("latin-1")).option("maxRecordsPerFile", per_file).option("compression", codec).text(path)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record with its terminator as a gzip member."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(r.encode() + _END, 6, mtime=0) for r in b.column(0).to_pylist()], pa.binary())], ["record"])


class _Bad(Exception):
    pass


#: Headers that a record may have once.
_ONCE = {"warc-type", "warc-record-id", "content-length", "warc-block-digest", "warc-payload-digest"}


def _holds(want: str | None, data: bytes) -> bool:
    """Whether a digest header is that of the data; true without one, or of an algorithm that is not known."""
    name, _, value = (want or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5") or not value:
        return True
    raw = hashlib.new(name, data).digest()
    value = value.strip().rstrip("=")
    return value.lower() == raw.hex() or value.upper() == base64.b32encode(raw).decode().rstrip("=")


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; _Bad if a check fails."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise _Bad("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise _Bad("headers do not end")
    heads: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", data[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("malformed header")
        key = name.strip().lower().decode("latin-1")
        if key in heads and key in _ONCE:
            raise _Bad("repeated header")
        heads.setdefault(key, value.strip().decode("utf-8", "replace"))
    length = heads.get("content-length", "")
    if not length.isascii() or not length.isdigit() or len(length) > DIGITS:
        raise _Bad("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise _Bad("block and terminator do not fit the length")
    block = data[start:stop]
    if not _holds(heads.get("warc-block-digest"), block):
        raise _Bad("block digest differs")
    kind = heads.get("warc-type", "")
    payload, declared = block, len(block)
    if heads.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise _Bad("HTTP headers do not end")
        m = re.search(rb"(?im)^content-length:[ \t]*(\d{1,%d})[ \t]*\r?$" % DIGITS, http)
        declared = int(m[1]) if m else len(payload)
    want = heads.get("warc-payload-digest")
    own = digest(payload)
    if kind == "response" and not _holds(want, payload):
        raise _Bad("payload digest differs")
    return {
        "type": kind,
        "record_id": heads.get("warc-record-id"),
        "refers_to": heads.get("warc-refers-to"),
        "target_uri": heads.get("warc-target-uri"),
        "payload_digest": own if kind == "response" else (want or "").removeprefix("sha1:") or None,
        "payload_bytes": len(payload) if kind == "response" else declared,
        "payload": payload,
    }, stop + 4


def _plain(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", offset, length, fields) and ("gap", offset, length, reason) of uncompressed bytes."""
    at = 0
    while at < len(data):
        try:
            fields, end = _record(data, at)
        except _Bad as why:
            end = data.find(VERSION, at + 1)
            while end >= 0:  # only a record that holds ends the gap
                try:
                    _record(data, end)
                    break
                except _Bad:
                    end = data.find(VERSION, end + 1)
            end = len(data) if end < 0 else end
            yield "gap", at, end - at, str(why)
        else:
            yield "record", at, end - at, fields
        at = end


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` holds, where it ends (-1: it broke off), and why."""
    d = zlib.decompressobj(31)
    out = []
    view = memoryview(data)
    try:
        for i in range(at, len(data), 1 << 16):
            before = d.copy()
            out.append(d.decompress(view[i : i + (1 << 16)]))
            if d.eof:
                return b"".join(out), min(i + (1 << 16), len(data)) - len(d.unused_data), ""
    except zlib.error as why:
        try:  # what a failing call had made is lost, so byte by byte up to the damage
            for k in range(i, min(i + (1 << 16), len(data))):
                out.append(before.decompress(view[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(out), -1, str(why)
    return b"".join(out), -1, "member does not end"


def _next_member(data: bytes, at: int) -> int:
    """Where the next gzip member begins whose content opens with a version line; the end if none does."""
    while True:
        at = data.find(_GZIP, at)
        if at < 0:
            return len(data)
        try:
            if zlib.decompressobj(31).decompress(data[at : at + 512], 64).startswith(VERSION):
                return at
        except zlib.error:
            pass
        at += 1


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Records and gaps of an archive, compressed or not; see _plain() for the form."""
    if not data.startswith(_GZIP) and (data.startswith(VERSION) or _next_member(data, 0) == len(data)):
        yield from _plain(data)
        return
    at = 0
    while at < len(data):
        if not data.startswith(_GZIP, at):
            end = _next_member(data, at)
            yield "gap", at, end - at, "no gzip member"
            at = end
            continue
        body, end, why = _inflate(data, at)
        stop = end if end >= 0 else _next_member(data, at + 1)
        for kind, off, length, x in _plain(body):
            if kind == "record":
                yield "record", at, stop - at, x
            elif end >= 0:
                yield "gap", at, stop - at, f"{x} (member bytes {off}-{off + length})"
        if end < 0:
            yield "gap", at, stop - at, why
        at = stop


FIELDS = ["type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes"]
SCHEMA = "kind string, archive string, offset long, length long, reason string, type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long"


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` of all archives under ``path``; with the payload if asked for."""
    schema = SCHEMA + (", payload binary" if payload else "")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary()}.get(f.split()[1], pa.string()) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                rows: list[list] = []
                held = 0
                for kind, at, length, x in salvage(data.as_py()):
                    record = x if kind == "record" else {}
                    rows.append([kind, name.as_py(), at, length, None if kind == "record" else x, *(record.get(f) for f in FIELDS), *([record.get("payload")] if payload else [])])
                    held += record.get("payload_bytes", 0) if payload else 0
                    if len(rows) >= 5000 or held > 32_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return in_batches(files, run, schema)


def _page(urn: str) -> Column:
    return F.nullif(F.regexp_extract(F.col(urn), r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")


def write_and_read_back(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page's record as read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least)
    read = materialise(read_archives(spark, path), "warc-log")
    gaps = read.where("kind = 'gap'").limit(3).collect()
    if gaps:
        raise RuntimeError(f"archives did not read back whole: {gaps}")
    return read.where("kind = 'record'").select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), _page("refers_to").alias("refers_to"))


#: Base32 of a SHA-1 in hex: each group of five hex digits is a number below 2**20, cut into four places.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS x FROM p),
m AS (SELECT x, n, max(page_id) AS first FROM h GROUP BY x, n),
g AS (SELECT x, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT + 1, 1), '' ORDER BY i, j) AS d
      FROM m, range(8) r(i), range(4) s(j) GROUP BY x)
SELECT h.page_id, h.n AS payload_bytes, g.d AS payload_digest,
  CASE WHEN h.page_id = m.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.page_id <> m.first THEN m.first END AS refers_to
FROM h JOIN m ON h.x = m.x AND h.n = m.n JOIN g ON g.x = h.x
"""
