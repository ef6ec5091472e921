"""Legacy archives to WARC.

ARC files open with a version block whose lines name the version and the fields of the
record headers; each record is one header line and as many bytes as it declares.  Every
record becomes a WARC record: an identifier from its address, date and digest, a date
from the 14 digits, a type from the address, and SHA-1 digests in base32.  Records whose
payload an earlier record has become revisits without payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, first_uid, shared_path, ship
from .files import write_whole

FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 16 << 20
DATE = "19970101000000"  # pages have none
NO_ADDRESS = "urn:x-no-address"
SMALL_FIRSTS = 100_000  # repeated payloads that may be broadcast, of under 1 KB each


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- ARC


def arc_header(version: int) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 weftgraph\n{' '.join(FIELDS[version])}\n".encode()
    lead = ["filedesc://weftgraph.arc", "0.0.0.0", DATE, "text/plain"] + (["200", "-", "-", "0", "weftgraph.arc"] if version == 2 else [])
    return " ".join([*lead, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, block: bytes, ip: str = "0.0.0.0", date: str = DATE, kind: str = "text/html", status: int = 200) -> bytes:
    lead = [address(url), ip, date, kind] + ([str(status), "-", "-", "0", "weftgraph.arc"] if version == 2 else [])
    return " ".join([*lead, str(len(block))]).encode() + b"\n" + block + b"\n"


def parse_arc(raw: bytes):
    """(fields, block, whole) of each record, the version block first.  whole is false if
    the file ends before the declared length.  A line that is no header ends the parse
    with a ValueError that names its offset."""
    names, at = None, 0
    while at < len(raw):
        if raw[at : at + 1] == b"\n":
            at += 1
            continue
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        parts = raw[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if names is None and len(parts) >= 5:  # of whichever version, the length comes last
            known = FIELDS[2] if len(parts) == len(FIELDS[2]) else FIELDS[1]
        else:
            known = names
        if known is None or len(parts) < len(known) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header at byte {at}")
        extra = len(parts) - len(known)  # an old address may hold spaces
        parts = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
        size = int(parts[-1])
        block = raw[end + 1 : end + 1 + size]
        if names is None:
            lines = block.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0]) if lines[0].split(" ")[0].isdigit() else 1
            names = lines[1].split() if len(lines) > 1 and lines[1].split() else FIELDS.get(version, FIELDS[1])
        yield dict(zip(known, parts)), block, len(block) == size
        at = end + 1 + size


# ---- WARC


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload of a response block."""
    for gap in (b"\r\n\r\n", b"\n\n"):
        at = block.find(gap)
        if block[:5] == b"HTTP/" and at >= 0:
            return block[: at + len(gap)], block[at + len(gap) :]
    return b"", block


def iso(date: str) -> str:
    d = (re.sub(r"\D", "", date) + "00000101000000"[min(14, len(re.sub(r"\D", "", date))) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(url: str, date: str, sha: str, place: str = "") -> str:
    """The identifier of a capture; place tells apart captures that agree in the rest."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {sha} {place}')}>"


def address(url: str | None) -> str:
    """An address as ARC headers can hold it."""
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or NO_ADDRESS)


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + press.flush()


def convert(fields: dict, block: bytes, whole: bool, original: dict | None = None, place: str = "", info: str | None = None) -> bytes:
    """The WARC record equivalent to an ARC record; a revisit of `original` (headers that
    name the first record of this payload) if given.  info: the file's warcinfo record."""
    url, date = fields["URL"], iso(fields["Archive-date"])
    head, payload = payload_of(block)
    sha = digest(payload)
    http = url.startswith(("http://", "https://")) or bool(head)
    kind = "warcinfo" if url.startswith("filedesc:") else "response" if http else "resource"
    headers = [("WARC-Type", "revisit" if original else kind), ("WARC-Record-ID", record_id(url, date, sha, place)), ("WARC-Date", date)]
    if kind == "warcinfo":
        headers.append(("WARC-Filename", place))
    else:
        headers += [("WARC-Target-URI", url), ("WARC-IP-Address", fields.get("IP-address", "0.0.0.0")), ("WARC-Payload-Digest", f"sha1:{sha}")]
        if info:
            headers.append(("WARC-Warcinfo-ID", info))
    if original:
        headers += [("WARC-Profile", REVISIT), *original.items()]
        block = head
    if not whole:
        headers.append(("WARC-Truncated", "length"))
    headers += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", {"warcinfo": "application/warc-fields", "response": "application/http; msgtype=response"}.get(kind, fields.get("Content-type", "application/octet-stream")))]
    return warc_record(headers, block)


def parse_warc(raw: bytes):
    """(headers, block) of each record of a gzipped WARC file."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        press = zlib.decompressobj(31)
        parts, step = [], 1 << 16
        while not press.eof:
            parts.append(press.decompress(view[at : at + step]))
            at += min(step, len(raw) - at)
            if at >= len(raw) and not press.eof:
                break
        at -= len(press.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


# ---- over tables


def page_block(page_id, html: bytes) -> bytes:
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(html)}\r\n\r\n".encode() + html


def _archive(batches, folder: str, roll: int):
    """Pages as legacy records, versions by turns, each converted; files roll by size."""
    uid = first_uid()
    part = uid >> 33
    version, out, size, seq, n = 1 + part % 2, [], 0, 0, 0
    header, info = arc_header(version), None
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first", "first_url")]
        for page, url, html, first, first_url in zip(*cols):
            records = parse_arc(header + arc_record(version, url or NO_ADDRESS, page_block(page, html or b"")))
            about = next(records)
            name = f"part-{part:06d}-{seq:06d}.warc.gz"
            if not out:
                out.append(convert(*about, place=name))
                size, info = len(out[0]), record_id(about[0]["URL"], iso(about[0]["Archive-date"]), digest(about[1]), name)
            for fields, block, whole in records:
                original = None
                if first is not None:
                    target = address(first_url)
                    original = {"WARC-Refers-To": record_id(target, iso(DATE), digest(payload_of(block)[1]), f"page {first}"), "WARC-Refers-To-Target-URI": target, "WARC-Refers-To-Date": iso(DATE)}
                out.append(convert(fields, block, whole, original, f"row {uid + n}" if page is None else f"page {page}", info))
                size, n = size + len(out[-1]), n + 1
            if size >= roll:
                write_whole(folder, name, b"".join(out))
                out, size, seq = [], 0, seq + 1
    if out:
        write_whole(folder, f"part-{part:06d}-{seq:06d}.warc.gz", b"".join(out))
    yield pa.record_batch({"n": pa.array([n], pa.int64())})


def _index(batches):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    for batch in batches:
        for raw in batch.column("content").to_pylist():
            rows = []
            for headers, block in parse_warc(raw):
                if headers["WARC-Type"] not in ("response", "revisit"):
                    continue
                head, payload = payload_of(block)
                http = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
                revisit = headers["WARC-Type"] == "revisit"
                sha = headers["WARC-Payload-Digest"][5:]
                if not revisit and digest(payload) != sha:
                    raise ValueError(f"digest of {headers['WARC-Record-ID']} differs")
                page = http.get("X-Page-Id")
                rows.append((headers["WARC-Record-ID"], None if page is None else int(page), int(http["Content-Length"]) if revisit else len(payload), sha, headers["WARC-Type"], headers.get("WARC-Refers-To")))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "target"])


def archive(pages: DataFrame, least_bytes: int = 0, roll: int = ROLL_BYTES) -> str:
    """Write a WARC record for each page; the folder.  Of payloads that are equal and at
    least `least_bytes` long, the smallest page_id has the response, the others revisit
    it.  Only digests are grouped; payloads that repeat are broadcast if they are few by
    count, and else joined by digest, which may be split where a payload is common."""
    spark = pages.sparkSession
    ship(spark)
    folder = shared_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1("html"))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = keyed.where(F.length("html") >= least_bytes).groupBy("sha").agg(F.min(named).alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = cut(firsts.select("sha", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")), "warc-firsts")
    size = firsts.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("first_url")), F.lit(0)).alias("longest")).first()
    few = size["n"] <= SMALL_FIRSTS and size["longest"] <= 900
    joined = keyed.join(F.broadcast(firsts) if few else firsts, "sha", "left")
    later = F.col("page_id") > F.col("first")
    joined = joined.select("page_id", "url", "html", F.when(later, F.col("first")).alias("first"), F.when(later, F.col("first_url")).alias("first_url"))
    joined.mapInArrow(lambda it: _archive(it, folder, roll), "n long").agg(F.sum("n")).collect()
    discard(firsts)
    return folder


def index(spark, folder: str) -> DataFrame:
    """The responses and revisits of a folder of WARC files: record_id, page_id,
    payload_bytes, payload_digest, record_type, target (the record a revisit refers to)."""
    ship(spark)
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(_index, "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, target string")


def read(spark, folder: str) -> DataFrame:
    """The pages' records; refers_to is found by resolving WARC-Refers-To among the records'
    identifiers.  Each target is resolved once, whatever the number of its revisits."""
    records = cut(index(spark, folder), "warc-index")
    targets = records.where("target is not null").select("target").distinct()
    known = records.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to")).join(targets, "target", "left_semi")
    known = cut(known.distinct(), "warc-targets")
    known = F.broadcast(known) if known.count() <= SMALL_FIRSTS else known
    return records.join(known, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """archive(), then read().  A null html is an empty payload, a null url a placeholder
    address.  Rows that repeat the smallest page_id of a payload are all responses, as are
    rows without a page_id.  Record identifiers are unique but for rows that agree in
    page_id, url and html: they are one capture.  An empty table gives no rows."""
    return read(pages.sparkSession, archive(pages, least_bytes))
