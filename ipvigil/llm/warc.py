"""WARC archives: pages to records, and records back to pages, with segments and chunked transfer framing.

Written are `response` records (an HTTP response in chunked framing) and, for payloads of at least `least` bytes that
occur again, `revisit` records without a payload that name the page, address and date of the response. A block of more than `segment` bytes is cut in segments: the first
keeps the record's type, the others are `continuation` records that name the first one's id, and the last gives the
total length. Records end with two line breaks, so Spark's text writer, with those as its separator, writes valid
gzipped archives through its commit protocol; a lost task leaves nothing behind. As segments are bounded, a number of
records bounds a file.

Read back: every file is one row of Spark's binary source, records are cut by their lengths, segments are grouped by
origin, ordered by number, checked against the total length and decoded. A revisit's `refers_to` is what its record says;
its size comes from the response of that page with its payload digest. `intact` says that numbers, lengths, framing and
digest agree, and that the response a revisit names is there.

Defined results: a null payload is written as an empty one; a page without an id gets a record without one and, where
its payload occurs at another page, revisits that; rows that repeat a page_id with its payload are all responses.
"""

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ipvigil.llm.frames import cut_lineage
from ipvigil.session import shared_folder

SEGMENT = 16 << 10
CHUNK = 4 << 10
LEAST = 100
FILE_RECORDS = 2000
END = b"\r\n\r\n"

# Fixed values of the public format.
_VERSION = b"WARC/1.1\r\n"
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked framing of a payload."""
    out = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload in chunked framing; ValueError if the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size expected")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, block: bytes, fields: dict[str, object]) -> bytes:
    """A record without the two line breaks that end it; fields that are None are left out."""
    own = {"WARC-Type": kind, **fields, "Content-Length": len(block)}
    # a field holds one line: line breaks in a value become spaces
    lines = (f"{k}: {' '.join(str(v).split())}\r\n".encode() for k, v in own.items() if v is not None)
    return b"".join([_VERSION, *lines, b"\r\n", block])


def records(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, str | None] | None, segment: int = SEGMENT
) -> Iterator[bytes]:
    """The record of a page, or its segments; `refers_to`: page and address of the response that has the payload."""
    name = f"<{uuid.uuid4().urn}>"
    common = {"WARC-Target-URI": url, "WARC-Date": _DATE}
    first = {"WARC-Record-ID": name, **common, "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Page-ID": page_id}
    if refers_to is not None:
        page, address = refers_to
        named = {"WARC-Refers-To-Target-URI": address, "WARC-Refers-To-Date": _DATE, "WARC-Refers-To-Page-ID": page}
        yield record("revisit", _HTTP, {**first, "WARC-Profile": _PROFILE, **named})
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        yield record("response", block, {**first, "Content-Type": "application/http;msgtype=response"})
        return
    yield record("response", block[:segment], {**first, "WARC-Segment-Number": 1})
    for number, at in enumerate(range(segment, len(block), segment), 2):
        own = {"WARC-Record-ID": f"<{uuid.uuid4().urn}>", **common, "WARC-Segment-Origin-ID": name}
        total = len(block) if at + segment >= len(block) else None
        yield record("continuation", block[at : at + segment], {**own, "WARC-Segment-Number": number, "WARC-Segment-Total-Length": total})


def write(pages: DataFrame, folder: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Archive pages (page_id, url, html) as gzipped WARC files in `folder`."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    large = F.length("payload") >= least
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = rows.filter(large).groupBy("digest").agg(F.min(known).alias("first"), F.count("*").alias("n"))
    first = first.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    revisit = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    marked = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for values in zip(*(batch.column(i) for i in range(5)), strict=True):
                page, url, body, digest, again = (v.as_py() for v in values)
                for made in records(page, url, body, digest.hex(), tuple(again.values()) if again else None, segment):
                    out.append(made)
                    size += len(made)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    writer = made.write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        head = data.index(END, at)
        lines = data[at:head].split(b"\r\n")[1:]
        pairs = (x.decode().partition(":") for x in lines)
        fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
        size = int(fields["content-length"])
        body = head + len(END)
        if body + size > len(data):
            raise ValueError("a record is cut short")
        yield fields, data[body : body + size]
        at = body + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message, out of its transfer framing."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("no end of the HTTP header")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _checked(block: bytes, expected: str, total: int | None) -> tuple[int | None, str | None, bool]:
    """Size, digest and soundness of a response's payload."""
    try:
        payload = payload_of(block)
    except ValueError:
        return None, None, False
    digest = hashlib.sha256(payload).hexdigest()
    return len(payload), digest, digest == expected and (total is None or total == len(block))


_SHAPE = "type string, page_id long, payload_bytes long, payload_digest string, intact boolean, refers_to long"
_PART = f"{_SHAPE}, origin string, number int, total long, block binary"


def _read_file(batches):
    for batch in batches:
        for content in batch.column(0):
            out = []
            for fields, block in parsed(gzip.decompress(content.as_py())):
                kind = fields.get("warc-type")
                page = fields.get("warc-page-id")
                digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                number = fields.get("warc-segment-number")
                row = {"type": kind, "page_id": None if page is None else int(page), "payload_digest": digest, "intact": True}
                if number is not None:
                    total = fields.get("warc-segment-total-length")
                    row |= {"origin": fields.get("warc-segment-origin-id", fields["warc-record-id"]), "number": int(number)}
                    row |= {"total": None if total is None else int(total), "block": block}
                elif kind == "response":
                    size, found, sound = _checked(block, digest, None)
                    row |= {"payload_bytes": size, "payload_digest": found, "intact": sound}
                elif kind == "revisit":
                    page = fields.get("warc-refers-to-page-id")
                    row["refers_to"] = None if page is None else int(page)
                else:
                    continue
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)


_SCHEMA = pa.schema([
    ("type", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("intact", pa.bool_()), ("refers_to", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()),
])


def _assembled(segments: pa.Table) -> pa.Table:
    """One record out of its segments."""
    rows = segments.sort_by("number").to_pylist()
    total = [r["total"] for r in rows if r["total"] is not None]
    size, digest, sound = _checked(b"".join(r["block"] for r in rows), rows[0]["payload_digest"], *total[:1] or [None])
    sound = sound and len(total) == 1 and [r["number"] for r in rows] == list(range(1, len(rows) + 1))
    made = {"type": rows[0]["type"], "page_id": rows[0]["page_id"], "payload_bytes": size, "payload_digest": digest, "intact": sound}
    return pa.Table.from_pylist([made], pa.schema(list(_SCHEMA)[:6]))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of every page in the archives."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    rows = cut_lineage(files.mapInArrow(_read_file, _PART), "warc-records")
    shape = [x.split(" ")[0] for x in _SHAPE.split(", ")]
    joined = rows.filter("origin IS NOT NULL").groupBy("origin").applyInArrow(_assembled, _SHAPE)
    whole = rows.filter("origin IS NULL").select(*shape)
    responses = whole.filter("type = 'response'").unionByName(joined)
    known = responses.groupBy(F.col("payload_digest").alias("digest"), F.col("page_id").alias("page")).agg(F.max("payload_bytes").alias("size"))
    same = (F.col("payload_digest") == F.col("digest")) & (F.col("refers_to") == F.col("page"))
    revisits = whole.filter("type = 'revisit'").drop("payload_bytes").join(known, same, "left")
    revisits = revisits.withColumn("intact", F.col("size").isNotNull()).withColumnRenamed("size", "payload_bytes")
    every = responses.unionByName(revisits.select(*shape))
    return every.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "intact")


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages to a new folder in the shared storage and read them back."""
    folder = shared_folder(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)
