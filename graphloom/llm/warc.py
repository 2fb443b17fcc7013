"""WARC archives with segmented records: write, read back, reassemble.

Writing: each page is one record whose block is an HTTP response in chunked
transfer framing.  Blocks longer than ``SEGMENT`` bytes continue in
``continuation`` records that name their origin, their number and, in the
last, the total length.  Pages whose payload (100 bytes or more) equals that
of a page with a smaller id become ``revisit`` records.  Spark's text writer
puts the records, separated by their closing two line ends, into gzipped
.warc files in the shared folder, at most ``FILE_RECORDS`` records each.

Reading: archives are parsed record by record, whether a file is one gzip
member, one a record or plain.  Records in one piece are
decoded at once and travel as a digest; only blocks of segmented records are
shuffled, by origin identifier.  They are ordered by segment number, their
numbers and total length verified, and the chunked framing decoded.

Defined results: null html is an empty payload; null url leaves out the
target; null page ids sort last and come back as null; rows that repeat id
and payload become one response and revisits (all responses if small); an
empty table gives an empty result; extra columns are ignored; broken records
raise unless the reader is told to skip them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

SEGMENT = 16 << 10
CHUNK = 4 << 10
FILE_RECORDS = 2048
LEAST_BYTES = 100
END = b"\r\n\r\n"
#: Names of header fields are read in any letter case.
_FIELDS = {
    f.lower(): f
    for f in (
        "WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Segment-Origin-ID", "WARC-Segment-Number",
        "WARC-Segment-Total-Length", "WARC-Refers-To", "X-Page-Id", "X-Refers-To-Page-Id", "Content-Length",
    )
}
_BEGIN = re.compile(rb"(?<=\n)WARC/\d")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def chunked(body: bytes) -> bytes:
    parts = []
    for at in range(0, len(body), CHUNK):
        piece = body[at : at + CHUNK]
        parts.append(b"%x\r\n%b\r\n" % (len(piece), piece))
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body in chunked framing; raises on a broken frame."""
    parts, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        size = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            if framed[at:] != b"\r\n":
                raise ValueError("chunked framing does not end")
            return b"".join(parts)
        parts.append(framed[at : at + size])
        if len(parts[-1]) != size or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += size + 2


def record_id(key: object) -> str:
    h = hashlib.sha256(str(key).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " else "%%%02X" % ord(c) for c in url)


def page_records(row_key, page_id, url, payload: bytes, digest: str, first_key, first_page) -> Iterator[bytes]:
    """The records of one page: a response in segments, or one revisit."""
    me = record_id(row_key)
    page = None if page_id is None or pd.isna(page_id) else page_id
    shared = [
        ("WARC-Record-ID", me),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", page),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first_key is not None and not pd.isna(first_key) and first_key != row_key:
        block = head + b"Content-Length: %d" % len(payload) + END
        refers = None if first_page is None or pd.isna(first_page) else first_page
        extra = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first_key)), ("X-Refers-To-Page-Id", refers)]
        yield _record([("WARC-Type", "revisit"), *shared, *extra], block)
        return
    block = head + b"Transfer-Encoding: chunked" + END + chunked(payload)
    if len(block) <= SEGMENT:
        yield _record([("WARC-Type", "response"), *shared], block)
        return
    cuts = list(range(0, len(block), SEGMENT))
    yield _record([("WARC-Type", "response"), *shared, ("WARC-Segment-Number", 1)], block[:SEGMENT])
    for number, at in enumerate(cuts[1:], 2):
        fields = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", record_id(f"{row_key}/{number}")),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", me),
            ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if number == len(cuts) else None),
        ]
        yield _record(fields, block[at : at + SEGMENT])


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one record set per row of ``pages`` (page_id, url, html)."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("row_key"),
        "page_id",
        "url",
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # Equal payloads find their first page by an aggregate that combines
    # before the shuffle, so thousands of copies of a page cost one row a task.
    rank = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row_key")
    firsts = (
        rows.filter(F.octet_length("payload") >= LEAST_BYTES)
        .groupBy("digest")
        .agg(F.min(rank).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", F.col("first.row_key").alias("first_key"), F.col("first.page_id").alias("first_page"))
    )
    joined = rows.join(firsts, "digest", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                out += page_records(r.row_key, r.page_id, r.url, r.payload, r.digest, r.first_key, r.first_page)
            yield pd.DataFrame({"record": out})

    # Ids and keys travel as text: a float would not hold them.
    texts = [F.col(c).cast("string").alias(c) for c in ("row_key", "page_id", "first_key", "first_page")]
    records = joined.select(*texts, "url", "payload", "digest").mapInPandas(
        write, "record binary"
    )
    (
        records.select(F.col("record").cast("string"))
        .write.option("lineSep", END.decode())
        .option("maxRecordsPerFile", FILE_RECORDS)
        .option("compression", "gzip")
        .text(path)
    )


def _members(archive: bytes) -> Iterator[bytes]:
    """The archive's bytes: of each gzip member in turn (real archives have one
    a record), or as they are.  Raises on a broken member after giving what
    it held before the break."""
    if archive[:2] != b"\x1f\x8b":
        yield archive
        return
    while archive:
        one = zlib.decompressobj(31)
        data = one.decompress(archive)
        yield data
        if not one.eof:
            raise ValueError("gzip member does not end")
        archive = one.unused_data.lstrip(b"\0")


class Malformed(ValueError):
    """A record that can't be read; ``at`` is where to look for the next."""

    def __init__(self, why: str, at: int) -> None:
        super().__init__(why)
        self.at = at


def _record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    if not data.startswith(b"WARC/", at):
        raise Malformed("no record where one should begin", at)
    end = data.find(END, at)
    if end < 0:
        raise Malformed("header does not end", len(data))
    fields = {}
    for line in data[at:end].decode(errors="replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(_FIELDS.get(name.strip().lower(), name.strip()), value.strip())
    size = fields.get("Content-Length", "")
    begin = end + 4
    if not size.isdigit():
        raise Malformed("no length", begin)
    stop = begin + int(size)
    if data[stop : stop + 4] != END and stop + 4 <= len(data) or stop > len(data):
        raise Malformed("record does not end where its length says", begin)
    return fields, data[begin:stop], stop + 4


def records_of(archive: bytes, skip: bool = False) -> Iterator[tuple[dict[str, str], bytes] | None]:
    """The (header fields, block) of every record of one archive.  A record
    that can't be read raises, or with ``skip`` gives None and the search goes
    on at the next line that begins one."""
    held = b""
    members = _members(archive)
    while True:
        try:
            member = next(members, None)
        except (ValueError, zlib.error):
            if not skip:
                raise
            member, members = None, iter(())
            yield None
        # Members that hold whole records are read one at a time.
        if member is not None:
            held += member
            if not held.endswith(END):
                continue
        at = 0
        while at < len(held):
            try:
                fields, block, at = _record_at(held, at)
            except Malformed as error:
                if not skip:
                    raise
                yield None
                again = _BEGIN.search(held, max(at + 1, error.at))
                at = again.start() if again else len(held)
                continue
            yield fields, block
        held = b""
        if member is None:
            return


def decode_block(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


PARSED = (
    "origin string, page_id string, record_type string, refers_to string, declared string, "
    "payload_bytes long, payload_digest string, segment int, total long, block binary"
)
PAGE = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _parse(skip: bool):
    names = [c.split()[0] for c in PARSED.split(", ")]

    def row_of(f: dict[str, str], block: bytes) -> dict:
        number = lambda key: int(f[key]) if key in f else None
        kind = f["WARC-Type"]
        row = dict.fromkeys(names)
        row["origin"] = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
        row["declared"] = f.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
        row["page_id"], row["refers_to"] = f.get("X-Page-Id"), f.get("X-Refers-To-Page-Id")
        row["segment"], row["total"] = number("WARC-Segment-Number"), number("WARC-Segment-Total-Length")
        row["record_type"] = None if kind == "continuation" else kind
        if row["segment"] is not None:
            row["block"] = block
        elif kind == "revisit":
            http = dict(x.split(": ", 1) for x in block.decode().split("\r\n")[1:] if x)
            row["payload_bytes"], row["payload_digest"] = int(http["Content-Length"]), row["declared"]
        else:
            payload = decode_block(block)
            row["payload_bytes"], row["payload_digest"] = len(payload), hashlib.sha256(payload).hexdigest()
        return row

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for found in records_of(content, skip):
                    # Records of other types (warcinfo, request ...) hold no page.
                    if found is None or found[0].get("WARC-Type") not in ("response", "revisit", "continuation", "resource"):
                        continue
                    try:
                        rows.append(row_of(*found))
                    except (KeyError, ValueError):
                        if not skip:
                            raise
                    if len(rows) == 512:
                        yield _frame(rows, names)
                        rows = []
                if rows:
                    yield _frame(rows, names)

    return parse


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("payload_bytes", "segment", "total"):
        out[c] = out[c].astype("Int64")
    return out


def joined_segments(parts: list) -> bytes:
    """The block of a segmented record; raises where numbers or the total
    length do not fit."""
    parts = sorted(parts, key=lambda p: p["segment"])
    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(p["block"] for p in parts)
    if parts[-1]["total"] is None or int(parts[-1]["total"]) != len(block):
        raise ValueError("segments do not add up to the total length")
    return block


def _reassemble(skip: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    if r.record_type is None:
                        raise ValueError("continuation of no record")
                    size, digest = r.payload_bytes, r.payload_digest
                    if digest is None:
                        payload = decode_block(joined_segments(list(r.parts)))
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if r.declared is not None and r.declared != digest:
                        raise ValueError("payload does not match its digest")
                except (KeyError, ValueError):
                    if not skip:
                        raise
                    continue
                rows.append((r.page_id, int(size), digest, r.record_type, r.refers_to))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE.split(", ")])

    return run


def read_archives(spark: SparkSession, path: str, skip: bool = False) -> DataFrame:
    """One row per page that the archives under ``path`` hold.  A record that
    is broken, incomplete or does not match its digest raises, or with ``skip``
    is left out."""
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInPandas(_parse(skip), PARSED)
    part = F.when(F.col("segment").isNotNull(), F.struct("segment", "total", "block"))
    # One row an origin, except for segments: their blocks are all that moves.
    grouped = parsed.groupBy("origin").agg(
        *[F.max(c).alias(c) for c in ("page_id", "record_type", "refers_to", "declared", "payload_bytes", "payload_digest")],
        F.collect_list(part).alias("parts"),
    )
    pages = grouped.drop("origin").mapInPandas(_reassemble(skip), PAGE)
    return pages.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM f
"""
