"""WARC archives: writing with revisits and segments, and reading back with reassembly.

Writing: a response record holds an HTTP message in chunked transfer framing. A message longer than a segment goes
into a first record and continuation records, which name the first as their origin and are numbered; the last gives
the total length. Of rows with equal payloads of ``LEAST`` bytes or more, those with the smallest page_id are
responses and the others revisits without a payload. A record is a gzip member of its own, so archives can be read from
any record on; files are written by Spark's own writer and hold a bounded number of records.

Reading: records are found by their Content-Length. A whole message is decoded where it is read; segments are
grouped by origin, ordered by number, checked against the total length, joined and decoded. Only segments are
shuffled, and a group is one record's segments.

Defined results: null html is an empty payload; a null page_id is written without an id and never referred to; it is
a revisit where a row with an id has its payload (rows of equal payloads that all lack an id are responses); repeated rows are records of their own, and all rows that
carry the smallest page_id of equal payloads are responses; an empty table gives no rows; a null url leaves the target
out; other columns are ignored. A record with missing segments or a wrong total length raises an error.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, goes_at_exit, materialise, scratch_path, spread_join, table, tidy

#: Payloads below LEAST bytes are never revisits; a record's block has at most SEGMENT bytes, a chunk at most CHUNK, a
#: file at most FILE_RECORDS records; FEED bytes are decompressed at once. DATE: of records, where none is given.
LEAST, SEGMENT, CHUNK, FILE_RECORDS, FEED, DATE = 100, 32_768, 8_192, 4_096, 1 << 16, "2024-01-31T00:00:00Z"
END = b"\r\n\r\n"
OUT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def chunked(payload: bytes, most: int = CHUNK) -> bytes:
    parts = []
    for k in range(0, len(payload), most):
        part = payload[k : k + most]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";", 1)[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record with the two line ends after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + END


def record_id(run: str, *of: object) -> str:
    """The id of a record: a name-based UUID of the writing and what the record is of, so that others can refer to it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, (run, *of))))}>"


def page_records(page_id, url, payload: bytes, digest: str, refers_to, name: str, segment: int = SEGMENT, date: str = DATE, refers_id: str | None = None) -> list[bytes]:
    """The records of a page. name: its record id; refers_id: that of the response which a revisit refers to."""
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url is not None else None
    common = [("WARC-Date", date), ("WARC-Target-URI", target)]
    about = [*common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Page-ID", page_id)]
    kind = ("Content-Type", "application/http;msgtype=response")
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Profile", profile), ("WARC-Refers-To", refers_id), ("WARC-Refers-To-Page-ID", refers_to), *about, kind], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", name), *about, kind], block)]
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Segment-Number", 1), *about, kind], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(name, k)), *common, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), *total], part))
    return out


def members(raw: bytes):
    """The contents of the gzip members of a file, one after the other; a plain file is one."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(raw):
                raise ValueError("a gzip member is cut off")
            fed = view[at : at + FEED]
            parts.append(one.decompress(fed))
            at += len(fed) - len(one.unused_data)
        yield b"".join(parts)


def records(raw: bytes):
    """(headers, block) of each record of an archive, plain or compressed."""
    for member in members(raw):
        at = 0
        while at < len(member):
            end = member.index(END, at)
            lines = member[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record at byte {at}")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            size = int(headers["Content-Length"])
            yield headers, member[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def message(headers: dict, block: bytes) -> tuple:
    """The output row of a whole response or revisit."""
    head, _, body = block.partition(END)
    fields = dict(x.lower().split(": ", 1) for x in head.decode().split("\r\n")[1:])
    page, refers = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
    page = int(page) if page is not None else None
    said = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if headers["WARC-Type"] == "revisit":
        return page, headers.get("WARC-Target-URI"), int(fields["content-length"]), said, "revisit", int(refers), None
    payload = dechunk(body) if fields.get("transfer-encoding") == "chunked" else body
    digest = hashlib.sha256(payload).hexdigest()
    if digest != said:
        raise ValueError(f"the payload of page {page} does not have the digest that its record names")
    return page, headers.get("WARC-Target-URI"), len(payload), digest, "response", None, payload


def write(pages: DataFrame, path: str, segment: int = SEGMENT, date: str = DATE) -> None:
    """A record per row, each a gzip member of its own, in files of FILE_RECORDS records at most."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # a row per digest and page of a task before the shuffle; only payloads met twice or more are joined back, and
    # those of very many pages are dealt over many tasks
    narrow = rows.where(F.length("payload") >= LEAST).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("n"), F.min_by("n", "page_id").alias("alike")).where("n > 1 and first is not null")
    first = materialise(first, "revisited")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    refers = F.when((F.col("first") < F.col("page_id")) | F.col("page_id").isNull(), F.col("first"))
    rows = spread_join(rows, first, "digest", "n", total).select("page_id", "url", "payload", "digest", refers.alias("refers_to"), (F.col("alike") == 1).alias("sole"))

    def run(batches):
        part, k, out = TaskContext.get().partitionId(), 0, []
        info = b"software: loomgrid\r\nformat: WARC File Format 1.1\r\n"

        def packed():
            # the last byte of a member is the highest of its length, 0 below 16 MB: the writer's line end puts it there
            return pa.RecordBatch.from_arrays([pa.array([gzip.compress(x, 6, mtime=0)[:-1] for x in out], pa.binary())], names=["value"])

        for batch in batches:
            for page, url, payload, digest, refers_to, sole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not k:
                    out.append(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(path, part)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info))
                # a page that others refer to is named by its id, if one row alone has it
                name = record_id(path, "page", page) if sole and refers_to is None else record_id(path, part, k)
                out += page_records(page, url, payload, digest, refers_to, name, segment, date, record_id(path, "page", refers_to) if sole and refers_to is not None else None)
                k += 1
                if len(out) >= 256:
                    yield packed()
                    out = []
        if out:
            yield packed()

    schema = "value binary"
    # the text writer puts the bytes of a string out as they are (a test holds it to that), in any store, and commits
    rows.mapInArrow(tidy(run), schema).select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    drop(first)


def read(spark, path: str, with_payload: bool = True) -> DataFrame:
    """A row per response or revisit of the archives: the columns of OUT."""
    names = [x.split()[0] for x in OUT.split(", ")]

    def rows_of(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return [pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)]

    strip = (lambda row: row) if with_payload else (lambda row: (*row[:6], None))

    def scan(batches):
        for batch in batches:
            for raw in batch.column(0):
                whole, parts = [], []
                for headers, block in records(raw.as_py()):
                    kind = headers["WARC-Type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    if "WARC-Segment-Number" in headers:
                        origin = headers.get("WARC-Segment-Origin-ID") or headers["WARC-Record-ID"]
                        total = headers.get("WARC-Segment-Total-Length")
                        about = [headers[k] if k in headers else None for k in ("WARC-Page-ID", "WARC-Target-URI", "WARC-Payload-Digest")]
                        parts.append((origin, int(headers["WARC-Segment-Number"]), int(total) if total else None, *about, block))
                    else:
                        whole.append(strip(message(headers, block)))
                n, m = len(whole), len(parts)
                arrays = rows_of([*whole, *[(None,) * 7] * m])
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                cols = list(zip(*parts, strict=True)) if parts else [[]] * 7
                arrays += [pa.array([None] * n + list(c), t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "origin", "number", "total", "s_page", "s_target", "s_digest", "block"])

    def join(batches):
        for batch in batches:
            out = []
            for group in batch.column(0).to_pylist():
                group.sort(key=lambda s: s["number"])
                block = b"".join(s["block"] for s in group)
                if [s["number"] for s in group] != list(range(1, len(group) + 1)) or group[-1]["total"] != len(block):
                    raise ValueError(f"segments of page {group[0]['s_page']} are missing or of the wrong total length")
                about = {"WARC-Type": "response", "WARC-Page-ID": group[0]["s_page"], "WARC-Target-URI": group[0]["s_target"], "WARC-Payload-Digest": group[0]["s_digest"]}
                out.append(strip(message(about, block)))
            yield pa.RecordBatch.from_arrays(rows_of(out), names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(tidy(scan), f"{OUT}, origin string, number int, total long, s_page string, s_target string, s_digest string, block binary")
    return found, join, names


def read_pages(spark, path: str, with_payload: bool = True) -> DataFrame:
    """All pages of the archives. What is found by the scan is kept as a table, since two branches need it."""
    found, join, names = read(spark, path, with_payload)
    found = materialise(found, "records")
    whole = found.where(F.col("origin").isNull()).select(*names)
    parts = found.where(F.col("origin").isNotNull()).groupBy("origin").agg(F.collect_list(F.struct("number", "total", "s_page", "s_target", "s_digest", "block")).alias("segments"))
    return whole.unionByName(parts.select("segments").mapInArrow(tidy(join), OUT))


def op5(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    goes_at_exit(spark, path)
    return read_pages(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first < d.page_id OR (d.page_id IS NULL AND f.first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < d.page_id OR d.page_id IS NULL THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND d.payload_bytes >= 100
"""
