"""WARC archives: records with segments and chunked transfer framing, written and read back.

Writing: one HTTP response record per page, its payload in chunks; of equal payloads of at least ``REVISIT_BYTES`` bytes that of the
largest page_id is the response, the others are revisit records without payload. A block longer than ``segment_bytes`` is cut: the first
segment is the response record, the rest continuation records that name their origin, their number and, on the last, the total length.
Records are whole rows of Spark's text writer (its line feed closes the record), so commits and retries are Spark's; files are compressed
and hold at most ``RECORDS_PER_FILE`` records.

Reading: files are parsed by Content-Length; segmented records are grouped by origin identifier, put in order of segment number and
checked for gaps and for the total length; then the chunk framing is taken off and the payload digest verified. Only segmented records
are shuffled, and a group is one record. ``intact`` tells whether all checks held; a damaged record keeps what could be read.

Null html: empty payload. Null url: no target header. Null page_id: a response of its own (never the largest), page_id null. Repeated rows:
all rows of the largest page_id are responses. Short equal payloads: all responses. Extra columns are not archived. Empty table: no
records, empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import batches_of, documents
from gradeloom.staging import shared_folder

REVISIT_BYTES = 1000
SEGMENT_BYTES, CHUNK_CHARS, RECORDS_PER_FILE = 16 << 10, 4096, 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = pa.schema([("kind", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()),
                     ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])
_RECORD_DDL = "kind string, origin string, number int, total long, page_id long, url string, digest string, refers_to long, block binary"


def _head(*fields: tuple[str, object]) -> bytes:
    """Header lines; control characters in values are percent-encoded so that a value cannot end its line."""
    lines = ["WARC/1.1", *(f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', str(v))}" for k, v in fields if v is not None)]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n"


def chunked(payload: str) -> bytes:
    """Chunked transfer framing, cut between characters."""
    parts = []
    for i in range(0, len(payload), CHUNK_CHARS):
        piece = payload[i:i + CHUNK_CHARS].encode("utf-8", "replace")
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """Payload of a chunked body, and whether the framing was whole. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return b"".join(out), False
        n = int(size, 16)
        if n == 0:
            return b"".join(out), True
        out.append(body[end + 2:end + 2 + n])
        at = end + 2 + n + 2
        if len(out[-1]) < n or body[at - 2:at] != b"\r\n":
            return b"".join(out), False


def records(page_id, url, payload: str, digest: str, size: int, keeper, name: str, segment_bytes: int) -> Iterator[bytes]:
    """The record of one page, as one or more segments."""
    common = (("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page_id),
              ("Content-Type", "application/http; msgtype=response"))
    if keeper is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
        yield _head(("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common, ("WARC-Profile", PROFILE),
                    ("WARC-Refers-To", f"<urn:page:{keeper}>"), ("Content-Length", len(block))) + block + b"\r\n\r\n"
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = [0]
    while len(block) - cuts[-1] > segment_bytes:
        cut = cuts[-1] + segment_bytes
        while block[cut] & 0xC0 == 0x80:  # not within a character
            cut -= 1
        cuts.append(cut)
    cuts.append(len(block))
    last = len(cuts) - 1
    for n in range(1, last + 1):
        part = block[cuts[n - 1]:cuts[n]]
        if n == 1:
            head = _head(("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common, ("WARC-Segment-Number", 1 if last > 1 else None),
                         ("Content-Length", len(part)))
        else:
            head = _head(("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{name}>"),
                         ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == last else None), ("Content-Length", len(part)))
        yield head + part + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archive ``pages`` (page_id, url, html) into ``folder``."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("payload"), F.sha1(html.cast("binary")).alias("digest"),
                        F.octet_length(html).cast("long").alias("size"))
    keepers = (rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
               .where("n > 1 AND keeper IS NOT NULL").drop("n"))
    told = rows.join(keepers, ["digest", "size"], "left").withColumn("keeper", F.when(F.col("keeper") != F.col("page_id"), F.col("keeper")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches_of(batches, 256):
            out = []
            for row in batch.to_pylist():
                n += 1
                out += records(**row, name=f"urn:record:{part}-{n}", segment_bytes=segment_bytes)
            # the writer's line feed is the last byte of a record
            yield pa.RecordBatch.from_arrays([pa.array([r[:-1].decode() for r in out], pa.string())], names=["value"])

    told = told.select("page_id", "url", "payload", "digest", "size", "keeper")
    told.mapInArrow(run, "value string").write.option("maxRecordsPerFile", RECORDS_PER_FILE).option("lineSep", "\n").option("compression", "gzip").text(folder)


def parse(content: bytes) -> Iterator[dict]:
    """Records of one archive file, by Content-Length."""
    at = 0
    while (end := content.find(b"\r\n\r\n", at)) >= 0:
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(head.get("content-length", 0))
        block = content[end + 4:end + 4 + size]
        number = head.get("warc-segment-number")
        refers = re.search(r"urn:page:(-?\d+)", head.get("warc-refers-to", ""))
        yield {"kind": head.get("warc-type"), "origin": head.get("warc-segment-origin-id", head.get("warc-record-id")),
               "number": int(number) if number else None, "total": int(t) if (t := head.get("warc-segment-total-length")) else None,
               "page_id": int(p) if (p := head.get("x-page-id")) else None, "url": head.get("warc-target-uri"),
               "digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": int(refers[1]) if refers else None, "block": block}
        at = end + 4 + size + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            held, size = [], 0
            for record in parse(gzip.decompress(raw) if (raw := content.as_py())[:2] == b"\x1f\x8b" else raw):
                held.append(record)
                size += len(record["block"])
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=_RECORD)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_RECORD)


def joined(segments: DataFrame) -> DataFrame:
    """One row per origin: the block put together, and ``whole``: numbers 1..n without gap or repeat, and the stated total length."""
    parts = F.sort_array(F.collect_list(F.struct("number", "block")))
    first = F.min(F.when(F.col("number") == 1, F.struct("kind", "page_id", "url", "digest", "refers_to")))
    grouped = segments.groupBy("origin").agg(parts.alias("parts"), first.alias("first"), F.max("total").alias("total"))
    # one pass over all segments: adding them to a growing block one by one would copy it once per segment
    block = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    whole = (F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts"))) & (F.octet_length("joined") == F.col("total"))
    return (grouped.withColumn("joined", block)
            .select("first.*", F.col("joined").alias("block"), F.coalesce(whole, F.lit(False)).alias("whole")))


def read(spark, folder: str) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to, intact."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    found = files.mapInArrow(_parsed, _RECORD_DDL)
    single = found.where("number IS NULL").select("kind", "page_id", "url", "digest", "refers_to", "block", F.lit(True).alias("whole"))
    every = single.unionByName(joined(found.where("number IS NOT NULL")))
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 256):
            out = []
            for r in batch.to_pylist():
                head, _, body = (r["block"] or b"").partition(b"\r\n\r\n")
                ok, payload, digest = r["whole"], None, r["digest"]
                if r["kind"] == "revisit":
                    size = int(m[1]) if (m := re.search(rb"Content-Length: (\d+)", head)) else None
                else:
                    payload, framed = unchunked(body) if b"Transfer-Encoding: chunked" in head else (body, True)
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    ok = ok and framed and digest == r["digest"]
                out.append({"page_id": r["page_id"], "url": r["url"], "payload": payload, "payload_bytes": size, "payload_digest": digest,
                            "record_type": r["kind"], "refers_to": r["refers_to"], "intact": ok})
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    return every.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
                                 "refers_to long, intact boolean")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE n >= {REVISIT_BYTES} GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to, true AS intact
FROM p LEFT JOIN k USING (h)
"""
