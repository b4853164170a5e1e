"""WARC archives: records with revisits, segments and chunked transfer framing, written and read back.

Records are written by Spark's text writer, whose line separator is set to the
two line ends that close a record, so archives land in whatever store the path
names; they are compressed with gzip, and read with or without it. A block longer than ``segment_bytes`` is written as a first record and
continuation records, which the reader groups by their origin, orders by segment
number and joins after checking their total length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize, scratch_path, table

END = b"\r\n\r\n"
GZIP = b"\x1f\x8b"
RECORDS = "record_type string, page_id long, refers_to long, payload_digest string, payload_bytes long, origin string, segment int, total long, block binary"
PAYLOADS = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def cuts(body: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes, cut between code points."""
    at = 0
    while at < len(body):
        to = min(at + size, len(body))
        while to < len(body) and body[to] & 0xC0 == 0x80:
            to += 1
        yield body[at:to]
        at = to


def chunked(body: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(part), part) for part in cuts(body, size)) + b"0" + END


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer framing; ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk's length is wrong")
        parts.append(body[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, block: bytes, **fields: object) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "2024-01-01T00:00:00Z"} | {k.replace("_", "-"): v for k, v in fields.items() if v is not None} | {"Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = 32_768, chunk_bytes: int = 8_192, per_file: int = 2_000) -> None:
    """One record a page, its payload the html in UTF-8 (null: empty).

    Of pages with equal payloads of at least ``min_bytes`` bytes, the one with
    the largest id is a response and the others revisit it. Rows that repeat
    that id are responses too, as are rows without an id. An empty table writes
    archives without records; columns other than page_id, url and html are not read.
    """
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("payload_sha1", F.sha1(F.col("html").cast("binary")))
    # the ids learn their response first, so that the html is dealt by id: one payload may be a third of all
    ids = materialize(body.where("page_id IS NOT NULL").select("page_id", "payload_sha1").distinct(), "payloads")
    told = ids.join(ids.groupBy("payload_sha1").agg(F.max("page_id").alias("keep")), "payload_sha1")
    roles = body.where("page_id IS NOT NULL").hint("merge").join(told, ["page_id", "payload_sha1"]).select("page_id", "url", "html", "keep")
    roles = roles.unionByName(body.where("page_id IS NULL").select("page_id", "url", "html", F.lit(None).cast("long").alias("keep"))).withColumn("row", F.monotonically_increasing_id())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[str] = []
        for page_id, url, html, keep, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            payload = html.encode()
            digest, name = base32_sha1(payload), f"urn:x-page:{page_id}:{row}"
            common = {"WARC_Target_URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"), "WARC_Page_ID": page_id, "WARC_Payload_Digest": f"sha1:{digest}", "WARC_Payload_Length": len(payload), "Content_Type": "application/http; msgtype=response"}
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            if page_id is not None and page_id != keep and len(payload) >= min_bytes:
                block = head + b"\r\n"
                out.append(record("revisit", name, block, **common, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<urn:x-page:{keep}>").decode())
                continue
            block = head + b"Transfer-Encoding: chunked" + END + chunked(payload, chunk_bytes)
            parts = list(cuts(block, segment_bytes))
            out.append(record("response", name, parts[0], **common, WARC_Segment_Number=1 if len(parts) > 1 else None).decode())
            for k, part in enumerate(parts[1:], 2):
                total = len(block) if k == len(parts) else None
                out.append(record("continuation", f"{name}:{k}", part, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total).decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    arrow_map(roles, run, "value string").write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)
    discard(ids)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: fields (names in lower case) and block. ValueError where it isn't one."""
    at = 0
    while at < len(content):
        if not content.startswith(b"WARC/1.", at):
            raise ValueError(f"no record begins at byte {at}")
        head = content.index(END, at)
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in content[at:head].decode().split("\r\n")[1:])}
        start = head + len(END)
        end = start + int(fields["content-length"])
        if content[end : end + 4] != END:
            raise ValueError(f"the record at byte {at} is not closed where its length says")
        yield fields, content[start:end]
        at = end + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for content in batch.column(0).to_pylist():
            rows = []
            for f, block in parse(gzip.decompress(content) if content.startswith(GZIP) else content):
                digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                number = lambda k: None if f.get(k, "None") == "None" else int(f[k])  # noqa: B023, E731
                refers = f.get("warc-refers-to", "").strip("<>").removeprefix("urn:x-page:")
                origin = f.get("warc-segment-origin-id", f["warc-record-id"]).strip("<>")
                rows.append((f["warc-type"], number("warc-page-id"), int(refers) if refers else None, digest, number("warc-payload-length"), origin, number("warc-segment-number"), number("warc-segment-total-length"), block))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return arrow_map(spark.read.format("binaryFile").load(path).select("content"), run, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """Payloads of all records; segments of one origin are ordered, checked and joined. A group is one page's segments."""
    order = F.sort_array(F.collect_list(F.struct("segment", "record_type", "page_id", "refers_to", "payload_digest", "payload_bytes", "total", "block")))
    whole = records.where("segment IS NULL").select("origin", F.array(F.struct("segment", "record_type", "page_id", "refers_to", "payload_digest", "payload_bytes", "total", "block")).alias("parts"))
    split = records.where("segment IS NOT NULL").groupBy("origin").agg(order.alias("parts"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for origin, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            first, block = parts[0], b"".join(p["block"] for p in parts)
            if len(parts) > 1 or first["segment"]:
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError(f"{origin}: segments are missing or their total length is wrong")
            head, _, body = block.partition(END)
            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            length, digest = (len(payload), base32_sha1(payload)) if first["record_type"] == "response" else (first["payload_bytes"], first["payload_digest"])
            if first["record_type"] == "response" and (digest != first["payload_digest"] or length != first["payload_bytes"]):
                raise ValueError(f"{origin}: the payload differs from its digest")
            rows.append((first["page_id"], first["record_type"], first["refers_to"], digest, length, payload))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PAYLOADS.split(", ")])

    return arrow_map(whole.unionByName(split), run, PAYLOADS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages``, written as archives and read back."""
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return reassemble(read_records(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((list_sum(list_transform(range(5), lambda k: (strpos('0123456789abcdef', substr(hex, CAST(5 * (i // 4) + k + 1 AS BIGINT), 1)) - 1) * CAST(16 ** (4 - k) AS BIGINT)))
              // CAST(32 ** (3 - i % 4) AS BIGINT)) % 32 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS keep
      FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))
"""
