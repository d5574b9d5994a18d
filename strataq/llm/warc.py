"""WARC archives: a writer through Spark's text sink and a salvage reader over Spark's binary files.

Writing: each record is a gzip member of its own. A member goes to the text sink as it is (the sink writes bytes
unchanged); the sink's line separator is a zero byte, which gzip readers skip as padding between members. So Spark's
commit protocol and any file system it knows serve for archives. Of records with equal payloads of at least
``min_bytes`` that with the smallest page_id is a response, the others are revisits without payload.

Reading: a file is a row. The reader takes members in order; where a member's checks fail (deflate data, CRC, size, or
the record's own length or block digest) it searches the next member magic or ``WARC/`` version line, goes on there,
and logs the bytes between as a quarantined gap. Uncompressed archives and runs of records in one member are read too.
File sizes are bounded by the writer (``file_bytes``), so a task holds one file.

Edge cases: null html is an empty payload; null url is written without a target URI; a null page_id is written as such
and sorts after all others; rows with the smallest page_id of their payload are all responses; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm.runtime import bytes_of, materialize, scratch, small_batches

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_DATE = "2024-01-01T00:00:00Z"
_HIGH = (1 << 63) - 1
RECORDS = "record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
GAPS = "file string, start long, stop long, reason string"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    body = payload if kind == "response" else b""
    b32 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{b32}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_pages(pages: DataFrame, path: str, *, min_bytes: int = 100, file_bytes: int = 8 << 20) -> None:
    """Write (page_id, url, html) rows as archives of about ``file_bytes`` of html each below ``path``."""
    small_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("order", F.coalesce("page_id", F.lit(_HIGH)))
    long = p.where(F.octet_length("payload") >= min_bytes)
    first = long.groupBy("digest").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("of")).where("of > 1").drop("of")
    # written first, so that its size is known and a small one is broadcast: payloads then move once, to their files
    p = p.join(materialize(first), "digest", "left")
    revisit = F.coalesce((F.octet_length("payload") >= min_bytes) & (F.col("first") != F.col("order")), F.lit(False))
    p = p.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))
    files = max(1, 3 * bytes_of(pages) // file_bytes)
    p = p.repartition(files, F.xxhash64("page_id", "digest"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, url, payload, digest, ref in pdf.itertuples(index=False, name=None):
                page, ref = (None if pd.isna(x) else int(x) for x in (page, ref))
                out.append(member(record("response" if ref is None else "revisit", page, url, payload, digest, ref)))
            yield pd.DataFrame({"member": out})

    kinds = "member binary"
    p.mapInPandas(run, kinds).select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


def _inflate(data: bytes, at: int) -> tuple[bytes | None, int]:
    """(contents, end) of the gzip member at ``at``; no contents where its checks fail."""
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(memoryview(data)[at:])
        out += d.flush()
    except zlib.error:
        return None, at
    return (out, len(data) - len(d.unused_data)) if d.eof else (None, at)


def _parse(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record, end, what is wrong) of the record at ``at`` in uncompressed data."""
    if not data.startswith(VERSION, at):
        return None, at, "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None, at, "headers without end"
    fields: dict[str, str] = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError):
        return None, at, "no length"
    body, end = data[stop + 4 : stop + 4 + n], stop + 4 + n
    if len(body) < n or data[end : end + 4] != b"\r\n\r\n":
        return None, at, "wrong length"
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and digest != base64.b32encode(hashlib.sha1(body).digest()).decode():
        return None, at, "wrong digest"
    return {"fields": fields, "body": body}, end + 4, ""


def salvage(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """(records, quarantined gaps as (start, stop, reason)) of one archive. Gaps inside a member are given at the
    member's own place."""
    records: list[dict] = []
    gaps: list[tuple[int, int, str]] = []

    def plain(text: bytes, base: int | None, whole: tuple[int, int]) -> None:
        at = 0
        while at < len(text):
            rec, end, why = _parse(text, at)
            if rec is not None:
                records.append(rec)
                at = end
                continue
            nxt = text.find(VERSION, at + 1)
            nxt = len(text) if nxt < 0 else nxt
            if text[at:nxt].strip(b"\r\n\x00"):
                gaps.append((base + at, base + nxt, why) if base is not None else (*whole, why))
            at = nxt

    at = 0
    while at < len(data):
        if data[at] == 0:  # padding between members
            at += 1
            continue
        if data.startswith(MAGIC, at):
            text, end = _inflate(data, at)
            if text is not None:
                plain(text, None, (at, end))
                at = end
                continue
            why = "broken member"
        elif data.startswith(VERSION, at):
            rec, end, why = _parse(data, at)
            if rec is not None:
                records.append(rec)
                at = end
                continue
        else:
            why = "no record"
        found = [i for i in (data.find(MAGIC, at + 1), data.find(VERSION, at + 1)) if i >= 0]
        nxt = min(found, default=len(data))
        if gaps and gaps[-1][1] == at:  # one damaged place, one gap
            gaps[-1] = (gaps[-1][0], nxt, gaps[-1][2])
        else:
            gaps.append((at, nxt, why))
        at = nxt
    return records, gaps


def _id(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True, strict: bool = False) -> DataFrame:
    """The records of all archives below ``path``; digests of responses are of what was read. With ``strict`` an archive
    with a gap fails the job instead. A row is a file; Arrow's own limit of bytes a batch keeps batches to a few files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                records, gaps = salvage(data)
                if strict and gaps:
                    raise ValueError(f"damaged archive: {gaps[:5]}")
                for r in records:
                    f, body = r["fields"], r["body"]
                    kind = f.get("warc-type")
                    own = kind != "revisit"
                    said = f.get("warc-payload-digest", "").rpartition(":")[2] or None
                    size = f.get("x-payload-length", "")
                    rows.append((kind, _id(f.get("warc-record-id")), f.get("warc-target-uri"), len(body) if own else int(size) if size.isdigit() else None, hashlib.sha256(body).hexdigest() if own else said, _id(f.get("warc-refers-to")), body if with_payload else None))
                out = pd.DataFrame(rows, columns=["record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload"])
                for start in range(0, max(1, len(out)), 256):
                    yield out.iloc[start : start + 256].astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORDS)


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """The quarantined byte ranges of all archives below ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(file, *gap) for file, data in zip(pdf["path"], pdf["content"], strict=True) for gap in salvage(data)[1]]
            yield pd.DataFrame(rows, columns=["file", "start", "stop", "reason"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, GAPS)


def round_trip(pages: DataFrame, *, min_bytes: int = 100) -> DataFrame:
    """Write archives in the shared folder and read them back: one row for each page; fails where bytes were lost."""
    path = scratch(pages.sparkSession)
    write_pages(pages, path, min_bytes=min_bytes)
    return read_archives(pages.sparkSession, path, with_payload=False, strict=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
