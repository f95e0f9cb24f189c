"""WARC archives compressed with Zstandard and a shared dictionary.

An archive begins with a skippable frame (magic 184D2A5D) that holds the
dictionary; each record is one frame.  The reader loads the dictionary from that
frame, decodes one frame per record and validates headers, lengths and digests.

Archives are rows (archive, content) so that only Spark writes and reads them;
``export`` writes them as files where executors mount a folder, and
``spark.read.format("binaryFile")`` reads such files back.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 8 << 20
SAMPLE_ROWS, SAMPLE_CHARS, DICT_BYTES = 400, 4000, 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or none if the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    if page_id is None:
        return "<urn:uuid:ffffffff-ffff-ffff-ffff-ffffffffffff>"
    return f"<urn:uuid:{uuid.UUID(int=page_id & (1 << 64) - 1)}>"


def _page(urn: str) -> int | None:
    n = uuid.UUID(urn[1:-1].removeprefix("urn:uuid:")).int
    if n >> 64:
        return None
    return n - (1 << 64) if n >> 63 else n


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}"]
    lines += ["WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {target}")
    lines += [f"WARC-Payload-Digest: sha1:{_digest(payload)}", f"WARC-Block-Digest: sha1:{_digest(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's columns; ValueError if a header, length or digest is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("ascii").split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    h: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in h:
            raise ValueError(f"bad header line {line[:80]!r}")
        h[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"} - h.keys()
    if missing:
        raise ValueError(f"headers missing: {sorted(missing)}")
    size = int(h["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the record")
    if h["warc-block-digest"] != f"sha1:{_digest(block)}":
        raise ValueError("block digest differs")
    http, found, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode("ascii").split("\r\n")[1:] if ": " in x)
    if not fields.get("Content-Length", "").isdigit():
        raise ValueError("the block has no Content-Length")
    length = int(fields["Content-Length"])
    kind = h["warc-type"]
    if kind == "response":
        if len(payload) != length or h["warc-payload-digest"] != f"sha1:{_digest(payload)}":
            raise ValueError("payload length or digest differs")
    elif kind != "revisit" or payload or "warc-refers-to" not in h or h.get("warc-profile") != PROFILE:
        raise ValueError("bad revisit record")
    return {
        "page_id": _page(h["warc-record-id"]),
        "payload_bytes": length,
        "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": _page(h["warc-refers-to"]) if kind == "revisit" else None,
        "url": h.get("warc-target-uri"),
        "html": payload.decode("utf-8") if kind == "response" else None,
    }


def compress_archive(records: list[bytes], trained: bytes) -> bytes:
    c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdCompressor(level=3)
    return struct.pack("<II", MAGIC, len(trained)) + trained + b"".join(c.compress(r) for r in records)


def read_archive(content: bytes) -> Iterator[dict]:
    """Records of one archive, one frame at a time."""
    if len(content) < 8:
        raise ValueError("truncated archive")
    magic, size = struct.unpack_from("<II", content)
    if magic != MAGIC or len(content) < 8 + size:
        raise ValueError("no dictionary frame at the start")
    trained = content[8 : 8 + size]
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdDecompressor()
    at = 8 + size
    while at < len(content):
        # a frame that does not end within its own bytes is truncated
        o = d.decompressobj()
        frame = o.decompress(content[at : at + (1 << 16)])
        taken = min(1 << 16, len(content) - at)
        parts = [frame]
        while not o.eof:
            more = content[at + taken : at + taken + (1 << 20)]
            if not more:
                raise ValueError("truncated frame")
            parts.append(o.decompress(more))
            taken += len(more)
        at += taken - len(o.unused_data)
        yield parse(b"".join(parts))


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """(archive, content) rows of about ``ARCHIVE_BYTES`` that hold a record per page.

    Null html is an empty payload.  Of equal payloads of at least ``min_bytes``
    bytes that of the smallest id is the response and the others revisit it;
    rows that repeat that id and payload are responses too.  A null id is never
    the smallest.  The dictionary is trained on up to ``SAMPLE_ROWS`` pages
    chosen by hash.  An empty table gives no archive.
    """
    p = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )
    # about as many hashes as are wanted pass the threshold, so no task sends more than a few
    top = min(1.0, 1.5 * SAMPLE_ROWS / max(1, p.count())) * (1 << 40)
    marked = p.select(F.pmod(F.xxhash64("id", "url"), F.lit(1 << 40)).alias("h"), F.substring("html", 1, SAMPLE_CHARS).alias("html")).where(F.col("h") <= top)
    chosen = marked.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(SAMPLE_ROWS)
    sent = p.sparkSession.sparkContext.broadcast(dictionary([r["html"].encode() for r in chosen.collect() if r["html"]]))
    digest = F.sha1(F.encode("html", "UTF-8"))
    size = F.octet_length("html")
    copies = (
        p.where(size >= min_bytes)
        .groupBy(digest.alias("digest"))
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    placed = p.join(copies, digest == F.col("digest"), "left").select(
        "id",
        "url",
        "html",
        "first",
        (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (size >= min_bytes)).alias("revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = sent.value
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdCompressor(level=3)
        start = struct.pack("<II", MAGIC, len(trained)) + trained
        parts, total = [], 0

        def done() -> pa.RecordBatch:
            content = start + b"".join(parts)
            name = hashlib.sha1(content).hexdigest() + ".warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                page, url, html, first, revisit = (x.as_py() for x in row)
                frame = c.compress(record(page, url, html.encode(), first, revisit))
                parts.append(frame)
                total += len(frame)
                if total >= ARCHIVE_BYTES:
                    yield done()
                    parts, total = [], 0
        if parts:
            yield done()

    return placed.mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """A row per record of the archives (RECORD); html is null for revisits.

    Raises on a truncated archive or a record that fails validation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in RECORD.split(", "))]
        )
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in read_archive(content.as_py()):
                    rows.append(r)
                    size += len(r["html"] or "") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select(content_col).mapInArrow(run, RECORD)


def export(archives: DataFrame, folder: str) -> None:
    """Writes the archives as files into a folder that every executor mounts."""

    def put(rows) -> None:
        for r in rows:
            Path(folder).mkdir(parents=True, exist_ok=True)
            (Path(folder) / r["archive"]).write_bytes(bytes(r["content"]))

    archives.foreachPartition(put)
