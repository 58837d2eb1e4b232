"""WARC archives in Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

Archives are written by Spark's own text writer, so they reach any file system through its commit protocol: a row is a
record's frame and the header of a one-byte skippable frame, whose byte is the line feed that the writer adds. A decoder
that knows nothing of this skips it. Reading goes through Spark's binaryFile source, one archive per row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import remade

#: Fixed values of the formats.
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
FILLER = struct.pack("<II", 0x184D2A50, 1)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: The dictionary is trained on at most so many payloads, those with the smallest hashes, of at most SAMPLE_BYTES each.
SAMPLE_PAGES = 300
SAMPLE_BYTES = 64 << 10
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Payload groups up to this number are broadcast; beyond it they meet the pages in a shuffle.
MAX_BROADCAST_GROUPS = 200_000


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to. Equal payloads are those of equal length
    and SHA-1. Of a group the largest page_id is the response (every row that has it); rows without an id revisit it, or
    are responses where no row of the group has an id."""
    html = F.coalesce("html", F.lit(""))
    payload = F.encode(html, "UTF-8")
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    key = ["payload_digest", "payload_bytes"]
    groups = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy(key).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1 and first is not null").select(*key, "first")
    if groups.count() <= MAX_BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(groups, key, "left")
    return joined.select(
        "page_id", "url", "html", *reversed(key), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")
    )


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary of the pages, or none if they are too few to train one. Only compression depends on it."""
    known = pages.where("length(html) > 0").withColumn("h", F.xxhash64("html", "page_id"))
    # The largest hash of the sample is found on hashes alone, so that only sampled pages reach the driver.
    last = known.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    sample = known.where(F.col("h") <= last).select(F.substring("html", 1, SAMPLE_BYTES).alias("html")).limit(SAMPLE_PAGES)
    texts = [r["html"].encode("utf-8", "surrogatepass") for r in sample.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def block_digest(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def header_value(text: str) -> str:
    """Controls, which would end a header, as percent escapes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the response's HTTP headers without the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_value(url or 'urn:none')}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: {block_digest(digest)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one archive per partition of the pages (page_id, url, html; null html is empty). Further columns are not read;
    repeated rows give repeated records. An empty table gives archives without records."""
    typed = with_types(pages)
    dictionary = train_dictionary(pages.select("page_id", "html"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True, write_content_size=True)
        rows = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary + FILLER]
        for batch in remade(batches, 256):
            for page_id, url, html, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(coder.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, kind, refers_to)) + FILLER)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["frame"])
            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["frame"])

    frames = typed.select("page_id", "url", "html", "payload_digest", "record_type", "refers_to").mapInArrow(write, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


def frames_of(archive: bytes) -> Iterator[bytes]:
    """Contents of the frames of an archive, decoded one at a time with the dictionary of its leading skippable frame."""
    view, at, coder = memoryview(archive), 0, None
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"frame header cut off at {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(view):
                raise ValueError(f"skippable frame cut off at {at}")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise ValueError("the dictionary is not the first frame")
                body = bytes(view[8 : 8 + size])
                coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body) if body else None)
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at {at}")
        coder = coder or zstandard.ZstdDecompressor()
        frame, parts = coder.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + 65536]
            if not len(piece):
                raise ValueError("last frame cut off")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def headers_of(raw: bytes, first: bytes) -> dict[str, str]:
    lines = raw.split(b"\r\n")
    if not lines[0].startswith(first):
        raise ValueError(f"starts with {lines[0][:40]!r}")
    found = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"no header: {line[:40]!r}")
        found[name.strip().lower().decode()] = value.strip().decode()
    return found


def parse_record(raw: bytes) -> tuple[int | None, str, str, str, int | None, bytes | None, int]:
    """page_id, url, record_type, hex digest, refers_to, payload (null for revisits) and payload length; every length and
    digest is checked against what is there."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("record without an end of headers")
    h = headers_of(head, VERSION)
    missing = {"warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest", "content-length"} - set(h)
    if missing:
        raise ValueError(f"headers missing: {sorted(missing)}")
    length = int(h["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{h['warc-record-id']}: Content-Length {length}, block of {len(rest) - 4}")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(headers_of(http, b"HTTP/")["content-length"])
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    page_id = int(h["x-page-id"]) if "x-page-id" in h else None
    if h["warc-record-id"] != record_id(page_id, digest):
        raise ValueError(f"{h['warc-record-id']}: record id does not fit")
    if h["warc-type"] == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{h['warc-record-id']}: payload does not fit its length or digest")
        return page_id, h["warc-target-uri"], "response", digest, None, payload, size
    if h["warc-type"] != "revisit" or payload:
        raise ValueError(f"{h['warc-record-id']}: {h['warc-type']} with {len(payload)} bytes")
    refers_to = int(h["x-refers-to-page"])
    if h.get("warc-refers-to") != record_id(refers_to, digest):
        raise ValueError(f"{h['warc-record-id']}: refers to another record")
    return page_id, h["warc-target-uri"], "revisit", digest, refers_to, None, size


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of every record. A
    record that breaks the format raises an error."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload", "payload_bytes"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for raw in frames_of(content.as_py()):
                    rows.append(parse_record(raw))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(
        read, "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary, payload_bytes long"
    )
