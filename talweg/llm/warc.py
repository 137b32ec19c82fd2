"""WARC archives in Zstandard form (.warc.zst): writer and reader.

An archive starts with a skippable frame that holds the compression dictionary,
followed by one Zstandard frame per record. The reader loads the dictionary,
decodes frame by frame and validates each record's headers, block length and
digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import shared_dir, written

#: Fixed values of the formats: frame magics and the revisit profile.
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = re.compile(rb"<urn:x-page:([^>]*)>")


class ArchiveError(ValueError):
    """A malformed archive, frame or record."""


@dataclass
class Record:
    version: str
    headers: dict[str, str]
    block: bytes
    offset: int
    #: HTTP header fields and payload of response and revisit records
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _text(head: list[tuple[str, str]]) -> bytes:
    for name, value in head:
        if "\r" in value or "\n" in value:
            raise ArchiveError(f"line break in the value of {name}")
    return "".join(f"{a}: {b}\r\n" for a, b in head).encode()


def record(head: list[tuple[str, str]], block: bytes, version: str = "WARC/1.1") -> bytes:
    """The bytes of one record; Content-Length is added here."""
    return version.encode() + b"\r\n" + _text([*head, ("Content-Length", str(len(block)))]) + b"\r\n" + block + b"\r\n\r\n"


def leading_frame(dictionary: bytes) -> bytes:
    """The skippable frame that holds a dictionary, itself compressed."""
    held = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return SKIPPABLE.to_bytes(4, "little") + len(held).to_bytes(4, "little") + held


def open_dictionary(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary in the leading skippable frame, if there is one, and where the frames begin."""
    if len(data) < 8 or int.from_bytes(data[:4], "little") != SKIPPABLE:
        return None, 0
    end = 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise ArchiveError("the dictionary frame is cut off")
    held = bytes(data[8:end])
    if int.from_bytes(held[:4], "little") == FRAME:
        try:
            held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"the dictionary can't be decoded: {e}") from e
    return zstandard.ZstdCompressionDict(held), end


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each frame of an archive; other skippable frames are passed over."""
    dictionary, at = open_dictionary(data)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            continue
        if magic != FRAME:
            raise ArchiveError(f"no frame at byte {at}")
        one = reader.decompressobj()
        body, size, step = [], 0, 1 << 16
        while not one.eof:
            if at + size >= len(data):
                raise ArchiveError(f"the frame at byte {at} is cut off")
            try:
                body.append(one.decompress(view[at + size : at + size + step]))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"the frame at byte {at} can't be decoded: {e}") from e
            size = min(size + step, len(data) - at) - (len(one.unused_data) if one.eof else 0)
        yield at, b"".join(body)
        at += size


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode()
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"not a header line: {line[:80]!r}")
        last = name.decode().lower()
        out[last] = value.strip().decode()
    return out


def _digest(value: str) -> tuple[str, bytes]:
    kind, _, text = value.partition(":")
    kind = kind.lower().replace("-", "")
    size = hashlib.new(kind).digest_size if kind in hashlib.algorithms_available else 0
    try:
        raw = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper())
    except ValueError as e:
        raise ArchiveError(f"not a digest: {value}") from e
    return kind, raw


def parse(data: bytes, offset: int = 0) -> Record:
    """One record from one frame, validated: version, mandatory headers, lengths and digests."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        raise ArchiveError(f"no record at byte {offset}")
    headers = _fields(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"the record at byte {offset} lacks {name}")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise ArchiveError(f"the record at byte {offset} has a bad length")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"the record at byte {offset} states {n} bytes and holds {len(rest) - 4}")
    found = Record(lines[0].decode(), headers, rest[:n], offset)
    if "warc-block-digest" in headers:
        kind, want = _digest(headers["warc-block-digest"])
        if hashlib.new(kind, found.block).digest() != want:
            raise ArchiveError(f"the record at byte {offset} has another block digest")
    if headers["warc-type"] in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        top, blank, found.payload = found.block.partition(b"\r\n\r\n")
        if not blank:
            raise ArchiveError(f"the record at byte {offset} has no end of HTTP headers")
        found.http = _fields(top.split(b"\r\n")[1:])
        if headers["warc-type"] == "response":
            if "content-length" in found.http and int(found.http["content-length"]) != len(found.payload):
                raise ArchiveError(f"the record at byte {offset} has another payload length")
            if "warc-payload-digest" in headers:
                kind, want = _digest(headers["warc-payload-digest"])
                if hashlib.new(kind, found.payload).digest() != want:
                    raise ArchiveError(f"the record at byte {offset} has another payload digest")
    return found


def records(data: bytes) -> Iterator[Record]:
    for at, body in frames(data):
        yield parse(body, at)


def page_record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object = None, size: int | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit record where ``refers_to`` names the page that has the payload of ``size`` bytes."""
    http = b"HTTP/1.1 200 OK\r\n" + _text([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload) if size is None else size))]) + b"\r\n"
    block = http + (payload if refers_to is None else b"")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:x-page:{page}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    return record([*head, ("Content-Type", "application/http;msgtype=response")], block)


def train_dictionary(samples: list[bytes], size: int = 32 << 10) -> bytes:
    """A dictionary fitted to samples, or their raw beginnings where there are too few to fit one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http;msgtype=response\r\n" + b"".join(s[:2048] for s in samples))[:size]


def _at(uri: str):  # noqa: ANN202  a pyarrow file system and a path in it
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_pages(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000, archive_bytes: int = 16 << 20, samples: int = 200, sample_bytes: int = 8 << 10) -> DataFrame:
    """Write a record per row into ``folder`` (a URI that all executors share) and return one row per archive.

    Of the rows with equal payloads of at least ``min_revisit`` bytes, the one
    with the largest id is the response and the others revisit it; smaller ones
    and rows with a null id are all responses, a null html is an empty payload,
    and of rows that repeat that largest id all are responses. An empty table
    writes no archive. Each task writes archives of about ``archive_bytes``,
    under names fixed by the task, through a temporary name, so that a task that
    runs again replaces its own files. The dictionary is fitted to ``samples``
    payload beginnings of ``sample_bytes`` at most and doesn't affect what is read back.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    small = base.filter(F.col("size") >= min_revisit).select("page", "digest", "size")
    largest = small.groupBy("digest", "size").agg(F.max("page").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # the id among the keys: a payload with many copies then never meets in one task
    again = small.join(largest, ["digest", "size"]).filter(F.col("page") < F.col("refers_to")).distinct()
    rows = base.join(again, ["page", "digest", "size"], "left")
    every = max(1, pages.count() // samples)  # about so many rows, chosen by hash; never more than twice that
    taken = base.filter(F.pmod(F.xxhash64("page", "digest"), F.lit(every)) == 0).select(F.substring("html", 1, sample_bytes).alias("html")).limit(2 * samples).collect()
    dictionary = train_dictionary([page_record(i, "http://x/", (p := r["html"].encode()), hashlib.sha1(p).hexdigest()) for i, r in enumerate(taken)]) if taken else b""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, task = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = _at(folder)
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        out, held, n, k, made = [], 0, 0, 0, []

        def close() -> None:
            nonlocal out, held, n, k
            name = f"{root}/pages-{part:06d}-{k:04d}.warc.zst"
            with store.open_output_stream(f"{root}/_{part:06d}-{k:04d}-{task}.tmp") as f:
                for x in out:
                    f.write(x)
            store.move(f"{root}/_{part:06d}-{k:04d}-{task}.tmp", name)
            made.append((name, n, held))
            out, held, n, k = [], 0, 0, k + 1

        for batch in batches:
            for page, url, html, digest, size, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not out:
                    out.append(leading_frame(dictionary))
                    held += len(out[0])
                x = squeeze.compress(page_record("" if page is None else page, url, html.encode(), digest, refers_to, size))
                out.append(x)
                held += len(x)
                n += 1
                if held >= archive_bytes:
                    close()
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    store, root = _at(folder)
    store.create_dir(root, recursive=True)
    made = rows.select("page", "url", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise("").alias("html"), "digest", "size", "refers_to").mapInArrow(write, "archive string, records long, bytes long")
    return written(made)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all archives in ``folder``: archive, offset, page_id (text), record_type, refers_to (text), url, payload_digest, payload_bytes, payload.

    Digest and length are those of the full payload: a revisit takes them from
    its own headers. Damaged archives raise ``ArchiveError``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["archive", "offset", "page_id", "record_type", "refers_to", "url", "payload_digest", "payload_bytes", "payload"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for r in records(content.as_buffer()):
                    page, refers = (_RECORD.fullmatch(r.headers.get(h, "").encode()) for h in ("warc-record-id", "warc-refers-to"))
                    rows.append((path, r.offset, page and page[1].decode(), r.headers["warc-type"], refers and refers[1].decode(), r.headers.get("warc-target-uri"), _digest(r.headers["warc-payload-digest"])[1].hex(), int(r.http["content-length"]), r.payload))
                    held += len(r.payload)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(read, "archive string, offset long, page_id string, record_type string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, **options: object) -> DataFrame:
    """Write ``pages`` to a new folder in the shared storage and read the archives back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/talweg-archives/{uuid.uuid4().hex}"
    write_pages(pages, folder, **options)
    return read_pages(spark, folder)
