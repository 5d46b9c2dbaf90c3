"""WARC archives, Zstandard-compressed: one frame per record, a dictionary in the leading skippable frame.

Writing
    Records of equal payload are found by digest. The one with the largest page id is a response, the others
    revisit it. Every task writes one archive: a dictionary trained on at most ``SAMPLE_BYTES`` of its first records, then
    one frame per record. The frames are rows of bytes that Spark's own text writer puts into files, so archives go to any
    file system Spark can write and only those of committed tasks are seen. What the text writer puts after
    each row is an empty skippable frame, which every Zstandard reader passes over.

Reading
    Files come through Spark's binary source. The reader takes the dictionary from the leading skippable frame, walks from
    frame to frame by their block headers, decodes one frame per record, and checks the version line, the required
    headers, the content length against the block, the end of the record, the HTTP length against the payload,
    and the payload digest.

Scale
    Only ids and digests are grouped, combined in each task first; the payloads meet the result in one join, whose skewed
    partitions adaptive execution splits. A record that revisits carries no payload, so a hot payload costs headers only.

Defined results: a null html is an empty payload; a null page id never is the largest unless all are null, and reads back
as null; repeated rows with the largest id are all responses; a null url is written as ``about:blank`` and control
characters and blanks in a url are percent-encoded; an empty table gives an archive without records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed values of the formats: skippable frames, the dictionary's frame, data frames, and the revisit profile.
SKIPPABLE, SKIPPABLE_LAST, DICTIONARY, FRAME = 0x184D2A50, 0x184D2A5F, 0x184D2A5D, 0xFD2FB528
DICTIONARY_START = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-record-id", "content-length", "warc-date", "warc-type")
VERSIONS = (b"WARC/1.0", b"WARC/1.1")

EMPTY_FRAME = struct.pack("<II", SKIPPABLE, 0).decode("latin-1")
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
DATE = "2000-01-01T00:00:00Z"
PAGE = "urn:page:"
SCHEMA = (
    "file string, number long, record_id string, page_id long, url string, record_type string, date string, "
    "payload_digest string, payload_bytes long, refers_to long, payload binary, error string"
)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads of ``least_bytes`` or more all but one refer to that one."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    first = rows.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("first_id"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(first, ["sha", "n"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One response or revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = lambda number: f"<{PAGE}{'' if number is None else number}>"
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "about:blank" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{key}: {value}\r\n" for key, value in headers) + "\r\n"
    return head.encode("ascii") + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    sample, held = [], 0
    for one in records:
        if held >= SAMPLE_BYTES:
            break
        sample.append(one[: SAMPLE_BYTES - held])  # a dictionary is only trained on this much; records stay whole
        held += len(sample[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, held // 8), sample)
    except zstandard.ZstdError:  # too few records to learn from: the archive has no dictionary
        return None


def write_archives(rows: DataFrame, path: str, date: str = DATE) -> None:
    """Write records of ``page_id, url, payload, refers_to``, one archive per partition."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in batches:
            records = [record(*row.values(), date) for row in batch.to_pylist()]
            out = []
            if packer is None and records:
                known = _dictionary(records)
                if known is not None:
                    body = known.as_bytes()
                    out.append(struct.pack("<II", DICTIONARY, len(body)) + body)
                packer = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True, write_checksum=True)
            out += [packer.compress(one) for one in records]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    framed = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(frames, "frame binary")
    framed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def _frame_end(data: memoryview, begin: int) -> int:
    """Where the frame ends, from its header and the headers of its blocks."""
    head = data[begin : begin + 18]
    at = begin + zstandard.frame_header_size(head)
    checksum = zstandard.get_frame_parameters(head).has_checksum
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("the archive ends inside a frame")
        header = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise ValueError("the archive ends inside a frame")
    return at


def _records(data: memoryview) -> Iterator[bytes]:
    """The decoded frames of an archive."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("the archive ends inside a frame")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE <= magic <= SKIPPABLE_LAST:
            if at == 0 and magic == DICTIONARY:
                body = bytes(data[8 : 8 + size])
                if len(body) != size:
                    raise ValueError("the archive ends inside its dictionary")
                if not body.startswith(DICTIONARY_START):  # the dictionary may itself be compressed
                    body = zstandard.ZstdDecompressor().decompress(body)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at byte {at}")
        end = _frame_end(data, at)
        frame, at = data[at:end], end
        yield reader.decompressobj().decompress(frame)


def _number(name: str | None) -> int | None:
    digits = (name or "").strip("<>").removeprefix(PAGE)
    return int(digits) if digits else None


def parse(one: bytes) -> dict:
    """Fields of a record; raises ValueError if its headers or lengths are wrong."""
    head, gap, rest = one.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version not in VERSIONS:
        raise ValueError(f"version line {version[:20]!r}")
    if not gap:
        raise ValueError("the headers have no end")
    headers = {}
    for line in lines:
        key, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise ValueError(f"header line {line[:40]!r}")
        headers[key.strip().lower()] = value.strip()
    missing = [key for key in REQUIRED if not headers.get(key)]
    if missing:
        raise ValueError(f"no {', '.join(missing)}")
    if not headers["content-length"].isdecimal() or int(headers["content-length"]) != len(rest) - 4:
        raise ValueError(f"content length {headers['content-length']}, block of {len(rest) - 4}")
    if rest[-4:] != b"\r\n\r\n":
        raise ValueError("the record has no end")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    lengths = [int(x[15:]) for x in http.split(b"\r\n") if x[:15].lower() == b"content-length:"]
    if not gap or not lengths:
        raise ValueError("no HTTP header or length")
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (lengths[0] != len(payload) or digest != _digest(payload)):
        raise ValueError("the payload does not match its length or digest")
    if kind == "revisit" and (payload or not headers.get("warc-refers-to")):
        raise ValueError("a revisit with a payload or without a reference")
    return {
        "record_id": headers["warc-record-id"],
        "page_id": _number(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "date": headers["warc-date"],
        "payload_digest": digest,
        "payload_bytes": lengths[0],
        "refers_to": _number(headers.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


def read_archives(spark: SparkSession, path: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """All records below a path (columns of ``SCHEMA``; ``number`` counts from 0 in a file).

    A wrong record stops the job, or, if not ``strict``, is returned with its ``error``; after a broken frame the rest of that
    archive cannot be read, which is one row with its error.
    """
    names = [field.split()[0] for field in SCHEMA.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _read(file, memoryview(data.as_buffer()))

    def _read(file: str, data: memoryview) -> Iterator[pa.RecordBatch]:
        rows, held, number = [], 0, 0
        records = _records(data)
        while True:
            found = {"file": file, "number": number}
            one = None
            try:
                one = next(records, None)
                if one is None:
                    break
                found |= parse(one)
            except (ValueError, zstandard.ZstdError) as wrong:
                if strict:
                    raise ValueError(f"{file}, record {number}: {wrong}") from wrong
                found["error"] = str(wrong)
            if not payloads:
                found["payload"] = None
            rows.append(found)
            number += 1
            held += len(found.get("payload") or b"") + 500
            if held > 8 << 20:
                yield _table(rows)
                rows, held = [], 0
            if one is None:
                break
        yield _table(rows)

    def _table(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"number": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
        kinds["payload"] = pa.binary()
        columns = [pa.array([row.get(name) for row in rows], kinds.get(name, pa.string())) for name in names]
        return pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, SCHEMA)
