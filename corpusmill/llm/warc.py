"""WARC archives, one Zstandard frame a record, with the dictionary in a leading skippable frame (operator 6).

Each file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed or not; then
comes a frame for each record. Spark's text sink writes an archive as one row of its own file, so files commit as any Spark
output does; the line separator after it is an empty skippable frame, which any reader of Zstandard skips. A new archive
begins where one reaches ARCHIVE_BYTES, so neither writing nor reading holds more, but for one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready_workers, scratch

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame: magic 0x184D2A50 and length 0; all its bytes are ASCII.
GAP = "P*M\x18\0\0\0\0"
#: The bound of the sample that a file's dictionary is made from, and of the dictionary.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 400, 1_000_000, 32_768
ARCHIVE_BYTES = 32_000_000
SALTS = 16
CRLF = b"\r\n"
HEADER = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n:]+:[^\r\n]*\r\n)*)\r\n")
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with the payload, or a revisit record without it; both name the payload's digest and length."""
    block = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or "")),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to)),
            ("X-Refers-To-Page", str(refers_to)),
        ]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises if the header, the length or a digest isn't right."""
    m = HEADER.match(data)
    if not m:
        raise ValueError("no WARC header")
    fields = {}
    for line in m[1].decode().split("\r\n")[:-1]:
        name, _, value = line.partition(":")
        if name.lower() in fields:
            raise ValueError(f"{name} stands twice")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(name):
            raise ValueError(f"no {name}")
    if not re.fullmatch("[0-9]+", fields["content-length"]):
        raise ValueError("Content-Length is no number")
    length = int(fields["content-length"])
    block = data[m.end() : m.end() + length]
    if len(block) != length or data[m.end() + length :] != CRLF + CRLF:
        raise ValueError("Content-Length doesn't fit the record")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("the block doesn't fit its digest")
    return fields, block


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary made from samples; raw bytes of them where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def archives(records: Iterator[bytes], limit: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Archives of about so many bytes: the dictionary's skippable frame, then a frame for each record."""
    while True:
        held, size = [], 0
        for r in records:
            held.append(r)
            size += len(r)
            if len(held) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
                break
        if not held:
            return
        raw = dictionary(held)
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)
        out = [struct.pack("<II", DICT_MAGIC, len(raw)) + raw, *map(coder.compress, held)]
        size = sum(map(len, out))
        while size < limit and (r := next(records, None)) is not None:
            out.append(coder.compress(r))
            size += len(out[-1])
        yield b"".join(out)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at this byte ends, from its header and the headers of its blocks."""
    head = bytes(data[at : at + 18])
    try:
        end, checksum = at + zstandard.frame_header_size(head), zstandard.get_frame_parameters(head).has_checksum
    except zstandard.ZstdError as e:
        raise ValueError(f"no frame at byte {at}") from e
    last = False
    while not last:
        if end + 3 > len(data):
            raise ValueError("a frame is cut short")
        block = int.from_bytes(data[end : end + 3], "little")
        last, kind = bool(block & 1), block >> 1 & 3
        end += 3 + (1 if kind == 1 else block >> 3)  # a block of one repeated byte holds just that
    end += 4 * checksum
    if end > len(data):
        raise ValueError("a frame is cut short")
    return end


def read_archive(data: memoryview) -> Iterator[bytes]:
    """The records of an archive, a frame at a time, wherever skippable frames stand between; in time linear in its size."""
    at, decoder, first = 0, zstandard.ZstdDecompressor(), True
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("the archive ends within a frame")
        magic, length = struct.unpack_from("<II", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if len(data) < at + 8 + length:
                raise ValueError("a skippable frame is cut short")
            if magic == DICT_MAGIC and first:
                raw = bytes(data[at + 8 : at + 8 + length])
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at, first = at + 8 + length, False
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        first = False
        end = frame_end(data, at)
        one = decoder.decompressobj()
        out = one.decompress(data[at:end])
        if not one.eof or one.unused_data:
            raise ValueError(f"the frame at byte {at} doesn't end where its blocks do")
        at = end
        yield out


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with payload, digest, refers_to and revisit: of equal payloads of at least min_bytes, the largest page_id
    is the response and the others revisit it; rows that repeat that page_id are responses too, as are rows without an
    id. A null html is empty.

    Only digests with more than one id are joined, salted, as one may hold a third of the rows.
    """
    src = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    most = src.where((F.length("payload") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"))
    most = most.where("first < last").select("digest", "last").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    out = src.withColumn("salt", F.expr(f"int(pmod(xxhash64(page_id), {SALTS}))")).join(most, ["digest", "salt"], "left")
    revisit = F.coalesce((F.length("payload") >= min_bytes) & (F.col("page_id") < F.col("last")), F.lit(False))
    return out.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """A record for each row; each partition of the join that decides writes archives of bounded size."""
    ready_workers(pages.sparkSession)
    src = decide(pages, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit"))):
                    yield record(*r)

        for whole in archives(records()):
            yield pa.RecordBatch.from_pydict({"value": pa.array([whole], pa.binary())})

    out = src.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", GAP).option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all records at path.

    Raises on a frame, header, length or digest that isn't right. A revisit's payload is null; its digest and length are
    those of the full payload.
    """
    ready_workers(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for data in read_archive(memoryview(content.as_buffer())):
                    head, block = parse(data)
                    number = lambda name: int(head[name]) if head.get(name) else None
                    if head["warc-type"] == "response" and (len(block) != number("x-payload-length") or f"sha1:{sha1_base32(block)}" != head["warc-payload-digest"]):
                        raise ValueError("the payload doesn't fit its digest or length")
                    rows.append((number("x-page-id"), head["warc-target-uri"], number("x-payload-length"), head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], number("x-refers-to-page"), block if head["warc-type"] == "response" and with_payload else None))
                    if len(rows) >= 1000:
                        yield rows_to_batch(rows)
                        rows = []
                if rows:
                    yield rows_to_batch(rows)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    width = len(names) if with_payload else len(names) - 1

    def rows_to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, k, c in list(zip(names, kinds, zip(*rows)))[:width]})

    return files.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's rows, from archives written to the shared folder."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
