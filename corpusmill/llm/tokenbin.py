"""Token-ID output in range-coded block files, and reading them back (operator 1).

A file is a run of blocks, each followed by the eight bytes of SYNC. A block is a header (see HEAD), a table of the
documents that begin in it (ids, token counts and a null mask, deflated), the block's distinct ids (deltas, deflated) and
the range-coded payload. The header has a CRC-32 of the ids and one of everything else in the block. A document may run
over into later blocks of its file. Files hold documents in ascending order of doc_id, part after part.

Spark's text sink writes the blocks (its line separator is SYNC), so files commit as any Spark output does.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize, ready_workers, scratch
from . import rangecoder
from .bpe import by_bytes, cache_for, give_back
from .chunks import LibraryCodec

SYNC = "\x00CMSYNC\n"
MAGIC = b"CMB2"
#: magic; ids, documents beginning, bytes of their table, distinct ids, bytes of them, bytes of payload; CRC-32 of the
#: ids as little-endian unsigned 32-bit integers; CRC-32 of the header so far and of what follows it.
HEAD = struct.Struct("<4s6I2I")
#: Blocks written and read in one go (writing holds tokens and texts too), and input bytes for each file.
GO_BLOCKS, READ_BLOCKS = 1400, 1400
FILE_BYTES = 16_000_000
#: Bytes of text tokenized at a time.
SLICE_BYTES = 5_000_000


def pack(ids: np.ndarray, begins: list[tuple[int | None, int]], alphabet: np.ndarray, payload: bytes) -> bytes:
    names = np.array([d or 0 for d, _ in begins], "<i8").tobytes()
    counts = np.array([n for _, n in begins], "<i8").tobytes()
    nulls = np.array([d is None for d, _ in begins], np.uint8).tobytes()
    table = zlib.compress(names + counts + nulls, 1)
    letters = zlib.compress(np.diff(alphabet, prepend=0).astype("<u4").tobytes(), 1)
    body = table + letters + payload
    head = HEAD.pack(MAGIC, len(ids), len(begins), len(table), len(alphabet), len(letters), len(payload), zlib.crc32(ids.astype("<u4").tobytes()), 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body


class Block:
    """A parsed block; its ids are still coded."""

    def __init__(self, data: memoryview, at: int):
        if len(data) < at + HEAD.size or bytes(data[at : at + 4]) != MAGIC:
            raise ValueError(f"no block at byte {at}")
        _, self.n, docs, table, alphabet, letters, payload, self.crc, check = HEAD.unpack_from(data, at)
        start = at + HEAD.size
        body = bytes(data[start : start + table + letters + payload])
        if len(body) != table + letters + payload or zlib.crc32(body, zlib.crc32(data[at : start - 4])) != check:
            raise ValueError(f"the block at byte {at} is damaged")
        self.end = start + len(body) + len(SYNC)
        if bytes(data[self.end - len(SYNC) : self.end]) != SYNC.encode():
            raise ValueError(f"no sync mark at byte {self.end - len(SYNC)}")
        raw = zlib.decompress(body[:table])
        ids, counts = np.frombuffer(raw[: 8 * docs], "<i8").tolist(), np.frombuffer(raw[8 * docs : 16 * docs], "<i8").tolist()
        self.begins = [(None if null else i, n) for i, n, null in zip(ids, counts, raw[16 * docs :])]
        self.alphabet = np.cumsum(np.frombuffer(zlib.decompress(body[table : table + letters]), "<u4").astype(np.int64)).astype(np.int32)
        if len(self.alphabet) != alphabet:
            raise ValueError(f"the block at byte {at} has another alphabet")
        self.payload = body[table + letters :]


def block_stream(rows: Iterator[tuple[list, np.ndarray, np.ndarray]], size: int = rangecoder.BLOCK, go: int = GO_BLOCKS) -> Iterator[list[bytes]]:
    """Blocks, some thousand at a time, from (document ids, all their token ids, token counts) in order."""
    held: list[np.ndarray] = []
    begins: list[tuple[int, tuple[int | None, int]]] = []  # (offset in held, (document, count))
    have = 0

    def code(ids: np.ndarray, starts: list) -> list[bytes]:
        blocks = [ids[k : k + size] for k in range(0, len(ids), size)]
        by_block: list[list] = [[] for _ in blocks]
        for at, doc in starts:
            by_block[min(at // size, len(blocks) - 1)].append(doc)
        return [pack(b, d, *c) for b, d, c in zip(blocks, by_block, rangecoder.encode(blocks))]

    for docs, ids, counts in rows:
        at = have + np.append(0, np.cumsum(counts))[:-1]
        begins += zip(at.tolist(), zip(docs, counts.tolist()))
        held.append(ids)
        have += len(ids)
        if have >= size * go:
            ids = np.concatenate(held)
            cut = have // size * size
            held, have = [ids[cut:].copy()], have - cut
            yield code(ids[:cut], [b for b in begins if b[0] < cut])
            del ids
            begins = [(a - cut, d) for a, d in begins if a >= cut]
    if have:
        yield code(np.concatenate(held), begins)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the input by the planner's statistics; where it has none, the bytes of the texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, file_bytes: int = FILE_BYTES) -> None:
    """Encode each row's whole text (null: empty), append end_id, and write block files in ascending doc_id order.

    Rows that repeat a doc_id stay separate, ordered by their text; null ids come first.
    """
    ready_workers(df.sparkSession)
    src = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-input_bytes(src) // file_bytes))
    src = src.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            cache = cache_for("library", tokenizer, LibraryCodec)
            for batch in batches:
                for part in by_bytes(batch, "text", SLICE_BYTES):
                    ids, counts = cache.encode(part.column("text"))
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    yield part.column("doc_id").to_pylist(), ids, counts + 1

        for blocks in block_stream(rows()):
            for k in range(0, len(blocks), 256):
                yield pa.RecordBatch.from_pydict({"value": pa.array(blocks[k : k + 256], pa.binary())})
        give_back()

    src.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", SYNC).text(path)


def documents_of(data: memoryview, go: int = READ_BLOCKS) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """(doc_id, ids) of a file's documents in order, checking every block; some thousand blocks at a time."""
    at = 0
    doc, want, got, have = None, -1, [], 0
    while at < len(data):
        blocks = []
        while at < len(data) and len(blocks) < go:
            blocks.append(Block(data, at))
            at = blocks[-1].end
        out = []
        for b, ids in zip(blocks, rangecoder.decode([(b.n, b.alphabet, b.payload) for b in blocks])):
            if zlib.crc32(ids.astype("<u4").tobytes()) != b.crc:
                raise ValueError("a block's ids don't fit their checksum")
            queue, k = list(b.begins)[::-1], 0
            while k < len(ids) or queue:
                if have >= want:
                    if not queue:
                        raise ValueError("ids without a document")
                    (doc, want), got, have = queue.pop(), [], 0
                part = ids[k : k + want - have]
                got.append(part)
                have += len(part)
                k += len(part)
                if have >= want:
                    out.append((doc, np.concatenate(got)))
                elif k >= len(ids):
                    break
        yield out
    if have < want:
        raise ValueError("the file ends within a document")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Rows (file, nth, doc_id, start_in_file, n_tokens, ids_crc32[, ids]) of all documents in the files at path."""
    ready_workers(spark)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                start = nth = 0
                for docs in documents_of(memoryview(content.as_buffer())):
                    counts = np.array([len(i) for _, i in docs], np.int64)
                    cols = {
                        "file": pa.array(np.full(len(docs), file)),
                        "nth": pa.array(np.arange(nth, nth + len(docs))),
                        "doc_id": pa.array([d for d, _ in docs], pa.int64()),
                        "start_in_file": pa.array(start + np.append(0, np.cumsum(counts))[:-1]),
                        "n_tokens": pa.array(counts),
                        "ids_crc32": pa.array([zlib.crc32(i.astype("<u4").tobytes()) for _, i in docs], pa.int64()),
                    }
                    if with_ids:
                        cols["ids"] = pa.array([i for _, i in docs], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(cols)
                    start, nth = start + int(counts.sum()), nth + len(docs)

    kept = "file bigint, nth bigint, doc_id bigint, start_in_file bigint, n_tokens bigint, ids_crc32 bigint"
    return files.mapInArrow(run, kept + (", ids array<int>" if with_ids else ""))


def index(df: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """The contract's rows: write the files to the shared folder, read them back, and number the ids over all files.

    Only one row for each file is ordered in one place.
    """
    spark = df.sparkSession
    path = scratch(spark, "tokens")
    write(df, path, tokenizer, end_id)
    rows = materialize(read(spark, path), "token-index")
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
