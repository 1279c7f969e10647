"""Word windows by rolling polynomial hashes: fingerprints, hits against a known set, and runs, each within a document's row."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ready_workers

#: The polynomial's base; hashes wrap at 64 bits. A word's number is the first 32 bits of its MD5.
BASE = 1_000_003
#: The most bytes of known windows that are broadcast.
BROADCAST_BYTES = 64_000_000


class Words:
    """The words of some texts, one text after the other."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.string()), ""), "[ \\t\\n\\r\\f]+")
        flat = lists.flatten()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        self.ends = np.append(0, np.cumsum(real))[ends]
        found = pc.dictionary_encode(flat.filter(pa.array(real)))
        self.codes, self.dictionary = found.indices.to_numpy(zero_copy_only=False), found.dictionary
        number = np.fromiter((int.from_bytes(md5(w.encode()).digest()[:4], "big") for w in self.dictionary.to_pylist()), np.uint64, len(self.dictionary))
        self.numbers = number[self.codes]

    def windows(self, n: int, stride: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the first word among all, text, hash) of each text's windows at every stride-th place."""
        many = max(0, len(self.numbers) - n + 1)
        h = np.zeros(many, np.uint64)
        for k in range(n):
            h = h * np.uint64(BASE) + self.numbers[k : k + many]
        first = np.arange(many)
        text = np.searchsorted(self.ends, first, side="right") - 1
        inside = first + n <= self.ends[text + 1]
        if stride > 1:
            inside &= (first - self.ends[text]) % stride == 0
        return first[inside], text[inside], h[inside]

    def at(self, first: np.ndarray, n: int) -> list[str]:
        """The windows that begin there, as strings."""
        word = self.dictionary.to_pylist() if len(first) else []
        return [" ".join(map(word.__getitem__, self.codes[k : k + n].tolist())) for k in first.tolist()]


def hashes(docs: DataFrame, n: int, stride: int = 1, id_col: str = "doc_id", strings: bool = False) -> DataFrame:
    """(id, pos, h[, g]): the hash of every window and, if asked for, its words. Texts of fewer words have none."""
    ready_workers(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words(batch.column("text"))
            first, text, h = w.windows(n, stride)
            for k in range(0, len(first), 100_000):
                one = slice(k, k + 100_000)
                cols = {id_col: batch.column(id_col).take(pa.array(text[one])), "pos": pa.array(first[one] - w.ends[text[one]]), "h": pa.array(h[one].view(np.int64))}
                yield pa.RecordBatch.from_pydict(cols | ({"g": pa.array(w.at(first[one], n), pa.string())} if strings else {}))

    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind.simpleString()}, pos bigint, h bigint" + (", g string" if strings else ""))


def overlaps(docs: DataFrame, known_texts: DataFrame, n: int, known_stride: int = 1, stride: int = 1) -> DataFrame:
    """(doc_id, windows, hits, run) of documents with a window: how many there are, how many stand in the known texts, and
    the longest run of such ones at consecutive places.

    The known windows are broadcast up to BROADCAST_BYTES, measured before; documents are then not shuffled. Beyond it, windows are
    joined by hash and words. Either way, words are compared, not hashes alone.
    """
    known = hashes(known_texts.select(F.lit(0).alias("doc_id"), "text"), n, known_stride, strings=True).select("h", "g").distinct()
    if (known.agg(F.sum(F.octet_length("g") + 8)).first()[0] or 0) > BROADCAST_BYTES:
        seen = hashes(docs, n, stride, strings=True)
        return joined_runs(seen.join(known.withColumn("hit", F.lit(True)), ["h", "g"], "left").select("doc_id", "pos", F.coalesce("hit", F.lit(False)).alias("hit")), stride)
    rows = known.collect()
    held = docs.sparkSession.sparkContext.broadcast((np.unique(np.array([r.h for r in rows], np.int64)), frozenset(r.g for r in rows)))
    kind = docs.schema["doc_id"].dataType
    to_arrow_type(kind)  # raises here rather than in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_hashes, strings = held.value
        for batch in batches:
            w = Words(batch.column("text"))
            first, text, h = w.windows(n, stride)
            hit = np.isin(h.view(np.int64), known_hashes)
            maybe = np.flatnonzero(hit)
            hit[maybe] = [g in strings for g in w.at(first[maybe], n)]
            size = batch.num_rows
            windows, hits = np.bincount(text, minlength=size), np.bincount(text[hit], minlength=size)
            longest = np.zeros(size, np.int64)
            on = np.flatnonzero(hit)
            if len(on):
                begins = np.flatnonzero(np.append(True, (np.diff(first[on]) != stride) | (np.diff(text[on]) != 0)))
                np.maximum.at(longest, text[on[begins]], np.diff(np.append(begins, len(on))))
            some = pa.array(np.flatnonzero(windows))
            out = {"doc_id": batch.column("doc_id"), "windows": pa.array(windows), "hits": pa.array(hits), "run": pa.array(longest)}
            yield pa.RecordBatch.from_pydict(out).take(some)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, windows bigint, hits bigint, run bigint")


def sketches(docs: DataFrame, n: int = 8, size: int = 8) -> DataFrame:
    """(doc_id, sketch array<bigint>): the smallest distinct hashes (as unsigned numbers) of a text's n-word windows; of all its
    words where there are fewer, none below two words."""
    ready_workers(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words(batch.column("text"))
            many = np.diff(w.ends)
            out: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for width in range(2, n + 1):
                _, text, h = w.windows(width)
                own = many[text] == width if width < n else many[text] >= n
                text, h = text[own], h[own]
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.append(True, (np.diff(text) != 0) | (h[1:] != h[:-1]))[: len(text)]
                text, h = text[new], h[new]
                place = np.arange(len(text)) - np.searchsorted(text, text)
                for t, x in zip(text[place < size].tolist(), h[place < size].view(np.int64).tolist()):
                    out[t].append(x)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "sketch": pa.array(out, pa.list_(pa.int64()))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sketch array<bigint>")


def joined_runs(flags: DataFrame, stride: int = 1) -> DataFrame:
    """overlaps()'s rows from (doc_id, pos, hit): gaps and islands over consecutive hits."""
    from pyspark.sql import Window as W

    island = F.col("pos") - stride * F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    runs = flags.where("hit").withColumn("island", island).groupBy("doc_id", "island").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("run"))
    return flags.groupBy("doc_id").agg(F.count("*").alias("windows"), F.count_if("hit").alias("hits")).join(runs, "doc_id", "left").na.fill(0, ["run"])
