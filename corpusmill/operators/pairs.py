"""All pairs of similar shingle sets, exact, by prefixes of a common order.

Texts with the same shingles form a class, and classes are compared. If shingles are in one order for all classes, two
classes this similar share one among the first of each (a prefix of n - ceil(t n) + 1), wherever the order comes from. Here
it comes from a sketch that counts all shingles, so common ones come last and hardly any is in a prefix. Only prefixes are
shuffled; what meets in one is verified on all shingles. Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, materialize, ready_workers

K, SLOTS, STEP, TEXTS = 5, 1 << 20, 1 << 17, 1 << 21
LONG = 64  # bytes of a word from which BLAKE2b hashes it
_rng = np.random.default_rng(5)
LETTER, PLACE = _rng.integers(1, 1 << 63, 256, np.uint64), _rng.integers(1, 1 << 63, K + 1, np.uint64) | np.uint64(1)
POWER = np.cumprod(np.full(LONG, 0x9E3779B97F4A7C15, np.uint64))
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\r\f")] = True
LETTER[BLANK] = 0


def mixed(x: np.ndarray) -> np.ndarray:
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words between ASCII white space begin, and their hashes; STEP bytes at a time."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(~BLANK[raw], prepend=False, append=False).nonzero()[0]
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        last = max(k + 1, int(np.searchsorted(starts, starts[k] + STEP)))
        base, at = starts[k], starts[k:last]
        if last == k + 1 and ends[k] - base >= LONG:  # one word, perhaps longer than a step
            out[k] = 0
        else:
            part = raw[base : ends[last - 1]]
            place = np.arange(len(part)) - np.repeat(at - base, np.diff(at, append=ends[last - 1]))
            out[k:last] = np.add.reduceat(LETTER[part] * POWER[np.minimum(place, LONG - 1)], at - base)
        k = last
    for k in (ends - starts >= LONG).nonzero()[0]:
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return starts, mixed(out)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's distinct shingles, ascending; a text of fewer words is one shingle, of none has none."""
    texts = [t or b"" for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    starts, words = word_hashes(b"\n".join(texts))
    bounds = np.searchsorted(starts, offsets)
    runs = np.zeros(max(0, len(words) - K + 1), np.uint64)
    for j in range(K):
        runs += words[j : len(runs) + j] * PLACE[j]
    runs = mixed(runs)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= K:
            h = np.sort(runs[a : b - K + 1])
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]
        elif b > a:
            yield mixed((words[a:b] * PLACE[: b - a]).sum(keepdims=True) + PLACE[K : K + 1] * np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def class_of(h: np.ndarray) -> int:
    """One number for a set of shingles."""
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets_of(batch: pa.RecordBatch, c: str) -> Iterator[np.ndarray]:
    """The sets of a batch's texts, some megabytes of text at a time."""
    texts, held, size = batch.column(c).cast(pa.binary()).to_pylist(), [], 0
    for t in texts:
        held.append(t)
        size += len(t or b"")
        if size > TEXTS:
            yield from shingle_sets(held)
            held, size = [], 0
    if held:
        yield from shingle_sets(held)


def summed(df: DataFrame, c: str) -> np.ndarray:
    """The sum of rows of SLOTS counts, in two rounds; the driver gets one row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    one = df.select(F.col(c).alias("counts")).coalesce(16).mapInArrow(add, "counts binary").repartition(1).mapInArrow(add, "counts binary")
    return np.frombuffer(one.collect()[0].counts, np.uint32)


def needed(n, t: float):
    """How many shingles of a set of n another must share to be this similar; never too many for a double's error."""
    return np.ceil(t * n - 1e-6).astype(np.int64)


def met(h: np.ndarray, n: np.ndarray, place: np.ndarray, of: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes that share a shingle, of rows ordered by shingle and size, if their sizes and the shingle's places
    leave room for that much in common."""
    i = np.arange(len(h) - 1)
    d = 1
    while len(i):
        i = i[i + d < len(h)]
        j = i + d
        near = (h[i] == h[j]) & (n[i] >= t * n[j] - 1e-6)
        i, j = i[near], j[near]
        room = 1 + np.minimum(n[i] - 1 - place[i], n[j] - 1 - place[j]) >= needed(n[i] + n[j], t / (1 + t))
        some = room & (of[i] != of[j])
        if some.any():
            a, b = of[i[some]], of[j[some]]
            yield np.minimum(a, b), np.maximum(a, b)
        d += 1


def exact_pairs(docs: DataFrame, at_least: float = 0.70, c: str = "text") -> DataFrame:
    """(lo, hi, jaccard) of all pairs of documents whose five-word shingles are this similar. Classes are compared; pairs of
    documents come from their members at the end, which is the only step that grows with the copies' square."""
    spark = docs.sparkSession
    ready_workers(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    t = at_least
    long, longs = pa.int64(), pa.list_(pa.int64())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        ids = None
        for batch in batches:
            ids, of, sizes, held = batch.column("doc_id"), [], [], []
            for h in sets_of(batch, c):
                of.append(class_of(h))
                sizes.append(len(h))
                held.append((h & np.uint64(SLOTS - 1)).astype(np.int64))
            if held:
                counts += np.bincount(np.concatenate(held), minlength=SLOTS).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "of": pa.array(of, long), "n": pa.array(sizes, long), "counts": pa.nulls(len(of), pa.binary())})
        if ids is not None:
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, ids.type), "of": pa.nulls(1, long), "n": pa.nulls(1, long), "counts": pa.array([counts.tobytes()], pa.binary())})

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out: list = [[], [], []]
            for h in sets_of(batch, c):
                if not len(h) or (k := class_of(h)) in seen:
                    continue
                seen.add(k)
                first = np.argsort(counts.value[h & np.uint64(SLOTS - 1)], kind="stable")[: len(h) - int(needed(np.array(len(h)), t)) + 1]
                for x, y in zip(out, (h[first].view(np.int64), np.full(len(first), k, np.int64), (len(h) << 32) + np.arange(len(first)))):
                    x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(x)) for k, x in zip(("h", "of", "n_place"), out)})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(3)])
            size += batch.num_rows
            if size >= 200_000 and held[-1][0][-1] != held[0][0][0]:
                rows = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.argmax(rows[0] == rows[0][-1]))  # the last shingle's rows may go on
                yield from pairs_of([x[:cut] for x in rows])
                held, size = [[x[cut:] for x in rows]], len(rows[0]) - cut
        if held:
            yield from pairs_of([np.concatenate(x) for x in zip(*held)])

    def pairs_of(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, of, n_place = rows
        if not len(h):
            return
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
        h, of, n_place = h[new], of[new], n_place[new]
        held: list = []
        for a, b in met(h, n_place >> 32, n_place & 0xFFFFFFFF, of, t):
            held.append(np.stack((a, b)))
            if sum(x.shape[1] for x in held) > 500_000:
                held = [unique(np.concatenate(held, axis=1))]
                if held[0].shape[1] > 250_000:
                    yield as_batch(held.pop())
        if held:
            yield as_batch(unique(np.concatenate(held, axis=1)))

    def unique(p: np.ndarray) -> np.ndarray:
        p = p[:, np.lexsort(p)]
        return p[:, np.concatenate(([True], (p[:, 1:] != p[:, :-1]).any(axis=0)))]

    def as_batch(p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array(p[0]), "b": pa.array(p[1])})

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            counts[batch.column(0).to_numpy()] = 1
        yield pa.RecordBatch.from_pydict({"counts": pa.array([counts.tobytes()], pa.binary())})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(asked.value[batch.column("slot").to_numpy()] > 0))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "h": pa.array([h.view(np.int64) for h in sets_of(batch, c)], longs)})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for k in (2, 3):
                x = batch.column(k)
                o = x.offsets.to_numpy()
                sides.append((x.values.to_numpy(), o))
            (va, oa), (vb, ob) = sides
            j = np.empty(batch.num_rows)
            for k in range(batch.num_rows):
                x, y = va[oa[k] : oa[k + 1]], vb[ob[k] : ob[k + 1]]
                m = len(np.intersect1d(x, y, assume_unique=True))
                j[k] = m / (len(x) + len(y) - m)
            good = j >= t
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).filter(pa.array(good)), "b": batch.column(1).filter(pa.array(good)), "jaccard": pa.array(j[good])})

    text = docs.select("doc_id", c)
    marks = materialize(text.mapInArrow(mark, f"doc_id {kind}, of bigint, n bigint, counts binary"), "marks")
    counts = spark.sparkContext.broadcast(summed(marks.where("counts IS NOT NULL"), "counts"))
    dealt = text.mapInArrow(prefixes, "h bigint, of bigint, n_place bigint").repartition("h").sortWithinPartitions("h", "n_place", "of")
    found = materialize(dealt.mapInArrow(join, "a bigint, b bigint").distinct(), "found")
    counts.destroy()
    ids = found.select(F.col("a").alias("of")).union(found.select("b"))
    first = materialize(marks.join(ids, "of", "left_semi").groupBy("of").agg(F.min("doc_id").alias("doc_id")), "first")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")
    asked = spark.sparkContext.broadcast(summed(first.select(slot).mapInArrow(wanted, "counts binary"), "counts"))
    own = text.select("*", slot).mapInArrow(sets, f"doc_id {kind}, h array<bigint>").join(first, "doc_id").select("of", "h")
    own = materialize(own, "sets")
    asked.destroy()
    drop(first)
    both = found.join(own.toDF("a", "ha"), "a").join(own.toDF("b", "hb"), "b").select("a", "b", "ha", "hb")
    like = materialize(both.mapInArrow(verify, "a bigint, b bigint, jaccard double"), "like")
    drop(found)
    drop(own)
    member = marks.where("n > 0").select("doc_id", "of")
    x, y = member.toDF("x", "a"), member.toDF("y", "b")
    across = like.join(x, "a").join(y, "b").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "jaccard")
    inside = x.join(member.toDF("y", "a"), "a").where("x < y").select(F.col("x").alias("lo"), F.col("y").alias("hi"), F.lit(1.0).alias("jaccard"))
    return across.union(inside)
