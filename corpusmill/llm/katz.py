"""Katz backoff scores from n-gram counts over the whole training fold (operator 8).

A bigram model: log p(w | h) is that of the discounted bigram if it was kept, else alpha(h) p(w), down to the discounted
unigram and the class of unknown words. Counts up to K are discounted by Good-Turing; every bigram seen in training is kept
(MIN_BIGRAM is 1), and alpha(h) makes up for the others exactly: the probabilities of all known words and of the unknown
class sum to one after every context.

Texts are read once and stored in parts, as numbers of the part's own words. Then parts ask and buckets answer. A part
sends the sorted 64-bit hashes of its words and bigrams with their training counts, dealt out by hash, so a frequent word
or context is spread over all buckets and stands once for each part. A bucket adds up the counts and answers each part
with an array in the order in which it asked, so answers need no keys; of the parts that hold a kept bigram the first owns
it. Owners send what alpha needs, summed for each context; alphas are answered the same way. Each part then evaluates the
recursion for all its tokens. Discounts come from the counts of counts up to FIT, a handful of numbers, smoothed by a
log-linear fit so that Good-Turing's factors always apply. A message holds at least one word, so their number is at most that
of the parts' distinct words and bigrams, however many buckets there are.
"""

from __future__ import annotations

import gc
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize, ready_workers
from .bpe import by_bytes
from .tokenbin import input_bytes

K, MIN_BIGRAM = 5, 1
#: Counts of counts that the fit takes, and the slope that it keeps below: from -1 on, the factors would not lie within 0 and 1.
FIT, FLATTEST = 40, -1.05
#: Bytes of text in a part, and input bytes for each bucket.
PART_BYTES, BUCKET_BYTES = 8_000_000, 16_000_000
#: Fixed keys of the end of a text and of the place before its first word.
END, START = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
PART = "part bigint, who binary, words binary, tokens binary"
ROW = "kind string, bucket int, part bigint, blob binary, stats array<bigint>"
ROW_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("part", pa.int64()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])


class _Numbers(dict):
    """Numbers new keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        return number


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob: each byte plane on its own, then deflated; unsigned sorted ones as differences (dtype u8)."""
    out = [struct.pack("<B", len(arrays))]
    coder = zstandard.ZstdCompressor(level=1)
    for a in arrays:
        sorted_ = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        raw = np.diff(a, prepend=np.zeros(1, a.dtype)) if sorted_ else a
        body = coder.compress(np.ascontiguousarray(raw).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
        out.append(struct.pack("<3sBII", a.dtype.str.encode()[-3:], sorted_, len(a), len(body)) + body)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<B", blob), 1, []
    coder = zstandard.ZstdDecompressor()
    for _ in range(n):
        kind, sorted_, size, length = struct.unpack_from("<3sBII", blob, at)
        at += struct.calcsize("<3sBII")
        dtype = np.dtype(kind.decode())
        raw = coder.decompress(blob[at : at + length])
        at += length
        a = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, size).T.copy().view(dtype).ravel() if size else np.empty(0, dtype)
        out.append(np.cumsum(a, dtype=dtype) if sorted_ else a)
    return out


def smallest(a: np.ndarray) -> np.ndarray:
    """The same counts in the narrowest unsigned type."""
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit key of two."""
    x = (h * np.uint64(0xBF58476D1CE4E5B9)) ^ (w + np.uint64(0x94D049BB133111EB))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key ^ (key >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def learns(doc_id: object) -> bool:
    """The contract's fold; null ids teach nothing."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 != 1


def part_of(ids: list, texts: list[bytes | None], part: int) -> dict:
    """The stored form of some documents: who they are, their words' hashes by number, their tokens' numbers."""
    number = _Numbers()
    number[b""], number[b" "] = 0, 1  # the end and the start
    seqs, lens = [], []
    for t in texts:
        found = t.lower().split() if t else []
        found.append(b"")
        lens.append(len(found))
        seqs.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
    tokens = np.concatenate(seqs)
    key = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
    key[:2] = END, START
    common = np.argsort(-np.bincount(tokens, minlength=len(key))[2:], kind="stable") + 2  # small numbers pack well
    order = np.concatenate([[0, 1], common])
    new = np.empty(len(order), np.uint32)
    new[order] = np.arange(len(order))
    who = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids), "n": pa.array(lens, pa.int64()), "train": pa.array([learns(i) for i in ids], pa.bool_())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, who.schema) as w:
        w.write_batch(who)
    return {"part": part, "who": sink.getvalue().to_pybytes(), "words": pack(key[order]), "tokens": pack(new[tokens])}


class Part:
    """A stored part, unpacked: its words and bigrams, and the order in which it asks for them."""

    def __init__(self, r: dict, buckets: int):
        self.who = pa.ipc.open_stream(r["who"]).read_all()
        self.lens = self.who.column("n").to_numpy()
        (self.key,), (tok,) = unpack(r["words"]), unpack(r["tokens"])
        self.tok = tok.astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        ctx = np.empty_like(self.tok)
        ctx[1:] = self.tok[:-1]
        ctx[np.append(0, np.cumsum(self.lens)[:-1])] = 1
        self.ctx = ctx
        pairs, self.type = np.unique(ctx * len(self.key) + self.tok, return_inverse=True)
        self.h, self.w = pairs // len(self.key), pairs % len(self.key)
        train = self.who.column("train").to_numpy()[self.doc]
        self.keys = {"U": self.key, "B": mix(self.key[self.h], self.key[self.w])}
        self.counts = {"U": np.bincount(self.tok[train], minlength=len(self.key)), "B": np.bincount(self.type[train], minlength=len(pairs))}
        self.order, self.cuts = {}, {}
        for kind, key in self.keys.items():
            at = bucket_of(key, buckets)
            self.order[kind] = np.lexsort((key, at))
            self.cuts[kind] = np.searchsorted(at[self.order[kind]], np.arange(buckets + 1))

    def ask(self, kind: str, bucket: int) -> np.ndarray:
        """Which words or bigrams it asks of a bucket, in the order of their keys."""
        return self.order[kind][self.cuts[kind][bucket] : self.cuts[kind][bucket + 1]]

    def requests(self, part: int, buckets: int, kinds: str) -> Iterator[dict]:
        for kind in kinds:
            for k in np.flatnonzero(np.diff(self.cuts[kind])).tolist():
                own = self.ask(kind, k)
                yield {"kind": kind, "bucket": k, "part": part, "blob": pack(self.keys[kind][own], smallest(self.counts[kind][own])), "stats": None}

    def answers(self, rows: list[dict], kind: str, of: str, column: int, fill: float = 0) -> np.ndarray:
        """The answered column for all words or bigrams."""
        out = None
        for r in rows:
            if r["kind"] == kind:
                a = unpack(r["blob"])[column]
                if out is None:
                    out = np.full(len(self.keys[of]), fill, np.float64 if a.dtype.kind == "f" else np.int64)
                out[self.ask(of, r["bucket"])] = a
        return np.full(len(self.keys[of]), fill) if out is None else out


def of_count(c: np.ndarray) -> np.ndarray:
    """How often each count 1 to FIT stands."""
    return np.bincount(c[(c >= 1) & (c <= FIT)], minlength=FIT + 1)[1:]


def counted(table: pa.Table) -> pa.Table:
    """A bucket's answers to its parts (RU: counts of words; RB: counts of kept bigrams, and which the part owns) and its
    statistics (NU, NB)."""
    rows, out = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["part"])), []
    for kind in "UB":
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        blobs = [unpack(r["blob"]) for r in own]
        flat = np.concatenate([b[0] for b in blobs])
        key, first, where = np.unique(flat, return_index=True, return_inverse=True)
        count = np.bincount(where, np.concatenate([b[1] for b in blobs]), len(key)).astype(np.int64)
        owner = np.zeros(len(flat), np.uint8)
        owner[first] = 1
        stats = [int(count.sum()), int((count > 0).sum()), int(count[key == np.uint64(END)].sum())] if kind == "U" else []
        out.append({"kind": "N" + kind, "bucket": own[0]["bucket"], "part": -1, "blob": b"", "stats": stats + of_count(count).tolist()})
        value = count if kind == "U" else np.where(count >= MIN_BIGRAM, count, 0)
        at = 0
        for r, b in zip(own, blobs):
            piece = slice(at, at + len(b[0]))
            got = smallest(value[where[piece]])
            out.append({"kind": "R" + kind, "bucket": r["bucket"], "part": r["part"], "blob": pack(got) if kind == "U" else pack(got, owner[piece] * (got > 0)), "stats": None})
            at += len(b[0])
    return pa.Table.from_pylist(out, ROW_ARROW)


def answered(asked: pa.Table, alphas: pa.Table) -> pa.Table:
    """A bucket's answers RA: log alpha and the shrinking of each word as a context."""
    key = alphas.column("key").to_numpy().view(np.uint64) if len(alphas) else np.empty(0, np.uint64)
    order = np.argsort(key)
    key = key[order]
    cols = [alphas.column(c).to_numpy()[order] if len(alphas) else np.empty(0) for c in ("alpha", "shrink")]
    out = []
    for r in asked.to_pylist() if len(key) else []:
        own = unpack(r["blob"])[0]
        at = np.minimum(np.searchsorted(key, own), len(key) - 1)
        there = key[at] == own
        out.append({"kind": "RA", "bucket": r["bucket"], "part": r["part"], "blob": pack(np.where(there, cols[0][at], 0.0), np.where(there, cols[1][at], 1.0)), "stats": None})
    return pa.Table.from_pylist(out, ROW_ARROW)


@dataclass(frozen=True)
class Discounts:
    """Good-Turing factors for counts 1 to K of unigrams and bigrams, and what the unigrams leave to the unknown class."""

    n: int
    v: int
    documents: int
    uni: tuple[float, ...]
    bi: tuple[float, ...]
    scale: float
    unknown: float


def slope(of: list[int]) -> float:
    """Of the line through the logs of the counts of counts 1, 2, ..., each spread over the gap around it (simple
    Good-Turing); -2, as Zipf's law has it, where there are not two of them."""
    at = [r for r, n in enumerate(of, 1) if n]
    if len(at) < 2:
        return -2.0
    gap = [(b - a) / 2 for a, b in zip([0, *at[:-1]], [*at[1:], 2 * at[-1] - at[-2]])]
    x, y = np.log(at), np.log([of[r - 1] / g for r, g in zip(at, gap)])
    return min(FLATTEST, float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()))


def good_turing(of: list[int]) -> tuple[float, ...]:
    """Katz's factors for counts 1 to K from smoothed counts of counts n(r) = c r^b: r* = (r + 1) n(r + 1) / n(r), and what
    the counts up to K lose is what Good-Turing gives the unseen. With b under -1 they lie between 0 and 1."""
    b = slope(of) + 1
    cut = (K + 1) ** b
    return tuple((((r + 1) / r) ** b - cut) / (1 - cut) for r in range(1, K + 1))


def discounts(n: int, v: int, documents: int, uni: list[int], bi: list[int]) -> Discounts:
    d = good_turing(uni)
    left = sum(r * c * (1 - x) for r, (c, x) in enumerate(zip(uni, d), 1))
    if not n:
        return Discounts(0, 0, 0, d, good_turing(bi), 1.0, 1.0)
    if left <= 0:  # every word is frequent: one more token is the unknown class
        return Discounts(n, v, documents, d, good_turing(bi), n / (n + 1), 1 / (n + 1))
    return Discounts(n, v, documents, d, good_turing(bi), 1.0, left / n)


class Probabilities:
    """Of a part's words and kept bigrams, from the answered counts; without alpha and shrinking."""

    def __init__(self, p: Part, rows: list[dict], d: Discounts):
        self.count = p.answers(rows, "RU", "U", 0).astype(np.int64)
        pair = p.answers(rows, "RB", "B", 0).astype(np.int64)
        self.owned = p.answers(rows, "RB", "B", 1) > 0
        uni, bi = np.array([1.0, *d.uni, 1.0]), np.array([1.0, *d.bi, 1.0])
        low = lambda c: np.minimum(c, K + 1)
        self.p1 = np.where(self.count > 0, self.count * uni[low(self.count)] * d.scale / max(1, d.n), d.unknown)
        self.context = np.where(np.arange(len(p.key)) == 1, d.documents, self.count)
        self.kept = pair > 0
        self.p2 = pair * bi[low(pair)] / np.maximum(1, self.context[p.h])


def score(df: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of df.

    A null or empty text has one token, its end. Repeated rows are counted and scored each. Null ids teach nothing and
    are held out. Without training rows all tokens are unknown, with probability 1. Other columns are left out.
    """
    spark = df.sparkSession
    ready_workers(spark)
    src = df.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    id_kind = to_arrow_type(src.schema["doc_id"].dataType)
    buckets = max(16, -(-input_bytes(src) // BUCKET_BYTES))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            for part in by_bytes(batch, "text", PART_BYTES):
                own = part_of(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), (part.column("at")[0].as_py() << 24) + nth)
                yield pa.RecordBatch.from_pylist([own], pa.schema([("part", pa.int64()), ("who", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary())]))
                nth += 1

    def ask(kinds: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield pa.RecordBatch.from_pylist(list(Part(r, buckets).requests(r["part"], buckets, kinds)), ROW_ARROW)

        return parts.mapInArrow(run, ROW)

    def settle() -> None:
        """Shuffle files of finished steps can go now."""
        for _ in range(2):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)

    parts = materialize(src.withColumn("at", F.spark_partition_id().cast("long")).mapInArrow(store, PART), "katz-parts")
    first = materialize(ask("UB").groupBy("bucket").applyInArrow(counted, ROW), "katz-counts")
    settle()
    stats = first.where("kind IN ('NU', 'NB')").select("kind", F.posexplode("stats").alias("at", "n")).groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
    got = {(r["kind"], r["at"]): int(r["n"]) for r in stats}
    a, b = [got.get(("NU", k), 0) for k in range(FIT + 3)], [got.get(("NB", k), 0) for k in range(FIT)]
    d = discounts(a[0], a[1], a[2], a[3:], b)

    def sums(part: pa.Table, rows: pa.Table) -> pa.Table:
        """What the part's own bigrams add to their contexts."""
        p = Part(part.to_pylist()[0], buckets)
        q = Probabilities(p, rows.to_pylist(), d)
        own = np.flatnonzero(q.owned & q.kept)
        h = np.unique(p.h[own])
        sp, s1 = (np.bincount(p.h[own], v, len(p.key)).astype(np.float64)[h] for v in (q.p2[own], q.p1[p.w[own]]))
        return pa.table({"key": p.key[h].view(np.int64), "bucket": bucket_of(p.key[h], buckets).astype(np.int32), "n": q.context[h].astype(np.int64), "sp": sp, "s1": s1})

    answers = lambda *kinds: first.where(F.col("kind").isin(*kinds)).drop("stats")
    contexts = parts.groupBy("part").cogroup(answers("RU", "RB").groupBy("part")).applyInArrow(sums, "key bigint, bucket int, n bigint, sp double, s1 double")
    alphas = contexts.groupBy("key").agg(F.first("bucket").alias("bucket"), F.first("n").alias("n"), F.sum("sp").alias("sp"), F.sum("s1").alias("s1"))
    # at least one count's share is left to unseen words
    alphas = alphas.withColumn("shrink", F.expr("least(1D, (1 - 1 / (n + 1)) / sp)")).select("key", "bucket", "shrink", F.expr("log10((1 - sp * shrink) / greatest(1 - s1, 1e-300))").alias("alpha"))
    second = materialize(ask("U").groupBy("bucket").cogroup(alphas.groupBy("bucket")).applyInArrow(answered, ROW), "katz-alphas")
    settle()
    base = np.log10(d.n + 0.5 * (d.v + 1))

    def evaluate(part: pa.Table, rows: pa.Table) -> pa.Table:
        p, rows = Part(part.to_pylist()[0], buckets), rows.to_pylist()
        q = Probabilities(p, rows, d)
        alpha, shrink = p.answers(rows, "RA", "U", 0), p.answers(rows, "RA", "U", 1, 1)
        pair = np.log10(np.where(q.kept, q.p2 * shrink[p.h], 1.0))
        one = np.log10(q.p1)
        seen = q.kept[p.type]
        each = np.where(seen, pair[p.type], alpha[p.ctx] + one[p.tok])
        size = len(p.lens)
        return pa.table(
            {
                "doc_id": p.who.column("doc_id").cast(id_kind),
                "held_out": pa.array(~p.who.column("train").to_numpy()),
                "n_tokens": pa.array(p.lens),
                "n_known": pa.array(np.bincount(p.doc, q.count[p.tok] > 0, size).astype(np.int64)),
                "train_tokens": pa.array(np.full(size, d.n)),
                "base_score": pa.array(np.bincount(p.doc, np.log10(q.count + 0.5)[p.tok], size) - p.lens * base),
                "score": pa.array(np.bincount(p.doc, each, size)),
            }
        )

    told = answers("RU", "RB").union(second.drop("stats"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return parts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(evaluate, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
