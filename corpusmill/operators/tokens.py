"""Byte-level BPE over word tables, byte codes of tokens, and the shift and mask algebra of batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import drop, materialize, ready_workers

#: A run of blanks belongs to the word after it, so the pieces join to the text again.
PRE_TOKEN = "([ \\t\\n\\r\\f]*[^ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+)"


def pre_tokens(c: str = "text") -> Column:
    return F.regexp_extract_all(F.col(c), F.lit(PRE_TOKEN), F.lit(1))


def word_counts(df: DataFrame, c: str = "text") -> DataFrame:
    """(word, n) of pre-tokens."""
    return df.select(F.explode(pre_tokens(c)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(a, b, n): adjacent bytes of words (as two hex digits each), weighted by how often the word stands."""
    hexed = words.select(F.hex(F.encode("word", "utf-8")).alias("h"), "n").where("length(h) >= 4")
    pairs = hexed.select(F.explode(F.expr("transform(sequence(1, length(h) div 2 - 1), i -> substring(h, 2 * i - 1, 4))")).alias("p"), "n")
    return pairs.groupBy(F.substring("p", 1, 2).alias("a"), F.substring("p", 3, 2).alias("b")).agg(F.sum("n").alias("n"))


def merge_step(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    """Each non-overlapping occurrence of a pair, from the left, as one new id."""
    out, k = [], 0
    while k < len(ids):
        if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
            out.append(new)
            k += 2
        else:
            out.append(ids[k])
            k += 1
    return out


BLOCK = "ids binary, n binary, pairs array<struct<a:int,b:int,bytes:string,n:bigint>>"
BLOCK_IDS = 4_000_000


def merge_flat(x: np.ndarray, pair: tuple[int, int], new: int) -> np.ndarray:
    """merge_step over many words at once, -1 after each."""
    at = np.flatnonzero((x[:-1] == pair[0]) & (x[1:] == pair[1]))
    if pair[0] == pair[1] and len(at):  # in a run, every other one
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
    x[at] = new
    return np.delete(x, at + 1)


def block_pairs(x: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, how often) of adjacent ids under size, weighted by the words' counts."""
    word = np.cumsum(x < 0)[:-1]
    real = (x[:-1] >= 0) & (x[1:] >= 0)
    key, at = np.unique(x[:-1][real] * np.int64(size) + x[1:][real], return_inverse=True) if size > 2048 else (np.arange(size * size), x[:-1][real] * np.int64(size) + x[1:][real])
    count = np.bincount(at, n[word[real]], len(key)).astype(np.int64)
    there = np.flatnonzero(count)
    return key[there] // size, key[there] % size, count[there]


def block_row(x: np.ndarray, n: np.ndarray, text: list[bytes]) -> pa.RecordBatch:
    a, b, count = (v.tolist() for v in block_pairs(x, n, len(text)))
    pairs = [{"a": i, "b": j, "bytes": (text[i] + text[j]).hex(), "n": c} for i, j, c in zip(a, b, count)]
    kind = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.string()), ("n", pa.int64())])
    return pa.RecordBatch.from_pydict({"ids": pa.array([x.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary()), "pairs": pa.array([pairs], pa.list_(kind))})


def train(words: DataFrame, merges: int) -> list[tuple[int, int]]:
    """Merges in order: the commonest pair (ties: the larger merged bytes, then the smaller ids), then again. All words
    count. They stay distributed, as blocks of ids that each step rewrites with their pair counts; the driver gets the best
    pair of the step."""
    ready_workers(words.sparkSession)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = token_bytes([])
        held: list[np.ndarray] = []
        counts: list[int] = []
        size = 0
        for batch in batches:
            for w, c in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                held.append(np.append(np.frombuffer(w, np.uint8).astype(np.int32), np.int32(-1)))
                counts.append(c)
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield block_row(np.concatenate(held), np.array(counts, np.int64), text)
                    held, counts, size = [], [], 0
        if held:
            yield block_row(np.concatenate(held), np.array(counts, np.int64), text)

    def step(out: list[tuple[int, int]]):
        text = token_bytes(out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    x = merge_flat(np.frombuffer(r["ids"], np.int32).copy(), out[-1], len(text) - 1)
                    yield block_row(x, np.frombuffer(r["n"], np.int64), text)

        return run

    each = words.select(F.encode("word", "utf-8").alias("word"), "n").where("octet_length(word) > 1")
    state = materialize(each.mapInArrow(start, BLOCK), "bpe-words")
    out: list[tuple[int, int]] = []
    while len(out) < merges:
        pairs = state.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b", "p.bytes").agg(F.sum("p.n").alias("n"))
        best = pairs.agg(F.max(F.struct("n", "bytes", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("m")).first().m
        if best is None:
            break
        out.append((-best.a, -best.b))
        if len(out) < merges:
            new = materialize(state.select("ids", "n").mapInArrow(step(list(out)), BLOCK), "bpe-words")
            drop(state)
            state = new
    drop(state)
    return out


def combine(lists: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Merge lists one after the other, by merged bytes: those already there and those whose parts are missing are skipped."""
    text = {i: bytes([i]) for i in range(256)}
    ids = {v: k for k, v in text.items()}
    out: list[tuple[int, int]] = []
    for merges in lists:
        own = {i: bytes([i]) for i in range(256)}
        for k, (a, b) in enumerate(merges):
            own[256 + k] = own[a] + own[b]
            if own[a] in ids and own[b] in ids and own[256 + k] not in ids:
                out.append((ids[own[a]], ids[own[b]]))
                text[256 + len(out) - 1] = own[256 + k]
                ids[own[256 + k]] = 256 + len(out) - 1
    return out


def encode_word(word: str, ranks: dict[tuple[int, int], int]) -> list[int]:
    """Ids of one pre-token: always the lowest-ranked pair first."""
    ids = list(word.encode())
    while len(ids) > 1:
        best = min(zip(ids, ids[1:]), key=lambda p: ranks.get(p, 1 << 60))
        if best not in ranks:
            break
        ids = merge_step(ids, best, 256 + ranks[best])
    return ids


#: Pre-tokens whose ids a task keeps.
KEPT_WORDS = 500_000


def encode(df: DataFrame, merges: list[tuple[int, int]], c: str = "text") -> DataFrame:
    """(doc_id, ids): a task encodes each pre-token that it keeps once; nothing is shuffled. Null texts have no ids."""
    ready_workers(df.sparkSession)
    ranks = {p: k for k, p in enumerate(merges)}
    split = re.compile(PRE_TOKEN).findall
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for text in batch.column(c).to_pylist():
                ids: list[int] = []
                for word in split(text or ""):
                    own = known.get(word)
                    if own is None:
                        own = encode_word(word, ranks)
                        if len(known) < KEPT_WORDS:
                            known[word] = own
                    ids += own
                out.append(ids)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(out, pa.list_(pa.int32()))})

    return df.select("doc_id", c).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_bytes(merges: list[tuple[int, int]]) -> list[bytes]:
    """Bytes by id: the listing that model files hold."""
    out = [bytes([i]) for i in range(256)]
    for a, b in merges:
        out.append(out[a] + out[b])
    return out


def decode(df: DataFrame, merges: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, text) from ids; bytes that are no UTF-8 become the replacement character."""
    known = token_bytes(merges)

    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: b"".join(known[i] for i in x).decode("utf-8", "replace"))

    return df.select("doc_id", F.pandas_udf(run, "string")("ids").alias("text"))


def save_model(merges: list[tuple[int, int]]) -> str:
    return "\n".join(["bpe v1", *(f"{a} {b}" for a, b in merges)]) + "\n"


def load_model(raw: str) -> list[tuple[int, int]]:
    head, *rows = raw.rstrip("\n").split("\n")
    if head != "bpe v1":
        raise ValueError("no model file")
    return [tuple(map(int, r.split())) for r in rows]


def smallest_budget(cost, cap: float, most: int) -> int:
    """The smallest prefix length whose monotone cost is within the cap, by bisection; most if none is."""
    lo, hi = 0, most
    while lo < hi:
        mid = (lo + hi) // 2
        if cost(mid) <= cap:
            hi = mid
        else:
            lo = mid + 1
    return lo


def water_fill(worst_of, budget: int, step: int = 25) -> dict[str, int]:
    """A budget dealt out in steps, each to the language that is worst off by then."""
    given: dict[str, int] = {}
    while budget > 0:
        part = min(step, budget)
        lang = worst_of(given)
        given[lang] = given.get(lang, 0) + part
        budget -= part
    return given


def byte_code(c: Column, width: int) -> Column:
    """The first width bytes as numbers, padded with -1: the token's columns."""
    return F.expr(f"transform(sequence(1, {width}), i -> if(i <= octet_length({c._jc.toString()}), cast(conv(substring(hex(encode({c._jc.toString()}, 'utf-8')), 2 * i - 1, 2), 16, 10) as int), -1))")


def shifted(rows: DataFrame, offset: int) -> DataFrame:
    """(row, pos, token, valid, doc_id) with the target at an offset (null beyond the row)."""
    w = W.partitionBy("row").orderBy("pos")
    move = (lambda c: F.lead(c, offset).over(w)) if offset >= 0 else (lambda c: F.lag(c, -offset).over(w))
    return rows.withColumn("target", move("token")).withColumn("target_valid", move("valid")).withColumn("target_doc", move("doc_id"))


def loss_mask(padding: bool = True, boundaries: bool = True) -> Column:
    """Whether a pair counts: a target that is real, and of the same document."""
    ok = F.col("target").isNotNull()
    if padding:
        ok = ok & F.coalesce("target_valid", F.lit(False))
    return ok & F.coalesce(F.col("target_doc") == F.col("doc_id"), F.lit(False)) if boundaries else ok
