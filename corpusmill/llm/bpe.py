"""BPE encoding and decoding with a pair occurrence index (operator 10).

All distinct chunks of a batch are laid out in one array of symbols. An index maps each adjacent pair that has a merge
rank to all its positions. The active ranks are taken in ascending order; all positions of a pair merge at once and the
lists of the neighbouring pairs are updated. As a merge never makes a pair of a lower rank (checked on loading), each
chunk gets the ids it would get alone.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import ready_workers
from .chunks import WORD_PATTERN, ChunkCache, Folding, check_file, read_file

#: Ids decoded at a time, which bounds the memory for their strings.
DECODE_IDS = 1_000_000
#: Bytes of text encoded at a time.
SLICE_BYTES = 4_000_000
#: Fixed value: the pattern of the word_bpe file for lower-case ASCII.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+")


class PairIndexCodec:
    """Ids of chunks by merging over a pair occurrence index; vocabulary, merges and splitting come from the file."""

    at_once = 80_000

    def __init__(self, path: str):
        spec = read_file(path)
        check_file(spec)
        self.fold = Folding(spec)
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.tok = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fast = any(p.get("pattern", {}).get("Regex") == WORD_PATTERN for p in spec["pre_tokenizer"]["pretokenizers"])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        rank_of = np.full(max(self.vocab.values()) + 1, -1)
        rank_of[self.made[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(rank_of[self.left], rank_of[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before the merges that make its parts")
        keys = (self.left << 32) | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 without one."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def pieces(self, chunk: str) -> list[str]:
        if self.fast and chunk.isascii() and chunk.isprintable():
            return ASCII_WORDS.findall(chunk.lower())
        normal = self.tok.normalizer.normalize_str(chunk) if self.tok.normalizer else chunk
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal)]

    def __call__(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, their numbers)."""
        index: dict[str, int] = {}
        plan: list[list[int]] = []
        for chunk in chunks.to_pylist():
            if self.special_re and "<" in chunk and self.special_re.search(chunk):
                parts = []
                for part in self.special_re.split(chunk):
                    if part in self.special:
                        parts.append(-1 - self.special[part])
                    elif part:
                        parts += [index.setdefault(p, len(index)) for p in self.pieces(part)]
                plan.append(parts)
            else:
                plan.append([index.setdefault(p, len(index)) for p in self.pieces(chunk)])
        words = self.merge_all(list(index))
        ids = [words[parts[0]] if len(parts) == 1 and parts[0] >= 0 else [i for k in parts for i in (words[k] if k >= 0 else (-1 - k,))] for parts in plan]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())), lens

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words (each one pre-tokenizer piece)."""
        vocab, end = self.vocab, self.end
        sym: list[int] = []
        lens = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            row = [vocab[c] for c in w[:-1]]
            row.append(vocab[w[-1] + end])
            lens[k] = len(row)
            sym += row
        n = len(sym)
        if not n:
            return [[] for _ in words]
        sym_a = np.array(sym, np.int64)
        last = np.zeros(n, bool)
        last[np.cumsum(lens) - 1] = True
        nxt = np.where(last, n, np.arange(1, n + 1))
        nxt = np.append(nxt, n)
        prv = np.arange(-1, n - 1)
        prv[np.append(0, np.cumsum(lens)[:-1])] = n
        prv = np.append(prv, n)
        sym_a = np.append(sym_a, -1)
        live = np.ones(n + 1, bool)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(pos: np.ndarray) -> None:
            """Put positions of pairs that have a rank into the index."""
            rank = self.ranks(sym_a[pos], sym_a[nxt[pos]])
            keep = rank >= 0
            pos, rank = pos[keep], rank[keep]
            if not len(pos):
                return
            by = np.argsort(rank, kind="stable")
            pos, rank = pos[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(pos, cuts)):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(part)

        add(np.flatnonzero(~last))
        while heap:
            r = heapq.heappop(heap)
            found = lists.pop(r)
            pos = found[0] if len(found) == 1 else np.concatenate(found)
            a, b = self.left[r], self.right[r]
            pos = pos[live[pos] & (sym_a[pos] == a) & (sym_a[nxt[pos]] == b)]
            if len(pos) > 1 and (len(found) > 1 or a == b):
                pos = np.unique(pos)
                if a == b:  # in a run of equal symbols, every second pair
                    start = np.append(True, nxt[pos[:-1]] != pos[1:])
                    at = np.arange(len(pos))
                    pos = pos[(at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 0]
            if not len(pos):
                continue
            gone = nxt[pos]
            live[gone] = False
            sym_a[pos] = self.made[r]
            sym_a[gone] = -1
            after = nxt[gone]
            nxt[pos] = after
            prv[after] = pos  # place n only takes what is never read
            before = prv[pos]
            before = before[before < n]
            add(pos[after < n] if not len(before) else np.concatenate([pos[after < n], before]))
        ids = sym_a[:n][live[:n]]
        per_word = np.add.reduceat(live[:n].astype(np.int64), np.append(0, np.cumsum(lens)[:-1]))
        out, ends = ids.tolist(), np.cumsum(per_word).tolist()
        return [out[s:e] for s, e in zip([0, *ends[:-1]], ends)]


_CACHES: dict[tuple[str, str], ChunkCache] = {}


def cache_for(kind: str, path: str, make) -> ChunkCache:
    """The cache of this worker, which later tasks use again; it is bounded."""
    if (kind, path) not in _CACHES:
        _CACHES[kind, path] = ChunkCache(make(path))
    return _CACHES[kind, path]


def give_back() -> None:
    """Arrow keeps freed memory for later; idle workers need none."""
    pa.default_memory_pool().release_unused()


def token_strings(path: str) -> pa.Array:
    """Token strings by id; ids without one are null."""
    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out: list[str | None] = [None] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = token
    return pa.array(out, pa.string())


def decode_lists(ids: np.ndarray, counts: np.ndarray, strings: pa.Array) -> pa.Array:
    """Texts of lists of ids, as decode(ids, skip_special_tokens=False) of a file without decoder: joined by a space."""
    parts, begin = [], 0
    ends = np.append(0, np.cumsum(counts))
    while begin < len(counts):
        to = max(begin + 1, int(np.searchsorted(ends, ends[begin] + DECODE_IDS, side="right")) - 1)
        tokens = strings.take(pa.array(ids[ends[begin] : ends[to]]))
        lists = pa.ListArray.from_arrays(pa.array((ends[begin : to + 1] - ends[begin]).astype(np.int32)), tokens)
        parts.append(pc.binary_join(lists, " "))
        begin = to
    return pa.chunked_array(parts, pa.string())


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Rows (id, n_tokens, ids array<int>[, decoded]) of every row's whole text.

    A null or empty text has no ids and decodes to the empty text. Repeated rows and ids stay separate rows. Other
    columns are left out, whatever they are called. No shuffle; memory follows the Arrow batch.
    """
    ready_workers(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = token_strings(path) if decode else None
        cache = cache_for("pairs", path, PairIndexCodec)
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                ids, counts = cache.encode(part.column("text"))
                ends = np.append(0, np.cumsum(counts)).astype(np.int32)
                cols = {"id": part.column("id"), "n_tokens": pa.array(counts), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))}
                if decode:
                    cols["decoded"] = decode_lists(ids, counts, strings).combine_chunks()
                yield pa.RecordBatch.from_pydict(cols)
        give_back()

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_tokens bigint, ids array<int>" + (", decoded string" if decode else "")).withColumnRenamed("id", id_col)


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text; a longer row makes a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin = np.append(0, np.cumsum(size)), 0
    while begin < batch.num_rows:
        to = max(begin + 1, int(np.searchsorted(ends, ends[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, to - begin)
        begin = to


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, decoded) of lists of ids. Null and empty lists decode to the empty text; null ids and repeated rows are rows
    like others; an empty table gives no rows; other columns are left out."""
    ready_workers(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = token_strings(path)
        for batch in batches:
            lists = batch.column("ids")
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decode_lists(lists.flatten().to_numpy(zero_copy_only=False), counts, strings)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "decoded": texts.combine_chunks()})

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, decoded string").withColumnRenamed("id", id_col)


def encode_digest(df: DataFrame, path: str) -> DataFrame:
    """The contract's columns: digests of the decimal ids and of the decoded text."""
    return encode(df, path).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
