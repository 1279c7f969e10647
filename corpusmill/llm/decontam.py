"""Benchmark decontamination with an FM-index for each training shard (operator 2).

A shard is a run of documents of one partition. Its words become numbers of the benchmark's vocabulary; a word outside
it can be in no window, so it ends a run, and runs shorter than the shortest window hold none: they stay out of the
index. The index of the rest answers a backward search for all windows at once; occurrences are located by sampled
suffix positions and mapped back, and their spans are merged. The benchmark is broadcast in chunks of a checked size, one at
a time, so it may be of any size.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize, ready_workers
from .aside import set_aside
from .bpe import by_bytes
from .fmindex import FMIndex

WINDOW = 13
#: The most bytes of benchmark text in one broadcast.
CHUNK_BYTES = 16_000_000
SHARD_BYTES = 8_000_000
#: A word is a run of ASCII letters and digits and of bytes beyond ASCII; A-Z count as a-z.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TABLE = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class Phrases:
    """The windows of some items, as numbers, grouped by length."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        seen: dict[tuple, int] = {}
        owners: list[list] = []
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 2) for w in words(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                at = seen.setdefault(tuple(ids[k : k + window]), len(seen))
                if at == len(owners):
                    owners.append([])
                if not owners[at] or owners[at][-1] != item:
                    owners[at].append(item)
        self.owners = owners
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in seen}):
            rows = [(w, k) for w, k in seen.items() if len(w) == n]
            self.by_length[n] = np.array([w for w, _ in rows], np.int64), np.array([k for _, k in rows])
        self.shortest = min(self.by_length, default=0)

    def find(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, window number) of all occurrences in the texts' words, one text after the other with a gap of one."""
        none = np.empty(0, np.int64)
        if not self.shortest:
            return none, none, none
        get = self.number.get
        flat: list[int] = []
        for ws in texts:
            flat += map(get, ws, repeat(0))
            flat.append(0)
        seq = np.array(flat, np.int64)
        known = np.concatenate([[0], (seq > 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        begins, ends = edge[::2], edge[1::2]
        keep = ends - begins >= self.shortest
        begins, ends = begins[keep], ends[keep]
        if not len(begins):
            return none, none, none
        lens = ends - begins + 1  # each run with the gap after it, which is symbol 1
        cuts = np.append(0, np.cumsum(lens))
        place = np.repeat(begins - cuts[:-1], lens) + np.arange(cuts[-1])
        run = seq[place]
        run[cuts[1:] - 1] = 1
        index = FMIndex(run)
        out = []
        for n, (patterns, numbers) in self.by_length.items():
            lo, hi = index.search(patterns)
            some = hi > lo
            lo, count, numbers = lo[some], (hi - lo)[some], numbers[some]
            if len(lo):
                rows = np.repeat(lo - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                out.append((place[index.locate(rows)], np.full(len(rows), n), np.repeat(numbers, count)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def chunks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark's rows in lists of at most so many bytes (or one row), streamed to the driver."""
    held, size = [], 0
    for item, text in benchmark.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).where(F.col(id_col).isNotNull()).toLocalIterator():
        text = bytes(text or b"")
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text) + 64
    if held:
        yield held


def spans_of(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans [start, end) from each run of hit words' first to its last."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(len(text[: at[s][0]].decode()), len(text[: at[e - 1][1]].decode())) for s, e in runs_of(hit).tolist()]


_PHRASES: dict[str, Phrases] = {}


def phrases(held, window: int) -> Phrases:
    """The broadcast's phrases; one broadcast's at a time is kept in a worker."""
    if held.value[0] not in _PHRASES:
        _PHRASES.clear()
        _PHRASES[held.value[0]] = Phrases(held.value[1], window)
    return _PHRASES[held.value[0]]


def runs_of(hit: np.ndarray) -> np.ndarray:
    """(start, end) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, item_ids, spans[, kept columns]), one for each row of docs.

    A null or empty text has no words; an item without words has no windows; items that repeat one id count once. Spans
    are in code points, merged over adjacent and overlapping windows. Items of null id and columns not named are left
    out. No shuffle. A benchmark beyond one chunk takes a pass over docs for each chunk, whose hits are written to the shared
    folder and go into the next pass, so one chunk is broadcast at a time.
    """
    spark = docs.sparkSession
    ready_workers(spark)
    item_kind = benchmark.schema["item_id"].dataType
    item_type, item_arrow = item_kind.simpleString(), to_arrow_type(item_kind)
    key = uuid.uuid4().hex  # workers are used again by later scans
    fields = [docs.schema[c] for c in dict.fromkeys(("doc_id", "text", *keep))]
    hits_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    spans_type = "array<struct<start:bigint,end:bigint>>"

    def search(held, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_bytes(batch, "text", SHARD_BYTES):
                    raw = part.column("text").cast(pa.binary()).to_pylist()
                    texts = [words(t) for t in raw]
                    ends = np.append(0, np.cumsum([len(w) + 1 for w in texts]))
                    cover = np.zeros(ends[-1] + 1, np.int64)
                    items: dict[int, set] = {}
                    if not first:
                        for k, (own, spans) in enumerate(zip(part.column("item_ids").to_pylist(), part.column("spans").to_pylist())):
                            if own:
                                items[k] = set(own)
                            for span in spans:
                                cover[ends[k] + span["start"]] += 1
                                cover[ends[k] + span["end"]] -= 1
                    known = phrases(held, window)
                    start, length, number = known.find(texts)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + length, -1)
                    doc = np.searchsorted(ends, start, side="right") - 1
                    pairs = np.unique(np.stack([doc, number]), axis=1) if len(doc) else np.empty((2, 0), np.int64)
                    for d, k in zip(*pairs.tolist()):
                        items.setdefault(d, set()).update(known.owners[k])
                    hit = np.cumsum(cover)[:-1] > 0
                    own_hit = lambda k: hit[ends[k] : ends[k + 1] - 1]
                    cols = {f.name: part.column(f.name) for f in fields if not last or f.name != "text" or "text" in keep}
                    if last:
                        spans = [[{"start": s, "end": e} for s, e in spans_of(raw[k], own_hit(k))] if k in items else [] for k in range(len(texts))]
                        cols["n_words"] = pa.array([len(w) for w in texts], pa.int64())
                        cols["n_hit"] = pa.array(np.add.reduceat(hit, ends[:-1], dtype=np.int64) if len(texts) else [], pa.int64())
                    else:
                        spans = [[{"start": s, "end": e} for s, e in runs_of(own_hit(k)).tolist()] if k in items else [] for k in range(len(texts))]
                    cols["item_ids"] = pa.array([sorted(items.get(k, ()), key=str) for k in range(len(texts))], pa.list_(item_arrow))
                    cols["spans"] = pa.array(spans, hits_type)
                    yield pa.RecordBatch.from_pydict(cols)

        out = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields if not last or f.name != "text" or "text" in keep]
        return run, ", ".join([*out, *(["n_words bigint, n_hit bigint"] if last else []), f"item_ids array<{item_type}>", f"spans {spans_type}"])

    parts = chunks(benchmark, "item_id", "text", chunk_bytes)
    rows, this, nth = docs.select(*(f.name for f in fields)), next(parts, []), 0
    while True:
        after = next(parts, None)
        held = spark.sparkContext.broadcast((f"{key}-{nth}", this))
        rows = rows.mapInArrow(*search(held, not nth, after is None))
        if after is None:
            return rows
        rows = materialize(rows, "decontam-pass")
        held.unpersist()
        this, nth = after, nth + 1


def contaminated():
    """The rule: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the rule doesn't judge contaminated, unchanged.

    Null and empty texts have no words and stay; long texts are searched whole; repeated rows and ids get their own
    decisions; an empty table gives none, an empty benchmark drops none. Other columns stay, whatever they are called.
    """
    plain, back = set_aside(docs)
    return scan(plain, benchmark, keep=tuple(plain.columns)).where(~contaminated()).select(back)


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """scan()'s rows, with text kept, and a column ``cleaned``: the text without the merged spans; null texts stay null."""
    keep = F.expr(f"""
        aggregate(
            spans,
            named_struct('at', 0L, 'out', ''),
            (a, s) -> named_struct('at', s.`end`, 'out', concat(a.out, substring({text_col}, int(a.at) + 1, int(s.start - a.at)))),
            a -> concat(a.out, substring({text_col}, int(a.at) + 1))
        )""")
    return found.withColumn("cleaned", keep)
