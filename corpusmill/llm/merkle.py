"""Document fingerprints: Merkle trees over sections, paragraphs and sentences (operator 4).

A paragraph is a line with its line end; a section is a run of paragraphs that ends after one whose hash has two zero
bits at its end, or before a blank line's end, so an edit moves no later border. A paragraph's leaves are its sentences,
long ones cut after words chosen by their own bytes. Leaves cover every character, so equal roots mean equal texts (up to
a 128-bit hash) and the branches that differ locate edits.

The fingerprint is text: the root, then each section's, paragraph's and leaf's shortened hash:
``root;S(P[leaf leaf ...]P[...])S(...)`` with 32, 8, 8 and 6 hex digits.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize, ready_workers
from .bpe import by_bytes
from .tokenbin import input_bytes

#: Sentences of more bytes than this are cut within.
LONG = 240
PARAGRAPH = re.compile(rb"[^\n]*\n|[^\n]+")
SENTENCE = re.compile(rb"[^.!?]*[.!?]+\s*|[^.!?]+")
WORD = re.compile(rb"\S*\s*")
SECTION = re.compile(r"([0-9a-f]{8})\(((?:[0-9a-f]{8}\[[0-9a-f]*\])*)\)")
PARA = re.compile(r"([0-9a-f]{8})\[([0-9a-f]*)\]")


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def pieces(paragraph: bytes) -> list[bytes]:
    """The leaves of a paragraph."""
    out = []
    for s in SENTENCE.findall(paragraph):
        if len(s) <= LONG:
            out.append(s)
            continue
        begin = at = 0
        for w in WORD.findall(s):
            at += len(w)
            if at - begin >= 32 and w and digest(w)[0] % 8 == 0 or at - begin > 4 * LONG:
                out.append(s[begin:at])
                begin = at
        if begin < len(s):
            out.append(s[begin:])
    return out


def tree(text: bytes) -> str:
    """The fingerprint of a text in UTF-8."""
    sections, current = [], []
    for p in PARAGRAPH.findall(text):
        leaves = [digest(x) for x in pieces(p)]
        node = digest(b"P" + b"".join(leaves))
        current.append((node, leaves))
        if node[15] & 3 == 0 or not p.strip():
            sections.append(current)
            current = []
    if current:
        sections.append(current)
    nodes = [digest(b"S" + b"".join(n for n, _ in s)) for s in sections]
    root = digest(b"R" + len(text).to_bytes(8, "big") + b"".join(nodes))
    shown = [f"{n.hex()[:8]}({''.join(f'{p.hex()[:8]}[' + ''.join([x.hex()[:6] for x in leaves]) + ']' for p, leaves in s)})" for n, s in zip(nodes, sections)]
    return f"{root.hex()};{''.join(shown)}"


def levels(fingerprint: str) -> list[tuple[str, list[tuple[str, list[str]]]]]:
    """Sections of a fingerprint, as (hash, [(paragraph's hash, leaves)])."""
    return [(s, [(p, re.findall("......", x)) for p, x in PARA.findall(rest)]) for s, rest in SECTION.findall(fingerprint[33:])]


def likeness(a: str, b: str) -> float:
    """Share of leaves in common, 2 |A and B| / (|A| + |B|), counting repeats: equal sections first, then equal
    paragraphs of the rest, then leaves of the rest. 1 for equal roots; an empty text is like nothing else."""
    if a[:32] == b[:32]:
        return 1.0
    sides = levels(a), levels(b)
    total = sum(len(x) for side in sides for _, ps in side for _, x in ps)
    if not total:
        return 0.0
    same = 0
    for depth in (0, 1):
        common = Counter(n for n, _ in sides[0]) & Counter(n for n, _ in sides[1])
        rests = []
        for k, side in enumerate(sides):
            left, rest = Counter(common), []
            for name, below in side:
                if left[name]:
                    left[name] -= 1
                    if not k:
                        same += sum(len(x) for _, x in below) if not depth else len(below)
                else:
                    rest += below if not depth else [below]
            rests.append(rest)
        sides = tuple(rests)
    leaves = [Counter(x for below in side for x in below) for side in sides]
    same += (leaves[0] & leaves[1]).total()
    return min(1.0, 2 * same / total)


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places in a, counted from 0, of paragraphs that b doesn't have: where a was edited."""
    if a[:32] == b[:32]:
        return []
    whole = Counter(s for s, _ in levels(b))
    loose = Counter(p for _, ps in levels(b) for p, _ in ps)
    out = []
    for i, (s, ps) in enumerate(levels(a)):
        if whole[s]:
            whole[s] -= 1
            loose -= Counter(p for p, _ in ps)
            continue
        for j, (p, _) in enumerate(ps):
            if loose[p]:
                loose[p] -= 1
            else:
                out.append((i, j))
    return out


def edited(text: str, after: str) -> str:
    """text with its last half of code points replaced by the first as many of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare(text: str, own: str, after: str, of_after: str) -> tuple[str, str, float, float]:
    """(edited text's SHA-256, its fingerprint, likeness to it, likeness to the next document)."""
    raw = edited(text, after).encode()
    print_ = tree(raw)
    return hashlib.sha256(raw).hexdigest(), print_, likeness(own, print_), likeness(own, of_after)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint) of every row's whole text; null counts as empty. No shuffle."""
    ready_workers(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fingerprint": pa.array(map(tree, part.column("text").to_pylist()), pa.string())})

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fingerprint string")


OUT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
KINDS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_neighbours(df: DataFrame, part_bytes: int = 8_000_000) -> DataFrame:
    """The contract's rows: each document against its edited text and the next document in descending doc_id.

    Texts are sorted once by range; within a partition each row has its neighbour before it. The first row of a
    partition meets the last of the one before in a join on the partition's number, where only those rows have texts.
    Rows that repeat a doc_id are ordered by text; null ids count as smallest; a lone document is its own next. Null texts
    count as empty, long ones whole; an empty table gives no rows; ids may be of any type that has an order; other columns
    are left out.
    """
    ready_workers(df.sparkSession)
    src = df.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    parts = max(1, -(-input_bytes(src) // part_bytes))
    src = src.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        part = None
        for batch in batches:
            rows = []
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = tree(text.encode())
                first = last is None
                sha, of_edited, near_edited, near_next = ("", "", 0.0, 0.0) if first else compare(text, own, *last)
                rows.append((doc, len(text), sha, own, of_edited, near_edited, near_next, part, "first" if first else "", text if first else None))
                last = text, own
            yield table_of(rows)
        if last is not None:
            yield table_of([(None, 0, "", last[1], "", 0.0, 0.0, part, "last", last[0])])

    names = [*OUT, "part", "edge", "text"]
    arrow_kinds = [None, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string()]

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_pydict({n: pa.array(c, k or id_kind) for n, c, k in zip(names, columns, arrow_kinds)})

    id_kind = to_arrow_type(src.schema["doc_id"].dataType)
    held = materialize(src.mapInArrow(run, f"doc_id {kind}, {KINDS}, part bigint, edge string, text string"), "merkle")
    inner = held.where("edge = ''").select(*OUT)
    firsts = held.where("edge = 'first'").select("part", "doc_id", "text", "fingerprint")
    lasts = held.where("edge = 'last'").select(F.col("part").alias("before"), F.col("text").alias("after"), F.col("fingerprint").alias("of_after"))
    order = held.where("edge = 'first'").select("part")
    before = F.coalesce(F.lag("part").over(W.orderBy("part")), F.max("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    pairs = firsts.join(order.select("part", before.alias("before")), "part").join(lasts, "before")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out.append((r["doc_id"], len(r["text"]), *(x := compare(r["text"], r["fingerprint"], r["after"], r["of_after"]))[:1], r["fingerprint"], *x[1:]))
            columns = list(zip(*out)) or [()] * len(OUT)
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k or id_kind) for n, c, k in zip(OUT, columns, arrow_kinds)})

    return inner.union(pairs.mapInArrow(meet, f"doc_id {kind}, {KINDS}"))
