"""SimHash near-duplicates by a segment-popcount embedding (operator 7).

A fingerprint's 64 bits are 32 segments of two; their bit counts are a point of a grid, packed into 64 bits. The
Manhattan distance of two points is at most the Hamming distance of the fingerprints. So fingerprints that differ in at
most two bits have points at most two apart, and share a cell if each is put into its own cell and all cells one step
away. This range join gives the candidates: a cell of up to CELL fingerprints compares them with each other, and bit counts
verify each pair exactly. Fuller cells would make too many pairs. Their fingerprints are linked by another exact rule: two
differ in at most two bits if and only if some 64-bit value is at most one bit from both, so each emits its 65 such values
and is linked to the smallest of those that share one. That is a star for each shared value instead of all pairs, with the
same components. Only distinct fingerprints take part; each makes at most 65 rows, and a cell at most CELL a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import drop, materialize, ready_workers
from .aside import set_aside
from .bpe import by_bytes

WIDTH, SEED = 3, 42
SALTS = 16
#: Fingerprints in a cell that are compared pair by pair.
CELL = 64
#: Every second bit of 64, as a signed number.
ODD_BITS = 0x5555555555555555


def hash_shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; fewer words than width: of all words; none: nothing."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    h, join = xxhash.xxh64_intdigest, b" ".join
    rows = zip(*(words[k : n + k] for k in range(width))) if len(words) >= width else [words]
    return np.fromiter((h(join(r), SEED) for r in rows), np.uint64, n)


def fingerprint(text: bytes | None) -> int:
    """The SimHash: a bit is 1 if set in over half the shingle hashes; 0 without words."""
    hashes = hash_shingles(text or b"")
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """Rows (doc_id, fp bigint, the 64 bits as a signed number[, text_hash]) for every row; null texts have no words."""
    ready_workers(df.sparkSession)
    more = [F.xxhash64(text_col).alias("text_hash")] if text_hash else []
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                fps = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fp": pa.array(fps)} | ({"text_hash": part.column("text_hash")} if text_hash else {}))

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp bigint" + (", text_hash bigint" if text_hash else ""))


def cells(fps: DataFrame) -> DataFrame:
    """(cell, fp): each fingerprint's own grid cell and those one step away."""
    x, half = F.col("fp"), F.shiftrightunsigned(F.col("fp"), 1)
    odd = F.lit(ODD_BITS)
    point = F.shiftleft(x.bitwiseAND(half).bitwiseAND(odd), 1).bitwiseOR(x.bitwiseXOR(half).bitwiseAND(odd))
    step = F.expr("explode(sequence(0, 64))")
    at = fps.select("fp", point.alias("point"), step.alias("s"))
    count = F.expr("shiftrightunsigned(point, int(2 * pmod(s - 1, 32))) & 3L")
    moved = F.expr("CASE WHEN s = 0 THEN point WHEN s <= 32 THEN point ^ shiftleft(1L, int(2 * pmod(s - 1, 32))) ELSE point ^ shiftleft(3L, int(2 * pmod(s - 1, 32))) END")
    #: 0 -> 1 and 1 -> 0 flip the low bit of a count, 1 -> 2 and 2 -> 1 both bits.
    possible = (F.col("s") == 0) | ((F.col("s") <= 32) & (count <= 1)) | ((F.col("s") > 32) & (count >= 1))
    return at.where(possible).select(moved.alias("cell"), "fp")


def in_range(fps: DataFrame) -> DataFrame:
    """(cell, fp, n) of the cells that n > 1 of the distinct fingerprints share. A cell's rows meet once, in a window that
    spills; nothing is joined back."""
    return cells(fps).withColumn("n", F.count("*").over(W.partitionBy("cell"))).where("n > 1")


def links(fps: DataFrame, most: int = CELL) -> DataFrame:
    """Edges (u, v), v < u, between fingerprints within two bits, with the components of all such pairs; fps: distinct."""
    shared = materialize(in_range(fps), "simhash-cells")
    few = shared.where(F.col("n") <= most).groupBy("cell").agg(F.collect_list("fp").alias("members"))
    pairs = few.select(F.explode("members").alias("u"), "members").select("u", F.expr("explode(filter(members, v -> v < u AND bit_count(u ^ v) <= 2))").alias("v"))
    many = shared.where(F.col("n") > most).select("fp").distinct()
    middle = many.select("fp", F.expr("explode(sequence(0, 64))").alias("b")).select("fp", F.expr("CASE WHEN b = 0 THEN fp ELSE fp ^ shiftleft(1L, b - 1) END").alias("mid"))
    star = middle.withColumn("v", F.min("fp").over(W.partitionBy("mid"))).where("v < fp").select(F.col("fp").alias("u"), "v")
    return pairs.union(star).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v): each node that has an edge and is not the smallest of its component, and that smallest one.

    Alternates the large-star and small-star steps, each a group minimum and a join; written to the shared folder
    after each round, until nothing changes.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(edges, "star")
    was = state(e)
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct()
        new = materialize(small, "star")
        drop(e)
        e, now = new, state(new)
        if now == was:
            return e
        was = now
    raise RuntimeError("components did not settle")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", told_apart: bool = False) -> DataFrame:
    """Rows (doc_id, fp, component_id[, text_hash, root]) for every row of df; root, a fingerprint, is a component's own.

    component_id is the smallest doc_id that links reach. Texts without words have fingerprint 0 and link like others.
    Repeated rows share a component. Null ids are kept; a component of null ids only is null. An empty table gives none.
    """
    held = materialize(fingerprints(df, id_col, text_col, told_apart), "simhash-fp")
    nodes = held.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes now, but 50 cells for each to come
    tree = components(links(nodes.select("fp").repartition(parts, "fp")))
    rooted = nodes.join(tree.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    ends = tree.select(F.col("v").alias("fp")).distinct().withColumn("linked", F.lit(True))
    rooted = rooted.join(ends, "fp", "left")
    lows = rooted.where("root <> fp OR linked").groupBy("root").agg(F.min("low").alias("low"))
    of_links = rooted.where("root <> fp OR linked").select("fp", "root").join(lows, "root").select("fp", F.col("low").alias("component_id"), "root")
    of_copies = rooted.where("root = fp AND linked IS NULL AND n > 1").select("fp", F.col("low").alias("component_id"), "root")
    known = of_links.union(of_copies).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rows = held.withColumn("salt", F.expr(f"int(pmod(xxhash64(doc_id), {SALTS}))"))
    return rows.join(known, ["fp", "salt"], "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"), *(["text_hash", F.coalesce("root", "fp").alias("root")] if told_apart else []))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents, one of each component: a row with its smallest doc_id, of several such the one with the least hash of
    its text. Rows of one id are told apart by their text.

    Null and empty texts have no words and form one component. Rows of null ids stay, of those that repeat a text one. Long
    texts count whole; an empty table gives none; other columns stay as they are, whatever they are called.
    """
    docs, back = set_aside(docs)
    marks = materialize(near_duplicates(docs, told_apart=True), "simhash-marks")
    first = marks.where("doc_id = component_id").groupBy("root").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least < most").drop("most")
    others = marks.where("doc_id = component_id").join(first, "root").where("text_hash > least")
    losers = marks.where("doc_id <> component_id").unionByName(others.drop("least")).select(F.col("doc_id").alias("_loser"), F.col("text_hash").alias("_hash")).distinct()
    kept = docs.withColumn("_text", F.xxhash64("text")).join(losers, (F.col("doc_id") == F.col("_loser")) & (F.col("_text") == F.col("_hash")), "left_anti")
    return kept.dropDuplicates(["doc_id", "_text"]).select(back)


def hex16(fp) -> F.col:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
