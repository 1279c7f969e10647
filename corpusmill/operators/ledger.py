"""Hash-chained ledgers, coverage, checkpoints and replay, as relations over (ledger, seq, body)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0" * 64


def chain(df: DataFrame, by: str, seq: str, body: str) -> DataFrame:
    """Adds prev_hash and event_hash: SHA-256 of the hash before and the body. A chain is sequential, so each ledger is
    folded in one place; ledgers run in parallel."""
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(body).alias("b")))).alias("_x"))
    fold = F.expr(f"aggregate(_x, named_struct('h', '{GENESIS}', 'o', cast(array() as array<struct<s:bigint,p:string,e:string>>)), (a, x) -> named_struct('h', sha2(concat(a.h, x.b), 256), 'o', array_append(a.o, named_struct('s', x.s, 'p', a.h, 'e', sha2(concat(a.h, x.b), 256)))), a -> a.o)")
    out = rows.select(by, F.explode(fold).alias("y")).select(by, F.col("y.s").alias(seq), F.col("y.p").alias("prev_hash"), F.col("y.e").alias("event_hash"))
    return df.join(out, [by, seq])


def verify(df: DataFrame, by: str, seq: str, body: str) -> DataFrame:
    """(by, seq, violation): the first seq_gap, prev_mismatch or hash_mismatch of each ledger. Every row is checked against
    the one before it, so the check is parallel within a ledger too."""
    w = W.partitionBy(by).orderBy(seq)
    before = F.coalesce(F.lag("event_hash").over(w), F.lit(GENESIS))
    gap = F.col(seq) != F.coalesce(F.lag(seq).over(w) + 1, F.lit(0))
    bad = F.when(gap, "seq_gap").when(F.col("prev_hash") != before, "prev_mismatch").when(F.col("event_hash") != F.sha2(F.concat("prev_hash", body), 256), "hash_mismatch")
    return df.withColumn("violation", bad).where("violation IS NOT NULL").groupBy(by).agg(F.min(F.struct(seq, "violation")).alias("x")).select(by, f"x.{seq}", "x.violation")


def offsets(df: DataFrame, by: str, seq: str) -> DataFrame:
    """(by, count, tail_hash)."""
    return df.groupBy(by).agg(F.count("*").alias("count"), F.max_by("event_hash", seq).alias("tail_hash"))


def truncate(df: DataFrame, marks: DataFrame, by: str, seq: str) -> DataFrame:
    """Rows before each ledger's mark (by, count, tail_hash). Raises if a ledger is shorter or its tail differs."""
    out = df.join(marks.select(by, F.col("count").alias("_n"), F.col("tail_hash").alias("_t")), by).where(F.col(seq) < F.col("_n"))
    whole = W.partitionBy(by)
    right = (F.count("*").over(whole) == F.col("_n")) & (F.max_by("event_hash", seq).over(whole) == F.col("_t"))
    return out.withColumn("_ok", F.when(right, F.lit(True)).otherwise(F.raise_error(F.lit("the ledger doesn't reach its checkpoint")).cast("boolean"))).where("_ok").drop("_n", "_t", "_ok")


def coverage(seen: DataFrame, by: str, step: str) -> DataFrame:
    """(by, rows, distinct, duplicates, missing, extra, exactly_once, monotonic): steps seen, in order of seq, against
    0 .. max."""
    w = W.partitionBy(by).orderBy("seq")
    flat = seen.withColumn("_up", F.coalesce(F.col(step) > F.lag(step).over(w), F.lit(True)))
    out = flat.groupBy(by).agg(F.count("*").alias("rows"), F.count_distinct(step).alias("distinct"), F.max(step).alias("_max"), F.bool_and("_up").alias("monotonic"))
    out = out.withColumn("duplicates", F.col("rows") - F.col("distinct")).withColumn("missing", F.col("_max") + 1 - F.col("distinct"))
    return out.withColumn("exactly_once", (F.col("duplicates") == 0) & (F.col("missing") == 0)).drop("_max")
