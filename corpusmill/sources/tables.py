"""Sources and sinks: JSON lines, CSV inventories, manifests, token blobs, gzip slices; all through Spark's readers and writers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

INVENTORY = "lane string, dataset string, tokens_b double, samples_m double, license string, tier string, overlap_frac double, keep_frac double, confidence string, notes string"


def write_jsonl(df: DataFrame, path: str, gzip: bool = False) -> None:
    """One canonical JSON object a line; committed as any Spark output."""
    df.select(canonical_json(df).alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema if isinstance(schema, str) else schema).alias("r")).select("r.*")


def canonical_json(df: DataFrame):
    """A row as JSON with sorted keys, no spaces, non-ASCII kept, nulls left out."""
    return F.to_json(F.struct(*sorted(df.columns)))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A CSV inventory with casts; blank numbers are null, blank fractions their default."""
    return spark.read.csv(path, header=True, schema=INVENTORY).na.fill({"overlap_frac": 0.0, "keep_frac": 1.0})


def read_manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Manifests under a folder; index and plan files are left out."""
    return spark.read.schema(schema).json(path, pathGlobFilter="manifest*.json")


def load_config(raw: str) -> tuple[dict, str]:
    """A JSON specification and the hash of its bytes, by which derived tables may be named and reused."""
    return json.loads(raw), hashlib.sha256(raw.encode()).hexdigest()


def budgeted(df: DataFrame, shard: str, order: str, amount: str, per_shard: int, overall: int | None = None) -> DataFrame:
    """Rows while the amount before them is under the budget of their shard, then under that of all shards in order; the
    row that crosses a budget is kept. Shard totals are few; only they are ordered in one place."""
    before = F.coalesce(F.sum(amount).over(W.partitionBy(shard).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("_before", before).where(F.col("_before") < per_shard)
    if overall is None:
        return out.drop("_before")
    totals = out.groupBy(shard).agg(F.sum(amount).alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(W.orderBy(shard).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return out.join(totals.select(shard, "_base"), shard).where(F.col("_base") + F.col("_before") < overall).drop("_before", "_base")


def read_span(tokens, start, end):
    """Tokens [start, end) of an array column."""
    return F.slice(tokens, start + 1, end - start)


def write_files(df: DataFrame, name: str, text: str, path: str) -> str:
    """A text file for each row, in a folder of its name; names tell rows apart."""
    df.select(F.col(name).alias("name"), F.col(text).alias("value")).write.partitionBy("name").text(path)
    return path


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha, bytes) of every file under a path of write_files()."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", "name=([^/]*)/", 1).alias("name"), F.sha2("content", 256).alias("sha"), F.col("length").alias("bytes"))


def check_frozen(frozen: DataFrame, live: DataFrame) -> DataFrame:
    """(name, sha, bytes, verdict) of all frozen files: ok, or refused where the live one is gone or differs."""
    now = live.select("name", F.col("sha").alias("_sha"))
    return frozen.join(now, "name", "left").withColumn("verdict", F.when(F.col("sha").eqNullSafe(F.col("_sha")), "ok").otherwise("refused")).drop("_sha")


def frozen_or_raise(frozen: DataFrame, live: DataFrame) -> None:
    """Refuse to go on with files that differ from the frozen ones."""
    bad = check_frozen(frozen, live).where("verdict = 'refused'").select("name").limit(10).collect()
    if bad:
        raise ValueError("files differ from the frozen ones: " + ", ".join(sorted(r.name for r in bad)))
