"""Overlap with evaluation text: n-gram fingerprints, verbatim runs, verdicts, the admission gate and the firewall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows

N = 13
WINDOW = 12
MIN_RUN, MIN_WINDOWS, MIN_RATIO = 48, 64, 0.30
BLOCKED_LICENSES = ("unknown", "restricted", "noncommercial_restricted")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, eval_stride: int = 1, doc_stride: int = 1) -> DataFrame:
    """doc_ids that share an n-gram with the benchmark. Strides over 1 on both sides miss shifted overlaps."""
    return windows.overlaps(docs, benchmark, n, eval_stride, doc_stride).where("hits > 0").select("doc_id").distinct()


def runs(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, windows, hits, run): a document's windows, those that stand in the benchmark, and the longest run of these."""
    return windows.overlaps(docs, benchmark, n)


def verdicts(runs: DataFrame) -> DataFrame:
    """Adds hit_ratio and reason: verbatim_run, saturated_overlap or null."""
    ratio = F.col("hits") / F.greatest(F.lit(1), F.col("windows"))
    reason = F.when(F.col("run") >= MIN_RUN, "verbatim_run").when((F.col("windows") >= MIN_WINDOWS) & (ratio >= MIN_RATIO), "saturated_overlap")
    return runs.withColumn("hit_ratio", F.round(ratio, 6)).withColumn("reason", reason)


def refusals(tokenizer: str) -> Column:
    """All reasons why a manifest may not be trained on, in a fixed order; empty if admitted."""
    c = F.col
    return F.array_compact(
        F.array(
            F.when(~c("tokenizer_hash").eqNullSafe(tokenizer), F.lit("tokenizer_hash_mismatch")),
            F.when(~c("split").eqNullSafe("train"), F.concat(F.lit("split_not_trainable:"), F.coalesce("split", F.lit("None")))),
            F.when(~c("permission").eqNullSafe("trainable"), F.concat(F.lit("permission:"), F.coalesce("permission", F.lit("None")))),
            F.when(F.coalesce("never_train", F.lit(False)), F.lit("never_train_flag")),
            F.when(F.coalesce("license", F.lit("unknown")).isin(*BLOCKED_LICENSES), F.lit("license_not_admissible")),
            F.when(~c("dedup_status").eqNullSafe("exact_dedup_pass"), F.lit("dedup_status_missing")),
            F.when(~c("contamination_status").eqNullSafe("clean"), F.concat(F.lit("contamination:"), F.coalesce("contamination_status", F.lit("None")))),
            F.when(F.coalesce("cleaning_pipeline_hash", F.lit("")) == "", F.lit("unknown_cleaning_lineage")),
        )
    )


def admit(manifests: DataFrame, tokenizer: str) -> DataFrame:
    """Adds reasons and admitted."""
    out = manifests.withColumn("reasons", refusals(tokenizer))
    return out.withColumn("admitted", F.size("reasons") == 0)


def consumption_violations(consumed: DataFrame, registry: DataFrame) -> DataFrame:
    """(shard_id, problem): consumed shards that are unknown, not trainable or not admitted."""
    out = consumed.select(F.explode("shard_ids").alias("shard_id")).distinct().join(registry, "shard_id", "left")
    problem = F.when(F.col("permission").isNull(), "unknown").when(F.col("permission") != "trainable", "not_trainable").when(~F.col("admitted"), "not_admitted")
    return out.select("shard_id", problem.alias("problem")).where("problem IS NOT NULL")
