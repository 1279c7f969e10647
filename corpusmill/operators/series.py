"""Series over steps: trailing statistics, spikes, robust z-scores, smoothing, settling, and lookups in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spikes(df: DataFrame, by: str, order: str, value: str, window: int = 8, sigmas: float = 2.0) -> DataFrame:
    """Rows over the mean of the window before them by so many population deviations, with z and the three values before;
    only where the window is full."""
    w = W.partitionBy(by).orderBy(order)
    back = w.rowsBetween(-window, -1)
    out = df.withColumn("mu", F.avg(value).over(back)).withColumn("sd", F.stddev_pop(value).over(back)).withColumn("n", F.count(value).over(back))
    out = out.withColumn("before", F.collect_list(value).over(w.rowsBetween(-3, -1)))
    return out.where((F.col("n") == window) & (F.col("sd") > 0) & (F.col(value) > F.col("mu") + sigmas * F.col("sd"))).withColumn("z", (F.col(value) - F.col("mu")) / F.col("sd"))


def array_median(x: Column) -> Column:
    s = F.array_sort(x)
    n = F.size(s)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def robust_z(df: DataFrame, by: str, order: str, value: str, window: int = 25) -> DataFrame:
    """Adds z against the median and scaled absolute deviation of the window before; the population deviation where that
    is 0; 0 before the window is full."""
    back = W.partitionBy(by).orderBy(order).rowsBetween(-window, -1)
    out = df.withColumn("_x", F.collect_list(value).over(back)).withColumn("_m", array_median(F.col("_x")))
    out = out.withColumn("_d", 1.4826 * array_median(F.transform("_x", lambda v: F.abs(v - F.col("_m"))))).withColumn("_s", F.stddev_pop(value).over(back))
    scale = F.when(F.col("_d") > 0, F.col("_d")).otherwise(F.col("_s"))
    z = F.when((F.size("_x") == window) & (scale > 0), (F.col(value) - F.col("_m")) / F.nullif(scale, F.lit(0.0))).otherwise(0.0)
    return out.withColumn("z", z).drop("_x", "_m", "_d", "_s")


def centred_mean(df: DataFrame, by: str, order: str, value: str, half: int = 4) -> DataFrame:
    """Adds the centred moving average; beyond the ends the end values repeat."""
    w = W.partitionBy(by).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at, n = F.row_number().over(w), F.count("*").over(W.partitionBy(by))
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    inner = F.sum(value).over(w.rowsBetween(-half, half))
    lack_low, lack_high = F.greatest(F.lit(0), half + 1 - at), F.greatest(F.lit(0), at + half - n)
    return df.withColumn("smooth", (inner + lack_low * first + lack_high * last) / (2 * half + 1))


def settled(df: DataFrame, by: str, order: str, good: Column) -> DataFrame:
    """(by, step): the first place from which all later rows are good; none where the last is not."""
    rest = W.partitionBy(by).orderBy(order).rowsBetween(W.currentRow, W.unboundedFollowing)
    return df.withColumn("_ok", F.min(F.coalesce(good, F.lit(False)).cast("int")).over(rest) == 1).where("_ok").groupBy(by).agg(F.min(order).alias("step"))


def next_at_or_after(left: DataFrame, right: DataFrame, by: str, order: str) -> DataFrame:
    """As-of lookup forward: for each left row the first right row of its key at or after it, by a sorted union instead of a
    range join. right: (by, order)."""
    u = left.select(by, F.col(order).alias("_t"), F.lit(None).cast("long").alias("_hit")).unionByName(right.select(by, F.col(order).alias("_t"), F.col(order).cast("long").alias("_hit")))
    ahead = W.partitionBy(by).orderBy("_t").rangeBetween(W.currentRow, W.unboundedFollowing)
    found = u.withColumn("_next", F.min("_hit").over(ahead)).where("_hit IS NULL").select(by, F.col("_t").alias(order), F.col("_next").alias("next"))
    return found


def refractory(df: DataFrame, by: str, order: str, gap: int) -> DataFrame:
    """Rows of events at least gap after the last one taken: a fold over each key's sorted places."""
    places = df.groupBy(by).agg(F.array_sort(F.collect_list(F.col(order).cast("long"))).alias("_x"))
    fold = F.aggregate("_x", F.array().cast("array<bigint>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) >= gap), F.array_append(a, x)).otherwise(a))
    return places.select(by, F.explode(fold).alias(order))
