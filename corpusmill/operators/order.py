"""Places in an order, without a task that sorts all rows or all of a large group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Adds each row's place (from 0) in this order within its keys.

    Rows are dealt out by ranges of (keys, order) and sorted there, so a group may span many partitions. What comes before a
    partition is summed over one row for each group and partition. The ranges are written once, as drawing them again could
    cut elsewhere; pass narrow rows. The order must tell rows apart, or equal ones get any of their places.
    """
    cut = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    held = materialize(cut.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per = held.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), F.col("_part").alias("_its"), "_first", "_before")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)), F.col("_part") == F.col("_its"))
    return held.join(per, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).select(*df.columns, name)
