"""Event-time windows over events: the streaming extensions, run as batch queries here and as streams in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..session import table
from ..streaming import windows


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def flat(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(F.unix_seconds("window.start").alias("start"), *cols)


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    """Counts by hour and type."""
    return flat(windows.tumbling(events(spark, sf_dir), "1 hour", "10 minutes", "event_type"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT CAST(epoch(s) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s")
def sliding_windows(spark, sf_dir):
    """Two-hour windows every hour."""
    return flat(windows.sliding(events(spark, sf_dir), "2 hours", "1 hour"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    """Sessions of a user, closed by two hours without an event."""
    s = windows.sessions(events(spark, sf_dir), "2 hours", "10 minutes", "user_id")
    return s.select("user_id", F.unix_micros("session_window.start").alias("start"), "n")
