"""Queries of the event-time windows, on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.plans.bind import query, table
from loomspan.streaming import counts


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts::TIMESTAMP, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark, d):
    x = counts.windowed(_events(spark, d), "6 hours")
    return x.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 2 HOUR, ts::TIMESTAMP, TIMESTAMP '1970-01-01') - to_hours(2 * k) AS s, event_type, value FROM events, (SELECT unnest([0, 1, 2]) AS k))
SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def stream_sliding(spark, d):
    x = counts.windowed(_events(spark, d), "6 hours", "2 hours")
    return x.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT user_id, strftime(min(ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def stream_sessions(spark, d):
    x = counts.sessions(_events(spark, d), "3 hours")
    return x.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
