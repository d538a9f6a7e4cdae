"""The streaming operators over whole tables; a batch run must agree with the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.tables import cut
from quarry.plans.tables import CUR, q
from quarry.streaming import jobs


def stamped(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@q("windowed_query_statistics", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, query, count(*) AS n, round(avg(execution_time_ms), 6) AS mean_ms FROM query_log GROUP BY 1, 2")
def _(c):
    return jobs.query_statistics(stamped(c.query_log)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@q("user_sessions", "WITH g AS (SELECT result_count AS u, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY result_count ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM query_log), s AS (SELECT u, ts, sum(n) OVER (PARTITION BY u ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT u AS user, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY u, s")
def _(c):
    return jobs.sessions(stamped(c.query_log)).select("user", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@q("latest_status", f"SELECT doc_id, store, status FROM ({CUR}) c")
def _(c):
    return jobs.latest_status(c.ledger)


@q("ledger_changes", f"SELECT doc_id, store, status, event_id, false AS expired FROM ({CUR}) c")
def _(c):
    with jobs.keyed_state(c.spark):  # state is kept while the job runs, so it runs here
        return cut(jobs.ledger_changes(stamped(c.ledger)).select("doc_id", "store", "status", "event_id", "expired"))
