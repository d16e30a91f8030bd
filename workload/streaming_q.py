"""Streaming jobs run over the tables as streams and drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.streaming import jobs, state
from workload import conformance_q
from workload.base import register, scratch, table


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


REFRESHED_SQL = """
WITH RECURSIVE f AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderstatus AS st, o_orderpriority AS prio, o_orderkey * 10 AS ts,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
s AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS VARCHAR) AS etag, CAST(NULL AS BIGINT) AS fetched FROM f
  UNION ALL
  SELECT s.k, f.n,
    CASE WHEN st = 'F' AND (content IS NULL OR ts - fetched >= 86400) THEN 'page ' || id ELSE content END,
    CASE WHEN st = 'F' AND (content IS NULL OR ts - fetched >= 86400) THEN 'e' || prio ELSE etag END,
    CASE WHEN st = 'F' AND content IS NULL THEN ts WHEN st IN ('F', 'O') AND ts - fetched >= 86400 THEN ts ELSE fetched END
  FROM s JOIN f ON f.k = s.k AND f.n = s.n + 1)
SELECT '/c/' || k AS path, content, etag FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1) WHERE content IS NOT NULL
"""
FETCHES = (
    "concat('c/', o_custkey, '/') AS path", "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'not_modified' ELSE 'permanent' END AS kind",
    "if(o_orderstatus = 'F', concat('page ', o_orderkey), NULL) AS body", "concat('e', o_orderpriority) AS etag", "timestamp_seconds(o_orderkey * 10) AS ts")


@register("cache_refresh_stream", REFRESHED_SQL)
def cache_refresh_stream(spark, sf):
    fetched = _stream(spark, sf, "orders").selectExpr(*FETCHES)
    target = scratch(spark)
    jobs.cache_refresh_stream(fetched, f"{target}/log", f"{target}/state").awaitTermination()
    return jobs.current_cache(spark, f"{target}/log").select("path", "content", "etag")


@register("keyed_refresh_stream", REFRESHED_SQL)
def keyed_refresh_stream(spark, sf):
    """The fetch log in three parts by time, each a micro-batch of its own, with the entries in keyed state."""
    orders = table(spark, sf, "orders")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    target = scratch(spark)
    third = F.floor((F.col("o_orderkey") - low) * 3 / (high - low + 1))
    for part in range(3):
        orders.where(third == part).coalesce(1).write.mode("append").parquet(f"{target}/fetches")
    source = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(f"{target}/fetches")
    state.keyed_refresh_stream(source.selectExpr(*FETCHES), f"{target}/changes", f"{target}/state").awaitTermination()
    return state.keyed_cache(spark, f"{target}/changes").select("path", "content", "etag")


@register("validate_stream", f"WITH {conformance_q.ISSUES_SQL} SELECT body_id, level, rule, field FROM issues")
def validate_stream(spark, sf):
    bodies = _stream(spark, sf, "orders").selectExpr(
        "o_orderkey AS body_id", f"{conformance_q.ENDPOINT} AS endpoint", f"{conformance_q.BODY} AS body")
    found = jobs.validate_stream(
        bodies, conformance_q.endpoints(spark), conformance_q.schemas(spark), conformance_q.rules(spark))
    return jobs.run_once(found.select("body_id", "level", "rule", "field"), scratch(spark))


@register("dead_letters", "SELECT o_orderkey AS body_id, CASE o_custkey % 8 WHEN 5 THEN 'invalid_json' ELSE 'not_object' END AS reason FROM orders WHERE o_custkey % 8 IN (5, 6)")
def dead_letters(spark, sf):
    bodies = _stream(spark, sf, "orders").selectExpr(
        "o_orderkey AS body_id", f"{conformance_q.ENDPOINT} AS endpoint", f"{conformance_q.BODY} AS body")
    return jobs.run_once(jobs.dead_letters(bodies).select("body_id", "reason"), scratch(spark))


# The stream emits a window once the watermark (newest time less ten minutes) has passed its end.
@register("conformance_windows", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS endpoint, CAST(count(*) AS BIGINT) AS bodies,
  CAST(count(*) FILTER (WHERE value < 10) AS BIGINT) AS failed
FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
""")
def conformance_windows(spark, sf):
    checked = _stream(spark, sf, "events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type AS endpoint", "value >= 10 AS ok")
    windows = jobs.run_once(jobs.conformance_windows(checked), scratch(spark))
    return windows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "endpoint", "bodies", "failed")


@register("conformance_windows_batch", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS endpoint, CAST(count(*) AS BIGINT) AS bodies,
  CAST(count(*) FILTER (WHERE value < 10) AS BIGINT) AS failed FROM events GROUP BY ALL
""")
def conformance_windows_batch(spark, sf):
    checked = table(spark, sf, "events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type AS endpoint", "value >= 10 AS ok")
    windows = jobs.conformance_windows(checked)
    return windows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "endpoint", "bodies", "failed")
