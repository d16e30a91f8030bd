"""Fetch logs, cache tables, snapshots, gates and notes."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from docweave.operators import cache, fetchlog, notes, quality
from docweave.plans import index_build
from docweave.sources import readers, snapshots
from workload.base import register, scratch, table
from workload.fixtures import api_pages

NOW = datetime.datetime(2024, 1, 20, 12, 0, 0)
NOW_SQL = "TIMESTAMP '2024-01-20 12:00:00'"

# ---------------------------------------------------------------- fetch log

ATTEMPTS = """inline(CASE o_custkey % 6
  WHEN 0 THEN array(named_struct('v', 0, 'a', 1, 's', 200, 'e', CAST(NULL AS STRING)))
  WHEN 1 THEN array(named_struct('v', 0, 'a', 1, 's', 503, 'e', NULL), named_struct('v', 0, 'a', 2, 's', 404, 'e', NULL), named_struct('v', 1, 'a', 1, 's', 200, 'e', NULL))
  WHEN 2 THEN array(named_struct('v', 0, 'a', 1, 's', 404, 'e', NULL), named_struct('v', 1, 'a', 1, 's', 404, 'e', NULL))
  WHEN 3 THEN array(named_struct('v', 0, 'a', 1, 's', 502, 'e', NULL), named_struct('v', 0, 'a', 2, 's', 200, 'e', NULL))
  WHEN 4 THEN array(named_struct('v', 0, 'a', 1, 's', 304, 'e', NULL))
  ELSE array(named_struct('v', 0, 'a', 1, 's', CAST(NULL AS INT), 'e', 'timeout'), named_struct('v', 0, 'a', 2, 's', 500, 'e', NULL),
             named_struct('v', 0, 'a', 3, 's', NULL, 'e', 'reset'), named_struct('v', 1, 'a', 1, 's', 200, 'e', NULL)) END)"""


def attempts(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderpriority", "o_orderdate", ATTEMPTS)
    return rows.selectExpr(
        "concat('/d/', o_orderkey) AS path", "v AS variant_no", "a AS attempt_no", "s AS status", "e AS error_kind", "'x' AS etag",
        "if(s = 200, concat(o_orderpriority, ' page'), NULL) AS body", "o_orderdate AS ts")


@register("classify_attempts", """
SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'transient' ELSE CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'not_found' WHEN 'error' THEN 'transient'
  WHEN 'purchase' THEN 'permanent' ELSE 'not_modified' END END AS kind FROM events
""")
def classify_attempts(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "if(user_id % 7 = 0, 'timeout', NULL) AS error_kind",
        "CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 404 WHEN 'error' THEN 429 WHEN 'purchase' THEN 403 ELSE 304 END AS status")
    return fetchlog.classify_attempts(rows).select("event_id", "kind")


@register("slash_variants", """
SELECT c_name AS path, 0 AS variant_no, c_name AS candidate FROM customer WHERE c_nationkey < 9
UNION ALL SELECT c_name, 1, c_name || '/' FROM customer WHERE c_nationkey < 9
UNION ALL SELECT c_name || '//', 0, c_name || '//' FROM customer WHERE c_nationkey >= 9
UNION ALL SELECT c_name || '//', 1, c_name FROM customer WHERE c_nationkey >= 9
""")
def slash_variants(spark, sf):
    paths = table(spark, sf, "customer").selectExpr("if(c_nationkey < 9, c_name, concat(c_name, '//')) AS path")
    return fetchlog.slash_variants(paths)


@register("resolve_fetch", """
SELECT '/d/' || o_orderkey AS path, CASE o_custkey % 6 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS variant_no,
  CASE o_custkey % 6 WHEN 3 THEN 2 WHEN 5 THEN 3 ELSE 1 END AS attempt_no,
  CASE o_custkey % 6 WHEN 2 THEN 'not_found' WHEN 4 THEN 'not_modified' WHEN 5 THEN 'transient' ELSE 'ok' END AS kind, o_custkey % 6 NOT IN (2, 5) AS ok
FROM orders
""")
def resolve_fetch(spark, sf):
    return fetchlog.resolve_fetch(attempts(spark, sf)).select("path", "variant_no", "attempt_no", "kind", "ok")


@register("sanity_filter", "SELECT page_id FROM pages WHERE contains(lower(html), 'queaux') OR contains(lower(html), 'of the')")
def sanity_filter(spark, sf):
    return fetchlog.sanity_filter(table(spark, sf, "pages"), ("QUEAUX", "Of The")).select("page_id")


@register("split_results", """
SELECT '/d/' || o_orderkey AS path, CASE o_custkey % 6 WHEN 2 THEN 'not_found' WHEN 5 THEN 'transient' ELSE 'suspicious' END AS kind,
  CASE o_custkey % 6 WHEN 2 THEN 'HTTP 404' WHEN 5 THEN 'network error: reset' ELSE 'content does not look like documentation' END AS error
FROM orders WHERE o_custkey % 6 IN (2, 5) OR (o_custkey % 6 IN (0, 1, 3) AND o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED'))
""")
def split_results(spark, sf):
    return fetchlog.split_results(fetchlog.resolve_fetch(attempts(spark, sf)), ("1-", "2-", "3-"))[1]


@register("batch_totals", """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE o_custkey % 6 NOT IN (2, 5)) AS BIGINT) AS succeeded,
  CAST(count(*) FILTER (WHERE o_custkey % 6 IN (2, 5)) AS BIGINT) AS failed FROM orders
""")
def batch_totals(spark, sf):
    return fetchlog.batch_totals(fetchlog.resolve_fetch(attempts(spark, sf)))


# ---------------------------------------------------------------- cache


@register("classify_fresh", f"SELECT event_id, {NOW_SQL} - ts < INTERVAL 24 HOUR AS fresh FROM events")
def classify_fresh(spark, sf):
    return cache.classify_fresh(table(spark, sf, "events"), NOW, fetched_at="ts").select("event_id", "fresh")


@register("cache_stats", f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE {NOW_SQL} - ts < INTERVAL 24 HOUR) AS BIGINT) AS fresh,
  CAST(count(*) FILTER (WHERE NOT ({NOW_SQL} - ts < INTERVAL 24 HOUR)) AS BIGINT) AS stale, 86400 AS ttl_seconds,
  CAST(floor((epoch_us({NOW_SQL}) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS oldest FROM events
""")
def cache_stats(spark, sf):
    stats = cache.cache_stats(table(spark, sf, "events"), NOW, fetched_at="ts")
    return stats.select("total", "fresh", "stale", "ttl_seconds", F.floor("oldest_age_seconds").alias("oldest"))


def stored(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "concat('/c/', c_custkey) AS path", "c_name AS content", "concat('e', c_nationkey) AS etag",
        "TIMESTAMP '2024-01-20 12:00:00' - make_interval(0, 0, 0, 0, c_nationkey * 2, 0, 0) AS fetched_at")


def fetched(spark, sf):
    """Several results per path, in order of the order key, over days."""
    return table(spark, sf, "orders").selectExpr(
        "concat('c/', o_custkey, '/') AS path",
        "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'not_modified' ELSE 'transient' END AS kind",
        "if(o_orderstatus = 'F', concat('new ', o_orderkey), NULL) AS body", "if(o_orderstatus = 'F', concat('n', o_orderkey), NULL) AS etag",
        "timestamp_micros(1705752000000000 + o_orderkey * 10000000) AS ts")


REFRESH_SQL = """
WITH RECURSIVE f AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderstatus AS st, 1705752000 + o_orderkey * 10 AS ts,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
s AS (
  SELECT coalesce(c_custkey, k) AS k, CAST(0 AS BIGINT) AS n, c_name AS content, 'e' || c_nationkey AS etag,
    CAST(1705752000 - c_nationkey * 7200 AS BIGINT) AS fetched, coalesce(c_nationkey * 2 < 24, FALSE) AS young, FALSE AS touched, CAST(NULL AS VARCHAR) AS outcome
  FROM customer FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) ON k = c_custkey
  UNION ALL
  SELECT k, n, CASE WHEN o = 'replaced' THEN 'new ' || id ELSE content END, CASE WHEN o = 'replaced' THEN 'n' || id ELSE etag END,
    CASE WHEN o IN ('replaced', 'revalidated') THEN ts ELSE fetched END, young, touched OR o IN ('replaced', 'revalidated'),
    CASE WHEN o = 'fresh' THEN coalesce(outcome, o) ELSE o END
  FROM (SELECT s.k, f.n, content, etag, fetched, young, touched, outcome, id, ts,
      CASE WHEN content IS NOT NULL AND (young OR (touched AND ts - fetched < 86400)) THEN 'fresh' WHEN st = 'F' THEN 'replaced'
        WHEN content IS NOT NULL AND st = 'O' THEN 'revalidated' WHEN content IS NOT NULL THEN 'stale' ELSE 'error' END AS o
    FROM s JOIN f ON f.k = s.k AND f.n = s.n + 1))
SELECT '/c/' || k AS path, coalesce(outcome, CASE WHEN young THEN 'fresh' WHEN content IS NOT NULL THEN 'stale' ELSE 'error' END) AS outcome,
  content, etag, CAST(fetched AS BIGINT) AS fetched
FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1
"""


@register("refresh_merge", REFRESH_SQL)
def refresh_merge(spark, sf):
    merged = cache.refresh_merge(stored(spark, sf), fetched(spark, sf), NOW)
    return merged.select("path", "outcome", "content", "etag", F.unix_seconds("fetched_at").alias("fetched"))


@register("warm_diff", """
SELECT CASE WHEN c_nationkey > 20 THEN 'error' WHEN c_nationkey > 10 OR c_nationkey = 0 THEN 'fetched' ELSE 'unchanged' END AS kind, CAST(count(*) AS BIGINT) AS pages
FROM customer GROUP BY kind
""")
def warm_diff(spark, sf):
    batch = table(spark, sf, "customer").selectExpr(
        "concat('c/', c_custkey, '/') AS path", "if(c_nationkey > 20, NULL, if(c_nationkey > 10, concat(c_name, '!'), c_name)) AS content",
        "if(c_nationkey > 20, 'HTTP 500', NULL) AS error")
    return cache.warm_diff(stored(spark, sf).where("etag <> 'e0'"), batch)


@register("put_many", """
WITH last AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS content FROM orders GROUP BY o_custkey)
SELECT '/c/' || o_custkey AS path, content, CAST(NULL AS VARCHAR) AS etag FROM last
UNION ALL SELECT '/c/' || c_custkey, c_name, 'e' || c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM last)
""")
def put_many(spark, sf):
    batch = table(spark, sf, "orders").selectExpr(
        "concat('c/', o_custkey) AS path", "o_orderkey AS seq", "o_orderpriority AS content")
    return cache.put_many(stored(spark, sf), batch, NOW).select("path", "content", "etag")


@register("invalidate", "SELECT '/c/' || c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def invalidate(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'P'").selectExpr("concat('c/', o_custkey, '/') AS path")
    return cache.invalidate(stored(spark, sf), gone).select("path")


# ---------------------------------------------------------------- snapshots and gates


@register("snapshot_round_trip", """
SELECT 'error_codes' AS entity, CAST(p_partkey AS VARCHAR) AS code, p_name AS reason FROM part
UNION ALL SELECT 'endpoints', c_mktsegment, c_name FROM customer
""")
def snapshot_round_trip(spark, sf):
    root = scratch(spark)
    codes = table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS code", "p_name AS reason")
    routes = table(spark, sf, "customer").selectExpr("c_mktsegment AS method", "c_name AS path")
    snapshots.write_snapshot({"error_codes": codes.limit(0), "endpoints": routes}, root, "1", datetime.datetime(2024, 1, 1))
    snapshots.write_snapshot({"error_codes": codes, "endpoints": routes}, root, "2", datetime.datetime(2024, 1, 2))
    snapshots.write_snapshot({"error_codes": codes.limit(0), "endpoints": routes}, root, "3", datetime.datetime(2024, 1, 3), schema_version=4)
    read = snapshots.read_snapshot(spark, root, ("error_codes", "endpoints"))
    return read["error_codes"].select(F.lit("error_codes").alias("entity"), "code", "reason").unionByName(
        read["endpoints"].select(F.lit("endpoints").alias("entity"), F.col("method").alias("code"), F.col("path").alias("reason")))


@register("guarded_overwrite", "SELECT p_partkey AS page_ord, p_name AS title FROM part")
def guarded_overwrite(spark, sf):
    target = scratch(spark)
    rows = table(spark, sf, "part").selectExpr("p_partkey AS page_ord", "p_name AS title")
    snapshots.guarded_overwrite(rows, target)
    try:
        snapshots.guarded_overwrite(rows.where("page_ord < 0"), target)
    except ValueError:
        pass
    return spark.read.parquet(target)


@register("read_json_table", "SELECT CAST(count(*) FILTER (WHERE o_orderstatus <> 'P') AS BIGINT) AS good, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS bad FROM orders")
def read_json_table(spark, sf):
    target = scratch(spark)
    table(spark, sf, "orders").selectExpr(
        "if(o_orderstatus = 'P', concat('{\"path\": ', o_orderkey), to_json(named_struct('path', concat('/', o_orderkey), 'error', o_orderpriority))) AS value").write.text(target)
    good, bad = readers.read_json_table(spark, target, "path STRING, error STRING")
    return good.select(F.lit(1).alias("g"), F.lit(0).alias("b")).unionByName(
        bad.select(F.lit(0).alias("g"), F.lit(1).alias("b"))).agg(F.sum("g").alias("good"), F.sum("b").alias("bad"))


@register("build_index", """
SELECT 'endpoints' AS entity, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE p_size > 30) AS BIGINT) AS deprecated FROM part WHERE p_size <> 7
UNION ALL SELECT 'error_codes', 2 * count(*), 0 FROM part WHERE p_size <> 7
UNION ALL SELECT 'status_codes', count(*), 0 FROM part WHERE p_size <> 7
UNION ALL SELECT 'schemas', count(*), 0 FROM part WHERE p_size <> 7
UNION ALL SELECT 'releases', 0, 0
UNION ALL SELECT 'validation_rules', count(*), 0 FROM part WHERE p_size <> 7
UNION ALL SELECT 'parse_errors', count(*), 0 FROM part WHERE p_size = 7
""")
def build_index(spark, sf):
    pages = api_pages(spark, sf).withColumn("html", F.expr("if(contains(html, '<div>f7</div>'), NULL, html)"))
    index = index_build.build_index(pages, "/notes", "/notes/upcoming", suffix_word="Vendor")
    names = ("endpoints", "error_codes", "status_codes", "schemas", "releases", "validation_rules", "parse_errors")
    return quality.index_summary({name: index[name] for name in names})


@register("rebuild", """
SELECT version, entity, CASE entity WHEN 'error_codes' THEN 2 * n ELSE n END AS n
FROM (SELECT 'first' AS version, CAST(count(*) AS BIGINT) AS n FROM part),
  (VALUES ('endpoints'), ('error_codes'), ('status_codes'), ('schemas'), ('catalog'), ('validation_rules')) AS e(entity)
""")
def rebuild(spark, sf):
    """A build is accepted; two later ones, under its own and under another name, are rejected; readers keep the first."""
    root, pages = scratch(spark), api_pages(spark, sf)
    empty = pages.withColumn("html", F.lit("<p>nothing</p>"))
    days = [datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k) for k in range(3)]
    done = [index_build.rebuild(p, root, v, day, "/notes", "/notes/upcoming")
            for p, v, day in ((pages, "first", days[0]), (empty, "first", days[1]), (empty, "second", days[2]))]
    if done != [True, False, False]:
        raise AssertionError(f"accepted: {done}")
    names = ("endpoints", "error_codes", "status_codes", "schemas", "catalog", "validation_rules")
    read = snapshots.read_snapshot(spark, root, names)
    counts = [read[name].agg(F.count("*").alias("n")).withColumn("entity", F.lit(name)) for name in names]
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.unionByName(more)
    return rows.withColumn("version", F.lit(read["manifest"].first()["version"])).select("version", "entity", "n")


@register("capture_parse_errors", "SELECT '/docs/' || lower(p_type) || '/' || p_partkey || '/' AS path, 'no content' AS error FROM part WHERE p_size = 7")
def capture_parse_errors(spark, sf):
    from docweave.operators import html

    pages = api_pages(spark, sf).withColumn("html", F.expr("if(contains(html, '<div>f7</div>'), NULL, html)"))
    return html.parse_errors(html.shred_html(pages))


@register("index_summary", """
SELECT 'endpoints' AS entity, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE p_size > 30) AS BIGINT) AS deprecated FROM part
UNION ALL SELECT 'releases', count(*), 0 FROM orders UNION ALL SELECT 'error_codes', count(*), 0 FROM lineitem
""")
def index_summary(spark, sf):
    return quality.index_summary({
        "endpoints": table(spark, sf, "part").selectExpr("p_size > 30 AS deprecated"),
        "releases": table(spark, sf, "orders"), "error_codes": table(spark, sf, "lineitem")})


@register("first_errors", "SELECT '/p/' || o_orderkey AS path, o_orderpriority AS error FROM orders ORDER BY path, error LIMIT 20")
def first_errors(spark, sf):
    return quality.first_errors(table(spark, sf, "orders").selectExpr("concat('/p/', o_orderkey) AS path", "o_orderpriority AS error"))


@register("failure_rate_gate", """
SELECT CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS errors, CAST(count(*) AS BIGINT) AS pages,
  count(*) FILTER (WHERE o_orderstatus = 'P') / count(*) >= 0.25 AS incomplete FROM orders
""")
def failure_rate_gate(spark, sf):
    orders = table(spark, sf, "orders")
    return quality.failure_rate_gate(orders.where("o_orderstatus = 'P'"), orders.agg(F.count("*").alias("pages"))).select(
        "errors", "pages", "incomplete")


@register("structural_floors", """
SELECT 'endpoints' AS entity, CAST(count(*) AS BIGINT) AS n, CAST(10 AS BIGINT) AS floor, count(*) >= 10 AS ok FROM part
UNION ALL SELECT 'error_codes', count(*), 20, count(*) >= 20 FROM orders
UNION ALL SELECT 'status_codes', count(*), 8, count(*) >= 8 FROM region
UNION ALL SELECT 'schemas', NULL, 5, FALSE
""")
def structural_floors(spark, sf):
    counts = quality.index_summary({
        "endpoints": table(spark, sf, "part").selectExpr("p_size > 30 AS deprecated"),
        "error_codes": table(spark, sf, "orders"), "status_codes": table(spark, sf, "region")})
    return quality.structural_floors(counts)


@register("resolve_tier", """
SELECT CAST(o_custkey AS VARCHAR) AS name,
  arg_min(CASE o_orderstatus WHEN 'F' THEN 'user-local' WHEN 'O' THEN 'remote' ELSE 'baseline' END, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS source
FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey
""")
def resolve_tier(spark, sf):
    copies = table(spark, sf, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS name", "CASE o_orderstatus WHEN 'F' THEN 'user-local' WHEN 'O' THEN 'remote' ELSE 'baseline' END AS tier",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 4 ELSE 5 END AS schema_version", "o_orderkey AS rows")
    return quality.resolve_tier(copies).select("name", "source")


@register("freshness", f"""
WITH h AS (SELECT event_id, (epoch_us({NOW_SQL}) - epoch_us(ts)) / 3600000000 AS hours FROM events)
SELECT event_id, CASE WHEN hours < 48 THEN CAST(CAST(round_even(hours, 0) AS BIGINT) AS VARCHAR) || 'h old'
  ELSE CAST(CAST(round_even(hours / 24, 0) AS BIGINT) AS VARCHAR) || 'd old' END AS age FROM h
""")
def freshness(spark, sf):
    return quality.freshness(table(spark, sf, "events"), NOW, "ts").select("event_id", "age")


@register("diff_snapshots", """
SELECT CAST(p_partkey AS VARCHAR) AS code, p_brand AS endpoint, CASE WHEN p_size = 1 THEN 'removed' ELSE 'changed' END AS change FROM part WHERE p_size = 1 OR p_size > 25
UNION ALL SELECT 's' || s_suppkey, 'new', 'added' FROM supplier
""")
def diff_snapshots(spark, sf):
    part = table(spark, sf, "part")
    old = part.selectExpr("CAST(p_partkey AS STRING) AS code", "p_brand AS endpoint", "p_name AS reason", "array(p_type) AS tags")
    new = part.where("p_size <> 1").selectExpr(
        "CAST(p_partkey AS STRING) AS code", "p_brand AS endpoint", "p_name AS reason", "if(p_size > 25, array(p_type, 'x'), array(p_type)) AS tags")
    added = table(spark, sf, "supplier").selectExpr("concat('s', s_suppkey) AS code", "'new' AS endpoint", "s_name AS reason", "array('t') AS tags")
    return quality.diff_snapshots(old, new.unionByName(added), ["code", "endpoint"])


# ---------------------------------------------------------------- notes

NOTE = """concat('# Notes\\nintro ', c_custkey, '\\n## ', c_name, ' Life-cycle!\\n\\n### tip\\n- ', c_mktsegment, '\\n---\\nmore\\n\\n## Empty\\n\\n## Last ', c_nationkey, '\\r\\nend')"""


def note_rows(spark, sf):
    return table(spark, sf, "customer").selectExpr("CAST(c_custkey AS STRING) AS note_id", f"{NOTE} AS text")


@register("read_notes", "SELECT c_name || ' ' || c_mktsegment AS line FROM customer")
def read_notes(spark, sf):
    target = scratch(spark)
    lines = table(spark, sf, "customer").selectExpr("concat(c_name, ' ', c_mktsegment) AS value")
    lines.write.option("maxRecordsPerFile", 200).text(target)
    return readers.note_lines(readers.read_notes(spark, target)).where("line <> ''").select("line")


@register("split_topics", """
SELECT CAST(c_custkey AS VARCHAR) AS note_id, 0 AS ord, c_name || ' Life-cycle!' AS topic, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || 'lifecycle' AS topic_key,
  '### tip' || chr(10) || '- ' || c_mktsegment || chr(10) || '---' || chr(10) || 'more' AS body FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, 'Empty', 'empty', '' FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 2, 'Last ' || c_nationkey, 'last' || c_nationkey, 'end' FROM customer
""")
def split_topics(spark, sf):
    return notes.split_topics(note_rows(spark, sf))


@register("list_topics", """
SELECT CAST(c_custkey AS VARCHAR) AS note_id, 0 AS ord, c_name || ' Life-cycle!' AS topic FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, 'Empty' FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 2, 'Last ' || c_nationkey FROM customer
""")
def list_topics(spark, sf):
    return notes.list_topics(notes.split_topics(note_rows(spark, sf)))


LOOKUP_SQL = """
SELECT CASE o_orderstatus WHEN 'F' THEN upper('Customer ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) || '_LIFE cycle' WHEN 'O' THEN 'EMPTY' ELSE 'none' END AS requested,
  CASE WHEN o_orderstatus = 'F' AND c_custkey IS NOT NULL THEN '### tip' || chr(10) || '- ' || c_mktsegment || chr(10) || '---' || chr(10) || 'more' END AS body
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
"""
ASK = """CASE o_orderstatus WHEN 'F' THEN concat(upper(concat('Customer ', lpad(CAST(o_custkey AS STRING), 9, '0'))), '_LIFE cycle') WHEN 'O' THEN 'EMPTY' ELSE 'none' END AS topic"""


@register("lookup_topics", f"SELECT requested, body, body IS NOT NULL AS found FROM ({LOOKUP_SQL})")
def lookup_topics(spark, sf):
    found = notes.lookup_topics(table(spark, sf, "orders").selectExpr(ASK), notes.split_topics(note_rows(spark, sf)))
    return found.select("requested", "body", "found")


@register("missed_topics", f"SELECT requested FROM ({LOOKUP_SQL}) WHERE body IS NULL")
def missed_topics(spark, sf):
    return notes.missed_topics(table(spark, sf, "orders").selectExpr(ASK), notes.split_topics(note_rows(spark, sf)))
