"""Release notes rendered from orders, and queries over entries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from docweave.operators import html, releases
from docweave.session import spread_small
from workload.base import register, table
from workload.fixtures import release_pages


def _entries_from_pages(spark, sf):
    return releases.parse_releases(html.shred_html(release_pages(spark, sf)))


ENTRY_SQL = """
SELECT o_orderkey AS page_ord, 1 AS k, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%B %d, %Y') AS raw_date,
       'api_changes' AS section, 2 AS n_changes FROM orders
UNION ALL SELECT o_orderkey, 2, NULL, 'Earlier releases', 'earlier', 1 FROM orders
UNION ALL SELECT o_orderkey, 3, strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%b ') || CAST(day(o_orderdate) AS VARCHAR) || strftime(o_orderdate, ', %Y'), 'sandbox', 1 FROM orders
UNION ALL SELECT o_orderkey, 4, NULL, 'Nothing here', 'earlier', 0 FROM orders
"""


@register("parse_releases", f"SELECT page_ord, date, raw_date, section, n_changes FROM ({ENTRY_SQL})")
def parse_releases(spark, sf):
    return _entries_from_pages(spark, sf).select(
        "page_ord", F.col("date").cast("string").alias("date"), "raw_date", "section", F.size("changes").alias("n_changes")
    )


@register("collect_changes", """
SELECT o_orderkey AS page_ord, 'api_changes' AS section, 'Feature ' || o_orderkey AS title,
       'First ' || o_orderpriority || E'\\n\\n- a\\n\\n- b ' || o_orderstatus AS body FROM orders
UNION ALL SELECT o_orderkey, 'api_changes', 'Empty', '' FROM orders
UNION ALL SELECT o_orderkey, 'earlier', 'Earlier releases', 'old ' || o_custkey || E'\\n\\n**sub**' FROM orders
UNION ALL SELECT o_orderkey, 'sandbox', strftime(o_orderdate, '%b ') || CAST(day(o_orderdate) AS VARCHAR) || strftime(o_orderdate, ', %Y'),
       E'```\\ncode ' || o_orderkey || E'\\n```' FROM orders
""")
def collect_changes(spark, sf):
    return releases.release_changes(_entries_from_pages(spark, sf)).select("page_ord", "section", "title", "body")


@register("classify_sections", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'api_changes' WHEN 'O' THEN 'sandbox' END AS section FROM orders
""")
def classify_sections(spark, sf):
    heading = F.expr("CASE o_orderstatus WHEN 'F' THEN 'Latest API Changes and Sandbox' WHEN 'O' THEN 'SANDBOX news' ELSE 'Other' END")
    return table(spark, sf, "orders").select("o_orderkey", releases.classify_section(heading).alias("section"))


@register("parse_release_dates", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders
""")
def parse_release_dates(spark, sf):
    text = F.expr("""CASE o_orderstatus WHEN 'F' THEN concat(' ', upper(date_format(o_orderdate, 'MMMM dd, yyyy')))
        WHEN 'O' THEN date_format(o_orderdate, 'MMM  d,  yyyy ') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END""")
    return table(spark, sf, "orders").select("o_orderkey", releases.parse_release_date(text).cast("string").alias("date"))


@register("parse_upcoming", """
SELECT o_orderkey AS page_ord, 'Upcoming' AS raw_date, 'upcoming' AS section,
       'Plan ' || o_orderkey || E'\\n\\nsoon ' || o_orderpriority || E'\\n\\n- x\\n\\n- y' AS body
FROM orders WHERE o_orderstatus <> 'P'
""")
def parse_upcoming(spark, sf):
    page = """if(o_orderstatus = 'P', '<main><h1>Upcoming</h1></main>', concat('<p>outside</p><main><h1>Upcoming</h1><h2>Plan ', o_orderkey,
        '</h2><nav><p>menu</p></nav><p>soon <b>', o_orderpriority, '</b></p><ul><li>x</li><li> y </li><li></li></ul></main>'))"""
    pages = spread_small(table(spark, sf, "orders")).selectExpr("o_orderkey AS page_id", "'/up' AS url", f"{page} AS html")
    return releases.parse_upcoming(html.shred_html(pages)).select(
        "page_ord", "raw_date", "section", F.col("changes")[0]["body"].alias("body")
    )


@register("rebucket_undated", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'earlier' ELSE 'sandbox' END AS section FROM orders
""")
def rebucket_undated(spark, sf):
    dated = table(spark, sf, "orders").selectExpr("o_orderkey", "if(o_orderpriority = '5-LOW', NULL, CAST(o_orderdate AS DATE)) AS date")
    return dated.select("o_orderkey", releases.entry_section(F.lit("sandbox"), F.col("date")).alias("section"))


ENTRIES = "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'api_changes' WHEN 'O' THEN 'sandbox' ELSE 'upcoming' END AS section, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS date FROM orders"


def entries(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS page_ord", "0 AS sec_ord", "0 AS entry_ord",
        "CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS date", "o_orderpriority AS raw_date",
        "CASE o_orderstatus WHEN 'F' THEN 'api_changes' WHEN 'O' THEN 'sandbox' ELSE 'upcoming' END AS section",
    )


@register("filter_since", f"SELECT o_orderkey AS page_ord, strftime(date, '%Y-%m-%d') AS date FROM ({ENTRIES}) WHERE date >= DATE '1997-06-15'")
def filter_since(spark, sf):
    return releases.filter_since(entries(spark, sf), "1997-06-15").select("page_ord", F.col("date").cast("string").alias("date"))


@register("filter_section", f"SELECT o_orderkey AS page_ord FROM ({ENTRIES}) WHERE section = 'sandbox'")
def filter_section(spark, sf):
    return releases.filter_section(entries(spark, sf), "sandbox").select("page_ord")


LATEST_SQL = f"""
WITH e AS ({ENTRIES}), top AS (SELECT * FROM e ORDER BY date DESC NULLS LAST, section, o_orderkey LIMIT 20)
"""


@register("latest_releases", LATEST_SQL + """
SELECT o_orderkey AS page_ord, section, strftime(date, '%Y-%m-%d') AS date, (SELECT CAST(count(*) AS BIGINT) FROM e) AS total FROM top
""")
def latest_releases(spark, sf):
    return releases.latest_releases(entries(spark, sf)).select("page_ord", "section", F.col("date").cast("string").alias("date"), "total")


@register("releases_by_section", LATEST_SQL + """
SELECT o_orderkey AS page_ord, section, CAST(CASE section WHEN 'api_changes' THEN 1 WHEN 'sandbox' THEN 2 ELSE 3 END AS INTEGER) AS section_rank,
       CAST(row_number() OVER (PARTITION BY section ORDER BY date DESC NULLS LAST, o_orderkey) AS INTEGER) AS position FROM top
""")
def releases_by_section(spark, sf):
    return releases.releases_by_section(entries(spark, sf)).select("page_ord", "section", "section_rank", "position")


CHANGES_SQL = """changes AS (
  SELECT p_partkey AS k, p_name AS title, 'About ' || p_type || ' of ' || p_brand AS body,
         CASE p_size % 4 WHEN 0 THEN 'api_changes' WHEN 1 THEN 'sandbox' WHEN 2 THEN 'upcoming' ELSE 'earlier' END AS section,
         CASE WHEN p_size % 4 < 2 THEN DATE '2024-01-01' + p_size END AS date FROM part)"""


def changes(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS page_ord", "0 AS sec_ord", "0 AS entry_ord", "0 AS change_ord", "p_name AS title",
        "concat('About ', p_type, ' of ', p_brand) AS body",
        "CASE p_size % 4 WHEN 0 THEN 'api_changes' WHEN 1 THEN 'sandbox' WHEN 2 THEN 'upcoming' ELSE 'earlier' END AS section",
        "CASE WHEN p_size % 4 < 2 THEN date_add(DATE '2024-01-01', p_size) END AS date", "p_name AS raw_date", "'/r' AS docs_path",
    )


@register("feature_status", f"""
WITH {CHANGES_SQL}, features AS (
  SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'BRAND#' || s_nationkey WHEN s_suppkey % 3 = 1 THEN 'ring about economy of brand#' || s_nationkey ELSE s_name END AS feature FROM supplier
), hits AS (
  SELECT feature, c.*, CASE section WHEN 'api_changes' THEN 1 WHEN 'sandbox' THEN 2 ELSE 3 END AS r
  FROM features f JOIN changes c ON contains(lower(title || ' ' || body), lower(feature)) WHERE section <> 'earlier'
), best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY feature ORDER BY r, date DESC NULLS LAST, k) = 1)
SELECT f.feature, CASE r WHEN 1 THEN 'Live' WHEN 2 THEN 'In Sandbox' WHEN 3 THEN 'Upcoming' ELSE 'Not documented' END AS status,
       strftime(date, '%Y-%m-%d') AS date, title AS evidence
FROM features f LEFT JOIN best USING (feature)
""")
def feature_status(spark, sf):
    features = table(spark, sf, "supplier").selectExpr(
        """CASE WHEN s_suppkey % 3 = 0 THEN concat('BRAND#', s_nationkey)
           WHEN s_suppkey % 3 = 1 THEN concat('ring about economy of brand#', s_nationkey) ELSE s_name END AS feature""")
    found = releases.feature_status(features, changes(spark, sf))
    return found.select("feature", "status", F.col("date").cast("string").alias("date"), "evidence")


@register("release_digest", f"""
WITH {CHANGES_SQL}
SELECT section, strftime(date, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS changes, CAST(count(*) FILTER (WHERE regexp_matches(title, '\\bold\\b')) AS BIGINT) AS deprecations
FROM (SELECT *, contains(lower(body), 'economy') AS area FROM changes) WHERE area
  AND (section = 'upcoming' OR (section IN ('api_changes', 'sandbox') AND date >= DATE '2024-01-16'))
GROUP BY ALL
""")
def release_digest(spark, sf):
    marked = changes(spark, sf).withColumn("title", F.expr("replace(title, 'old', 'sunset')"))
    return releases.release_digest(marked, datetime.date(2024, 2, 15), area="Economy")
