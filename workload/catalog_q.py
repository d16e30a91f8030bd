"""Catalog jobs over page URLs and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions.text import canonical_path, url_path
from docweave.operators import catalog, html
from docweave.sources import readers
from workload.base import register, scratch, table, unescaped

PATH_SQL = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '')"
CANON_SQL = """CASE WHEN length(s) > 1 THEN rtrim(s, '/') ELSE s END"""
PATHS_SQL = f"""paths AS (
  SELECT page_id, url, html, {CANON_SQL} AS path FROM (
    SELECT page_id, url, html, CASE WHEN p = '' THEN '/' WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS s
    FROM (SELECT page_id, url, html, {PATH_SQL} AS p FROM pages))
)"""
TITLE_SQL = unescaped("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")
TAGS_SQL = """array_to_string(list_sort(list_distinct(list_concat(
  flatten(list_transform(segs, lambda s: list_filter(string_split_regex(s, '[-_]'), lambda w: length(w) >= 3))),
  list_transform(segs, lambda s: replace(replace(s, '-', ' '), '_', ' ')),
  list_filter(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'),
    lambda w: length(w) >= 3 AND w NOT IN ('the','a','an','and','or','of','to','for','in','on','with','by'))))), '|')"""
TAGGED_SQL = f"""{PATHS_SQL}, titled AS (SELECT page_id, path, {TITLE_SQL} AS title FROM paths),
tagged AS (
  SELECT page_id, path, title, {TAGS_SQL} AS tags
  FROM (SELECT page_id, path, title, list_filter(string_split(lower(path), '/'), lambda s: s NOT IN ('', 'docs')) AS segs FROM titled)
)"""


def pages(spark, sf):
    return table(spark, sf, "pages").withColumn("url", url_path(F.col("url")))


@register("read_pages", "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n FROM pages")
def read_pages(spark, sf):
    return readers.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("n"))


@register("split_failed", "SELECT '/p/' || p_partkey AS path, CASE WHEN p_size > 40 THEN 'no content' END AS error, p_size > 40 AS failed FROM part")
def split_failed(spark, sf):
    rendered = table(spark, sf, "part").selectExpr(
        "p_partkey AS page_id", "concat('/p/', p_partkey) AS url", "if(p_size > 40, NULL, concat('<p>', p_name)) AS html")
    good, bad = readers.split_failed(rendered)
    good = good.select(F.col("url").alias("path"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("failed"))
    return good.unionByName(bad.withColumn("failed", F.lit(True)))


@register("read_sitemap_xml", """
SELECT '/docs/' || lower(c_mktsegment) || '/' || c_custkey AS path FROM customer WHERE c_nationkey > 5
""")
def read_sitemap_xml(spark, sf):
    loc = "concat('https://site.example', if(c_nationkey > 5, '/docs/', '/blog/'), lower(c_mktsegment), '/', c_custkey)"
    target = scratch(spark)
    entries = table(spark, sf, "customer").selectExpr(f"{loc} AS loc", "'2024-01-01' AS lastmod")
    entries.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(target)
    return readers.read_sitemap_xml(spark, target, "/docs/", "https://site.example")


@register("canonical_paths", f"WITH {PATHS_SQL} SELECT DISTINCT path FROM paths ORDER BY path")
def canonical_paths(spark, sf):
    return catalog.canonical_paths(pages(spark, sf), "url")


@register("catalog_floor", f"WITH {PATHS_SQL} SELECT CAST(count(DISTINCT path) AS BIGINT) AS found, 20 AS least FROM paths")
def catalog_floor(spark, sf):
    return catalog.catalog_floor(catalog.canonical_paths(pages(spark, sf), "url"), 20)


@register("resolve_titles", f"SELECT page_id, {TITLE_SQL} AS title FROM pages")
def resolve_titles(spark, sf):
    return catalog.resolve_titles(html.shred_html(pages(spark, sf))).select("page_id", "title")


@register("resolve_titles_fallback", """
SELECT p_partkey AS page_id, CASE p_size % 3 WHEN 0 THEN p_name || p_brand WHEN 1 THEN p_name || ' - ' || p_type ELSE '/p/' || p_partkey END AS title
FROM part
""")
def resolve_titles_fallback(spark, sf):
    page = """concat('<html><head>', if(p_size % 3 = 1, concat('<title> ', p_name, ' - ', p_type, ' | Vendor Developer | more</title>'), '<title> </title>'),
        '</head><body><nav><h1>', if(p_size % 3 = 0, concat(' ', p_name, ' <b> ', p_brand, '</b>'), ' '), '</h1></nav><h1>second</h1></body>')"""
    rendered = table(spark, sf, "part").selectExpr("p_partkey AS page_id", "concat('/p/', p_partkey) AS url", f"{page} AS html")
    return catalog.resolve_titles(html.shred_html(rendered), "Vendor").select("page_id", "title")


@register("derive_tags", f"WITH {TAGGED_SQL} SELECT page_id, tags FROM tagged")
def derive_tags(spark, sf):
    titled = catalog.resolve_titles(html.shred_html(pages(spark, sf)))
    entries = titled.select("page_id", canonical_path(F.col("url")).alias("path"), "title")
    return catalog.derive_tags(entries).select("page_id", F.array_join("tags", "|").alias("tags"))


@register("merge_curated_tags", """
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_orderstatus || '|' || o_orderpriority ELSE
  array_to_string(list_sort(list_distinct([o_orderstatus, o_orderpriority, c_mktsegment, 'F', c_name])), '|') END AS tags, c_custkey IS NOT NULL AS curated_hit
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey > 3) ON o_custkey = c_custkey
""")
def merge_curated_tags(spark, sf):
    entries = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat('/a/K', o_custkey, '/') AS path", "array(o_orderstatus, o_orderpriority) AS tags")
    curated = table(spark, sf, "customer").where("c_nationkey > 3").selectExpr(
        "concat('k', c_custkey) AS last_segment", "array(c_mktsegment, 'F', c_name) AS tags")
    merged = catalog.merge_curated_tags(entries, curated)
    return merged.select("o_orderkey", F.array_join("tags", "|").alias("tags"), "curated_hit")


@register("build_catalog", f"""
WITH {TAGGED_SQL} SELECT page_id AS page_ord, path, title, tags FROM tagged
QUALIFY row_number() OVER (PARTITION BY path ORDER BY page_id) = 1
""")
def build_catalog(spark, sf):
    built = catalog.build_catalog(html.shred_html(pages(spark, sf)))
    return built.select("page_ord", "path", "title", F.array_join("tags", "|").alias("tags"))


@register("list_catalog", """
SELECT path, p_name AS title, CASE WHEN p_size > 10 THEN
    array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE 'Root' END AS area
FROM (SELECT *, CASE WHEN p_size > 10 THEN '/docs/' || replace(p_name, ' ', '-') || '/' || p_partkey ELSE '/p' || p_partkey END AS path FROM part)
ORDER BY path
""")
def list_catalog(spark, sf):
    entries = table(spark, sf, "part").selectExpr(
        "if(p_size > 10, concat('/docs/', replace(p_name, ' ', '-'), '/', p_partkey), concat('/p', p_partkey)) AS path", "p_name AS title")
    return catalog.list_catalog(entries)


LOOKUP_ROWS = "concat('c/', o_custkey, '/') AS path"


@register("lookup_page", """
SELECT 'c/' || o_custkey || '/' AS path, '/c/' || o_custkey AS canonical, coalesce(c_name, '/c/' || o_custkey) AS title, c_custkey IS NOT NULL AS known
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 7) ON o_custkey = c_custkey
""")
def lookup_page(spark, sf):
    known = table(spark, sf, "customer").where("c_nationkey <> 7").selectExpr(
        "c_custkey AS page_ord", "concat('/c/', c_custkey) AS path", "c_name AS title")
    return catalog.lookup_page(table(spark, sf, "orders").selectExpr(LOOKUP_ROWS), known)


@register("unknown_pages", """
SELECT 'c/' || o_custkey || '/' AS path FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)
""")
def unknown_pages(spark, sf):
    known = table(spark, sf, "customer").where("c_nationkey <> 7").selectExpr("concat('/c/', c_custkey) AS path")
    return catalog.unknown_pages(table(spark, sf, "orders").selectExpr(LOOKUP_ROWS), known)
