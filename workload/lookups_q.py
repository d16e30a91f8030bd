"""Listings and joins over entity tables made from the rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import lookups, resolve
from workload.base import register, table
from workload.releases_q import CHANGES_SQL, changes

CODES_SQL = """codes AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS code, p_name AS reason,
  CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'POST /V3/' || upper(p_type) || '/' || p_size ELSE 'see /v3/' || p_brand || '/x' END AS endpoint FROM part)"""


def codes(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS page_ord", "0 AS tbl_ord", "0 AS row_ord", "CAST(p_partkey AS STRING) AS code", "p_name AS reason",
        "CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('POST /V3/', upper(p_type), '/', p_size) ELSE concat('see /v3/', p_brand, '/x') END AS endpoint",
        "CAST(NULL AS STRING) AS response", "concat('/d/', p_type) AS docs_path",
    )


@register("list_error_codes", f"WITH {CODES_SQL} SELECT code, reason, endpoint FROM codes WHERE contains(code, '17') OR contains(lower(reason), '17') OR contains(lower(endpoint), '17')")
def list_error_codes(spark, sf):
    return lookups.list_error_codes(codes(spark, sf), "17").select("code", "reason", "endpoint")


@register("list_status_codes", """
SELECT CAST(p_size AS VARCHAR) AS code, p_name AS description, p_brand AS applicable_resources FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')
""")
def list_status_codes(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey AS page_ord", "0 AS tbl_ord", "0 AS row_ord", "CAST(p_size AS STRING) AS code", "p_name AS description",
        "p_brand AS applicable_resources", "'/d' AS docs_path")
    return lookups.list_status_codes(rows, "RING").select("code", "description", "applicable_resources")


@register("list_schemas", """
SELECT p_partkey AS page_ord, 'a' AS field, CASE WHEN p_size > 25 THEN 'yes' ELSE 'optional' END AS required FROM part WHERE contains(lower(p_brand), 'brand#1')
UNION ALL SELECT p_partkey, 'b', 'unspecified' FROM part WHERE contains(lower(p_brand), 'brand#1')
""")
def list_schemas(spark, sf):
    item = "named_struct('name', '{0}', 'type', p_type, 'required', {1}, 'description', p_name, 'constraints', '', 'deprecated', false)"
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey AS page_ord", "0 AS tbl_ord", "p_brand AS name", "2 AS level",
        f"array({item.format('a', 'p_size > 25')}, {item.format('b', 'CAST(NULL AS BOOLEAN)')}) AS fields", "'/d' AS docs_path")
    return lookups.list_schemas(rows, "BRAND#1").select("page_ord", "field", "required")


@register("list_endpoints", """
SELECT p_partkey AS page_ord, CASE p_size % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN 'x' || p_partkey ELSE 'misc' END AS area FROM part
""")
def list_endpoints(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey AS page_ord", "0 AS tbl_ord", "0 AS row_ord", "'GET' AS method",
        "CASE p_size % 3 WHEN 0 THEN concat('/v3//', lower(p_type), '/', p_partkey) WHEN 1 THEN concat('x', p_partkey, '/') ELSE '/' END AS path")
    return lookups.list_endpoints(rows).select("page_ord", "area")


DOCUMENTED_SQL = """eps AS (SELECT c_custkey AS k, CASE WHEN c_nationkey < 12 THEN 'POST' ELSE 'GET' END AS method,
  '/v3/' || lower(c_mktsegment) || '/' || c_custkey || CASE WHEN c_nationkey % 2 = 0 THEN '/' ELSE '' END AS path, '/d/' || c_custkey AS docs_path FROM customer)"""


def documented(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS page_ord", "0 AS tbl_ord", "0 AS row_ord", "if(c_nationkey < 12, 'POST', 'GET') AS method",
        "concat('/v3/', lower(c_mktsegment), '/', c_custkey, if(c_nationkey % 2 = 0, '/', '')) AS path", "concat('/d/', c_custkey) AS docs_path")


@register("resolve_schema", f"""
WITH {DOCUMENTED_SQL}, asked AS (
  SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'POST' WHEN 'O' THEN 'GET' END AS method,
         CASE WHEN o_orderpriority = '5-LOW' THEN '/v3/none/q' WHEN o_orderpriority = '1-URGENT' THEN '/v9/' || o_custkey || '//'
              ELSE '/v3/' || lower(c_mktsegment) || '/' || o_custkey END AS path,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'q' ELSE CAST(o_custkey AS VARCHAR) END AS seg
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
), segs AS (SELECT DISTINCT method, seg FROM asked WHERE method IS NOT NULL),
loose AS (SELECT s.method, s.seg, arg_min(docs_path, k) AS docs_path FROM segs s JOIN eps e ON e.method = s.method AND ends_with(rtrim(e.path, '/'), s.seg) GROUP BY ALL),
found AS (
  SELECT a.o_orderkey, a.method, x.docs_path AS exact, l.docs_path AS loose FROM asked a
  LEFT JOIN eps x ON x.method = a.method AND x.path = a.path LEFT JOIN loose l ON l.method = a.method AND l.seg = a.seg
), named AS (SELECT *, coalesce(exact, loose) AS docs_path FROM found)
SELECT o_orderkey, docs_path, CASE WHEN c_nationkey < 20 THEN c_name END AS schema_name,
  CASE WHEN method IS NULL THEN 'unparseable' WHEN docs_path IS NULL THEN 'not_found' WHEN c_nationkey >= 20 THEN 'no_schema' END AS failure,
  CASE WHEN exact IS NOT NULL THEN 'exact' WHEN loose IS NOT NULL THEN 'loose' END AS match
FROM named LEFT JOIN customer ON docs_path = '/d/' || c_custkey
""")
def resolve_schema(spark, sf):
    line = """concat(CASE o_orderstatus WHEN 'F' THEN ' post ' WHEN 'O' THEN 'GET  ' ELSE 'FETCH ' END,
        CASE WHEN o_orderpriority = '5-LOW' THEN '/v3/none/q' WHEN o_orderpriority = '1-URGENT' THEN concat('/v9/', o_custkey, '//')
             ELSE concat('/v3/', lower(c_mktsegment), '/', o_custkey) END)"""
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("c_custkey = o_custkey"), "left")
    requests = joined.selectExpr("o_orderkey", f"{line} AS endpoint")
    described = table(spark, sf, "customer").where("c_nationkey < 20").selectExpr(
        "c_custkey AS page_ord", "explode(array(0, 1)) AS tbl_ord", "c_name", "concat('/d/', c_custkey) AS docs_path").selectExpr(
        "page_ord", "tbl_ord", "if(tbl_ord = 0, concat(c_name, ' Response'), c_name) AS name", "array(named_struct('name', c_name)) AS fields", "docs_path")
    found = resolve.resolve_schema(requests, documented(spark, sf), described, F.col("o_orderkey"))
    return found.select("o_orderkey", "docs_path", "schema_name", "failure", "match")


ASKED_SQL = """eps AS (SELECT s_suppkey AS k, 'POST' AS method,
  '/v3/' || CASE WHEN s_nationkey = 0 THEN 'all/' WHEN s_nationkey < 8 THEN 'economy/' || s_nationkey WHEN s_nationkey < 16 THEN 'Brand#' || s_nationkey ELSE 'q/' || s_nationkey END AS path,
  CASE WHEN s_nationkey = 3 THEN '' WHEN s_nationkey < 12 THEN 'Economy OF Brand#' || s_nationkey ELSE s_name END AS title FROM supplier)"""


def asked(spark, sf):
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS page_ord", "0 AS tbl_ord", "0 AS row_ord", "'POST' AS method",
        """concat('/v3/', CASE WHEN s_nationkey = 0 THEN 'all/' WHEN s_nationkey < 8 THEN concat('economy/', s_nationkey)
           WHEN s_nationkey < 16 THEN concat('Brand#', s_nationkey) ELSE concat('q/', s_nationkey) END) AS path""",
        "CASE WHEN s_nationkey = 3 THEN '' WHEN s_nationkey < 12 THEN concat('Economy OF Brand#', s_nationkey) ELSE s_name END AS title",
        "concat('/d/', s_suppkey) AS docs_path", "s_nationkey > 20 AS deprecated", "CAST(NULL AS STRING) AS deprecation_note",
    )


ERRORS_SQL = f"""{CODES_SQL}, {ASKED_SQL}, exact AS (
  SELECT e.k AS ek, c.* FROM eps e JOIN codes c ON lower(c.endpoint) = lower(e.method || ' ' || e.path)
), loose AS (
  SELECT e.k AS ek, c.* FROM eps e JOIN codes c ON contains(c.endpoint, split_part(e.path, '/', -1)) WHERE e.k NOT IN (SELECT ek FROM exact)
), errs AS (
  SELECT *, row_number() OVER (PARTITION BY ek ORDER BY k) AS rank, count(*) OVER (PARTITION BY ek) AS found
  FROM (SELECT *, 'exact' AS match FROM exact UNION ALL SELECT *, 'segment' FROM loose)
)"""


@register("errors_for_endpoint", f"""
WITH {ERRORS_SQL}
SELECT ek AS page_ord, match, code, CAST(rank AS INTEGER) AS rank, CAST(found AS BIGINT) AS found FROM errs WHERE rank <= 20
""")
def errors_for_endpoint(spark, sf):
    return lookups.errors_for_endpoint(asked(spark, sf), codes(spark, sf)).select("page_ord", "match", "code", "rank", "found")


MENTIONS_SQL = f"""{CHANGES_SQL}, {ASKED_SQL}, ment AS (
  SELECT e.k AS ek, c.k, c.title, row_number() OVER (PARTITION BY e.k ORDER BY c.k) AS rank, count(*) OVER (PARTITION BY e.k) AS found
  FROM eps e JOIN changes c ON contains(lower(c.title || ' ' || c.body), lower(e.path)) OR contains(lower(c.title || ' ' || c.body), lower(e.title))
)"""


@register("release_mentions", f"""
WITH {MENTIONS_SQL} SELECT ek AS page_ord, title, CAST(rank AS INTEGER) AS rank, CAST(found AS BIGINT) AS found FROM ment WHERE rank <= 5
""")
def release_mentions(spark, sf):
    return lookups.release_mentions(asked(spark, sf), changes(spark, sf)).select("page_ord", "title", "rank", "found")


@register("describe_endpoints", f"""
WITH {ERRORS_SQL}, {MENTIONS_SQL.replace(ASKED_SQL + ', ', '')}, first AS (
  SELECT * FROM eps QUALIFY row_number() OVER (PARTITION BY method, path ORDER BY k) = 1
)
SELECT method, path, title, CASE WHEN k % 2 = 0 THEN 'S' || k END AS schema_name,
  coalesce((SELECT CAST(max(found) AS BIGINT) FROM errs WHERE ek = first.k), 0) AS n_errors,
  (SELECT string_agg(code, ',' ORDER BY rank) FROM errs WHERE ek = first.k AND rank <= 20) AS codes,
  coalesce((SELECT CAST(max(found) AS BIGINT) FROM ment WHERE ek = first.k), 0) AS n_mentions
FROM first
""")
def describe_endpoints(spark, sf):
    described = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").selectExpr(
        "s_suppkey AS page_ord", "0 AS tbl_ord", "concat('S', s_suppkey) AS name", "array(named_struct('name', s_name)) AS fields", "concat('/d/', s_suppkey) AS docs_path")
    full = lookups.describe_endpoints(asked(spark, sf), described, codes(spark, sf), changes(spark, sf))
    listed = F.array_join(F.transform("errors", lambda e: e["code"]), ",")
    return full.select("method", "path", "title", "schema_name", "n_errors", listed.alias("codes"), "n_mentions")


@register("suggest_endpoints", f"""
WITH {DOCUMENTED_SQL}, asked AS (
  SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'POST' WHEN 'O' THEN 'GET' ELSE 'PUT' END AS method, '/v3/' || lower(c_mktsegment) || '/' || o_custkey AS path
  FROM orders JOIN customer ON o_custkey = c_custkey
), missing AS (SELECT * FROM asked ANTI JOIN eps USING (method, path)),
offers AS (SELECT method, path AS suggestion, row_number() OVER (PARTITION BY method ORDER BY k) AS rank FROM eps)
SELECT method, path, suggestion, CAST(rank AS INTEGER) AS rank FROM missing JOIN offers USING (method) WHERE rank <= 5
""")
def suggest_endpoints(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("c_custkey = o_custkey"))
    requests = joined.selectExpr(
        "CASE o_orderstatus WHEN 'F' THEN ' post' WHEN 'O' THEN 'Get ' ELSE 'PUT' END AS method",
        "concat(' /v3/', lower(c_mktsegment), '/', o_custkey) AS path")
    return lookups.suggest_endpoints(requests, documented(spark, sf)).select("method", "path", "suggestion", "rank")


@register("examples_for_page", """
WITH ex AS (SELECT '/d/' || p_brand AS docs_path, CASE WHEN p_size > 25 THEN 'json' END AS language, p_partkey AS ord FROM part),
req AS (SELECT DISTINCT '/d/Brand#' || c_nationkey AS docs_path, CASE WHEN c_nationkey < 10 THEN 'json' WHEN c_nationkey < 15 THEN 'bash' END AS wanted FROM customer)
SELECT docs_path, ord, language FROM ex JOIN req USING (docs_path) WHERE wanted IS NULL OR coalesce(language, '') = wanted
""")
def examples_for_page(spark, sf):
    examples = table(spark, sf, "part").selectExpr(
        "concat('/d/', p_brand) AS docs_path", "if(p_size > 25, 'json', NULL) AS language", "p_partkey AS ord")
    requests = table(spark, sf, "customer").selectExpr(
        "concat('/d/Brand#', c_nationkey) AS docs_path", "CASE WHEN c_nationkey < 10 THEN 'JSON' WHEN c_nationkey < 15 THEN 'bash' END AS language")
    return lookups.examples_for_page(examples, requests).select("docs_path", "ord", "language")


@register("explain_error_occurrences", """
WITH occ AS (SELECT CAST(p_size AS VARCHAR) AS code, 'POST /' || p_brand AS endpoint, p_name AS reason FROM part),
ask AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS code, CASE WHEN s_suppkey % 3 > 0 THEN 'post /brand#' || (s_suppkey % 25) END AS asked_endpoint FROM supplier),
j AS (SELECT a.*, o.endpoint, o.reason, coalesce(lower(o.endpoint) = lower(a.asked_endpoint), FALSE) AS on_endpoint FROM ask a JOIN occ o USING (code)),
r AS (SELECT *, max(on_endpoint::INT) OVER (PARTITION BY code, asked_endpoint) AS any_own FROM j)
SELECT code, asked_endpoint, endpoint, reason, on_endpoint FROM r WHERE any_own = on_endpoint::INT
""")
def explain_error_occurrences(spark, sf):
    occurrences = table(spark, sf, "part").selectExpr(
        "CAST(p_size AS STRING) AS code", "concat('POST /', p_brand) AS endpoint", "p_name AS reason", "'/d' AS docs_path")
    wanted = table(spark, sf, "supplier").selectExpr(
        "CAST(s_nationkey AS STRING) AS code", "if(s_suppkey % 3 > 0, concat('post /brand#', s_suppkey % 25), NULL) AS endpoint")
    return lookups.explain_error_occurrences(wanted, occurrences).select("code", "asked_endpoint", "endpoint", "reason", "on_endpoint")
