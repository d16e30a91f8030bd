"""Bodies rendered from orders, checked against a small documented index."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave import schemas as layouts
from docweave.operators import conformance
from docweave.sources import readers
from workload.base import register, scratch, table


def _rows(spark, sql, layout):
    """A small literal table; its size is known to the optimizer."""
    names = [part.strip().split(" ")[0].strip("`") for part in _split_layout(layout)]
    types = [part.strip().split(" ", 1)[1] for part in _split_layout(layout)]
    raw = spark.sql(sql)
    return raw.select(*[F.col(n).cast(t).alias(n) for n, t in zip(names, types)])


def _split_layout(layout):
    parts, depth, current = [], 0, ""
    for ch in layout:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [*parts, current]


def endpoints(spark):
    return _rows(spark, """
        SELECT 1 AS page_ord, 0 AS tbl_ord, 1 AS row_ord, 'POST' AS method, '/v3/orders' AS path, '/docs/orders' AS docs_path,
               'Create order' AS title, false AS deprecated, CAST(NULL AS STRING) AS deprecation_note
        UNION ALL SELECT 2, 0, 1, 'POST', '/v3/old-orders', '/docs/old', 'Old', true, 'gone'
        UNION ALL SELECT 3, 0, 1, 'GET', '/v3/orders', '/docs/list', 'List', false, NULL""", layouts.ENDPOINTS)


def schemas(spark):
    return _rows(spark, """
        SELECT 1 AS page_ord, 5 AS tbl_ord, 'Order response' AS name, 2 AS level, array(
            named_struct('name', 'other', 'type', 'String', 'required', true, 'description', '', 'constraints', '', 'deprecated', false)) AS fields, '/docs/orders' AS docs_path
        UNION ALL SELECT 1, 9, 'Order', 2, array(
            named_struct('name', 'key', 'type', 'Integer', 'required', true, 'description', 'id', 'constraints', 'Max: 9000', 'deprecated', false),
            named_struct('name', 'status', 'type', 'String (Enum)', 'required', true, 'description', 's', 'constraints', 'Max: 1 characters', 'deprecated', false),
            named_struct('name', 'total', 'type', 'Number (decimal)', 'required', false, 'description', 't', 'constraints', 'min 100000', 'deprecated', false),
            named_struct('name', 'priority', 'type', 'String', 'required', CAST(NULL AS BOOLEAN), 'description', 'p', 'constraints', 'Min: 6 characters, max: 10 characters', 'deprecated', false),
            named_struct('name', 'comment', 'type', 'String', 'required', CAST(NULL AS BOOLEAN), 'description', 'Deprecated: use note', 'constraints', '', 'deprecated', true),
            named_struct('name', 'customer', 'type', 'Customer resource', 'required', false, 'description', '', 'constraints', '', 'deprecated', false),
            named_struct('name', 'lines', 'type', 'Array of lines', 'required', false, 'description', '', 'constraints', '', 'deprecated', false),
            named_struct('name', 'flag', 'type', 'Boolean', 'required', false, 'description', '', 'constraints', '', 'deprecated', false)), '/docs/orders'""",
                 layouts.SCHEMAS)


def rules(spark):
    return _rows(spark, r"""
        SELECT 7 AS page_ord, 1 AS tbl_ord, 1 AS row_ord, 'Priority' AS field_name, 'Order' AS resource, '^never$' AS pattern, '' AS notes
        UNION ALL SELECT 7, 1, 2, 'priority', 'Order', r'^[\\p{L}\\p{N} -]+$', 'letters'
        UNION ALL SELECT 7, 1, 3, 'status', 'Order', r'([', NULL
        UNION ALL SELECT 7, 1, 4, 'unknownField', 'Any', r'^[a-z]+$', NULL""", layouts.RULES)


BODY = r"""
CASE o_custkey % 8
  WHEN 5 THEN concat('{"key":', o_orderkey, ',"status":')
  WHEN 6 THEN concat('[', o_orderkey, ']')
  ELSE concat('{"key":', o_orderkey, if(o_custkey % 8 = 7, '', concat(',"status":"', o_orderstatus, '"')),
    ',"total":', CAST(o_totalprice AS DECIMAL(15,2)), ',"priority":"', o_orderpriority, '"',
    CASE o_custkey % 8 WHEN 1 THEN ',"flag":"yes"' WHEN 2 THEN ',"comment":"x","unknownField":"A1"'
      WHEN 3 THEN ',"customer":{"id":1},"lines":[{"a":1},{"b":2}]' WHEN 4 THEN ',"status":null' ELSE '' END, '}')
END
"""
ENDPOINT = "CASE o_orderstatus WHEN 'F' THEN 'POST /v3/orders' WHEN 'O' THEN ' post /v9/x/orders/ ' ELSE 'PATCH /v3/nothing' END"


def bodies(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS body_id", f"{ENDPOINT} AS endpoint", f"{BODY} AS body")


def issues(spark, sf):
    return conformance.validate(bodies(spark, sf), endpoints(spark), schemas(spark), rules(spark))


# What each order's body must yield, worked out from the order's own columns.
ISSUES_SQL = """
b AS (SELECT o_orderkey AS id, o_custkey % 8 AS k, o_orderstatus AS st, o_orderpriority AS pr, CAST(o_totalprice AS DECIMAL(15,2)) AS tot,
        CASE o_orderstatus WHEN 'F' THEN 'POST /v3/orders' WHEN 'O' THEN ' post /v9/x/orders/ ' ELSE 'PATCH /v3/nothing' END AS endpoint FROM orders),
good AS (SELECT * FROM b WHERE k NOT IN (5, 6) AND st <> 'P'),
issues AS (
  SELECT id AS body_id, endpoint, 'error' AS level, 'invalid_json' AS rule, CAST(NULL AS VARCHAR) AS field, 0 AS phase, 0 AS pos, 0 AS chk FROM b WHERE k = 5
  UNION ALL SELECT id, endpoint, 'error', 'not_object', NULL, 0, 0, 0 FROM b WHERE k = 6
  UNION ALL SELECT id, endpoint, 'error', 'unresolved_endpoint', NULL, 0, 0, 0 FROM b WHERE k NOT IN (5, 6) AND st = 'P'
  UNION ALL SELECT id, endpoint, 'warning', 'unknown_field', 'unknownField', 1, 5, 0 FROM good WHERE k = 2
  UNION ALL SELECT id, endpoint, 'error', 'missing_required', 'status', 2, 1, 0 FROM good WHERE k = 7
  UNION ALL SELECT id, endpoint, 'error', 'over_max', 'key', 3, 0, 5 FROM good WHERE id > 9000
  UNION ALL SELECT id, endpoint, 'error', 'null_required', 'status', 3, 1, 1 FROM good WHERE k = 4
  UNION ALL SELECT id, endpoint, 'error', 'under_min', 'total', 3, CASE WHEN k = 7 THEN 1 ELSE 2 END, 6 FROM good WHERE tot < 100000
  UNION ALL SELECT id, endpoint, 'error', 'too_long', 'priority', 3, CASE WHEN k = 7 THEN 2 ELSE 3 END, 3 FROM good WHERE length(pr) > 10
  UNION ALL SELECT id, endpoint, 'error', 'too_short', 'priority', 3, CASE WHEN k = 7 THEN 2 ELSE 3 END, 4 FROM good WHERE length(pr) < 6
  UNION ALL SELECT id, endpoint, 'error', 'type_mismatch', 'flag', 3, 4, 2 FROM good WHERE k = 1
  UNION ALL SELECT id, endpoint, 'warning', 'deprecated_field', 'comment', 3, 4, 0 FROM good WHERE k = 2
  UNION ALL SELECT id, endpoint, 'info', 'nested_object', 'customer', 3, 4, 7 FROM good WHERE k = 3
  UNION ALL SELECT id, endpoint, 'info', 'nested_array', 'lines', 3, 5, 8 FROM good WHERE k = 3
  UNION ALL SELECT id, endpoint, 'error', 'pattern_mismatch', 'unknownField', 4, 5, 0 FROM good WHERE k = 2
)
"""


@register("read_bodies", "SELECT event_id AS body_id, 'POST /' || event_type AS endpoint, props AS body FROM events")
def read_bodies(spark, sf):
    target = scratch(spark)
    table(spark, sf, "events").selectExpr("event_id AS body_id", "concat('POST /', event_type) AS endpoint", "props AS body").write.json(target)
    return readers.read_bodies(spark, target, "json")


@register("parse_bodies", "SELECT o_orderkey AS body_id, o_custkey % 8 <> 5 AS parsed, CASE WHEN o_custkey % 8 <> 5 THEN o_custkey % 8 <> 6 END AS is_object FROM orders")
def parse_bodies(spark, sf):
    return conformance.parse_bodies(bodies(spark, sf)).select("body_id", F.col("json").isNotNull().alias("parsed"), "is_object")


@register("explode_fields", """
SELECT event_id AS body_id, 0 AS pos, 'k' AS name, json_extract_string(props, '$.k') AS value, 'integer' AS kind FROM events
""")
def explode_fields(spark, sf):
    raw = table(spark, sf, "events").selectExpr("event_id AS body_id", "'' AS endpoint", "props AS body")
    return conformance.explode_fields(conformance.parse_bodies(raw))


@register("attach_schema", """
SELECT o_orderkey AS body_id, CASE WHEN o_orderstatus <> 'P' THEN 'Order' END AS schema_name, CASE WHEN o_orderstatus = 'P' THEN 'not_found' END AS failure,
       CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'loose' END AS match FROM orders
""")
def attach_schema(spark, sf):
    ready = conformance.attach_schema(conformance.parse_bodies(bodies(spark, sf)), endpoints(spark), schemas(spark))
    return ready.select("body_id", "schema_name", "failure", "match")


@register("validate", f"WITH {ISSUES_SQL} SELECT body_id, level, rule, field FROM issues")
def validate(spark, sf):
    return issues(spark, sf).select("body_id", "level", "rule", "field")


def _one_rule(name, rule):
    sql = f"WITH {ISSUES_SQL} SELECT body_id, field FROM issues WHERE rule = '{rule}'"

    @register(name, sql)
    def run(spark, sf):
        return issues(spark, sf).where(F.col("rule") == rule).select("body_id", "field")


_one_rule("require_object", "not_object")
_one_rule("unknown_fields", "unknown_field")
_one_rule("missing_required", "missing_required")
_one_rule("deprecated_fields", "deprecated_field")
_one_rule("null_required", "null_required")
_one_rule("type_mismatch", "type_mismatch")
_one_rule("nested_notes", "nested_array")
_one_rule("regex_rules", "pattern_mismatch")


PROSE = """CASE o_custkey % 9 WHEN 0 THEN concat('Max: ', o_custkey, ' characters') WHEN 1 THEN concat('MIN ', o_custkey, ' chars')
  WHEN 2 THEN concat('max: ', o_custkey) WHEN 3 THEN concat('Min: ', o_custkey, ' items') WHEN 4 THEN concat('limit ', o_custkey)
  WHEN 5 THEN concat('min: 3 characters, max: ', o_custkey, ' characters') ELSE NULL END"""


@register("limit_checks", """
SELECT o_orderkey,
  CAST(CASE o_custkey % 9 WHEN 0 THEN o_custkey WHEN 5 THEN o_custkey END AS BIGINT) AS max_chars,
  CAST(CASE o_custkey % 9 WHEN 1 THEN o_custkey WHEN 5 THEN 3 END AS BIGINT) AS min_chars,
  CAST(CASE WHEN o_custkey % 9 = 2 THEN o_custkey WHEN o_custkey % 9 IN (0, 5) AND o_custkey > 9 THEN o_custkey // 10 END AS BIGINT) AS max_value,
  CAST(CASE WHEN o_custkey % 9 = 3 THEN o_custkey WHEN o_custkey % 9 = 1 AND o_custkey > 9 THEN o_custkey // 10 END AS BIGINT) AS min_value
FROM orders
""")
def limit_checks(spark, sf):
    prose = F.expr(PROSE)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        *[conformance.limit_of(prose, which).cast("bigint").alias(which) for which in conformance.LIMITS],
    )


@register("type_categories", """
SELECT o_orderkey, CASE o_custkey % 9 WHEN 0 THEN 'string' WHEN 1 THEN 'array' WHEN 2 THEN 'object' WHEN 3 THEN 'object' WHEN 4 THEN 'integer'
  WHEN 5 THEN 'number' WHEN 6 THEN 'boolean' WHEN 7 THEN 'string' ELSE 'unknown' END AS category FROM orders
""")
def type_categories(spark, sf):
    prose = F.expr("""CASE o_custkey % 9 WHEN 0 THEN concat('String (', o_orderpriority, ')') WHEN 1 THEN concat('Array of ', o_orderpriority)
      WHEN 2 THEN concat(o_orderpriority, ' Resource (nested)') WHEN 3 THEN concat(o_orderpriority, ' object') WHEN 4 THEN ' LONG ' WHEN 5 THEN 'Decimal'
      WHEN 6 THEN 'bool' WHEN 7 THEN '(x) DateTime (ISO)' ELSE o_orderpriority END""")
    return table(spark, sf, "orders").select("o_orderkey", conformance.expected_type(prose).alias("category"))


@register("prepare_rules", """
SELECT lower(c_name) AS rule_key, '^\\p{L}' || c_nationkey || '$' AS pattern FROM customer WHERE c_nationkey <> 4
""")
def prepare_rules(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey AS page_ord", "0 AS tbl_ord", "explode(array(0, 1)) AS row_ord", "c_name", "c_nationkey")
    made = rows.selectExpr(
        "page_ord", "tbl_ord", "row_ord", "if(row_ord = 0, upper(c_name), c_name) AS field_name", "'r' AS resource",
        r"CASE WHEN row_ord = 0 THEN 'first' WHEN c_nationkey = 4 THEN '([' ELSE concat(r'^\\p{L}', c_nationkey, '$') END AS pattern", "'' AS notes")
    return conformance.prepare_rules(made).select("rule_key", "pattern")


@register("verdicts", f"""
WITH {ISSUES_SQL}
SELECT b.id AS body_id, count(*) FILTER (WHERE level = 'error') = 0 AS ok, CAST(count(*) FILTER (WHERE level = 'error') AS BIGINT) AS errors,
       CAST(count(*) FILTER (WHERE level = 'warning') AS BIGINT) AS warnings
FROM b LEFT JOIN issues ON body_id = b.id GROUP BY b.id
""")
def verdicts(spark, sf):
    judged = conformance.judge(bodies(spark, sf), endpoints(spark), schemas(spark), rules(spark))
    return conformance.verdicts(judged).select("body_id", "ok", "errors", "warnings")


@register("issue_report", f"""
WITH {ISSUES_SQL}
SELECT body_id, rule, CAST(row_number() OVER (PARTITION BY body_id ORDER BY CASE level WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, phase, pos, chk) AS INTEGER) AS issue_ord
FROM issues
""")
def issue_report(spark, sf):
    return conformance.issue_report(issues(spark, sf)).select("body_id", "rule", "issue_ord")


@register("conformance_stats", f"""
WITH {ISSUES_SQL}
SELECT endpoint, field, CAST(grouping_id(endpoint, field) AS BIGINT) AS grain, CAST(count(*) AS BIGINT) AS issues,
       CAST(count(*) FILTER (WHERE level = 'error') AS BIGINT) AS errors
FROM issues GROUP BY ROLLUP (endpoint, field)
""")
def conformance_stats(spark, sf):
    return conformance.conformance_stats(issues(spark, sf))


@register("top_fields", f"""
WITH {ISSUES_SQL}
SELECT field, CAST(count(*) AS BIGINT) AS errors FROM issues WHERE level = 'error' AND field IS NOT NULL GROUP BY field ORDER BY errors DESC, field LIMIT 10
""")
def top_fields(spark, sf):
    return conformance.top_fields(issues(spark, sf))


@register("synthesise_bodies", """
SELECT CASE p_size % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'GET' ELSE 'PUT' END || ' /v3/p' || p_partkey AS endpoint,
  CASE WHEN p_size % 3 = 1 THEN NULL WHEN p_size > 40 THEN '{}'
       WHEN p_size > 20 THEN '{"' || p_brand || '":"<' || p_brand || '>","n":0}'
       ELSE '{"' || p_brand || '":"<' || p_brand || '>","n":0,"opt":0.0,"list":[],"o":{},"b":false,"?":"<?>"}' END AS body
FROM part
""")
def synthesise_bodies(spark, sf):
    part = table(spark, sf, "part")
    documented = part.selectExpr(
        "p_partkey AS page_ord", "0 AS tbl_ord", "0 AS row_ord", "CASE p_size % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'GET' ELSE 'PUT' END AS method",
        "concat('/v3/p', p_partkey) AS path", "concat('/d/', p_partkey) AS docs_path")
    field = "named_struct('name', {0}, 'type', {1}, 'required', {2}, 'description', '', 'constraints', '', 'deprecated', false)"
    listed = ", ".join([
        field.format("p_brand", "'String'", "p_size > 20"), field.format("'n'", "'Integer'", "p_size > 20"),
        field.format("'opt'", "'Number'", "false"), field.format("'id'", "'String (Read Only)'", "true"),
        field.format("'list'", "'Array'", "CAST(NULL AS BOOLEAN)"), field.format("'o'", "'X object'", "false"),
        field.format("'b'", "'Boolean'", "false"), field.format("'?'", "'Thing'", "false"),
    ])
    described = part.where("p_size <= 40").selectExpr(
        "p_partkey AS page_ord", "0 AS tbl_ord", "p_name AS name", "2 AS level", f"array({listed}) AS fields", "concat('/d/', p_partkey) AS docs_path")
    return conformance.synthesise_bodies(documented, described).select("endpoint", "body")
