"""Shredding, page text and the entity tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions.text import deprecation_note
from docweave.operators import entities, html
from workload.base import register, table, unescaped
from workload.fixtures import api_pages


def _sql(text: str) -> str:
    """Put the SQL of ``unescaped`` in place of UNESCAPED(...)."""
    for inner in ("regexp_replace(x, '<[^>]*>', '', 'g')", "x", "head"):
        text = text.replace(f"UNESCAPED({inner})", unescaped(inner))
    return text


def _trees(spark, sf, **options):
    return html.shred_html(table(spark, sf, "pages"), **options)


def _api(spark, sf):
    return html.shred_html(api_pages(spark, sf))


def _api_tables(spark, sf):
    return html.pseudo_tables(_api(spark, sf))


TAG_COUNT = """
SELECT page_id, tag, n FROM (
  SELECT page_id, 'h1' AS tag, CAST((length({h}) - length(replace({h}, '<h1>', ''))) / 4 AS BIGINT) AS n FROM pages
  UNION ALL SELECT page_id, 'p', CAST((length({h}) - length(replace({h}, '<p>', ''))) / 3 AS BIGINT) FROM pages
  UNION ALL SELECT page_id, 'b', CAST((length({h}) - length(replace({h}, '<b>', ''))) / 3 AS BIGINT) FROM pages
  UNION ALL SELECT page_id, 'br', CAST((length({h}) - length(replace({h}, '<br>', ''))) / 4 AS BIGINT) FROM pages
  UNION ALL SELECT page_id, 'li', CAST((length({h}) - length(replace({h}, '<li>', ''))) / 4 AS BIGINT) FROM pages
  UNION ALL SELECT page_id, 'a', CAST((length({h}) - length(replace({h}, '<a ', ''))) / 3 AS BIGINT) FROM pages
) WHERE n > 0
"""


def _tag_counts(nodes):
    return nodes.where(F.col("tag").isin("h1", "p", "b", "br", "li", "a")).groupBy("page_id", "tag").agg(
        F.count("*").alias("n")
    )


@register("shred_html", TAG_COUNT.format(h="html"))
def shred_html(spark, sf):
    return _tag_counts(html.node_table(_trees(spark, sf)))


@register("prune_chrome", TAG_COUNT.format(
    h="regexp_replace(regexp_replace(html, '<nav>.*?</nav>', '', 'gs'), '<footer>.*?</footer>', '', 'gs')"))
def prune_chrome(spark, sf):
    return _tag_counts(html.prune_chrome(html.node_table(_trees(spark, sf))))


SHAPED = r"""
concat('<html><body><nav><main>no</main></nav>',
  CASE p_size % 4 WHEN 0 THEN concat('<article><p>a</p></article><main class="m"><p>', p_name, '</p></main>')
                  WHEN 1 THEN concat('<div class="body"><p>d</p></div><article><p>', p_name, '</p></article>')
                  WHEN 2 THEN concat('<div class="x Content-wide"><p>', p_name, '</p></div>')
                  ELSE concat('<section><p>', p_name, '</p></section>') END, '</body></html>')
"""


def _shaped(spark, sf):
    return html.shred_html(table(spark, sf, "part").selectExpr(
        "p_partkey AS page_id", "concat('/p/', p_partkey) AS url", f"{SHAPED} AS html"))


@register("main_container", """
SELECT p_partkey AS page_id,
       CASE p_size % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'article' WHEN 2 THEN 'div' ELSE 'page' END AS container
FROM part
""")
def main_container(spark, sf):
    trees = _shaped(spark, sf)
    span = html.container_span(F.col("nodes"), html.mask(html.CHROME))
    return trees.select("page_id", "nodes", span.alias("span")).select(
        "page_id", F.coalesce(F.get("nodes", F.col("span.ord"))["tag"], F.lit("page")).alias("container")
    )


@register("subtree_text", """
SELECT p_partkey AS page_id, 'h1' AS tag, p_name AS text FROM part
UNION ALL SELECT p_partkey, 'h2', 'Request' FROM part
UNION ALL SELECT p_partkey, 'h2', p_brand || 'item' FROM part
""")
def subtree_text(spark, sf):
    return html.subtree_text(_api(spark, sf), ("h1", "h2"), "", html.CHROME).select("page_id", "tag", "text")


@register("clean_documents_nested", r"""
SELECT p_partkey AS page_id,
  '# ' || p_name || chr(10) || chr(10)
  || CASE WHEN p_size > 40 THEN 'Intro. The ' || p_type || ' call is deprecated since v2. Use another.' ELSE 'Intro only.' END
  || chr(10) || chr(10) || '## Request' || chr(10) || chr(10) || '```' || chr(10) || '{"id": ' || p_partkey || '}' || chr(10) || '```' || chr(10) || chr(10)
  || '{"id": ' || p_partkey || '}' || chr(10) || chr(10) || '## ' || p_brand || ' item' || chr(10) || chr(10) || '### Errors' || chr(10) || chr(10)
  || '### Status' || chr(10) || chr(10) || '```' || chr(10) || 'plain ' || p_partkey || chr(10) || '```' || chr(10) || chr(10) || 'plain ' || p_partkey AS content
FROM part
""")
def clean_documents_nested(spark, sf):
    return html.clean_documents(_api(spark, sf), "nested").select("page_id", "content")


@register("clean_documents", _sql(r"""
WITH body AS (
  SELECT page_id, regexp_extract(html, '<article><h1>(.*?)</h1>', 1, 's') AS head,
         regexp_replace(regexp_replace(html, '^.*?<article><h1>.*?</h1>', '', 's'), '</article>.*$', '', 's') AS rest
  FROM pages
), flat AS (
  SELECT page_id, head, string_split_regex(rest, '</?p>') AS parts FROM body
)
SELECT page_id,
  '# ' || UNESCAPED(head) || chr(10) || chr(10) || array_to_string(
    list_filter(list_transform(parts, lambda x: UNESCAPED(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: x <> ''),
    chr(10)) AS content
FROM flat
"""))
def clean_documents(spark, sf):
    return html.clean_documents(_trees(spark, sf)).select("page_id", "content")


CELLS_PAGE = r"""
concat('<div class="outer"><div class="big table"><div><div>Key</div><div>Segment</div><div>Balance</div></div>',
  '<div><div> ', c_custkey, ' </div><div>a&lt;br /&gt;  ', lower(c_mktsegment), '</div><div><b>x</b><br>y   z</div></div>',
  'loose text<div>no cells</div>',
  '<div><div>', c_name, '</div><div><p>n</p> <p>', c_nationkey, '</p></div></div></div></div>')
"""


@register("pseudo_tables", """
SELECT c_custkey AS page_id, 1 AS row_ord, 0 AS col_ord, 'key' AS header, CAST(c_custkey AS VARCHAR) AS text FROM customer
UNION ALL SELECT c_custkey, 1, 1, 'segment', 'a' || chr(10) || lower(c_mktsegment) FROM customer
UNION ALL SELECT c_custkey, 1, 2, 'balance', 'x' || chr(10) || 'y z' FROM customer
UNION ALL SELECT c_custkey, 3, 0, 'key', c_name FROM customer
UNION ALL SELECT c_custkey, 3, 1, 'segment', 'n ' || c_nationkey FROM customer
""")
def pseudo_tables(spark, sf):
    pages = table(spark, sf, "customer").selectExpr(
        "c_custkey AS page_id", "concat('/c/', c_custkey) AS url", f"{CELLS_PAGE} AS html")
    cells = html.table_cells(html.pseudo_tables(html.shred_html(pages)))
    return cells.select("page_id", "row_ord", "col_ord", "header", "text")


@register("normalise_cells", """
SELECT c_custkey AS page_id, c_name || chr(10) || c_mktsegment || chr(10) || 'end' AS text FROM customer
""")
def normalise_cells(spark, sf):
    page = """concat('<div class="table"><div><div>H</div></div><div><div>  ', replace(c_name, '#', '&#35;'),
        ' &lt;br&gt; ', c_mktsegment, '<br/>\n\n <i> end </i></div></div></div>')"""
    pages = table(spark, sf, "customer").selectExpr("c_custkey AS page_id", "'/c' AS url", f"{page} AS html")
    return html.table_cells(html.pseudo_tables(html.shred_html(pages))).select("page_id", "text")


@register("bind_columns", """
SELECT c_custkey AS page_id, c_name AS name, CASE WHEN c_nationkey > 12 THEN c_mktsegment END AS note FROM customer
""")
def bind_columns(spark, sf):
    page = """concat('<div class="table"><div><div>Any NAME here</div><div>Other</div><div>Notes, if any</div></div>',
        '<div><div>', c_name, '</div><div>x</div>', if(c_nationkey > 12, concat('<div>', c_mktsegment, '</div>'), ''), '</div>',
        '</div><div class="table"><div><div>Nothing</div></div><div><div>y</div></div></div>')"""
    pages = table(spark, sf, "customer").selectExpr("c_custkey AS page_id", "'/c' AS url", f"{page} AS html")
    headers = F.col("headers")
    rows = html.bind_columns(
        html.pseudo_tables(html.shred_html(pages)),
        {"name": html.column_of(headers, "name", exact=False), "note": html.column_of(headers, "note", exact=False)},
        required=("name",), width=("name",),
    )
    return rows.select("page_id", "name", "note")


@register("scan_deprecation", """
WITH t AS (
  SELECT doc_id, 'The ' || source || ' feed Will Be Removed in ' || lang || repeat(' soon', CASE WHEN lang = 'en' THEN 60 ELSE 1 END) AS s
  FROM documents)
SELECT doc_id, s AS note FROM t
""")
def scan_deprecation(spark, sf):
    text = F.expr("""concat(text, '. The ', source, ' feed Will Be Removed in ', lang,
        repeat(' soon', if(lang = 'en', 60, 1)), '. It was deprecated before. End')""")
    return table(spark, sf, "documents").select("doc_id", deprecation_note(text).alias("note"))


@register("page_deprecation", """
SELECT p_partkey AS page_id,
  CASE WHEN p_size > 40 THEN 'The ' || p_type || ' call is deprecated since v2' ELSE 'Intro only' END AS note, p_size > 40 AS noted
FROM part WHERE p_size > 40
""")
def page_deprecation(spark, sf):
    page = """concat('<nav>deprecated menu.</nav><h1>', p_name, '.</h1>',
        if(p_size > 40, concat('<p>Intro. The ', p_type, ' <b>call</b> is deprecated since v2. Bye.</p>'), '<p>Intro only.</p>'))"""
    pages = table(spark, sf, "part").selectExpr("p_partkey AS page_id", "'/p' AS url", f"{page} AS html")
    noted = html.page_deprecation(html.shred_html(pages)).where("deprecation_note IS NOT NULL")
    return noted.select("page_id", F.col("deprecation_note").alias("note"), F.lit(True).alias("noted"))


@register("code_blocks", """
SELECT p_partkey AS page_id, 'json' AS language, '{"id": ' || p_partkey || '}' AS code FROM part
UNION ALL SELECT p_partkey, NULL, 'plain ' || p_partkey FROM part
""")
def code_blocks(spark, sf):
    return html.code_blocks(_api(spark, sf)).select("page_id", "language", "code")


@register("nearest_heading", """
SELECT p_partkey AS page_id, 'Request' AS nearby_heading FROM part UNION ALL SELECT p_partkey, 'Status' FROM part
""")
def nearest_heading(spark, sf):
    trees = _api(spark, sf)
    return html.nearest_heading(trees).select("page_id", "nearby_heading")


@register("extract_endpoints", """
SELECT p_partkey AS page_ord, CASE WHEN p_size > 25 THEN 'POST' ELSE 'GET' END AS method,
       '/v3/' || lower(p_type) || '/' || p_partkey AS path, '/docs/' || lower(p_type) || '/' || p_partkey || '/' AS docs_path,
       p_name AS title, p_size > 30 AS deprecated,
       CASE WHEN p_size > 40 THEN 'The ' || p_type || ' call is deprecated since v2' END AS deprecation_note
FROM part
""")
def extract_endpoints(spark, sf):
    from docweave.operators.catalog import title_in_page

    rows = entities.extract_endpoints(html.pseudo_tables(_api(spark, sf), title_in_page()))
    # Pages with p_size 31 to 40 are flagged by a field description, whose sentence is long.
    note = F.when(F.startswith("deprecation_note", F.lit("The ")), F.col("deprecation_note"))
    return rows.select("page_ord", "method", "path", "docs_path", "title", "deprecated", note.alias("deprecation_note"))


@register("extract_error_codes", """
SELECT p_partkey AS page_ord, CAST(1000 + p_partkey AS VARCHAR) AS code, p_name || ' failed' AS reason,
       'POST /v3/' || lower(p_type) || '/' || p_partkey AS endpoint, 'bad' || chr(10) || p_brand AS response FROM part
""")
def extract_error_codes(spark, sf):
    return entities.extract_numeric_codes(_api_tables(spark, sf)).select("page_ord", "code", "reason", "endpoint", "response")


@register("extract_reason_codes", """
SELECT p_partkey AS page_ord, 'BAD_' || upper(p_type) AS code, p_brand AS reason FROM part
""")
def extract_reason_codes(spark, sf):
    return entities.extract_reason_codes(_api_tables(spark, sf)).select("page_ord", "code", "reason")


@register("error_codes_union", """
SELECT p_partkey AS page_ord, CAST(1000 + p_partkey AS VARCHAR) AS code FROM part
UNION ALL SELECT p_partkey, 'BAD_' || upper(p_type) FROM part
""")
def error_codes_union(spark, sf):
    return entities.extract_error_codes(_api_tables(spark, sf)).select("page_ord", "code")


@register("extract_status_codes", """
SELECT p_partkey AS page_ord, CAST(2000 + p_size AS VARCHAR) AS code, p_type AS description,
       'Order, Subscription, Transfer' AS applicable_resources FROM part
""")
def extract_status_codes(spark, sf):
    return entities.extract_status_codes(_api_tables(spark, sf)).select("page_ord", "code", "description", "applicable_resources")


@register("apply_corrections", """
SELECT doc_id, replace(replace(text, 'the', 'THE'), 'THE of', 'of THE') AS text FROM documents
""")
def apply_corrections(spark, sf):
    fixed = entities.apply_corrections(F.col("text"), (("the", "THE"), ("THE of", "of THE")))
    return table(spark, sf, "documents").select("doc_id", fixed.alias("text"))


@register("extract_schemas", """
SELECT p_partkey AS page_ord, p_brand || 'item' AS name, 2 AS level, 0 AS field_ord, 'id' || p_size AS field, 'String' AS type,
       TRUE AS required, 'Key of ' || p_name AS description, 'Max: ' || p_size || ' characters' AS constraints, FALSE AS deprecated FROM part
UNION ALL SELECT p_partkey, p_brand || 'item', 2, 1, 'price', 'Number', FALSE,
       CASE WHEN p_size > 30 THEN 'No longer supported.' ELSE 'Plain & simple' END, NULL, p_size > 30 FROM part
UNION ALL SELECT p_partkey, p_brand || 'item', 2, 2, 'tag', 'Array of tags', NULL, 'first' || chr(10) || 'second', NULL, FALSE FROM part
""")
def extract_schemas(spark, sf):
    fields = entities.schema_fields(entities.extract_schemas(html.heading_tables(_api(spark, sf))))
    return fields.select(
        "page_ord", F.col("schema_name").alias("name"), "level", "field_ord", F.col("name").alias("field"), "type", "required",
        "description", "constraints", "deprecated",
    )


@register("split_type_cell", """
SELECT o_orderkey, o_orderpriority AS type,
       CASE o_orderstatus WHEN 'F' THEN FALSE WHEN 'O' THEN TRUE END AS required FROM orders
""")
def split_type_cell(spark, sf):
    cell = F.expr("""concat(' ', o_orderpriority, ' \n(read only)\n', CASE o_orderstatus
        WHEN 'F' THEN 'Required here\nnow Optional' WHEN 'O' THEN 'optional\nREQUIRED' ELSE '' END)""")
    split = entities.split_type_cell(cell)
    return table(spark, sf, "orders").select("o_orderkey", split["type"].alias("type"), split["required"].alias("required"))


@register("extract_rules", """
SELECT p_partkey AS page_ord, 'f' || p_size AS field_name, p_brand AS resource, '^[a-z]{1,' || p_size || '}$' AS pattern,
       CASE WHEN p_size > 20 THEN NULL ELSE 'short' END AS notes FROM part
""")
def extract_rules(spark, sf):
    return entities.extract_rules(_api_tables(spark, sf)).select("page_ord", "field_name", "resource", "pattern", "notes")


@register("extract_code_examples", """
SELECT p_partkey AS page_ord, '{"id": ' || p_partkey || '}' AS code, 'Request' AS nearby_heading FROM part
""")
def extract_code_examples(spark, sf):
    return entities.extract_code_examples(_api(spark, sf), "Json").select("page_ord", "code", "nearby_heading")


# A paragraph without an end tag stays open to the end of the article and so holds all later text.
@register("clean_documents_whole_pages", _sql(r"""
WITH body AS (
  SELECT page_id, regexp_extract(html, '<article><h1>(.*?)</h1>', 1, 's') AS head,
         string_split(regexp_replace(regexp_replace(html, '^.*?<article><h1>.*?</h1>', '', 's'), '</article>.*$', '', 's'), '<p>')[2:] AS segs
  FROM pages
), plain AS (
  SELECT page_id, head, segs, list_transform(segs, lambda g: array_to_string(list_filter(list_transform(string_split_regex(g, '<[^>]*>'),
    lambda x: UNESCAPED(x)), lambda x: x <> ''), ' ')) AS texts
  FROM body
)
SELECT page_id, '# ' || UNESCAPED(head) || chr(10) || chr(10)
  || array_to_string(list_transform(range(1, len(segs) + 1), lambda i:
       CASE WHEN contains(segs[i], '</p>') THEN texts[i] ELSE array_to_string(texts[i:], ' ') END), chr(10)) AS content
FROM plain
"""))
def clean_documents_whole_pages(spark, sf):
    """Nested text of the raw pages: unclosed paragraphs repeat what they contain."""
    return html.clean_documents(_trees(spark, sf), "nested").select("page_id", "content")
