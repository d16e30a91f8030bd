"""Search over documents: scoring, batches of queries, sections and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions.text import tokens
from docweave.operators import search
from docweave.plans import answer
from docweave.session import stored
from workload.base import register, table

QUERY = "The of src1 une und THE que en"
SQL_TOKENS = "regexp_extract_all(lower({q}), '[\\p{{L}}\\p{{N}}_]+')"
QUERY_TOKENS = f"""(SELECT token, CAST(count(*) AS BIGINT) AS m FROM (SELECT unnest({SQL_TOKENS.format(q=f"'{QUERY}'")}) AS token) GROUP BY token)"""
DOCS_SQL = """docs AS (
  SELECT doc_id, text AS content, lower(text) AS c, lower(split_part(text, chr(10), 1)) AS t, lower(lang || ' ' || source) AS g FROM documents
)"""


def docs(spark, sf):
    """Documents as a searchable catalog: the first line is the title, language and source are tags."""
    return table(spark, sf, "documents").select(
        "doc_id", F.split("text", "\n")[0].alias("title"), F.array("lang", "source").alias("tags"),
        F.col("text").alias("content"),
    )


def queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@register("tokenize", f"""
SELECT doc_id, array_to_string({SQL_TOKENS.format(q='text')}, ' ') AS tokens, CAST(len({SQL_TOKENS.format(q='text')}) AS INTEGER) AS n FROM documents
""")
def tokenize(spark, sf):
    words = tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(words, " ").alias("tokens"), F.size(words).alias("n"))


SCORED_SQL = f"""
WITH {DOCS_SQL}, q AS {QUERY_TOKENS}, scored AS (
  SELECT doc_id, content,
    sum(CASE WHEN contains(t, token) THEN m ELSE 0 END) AS ts, sum(CASE WHEN contains(g, token) THEN m ELSE 0 END) AS gs,
    sum(m * ((length(c) - length(replace(c, token, ''))) // length(token))) AS cs
  FROM docs, q GROUP BY doc_id, content
)
"""


@register("score_title_tags", SCORED_SQL + """
SELECT doc_id, CAST(ts AS INTEGER) AS title_score, CAST(gs AS INTEGER) AS tag_score FROM scored
""")
def score_title_tags(spark, sf):
    return search.score_title_tags(docs(spark, sf), QUERY).select("doc_id", "title_score", "tag_score")


@register("score_content", SCORED_SQL + "SELECT doc_id, CAST(cs AS BIGINT) AS content_score FROM scored")
def score_content(spark, sf):
    return search.score_content(docs(spark, sf), QUERY).select("doc_id", "content_score")


@register("search_top_k", SCORED_SQL + """
SELECT doc_id, split_part(content, chr(10), 1) AS title, CAST(ts AS INTEGER) AS title_score, CAST(gs AS INTEGER) AS tag_score,
       CAST(cs AS BIGINT) AS content_score, CAST(4 * ts + 2 * gs + cs AS BIGINT) AS total
FROM scored WHERE 4 * ts + 2 * gs + cs > 0 ORDER BY total DESC, doc_id LIMIT 5
""")
def search_top_k(spark, sf):
    return search.search_top_k(docs(spark, sf), QUERY)


BATCH_SQL = f"""
WITH {DOCS_SQL}, q AS (
  SELECT query_id, token, CAST(count(*) AS BIGINT) AS m
  FROM (SELECT item_id AS query_id, unnest({SQL_TOKENS.format(q='text')}) AS token FROM benchmark) GROUP BY ALL
), words AS (SELECT DISTINCT token FROM q), hits AS (
  SELECT doc_id, token, contains(t, token) AS it, contains(g, token) AS ig,
         (length(c) - length(replace(c, token, ''))) // length(token) AS n
  FROM docs, words WHERE contains(c, token) OR contains(g, token)
), scored AS (
  SELECT query_id, doc_id, CAST(sum(m * it::INT) AS BIGINT) AS title_score, CAST(sum(m * ig::INT) AS BIGINT) AS tag_score,
         CAST(sum(m * n) AS BIGINT) AS content_score
  FROM hits JOIN q USING (token) GROUP BY query_id, doc_id
), ranked AS (
  SELECT *, 4 * title_score + 2 * tag_score + content_score AS total,
         row_number() OVER (PARTITION BY query_id ORDER BY 4 * title_score + 2 * tag_score + content_score DESC, doc_id) AS rank
  FROM scored WHERE 4 * title_score + 2 * tag_score + content_score > 0
)
"""


@register("search_batch", BATCH_SQL + """
SELECT query_id, doc_id, title_score, tag_score, content_score, CAST(total AS BIGINT) AS total, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= 10
""")
def search_batch(spark, sf):
    return search.search_batch(stored(search.build_postings(docs(spark, sf))), queries(spark, sf), 10)


# ---------------------------------------------------------------- sections

SECTIONED = "concat(lang, ' intro\\n\\n# ', source, ' *top*  \\n', text, '\\n\\n##   Part ', doc_id, '\\n###\\tDeep\\ntail ', n_chars, '\\n')"


def sectioned(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{SECTIONED} AS content")


SECTIONS_SQL = """
SELECT doc_id, 0 AS sec_ord, '' AS heading, 0 AS level, lang || ' intro' AS body FROM documents
UNION ALL SELECT doc_id, 1, source || ' *top*', 1, trim(text, E' \\n\\t\\r') FROM documents
UNION ALL SELECT doc_id, 2, 'Part ' || doc_id, 2, '' FROM documents
UNION ALL SELECT doc_id, 3, 'Deep', 3, 'tail ' || n_chars FROM documents
"""


@register("split_sections", SECTIONS_SQL)
def split_sections(spark, sf):
    return search.split_sections(sectioned(spark, sf))


@register("score_sections", f"""
WITH s AS ({SECTIONS_SQL}), q AS {QUERY_TOKENS}, x AS (SELECT doc_id, sec_ord, lower(heading || ' ' || body) AS c FROM s)
SELECT doc_id, sec_ord, CAST(sum(m * ((length(c) - length(replace(c, token, ''))) // length(token))) AS INTEGER) AS score
FROM x, q GROUP BY doc_id, sec_ord
""")
def score_sections(spark, sf):
    return search.score_sections(search.split_sections(sectioned(spark, sf)), QUERY).select("doc_id", "sec_ord", "score")


PARAGRAPHS = "concat(replace(text, '\\n', ' \\n \\t\\n'), '\\n\\n\\n')"
PARAGRAPHS_SQL = """pars AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> '') AS ps FROM documents
)"""


def paragraphed(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{PARAGRAPHS} AS content")


@register("split_paragraphs", f"""
WITH {PARAGRAPHS_SQL} SELECT doc_id, CAST(i - 1 AS INTEGER) AS par_ord, ps[i] AS body FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM pars)
""")
def split_paragraphs(spark, sf):
    return search.split_paragraphs(paragraphed(spark, sf))


@register("route_flat_pages", f"""
WITH {PARAGRAPHS_SQL}
SELECT doc_id, CASE WHEN lang = 'en' THEN 'paragraph' ELSE 'section' END AS unit_kind,
       CAST(CASE WHEN lang = 'en' THEN len(ps) + 1 ELSE 2 END AS INTEGER) AS n_units
FROM documents JOIN pars USING (doc_id)
""")
def route_flat_pages(spark, sf):
    flat = "concat('# ', lang, '\\n\\n', replace(text, '\\n', '\\n\\n'))"
    headed = "concat('# ', lang, '\\n', text, '\\n## ', source, '\\nend')"
    mixed = table(spark, sf, "documents").selectExpr("doc_id", f"if(lang = 'en', {flat}, {headed}) AS content")
    return search.route_units(mixed).select("doc_id", "unit_kind", F.size("units").alias("n_units"))


def passages_sql(order: str, zero_rule: str) -> str:
    return f"""
WITH {PARAGRAPHS_SQL}, units AS (
  SELECT doc_id, i AS pos, ps[i] AS shown, lower(ps[i]) AS c FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM pars)
), q AS {QUERY_TOKENS}, scored AS (
  SELECT doc_id, pos, shown, sum(m * ((length(c) - length(replace(c, token, ''))) // length(token))) AS score FROM units, q GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER w AS rk, sum(length(shown) + 2) OVER (w ROWS UNBOUNDED PRECEDING) AS used
  FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY {order})
), kept AS (SELECT *, rk = 1 OR (used <= 700 {zero_rule}) AS keep FROM ranked)
SELECT doc_id, string_agg(shown, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE keep) AS passage,
       CAST(count(*) FILTER (WHERE NOT keep) AS INTEGER) AS omitted
FROM kept GROUP BY doc_id
"""


@register("select_passages", passages_sql("score DESC, pos", "AND score > 0"))
def select_passages(spark, sf):
    asked = paragraphed(spark, sf).withColumn("query", F.lit(QUERY))
    return search.relevant_passages(asked, 700).select("doc_id", "passage", "omitted")


@register("lead_passages", passages_sql("pos", ""))
def lead_passages(spark, sf):
    return search.lead_passages(paragraphed(spark, sf), 700).select("doc_id", "passage", "omitted")


@register("assemble_passages", """
SELECT doc_id, lang || ' intro' || chr(10) || chr(10) || '### Deep' || chr(10) || chr(10) || 'tail ' || n_chars AS passage, 2 AS omitted
FROM documents
""")
def assemble_passages(spark, sf):
    chosen = search.route_units(sectioned(spark, sf)).withColumns(
        {"chosen": F.array(F.lit(0), F.lit(3)), "n_units": F.size("units")}
    )
    return search.assemble_passages(chosen).select("doc_id", "passage", "omitted")


@register("search_with_passages", BATCH_SQL + """, best AS (SELECT * FROM ranked WHERE rank <= 3), units AS (
  SELECT query_id, b.rank, d.doc_id, trim(d.content, E' \\n\\t\\r') AS shown FROM best b JOIN docs d USING (doc_id)
)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, shown AS passage, 0 AS omitted FROM units
""")
def search_with_passages(spark, sf):
    # These documents hold no blank line, so each is one unit and is shown whole.
    found = answer.search_with_passages(docs(spark, sf), queries(spark, sf), 3)
    return found.select("query_id", "doc_id", "rank", "passage", "omitted")
