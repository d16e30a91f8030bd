"""Table layouts. Positions are columns, so "first" is always a ``min_by`` on them."""

PAGES = "page_id BIGINT, url STRING, html STRING"

NODE = (
    "STRUCT<ord: INT, parent: INT, last: INT, nth: INT, tag: STRING, cls: ARRAY<STRING>, "
    "attrs: MAP<STRING, STRING>, marks: BIGINT, lo: INT, hi: INT>"
)
RUN = "STRUCT<elem: INT, block: INT, marks: BIGINT, text: STRING>"
TREES = f"page_id BIGINT, url STRING, error STRING, nodes ARRAY<{NODE}>, runs ARRAY<{RUN}>"

ENDPOINTS = (
    "page_ord BIGINT, tbl_ord INT, row_ord INT, method STRING, path STRING, docs_path STRING, "
    "title STRING, deprecated BOOLEAN, deprecation_note STRING"
)
ERROR_CODES = (
    "page_ord BIGINT, tbl_ord INT, row_ord INT, code STRING, reason STRING, endpoint STRING, "
    "response STRING, docs_path STRING"
)
STATUS_CODES = (
    "page_ord BIGINT, tbl_ord INT, row_ord INT, code STRING, description STRING, "
    "applicable_resources STRING, docs_path STRING"
)
FIELD = (
    "STRUCT<name: STRING, type: STRING, required: BOOLEAN, description: STRING, "
    "constraints: STRING, deprecated: BOOLEAN>"
)
SCHEMAS = (
    "page_ord BIGINT, tbl_ord INT, name STRING, level INT, "
    f"fields ARRAY<{FIELD}>, docs_path STRING"
)
RULES = (
    "page_ord BIGINT, tbl_ord INT, row_ord INT, field_name STRING, resource STRING, "
    "pattern STRING, notes STRING"
)
RELEASES = (
    "page_ord BIGINT, sec_ord INT, entry_ord INT, date DATE, raw_date STRING, section STRING, "
    "changes ARRAY<STRUCT<title: STRING, body: STRING>>, docs_path STRING"
)
PARSE_ERRORS = "path STRING, error STRING"
CATALOG = "page_ord BIGINT, path STRING, title STRING, tags ARRAY<STRING>"
CONTENT_CACHE = "path STRING, content STRING, etag STRING, fetched_at TIMESTAMP"
ATTEMPTS = (
    "path STRING, variant_no INT, attempt_no INT, status INT, error_kind STRING, etag STRING, "
    "body STRING, ts TIMESTAMP"
)

ENTITY_TABLES = {
    "endpoints": ENDPOINTS,
    "error_codes": ERROR_CODES,
    "status_codes": STATUS_CODES,
    "schemas": SCHEMAS,
    "releases": RELEASES,
    "validation_rules": RULES,
    "parse_errors": PARSE_ERRORS,
}

# Version numbers a reader must find before it trusts a table set.
INDEX_VERSION = 5
CACHE_VERSION = 1
CATALOG_VERSION = 1
