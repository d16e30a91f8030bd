"""Entity tables read out of the pseudo-tables of API documentation pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import is_deprecated, strip
from docweave.operators import html

# Request methods that make an endpoint.
METHODS = ("GET", "POST", "PATCH", "PUT", "DELETE")
# Source slips in the resources column, wrong and right, applied in order.
CORRECTIONS = (("Subscription Transfer", "Subscription, Transfer"),)

_H = F.col


def extract_endpoints(tables: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Tables with ``endpoint`` and ``method`` columns; the page's deprecation is inherited.

    Titles come from the tables' own ``title`` column or else from ``titles(page_id, title)``;
    without either the title is the page's path.
    """
    headers = _H("headers")
    carried = ("title",) if "title" in tables.columns else ()
    rows = html.bind_columns(
        tables,
        {"path": html.column_of(headers, "endpoint"), "method": html.column_of(headers, "method")},
        required=("path", "method"),
        keep=("page_note", *carried),
    )
    rows = rows.withColumn("method", F.upper("method")).where(
        F.col("method").isin(*METHODS) & (F.col("path") != "")
    )
    if carried:
        rows = rows.withColumn("title", F.coalesce("title", "url"))
    elif titles is None:
        rows = rows.withColumn("title", F.col("url"))
    else:
        rows = rows.join(titles.select("page_id", "title"), "page_id", "left").withColumn(
            "title", F.coalesce("title", "url")
        )
    return rows.select(
        F.col("page_id").alias("page_ord"), "tbl_ord", "row_ord", "method", "path",
        F.col("url").alias("docs_path"), "title",
        F.col("page_note").isNotNull().alias("deprecated"), F.col("page_note").alias("deprecation_note"),
    )


def _numeric(headers: Column) -> Column:
    return F.array_contains(headers, "error code") & F.array_contains(headers, "reason")


def _numeric_roles(headers: Column) -> dict[str, Column]:
    return {
        "code": html.column_of(headers, "error code"),
        "reason": html.column_of(headers, "reason"),
        "endpoint": html.column_of(headers, "endpoint"),
        "response": html.column_of(headers, "error response"),
    }


def _symbolic(headers: Column) -> Column:
    return (F.array_contains(headers, "reason_code") | F.array_contains(headers, "reasoncode")) & ~_numeric(headers)


def _symbolic_roles(headers: Column) -> dict[str, Column]:
    code = html.column_of(headers, "reason", "code", exact=False, allof=True)
    nowhere = F.lit(None).cast("int")
    reason = F.coalesce(html.column_of(headers, "description", exact=False), code + 1)
    return {"code": code, "reason": reason, "endpoint": nowhere, "response": nowhere}


def extract_numeric_codes(tables: DataFrame) -> DataFrame:
    """Tables with ``error code`` and ``reason``, optionally ``endpoint`` and ``error response``."""
    return _code_rows(html.bind_columns(tables, _numeric_roles(_H("headers")), required=("code", "reason")))


def extract_reason_codes(tables: DataFrame) -> DataFrame:
    """Tables of symbolic reason codes that are not tables of numeric codes."""
    symbolic = tables.where(_symbolic(_H("headers")))
    return _code_rows(html.bind_columns(symbolic, _symbolic_roles(_H("headers")), required=("code",)))


def _code_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("page_id").alias("page_ord"), "tbl_ord", "row_ord", "code", "reason", "endpoint",
        "response", F.col("url").alias("docs_path"),
    )


def extract_error_codes(tables: DataFrame) -> DataFrame:
    """Numeric and symbolic codes together. A table is of one kind, so both come from one pass over the tables."""
    headers = _H("headers")
    numeric, symbolic = _numeric_roles(headers), _symbolic_roles(headers)
    roles = {role: F.when(_numeric(headers), numeric[role]).otherwise(symbolic[role]) for role in numeric}
    return _code_rows(html.bind_columns(tables.where(_numeric(headers) | _symbolic(headers)), roles, required=("code",)))


def apply_corrections(text: Column, corrections: tuple[tuple[str, str], ...] = CORRECTIONS) -> Column:
    """Replace known source slips, one after the other."""
    for wrong, right in corrections:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def extract_status_codes(tables: DataFrame,
                         corrections: tuple[tuple[str, str], ...] = CORRECTIONS) -> DataFrame:
    """Tables with ``status code`` and ``applicable resources``."""
    headers = _H("headers")
    rows = html.bind_columns(
        tables,
        {
            "code": html.column_of(headers, "status code"),
            "description": html.column_of(headers, "description"),
            "applicable_resources": html.column_of(headers, "applicable resources"),
        },
        required=("code", "applicable_resources"),
    )
    return rows.select(
        F.col("page_id").alias("page_ord"), "tbl_ord", "row_ord", "code",
        F.coalesce("description", F.lit("")).alias("description"),
        apply_corrections(F.col("applicable_resources"), corrections).alias("applicable_resources"),
        F.col("url").alias("docs_path"),
    )


def split_type_cell(cell: Column) -> Column:
    """Type cell to struct(type, required): the first line names the type, later ones say
    optional or required and the last such line wins."""
    parts = F.filter(F.transform(F.split(cell, "\n"), strip), lambda line: line != "")
    verdicts = F.filter(
        F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
            lambda line: F.when(F.contains(F.lower(line), F.lit("optional")), False)
            .when(F.contains(F.lower(line), F.lit("required")), True),
        ),
        lambda v: v.isNotNull(),
    )
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("type"),
        F.get(verdicts, F.size(verdicts) - 1).alias("required"),
    )


def extract_schemas(headed: DataFrame) -> DataFrame:
    """One resource per h2/h3 directly followed by a Property/Type table; rows stay in one array.

    ``headed`` are the tables of :func:`html.heading_tables`.
    """
    headers = _H("headers")
    tables = (
        headed
        .withColumn("_name", html.column_of(headers, "property"))
        .withColumn("_type", html.column_of(headers, "type"))
        .withColumn("_desc", html.column_of(headers, "description"))
        .withColumn("_limits", html.column_of(headers, "range", "limit", exact=False))
        .where("_name IS NOT NULL AND _type IS NOT NULL")
    )

    def field(row: Column) -> Column:
        cells = row["cells"]
        kind = split_type_cell(F.get(cells, F.col("_type")))
        description = F.coalesce(strip(F.get(cells, F.col("_desc"))), F.lit(""))
        return F.struct(
            strip(F.get(cells, F.col("_name"))).alias("name"),
            kind["type"].alias("type"),
            kind["required"].alias("required"),
            description.alias("description"),
            F.nullif(strip(F.get(cells, F.col("_limits"))), F.lit("")).alias("constraints"),
            is_deprecated(description).alias("deprecated"),
        )

    wide = F.filter("rows", lambda r: F.size(r["cells"]) > F.greatest("_name", "_type"))
    fields = F.filter(F.transform(wide, field), lambda f: f["name"] != "")
    return (
        tables.select("page_id", "url", "tbl_ord", "heading", "level", fields.alias("fields"))
        .where("size(fields) > 0")
        .select(
            F.col("page_id").alias("page_ord"), "tbl_ord", F.col("heading").alias("name"), "level",
            "fields", F.col("url").alias("docs_path"),
        )
    )


def schema_fields(schemas: DataFrame) -> DataFrame:
    """One row per field, with its position."""
    return schemas.select(
        "page_ord", "tbl_ord", F.col("name").alias("schema_name"), "level", "docs_path",
        F.posexplode("fields").alias("field_ord", "f"),
    ).select("page_ord", "tbl_ord", "schema_name", "level", "docs_path", "field_ord", "f.*")


def extract_rules(tables: DataFrame) -> DataFrame:
    """Tables pairing field names with validation patterns."""
    headers = _H("headers")
    rows = html.bind_columns(
        tables,
        {
            "field_name": html.column_of(headers, "field name", exact=False),
            "resource": html.column_of(headers, "resource", "object", exact=False),
            "pattern": html.column_of(headers, "regular expression", "regex", exact=False),
            "notes": html.column_of(headers, "note", exact=False),
        },
        required=("field_name", "resource", "pattern"),
        width=("field_name", "resource", "pattern"),
    )
    return rows.where("field_name <> '' AND pattern <> ''").select(
        F.col("page_id").alias("page_ord"), "tbl_ord", "row_ord", "field_name", "resource", "pattern",
        F.nullif("notes", F.lit("")).alias("notes"),
    )


def extract_code_examples(trees: DataFrame, language: str | None = None) -> DataFrame:
    """Code blocks with the heading they stand under, optionally of one language."""
    blocks = html.nearest_heading(trees)
    if language:
        blocks = blocks.where(F.coalesce("language", F.lit("")) == language.lower())
    return blocks.select(
        F.col("page_id").alias("page_ord"), F.col("url").alias("docs_path"), "ord", "language", "code",
        "nearby_heading",
    )
