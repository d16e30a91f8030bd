"""From a request line such as ``POST /v3/items`` to the documented endpoint and schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.joins import attach

# How a request line is written.
REQUEST_LINE = r"(?iU)^\s*(GET|POST|PATCH|PUT|DELETE)\s+(\S+)\s*$"
ENDPOINT_ORDER = ("page_ord", "tbl_ord", "row_ord")

UNPARSEABLE, NOT_FOUND, NO_SCHEMA = "unparseable", "not_found", "no_schema"


def last_segment(path: Column) -> Column:
    """What follows the last slash once trailing slashes are gone; may be empty."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def exact_index(endpoints: DataFrame) -> DataFrame:
    """(method, path) to the first documented occurrence."""
    return endpoints.groupBy("method", "path").agg(
        F.min_by("docs_path", F.struct(*ENDPOINT_ORDER)).alias("exact_docs")
    )


def loose_index(endpoints: DataFrame) -> DataFrame:
    """(method, suffix) to the first endpoint whose path ends with the suffix.

    A request's last segment holds no slash, so only suffixes of the documented last
    segment can match it. Reduced to one row per key before any request is joined.
    """
    last = last_segment(F.col("path"))
    suffixes = F.transform(F.sequence(F.lit(0), F.length(last)), lambda n: F.right(last, n))
    return (
        endpoints.select("method", "docs_path", *ENDPOINT_ORDER, F.explode(suffixes).alias("suffix"))
        .groupBy("method", "suffix")
        .agg(F.min_by("docs_path", F.struct(*ENDPOINT_ORDER)).alias("loose_docs"))
    )


def request_schemas(schemas: DataFrame) -> DataFrame:
    """docs_path to its request schema: the first not named as a response, else the first."""
    is_response = F.contains(F.lower("name"), F.lit("response"))
    return (
        schemas.groupBy("docs_path")
        .agg(F.min_by(F.struct("name", "fields"), F.struct(is_response, "page_ord", "tbl_ord")).alias("s"))
        .select("docs_path", F.col("s.name").alias("schema_name"), F.col("s.fields").alias("fields"))
    )


def resolve_schema(requests: DataFrame, endpoints: DataFrame, schemas: DataFrame,
                   spread: Column | None = None) -> DataFrame:
    """Add method, path, match, docs_path, schema_name, fields and failure to ``requests(endpoint, …)``.

    Exact (method, path) first; only requests without one fall back to the suffix match.
    """
    spread = F.col("endpoint") if spread is None else spread
    method = F.nullif(F.upper(F.regexp_extract("endpoint", REQUEST_LINE, 1)), F.lit(""))
    parsed = requests.withColumns({
        "method": method,
        "path": F.when(method.isNotNull(), F.regexp_extract("endpoint", REQUEST_LINE, 2)),
    })
    found = attach(parsed, exact_index(endpoints), ["method", "path"], spread)
    # Requests with an exact hit carry no suffix and so cannot meet the fallback.
    found = found.withColumn("suffix", F.when(F.col("exact_docs").isNull(), last_segment(F.col("path"))))
    found = attach(found, loose_index(endpoints), ["method", "suffix"], spread)
    found = found.withColumn("docs_path", F.coalesce("exact_docs", "loose_docs"))
    resolved = attach(found, request_schemas(schemas), ["docs_path"], spread)
    failure = (
        F.when(F.col("method").isNull(), UNPARSEABLE)
        .when(F.col("docs_path").isNull(), NOT_FOUND)
        .when(F.col("schema_name").isNull(), NO_SCHEMA)
    )
    match = F.when(F.col("exact_docs").isNotNull(), "exact").when(F.col("loose_docs").isNotNull(), "loose")
    return resolved.withColumns({"failure": failure, "match": match}).drop("exact_docs", "loose_docs", "suffix")
