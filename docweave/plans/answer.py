"""The two request paths end to end: search with passages, and checks against a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.joins import attach
from docweave.operators import conformance, search
from docweave.session import stored
from docweave.sources.snapshots import read_snapshot


def search_with_passages(docs: DataFrame, queries: DataFrame, k: int = search.DEFAULT_RESULTS,
                         budget: int = search.BUDGET, postings: DataFrame | None = None) -> DataFrame:
    """Top documents per query with their best passages.

    Ranking works on postings only. The hits, at most ``k`` per query, are stored and
    measured, so that they go to the contents and the contents stay where they are.
    """
    postings = stored(search.build_postings(docs)) if postings is None else postings
    hits = search.search_batch(postings, queries, k)
    asked = stored(hits.join(queries.select("query_id", F.col("text").alias("query")), "query_id"))
    contents = docs.select("doc_id", "title", "content")
    found = attach(contents, asked, ["doc_id"], F.col("doc_id"), how="inner")
    return search.relevant_passages(found, budget)


def validate_against_snapshot(spark: SparkSession, bodies: DataFrame, root: str) -> DataFrame:
    """Issues of ``bodies`` against the newest snapshot under ``root``.

    The index tables come from parquet, so Spark knows their size and broadcasts them while
    they are small; then the bodies are not shuffled at all.
    """
    index = read_snapshot(spark, root, ("endpoints", "schemas", "validation_rules"))
    if index is None:
        raise ValueError(f"no usable index under {root}, rebuild it first")
    return conformance.validate(bodies, index["endpoints"], index["schemas"], index["validation_rules"])
