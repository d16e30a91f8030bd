"""The page catalog: canonical paths, titles, tags, listing and lookup."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.expr import let
from docweave.functions.joins import attach
from docweave.functions.text import WORD, canonical_path, path_parts, strip, title_case
from docweave.operators import html

# The least number of paths a healthy catalog has, and words not used as tags.
MIN_PATHS = 50
STOPWORDS = ("the", "a", "an", "and", "or", "of", "to", "for", "in", "on", "with", "by")
GENERIC_SEGMENTS = ("docs",)
MIN_TAG_LENGTH = 3


def canonical_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct canonical paths in order."""
    return paths.select(canonical_path(F.col(column)).alias("path")).distinct().orderBy("path")


def catalog_floor(paths: DataFrame, least: int = MIN_PATHS) -> DataFrame:
    """(found, least) when at least ``least`` paths survive; the job fails otherwise."""
    counted = paths.agg(F.count("*").alias("found"))
    enough = F.col("found") >= least
    message = F.concat(F.lit("catalog has only "), F.col("found").cast("string"), F.lit(f" paths, needs {least}"))
    return counted.select(
        F.when(enough, F.col("found")).otherwise(F.raise_error(message).cast("bigint")).alias("found"),
        F.lit(least).alias("least"),
    )


def title_in_page(suffix_word: str | None = None) -> Column:
    """The first h1 if it has text, else the title element without its `` | Vendor`` or
    `` — Vendor`` suffix, else the path. Other h1s are not tried."""
    def first(tag: str) -> Column:
        return let(
            F.get(F.filter("nodes", lambda n: n["tag"] == tag), F.lit(0)),
            lambda n: F.when(n.isNotNull(), F.nullif(html.node_text(n, ""), F.lit(""))),
        )

    title = first("title")
    if suffix_word:
        title = strip(F.regexp_replace(title, rf"\s*[|—]\s*{re.escape(suffix_word)}[^\n]*$", ""))
    return F.coalesce(first("h1"), title, F.col("url"))


def resolve_titles(trees: DataFrame, suffix_word: str | None = None) -> DataFrame:
    """(page_id, url, title) of every readable page."""
    return trees.where("error IS NULL").select("page_id", "url", title_in_page(suffix_word).alias("title"))


def tags_of(path: Column, title: Column, generic: tuple[str, ...] = GENERIC_SEGMENTS) -> Column:
    """Sorted distinct tags: words of the path segments, whole segments, and title words."""
    segments = F.filter(path_parts(path), lambda s: ~s.isin(*generic) if generic else F.lit(True))
    words = F.flatten(F.transform(segments, lambda s: F.filter(
        F.split(s, "[-_]"), lambda w: F.length(w) >= MIN_TAG_LENGTH
    )))
    whole = F.transform(segments, lambda s: F.translate(s, "-_", "  "))
    named = F.filter(
        F.regexp_extract_all(F.lower(title), F.lit(WORD), F.lit(0)),
        lambda w: (F.length(w) >= MIN_TAG_LENGTH) & ~w.isin(*STOPWORDS),
    )
    return F.array_sort(F.array_distinct(F.concat(F.transform(F.concat(words, whole), F.lower), named)))


def derive_tags(entries: DataFrame, generic: tuple[str, ...] = GENERIC_SEGMENTS) -> DataFrame:
    return entries.withColumn("tags", tags_of(F.col("path"), F.col("title"), generic))


def merge_curated_tags(catalog: DataFrame, curated: DataFrame) -> DataFrame:
    """Union the curated tags of the last path segment into the entry's tags.

    ``curated(last_segment, tags)`` has one row per segment. ``curated_hit`` tells merged rows.
    """
    extra = curated.select(F.col("last_segment").alias("_segment"), F.col("tags").alias("_extra"))
    segment = F.lower(F.element_at(path_parts(F.col("path")), -1))
    keyed = catalog.withColumn("_segment", F.when(F.size(path_parts(F.col("path"))) > 0, segment))
    merged = attach(keyed, extra, ["_segment"], F.col("path"))
    return merged.withColumns({
        "tags": F.when(F.col("_extra").isNotNull(), F.array_sort(F.array_union("tags", "_extra"))).otherwise(F.col("tags")),
        "curated_hit": F.col("_extra").isNotNull(),
    }).drop("_segment", "_extra")


def build_catalog(trees: DataFrame, curated: DataFrame | None = None, suffix_word: str | None = None,
                  generic: tuple[str, ...] = GENERIC_SEGMENTS) -> DataFrame:
    """Canonical path, title and tags per readable page; of equal paths the first page stays."""
    return catalog_of(resolve_titles(trees, suffix_word), curated, generic)


def catalog_of(titles: DataFrame, curated: DataFrame | None = None,
               generic: tuple[str, ...] = GENERIC_SEGMENTS) -> DataFrame:
    """The catalog of titles(page_id, url, title)."""
    titled = titles.withColumn("path", canonical_path(F.col("url")))
    first = titled.groupBy("path").agg(F.min(F.struct("page_id", "title")).alias("e")).select(
        F.col("e.page_id").alias("page_ord"), "path", F.col("e.title").alias("title")
    )
    tagged = derive_tags(first, generic)
    if curated is None:
        return tagged
    return merge_curated_tags(tagged, curated).drop("curated_hit")


def list_catalog(catalog: DataFrame) -> DataFrame:
    """Entries in path order with their area: the second path segment in title case."""
    area = F.coalesce(F.get(path_parts(F.col("path")), F.lit(1)), F.lit("root"))
    return catalog.select(
        title_case(F.translate(area, "-_", "  ")).alias("area"), "path", "title"
    ).orderBy("path")


def lookup_page(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog entry for each requested path, compared canonically; ``known`` flags misses."""
    wanted = requests.withColumn("key", canonical_path(F.col("path"))).select("path", "key")
    entries = catalog.groupBy(canonical_path(F.col("path")).alias("key")).agg(
        F.min_by("title", "page_ord").alias("title")
    )
    # Requests may repeat one path any number of times.
    return attach(wanted, entries.withColumn("known", F.lit(True)), ["key"], F.monotonically_increasing_id()).select(
        "path", F.col("key").alias("canonical"), F.coalesce("title", "key").alias("title"),
        F.coalesce("known", F.lit(False)).alias("known"),
    )


def unknown_pages(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested paths the catalog does not have."""
    wanted = requests.select("path", canonical_path(F.col("path")).alias("key"))
    return wanted.join(
        catalog.select(canonical_path(F.col("path")).alias("key")), "key", "left_anti"
    ).select("path")
