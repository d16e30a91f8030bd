"""From raw pages to a complete index snapshot in one job graph."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import canonical_path
from docweave.operators import catalog as catalogs
from docweave.operators import entities, html, quality, releases
from docweave.session import cut_lineage
from docweave.sources import snapshots


def page_facts(pages: DataFrame, release_path: str, upcoming_path: str, suffix_word: str | None = None) -> DataFrame:
    """One row per page with everything the extractors need, in one narrow pass.

    The trees themselves, larger than the pages, never leave the task that built them.
    """
    trees = html.shred_html(pages)
    path = canonical_path(F.col("url"))
    is_notes = path == canonical_path(F.lit(release_path))
    is_upcoming = path == canonical_path(F.lit(upcoming_path))
    tables = html.tables_in_page()
    return trees.select(
        "page_id", "url", "error",
        catalogs.title_in_page(suffix_word).alias("title"),
        F.when(F.exists("nodes", html.is_table), html.note_in_page()).alias("page_note"),
        tables.alias("tables"), html.headed_tables_in_page().alias("headed"),
        F.when(is_notes, releases.blocks_in_page()).alias("blocks"),
        F.when(is_upcoming, releases.upcoming_in_page()).alias("upcoming"),
    )


def build_index(pages: DataFrame, release_path: str, upcoming_path: str,
                suffix_word: str | None = None, curated: DataFrame | None = None) -> dict[str, DataFrame]:
    """All entity tables, the catalog, the parse errors and the checkpointed page facts.

    Pages are parsed once; what the extractors need from them is checkpointed, which is
    little for pages without tables. Every extractor then works on its own few rows.
    """
    facts = cut_lineage(page_facts(pages, release_path, upcoming_path, suffix_word))
    tables = html.split_header(facts.select("page_id", "url", "title", "page_note", F.inline("tables")))
    headed = html.split_header(facts.select("page_id", "url", F.inline("headed")))
    titles = facts.where("error IS NULL").select("page_id", "url", "title")
    upcoming = facts.where("error IS NULL AND upcoming IS NOT NULL").select("page_id", "url", F.col("upcoming").alias("body"))
    notes = releases.collect_changes(facts.where("blocks IS NOT NULL"))
    return {
        "facts": facts,
        "catalog": catalogs.catalog_of(titles, curated),
        "endpoints": entities.extract_endpoints(tables),
        "error_codes": entities.extract_error_codes(tables),
        "status_codes": entities.extract_status_codes(tables),
        "schemas": entities.extract_schemas(headed),
        "releases": notes.unionByName(releases.upcoming_entries(upcoming)),
        "validation_rules": entities.extract_rules(tables),
        "parse_errors": html.parse_errors(facts),
    }


def rebuild(pages: DataFrame, root: str, version: str, now: datetime.datetime, release_path: str,
            upcoming_path: str, least_paths: int = catalogs.MIN_PATHS, **options) -> bool:
    """Check the catalog floor, build, write to a new folder, check the floors and the failure rate.

    Returns whether the new version was accepted; fewer than ``least_paths`` paths fail the job before
    a page is parsed. A failed or rejected build gets no manifest, also under the name of a
    published version, so readers stay with what was published before.
    """
    catalogs.catalog_floor(pages.select(canonical_path(F.col("url")).alias("path")).distinct(), least_paths).collect()
    index = build_index(pages, release_path, upcoming_path, **options)
    facts = index.pop("facts")
    spark = pages.sparkSession
    folder = snapshots.new_folder(version)
    for name, table in index.items():
        table.write.parquet(f"{root}/{folder}/{name}")
    written = {name: spark.read.schema(table.schema).parquet(f"{root}/{folder}/{name}") for name, table in index.items()}
    counts = quality.index_summary(written)
    accepted = quality.accept_snapshot(quality.structural_floors(counts)).first()["accepted"]
    sizes = facts.agg(F.count("*").alias("pages"), F.count_if(F.col("error").isNull()).alias("parsed")).first()
    errors = counts.where("entity = 'parse_errors'").first()["n"]
    if not accepted or errors / max(sizes["pages"], 1) >= quality.FAILURE_SHARE:
        return False
    snapshots.write_manifest(spark, root, folder, version, now, sizes["pages"], sizes["parsed"])
    return True
