"""Versioned table sets on shared storage.

Every write takes a new folder of parquet tables; its manifest is written last and names the
folder, so a write without a manifest (failed, unfinished or rejected) does not exist for
readers, and one that reuses a version's name leaves the published tables alone.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.schemas import INDEX_VERSION

MANIFEST = "version STRING, schema_version INT, built_at TIMESTAMP, source_sitemap_size BIGINT, pages_parsed BIGINT, folder STRING, written_at TIMESTAMP"


def new_folder(version: str) -> str:
    """A folder below the root that no other write uses."""
    return f"v={version}/{uuid.uuid4().hex}"


def write_snapshot(tables: dict[str, DataFrame], root: str, version: str, built_at: datetime.datetime,
                   source_sitemap_size: int = 0, pages_parsed: int = 0,
                   schema_version: int = INDEX_VERSION) -> str:
    """Write all tables of one version, then its manifest. Returns the version's folder."""
    folder, spark = new_folder(version), SparkSession.active()
    for name, table in tables.items():
        table.write.parquet(f"{root}/{folder}/{name}")
    write_manifest(spark, root, folder, version, built_at, source_sitemap_size, pages_parsed, schema_version)
    return f"{root}/{folder}"


def write_manifest(spark: SparkSession, root: str, folder: str, version: str, built_at: datetime.datetime,
                   source_sitemap_size: int = 0, pages_parsed: int = 0,
                   schema_version: int = INDEX_VERSION) -> None:
    """Make the tables of ``folder`` visible to readers as ``version``."""
    row = (version, schema_version, built_at, source_sitemap_size, pages_parsed, folder, None)
    manifest = spark.createDataFrame([row], MANIFEST).withColumn("written_at", F.current_timestamp())
    manifest.coalesce(1).write.parquet(f"{root}/{folder}/manifest")


def manifests(spark: SparkSession, root: str) -> DataFrame | None:
    """Manifests of all finished writes, without damaged ones, or None when there are none."""
    try:
        return spark.read.schema(MANIFEST).option("ignoreCorruptFiles", "true").parquet(f"{root}/v=*/*/manifest")
    except AnalysisException:
        return None


def read_snapshot(spark: SparkSession, root: str, names: tuple[str, ...],
                  schema_version: int = INDEX_VERSION) -> dict[str, DataFrame] | None:
    """Tables of the newest finished version that can be read, with ``manifest``.

    The latest write counts where a version was written again. Missing, unreadable or of another
    schema version counts as absent: the next older one is taken, None when there is none left.
    """
    known = manifests(spark, root)
    if known is None:
        return None
    ranked = known.where(F.col("schema_version") == schema_version).orderBy(
        F.col("built_at").desc(), F.col("version").desc(), F.col("written_at").desc())
    for row in ranked.select("folder").toLocalIterator():  # one short row per version
        try:
            tables = {name: spark.read.parquet(f"{root}/{row['folder']}/{name}") for name in names}
        except Exception:  # a damaged version is an absent one
            continue
        tables["manifest"] = known.where(F.col("folder") == row["folder"])
        return tables
    return None


def guarded_overwrite(table: DataFrame, path: str) -> None:
    """Overwrite a table on disk, but refuse to put an empty one over rows."""
    if table.isEmpty():
        try:
            existing = table.sparkSession.read.parquet(path)
            occupied = not existing.isEmpty()
        except AnalysisException:
            occupied = False
        if occupied:
            raise ValueError(f"refusing to overwrite the rows at {path} with an empty table")
    table.write.mode("overwrite").parquet(path)
