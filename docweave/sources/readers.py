"""Readers for pages, sitemaps, bodies, notes and tables kept as JSON lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import lines


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Parquet pages(page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """HTML files, one page each; the file path is the URL and its hash the page id."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.xxhash64("path").alias("page_id"), F.col("path").alias("url"),
        F.decode("content", "UTF-8").alias("html"),
    )


def split_failed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with content, and (path, error) for those without: a bad page is recorded, not fatal."""
    failed = pages.where("html IS NULL").select(F.col("url").alias("path"), F.lit("no content").alias("error"))
    return pages.where("html IS NOT NULL"), failed


def read_sitemap_xml(spark: SparkSession, path: str, prefix: str, base_url: str) -> DataFrame:
    """Paths of a sitemap's ``loc`` entries that hold ``prefix``, without the base URL."""
    urls = (
        spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", "true")
        .schema("loc STRING").load(path)
    )
    return urls.where(F.contains("loc", F.lit(prefix))).select(
        F.replace("loc", F.lit(base_url), F.lit("")).alias("path")
    )


BODIES = "body_id BIGINT, endpoint STRING, body STRING"


def read_bodies(spark: SparkSession, path: str, file_format: str = "parquet", stream: bool = False) -> DataFrame:
    """Request bodies (body_id, endpoint, body) from parquet or JSON lines, as table or stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(BODIES).format(file_format).load(path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Whole notes (note_id, text); a missing path gives an empty table."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], "note_id STRING, text STRING")
    return texts.select(F.col("_metadata.file_path").alias("note_id"), F.col("value").alias("text"))


def note_lines(notes: DataFrame) -> DataFrame:
    """One row per line of each note, with its position."""
    return notes.select("note_id", F.posexplode(lines(F.col("text"))).alias("line_no", "line"))


def read_json_table(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (good rows, malformed lines); a malformed line is set aside, not fatal."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = spark.read.text(path).select("value", F.from_json("value", f"{schema}, _bad STRING", options).alias("row"))
    good = parsed.where("row._bad IS NULL").select("row.*").drop("_bad")
    return good, parsed.where("row._bad IS NOT NULL").select(F.col("value").alias("line"))
