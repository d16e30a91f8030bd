"""Streaming forms of cache refresh, body validation and conformance rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import cache, conformance
from docweave.schemas import CONTENT_CACHE
from docweave.streaming import log

LOG = f"{CONTENT_CACHE}, outcome STRING"


# ---------------------------------------------------------------- cache refresh


def _newest(rows: DataFrame) -> DataFrame:
    latest = rows.where("content IS NOT NULL").groupBy("path").agg(
        F.max_by(F.struct("content", "etag", "fetched_at"), "batch").alias("c")
    )
    return latest.select("path", "c.*")


def current_cache(spark: SparkSession, root: str, before: int | None = None,
                  paths: DataFrame | None = None) -> DataFrame:
    """State of the cache: per path the row of the latest batch.

    With ``before``, batches from that one on are left out; with ``paths(path)``, all others are,
    and only files of the parts these paths fall into are read (the numbers of these parts, 64 at most, are collected).
    """
    parts = None
    if paths is not None:
        parts = sorted(r[0] for r in paths.select(log.part_of()).distinct().collect())
    rows = log.read(spark, root, LOG, before, parts)
    if rows is None:
        return spark.createDataFrame([], CONTENT_CACHE)
    if paths is not None:
        rows = rows.join(paths, "path", "left_semi")
    return _newest(rows)


def compact_cache(spark: SparkSession, root: str, upto: int) -> None:
    """Fold all batches up to and including ``upto`` into one run."""
    rows = log.read(spark, root, LOG, upto + 1)
    if upto > 0 and rows is not None:
        _fold_run(rows, root, (0, upto))


def _fold_run(rows: DataFrame, root: str, span: log.Span) -> None:
    log.write_run(_newest(rows).withColumn("outcome", F.lit("kept")), root, span)


def apply_batch(fetched: DataFrame, batch_id: int, root: str, ttl: int = cache.PAGE_TTL) -> None:
    """Merge one micro-batch of resolved fetches (path, kind, body, etag, ts) into the cache.

    Only paths of the batch are merged and only their new rows are written, into a folder
    named by the batch, so a repeated batch overwrites itself. Of what is stored, only files of the parts
    of these paths are read. The fetches of a path are folded in
    order of time (``cache.refreshed``), so the state is the same however a log is cut into
    batches. Rows that leave an entry as it was carry no content. Every 8th, 64th, … batch folds
    the ones before it into a run (``streaming.log``).
    """
    spark = fetched.sparkSession
    paths = cache.keyed(fetched).where("path IS NOT NULL").select("path").distinct()
    rows = cache.refreshed(current_cache(spark, root, before=batch_id, paths=paths), fetched, ttl)
    changed = F.col("outcome").isin("replaced", "revalidated") | (F.col("content").isNotNull() & (F.col("outcome") != "fresh"))
    log.write_batch(rows.withColumn("content", F.when(changed, F.col("content"))), root, batch_id)
    for span in log.finished_spans(batch_id):
        held = log.read(spark, root, LOG, span[1] + 1, first=span[0])
        if held is not None:
            _fold_run(held, root, span)


def cache_refresh_stream(fetched: DataFrame, root: str, checkpoint: str, ttl: int = cache.PAGE_TTL):
    """Start the refresh: every micro-batch of fetch results is merged into the cache log."""
    return (
        fetched.writeStream.foreachBatch(lambda df, batch_id: apply_batch(df, batch_id, root, ttl))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# ---------------------------------------------------------------- validation


def validate_stream(bodies: DataFrame, endpoints: DataFrame, schemas: DataFrame, rules: DataFrame) -> DataFrame:
    """Issues of a stream of bodies: stream-static joins only, no state, same rows as in batch."""
    return conformance.validate(bodies, endpoints, schemas, rules)


def dead_letters(bodies: DataFrame) -> DataFrame:
    """Bodies that are not JSON or not an object, with the reason."""
    parsed = conformance.parse_bodies(bodies)
    reason = F.when(F.col("json").isNull(), "invalid_json").when(~F.col("is_object"), "not_object")
    return parsed.withColumn("reason", reason).where("reason IS NOT NULL").drop("json", "is_object")


def conformance_windows(checked: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Share of failing bodies per endpoint and tumbling window.

    ``checked(ts, endpoint, ok)``; works on tables and streams, late rows beyond the
    watermark are dropped by the stream only.
    """
    counted = checked.withWatermark("ts", late).groupBy(F.window("ts", width), "endpoint").agg(
        F.count("*").alias("bodies"), F.count_if(~F.col("ok")).alias("failed")
    )
    return counted.select(
        F.col("window.start").alias("window_start"), "endpoint", "bodies", "failed",
        (F.col("failed") / F.col("bodies")).alias("error_rate"),
    )


def run_once(stream: DataFrame, target: str, mode: str = "append") -> DataFrame:
    """Drain what a stream has into parquet under ``target`` and read it back."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{target}/rows")
        .option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{target}/rows")
