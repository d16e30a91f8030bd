"""Cache refresh with keyed state: one entry per path in the state store, which expires on its own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docweave.operators import cache

CHANGES = "path string, outcome string, content string, etag string, digest string, at bigint"
ENTRY = "at bigint, etag string, digest string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PathEntry(StatefulProcessor):
    """Folds the fetches of a path into its entry: time, etag and digest of the content, which is not kept itself."""

    def __init__(self, ttl: int, keep_ms: int | None):
        self.limit, self.keep_ms = ttl * 1_000_000, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", ENTRY, ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # A fetch is told by its time, then its kind, then, among successes, the largest body.
        ordered = sorted(((r.at, r.rank, r.body or "", r) for r in rows), key=lambda f: (f[0], f[1]))
        entry = self.entry.get()  # None without one; asking first would cost every path one more trip to the store
        outcome, content, touched = None, None, False
        k = 0
        while k < len(ordered):
            at, rank, _, row = ordered[k]
            while k + 1 < len(ordered) and ordered[k + 1][:2] == (at, rank):
                k += 1
                row = max(row, ordered[k][3], key=lambda r: (r.body or "", r.etag or ""))
            k += 1
            if entry and at - entry[0] < self.limit:
                outcome = outcome or "fresh"
            elif rank == cache.SUCCESS:
                entry, content, outcome, touched = (at, row.etag, row.digest), row.body, "replaced", True
            elif entry and rank == cache.UNCHANGED:
                entry, outcome, touched = (at, *entry[1:]), "revalidated", True
            else:
                outcome = "stale" if entry else "error"
        if touched:
            self.entry.update(entry)
        at, etag, digest = entry or (None, None, None)
        yield Row(path=key[0], outcome=outcome, content=content, etag=etag, digest=digest, at=at)

    def close(self) -> None:
        pass


def keyed_changes(fetched: DataFrame, ttl: int = cache.PAGE_TTL, keep_ms: int | None = None) -> DataFrame:
    """Stream of what each micro-batch of fetches (path, kind, body, etag, ts) did to the entry of a path.

    The rules are those of ``cache.refreshed``: a fetch within ``ttl`` seconds of the entry, or older than it, changes nothing; a
    success replaces it, 304 renews its time, anything else leaves it. The state of a path is
    its time, etag and a digest, kept for ``keep_ms`` milliseconds after the last change (without: for good), so
    paths that are fetched no more leave the store by themselves. ``content`` is the new body where it was
    replaced in this batch, also if it was revalidated after. Rows without path or time are left out. A task holds the rows of one path
    of one micro-batch, which the source's trigger options bound.
    """
    known = cache.keyed(fetched).where("path IS NOT NULL AND ts IS NOT NULL")
    success = (F.col("kind") == "ok") & F.col("body").isNotNull()
    rank = F.when(success, cache.SUCCESS).when(F.col("kind") == "not_modified", cache.UNCHANGED).otherwise(cache.FAILURE)
    rows = known.select(
        "path", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), rank.alias("rank"), F.when(success, F.col("body")).alias("body"),
        "etag", F.when(success, F.sha2("body", 256)).alias("digest"))
    return rows.groupBy("path").transformWithState(PathEntry(ttl, keep_ms), CHANGES, "append", "processingTime" if keep_ms else "none")


def keyed_refresh_stream(fetched: DataFrame, root: str, checkpoint: str, ttl: int = cache.PAGE_TTL, keep_ms: int | None = None,
                         **trigger):
    """Start the refresh with keyed state; changes are appended to parquet under ``root``, each exactly once.

    ``trigger`` is that of the query. By default it drains what there is and ends; a query whose entries expire always finds another
    batch to run, so without a trigger it takes what there is in one batch. Keyed state with expiry needs the store
    on RocksDB, which is set for this query alone.
    """
    trigger = trigger or ({"once": True} if keep_ms else {"availableNow": True})
    spark = fetched.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return (
            keyed_changes(fetched, ttl, keep_ms).writeStream.format("parquet").outputMode("append").option("path", root)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start()
        )
    finally:
        spark.conf.set(PROVIDER, before)


def keyed_cache(spark: SparkSession, root: str) -> DataFrame:
    """Cache as the changes under ``root`` leave it: the last content of a path and the time of its last renewal.

    ``outcome`` names what the last fetch of a batch did, so a content may be new although the batch ended stale.
    """
    changes = spark.read.schema(CHANGES).parquet(root).where("at IS NOT NULL")
    replaced = F.when(F.col("content").isNotNull(), F.col("at"))
    last = changes.groupBy("path").agg(F.max_by(F.struct("content", "etag"), replaced).alias("c"), F.max("at").alias("at"))
    return last.select("path", "c.content", "c.etag", F.timestamp_micros("at").alias("fetched_at"))
