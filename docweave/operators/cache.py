"""The content cache as a table keyed by canonical path. The current time is a parameter."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import canonical_path

# How long pages and remote index copies stay fresh, in seconds.
PAGE_TTL = 24 * 3600
REMOTE_TTL = 12 * 3600

# Kinds of rows in the fold of a path, in the order in which they count at the same time.
ENTRY, SUCCESS, UNCHANGED, FAILURE = range(4)


def _age(now: datetime.datetime, fetched_at: Column) -> Column:
    return F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(fetched_at)


def is_fresh(now: datetime.datetime, ttl: int = PAGE_TTL, fetched_at: str = "fetched_at") -> Column:
    """Strictly younger than the time to live."""
    return _age(now, F.col(fetched_at).cast("timestamp")) < F.lit(ttl * 1_000_000)


def classify_fresh(cache: DataFrame, now: datetime.datetime, ttl: int = PAGE_TTL,
                   fetched_at: str = "fetched_at") -> DataFrame:
    return cache.withColumn("fresh", is_fresh(now, ttl, fetched_at))


def keyed(table: DataFrame) -> DataFrame:
    return table.withColumn("path", canonical_path(F.col("path")))


def _fold(batches: Iterator[pa.RecordBatch], ttl: int) -> Iterator[pa.RecordBatch]:
    """Fold rows (path, at, kind, fresh, filled), sorted by path, kind = entry first and time; one row per path."""
    path, known = None, False
    filled, at, body_at, blocked, outcome = False, None, None, None, None

    def result() -> tuple:
        rest = "fresh" if blocked else "stale" if filled else "error"
        return path, at, body_at, outcome or rest

    for batch in batches:
        done = []
        for key, ts, kind, fresh, full in zip(*(c.to_pylist() for c in batch.columns)):
            if not known or key != path:
                if known:
                    done.append(result())
                path, known = key, True
                filled, at, body_at, blocked, outcome = False, None, None, None, None
            if kind == ENTRY:
                filled, at, blocked = full, ts, fresh and full
                continue
            young = at is not None and (ts < at if blocked is False and outcome is None else ts - at < ttl)
            if filled and (blocked or young):
                outcome = outcome or "fresh"
            elif kind == SUCCESS:
                filled, at, body_at, outcome = True, ts, ts, "replaced"
            elif filled and kind == UNCHANGED:
                at, outcome = ts, "revalidated"
            else:
                outcome = "stale" if filled else "error"
        yield _folded(done)
    if known:
        yield _folded([result()])


def _folded(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "at", "body_at", "outcome"])


def refreshed(cache: DataFrame, fetched: DataFrame, ttl: int = PAGE_TTL, now: datetime.datetime | None = None) -> DataFrame:
    """The cache after resolved fetches (path, kind, body, etag, ts), applied per path in order of ``ts``.

    A fetch changes nothing while the entry is fresh at its time, or if it is older than the entry. A
    success replaces content, etag and time; 304 renews the time of an entry; anything else, a
    success without a body too, leaves it, or makes an error row where there is none. ``outcome``
    names what the last fetch did that did not meet a fresh entry. With ``now`` the freshness of
    stored entries is judged at that time instead of the fetch's. At the same time successes come
    first (of several the largest body), then 304s. Rows without a path are left out.

    The result does not depend on how a log in order of time is cut into batches. Only path, time and
    kind are sorted, with one failure per path (only the last can matter), and streamed through
    the task of their path, which holds one row; contents join the one success that counts.
    """
    old, new = keyed(cache).where("path IS NOT NULL"), keyed(fetched).where("path IS NOT NULL AND ts IS NOT NULL")
    fresh = F.lit(None).cast("boolean") if now is None else F.coalesce(is_fresh(now, ttl), F.lit(False))
    entries = old.select(
        "path", F.unix_micros("fetched_at").alias("at"), F.lit(ENTRY).alias("kind"), fresh.alias("fresh"),
        F.col("content").isNotNull().alias("filled"))
    kind = (
        F.when((F.col("kind") == "ok") & F.col("body").isNotNull(), SUCCESS)
        .when(F.col("kind") == "not_modified", UNCHANGED)
        .otherwise(FAILURE)
    )
    events = new.select("path", F.unix_micros("ts").alias("at"), kind.alias("kind"))
    events = events.groupBy("path", "kind", F.when(F.col("kind") != FAILURE, F.col("at")).alias("own")).agg(F.max("at").alias("at"))
    rows = entries.unionByName(events.drop("own"), allowMissingColumns=True).withColumn("later", F.col("kind") != ENTRY)
    rows = rows.repartition("path").sortWithinPartitions("path", "later", "at", "kind").drop("later")
    limit = ttl * 1_000_000
    folded = rows.mapInArrow(lambda batches: _fold(batches, limit), "path string, at bigint, body_at bigint, outcome string")
    bodies = new.where(kind == SUCCESS).select("path", F.unix_micros("ts").alias("body_at"), "body", F.col("etag").alias("new_etag"))
    bodies = bodies.join(folded.where("body_at IS NOT NULL").select("path", "body_at"), ["path", "body_at"])
    bodies = bodies.groupBy("path").agg(F.max(F.struct("body", "new_etag")).alias("new"))
    replaced = F.col("body_at").isNotNull()
    both = folded.join(old.select("path", "content", "etag"), "path", "left").join(bodies, "path", "left")
    return both.select(
        "path",
        F.when(replaced, F.col("new.body")).otherwise(F.col("content")).alias("content"),
        F.when(replaced, F.col("new.new_etag")).otherwise(F.col("etag")).alias("etag"),
        F.timestamp_micros("at").alias("fetched_at"), "outcome",
    )


def refresh_merge(cache: DataFrame, fetched: DataFrame, now: datetime.datetime, ttl: int = PAGE_TTL) -> DataFrame:
    """Cache joined with a batch of resolved fetches, see ``refreshed``; entries fresh at ``now`` stay as they are."""
    return refreshed(cache, fetched, ttl, now)


def warm_diff(cache: DataFrame, batch: DataFrame) -> DataFrame:
    """Counts of new or changed, unchanged and failed pages of batch(path, content, error)."""
    old = keyed(cache).select("path", F.col("content").alias("_old"))
    kind = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("content").eqNullSafe(F.col("_old")), "unchanged")
        .otherwise("fetched")
    )
    return keyed(batch).join(old, "path", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("pages"))


def put_many(cache: DataFrame, batch: DataFrame, now: datetime.datetime) -> DataFrame:
    """Insert or replace batch(path, seq, content); the last ``seq`` per path wins and the etag is reset."""
    newest = keyed(batch).groupBy("path").agg(F.max_by("content", "seq").alias("content")).select(
        "path", "content", F.lit(None).cast("string").alias("etag"),
        F.lit(now).cast("timestamp").alias("fetched_at"),
    )
    kept = keyed(cache).join(newest.select("path"), "path", "left_anti")
    return kept.select("path", "content", "etag", "fetched_at").unionByName(newest)


def invalidate(cache: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Drop the given paths, or everything when none are given."""
    if paths is None:
        return cache.limit(0)
    return keyed(cache).join(keyed(paths.select("path")), "path", "left_anti")


def cache_stats(cache: DataFrame, now: datetime.datetime, ttl: int = PAGE_TTL,
                fetched_at: str = "fetched_at") -> DataFrame:
    """total, fresh, stale, ttl_seconds and the oldest age in seconds."""
    fresh = is_fresh(now, ttl, fetched_at)
    oldest = F.max(_age(now, F.col(fetched_at).cast("timestamp"))) / 1_000_000
    return cache.agg(
        F.count("*").alias("total"), F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("stale"),
        F.lit(ttl).alias("ttl_seconds"), F.coalesce(oldest, F.lit(0.0)).alias("oldest_age_seconds"),
    )
