"""Gates, summaries and comparisons of index snapshots."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.schemas import INDEX_VERSION

# Share of failed pages that makes an index incomplete, least rows per table,
# shown errors, and the order in which index copies are preferred.
FAILURE_SHARE = 0.25
FLOORS = {"endpoints": 10, "error_codes": 20, "status_codes": 8, "schemas": 5}
SHOWN_ERRORS = 20
TIERS = ("user-local", "remote", "baseline")


def index_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, n, deprecated): row counts per entity table; deprecated counts endpoints only."""
    parts = []
    for name, table in tables.items():
        flagged = F.count_if("deprecated") if name == "endpoints" else F.lit(0).cast("bigint")
        parts.append(table.agg(
            F.lit(name).alias("entity"), F.count("*").alias("n"), flagged.alias("deprecated")
        ))
    return reduce(DataFrame.unionByName, parts)


def first_errors(parse_errors: DataFrame, limit: int = SHOWN_ERRORS) -> DataFrame:
    return parse_errors.orderBy("path", "error").limit(limit)


def failure_rate_gate(parse_errors: DataFrame, sitemap_size: DataFrame, share: float = FAILURE_SHARE,
                      abort: bool = False) -> DataFrame:
    """(errors, pages, rate, incomplete); ``sitemap_size`` is a one-row table with column ``pages``.

    With ``abort`` the job fails on an incomplete index. The counts are reduced to one row
    before anything is raised.
    """
    counted = parse_errors.agg(F.count("*").alias("errors"), F.lit(0).cast("bigint").alias("pages"))
    sized = sitemap_size.select(F.lit(0).cast("bigint").alias("errors"), F.col("pages").cast("bigint"))
    both = counted.unionByName(sized).agg(F.sum("errors").alias("errors"), F.sum("pages").alias("pages"))
    rate = F.col("errors") / F.greatest("pages", F.lit(1))
    gated = both.select("errors", "pages", rate.alias("rate"), (rate >= share).alias("incomplete"))
    if not abort:
        return gated
    stop = F.raise_error(F.concat(
        F.lit("index incomplete: "), F.col("errors").cast("string"), F.lit(" of "), F.col("pages").cast("string"),
        F.lit(" pages failed"),
    ))
    return gated.withColumn("incomplete", F.when(~F.col("incomplete"), F.lit(False)).otherwise(stop.cast("boolean")))


def structural_floors(counts: DataFrame, floors: dict[str, int] | None = None,
                      schema_version: Column | None = None) -> DataFrame:
    """(entity, n, floor, ok) per required table; ``counts(entity, n)`` lacking a table fails it."""
    spark = counts.sparkSession
    least = spark.createDataFrame(list((floors or FLOORS).items()), "entity STRING, floor BIGINT")
    right_version = F.lit(True) if schema_version is None else schema_version == INDEX_VERSION
    return least.join(counts.select("entity", "n"), "entity", "left").select(
        "entity", "n", "floor",
        (F.coalesce(F.col("n") >= F.col("floor"), F.lit(False)) & right_version).alias("ok"),
    )


def accept_snapshot(checked: DataFrame) -> DataFrame:
    """One row: does the new snapshot pass all floors, so that it may replace the old one."""
    return checked.agg(F.bool_and("ok").alias("accepted"))


def resolve_tier(candidates: DataFrame, schema_version: int = INDEX_VERSION, need_rows: bool = False) -> DataFrame:
    """First usable copy by tier from candidates(name, tier, schema_version, rows): one row per name.

    Absent copies have a null version. For catalogs an empty copy falls through as well.
    """
    usable = candidates.where(F.col("schema_version") == schema_version)
    if need_rows:
        usable = usable.where("rows > 0")
    priority = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    return usable.where(priority > 0).groupBy("name").agg(
        F.min_by(F.struct("tier", "rows"), priority).alias("c")
    ).select("name", F.col("c.tier").alias("source"), F.col("c.rows").alias("rows"))


def freshness(table: DataFrame, now: datetime.datetime, built_at: str = "built_at") -> DataFrame:
    """Add ``age_seconds`` and ``age``: whole hours below two days, else whole days."""
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(built_at).cast("timestamp"))
    hours = micros / 3_600_000_000
    shown = F.when(
        hours < 48, F.concat(F.bround(hours, 0).cast("bigint").cast("string"), F.lit("h old"))
    ).otherwise(F.concat(F.bround(hours / 24, 0).cast("bigint").cast("string"), F.lit("d old")))
    return table.withColumns({"age_seconds": micros / 1_000_000, "age": shown})


def diff_snapshots(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): added, removed or changed keys; nothing for equal ones.

    Both sides are reduced per key to a row count and an order-free signature in one
    aggregate, so repeated and skewed keys combine before the shuffle.
    """
    values = sorted(c for c in new.columns if c not in keys)

    def signed(side: DataFrame, is_new: bool) -> DataFrame:
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        # Nested values are compared by their JSON text, which tells null from absent.
        row_hash = F.xxhash64(F.to_json(F.struct(*[F.col(v) for v in values]), {"ignoreNullFields": "false"}))
        return side.select(
            *keys, (none if is_new else one).alias("o"), (one if is_new else none).alias("n"),
            row_hash.cast("decimal(38,0)").alias("h"),
        )

    both = signed(old, False).unionByName(signed(new, True))
    sums = both.groupBy(*keys).agg(
        F.sum("o").alias("o"), F.sum("n").alias("n"), F.sum(F.col("h") * (F.col("n") - F.col("o"))).alias("d")
    )
    change = (
        F.when(F.col("o") == 0, "added").when(F.col("n") == 0, "removed")
        .when((F.col("o") != F.col("n")) | (F.col("d") != 0), "changed")
    )
    return sums.select(*keys, change.alias("change")).where("change IS NOT NULL")
