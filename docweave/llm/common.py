"""Registry, numbering and connected components shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.session import discard, name_local_folder, stored, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is SQL that gives the same rows."""

    def keep(run):
        def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(name_local_folder(tune(spark)), sf_dir)

        ready.__doc__ = run.__doc__
        QUERIES[name] = ready
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, group: Column, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in ``order``; no group needs to fit one task.

    ``group`` must have few distinct values (shards, lengths). Rows are range-partitioned by
    group, order and their place in the input, so that even a third of equal rows is split
    evenly, and written with their partition. A group lies in consecutive partitions, so the
    table of starts has at most groups + partitions rows, which is what makes it broadcastable.
    Ties in ``order`` are numbered in any order. ``rows`` should be stored: it is read twice.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_group", group).withColumn("_place", F.monotonically_increasing_id())
    keys = ["_group", *order, "_place"]
    laid = keyed.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    laid = stored(laid.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("_group", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    starts = starts.select(
        F.col("_group").alias("_g"), F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))
    return laid.join(F.broadcast(starts), same).withColumn(name, F.col("_at") + F.col("_shift")).drop(
        "_group", "_place", "_part", "_at", "_g", "_p", "_shift")


# Bits of the largest bitmap that is broadcast by ``asked``.
MOST_MARKS = 1 << 26


def asked(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with a column ``_asked``: true if ``on`` is in ``wanted``, and for few others.

    A bitmap of hashes is broadcast, with 16 to 32 bits a key and ``MOST_MARKS`` at most, so that rows nobody asks for
    need no shuffle; beyond that more others pass. A join must follow. ``wanted`` should be stored: it is read twice.
    """
    bits = min(MOST_MARKS, 1 << max(10, (16 * wanted.count()).bit_length()))
    spot = F.pmod(F.xxhash64(*on), F.lit(bits)).alias("_spot")
    marks = wanted.select(spot).groupBy(F.shiftright("_spot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, int(_spot & 63))")).alias("_marks"))
    met = rows.select("*", spot).join(F.broadcast(marks), F.shiftright("_spot", 6) == F.col("_word"), "left")
    return met.withColumn("_asked", F.expr("coalesce(bit_get(_marks, int(_spot & 63)) = 1, false)")).drop("_spot", "_word", "_marks")


def asked_only(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    return asked(rows, wanted, on).where("_asked").drop("_asked")


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of distinct edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node. ``nodes(node)`` are distinct longs, ``edges(a, b)`` join two of them.

    Alternates the large-star and small-star steps, in which every node sends its neighbours to
    the smallest node it sees; the edges end as stars in about log(diameter) rounds. Every step
    writes its edges to the shared folder. The smallest neighbour comes from a partial aggregate
    joined back to the edges, so that a node of very many edges is never gathered in one task.
    """
    a, b = F.col("a"), F.col("b")
    both = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    stars = stored(both.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    while True:
        ways = stars.union(stars.select(b.alias("a"), a.alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = ways.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large.where(a != b))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(lower, "a")
        small = kept.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        after = stored(small.union(lower.select("a", F.col("m").alias("b"))).distinct())
        same = _mark(after) == _mark(stars)
        discard(large, after if same else stars)
        if same:
            break
        stars = after
    return nodes.join(stars.select(a.alias("node"), b.alias("_least")), "node", "left").select(
        "node", F.coalesce("_least", "node").alias("component"))
