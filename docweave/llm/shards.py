"""Sharding by jump consistent hashing, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.expr import let
from docweave.llm.common import numbered
from docweave.session import stored

# Fixed values of the published algorithm: the multiplier of its generator and the modulus of its state.
MULTIPLIER = "2862933555777941757"
STATES = "18446744073709551616"
SHORT = 48


def jump(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key among ``shards``: Lamping and Veach's jump consistent hash.

    The state of the generator is an unsigned 64-bit number and so a decimal here. The last jump
    that stays below ``shards`` names the shard; jumps grow, so ``shards`` of them always do. All
    but a vanishing share of keys are through after ``SHORT``; only those go on to the full number.
    A null key is taken as 0.
    """
    state = F.pmod(F.coalesce(key, F.lit(0)).cast("decimal(38,0)"), F.lit(STATES).cast("decimal(38,0)")).cast("decimal(20,0)")

    def step(s: Column, _: Column) -> Column:
        grown = s["state"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
        moved = F.pmod(grown, F.lit(STATES).cast("decimal(38,0)")).cast("decimal(20,0)")
        # The upper 31 bits of the new state, plus one, over 2^31 is the share of keys that stay.
        bits = F.floor(moved / F.lit(2 ** 33).cast("decimal(10,0)")).cast("double")
        jumped = F.floor((s["next"] + F.lit(1)).cast("double") * (F.lit(float(2 ** 31)) / (bits + F.lit(1.0)))).cast("long")
        after = F.struct(moved.alias("state"), s["next"].alias("shard"), jumped.alias("next"))
        return F.when(s["next"] < F.lit(shards), after).otherwise(s)

    def run(start: Column, times: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, step)

    start = F.struct(state.alias("state"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    first = run(start, min(SHORT, shards))
    return let(first, lambda s: F.when(s["next"] >= F.lit(shards), s["shard"]).otherwise(run(s, shards)["shard"])).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id") -> DataFrame:
    """Deal all documents into ``shards`` by their key alone, and number the rows of each shard from 0.

    Returns the key, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32, law, shard,
    slot (in order of key, ties in any order) and grown_shard, the shard once one more is
    appended: the same or the new one. Rows of one key share a shard, also when repeated; a null
    key goes with key 0. Only keys, sizes and checksums are shuffled, never texts; the two output
    steps of ``numbered`` read a small stored table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    dealt = docs.select(
        F.col(key), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), jump(F.col(key), shards).alias("shard"), jump(F.col(key), shards + 1).alias("grown_shard"),
    )
    return numbered(stored(dealt), F.col("shard"), [key], "slot")
