"""Join helpers that hold up when one key owns a large share of the rows.

A side is broadcast only after its rows and bytes were measured; beyond the bound the
join shuffles, with the hot keys of the large side spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.needles import find_needles

SALTS = 16
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(table: DataFrame) -> bool:
    """Count a table's rows and bytes: an aggregate with one row per partition to shuffle."""
    size = F.octet_length(F.to_json(F.struct(*table.columns)))
    measured = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return measured["rows"] <= BROADCAST_ROWS and measured["bytes"] <= BROADCAST_BYTES


def attach(facts: DataFrame, dimension: DataFrame, keys: list[str], spread: Column, how: str = "left",
           salts: int = SALTS) -> DataFrame:
    """Join facts to a dimension table made from the index.

    A dimension within the measured bound is broadcast and the facts stay where they are.
    A larger one is joined by shuffle: facts of a hot key are spread over ``salts`` tasks by
    a hash of ``spread`` and the dimension is repeated once per salt.
    """
    if fits_broadcast(dimension):
        return facts.join(F.broadcast(dimension), keys, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def substring_pairs(texts: DataFrame, text_col: str, needles: DataFrame, needle_col: str) -> DataFrame:
    """Rows of ``texts`` paired with every distinct non-empty needle their text contains, see ``find_needles``."""
    found = find_needles(texts, text_col, needles, needle_col)
    return found.withColumn("needle", F.explode("found.key")).drop("found")
