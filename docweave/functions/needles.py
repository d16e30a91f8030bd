"""Which of many needles occur in which texts: one pass over each text by an automaton of the needles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

# Needles of one automaton, which takes about a hundred bytes a character, and text held by one group beyond that.
NEEDLE_ROWS = 200_000
NEEDLE_CHARS = 2_000_000
TEXT_BYTES = 32 * 1024 * 1024


class Finder:
    """Automaton of distinct non-empty needles, each with a key."""

    def __init__(self, needles: list[str], keys: list, kind: pa.ListType):
        import ahocorasick

        self.keys, self.sizes = pa.array(keys, kind.value_type[0].type), [len(n) for n in needles]
        self.automaton = ahocorasick.Automaton()
        for number, needle in enumerate(needles):
            self.automaton.add_word(needle, number)
        if needles:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> dict[int, int]:
        """Numbers of the needles in a text with their occurrences that do not overlap, as replacing from the left counts them."""
        if not text or not self.sizes:
            return {}
        times: dict[int, int] = {}
        free: dict[int, int] = {}
        for end, number in self.automaton.iter(text):
            if end - self.sizes[number] >= free.get(number, -1):
                times[number] = times.get(number, 0) + 1
                free[number] = end
        return times


_built: dict[str, Finder] = {}


def _finder(name: str, given: Broadcast, kind: pa.ListType) -> Finder:
    """One automaton per worker process and search; that of an earlier search is let go."""
    if name not in _built:
        _built.clear()
        _built[name] = Finder(*given.value, kind)
    return _built[name]


def _searched(table: pa.Table | pa.RecordBatch, text_col: str, finder: Finder, kind: pa.ListType) -> pa.Table:
    """Rows whose text holds a needle, with what was found."""
    rows, ends, numbers, times = [], [0], [], []
    for row, text in enumerate(table.column(text_col).to_pylist()):
        found = finder(text)
        if found:
            rows.append(row)
            numbers.extend(found)
            times.extend(found.values())
            ends.append(len(numbers))
    keys = finder.keys.take(pa.array(numbers, pa.int64()))
    items = pa.StructArray.from_arrays([keys, pa.array(times, pa.int32())], fields=list(kind.value_type))
    table = pa.table(table.columns, names=table.schema.names).take(pa.array(rows, pa.int64()))
    return table.append_column("found", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, type=kind))


def find_needles(texts: DataFrame, text_col: str, needles: DataFrame, needle_col: str, key_col: str | None = None) -> DataFrame:
    """Rows of ``texts`` whose text holds a needle, plus ``found``: an array of (key, times).

    ``key`` is the needle or, with ``key_col``, another column of ``needles``, whose needles are then distinct;
    ``times`` counts occurrences that do not overlap. The work is linear in the texts and in the matches, whatever the
    needles' lengths. Needles are counted first. Within the bound of one automaton they go
    to all tasks and texts stay where they are. Beyond it they are dealt to blocks by their hash; every block meets
    every part of the texts in a task of its own, and a text has a row for each block that finds something.
    Null texts and null or empty needles match nothing.
    """
    key_col = key_col or needle_col
    wanted = needles.select(F.col(needle_col).alias("needle"), F.col(key_col).alias("key")).where("needle <> ''").distinct()
    size = wanted.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["rows"] // NEEDLE_ROWS), -(-size["chars"] // NEEDLE_CHARS))
    key_type = wanted.schema["key"].dataType
    item = ArrayType(StructType([StructField("key", key_type), StructField("times", IntegerType())]))
    kind = to_arrow_type(item)
    schema = StructType([*texts.schema.fields, StructField("found", item)])
    if blocks == 1:
        name, rows = uuid.uuid4().hex, wanted.collect()
        shared = texts.sparkSession.sparkContext.broadcast(([r["needle"] for r in rows], [r["key"] for r in rows]))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _finder(name, shared, kind)
            for batch in batches:
                yield from _searched(batch, text_col, finder, kind).to_batches()

        return texts.mapInArrow(search, schema)

    bytes_ = texts.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    chunks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-bytes_ // TEXT_BYTES))

    def every(number: int):
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    # Parts are dealt by row, so equal texts are spread as well.
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    left = texts.withColumn("_chunk", part).withColumn("_block", every(blocks))
    right = wanted.withColumn("_block", F.pmod(F.xxhash64("needle"), F.lit(blocks)).cast("int")).withColumn("_chunk", every(chunks))

    def meet(rows: pa.Table, own: pa.Table) -> pa.Table:
        finder = Finder(own["needle"].to_pylist(), own["key"].to_pylist(), kind)
        return _searched(rows.select(schema.fieldNames()[:-1]), text_col, finder, kind)

    return left.groupBy("_block", "_chunk").cogroup(right.groupBy("_block", "_chunk")).applyInArrow(meet, schema)
