"""A keyed log in levels: batches divided by a hash of the path, folded into ever longer runs.

Layout under ``root``: ``batch=N/part=P`` holds the rows of one batch, ``runs/first=A/last=B/part=P`` the
newest row per path of batches A to B, and ``done/first=A/last=B`` marks a run as whole. Runs of
``FANOUT ** k`` batches are made when their last batch is there, from the runs one level below, so a row is
rewritten once per level and the state up to any batch is covered by a few runs per level. An unmarked run
is never read; what it would hold is read from the level below. Files that a run took in stay in place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the layout: parts a batch is divided into, and runs that make one of the next level.
PARTS = 64
FANOUT = 8

Span = tuple[int, int]


def part_of(path: str = "path") -> Column:
    return F.pmod(F.hash(path), F.lit(PARTS))


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    files, path = _path(spark, pattern)
    return [found.getPath().toString() for found in files.globStatus(path) or []]


def _mark(root: str, span: Span) -> str:
    return f"{root}/done/first={span[0]}/last={span[1]}"


def _run(root: str, span: Span) -> str:
    return f"{root}/runs/first={span[0]}/last={span[1]}"


def _is_marked(spark: SparkSession, root: str, span: Span) -> bool:
    files, path = _path(spark, _mark(root, span))
    return files.exists(path)


def _numbers(spark: SparkSession, pattern: str) -> list[int]:
    return [int(name.rsplit("=", 1)[1]) for name in _matches(spark, pattern)]


def spans(first: int, end: int) -> Iterator[Span]:
    """Batches ``first`` up to, not including, ``end`` as aligned spans, each as long as it can be."""
    while first < end:
        size = 1
        while first % (size * FANOUT) == 0 and first + size * FANOUT <= end:
            size *= FANOUT
        yield first, first + size - 1
        first += size


def _readable(spark: SparkSession, root: str, span: Span) -> Iterator[Span]:
    first, last = span
    if first == last or _is_marked(spark, root, span):
        yield span
        return
    step = (last - first + 1) // FANOUT
    for start in range(first, last + 1, step):
        yield from _readable(spark, root, (start, start + step - 1))


def cover(spark: SparkSession, root: str, end: int, first: int = 0) -> list[Span]:
    """The whole runs and single batches that hold the batches from ``first`` up to, not including, ``end``."""
    bases = [last for last in _numbers(spark, f"{root}/done/first={first}/last=*") if last < end]
    base = [(first, max(bases))] if bases else []
    rest = spans(base[0][1] + 1 if base else first, end)
    return base + [found for span in rest for found in _readable(spark, root, span)]


def read(spark: SparkSession, root: str, schema: str, before: int | None = None,
         parts: list[int] | None = None, first: int = 0) -> DataFrame | None:
    """Rows with ``batch``, the last batch of a run for rows of a run; None if there are no files.

    Batches before ``first`` and from ``before`` on are left out, and so are the files of parts other than ``parts``.
    """
    end = before if before is not None else max(_numbers(spark, f"{root}/batch=*"), default=-1) + 1
    wanted = "*" if parts is None else "{" + ",".join(map(str, parts)) + "}"
    found = cover(spark, root, end, first)
    singles = [name for a, b in found if a == b for name in _matches(spark, f"{root}/batch={a}/part={wanted}")]
    runs = [name for a, b in found if a < b for name in _matches(spark, f"{_run(root, (a, b))}/part={wanted}")]
    tables = []
    if singles:
        table = spark.read.schema(f"{schema}, batch BIGINT, part INT").option("basePath", root).parquet(*singles)
        tables.append(table.drop("part"))
    if runs:
        table = spark.read.schema(f"{schema}, first BIGINT, last BIGINT, part INT").option("basePath", f"{root}/runs").parquet(*runs)
        tables.append(table.drop("part", "first").withColumnRenamed("last", "batch"))
    return None if not tables else tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])


def _write(rows: DataFrame, target: str) -> None:
    # Rebalanced by part: small parts become one file each, large ones are split by size.
    divided = rows.withColumn("part", part_of()).hint("rebalance", F.col("part"))
    divided.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(target)


def write_batch(rows: DataFrame, root: str, batch: int) -> None:
    """Write the rows of a batch; a repeated batch overwrites itself."""
    _write(rows, f"{root}/batch={batch}")


def write_run(rows: DataFrame, root: str, span: Span) -> None:
    """Write a run and then its mark; a marked one stays as it is."""
    spark = rows.sparkSession
    if _is_marked(spark, root, span):
        return
    _write(rows, _run(root, span))
    files, mark = _path(spark, _mark(root, span))
    files.create(mark, True).close()


def finished_spans(batch: int) -> Iterator[Span]:
    """Spans longer than one batch that end with ``batch``, shortest first."""
    size = FANOUT
    while (batch + 1) % size == 0:
        yield batch + 1 - size, batch
        size *= FANOUT
