"""Session helpers: settings the jobs rely on, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# SQL settings the operators depend on for results, not only for speed.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # The last of two equal JSON keys wins, as most JSON readers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Pages are long strings, so Arrow batches are bounded by a small row count and by bytes.
SPEED_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in {**RESULT_CONF, **SPEED_CONF}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docweave")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = name_local_folder(tune(builder.getOrCreate()))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` or one set with ``setCheckpointDir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise RuntimeError("No shared folder: set spark.checkpoint.dir, or name one with setCheckpointDir")
    return folder.rstrip("/")


def name_local_folder(spark: SparkSession) -> SparkSession:
    """For tests and local runs: name a temporary folder where none is set. Never does so on a cluster."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and context.master.split("[")[0] == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docweave-shared-"))
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the cluster's shared folder so several branches can read it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder as parquet and read it back.

    Unlike a checkpoint it can be pruned by column, and its size is known to the optimizer.
    """
    spark = df.sparkSession
    target = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(target)
    table = spark.read.schema(df.schema).parquet(target)
    table._stored_in = target
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that was made of them is written itself."""
    for table in tables:
        folder = getattr(table, "_stored_in", None)
        if folder is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> SparkSession:
    """From now on delete a query's shuffle files when it ends, not when the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def spread_small(df: DataFrame) -> DataFrame:
    """Repartition an input with little to read for its work; leave a large one where it is.

    Python-heavy steps are bound by processor time, and a small table often is one file and
    so one task; a narrow one can hold millions of rows. It goes to a task per core, and to more where a task would
    get over ``SPREAD_ROWS`` rows. The check uses Spark's own size estimate and, below ``COUNTED_SHARE`` a core, a
    count of the rows, which reads no column of a stored table. Rows that are dealt out already stay as they are: do so
    before wide columns are computed, and only narrow rows move.
    """
    spark = df.sparkSession
    if df.isStreaming or not hasattr(df, "_jdf"):
        return df
    cores, plan = spark.sparkContext.defaultParallelism, df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size >= cores * COUNTED_SHARE or "Repartition" in plan.toString():
        return df
    tasks = max(cores, -(-df.count() // SPREAD_ROWS))
    return df.repartition(tasks) if size < tasks * SMALL_SHARE else df


# Below this many bytes a task an input is spread, and below that many a core its rows are counted for it.
SMALL_SHARE, COUNTED_SHARE = 16 * 1024 * 1024, 256 * 1024 * 1024
SPREAD_ROWS = 10_000
