"""Registry and small helpers shared by the registered queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.session import name_local_folder, shared_folder, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query function; ``oracle`` is the SQL giving the same rows."""

    def keep(run):
        def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(name_local_folder(tune(spark)), sf_dir)

        tuned.__doc__ = run.__doc__
        QUERIES[name] = tuned
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for a query that writes, on the storage that driver and executors share."""
    return f"{shared_folder(spark)}/docweave-{uuid.uuid4().hex}"


def unescaped(sql: str) -> str:
    """SQL for the text of a piece of HTML: named references, also one cut off at the end."""
    for name, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        sql = f"regexp_replace({sql}, '&{name}(;|$)', '{char}', 'g')"
    return f"trim({sql})"
