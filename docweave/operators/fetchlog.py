"""Reading a log of fetch attempts: what each attempt means and what each path ended up as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses worth another try, and how often to try.
TRANSIENT_STATUS = (408, 425, 429, 500, 502, 503, 504)


def classify(status: Column, error_kind: Column) -> Column:
    return (
        F.when(error_kind.isNotNull() | status.isin(*TRANSIENT_STATUS), "transient")
        .when(status == 304, "not_modified")
        .when(status == 404, "not_found")
        .when(status >= 400, "permanent")
        .when(status.isNotNull(), "ok")
        .otherwise("transient")
    )


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """Label each attempt ok, not_modified, not_found, transient or permanent."""
    return attempts.withColumn("kind", classify(F.col("status"), F.col("error_kind")))


def slash_variants(paths: DataFrame) -> DataFrame:
    """(path, variant_no, candidate): the path itself, then its trailing-slash sibling."""
    path = F.col("path")
    bare = F.rtrim(path, F.lit("/"))
    sibling = F.when(F.endswith(path, F.lit("/")), F.when(bare == "", F.lit("/")).otherwise(bare)).otherwise(
        F.concat(path, F.lit("/"))
    )
    return paths.select("path", F.posexplode(F.array(path, sibling)).alias("variant_no", "candidate"))


def resolve_fetch(attempts: DataFrame) -> DataFrame:
    """One row per path: the last try of the first variant, in order, that does not end in a 404, else of the last one.

    Every logged try and variant counts. Two aggregates with map-side combine find the ends of
    the variants and then of the paths; no group is ever sorted.
    """
    row = F.struct("variant_no", "attempt_no", "status", "error_kind", "etag", "body", "ts", "kind")
    labelled = classify_attempts(attempts)
    variants = labelled.groupBy("path", "variant_no").agg(F.max_by(row, F.col("attempt_no")).alias("end"))
    settled = F.when(F.col("end.kind") != "not_found", F.col("variant_no"))
    ends = variants.groupBy("path").agg(
        F.coalesce(F.min_by("end", settled), F.max_by("end", "variant_no")).alias("r")
    )
    return (
        ends.select("path", "r.*")
        .withColumn("ok", F.col("kind").isin("ok", "not_modified"))
    )


def sanity_filter(pages: DataFrame, markers: tuple[str, ...], text: str = "html") -> DataFrame:
    """Keep pages holding at least one marker, whatever the case."""
    test = F.lit(False)
    for marker in markers:
        test = test | F.contains(F.lower(text), F.lit(marker.lower()))
    return pages.where(test)


def split_results(resolved: DataFrame, markers: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Successes and per-path errors of a resolved batch.

    With ``markers``, a 2xx body without any of them is an error of kind ``suspicious``.
    """
    if markers:
        good = F.lit(False)
        for marker in markers:
            good = good | F.contains(F.lower("body"), F.lit(marker.lower()))
        bad_body = (F.col("kind") == "ok") & ~F.coalesce(good, F.lit(False))
        resolved = resolved.withColumn("kind", F.when(bad_body, "suspicious").otherwise(F.col("kind"))).withColumn(
            "ok", F.col("kind").isin("ok", "not_modified")
        )
    message = F.when(F.col("error_kind").isNotNull(), F.concat(F.lit("network error: "), "error_kind")).when(
        F.col("kind") == "suspicious", F.lit("content does not look like documentation")
    ).otherwise(F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    return resolved.where("ok"), resolved.where("NOT ok").select("path", "kind", message.alias("error"))


def batch_totals(resolved: DataFrame) -> DataFrame:
    return resolved.agg(
        F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed")
    )
