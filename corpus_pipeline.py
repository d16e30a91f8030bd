"""A corpus pipeline of four stages: quality rules, line dedup, near-duplicate documents, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import lines, overlap, quality
from docweave.llm.common import asked
from docweave.llm.queries import pack_documents
from docweave.session import drop_shuffles, name_local_folder, shared_folder, stored, tune


def with_text(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` with a new text and, where there is one, its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return changed.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rejected documents go, failing lines go from the others."""
    judged = quality.judge(docs).where("kept")
    return with_text(docs, judged, "cleaned")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: lines like an earlier one go, and with them a document that had words and has none left.

    A document without words before, or with a null text, stays as it is.
    """
    drop_shuffles(spark)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    left = lines.dedup_lines(docs.withColumn("_worded", worded))
    return with_text(docs, left.where(~F.col("_worded") | worded), "text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near-duplicates one row stays, that of the smallest id; without an id only if none has one.

    Taken with shingles of five words and a similarity of 0.8, as stages on word shingles are.
    Documents without words are in no group and stay. Rows are numbered and stored, as ids may
    repeat or be null.
    """
    drop_shuffles(spark)
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = overlap.jaccard_groups(numbered, percent=80, width=5, row="_row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")).alias("least")
    first = groups.where("component is not null").groupBy("component").agg(least).select("least._row")
    later = stored(groups.where("component is not null").select("_row").join(first, "_row", "left_anti"))
    # Only rows that a bitmap of the later ones names are shuffled, with the few others it lets through.
    marked = asked(numbered, later, ["_row"])
    left = marked.where("_asked").join(later, "_row", "left_anti")
    return marked.where("not _asked").select(*docs.columns).union(left.select(*docs.columns))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: what is left, cut and packed into sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard_join", near_stage), ("best_fit_packing", pack_stage)]
# Merging, tokenising and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    name_local_folder(tune(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
