"""Topic notes written in Markdown: one topic per second-level heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.joins import attach
from docweave.functions.text import LINE_END, strip

TOPIC_LINE = r"(?md)^## ([^\n]*)(?:\n|\z)"


def topic_key(text: Column) -> Column:
    """Lower-case letters and digits only, so punctuation and case do not matter."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def split_topics(notes: DataFrame) -> DataFrame:
    """``notes(note_id, text)`` to (note_id, ord, topic, topic_key, body).

    A body runs to the next second-level heading; text above the first one is ignored and
    other headings and rules are content. A note is one row, so nothing is shuffled.
    """
    text = F.regexp_replace("text", LINE_END, "\n")
    prepared = notes.select("note_id", text.alias("text"))
    heads = F.regexp_extract_all(F.col("text"), F.lit(TOPIC_LINE), F.lit(1))
    bodies = F.split("text", TOPIC_LINE, -1)
    zipped = F.arrays_zip(heads.alias("head"), F.slice(bodies, 2, F.size(bodies)).alias("body"))
    return (
        prepared.select("note_id", F.posexplode(zipped).alias("ord", "z"))
        .select(
            "note_id", "ord", strip(F.col("z.head")).alias("topic"), topic_key(F.col("z.head")).alias("topic_key"),
            F.trim(F.col("z.body"), F.lit("\n")).alias("body"),
        )
    )


def list_topics(topics: DataFrame) -> DataFrame:
    """Topic headings in file order."""
    return topics.select("note_id", "ord", "topic").orderBy("note_id", "ord")


def lookup_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """Body of the first topic with the requested key; a blank body counts as not found."""
    first = topics.groupBy("topic_key").agg(F.min_by("body", F.struct("note_id", "ord")).alias("body"))
    asked = requests.select(F.col("topic").alias("requested"), topic_key(F.col("topic")).alias("topic_key"))
    # Requests may repeat one topic any number of times.
    joined = attach(asked, first, ["topic_key"], F.monotonically_increasing_id())
    body = F.nullif("body", F.lit(""))
    return joined.select("requested", "topic_key", body.alias("body"), body.isNotNull().alias("found"))


def missed_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """Requests no topic with a body answers."""
    return lookup_topics(requests, topics).where("NOT found").select("requested")
