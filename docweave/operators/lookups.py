"""Filtered listings of the entity tables and joins between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.joins import attach, substring_pairs
from docweave.functions.text import contains_fold, path_parts
from docweave.operators import resolve
from docweave.session import stored

POSITION = ("page_ord", "tbl_ord", "row_ord")
SHOWN_ERRORS, SHOWN_MENTIONS, SHOWN_SUGGESTIONS = 20, 5, 5


# ---------------------------------------------------------------- listings


def _any_contains(query: str | None, *columns: str) -> Column:
    if not query:
        return F.lit(True)
    test = F.lit(False)
    for name in columns:
        test = test | contains_fold(F.col(name), query)
    return test


def list_error_codes(error_codes: DataFrame, query: str | None = None) -> DataFrame:
    """Codes whose code, reason or endpoint holds ``query``; codes sort as text."""
    return error_codes.where(_any_contains(query, "code", "reason", "endpoint")).orderBy(
        "code", F.coalesce("endpoint", F.lit("")), F.coalesce("docs_path", F.lit("")), *POSITION
    )


def list_status_codes(status_codes: DataFrame, query: str | None = None) -> DataFrame:
    """Codes whose code, description or resources hold ``query``."""
    return status_codes.where(_any_contains(query, "code", "description", "applicable_resources")).orderBy(
        "code", F.coalesce("docs_path", F.lit("")), *POSITION
    )


def list_schemas(schemas: DataFrame, resource_name: str | None = None) -> DataFrame:
    """Fields of the resources whose name holds ``resource_name``; requiredness in words."""
    needed = F.when(F.col("f.required"), "yes").when(~F.col("f.required"), "optional").otherwise("unspecified")
    return schemas.where(_any_contains(resource_name, "name")).select(
        "page_ord", "tbl_ord", F.col("name").alias("schema_name"), "docs_path",
        F.posexplode("fields").alias("field_ord", "f"),
    ).select(
        "page_ord", "tbl_ord", "schema_name", "docs_path", "field_ord", F.col("f.name").alias("field"), "f.type",
        needed.alias("required"), "f.description", "f.constraints", "f.deprecated",
    )


def endpoint_group(path: Column) -> Column:
    """Second path segment, else the first, else ``misc``."""
    parts = path_parts(path)
    return F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)), F.lit("misc"))


def list_endpoints(endpoints: DataFrame) -> DataFrame:
    """All endpoints grouped by resource area."""
    return endpoints.withColumn("area", endpoint_group(F.col("path"))).orderBy("area", "path", "method", *POSITION)


def examples_for_page(examples: DataFrame, requests: DataFrame) -> DataFrame:
    """Code examples for each requested (docs_path, language); a null language takes all."""
    wanted = requests.select("docs_path", F.lower("language").alias("wanted")).distinct()
    return examples.join(wanted, "docs_path").where(
        "wanted IS NULL OR wanted = '' OR coalesce(language, '') = wanted"
    )


# ---------------------------------------------------------------- errors of an endpoint


def _top(rows: DataFrame, key: str, order: list, limit: int) -> DataFrame:
    """First ``limit`` rows per key. The rank limit is applied before the shuffle as well."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def errors_for_endpoint(endpoints: DataFrame, error_codes: DataFrame, limit: int = SHOWN_ERRORS) -> DataFrame:
    """First ``limit`` error codes per endpoint with the number found.

    An endpoint takes the codes documented for exactly its ``METHOD path`` (any case). Only
    if there are none does it take those whose endpoint text holds its last path segment; an
    empty last segment is held by every text. Codes are counted and ranked per text or
    segment before they meet the endpoints, so a hot one never multiplies rows.
    """
    codes = error_codes.where("endpoint <> ''")
    asked = endpoints.select(
        *POSITION, "method", "path",
        F.lower(F.concat_ws(" ", "method", "path")).alias("line"),
        F.substring_index("path", "/", -1).alias("segment"),
    )
    by_line = _counted(codes.withColumn("line", F.lower("endpoint")), "line", limit)
    exact = asked.join(by_line, "line").withColumn("match", F.lit("exact"))

    lines = codes.select(F.lower("endpoint").alias("line")).distinct()
    rest = asked.join(lines, "line", "left_anti")
    needed = rest.select("segment").distinct()
    holders = substring_pairs(codes, "endpoint", needed, "segment").withColumnRenamed("needle", "segment")
    loose = rest.join(_counted(holders, "segment", limit), "segment")
    total = codes.agg(F.count("*")).scalar()
    first = _first_overall(codes.select("code", "reason", *POSITION), list(POSITION), ["code", "reason"], limit)
    every = _with_each(rest.where("segment = ''"), first).withColumn("found", total)
    loose = loose.unionByName(every).withColumn("match", F.lit("segment"))
    return exact.drop("line", "segment").unionByName(loose.drop("line", "segment"))


def _counted(codes: DataFrame, key: str, limit: int) -> DataFrame:
    order = [F.col(c) for c in POSITION]
    first = _top(codes.select(key, "code", "reason", *POSITION), key, order, limit)
    counts = codes.groupBy(key).agg(F.count("*").alias("found"))
    return first.drop(*POSITION).join(counts, key)


def _first_overall(rows: DataFrame, order: list[str], shown: list[str], limit: int) -> Column:
    """The first ``limit`` rows of a whole table as one small array, for use in another table."""
    first = rows.orderBy(*order).limit(limit)
    listed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*shown).alias("item"))))
    return first.agg(F.transform(listed, lambda r, i: F.struct((i + 1).alias("rank"), r["item"].alias("item")))).scalar()


def _with_each(rows: DataFrame, listed: Column) -> DataFrame:
    """Every row with each element of the array, as columns ``rank`` and the item's own."""
    return rows.withColumn("_listed", listed).select(*rows.columns, F.inline("_listed")).select(
        *rows.columns, "rank", "item.*"
    )


# ---------------------------------------------------------------- release notes that mention an endpoint


def release_mentions(endpoints: DataFrame, changes: DataFrame, limit: int = SHOWN_MENTIONS) -> DataFrame:
    """First ``limit`` releases mentioning an endpoint's path or title, with the number found.

    A release counts once, by its first change that holds the text (any case). An empty
    path or title is held by every change. Releases are counted and ranked per text, then per distinct pair
    of path and title, before they meet the endpoints: an endpoint gets its ``limit`` rows and no others. What a pair's
    texts have in common is found by going through the releases of the rarer one.
    """
    entry = ["page_ord", "sec_ord", "entry_ord"]
    order = [F.col(c) for c in entry]
    path, title = F.lower("path"), F.lower("title")
    asked = endpoints.select(*POSITION, "method", "path", F.coalesce(path, title).alias("p"), F.coalesce(title, path).alias("t"))
    texts = changes.select(
        *entry, "change_ord", "date", "raw_date", "section", "title",
        F.lower(F.concat("title", F.lit(" "), "body")).alias("_text"),
    )
    sets = asked.where("p <> '' AND t <> ''").select("p", "t").distinct()
    sides = sets.withColumn("needle", F.explode(F.array_distinct(F.array("p", "t"))))
    pairs = substring_pairs(texts, "_text", sides.select("needle"), "needle").drop("_text")
    per_needle = stored(pairs.groupBy("needle", *entry).agg(_first_change()))
    sizes = per_needle.groupBy("needle").agg(F.count("*").alias("size"))

    # A release among the first of a pair is among the first of each of its texts that has it.
    first = _top(per_needle, "needle", order, limit).drop("rank")
    merged = sides.join(first, "needle").groupBy("p", "t", *entry).agg(F.min("m").alias("m"))
    ranked = _top(merged.withColumn("key", F.struct("p", "t")), "key", order, limit).drop("key")
    summed = sides.join(sizes, "needle").groupBy("p", "t").agg(F.sum("size").alias("size"))
    both = sets.where("p <> t").join(sizes.toDF("p", "p_size"), "p").join(sizes.toDF("t", "t_size"), "t").select(
        "p", "t", F.when(F.col("p_size") <= F.col("t_size"), F.col("p")).otherwise(F.col("t")).alias("needle"),
        F.when(F.col("p_size") <= F.col("t_size"), F.col("t")).otherwise(F.col("p")).alias("other"))
    held = per_needle.select("needle", *entry)
    common = both.join(held, "needle").join(held.withColumnRenamed("needle", "other"), ["other", *entry])
    twice = common.groupBy("p", "t").agg(F.count("*").alias("twice"))
    found = summed.join(twice, ["p", "t"], "left").select("p", "t", (F.col("size") - F.coalesce("twice", F.lit(0))).alias("found"))
    named = asked.join(ranked.select("p", "t", "rank", "m").join(found, ["p", "t"]), ["p", "t"]).select(
        *POSITION, "method", "path", "rank", "found", "m.*")

    always = asked.where("p = '' OR t = ''").drop("p", "t")
    releases = texts.groupBy(*entry).agg(_first_change()).select(*entry, "m.*")
    shown = ["change_ord", "date", "raw_date", "section", "title"]
    total = releases.agg(F.count("*")).scalar()
    every = _with_each(always, _first_overall(releases, entry, shown, limit))
    return named.unionByName(every.withColumn("found", total)).drop("change_ord")


def _first_change() -> Column:
    return F.min(F.struct("change_ord", "date", "raw_date", "section", "title")).alias("m")


# ---------------------------------------------------------------- profiles and suggestions


def describe_endpoints(endpoints: DataFrame, schemas: DataFrame, error_codes: DataFrame, changes: DataFrame,
                       shown_errors: int = SHOWN_ERRORS, shown_mentions: int = SHOWN_MENTIONS) -> DataFrame:
    """One row per documented (method, path): schema, first errors, first mentions, deprecation.

    ``n_errors`` and ``n_mentions`` tell how many there are; ask for as many to see all.
    """
    first = endpoints.groupBy("method", "path").agg(
        F.min_by(
            F.struct("page_ord", "tbl_ord", "row_ord", "title", "docs_path", "deprecated", "deprecation_note"),
            F.struct(*POSITION),
        ).alias("e")
    ).select("method", "path", "e.*")
    errors = _listed(errors_for_endpoint(first, error_codes, shown_errors), F.struct("rank", "code", "reason"), "errors")
    mentions = _listed(
        release_mentions(first, changes, shown_mentions), F.struct("rank", "date", "raw_date", "section", "title"), "mentions"
    )
    profiled = attach(first, resolve.request_schemas(schemas), ["docs_path"], F.xxhash64("method", "path"))
    none = F.lit(0).cast("bigint")
    return (
        profiled.join(errors, list(POSITION), "left").join(mentions, list(POSITION), "left")
        .select(
            "method", "path", "title", "docs_path", "deprecated", "deprecation_note", "schema_name", "fields",
            "errors", F.coalesce("n_errors", none).alias("n_errors"),
            "mentions", F.coalesce("n_mentions", none).alias("n_mentions"),
        )
    )


def _listed(rows: DataFrame, item: Column, name: str) -> DataFrame:
    """Fold the ranked rows of each endpoint, as many as are shown, into an array."""
    return rows.groupBy(*POSITION).agg(
        F.array_sort(F.collect_list(item)).alias(name), F.max("found").alias(f"n_{name}")
    )


def suggest_endpoints(requests: DataFrame, endpoints: DataFrame, limit: int = SHOWN_SUGGESTIONS) -> DataFrame:
    """For requests (method, path) not documented: the first endpoints with the same method."""
    asked = requests.select(
        F.upper(F.trim("method")).alias("method"), F.trim(F.col("path")).alias("path")
    ).distinct()
    missing = asked.join(endpoints.select("method", "path"), ["method", "path"], "left_anti")
    offers = _top(endpoints.select("method", F.col("path").alias("suggestion"), *POSITION), "method",
                  [F.col(c) for c in POSITION], limit).drop(*POSITION)
    return attach(missing, offers, ["method"], F.col("path"), how="inner")


def explain_error_occurrences(asked: DataFrame, error_codes: DataFrame) -> DataFrame:
    """Documented occurrences of each asked (code, endpoint?): those on the endpoint if any, else all.

    Whether an endpoint has an occurrence of its own is settled by a semi-join on
    (code, endpoint) first, so no group of occurrences has to be ranked.
    """
    wanted = asked.select("code", F.col("endpoint").alias("asked_endpoint")).distinct()
    keyed = wanted.withColumn("line", F.lower("asked_endpoint"))
    codes = error_codes.select("code", F.lower("endpoint").alias("line"), "endpoint", "reason", "docs_path")
    on_endpoint = keyed.join(codes, ["code", "line"])
    has_own = codes.select("code", "line").where("line IS NOT NULL").distinct()
    rest = keyed.join(has_own, ["code", "line"], "left_anti")
    elsewhere = rest.drop("line").join(codes.drop("line"), "code")
    return on_endpoint.drop("line").withColumn("on_endpoint", F.lit(True)).unionByName(
        elsewhere.withColumn("on_endpoint", F.lit(False))
    )
