"""Release notes: dated entries with their changes, filters, digests and feature status."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.expr import let
from docweave.functions.joins import substring_pairs
from docweave.functions.text import is_deprecated, strip
from docweave.operators import html

# Release sections in report order.
API_CHANGES, SANDBOX, UPCOMING, EARLIER = "api_changes", "sandbox", "upcoming", "earlier"
SECTION_ORDER = (API_CHANGES, SANDBOX, UPCOMING, EARLIER)


def section_rank(section: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), section).cast("int")


def classify_section(heading: Column) -> Column:
    """h2 text to section; null for sections that are not release lists."""
    lower = F.lower(heading)
    return F.when(F.contains(lower, F.lit("api change")), F.lit(API_CHANGES)).when(
        F.contains(lower, F.lit("sandbox")), F.lit(SANDBOX)
    )


def parse_release_date(text: Column) -> Column:
    """``Month DD, YYYY`` or ``Mon DD, YYYY``, in any letter case, else null."""
    plain = F.initcap(F.lower(strip(text)))
    shaped = F.when(F.rlike(plain, F.lit(r"^[A-Z][a-z]+\s+\d{1,2},\s+\d{4}$")), F.regexp_replace(plain, r"\s+", " "))
    # Every short name has three letters, so one pattern is tried; a failing one costs more than all the rest.
    short = F.rlike(shaped, F.lit("^[A-Z][a-z]{2} "))
    return F.when(short, F.try_to_date(shaped, "MMM d, yyyy")).otherwise(F.try_to_date(shaped, "MMMM d, yyyy"))


def entry_section(section: Column, date: Column) -> Column:
    """Undated entries go to the catch-all section."""
    return F.when(date.isNull(), F.lit(EARLIER)).otherwise(section)


def _rendered(node: Column, texts: Column, drop: int) -> Column:
    """One block element as text; blank elements give an empty string."""
    tag = node["tag"]

    def bullets() -> Column:
        items = F.filter(
            F.slice(F.col("nodes"), node["ord"] + 2, node["last"] - node["ord"]),
            lambda c: (c["parent"] == node["ord"]) & (c["tag"] == "li") & html.unmarked(c, drop),
        )
        shown = F.array_remove(F.transform(items, lambda c: html.text_among(texts, c)), F.lit(""))
        return F.array_join(F.transform(shown, lambda t: F.concat(F.lit("- "), t)), "\n\n")

    def framed(text: Column) -> Column:
        return (
            F.when(text == "", text)
            .when(tag == "li", F.concat(F.lit("- "), text))
            .when(tag.isin("h5", "h6"), F.concat(F.lit("**"), text, F.lit("**")))
            .when(tag == "pre", F.concat(F.lit("```\n"), text, F.lit("\n```")))
            .otherwise(text)
        )

    return F.when(tag.isin("ul", "ol"), bullets()).otherwise(let(html.text_among(texts, node), framed))


def _in_container(found) -> Column:
    """``found(span, texts, drop)`` evaluated once per page with its container span and the stripped texts of its runs."""
    drop = html.mask(html.CHROME)
    return let(html.container_span(F.col("nodes"), drop, with_div=False), lambda span: let(
        html.stripped_runs(F.col("runs"), drop), lambda texts: found(span, texts, drop)))


def blocks_in_page() -> Column:
    """Element siblings of every h2 in the container, rendered: array of (parent, ord, tag, title, body)."""

    def found(span: Column, texts: Column, drop: int) -> Column:
        heads = F.filter("nodes", lambda n: (n["tag"] == "h2") & html.inside(n, span) & html.unmarked(n, drop))
        parents = F.array_distinct(heads["parent"])
        siblings = let(parents, lambda ps: F.filter(
            "nodes",
            lambda n: F.array_contains(ps, n["parent"]) & html.inside(n, span) & html.unmarked(n, drop),
        ))
        return F.transform(
            siblings,
            lambda n: F.struct(
                n["parent"].alias("parent"), n["ord"].alias("ord"), n["tag"].alias("tag"),
                F.when(n["tag"].isin("h2", "h3", "h4"), html.text_among(texts, n, "")).alias("title"),
                F.when(~n["tag"].isin("h2", "h3", "h4"), _rendered(n, texts, drop)).alias("body"),
            ),
        )

    return _in_container(found)


def release_blocks(trees: DataFrame) -> DataFrame:
    """The raw material of entries, one row per page. A filter on it would render every page twice."""
    return trees.select("page_id", "url", blocks_in_page().alias("blocks"))


def entries_in_page(blocks: Column) -> Column:
    """Entries of a page's blocks: array of (sec_ord, entry_ord, raw_date, heading, changes).

    Siblings in document order are cut at every h2, their sections at every h3 and those entries at
    every h4, so a block belongs to the headings it stands under. Cuts are kept as positions, as
    arrays of blocks would be copied at every step. Work is linear in the blocks.
    """
    def cut(siblings: Column) -> Column:
        def rank(block: Column, i: Column) -> Column:
            starts = (block["tag"] == "h2") | (i == 0) | (F.get(siblings, i - 1)["parent"] != block["parent"])
            return F.struct(i.alias("at"), F.when(starts, 2).when(block["tag"] == "h3", 3).when(block["tag"] == "h4", 4).alias("rank"))

        heads = F.filter(F.transform(siblings, rank), lambda h: h["rank"].isNotNull())
        return let(siblings["body"], lambda bodies: let(heads, lambda hs: let(
            _positions(hs, lambda h: h["rank"] < 4), lambda upper: sections(siblings, bodies, hs, upper))))

    def sections(siblings: Column, bodies: Column, heads: Column, upper: Column) -> Column:
        def head(k: Column) -> Column:
            return F.get(siblings, F.get(heads, k)["at"])

        def change(k: Column) -> Column:
            at = F.get(heads, k)["at"]
            texts = F.slice(bodies, at + 1, F.coalesce(F.get(heads, k + 1)["at"], F.size(bodies)) - at)
            return F.struct(head(k)["title"].alias("title"), strip(F.array_join(F.array_remove(texts, F.lit("")), "\n\n")).alias("body"))

        def entry(section: Column, k: Column, end: Column) -> Column:
            # An entry without h4s has one change made of its whole body.
            plain = F.filter(F.array(change(k)), lambda c: c["body"] != "")
            changes = F.when(end > k + 1, F.transform(F.sequence(k + 1, F.greatest(k + 1, end - 1)), change)).otherwise(plain)
            return let(head(k), lambda h3: F.struct(
                section["ord"].alias("sec_ord"), h3["ord"].alias("entry_ord"), h3["title"].alias("raw_date"),
                section["title"].alias("heading"), changes.alias("changes")))

        def entries(first: Column, end: Column) -> Column:
            below = F.slice(upper, first + 2, end - first - 1)
            return let(head(F.get(upper, first)), lambda section: F.when(
                (section["tag"] == "h2") & classify_section(section["title"]).isNotNull(),
                F.transform(below, lambda k, i: entry(section, k, F.coalesce(F.get(upper, first + i + 2), F.size(heads))))))

        starts = _positions(upper, lambda k: F.get(heads, k)["rank"] == 2)
        return let(starts, lambda cuts: F.flatten(F.filter(
            F.transform(cuts, lambda first, i: entries(first, F.coalesce(F.get(cuts, i + 1), F.size(upper)))), lambda found: found.isNotNull())))

    # Blocks come in document order; with several parents, those of each must follow each other.
    ordered = let(blocks, lambda bs: F.when(F.size(F.array_distinct(bs["parent"])) > 1, F.sort_array(bs)).otherwise(bs))
    return let(ordered, cut)


def _positions(items: Column, test) -> Column:
    """Positions of the items that pass a test."""
    return F.array_compact(F.transform(items, lambda x, i: F.when(test(x), i)))


def collect_changes(pages: DataFrame) -> DataFrame:
    """Entries of (page_id, url, blocks) with their changes; each page is read in its own row."""
    return _dated(pages.select("page_id", "url", F.inline(entries_in_page(F.col("blocks")))))


def _dated(found: DataFrame) -> DataFrame:
    date = parse_release_date(F.col("raw_date"))
    return found.select(
        F.col("page_id").alias("page_ord"), "sec_ord", "entry_ord", date.alias("date"), "raw_date",
        entry_section(classify_section(F.col("heading")), date).alias("section"), "changes", F.col("url").alias("docs_path"),
    )


def parse_releases(trees: DataFrame) -> DataFrame:
    """Release-note pages to entries, without a shuffle; blocks are not made rows on the way."""
    return _dated(trees.select("page_id", "url", F.inline(let(blocks_in_page(), entries_in_page))))


def upcoming_in_page() -> Column:
    """Body of an upcoming-changes page: its paragraphs, lists and headings, rendered."""

    def found(span: Column, texts: Column, drop: int) -> Column:
        blocks = F.filter(
            "nodes",
            lambda n: n["tag"].isin("p", "ul", "ol", "h2", "h3", "h4")
            & html.inside(n, span) & html.unmarked(n, drop),
        )
        return strip(F.array_join(F.array_remove(F.transform(blocks, lambda n: _rendered(n, texts, drop)), F.lit("")), "\n\n"))

    return _in_container(found)


def parse_upcoming(trees: DataFrame) -> DataFrame:
    """An upcoming-changes page to one undated entry; a page without text gives no row."""
    return upcoming_entries(trees.where("error IS NULL").select("page_id", "url", upcoming_in_page().alias("body")))


def upcoming_entries(bodies: DataFrame) -> DataFrame:
    """Entries of (page_id, url, body); blank bodies are dropped."""
    change = F.struct(F.lit("Upcoming changes").alias("title"), F.col("body").alias("body"))
    # Dropping blanks inside the array keeps the filter from rendering every page twice.
    changes = let(F.array(change), lambda cs: F.filter(cs, lambda c: c["body"] != ""))
    return bodies.select("page_id", "url", F.inline(changes)).select(
        F.col("page_id").alias("page_ord"), F.lit(0).alias("sec_ord"), F.lit(0).alias("entry_ord"),
        F.lit(None).cast("date").alias("date"), F.lit("Upcoming").alias("raw_date"),
        F.lit(UPCOMING).alias("section"), F.array(F.struct("title", "body")).alias("changes"),
        F.col("url").alias("docs_path"),
    )


# ---------------------------------------------------------------- queries over entries


def filter_since(entries: DataFrame, since: str) -> DataFrame:
    """Entries dated on or after ``since`` (ISO); undated ones are left out."""
    try:
        day = datetime.datetime.strptime(since, "%Y-%m-%d").date()
    except ValueError as problem:
        raise ValueError(f"since must be an ISO date 'YYYY-MM-DD', got {since!r}") from problem
    return entries.where(F.col("date") >= F.lit(day))


def filter_section(entries: DataFrame, section: str) -> DataFrame:
    return entries.where(F.col("section") == section)


def _newest_first() -> list[Column]:
    return [
        F.col("date").desc_nulls_last(), F.col("section"), F.col("page_ord"), F.col("sec_ord"), F.col("entry_ord"),
    ]


def latest_releases(entries: DataFrame, limit: int = 20) -> DataFrame:
    """Newest entries first, undated last, with the number found before the limit."""
    total = entries.agg(F.count("*")).scalar()
    return entries.orderBy(*_newest_first()).limit(limit).withColumn("total", total)


def releases_by_section(entries: DataFrame, limit: int = 20) -> DataFrame:
    """The limited listing regrouped in the fixed section order; position starts at 1."""
    shown = entries.orderBy(*_newest_first()).limit(limit)
    within = W.partitionBy("section").orderBy(*_newest_first())
    return (
        shown.withColumn("section_rank", section_rank(F.col("section")))
        .where("section_rank > 0")
        .withColumn("position", F.row_number().over(within))
        .orderBy("section_rank", "position")
    )


def release_changes(entries: DataFrame) -> DataFrame:
    """One row per change, with its position inside the entry."""
    return entries.select(
        "page_ord", "sec_ord", "entry_ord", "date", "raw_date", "section", "docs_path",
        F.posexplode("changes").alias("change_ord", "c"),
    ).select(
        "page_ord", "sec_ord", "entry_ord", "date", "raw_date", "section", "docs_path", "change_ord",
        "c.title", "c.body",
    )


STATUS_LABELS = {API_CHANGES: "Live", SANDBOX: "In Sandbox", UPCOMING: "Upcoming"}


def feature_status(features: DataFrame, changes: DataFrame) -> DataFrame:
    """Status of each feature phrase with date and title of the evidence.

    A change is evidence when its title or body holds the phrase, whatever the case.
    Sections count in the order live, sandbox, upcoming; inside one, the newest change.
    """
    counted = changes.where(F.col("section").isin(*STATUS_LABELS)).withColumn(
        "_text", F.lower(F.concat_ws(" ", "title", "body"))
    )
    asked = features.select("feature").distinct().withColumn("needle", F.lower("feature"))
    hits = substring_pairs(counted, "_text", asked, "needle")
    best = hits.groupBy("needle").agg(
        F.min_by(
            F.struct("section", "date", "title"),
            F.struct(
                section_rank(F.col("section")), -F.coalesce(F.unix_date("date"), F.lit(-999999)),
                F.col("page_ord"), F.col("entry_ord"), F.col("change_ord"),
            ),
        ).alias("found")
    )
    status = F.lit("Not documented")
    for section, label in STATUS_LABELS.items():
        status = F.when(F.col("found.section") == section, label).otherwise(status)
    return asked.join(best, "needle", "left").select(
        "feature", status.alias("status"), F.col("found.date").alias("date"), F.col("found.title").alias("evidence")
    )


def release_digest(changes: DataFrame, as_of: datetime.date, since: datetime.date | None = None,
                   area: str | None = None) -> DataFrame:
    """Changes of the window (30 days by default) per section and month, with deprecations.

    Upcoming changes have no date and are always in. ``area`` keeps changes whose title or
    body holds the phrase.
    """
    start = since or as_of - datetime.timedelta(days=30)
    shown = changes.where(
        (F.col("section") == UPCOMING)
        | (F.col("section").isin(API_CHANGES, SANDBOX) & (F.col("date") >= F.lit(start)))
    )
    text = F.concat_ws(" ", "title", "body")
    if area:
        shown = shown.where(F.contains(F.lower(text), F.lit(area.lower())))
    return shown.groupBy("section", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("changes"),
        F.count_if(is_deprecated(text)).alias("deprecations"),
    )
