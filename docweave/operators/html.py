"""Shredding pages and reading the trees: text, titles, pseudo-tables, code blocks.

``shred_html`` keeps each page's nodes in one row, numbered in document order, so the
tree is walked by array index: ``nodes[n.parent]`` is the parent, ``n.ord + 1 .. n.last``
the subtree and ``runs[n.lo .. n.hi)`` its text. Nothing here shuffles except
``nearest_heading`` for rows from elsewhere, and that moves headings and those rows only.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave import schemas
from docweave.functions import html_tree
from docweave.functions.expr import let
from docweave.functions.html_tree import shredder
from docweave.functions.text import clean_lines, deprecation_note, strip
from docweave.session import spread_small

# Executors need no installed copy of the package: the tree builder travels with its tasks.
cloudpickle.register_pickle_by_value(html_tree)

# Page furniture that is not content.
CHROME = ("nav", "footer", "script", "style", "header")
TEXT_CHROME = (*CHROME, ".gatsby-highlight")
LANDMARKS = TEXT_CHROME
# Elements that make a line of clean text, and what goes around them.
LINE_TAGS = ("h1", "h2", "h3", "h4", "h5", "p", "li", "pre", "code", "th", "td")
OPENERS = {"h1": "\n# ", "h2": "\n## ", "h3": "\n### ", "h4": "\n#### ", "h5": "\n#### ",
           "pre": "\n```\n", "li": "- "}
CLOSERS = {"h1": "\n", "h2": "\n", "h3": "\n", "h4": "\n", "h5": "\n", "pre": "\n```\n"}
# Class names that mark a content container, and the language of a code block.
CONTENT_CLASS = r"(?i)content|main|body"
CODE_LANGUAGE = r"(?U)^language-([\w+-]+)"
HEADINGS = ("h1", "h2", "h3")
WHOLE_PAGE = 2**31 - 1


# ---------------------------------------------------------------- trees


def shred_html(pages: DataFrame, landmarks: tuple[str, ...] = LANDMARKS, attrs: bool = False) -> DataFrame:
    """``pages(page_id, url, html)`` to one tree row per page; a bad page gets an error text.

    ``landmarks`` are tag names or ``.class`` selectors whose insides can later be dropped.
    Attributes other than classes are kept only when ``attrs`` asks for them.
    """
    return spread_small(pages.select("page_id", "url", "html")).mapInArrow(shredder(landmarks, attrs), schemas.TREES)


def node_table(trees: DataFrame) -> DataFrame:
    """Flat view: one row per element, with its nesting interval and own marks."""
    return trees.select("page_id", F.inline("nodes"))


def text_runs(trees: DataFrame) -> DataFrame:
    """Flat view: one row per text run, in document order."""
    return trees.select("page_id", F.posexplode("runs").alias("run_ord", "run")).select(
        "page_id", "run_ord", "run.elem", "run.block", "run.marks", "run.text"
    )


def parse_errors(trees: DataFrame) -> DataFrame:
    """Pages that could not be read, as (path, error)."""
    return trees.where("error IS NOT NULL").select(F.col("url").alias("path"), "error")


def mask(selectors: tuple[str, ...], landmarks: tuple[str, ...] = LANDMARKS) -> int:
    """Bit mask of landmark selectors, for comparison with ``marks``."""
    return sum(1 << landmarks.index(s) for s in selectors)


def unmarked(item: Column, drop: int) -> Column:
    return item["marks"].bitwiseAND(F.lit(drop).cast("bigint")) == 0


def prune_chrome(nodes: DataFrame, selectors: tuple[str, ...] = CHROME,
                 landmarks: tuple[str, ...] = LANDMARKS) -> DataFrame:
    """Drop nodes (or text runs) inside any of the selectors. A row predicate, no join."""
    drop = mask(selectors, landmarks)
    return nodes.where(F.col("marks").bitwiseAND(F.lit(drop).cast("bigint")) == 0)


def container_span(nodes: Column, drop: int, with_div: bool = True) -> Column:
    """Interval of the main container: main, else article, else a content-like div, else all."""
    def first(among: Column, test) -> Column:
        # Bound, or every use of the found node would look for it again.
        return let(F.get(F.filter(among, test), F.lit(0)), lambda c: F.when(
            c.isNotNull(), F.struct(c["ord"].alias("ord"), c["last"].alias("last"))))

    def chosen(named: Column) -> Column:
        spans = [first(named, lambda n: n["tag"] == "main"), first(named, lambda n: n["tag"] == "article")]
        if with_div:
            spans.append(first(nodes, lambda n: (n["tag"] == "div")
                               & F.exists(n["cls"], lambda c: F.rlike(c, F.lit(CONTENT_CLASS))) & unmarked(n, drop)))
        return F.coalesce(*spans, F.struct(F.lit(-1).alias("ord"), F.lit(WHOLE_PAGE).alias("last")))

    return let(F.filter(nodes, lambda n: n["tag"].isin("main", "article") & unmarked(n, drop)), chosen)


def inside(node: Column, span: Column) -> Column:
    """Below the container, the container itself excluded."""
    return (node["ord"] > span["ord"]) & (node["ord"] <= span["last"])


def main_container(trees: DataFrame, drop: tuple[str, ...] = CHROME, with_div: bool = True) -> DataFrame:
    """One row per page: the container's first and last node number (-1 means whole page)."""
    span = container_span(F.col("nodes"), mask(drop), with_div)
    return trees.select("page_id", span.alias("span")).select("page_id", "span.ord", "span.last")


# ---------------------------------------------------------------- text


def runs_of(node: Column, drop: int = 0) -> Column:
    """Text runs below a node, without line breaks and without dropped parts."""
    own = F.slice(F.col("runs"), node["lo"] + 1, node["hi"] - node["lo"])
    if drop:
        return F.filter(own, lambda r: r["text"].isNotNull() & unmarked(r, drop))
    return F.filter(own, lambda r: r["text"].isNotNull())


def joined(texts: Column, separator: str) -> Column:
    """Non-blank ones of some stripped texts; nulls are left out."""
    return F.array_join(F.array_remove(texts, F.lit("")), separator)


def stripped_runs(runs: Column, drop: int = 0) -> Column:
    """Texts of runs, null for line breaks and dropped parts."""
    def text(run: Column) -> Column:
        return F.when(unmarked(run, drop), strip(run["text"])) if drop else strip(run["text"])

    return F.transform(runs, text)


def node_text(node: Column, separator: str = " ", drop: int = 0) -> Column:
    """Stripped, non-blank text runs of a subtree joined by ``separator``."""
    own = F.slice(F.col("runs"), node["lo"] + 1, node["hi"] - node["lo"])
    return joined(stripped_runs(own, drop), separator)


def text_among(texts: Column, node: Column, separator: str = " ") -> Column:
    """``node_text`` from the ``stripped_runs`` of the whole page, where many nodes are asked for."""
    return joined(F.slice(texts, node["lo"] + 1, node["hi"] - node["lo"]), separator)


def page_text(drop: int = 0) -> Column:
    """Text of the whole page, dropped parts removed."""
    return joined(stripped_runs(F.col("runs"), drop), " ")


def subtree_text(trees: DataFrame, tags: tuple[str, ...], separator: str = " ",
                 drop: tuple[str, ...] = ()) -> DataFrame:
    """Text of every element with one of the given tags."""
    gone = mask(drop)
    wanted = F.filter("nodes", lambda n: n["tag"].isin(*tags) & unmarked(n, gone))
    texts = F.transform(
        wanted,
        lambda n: F.struct(
            n["ord"].alias("ord"), n["tag"].alias("tag"), node_text(n, separator, gone).alias("text")
        ),
    )
    return trees.select("page_id", F.inline(texts))


def clean_documents(trees: DataFrame, mode: str = "leaf") -> DataFrame:
    """Markdown-like page text, as (page_id, url, content).

    ``nested`` emits every line element with its whole subtree, so a paragraph inside an
    unclosed paragraph appears in both; its size can grow with the square of the page.
    ``leaf`` emits each text run once, under the innermost element that owns it.
    """
    if mode not in ("leaf", "nested"):
        raise ValueError(f"mode must be 'leaf' or 'nested', got {mode!r}")
    drop = mask(TEXT_CHROME)
    render = _nested_text if mode == "nested" else _leaf_text
    content = let(container_span(F.col("nodes"), drop), lambda span: render(span, drop))
    return trees.where("error IS NULL").select(
        "page_id", "url", F.regexp_replace(strip(content), "\n{3,}", "\n\n").alias("content")
    )


def _nested_text(span: Column, drop: int) -> Column:
    wanted = F.filter("nodes", lambda n: n["tag"].isin(*LINE_TAGS) & inside(n, span) & unmarked(n, drop))
    texts = F.transform(
        wanted, lambda n: F.struct(n["tag"].alias("tag"), node_text(n, " ", drop).alias("text"))
    )
    shown = F.filter(texts, lambda t: t["text"] != "")
    return F.array_join(
        F.transform(
            shown, lambda t: F.concat(_around(t["tag"], OPENERS), t["text"], _around(t["tag"], CLOSERS))
        ),
        "\n",
    )


def _leaf_text(span: Column, drop: int) -> Column:
    kept = F.filter(
        "runs",
        lambda r: r["text"].isNotNull() & (r["block"] > span["ord"]) & (r["block"] <= span["last"])
        & unmarked(r, drop) & (strip(r["text"]) != ""),
    )

    def parts(runs: Column) -> Column:
        # Runs of one owner that follow each other share a line.
        def part(run: Column, i: Column) -> Column:
            same_before = F.coalesce(F.get(runs, i - 1)["block"] == run["block"], F.lit(False))
            same_after = F.coalesce(F.get(runs, i + 1)["block"] == run["block"], F.lit(False))
            tag = F.get("nodes", run["block"])["tag"]
            opened = F.when(same_before, F.lit(" ")).otherwise(_around(tag, OPENERS))
            closed = F.when(same_after, F.lit("")).otherwise(
                F.concat(_around(tag, CLOSERS), F.lit("\n"))
            )
            return F.concat(opened, strip(run["text"]), closed)

        return F.array_join(F.transform(runs, part), "")

    return let(kept, parts)


def _around(tag: Column, table: dict[str, str]) -> Column:
    chosen = F.lit("")
    for name, mark in table.items():
        chosen = F.when(tag == name, F.lit(mark)).otherwise(chosen)
    return chosen


# ---------------------------------------------------------------- pseudo-tables


def is_table(node: Column) -> Column:
    """Tables are marked by a class on a div, rows and cells are its nested divs."""
    return (node["tag"] == "div") & F.array_contains(node["cls"], "table")


def _child_divs(node: Column) -> Column:
    below = F.slice(F.col("nodes"), node["ord"] + 2, node["last"] - node["ord"])
    return F.filter(below, lambda c: (c["tag"] == "div") & (c["parent"] == node["ord"]))


def cell_text(node: Column) -> Column:
    """Cell text: line breaks, real or written out as ``<br />``, become newlines."""
    own = F.slice(F.col("runs"), node["lo"] + 1, node["hi"] - node["lo"])
    raw = F.array_join(F.transform(own, lambda r: F.coalesce(r["text"], F.lit("\n"))), " ")
    return clean_lines(F.regexp_replace(raw, r"<br\s*/?>", "\n"))


def table_rows(node: Column) -> Column:
    """Rows of a pseudo-table as an array of cell arrays; the first one is the header."""
    rows = F.transform(
        _child_divs(node),
        lambda row: F.struct(
            row["nth"].alias("row_ord"), F.transform(_child_divs(row), cell_text).alias("cells")
        ),
    )
    return F.filter(rows, lambda row: (row["row_ord"] == 0) | (F.size(row["cells"]) > 0))


def tables_in_page() -> Column:
    """All pseudo-tables of a tree row: array of (tbl_ord, all_rows)."""
    return F.transform(
        F.filter("nodes", is_table),
        lambda t: F.struct(t["ord"].alias("tbl_ord"), table_rows(t).alias("all_rows")),
    )


def note_in_page() -> Column:
    """Deprecation sentence of the page's text outside the chrome, or null."""
    return let(page_text(mask(CHROME)), lambda text: deprecation_note(text))


def pseudo_tables(trees: DataFrame, title: Column | None = None) -> DataFrame:
    """Every ``div.table``, nested ones too: (page_id, url, page_note, tbl_ord, headers, rows).

    ``page_note`` is the deprecation sentence of the page the table stands on. With ``title``, an expression on the
    page's tree, tables carry the title of their page, so nobody has to parse the pages again and join it.
    """
    pages = trees.where(F.exists("nodes", is_table))
    carried = [] if title is None else [title.alias("title")]
    return split_header(pages.select("page_id", "url", note_in_page().alias("page_note"), *carried, F.inline(tables_in_page())))


def page_deprecation(trees: DataFrame) -> DataFrame:
    """Deprecation sentence of each page's text outside the chrome, or null."""
    return trees.select("page_id", "url", note_in_page().alias("deprecation_note"))


def split_header(tables: DataFrame) -> DataFrame:
    """Separate ``all_rows`` into header cells and data rows; tables without rows go away."""
    return (
        tables.where("size(all_rows) > 0")
        .withColumn("headers", F.transform(F.col("all_rows")[0]["cells"], F.lower))
        .withColumn("rows", F.slice("all_rows", 2, F.size("all_rows")))
        .drop("all_rows")
    )


def table_cells(tables: DataFrame) -> DataFrame:
    """Flat view of the data cells: (page_id, tbl_ord, row_ord, col_ord, header, text)."""
    return (
        tables.select("page_id", "tbl_ord", "headers", F.inline("rows"))
        .select("page_id", "tbl_ord", "row_ord", "headers", F.posexplode("cells").alias("col_ord", "text"))
        .withColumn("header", F.get("headers", F.col("col_ord")))
        .select("page_id", "tbl_ord", "row_ord", "col_ord", "header", "text")
    )


def headed_tables_in_page(headings: tuple[str, ...] = ("h2", "h3")) -> Column:
    """Pseudo-tables right after a heading: array of (tbl_ord, heading, level, all_rows)."""
    def follows(h: Column) -> Column:
        # Nodes are elements only, so the next sibling element sits right after the subtree.
        nxt = F.get("nodes", h["last"] + 1)
        return F.coalesce(is_table(nxt) & (nxt["parent"] == h["parent"]), F.lit(False))

    return F.transform(
        F.filter("nodes", lambda n: n["tag"].isin(*headings) & follows(n)),
        lambda h: F.struct(
            (h["last"] + 1).alias("tbl_ord"),
            node_text(h, "").alias("heading"),
            F.substring(h["tag"], 2, 1).cast("int").alias("level"),
            table_rows(F.get("nodes", h["last"] + 1)).alias("all_rows"),
        ),
    )


def heading_tables(trees: DataFrame) -> DataFrame:
    """Pseudo-tables whose previous sibling element is a heading, with that heading."""
    return split_header(trees.select("page_id", "url", F.inline(headed_tables_in_page())))


def column_of(headers: Column, *patterns: str, exact: bool = True, allof: bool = False) -> Column:
    """First header position matching: equal to a pattern, or containing any (all) of them."""
    if exact:
        position = F.array_position(headers, patterns[0])
        return F.when(position > 0, position.cast("int") - 1)

    def hit(h: Column) -> Column:
        tests = [F.contains(h, F.lit(p)) for p in patterns]
        out = tests[0]
        for test in tests[1:]:
            out = (out & test) if allof else (out | test)
        return out

    marked = F.array_position(F.transform(headers, hit), F.lit(True))
    return F.when(marked > 0, marked.cast("int") - 1)


def bind_columns(tables: DataFrame, roles: dict[str, Column], required: tuple[str, ...],
                 width: tuple[str, ...] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bind header positions to role names and return one row per data row.

    ``required`` roles must be found in the header. A row must be wider than every
    position named in ``width`` (default: all bound roles); other roles are null when the
    row is too short. Cell texts come back stripped.
    """
    bound = tables
    for role, position in roles.items():
        bound = bound.withColumn(f"_{role}", position)
    for role in required:
        bound = bound.where(F.col(f"_{role}").isNotNull())
    rows = bound.select(
        "page_id", "url", "tbl_ord", *keep, *[f"_{r}" for r in roles], F.inline("rows")
    )
    limits = [F.coalesce(F.col(f"_{r}"), F.lit(0)) for r in (width or tuple(roles))]
    widest = F.greatest(*limits) if len(limits) > 1 else limits[0]
    cells = [strip(F.get("cells", F.col(f"_{r}"))).alias(r) for r in roles]
    return rows.where(F.size("cells") > widest).select(
        "page_id", "url", "tbl_ord", "row_ord", *keep, *cells
    )


# ---------------------------------------------------------------- deprecation, code, headings


def code_blocks(trees: DataFrame, headings: bool = False) -> DataFrame:
    """Non-blank ``pre > code`` blocks: (page_id, url, ord, language, code), with ``headings`` also ``nearby_heading``.

    The heading is looked up in the page's own row, so nothing is parsed twice or shuffled for it.
    """
    def block(n: Column, heads: Column | None) -> Column:
        found = [
            n["ord"].alias("ord"),
            F.get(F.filter(n["cls"], lambda c: F.rlike(c, F.lit(CODE_LANGUAGE))), F.lit(0)).alias("lang_class"),
            F.array_join(F.transform(runs_of(n), lambda r: r["text"]), "").alias("code"),
        ]
        if heads is not None:
            before = F.filter(heads, lambda h: h["ord"] < n["ord"])
            nearest = let(before, lambda hs: F.get(hs, F.size(hs) - 1))
            found.append(let(nearest, lambda h: F.when(h.isNotNull(), node_text(h, ""))).alias("nearby_heading"))
        return F.struct(*found)

    code = F.filter("nodes", lambda n: (n["tag"] == "code") & (F.get("nodes", n["parent"])["tag"] == "pre"))
    heads = F.filter("nodes", lambda n: n["tag"].isin(*HEADINGS))
    blocks = (let(heads, lambda hs: F.transform(code, lambda n: block(n, hs))) if headings
              else F.transform(code, lambda n: block(n, None)))
    language = F.lower(F.regexp_extract("lang_class", CODE_LANGUAGE, 1)).alias("language")
    return (
        trees.select("page_id", "url", F.inline(blocks))
        .where(strip(F.col("code")) != "")
        .select("page_id", "url", "ord", language, "code", *(["nearby_heading"] if headings else []))
    )


def nearest_heading(trees: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Add ``nearby_heading``: the closest h1-h3 before each row of ``marked`` (page_id, ord), or of the code blocks.

    Code blocks find theirs in the task that parsed the page. For rows from elsewhere it is a backward as-of match per
    page, to which only pages holding a ``pre`` send their headings.
    """
    if marked is None:
        return code_blocks(trees, headings=True)
    with_code = trees.where(F.exists("nodes", lambda n: n["tag"] == "pre"))
    heads = subtree_text(with_code, HEADINGS, "").select(
        "page_id", "ord", F.col("text").alias("_heading")
    )
    before = W.partitionBy("page_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    both = marked.withColumn("_asked", F.lit(True)).unionByName(heads, allowMissingColumns=True)
    return (
        both.withColumn("nearby_heading", F.last("_heading", ignorenulls=True).over(before))
        .where("_asked")
        .drop("_asked", "_heading")
    )
