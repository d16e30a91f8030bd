import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.functions import html_tree
from docweave.functions.html_tree import TreeBuilder
from docweave.operators import html


def tree(page, attrs=False):
    return TreeBuilder(html.LANDMARKS, attrs).build(page)


def shape(page):
    nodes, _ = tree(page)
    return [(n[4], n[1], n[2]) for n in nodes]


def texts(page):
    return [r[3] for r in tree(page)[1]]


def test_unclosed_paragraph_nests():
    assert shape("<div><p>a<p>b</div><i>c</i>") == [("div", -1, 2), ("p", 0, 2), ("p", 1, 2), ("i", -1, 3)]


def test_end_tag_pops_to_nearest_and_stray_is_ignored():
    assert shape("<div><b>x</div></b><p>y</p>") == [("div", -1, 1), ("b", 0, 1), ("p", -1, 2)]


def test_void_elements_close_at_once():
    assert shape("<p>a<br>b<img src=x>c</br></p>") == [("p", -1, 2), ("br", 0, 1), ("img", 0, 2)]


def test_self_closed_element_is_empty():
    assert shape("<div/><p>x</p>") == [("div", -1, 0), ("p", -1, 1)]


def test_entities_and_windows_1252():
    assert texts("<p>a &amp; b &#65; &#x42; &#146; &nope; &eacute;</p>") == ["a & b A B ’ &nope \xe9"]


def test_comment_splits_a_run_and_is_not_text():
    assert texts("<p>a<!-- no -->b</p>") == ["a", "b"]


def test_script_and_style_hold_no_text():
    assert texts('<script>var a = "<p>no</p>";</script><style>p{}</style><p>yes</p>') == ["yes"]


def test_blank_text_collapses_outside_pre():
    assert texts("<p>  \n </p><pre>  \n </pre>") == ["\n", "  \n "]


def test_last_duplicate_class_attribute_wins():
    nodes, _ = tree('<p class="a b" id="x" class="c">t</p>', attrs=True)
    assert nodes[0][5] == ["c"] and nodes[0][6] == {"class": "c", "id": "x"}


def test_null_page_is_an_error_row(shred):
    rows = html.parse_errors(shred("<p>ok</p>", None)).collect()
    assert [(r.path, r.error) for r in rows] == [("/p1", "no content")]


def test_node_table_and_runs(shred):
    trees = shred("<p>a<b>c</b></p>")
    assert html.node_table(trees).count() == 2
    assert [r.text for r in html.text_runs(trees).orderBy("run_ord").collect()] == ["a", "c"]


def test_chrome_is_dropped_with_everything_inside(shred):
    nodes = html.prune_chrome(html.node_table(shred("<nav><p>x</p></nav><p>y</p>")))
    assert [r.tag for r in nodes.collect()] == ["p"]


def test_unknown_landmark_is_refused():
    with pytest.raises(ValueError):
        html.mask(("aside",))


PAGE = """<html><body><nav><p>menu</p></nav><main><h1>Title</h1><p>Some <code>x</code> text</p>
<ul><li>one</li><li><p>two</p></li></ul><pre><code>a
b</code></pre><h5>Five</h5><h6>Six</h6><div>loose</div></main><footer>foot</footer></body></html>"""


def clean(trees, mode):
    return html.clean_documents(trees, mode).first().content


def test_nested_text_repeats_inner_elements(shred):
    assert clean(shred(PAGE), "nested") == (
        "# Title\n\nSome x text\nx\n- one\n- two\ntwo\n\n```\na\nb\n```\n\na\nb\n\n#### Five"
    )


def test_leaf_text_shows_each_run_once(shred):
    assert clean(shred(PAGE), "leaf") == (
        "# Title\n\nSome x text\n- one\ntwo\n\n```\na\nb\n```\n\n#### Five"
    )


def test_highlight_class_is_chrome_for_text_only(shred):
    trees = shred('<div class="gatsby-highlight"><p>hidden</p></div><p>shown</p>')
    assert clean(trees, "nested") == "shown"
    assert trees.select(html.page_text(html.mask(html.CHROME)).alias("t")).first().t == "hidden shown"


def test_unknown_mode_is_refused(shred):
    with pytest.raises(ValueError):
        html.clean_documents(shred("<p>x</p>"), "other")


@pytest.mark.parametrize("page,expected", [
    ("<article><p>a</p></article><main><p>m</p></main>", "m"),
    ("<div class='body'><p>d</p></div><article><p>a</p></article>", "a"),
    ("<p>x</p><div class='Page-Content'><p>d</p></div>", "d"),
    ("<section><p>s</p></section>", "s"),
    ("<nav><main><p>no</p></main></nav><p>rest</p>", "rest"),
])
def test_container_choice(shred, page, expected):
    assert clean(shred(page), "nested") == expected


TABLE = """<div class="table"><div><div>Name</div><div>Type</div></div>
<div><div>a</div><div>String&lt;br /&gt;  Optional</div></div><div>no cells</div>
<div><div>b<br>c</div><div> x   y </div><div><div class="table"><div><div>In</div></div><div><div>v</div></div></div></div></div></div>"""


def test_pseudo_tables_nest_and_normalise(shred):
    tables = html.pseudo_tables(shred(TABLE))
    cells = {(r.tbl_ord, r.row_ord, r.col_ord): r.text for r in html.table_cells(tables).collect()}
    assert cells[(0, 1, 1)] == "String\nOptional"
    assert cells[(0, 3, 0)] == "b\nc" and cells[(0, 3, 1)] == "x y"
    inner = [k for k in cells if k[0] != 0]
    assert [cells[k] for k in inner] == ["v"] and (0, 2, 0) not in cells


def test_row_narrower_than_bound_columns_is_dropped(shred):
    page = '<div class="table"><div><div>A</div><div>B</div></div><div><div>1</div></div><div><div>1</div><div>2</div></div></div>'
    headers = F.col("headers")
    tables = html.pseudo_tables(shred(page))
    both = {"a": html.column_of(headers, "a"), "b": html.column_of(headers, "b")}
    assert html.bind_columns(tables, both, ("a",)).count() == 1
    assert html.bind_columns(tables, both, ("a",), width=("a",)).count() == 2


def test_missing_required_column_gives_no_rows(shred):
    tables = html.pseudo_tables(shred(TABLE))
    roles = {"a": html.column_of(F.col("headers"), "absent")}
    assert html.bind_columns(tables, roles, ("a",)).count() == 0


def test_text_extraction_does_not_shuffle(spark):
    pages = spark.range(10).selectExpr("id AS page_id", "'/x' AS url", "'<p>a</p>' AS html")
    plan = html.clean_documents(pages.mapInArrow(html.shredder(html.LANDMARKS), html.schemas.TREES))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_deeply_nested_page_is_linear(shred):
    page = "<p>x" * 20000
    assert html.node_table(shred(page)).count() == 20000
    assert clean(shred(page), "leaf").count("x") == 20000


def test_odd_references_and_declarations_do_not_fail(shred):
    pages = ["<p>&#55357;&#56832;</p>", "<p>&#99999999999999999999;</p>", "<p>a</p><![foo bar]><p>b</p>", "<p>&#x110000;&#-1;</p>"]
    rows = shred(*pages).orderBy("page_id").collect()
    assert [r.error for r in rows] == [None] * 4
    text = ["".join(run.text for run in r.runs) for r in rows]
    assert text[0] == "\ufffd\ufffd" and text[2] == "ab" and "\ufffd" in text[1]


PIECES = ["<p>", "</p>", '<div class="a table">', "</div>", "text ", " \n", "&amp;", "&lt", "&#65;", "&#x42;", "&#", "&#12ab;", "&a-b;", "&", "<", "<b/>",
          "<br />", "<img src=x/>", "<img src='y' alt>", '<p class="x"  id="y">', "<script>var a='<p></p>';</script>", "<script>", "</script>", "<style>p{}</style>",
          "<title>t &amp; u</title>", "<TITLE>q</Title>", "<!-- c -->", "<!--", "-->", "<!doctype html>", "<![if x]>", "<?pi?>", "</>", "</ p>",
          '<a href="q?a=1&amp;b">', '<a href="x"/>', "<nav>", "</nav>", "<pre>", "  ", "</pre>", "<textarea>", ">", '"', "\x00", "<H1>", "</H1>", "<ſcript>", "&ſ;"]


def test_plain_constructs_read_as_by_the_base_class(monkeypatch):
    rnd = random.Random(3)
    pages = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(1, 20))) for _ in range(3000)]
    fast = [tree(page, True) for page in pages]
    assert TreeBuilder(html.LANDMARKS)._plain(PAGE) == len(PAGE)
    monkeypatch.setattr(TreeBuilder, "_plain", lambda self, page: 0)
    assert fast == [tree(page, True) for page in pages]


def test_headings_of_code_blocks_need_no_shuffle(spark, shred):
    trees = shred("<h1>One</h1><pre><code>a</code></pre><h2>T<b>wo</b></h2><p><pre><code>b</code></pre></p><h3> </h3><pre><code>c</code></pre>",
                  "<pre><code>d</code></pre><h1>late</h1>")
    inside = html.nearest_heading(trees)
    asked = html.nearest_heading(trees, html.code_blocks(trees))
    assert sorted(map(str, inside.select(asked.columns).collect())) == sorted(map(str, asked.collect()))
    assert [r.nearby_heading for r in inside.orderBy("page_id", "ord").collect()] == ["One", "Two", "", None]
    assert "hashpartitioning(page_id" not in inside._jdf.queryExecution().executedPlan().toString()


def test_many_narrow_rows_go_to_more_tasks(spark, monkeypatch, tmp_path):
    from docweave import session

    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "t"))
    spread = session.spread_small(spark.read.parquet(str(tmp_path / "t")))
    assert spread.rdd.getNumPartitions() == 50
    wide = spread.selectExpr("id", "repeat('x', 50) AS html")
    assert session.spread_small(wide) is wide


PIECES = (
    "<p>|</p>|<div class=\"a footer  table\">|</div>|<br>|<br/>|</br>|<b>|</b>|<pre>|</pre>|<code class=\"x\">|</code>| |\n |text|é世界|&amp;|&nbsp;|&#32;|&bogus;|"
    "&#x41;|&amp|&|<|<!-- c -->|<!-- a > b -->|<!DOCTYPE html>|<script>|</script>|<script src=\"x\">|if (a<b) \"<p>\"|<style>|</style>|<title>|</title>|<textarea>|"
    "</textarea>|<img src=\"a\" alt=\"b\"/>|<span/>|<template>|</template>|<nav>|</nav>|<UL>|</ul>|<li>|</li>|>|<a href=x>|</a>|<a title=\"a>b\">|<my-tag>|<?pi?>|</ p>|\r\n|\t\x0c"
).split("|")
PAIRS = [("<p>", "</p>"), ('<div class="footer b">', "</div>"), ("<pre>", "</pre>"), ("<code>", "</code>"), ("<nav>", "</nav>"), ("<script>", "</script>"), ("<title>", "</title>"),
         ("<li>", "</li>"), ("<template>", "</template>"), ('<b id="1">', "</B>"), ('<span x="y" x="z">', "</span>"), ('<style type="t">', "</STYLE>")]
LEAVES = ["text", " ", "\n", "&lt;", "a&amp;b", "&#32;", "<br>", '<img class="gatsby-highlight"/>', "<!-- x -->", "é", "<span/>", "  t  "]


def nested(rnd, depth):
    out = ""
    for _ in range(rnd.randint(0, 4)):
        if depth and rnd.random() < 0.6:
            start, end = rnd.choice(PAIRS)
            out += start + nested(rnd, depth - 1) + end
        else:
            out += rnd.choice(LEAVES)
    return out


def test_pages_read_together_have_the_trees_of_the_builder():
    rnd = random.Random(3)
    for attrs in (False, True):
        pages = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12))) for _ in range(800)] + [nested(rnd, 5) for _ in range(800)] + [None, "", "x", "<p></p>" * 5]
        pages += ["<i>" * 250 + "deep" + "</i>" * 250, "<p>é &amp; " * 20 + "</p>" * 20, "a<script>if (a<b) x = '<p>'</script>b"]
        rnd.shuffle(pages)
        for some in (pages, pages[:1], [""], [None, None]):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64()), pa.array(["u"] * len(some)), pa.array(some, pa.string())], names=["page_id", "url", "html"])
            got = {row["page_id"]: row for found in html_tree.shredder(html.LANDMARKS, attrs)(iter([batch])) for row in found.to_pylist()}
            rows = [(k, "u", "no content", [], []) if p is None else (k, "u", None, *html_tree.TreeBuilder(html.LANDMARKS, attrs).build(p)) for k, p in enumerate(some)]
            assert got == {row["page_id"]: row for row in html_tree._batch(rows).to_pylist()}


def test_well_nested_pages_are_read_together():
    page = '<!DOCTYPE html><main class="a b"><h2>A &amp; B</h2><br><pre> x\n</pre><script src="s">a<b</script></main> \n'
    data = np.frombuffer((page + "<p>open" + page).encode(), np.uint8)
    bounds = np.array([0, len(page), len(page) + 7, len(data)])
    good, nodes, runs = html_tree.read_together(data, bounds, html.LANDMARKS, False)
    assert good.tolist() == [True, False, True] and nodes[0].as_py() == nodes[2].as_py() and len(nodes[0]) == 5
    assert [r["text"] for r in runs[2].as_py()] == ["A & B", None, " x\n", "\n"]
