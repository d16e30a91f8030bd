import datetime

import pytest

from docweave.operators import releases

PAGE = """<main><h1>Notes</h1><h2>API changes</h2>
<h3>April 09, 2026</h3><h4>First</h4><p>body <b>one</b></p><ul><li>x</li><li>y</li></ul><h4>Second</h4><pre>code</pre>
<h3>Mar 3, 2026</h3><h4>Third</h4>
<h3>Earlier releases</h3><p>long ago</p><h6>aside</h6>
<h2>Other news</h2><h3>May 01, 2020</h3><p>ignored</p>
<h2>Sandbox changes</h2><h3>January 08, 2026</h3><h4>S</h4><p>s</p><h3>Earlier releases</h3></main>"""


@pytest.fixture
def entries(shred):
    return releases.parse_releases(shred(PAGE, "<p>no notes</p>"))


def test_entries(entries):
    rows = entries.orderBy("sec_ord", "entry_ord").collect()
    assert [(str(r.date), r.section, len(r.changes)) for r in rows] == [
        ("2026-04-09", "api_changes", 2), ("2026-03-03", "api_changes", 1), ("None", "earlier", 1),
        ("2026-01-08", "sandbox", 1), ("None", "earlier", 0)]


def test_change_bodies(entries):
    rows = entries.orderBy("sec_ord", "entry_ord").collect()
    assert [(c.title, c.body) for c in rows[0].changes] == [("First", "body one\n\n- x\n\n- y"), ("Second", "```\ncode\n```")]
    assert [(c.title, c.body) for c in rows[2].changes] == [("Earlier releases", "long ago\n\n**aside**")]


def test_since_is_inclusive_and_drops_undated(entries):
    assert releases.filter_since(entries, "2026-03-03").count() == 2
    with pytest.raises(ValueError):
        releases.filter_since(entries, "03/03/2026")


def test_section_filter_and_listing(entries):
    assert releases.filter_section(entries, "sandbox").count() == 1
    rows = releases.latest_releases(entries, 3).collect()
    assert [str(r.date) for r in rows] == ["2026-04-09", "2026-03-03", "2026-01-08"] and rows[0].total == 5
    grouped = releases.releases_by_section(entries, 20).collect()
    assert [r.section for r in grouped] == ["api_changes", "api_changes", "sandbox", "earlier", "earlier"]


def test_upcoming(shred):
    rows = releases.parse_upcoming(shred("<main><h1>Up</h1><p>Soon</p><p>Later</p></main>", "<main><h1>Up</h1></main>")).collect()
    assert [(r.page_ord, r.section, r.changes[0].body) for r in rows] == [(0, "upcoming", "Soon\n\nLater")]


@pytest.mark.parametrize("text,expected", [
    ("April 09, 2026", "2026-04-09"), ("apr 9, 2026", "2026-04-09"), (" MAY 1, 2020 ", "2020-05-01"),
    ("2026-04-09", None), ("Earlier releases from 2024", None), ("Month 1, 2020", None)])
def test_dates(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t STRING").select(releases.parse_release_date(releases.F.col("t")).alias("d")).first()
    assert (str(row.d) if row.d else None) == expected


def test_feature_status_and_digest(spark, entries):
    changes = releases.release_changes(entries)
    features = spark.createDataFrame([("FIRST body",), ("s s",), ("nothing",)], "feature STRING")
    rows = {r.feature: (r.status, str(r.date)) for r in releases.feature_status(features, changes).collect()}
    assert rows == {"FIRST body": ("Live", "2026-04-09"), "s s": ("In Sandbox", "2026-01-08"), "nothing": ("Not documented", "None")}
    digest = releases.release_digest(changes, datetime.date(2026, 4, 20)).collect()
    assert [(r.section, r.month, r.changes) for r in digest] == [("api_changes", "2026-04", 2)]


def test_since_filter_reaches_the_scan(spark, entries, tmp_path):
    entries.write.parquet(str(tmp_path / "releases"))
    recent = releases.filter_since(spark.read.parquet(str(tmp_path / "releases")), "2026-03-03").select("raw_date")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2026-03-03)" in plan and "ReadSchema: struct<date:date,raw_date:string>" in plan
    assert recent.count() == 2


def test_entries_are_cut_in_the_row_of_their_page(shred):
    """Siblings of several parents, blocks before any section or entry, blank headings; nothing is shuffled for them."""
    page = """<main><h3>May 01, 2026</h3><p>no section</p><h2>API changes</h2><p>intro</p><h4>no entry</h4><p>lost</p>
<h3>April 09, 2026</h3><p>before</p><h4>A</h4><p>a</p><section><h3>Jan 01, 2020</h3><h2>Sandbox</h2><p>x</p><h3>Jan 2, 2020</h3><p>in</p></section><p>after</p>
<h3></h3><p> </p><h4></h4><p>b</p></main>"""
    found = releases.parse_releases(shred(page))
    rows = found.orderBy("sec_ord", "entry_ord").collect()
    assert [(r.raw_date, r.section, [tuple(c) for c in r.changes]) for r in rows] == [
        ("April 09, 2026", "api_changes", [("A", "a\n\nJan 01, 2020 Sandbox x Jan 2, 2020 in\n\nafter")]),
        ("", "earlier", [("", "b")]), ("Jan 2, 2020", "sandbox", [("Jan 2, 2020", "in")])]
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
