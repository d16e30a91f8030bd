import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from docweave import schemas as layouts
from docweave.functions.text import canonical_path, NOTE_LIMIT, deprecation_note
from docweave.operators import cache, catalog, fetchlog, quality
from docweave.plans import answer, index_build
from docweave.sources import readers, snapshots

NOW = datetime.datetime(2024, 5, 2, 12, 0, 0)


@pytest.mark.parametrize("path,expected", [
    ("docs/a", "/docs/a"), ("/docs/a/", "/docs/a"), ("/", "/"), ("/docs/a", "/docs/a"), ("word", "/word"), ("//", ""), ("/a//", "/a")])
def test_canonical_paths(spark, path, expected):
    assert spark.createDataFrame([(path,)], "p STRING").select(canonical_path(F.col("p")).alias("c")).first().c == expected


@pytest.mark.parametrize("text,expected", [
    ("Fine. The field is deprecated now. More.", "The field is deprecated now"), ("undeprecated", None), ("", None),
    ("It reached end-of-life", "It reached end-of-life"), ("no longer support", None), ("No Longer Supported", "No Longer Supported"), ("\u00e9deprecated", None), ("x" * 300 + " sunset", "x" * 300 + " sunset")])
def test_deprecation(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t STRING").select(deprecation_note(F.col("t")).alias("d")).first().d == expected


def test_notes_are_cut_where_a_listing_asks_for_it(spark):
    long = spark.createDataFrame([("x" * 300 + " sunset",)], "t STRING")
    assert long.select(deprecation_note(F.col("t"), NOTE_LIMIT).alias("d")).first().d == "x" * 237 + "..."


def test_catalog_floor_fails_loudly(spark):
    paths = spark.range(49).selectExpr("concat('/p', id) AS path")
    with pytest.raises(Exception, match="catalog has only 49 paths"):
        catalog.catalog_floor(paths).collect()
    assert catalog.catalog_floor(paths.unionByName(spark.createDataFrame([("/x",)], "path STRING"))).first().found == 50


def test_listing_area_is_in_title_case(spark):
    rows = spark.createDataFrame([("/docs/3yc-flow_x/a", "t"), ("/a", "r")], "path STRING, title STRING")
    assert [r.area for r in catalog.list_catalog(rows).collect()] == ["Root", "3Yc Flow X"]


def test_tags(spark):
    rows = spark.createDataFrame([("/docs/order-flow/a_b", "The Order of Things, 3YC")], "path STRING, title STRING")
    assert catalog.derive_tags(rows).first().tags == sorted({"order", "flow", "order flow", "a b", "things", "3yc"})


ATTEMPTS = [
    ("ok", 0, 1, 200, None), ("swap", 0, 1, 404, None), ("swap", 1, 1, 200, None), ("gone", 0, 1, 404, None), ("gone", 1, 1, 404, None),
    ("retry", 0, 1, 502, None), ("retry", 0, 2, 200, None), ("same", 0, 1, 304, None), ("down", 0, 1, None, "timeout"), ("down", 1, 1, 200, None),
    ("late", 0, 1, 503, None), ("late", 0, 2, 404, None), ("late", 1, 1, 200, None), ("many", 0, 3, 500, None), ("many", 0, 4, 200, None),
    ("third", 0, 1, 404, None), ("third", 1, 1, 404, None), ("third", 2, 5, 200, None), ("only", 2, 4, 404, None)]


def test_fetch_resolution(spark):
    rows = [(p, v, a, s, e, "t", "marker text" if p != "swap" else "wall", NOW) for p, v, a, s, e in ATTEMPTS]
    resolved = fetchlog.resolve_fetch(spark.createDataFrame(rows, layouts.ATTEMPTS))
    kinds = {r.path: (r.variant_no, r.kind) for r in resolved.collect()}
    assert kinds == {"ok": (0, "ok"), "swap": (1, "ok"), "gone": (1, "not_found"), "retry": (0, "ok"), "same": (0, "not_modified"),
                     "down": (0, "transient"), "late": (1, "ok"), "many": (0, "ok"), "third": (2, "ok"), "only": (2, "not_found")}
    good, bad = fetchlog.split_results(resolved, ("MARKER",))
    assert {r.path for r in bad.collect()} == {"gone", "down", "only", "swap"} and good.count() == 6


@pytest.fixture
def stored(spark):
    old, new = NOW - datetime.timedelta(hours=30), NOW - datetime.timedelta(hours=1)
    return spark.createDataFrame([("/fresh", "f", "1", new), ("/stale", "s", "2", old), ("/same", "m", "3", old), ("/failed", "x", "4", old)], layouts.CONTENT_CACHE)


FETCHED = "path STRING, kind STRING, body STRING, etag STRING, ts TIMESTAMP"


def test_refresh_cases(spark, stored):
    fetched = spark.createDataFrame([
        ("fresh", "ok", "new", "9", NOW), ("/stale/", "ok", "new", "9", NOW), ("/same", "not_modified", None, None, NOW),
        ("/failed", "transient", None, None, NOW), ("/none", "transient", None, None, NOW), ("/first", "ok", "one", None, NOW)], FETCHED)
    rows = {r.path: (r.outcome, r.content, r.etag) for r in cache.refresh_merge(stored, fetched, NOW).collect()}
    assert rows == {"/fresh": ("fresh", "f", "1"), "/stale": ("replaced", "new", "9"), "/same": ("revalidated", "m", "3"),
                    "/failed": ("stale", "x", "4"), "/none": ("error", None, None), "/first": ("replaced", "one", None)}


def test_fetches_count_in_order_of_time(spark, stored):
    def at(hours):
        return NOW + datetime.timedelta(hours=hours)

    fetched = spark.createDataFrame([
        ("/a", "transient", None, None, at(1)), ("/a", "ok", "a", "1", at(0)), ("/b", "ok", "late", "9", at(30)), ("/b", "ok", "b", "1", at(0)),
        ("/b", "ok", "soon", "2", at(5)), ("/c", "not_modified", None, None, at(0)), ("/c", "ok", None, "1", at(1)), ("/fresh", "ok", "n", "2", at(99)),
        ("/failed", "transient", None, None, at(0)), ("/failed", "not_modified", None, None, at(1)), ("/d", "ok", "x", "1", at(0)), ("/d", "ok", "y", "2", at(0)),
        (None, "ok", "z", "1", at(0))], FETCHED)
    rows = {r.path: (r.outcome, r.content, r.etag, r.fetched_at) for r in cache.refresh_merge(stored, fetched, NOW).collect()}
    assert rows["/a"] == ("replaced", "a", "1", at(0)) and rows["/b"] == ("replaced", "late", "9", at(30))
    assert rows["/c"] == ("error", None, None, None) and rows["/fresh"][:3] == ("fresh", "f", "1")
    assert rows["/failed"][:2] == ("revalidated", "x") and rows["/failed"][3] == at(1) and rows["/d"][1:3] == ("y", "2")
    assert None not in rows and cache.refresh_merge(stored.limit(0), fetched.limit(0), NOW).count() == 0


def test_cache_upkeep(spark, stored):
    batch = spark.createDataFrame([("stale", 1, "a"), ("/stale/", 2, "b"), ("/new", 1, "n")], "path STRING, seq INT, content STRING")
    rows = {r.path: (r.content, r.etag) for r in cache.put_many(stored, batch, NOW).collect()}
    assert rows["/stale"] == ("b", None) and rows["/new"] == ("n", None) and rows["/fresh"] == ("f", "1")
    gone = spark.createDataFrame([("stale/",), ("/absent",)], "path STRING")
    assert cache.invalidate(stored, gone).count() == 3 and cache.invalidate(stored).count() == 0
    stats = cache.cache_stats(stored, NOW).first()
    assert (stats.total, stats.fresh, stats.stale, stats.oldest_age_seconds) == (4, 1, 3, 30 * 3600.0)
    assert cache.cache_stats(stored.limit(0), NOW).first().oldest_age_seconds == 0.0
    exactly = spark.createDataFrame([("/x", "c", None, NOW - datetime.timedelta(days=1))], layouts.CONTENT_CACHE)
    assert not cache.classify_fresh(exactly, NOW).first().fresh


def test_snapshot_versions(spark, tmp_path):
    root = str(tmp_path / "index")
    assert snapshots.read_snapshot(spark, root, ("t",)) is None
    one = spark.createDataFrame([(1,)], "n INT")
    snapshots.write_snapshot({"t": one}, root, "1", NOW)
    two = spark.createDataFrame([(2,)], "n INT")
    two.write.parquet(f"{root}/v=2/t")  # no manifest: an unfinished write
    snapshots.write_snapshot({"t": two}, root, "3", NOW + datetime.timedelta(days=1), schema_version=4)
    assert snapshots.read_snapshot(spark, root, ("t",))["t"].first().n == 1
    snapshots.write_snapshot({"t": two}, root, "4", NOW + datetime.timedelta(hours=1), pages_parsed=7)
    read = snapshots.read_snapshot(spark, root, ("t",))
    assert read["t"].first().n == 2 and read["manifest"].first().pages_parsed == 7
    assert snapshots.read_snapshot(spark, root, ("absent",)) is None
    # The same name again: the later write counts; where its tables are damaged, the one before.
    again = snapshots.write_snapshot({"t": one}, root, "4", NOW + datetime.timedelta(hours=1))
    assert snapshots.read_snapshot(spark, root, ("t",))["t"].first().n == 1
    for part in pathlib.Path(again, "t").glob("*.parquet"):
        part.write_bytes(b"damaged")
    assert snapshots.read_snapshot(spark, root, ("t",))["t"].first().n == 2


def test_guarded_overwrite(spark, tmp_path):
    target, rows = str(tmp_path / "t"), spark.createDataFrame([(1,)], "n INT")
    snapshots.guarded_overwrite(rows.limit(0), target)
    snapshots.guarded_overwrite(rows.limit(0), target)
    snapshots.guarded_overwrite(rows, target)
    with pytest.raises(ValueError):
        snapshots.guarded_overwrite(rows.limit(0), target)
    assert spark.read.parquet(target).count() == 1


def test_gates(spark):
    errors = spark.createDataFrame([("/a", "x")], "path STRING, error STRING")
    pages = spark.createDataFrame([(4,)], "pages BIGINT")
    assert quality.failure_rate_gate(errors, pages).first().incomplete
    with pytest.raises(Exception, match="1 of 4 pages failed"):
        quality.failure_rate_gate(errors, pages, abort=True).collect()
    assert not quality.failure_rate_gate(errors.limit(0), pages, abort=True).first().incomplete
    counts = spark.createDataFrame([("endpoints", 10), ("error_codes", 19), ("status_codes", 8), ("schemas", 5)], "entity STRING, n BIGINT")
    checked = quality.structural_floors(counts)
    assert [r.entity for r in checked.where("NOT ok").collect()] == ["error_codes"]
    assert not quality.accept_snapshot(checked).first().accepted


def test_tiers(spark):
    rows = [("index", "remote", 5, 9), ("index", "baseline", 5, 9), ("index", "user-local", 4, 9), ("catalog", "user-local", 5, 0), ("catalog", "baseline", 5, 3), ("none", "remote", None, 0)]
    copies = spark.createDataFrame(rows, "name STRING, tier STRING, schema_version INT, rows BIGINT")
    assert {r.name: r.source for r in quality.resolve_tier(copies).collect()} == {"index": "remote", "catalog": "user-local"}
    assert {r.name: r.source for r in quality.resolve_tier(copies, need_rows=True).collect()} == {"index": "remote", "catalog": "baseline"}


def test_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3"), ("c", "4")], "k STRING, v STRING")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "4"), ("c", "3"), ("d", "1")], "k STRING, v STRING")
    assert {r.k: r.change for r in quality.diff_snapshots(old, new, ["k"]).collect()} == {"b": "changed", "d": "added"}
    assert quality.diff_snapshots(old, old, ["k"]).count() == 0


def test_missing_notes_are_an_empty_table(spark, tmp_path):
    assert readers.read_notes(spark, str(tmp_path / "none.md")).count() == 0


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>ä</p>", encoding="utf-8")
    assert readers.read_html_files(spark, str(tmp_path / "*.html")).first().html == "<p>ä</p>"


def test_rebuild_accepts_and_rejects(spark, tmp_path):
    root = str(tmp_path / "index")

    def table(head, rows):
        def line(cells):
            return "<div>" + "".join(f"<div>{c}</div>" for c in cells) + "</div>"
        return '<div class="table">' + line(head) + "".join(map(line, rows)) + "</div>"

    page = (
        table(("Endpoint", "Method"), [(f"/v3/e{i}", "POST") for i in range(12)])
        + table(("Error Code", "Reason"), [(i, "r") for i in range(25)])
        + table(("Status Code", "Description", "Applicable Resources"), [(i, "d", "Order") for i in range(9)])
        + "".join(f"<h2>S{i}</h2>" + table(("Property", "Type"), [("id", "String<br>Required")]) for i in range(6))
    )
    pages = spark.createDataFrame([(1, "/docs/a", page), (2, "/notes", "<h2>API changes</h2><h3>May 1, 2024</h3><p>x</p>")], layouts.PAGES)
    with pytest.raises(Exception, match="catalog has only 2 paths"):
        index_build.rebuild(pages, root, "0", NOW, "/notes", "/notes/up")
    assert index_build.rebuild(pages, root, "1", NOW, "/notes", "/notes/up", least_paths=2)
    thin = spark.createDataFrame([(1, "/docs/a", "<p>nothing</p>")], layouts.PAGES)
    for version in ("2", "1"):
        assert not index_build.rebuild(thin, root, version, NOW + datetime.timedelta(days=1), "/notes", "/notes/up", least_paths=1)
    read = snapshots.read_snapshot(spark, root, ("endpoints", "releases"))
    assert read["endpoints"].count() == 12 and read["releases"].count() == 1
    bodies = spark.createDataFrame([(1, "POST /v3/e3", "{}")], "body_id BIGINT, endpoint STRING, body STRING")
    issues = answer.validate_against_snapshot(spark, bodies, root).collect()
    assert [(i.rule, i.field) for i in issues] == [("missing_required", "id")]
    with pytest.raises(ValueError):
        answer.validate_against_snapshot(spark, bodies, str(tmp_path / "none"))
