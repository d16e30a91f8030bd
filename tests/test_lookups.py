import pytest

from docweave import schemas as layouts
from docweave.operators import lookups, notes


@pytest.fixture
def endpoints(spark):
    return spark.createDataFrame([
        (1, 0, 0, "POST", "/v3/customers", "/d/c", "Create customer", False, None),
        (2, 0, 0, "GET", "/v3/customers/{id}", "/d/g", "Get customer", True, "old"),
        (3, 0, 0, "GET", "/v3/all/", "/d/a", "", False, None)], layouts.ENDPOINTS)


@pytest.fixture
def codes(spark):
    rows = [(1, 0, i, str(1000 + i), f"r{i}", "post /V3/customers", None, "/d") for i in range(25)]
    return spark.createDataFrame([*rows, (2, 0, 0, "2", "two", "GET /x/{id}", None, "/d"), (2, 0, 1, "3", "three", None, None, "/d")], layouts.ERROR_CODES)


@pytest.mark.parametrize("bound", [200_000, 0])
def test_errors_fall_back_only_without_exact_match(endpoints, codes, monkeypatch, bound):
    monkeypatch.setattr("docweave.functions.joins.BROADCAST_ROWS", bound)
    found = {}
    for r in lookups.errors_for_endpoint(endpoints, codes).orderBy("page_ord", "rank").collect():
        found.setdefault(r.page_ord, []).append((r.match, r.code, r.found))
    assert len(found[1]) == 20 and found[1][0] == ("exact", "1000", 25)
    assert found[2] == [("segment", "2", 26 - 25)]
    # An empty last segment is part of every endpoint text.
    assert len(found[3]) == 20 and found[3][0] == ("segment", "1000", 26)


def test_mentions(spark, endpoints):
    changes = spark.createDataFrame([
        (9, 1, 1, 0, None, "Soon", "upcoming", "/r", "New", "call /V3/CUSTOMERS now"), (9, 1, 1, 1, None, "Soon", "upcoming", "/r", "Create Customer", "again"),
        (9, 1, 2, 0, None, "Later", "upcoming", "/r", "Other", "nothing")],
        "page_ord BIGINT, sec_ord INT, entry_ord INT, change_ord INT, date DATE, raw_date STRING, section STRING, docs_path STRING, title STRING, body STRING")
    rows = sorted((r.page_ord, r.rank, r.title, r.found) for r in lookups.release_mentions(endpoints, changes).collect())
    assert rows == [(1, 1, "New", 1), (3, 1, "New", 2), (3, 2, "Other", 2)]


def test_listings(spark, endpoints, codes):
    assert [r.area for r in lookups.list_endpoints(endpoints).collect()] == ["all", "customers", "customers"]
    assert [r.code for r in lookups.list_error_codes(codes, "GET").collect()] == ["2"]
    assert lookups.list_error_codes(codes).first().code == "1000"


def test_suggestions(spark, endpoints):
    asked = spark.createDataFrame([(" get ", "/nope"), ("POST", "/v3/customers")], "method STRING, path STRING")
    rows = lookups.suggest_endpoints(asked, endpoints).orderBy("rank").collect()
    assert [r.suggestion for r in rows] == ["/v3/customers/{id}", "/v3/all/"]


def test_profile(spark, endpoints, codes):
    schemas = spark.createDataFrame([(1, 0, "X response", 2, [], "/d/c"), (1, 1, "Customer", 2, [], "/d/c")], layouts.SCHEMAS)
    changes = spark.createDataFrame([], "page_ord BIGINT, sec_ord INT, entry_ord INT, change_ord INT, date DATE, raw_date STRING, section STRING, docs_path STRING, title STRING, body STRING")
    rows = {r.path: r for r in lookups.describe_endpoints(endpoints, schemas, codes, changes).collect()}
    assert rows["/v3/customers"].schema_name == "Customer" and rows["/v3/customers"].n_errors == 25 and len(rows["/v3/customers"].errors) == 20
    assert rows["/v3/customers/{id}"].deprecated and rows["/v3/customers/{id}"].n_mentions == 0


NOTE = "intro\n## Customer lifecycle\n\n### tip\ntext\n---\nmore\n\n## 3YC & LGA (2024)\nbody\n## Blank\n\n## Customer lifecycle\nsecond"


def test_topics(spark):
    topics = notes.split_topics(spark.createDataFrame([("n", NOTE)], "note_id STRING, text STRING"))
    assert [r.topic for r in notes.list_topics(topics).collect()] == ["Customer lifecycle", "3YC & LGA (2024)", "Blank", "Customer lifecycle"]
    asked = spark.createDataFrame([("CUSTOMER_lifecycle",), ("3yc lga 2024",), ("blank",), ("no",)], "topic STRING")
    rows = {r.requested: r.body for r in notes.lookup_topics(asked, topics).collect()}
    assert rows == {"CUSTOMER_lifecycle": "### tip\ntext\n---\nmore", "3yc lga 2024": "body", "blank": None, "no": None}
    assert notes.missed_topics(asked, topics).count() == 2


def test_profile_shows_all_that_is_asked_for(spark, endpoints, codes):
    schemas = spark.createDataFrame([], layouts.SCHEMAS)
    changes = spark.createDataFrame(
        [(9, 1, k, 0, None, f"Note {k}", "upcoming", "/r", f"T{k}", "see /v3/customers") for k in range(8)],
        "page_ord BIGINT, sec_ord INT, entry_ord INT, change_ord INT, date DATE, raw_date STRING, section STRING, docs_path STRING, title STRING, body STRING")
    first = {r.path: r for r in lookups.describe_endpoints(endpoints, schemas, codes, changes).collect()}["/v3/customers"]
    assert (len(first.errors), first.n_errors, len(first.mentions), first.n_mentions) == (20, 25, 5, 8)
    full = {r.path: r for r in lookups.describe_endpoints(endpoints, schemas, codes, changes, 25, 8).collect()}["/v3/customers"]
    assert [e.code for e in full.errors] == [str(1000 + k) for k in range(25)]
    assert [m.title for m in full.mentions] == [f"T{k}" for k in range(8)]


CHANGES = "page_ord BIGINT, sec_ord INT, entry_ord INT, change_ord INT, date DATE, raw_date STRING, section STRING, docs_path STRING, title STRING, body STRING"


def test_mentions_are_counted_per_text_before_they_meet_the_endpoints(spark):
    words = ["alpha", "beta", "gamma", "", None]
    asked = [(k, 0, 0, "GET", words[k % 4], "/d", words[k // 4 % 5], False, None) for k in range(40)]
    bodies = ["alpha", "beta", "alpha beta", "gamma alpha", "none"]
    rows = [(9, 1, k // 2, k % 2, None, f"R{k}", "upcoming", "/r", f"T{k}", bodies[(k * k + k // 3) % 5]) for k in range(60)]
    table = spark.createDataFrame(asked, layouts.ENDPOINTS)
    expected = []
    for page, _, _, _, path, _, title, _, _ in asked:
        first = {}
        for r in rows:
            if any(w is not None and w in f"{r[8]} {r[9]}".lower() for w in (path, title)):
                first.setdefault(r[2], r[8])
        expected += [(page, rank + 1, first[e], len(first)) for rank, e in enumerate(sorted(first)[:4])]
    found = lookups.release_mentions(table, spark.createDataFrame(rows, CHANGES), 4)
    assert sorted((r.page_ord, r.rank, r.title, r.found) for r in found.collect()) == sorted(expected)


def test_no_row_per_endpoint_and_mention(spark):
    asked = [(k, 0, 0, "GET", "/hot", "/d", "Hot", False, None) for k in range(300)]
    rows = [(9, 1, k, 0, None, f"R{k}", "upcoming", "/r", f"T{k}", "the /hot call") for k in range(200)]
    found = lookups.release_mentions(spark.createDataFrame(asked, layouts.ENDPOINTS), spark.createDataFrame(rows, CHANGES))
    assert found.count() == 300 * 5 and {r.found for r in found.select("found").distinct().collect()} == {200}
    found.collect()

    def largest(node):
        name, at = node.nodeName(), node.metrics().get("numOutputRows")
        own = at.get().value() if "Join" in name and at.isDefined() else 0
        kids = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
        below = node.children()
        return max([own, *[largest(x) for x in kids], *[largest(below.apply(i)) for i in range(below.size())]])

    # Every endpoint with every mention would be 60,000 rows.
    assert 0 < largest(found._jdf.queryExecution().executedPlan()) <= 300 * 5
