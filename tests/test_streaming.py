import datetime
import random
import shutil

from docweave import schemas as layouts
from docweave.operators import cache
from docweave.streaming import jobs, log, state
from workload import conformance_q

START = datetime.datetime(2024, 5, 1)
FETCHED = "path STRING, kind STRING, body STRING, etag STRING, ts TIMESTAMP"


def at(hours):
    return START + datetime.timedelta(hours=hours)


BATCHES = [
    [("/a", "ok", "a1", "e1", at(0)), ("/b", "ok", "b1", None, at(0)), ("/c", "transient", None, None, at(0))],
    [("/a", "ok", "a2", "e2", at(5)), ("/b", "not_modified", None, None, at(30)), ("/c", "ok", "c1", "e", at(30))],
    [("/a", "ok", "a3", "e3", at(40)), ("/b", "transient", None, None, at(80)), ("/c", "ok", "c0", "old", at(10))],
]


def test_refresh_by_batches_equals_the_table_form(spark, tmp_path):
    root = str(tmp_path / "log")
    state = spark.createDataFrame([], layouts.CONTENT_CACHE)
    for number, rows in enumerate(BATCHES):
        # Results older than what is stored are ignored by the stream; leave them out here.
        stored = {r.path: r.fetched_at for r in state.collect()}
        usable = [r for r in rows if r[0] not in stored or r[4] >= stored[r[0]]]
        merged = []
        for row in usable:
            one = spark.createDataFrame([row], FETCHED)
            mine = state.where(state.path == row[0])
            merged += cache.refresh_merge(mine, one, row[4]).where("content IS NOT NULL").drop("outcome").collect()
        done = {r.path for r in merged}
        state = spark.createDataFrame([r for r in state.collect() if r.path not in done] + merged, layouts.CONTENT_CACHE)
        jobs.apply_batch(spark.createDataFrame(rows, FETCHED), number, root)
        jobs.apply_batch(spark.createDataFrame(rows, FETCHED), number, root)  # a repeated batch changes nothing
        assert sorted(map(tuple, jobs.current_cache(spark, root).collect())) == sorted(map(tuple, state.collect()))
        if number == 1:
            jobs.compact_cache(spark, root, 1)
            assert sorted(map(tuple, jobs.current_cache(spark, root).collect())) == sorted(map(tuple, state.collect()))
    final = {r.path: r.content for r in jobs.current_cache(spark, root).collect()}
    assert final == {"/a": "a3", "/b": "b1", "/c": "c1"}


def test_any_cut_of_a_log_gives_the_same_cache(spark, tmp_path):
    rnd = random.Random(4)
    log = sorted(
        ((f"/p{rnd.randrange(6)}", kind := rnd.choice(["ok", "not_modified", "transient", "permanent"]), f"b{k}" if kind == "ok" else None, f"e{k}", at(rnd.randrange(200)))
         for k in range(120)), key=lambda r: r[4])
    state = {}
    order = {"ok": 0, "not_modified": 1, "transient": 2, "permanent": 2}
    for path, kind, body, etag, ts in sorted(log, key=lambda r: (r[4], order[r[1]], [-ord(c) for c in r[2] or ""])):
        content, _, since = old = state.get(path, (None, None, None))
        if content is None or ts - since >= datetime.timedelta(days=1):
            state[path] = (body, etag, ts) if kind == "ok" else (*old[:2], ts) if kind == "not_modified" and content else old
    expected = sorted((p, *s) for p, s in state.items() if s[0] is not None)
    times = sorted({r[4] for r in log})
    for cuts in ([], [times[len(times) // 2]], [times[len(times) // 5], times[len(times) // 2], times[-3]]):
        root = str(tmp_path / f"log{len(cuts)}")
        edges = [times[0], *cuts, times[-1] + datetime.timedelta(hours=1)]
        for number, (low, high) in enumerate(zip(edges, edges[1:])):
            part = [r for r in log if low <= r[4] < high]
            jobs.apply_batch(spark.createDataFrame(part, FETCHED), number, root)
        assert sorted(map(tuple, jobs.current_cache(spark, root).collect())) == expected


def keyed_run(spark, root, parts, ttl=24 * 3600, keep_ms=None):
    """Write parts of a log one after the other and drain the stream after the last."""
    for part in parts:
        spark.createDataFrame(part, FETCHED).coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(FETCHED).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    state.keyed_refresh_stream(source, f"{root}/changes", f"{root}/checkpoint", ttl, keep_ms).awaitTermination()
    return sorted(map(tuple, state.keyed_cache(spark, f"{root}/changes").collect()))


def test_keyed_state_equals_a_loop_for_any_cut(spark, tmp_path):
    rnd = random.Random(11)
    log = sorted(
        ((f"/p{rnd.randrange(5)}" if k % 17 else None, kind := rnd.choice(["ok", "ok", "not_modified", "transient"]), f"b{k}" if kind == "ok" and k % 13 else None, f"e{k}", at(rnd.randrange(200)))
         for k in range(150)), key=lambda r: r[4])
    entries = {}
    rank = {"ok": 0, "not_modified": 1, "transient": 2}
    for path, kind, body, etag, ts in sorted(log, key=lambda r: (r[4], rank[r[1]] if r[2] or r[1] != "ok" else 2, [-ord(c) for c in r[2] or ""])):
        old = entries.get(path)
        if path and not (old and ts - old[2] < datetime.timedelta(days=1)):
            if kind == "ok" and body:
                entries[path] = (body, etag, ts)
            elif kind == "not_modified" and old:
                entries[path] = (*old[:2], ts)
    expected = sorted((p, *e) for p, e in entries.items())
    times = sorted({r[4] for r in log})
    for number, cuts in enumerate(([], [times[len(times) // 2]], [times[len(times) // 5], times[len(times) // 2], times[-3]])):
        edges = [times[0], *cuts, times[-1] + datetime.timedelta(hours=1)]
        parts = [[r for r in log if low <= r[4] < high] for low, high in zip(edges, edges[1:])]
        assert keyed_run(spark, str(tmp_path / f"log{number}"), parts) == expected


def test_late_fetch_changes_nothing_and_state_survives_a_restart(spark, tmp_path):
    root = str(tmp_path / "log")
    assert keyed_run(spark, root, [[("/a", "ok", "new", "e2", at(50))]]) == [("/a", "new", "e2", at(50))]
    assert keyed_run(spark, root, [[("/a", "ok", "old", "e1", at(10))]]) == [("/a", "new", "e2", at(50))]
    assert keyed_run(spark, root, [[("/a", "not_modified", None, None, at(90))]]) == [("/a", "new", "e2", at(90))]


def test_entries_leave_the_state_after_their_time(spark, tmp_path):
    import time

    outcomes = {}
    for keep, name in ((1500, "short"), (600_000, "long")):
        root = str(tmp_path / name)
        keyed_run(spark, root, [[("/a", "ok", "a1", "e1", at(0))]], keep_ms=keep)
        time.sleep(2)
        keyed_run(spark, root, [[("/a", "not_modified", None, None, at(30))]], keep_ms=keep)
        outcomes[name] = sorted(r.outcome for r in spark.read.parquet(f"{root}/changes").collect())
    # Gone from the state, a path that was not modified has nothing to renew.
    assert outcomes == {"short": ["error", "replaced"], "long": ["replaced", "revalidated"]}


def test_validate_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "bodies")
    bodies = conformance_q.bodies(spark, "/root/testdata/sf0.001")
    bodies.write.json(source)
    index = (conformance_q.endpoints(spark), conformance_q.schemas(spark), conformance_q.rules(spark))
    stream = spark.readStream.schema(bodies.schema).json(source)
    streamed = jobs.run_once(jobs.validate_stream(stream, *index), str(tmp_path / "out"))
    from docweave.operators import conformance

    assert sorted(map(repr, streamed.collect())) == sorted(map(repr, conformance.validate(bodies, *index).collect()))


def test_spans_cover_every_batch_once():
    for first in range(0, 20):
        for end in range(first, 90):
            found = list(log.spans(first, end))
            assert [n for a, b in found for n in range(a, b + 1)] == list(range(first, end))
            assert all((b - a + 1) in (1, 8, 64) and a % (b - a + 1) == 0 for a, b in found)
    assert [list(log.finished_spans(n)) for n in (0, 6, 7, 15, 63)] == [
        [], [], [(0, 7)], [(8, 15)], [(56, 63), (0, 63)]]


def test_log_reads_the_parts_of_its_paths_and_folds_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "FANOUT", 2)
    root = str(tmp_path / "log")
    expected = {}
    for number in range(6):
        rows = [(f"/p{k}", "ok", f"b{number}", "e", at(25 * number)) for k in range(number % 3, 9, 2)]
        expected |= {r[0]: r[2] for r in rows}
        for _ in range(2 if number in (1, 3) else 1):  # a repeated batch leaves its runs as they are
            jobs.apply_batch(spark.createDataFrame(rows, FETCHED), number, root)
        assert {r.path: r.content for r in jobs.current_cache(spark, root).collect()} == expected
    assert log.cover(spark, root, 6) == [(0, 3), (4, 5)] and log.cover(spark, root, 4) == [(0, 3)]
    wanted = spark.createDataFrame([("/p1",), ("/none",)], "path STRING")
    parts = {r[0] for r in wanted.select(log.part_of()).collect()}
    read = log.read(spark, root, jobs.LOG, 6, sorted(parts)).inputFiles()
    assert read and all(int(name.split("part=")[1].split("/")[0]) in parts and "/runs/" in name for name in read)
    assert [r.path for r in jobs.current_cache(spark, root, paths=wanted).collect()] == ["/p1"]
    # Runs whose marks are missing are not read: what they hold comes from the level below.
    bare = str(tmp_path / "bare")
    shutil.copytree(root, bare, ignore=lambda folder, names: [n for n in names if n == "last=3"])
    assert log.cover(spark, bare, 6) == [(0, 1), (2, 2), (3, 3), (4, 5)]
    assert {r.path: r.content for r in jobs.current_cache(spark, bare).collect()} == expected
    assert jobs.current_cache(spark, str(tmp_path / "nothing")).count() == 0


def test_a_path_takes_one_read_of_its_state():
    """Every call to the state store is a trip out of the Python worker, so an entry is read once and written if it changed."""
    from pyspark.sql import Row

    calls, held = [], {}

    class Entry:
        def exists(self):
            calls.append("exists")
            return "entry" in held

        def get(self):
            calls.append("get")
            return held.get("entry")

        def update(self, entry):
            calls.append("update")
            held["entry"] = entry

    processor = state.PathEntry(10, None)
    processor.entry = Entry()

    def run(time, rank):
        fetch = Row(at=time * 1_000_000, rank=rank, body="b", etag="e", digest="d")
        return [r.outcome for r in processor.handleInputRows(("/a",), iter([fetch]), None)]

    assert run(0, cache.FAILURE) + run(1, cache.SUCCESS) + run(5, cache.SUCCESS) + run(20, cache.UNCHANGED) == [
        "error", "replaced", "fresh", "revalidated"]
    assert held["entry"] == (20_000_000, "e", "d")
    assert calls == ["get", "get", "update", "get", "get", "update"]
