import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.vault import NOTES, catalog, frame

from tesserae.operators import actions, events, scan
from tesserae.plans.catalog import Catalog
from tesserae.plans.dql.syntax import NotIndexed
from tesserae.sources import notes as N
from tesserae.sources.layout import Layout
from tesserae.streaming.debounce import Accumulator
from tesserae.streaming.pipeline import Runner, run_scan

EVENT = "path string, type string, mtime bigint, size bigint, seq bigint"


def fold_by_hand(rows):
    out = {}
    for path, kind, mtime, size, seq in rows:
        if path not in out:
            out[path] = (kind, mtime, size, seq)
            continue
        old, _, _, first = out[path]
        gone = kind == "unlink"
        new = ("cancel" if gone else "add") if old == "add" else ("unlink" if gone else "change")
        if new == "cancel":
            del out[path]
        else:
            out[path] = (new, mtime, size, first)
    return out


def test_fold_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(events, "PIECE", 7)  # histories of many pieces
    rnd = random.Random(3)
    rows = [(rnd.choice("abcde"), rnd.choice(["add", "change", "unlink"]), rnd.choice([None, i]), i, i) for i in range(200)]
    got = {r.path: (r.type, r.mtime, r["size"], r.first_seq) for r in events.fold(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == fold_by_hand(rows)
    again = [(p, t, m, s, q) for p, (t, m, s, q) in got.items()]
    if again:
        assert {r.path: r.type for r in events.fold(spark.createDataFrame(again, EVENT)).collect()} == {p: t for p, (t, *_) in got.items()}
    assert events.fold(spark.createDataFrame([], EVENT)).count() == 0


def test_routing(spark):
    rows = [("pkm/a.md", "add", 1, 1, 1), ("pkm/x/b.md", "unlink", 1, 1, 2), ("c.md", "change", 1, 1, 3)]
    e = spark.createDataFrame(rows, EVENT)
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(events.match(e, None, ["pkm/**"])) == ["pkm/a.md", "pkm/x/b.md"]
    assert paths(events.match(e, ["add", "change"], ["*", "pkm/*"])) == ["c.md", "pkm/a.md"]
    assert paths(events.match(e, [], None)) == []


def flushes_by_hand(times, wait, max_wait):
    """Loop over a clock: a batch ends at the first moment that is ``wait`` after its last or ``max_wait`` after its first push."""
    out, held = [], []
    for now in range(times[-1] + max_wait + 1):
        if held and (now >= held[-1] + wait or now >= held[0] + max_wait):
            out.append((now, held))
            held = []
        held = held + [now] * times.count(now)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=12), st.integers(1, 20), st.integers(1, 40))
def test_accumulator_against_a_clock(times, wait, max_wait):
    times, acc, got = sorted(times), Accumulator(wait, max_wait), []
    for now in range(times[-1] + max_wait + 1):
        if acc.due(now):
            assert acc.next_due() <= now
            got.append((now, acc.flush()))
        for _ in range(times.count(now)):
            acc.push(now, now)
    assert got == flushes_by_hand(times, wait, max_wait) and not acc.due(10**9)


def test_batches_of_a_log(spark):
    rnd = random.Random(4)
    rows = [(k, t) for k in ("a", "b") for t in sorted(rnd.randrange(300) for _ in range(60))] + [("c", 5)]
    df = spark.createDataFrame(rows, "k string, ms bigint").selectExpr("k", "timestamp_millis(ms) AS ts")
    got = {}
    for r in events.batches(df, "k", "ts", 7, 25).selectExpr("k", "unix_millis(first_ts) AS a", "unix_millis(last_ts) AS z", "n_events", "unix_millis(flushed_at) AS f").collect():
        got.setdefault(r.k, []).append((r.f, r.a, r.z, r.n_events))
    for k in ("a", "b", "c"):
        want = [(now, held[0], held[-1], len(held)) for now, held in flushes_by_hand(sorted(t for x, t in rows if x == k), 7, 25)]
        assert sorted(got[k]) == want
    assert events.batches(df.limit(0), "k", "ts", 7, 25).count() == 0


def test_diff_and_merge(spark):
    c = catalog(spark)
    later = dict(NOTES)
    del later["Food/Plan.md"]
    later["Work/Old.md"] += "more [[Start]] #new\n"
    later["New.md"] = "- [ ] a #fresh\n"
    listing = frame(spark, later)
    listing = listing.withColumn("mtime", __import__("pyspark.sql.functions", fromlist=["x"]).expr("CASE WHEN path IN ('Work/Old.md') THEN mtime + 5 ELSE 1700000000000 + element_at(map('Start.md',0L,'Work/Plan.md',1L,'Food/Recipe.md',3L,'Daily/2026-01-01.md',5L,'New.md',9L), path) END"))
    kinds = {r.path: r.kind for r in scan.diff(listing, c.files).collect()}
    assert {p: k for p, k in kinds.items() if k != "unchanged"} == {"Food/Plan.md": "deleted", "Work/Old.md": "modified", "New.md": "added"}
    assert {r.dir: (r.added, r.modified, r.deleted) for r in scan.by_dir(scan.diff(listing, c.files)).collect()} == {".": (1, 0, 0), "Food": (0, 0, 1), "Work": (0, 1, 0)}
    assert scan.diff(listing, c.files, ["Food"]).filter("kind = 'deleted'").count() == 0
    assert [p.remaining for p in scan.scan_batches(c, listing, dry_run=True)] == [3]
    steps = list(scan.scan_batches(c, listing, batch_size=1))
    assert steps[-1].remaining == 0 and steps[-1].done == 3
    end = steps[-1].catalog
    assert scan.diff(listing, end.files).filter("kind <> 'unchanged'").count() == 0
    assert end.tags.filter("tag IN ('new', 'fresh')").count() == 2 and end.tags.filter("file_path = 'Food/Plan.md'").count() == 0
    fresh = {r.path for r in catalog(spark, later).files.collect()}
    assert {r.path for r in end.files.collect()} == fresh


def test_same_size_and_time_needs_rehash(spark):
    a, b = frame(spark, {"x.md": "one"}), frame(spark, {"x.md": "two"})
    assert scan.diff(b, a).first().kind == "unchanged" and scan.diff(b, a, rehash=True).first().kind == "modified"


def test_write_and_read_tables(spark, tmp_path):
    d = str(tmp_path / "index")
    with pytest.raises(NotIndexed):
        Catalog.from_parquet(spark, d)
    catalog(spark).write("file://" + d)
    catalog(spark).write("file://" + d)  # a refresh replaces
    assert Catalog.from_parquet(spark, d).files.count() == 6 and Catalog.from_parquet(spark, "file://" + d).inline_fields.count() > 0
    os.makedirs(d + "/version-000000003/files.parquet")  # a writer that died: no marker
    assert Catalog.from_parquet(spark, d).files.count() == 6
    catalog(spark).write("file://" + d)
    assert sorted(os.listdir(d)) == ["version-000000002", "version-000000003"]


def make(tmp_path, notes=NOTES):
    for p, t in notes.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t, encoding="utf-8")
    return str(tmp_path)


def test_listing(spark, tmp_path):
    root = make(tmp_path / "v")
    for p in ("_draft.md", ".hidden.md", ".git/x.md", "UP.MD", "a.png", "deep/er/_x/y.md"):
        make(tmp_path / "v", {p: "x"})
    os.symlink(os.path.join(root, "Start.md"), os.path.join(root, "link.md"))
    want = {*NOTES, "_draft.md", "UP.MD", "deep/er/_x/y.md"}
    assert {r.path for r in N.notes(spark, root).collect()} == want
    spark.dataSource.register(N.NotesDataSource)
    df = spark.read.format("tesserae_notes").option("roots", root).load()
    assert {r.path for r in df.collect()} == want
    assert N.list_files(spark, Layout.of(root), notes_only=False).filter("path = 'a.png'").count() == 1


def test_layout(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    two = Layout.of([a, b, a + "/inner"])
    assert two.roots == (a, b) and two.key(a + "/inner/n.md") == "a/inner/n.md" and two.absolute("b/n.md") == b + "/n.md"
    assert Layout.of(a).key(a + "/n.md") == "n.md"
    for bad in ([], [str(tmp_path / "x/v"), str(tmp_path / "y/v")]):
        with pytest.raises(ValueError):
            Layout.of(bad)
    with pytest.raises(ValueError):
        two.absolute("c/n.md")
    with pytest.raises(FileNotFoundError):
        N.present_roots(Layout.of(a))


def test_config(tmp_path):
    make(tmp_path, {"home/.tesserae/config.json": '{"a": {"x": 1, "y": 1}, "b": 1}', "p/.tesserae/config.yaml": "a:\n  y: 2\n"})
    assert N.merged_config(str(tmp_path / "p"), str(tmp_path / "home")) == {"a": {"x": 1, "y": 2}, "b": 1}
    assert N.emit({"a": 1}) == '{\n  "a": 1\n}' and N.emit({"a": 1}, "yaml") == "a: 1\n"


def test_json5():
    text = """// settings
{ plain: 'it\\'s "x"', "url": "http://a//b", /* gone, } */ list: [1, .5, +2, 0x1F, 5., -.25e1, 'a,]',], $k: null, t: true, n: 'a\\
b' ,}"""
    assert N.read_json5(text) == {"plain": 'it\'s "x"', "url": "http://a//b", "list": [1, 0.5, 2, 31, 5.0, -2.5, "a,]"], "$k": None, "t": True, "n": "ab"}
    assert N.read_json5("[]") == [] and N.read_json5("-Infinity") == float("-inf")


def test_watch_offsets_are_numbers(tmp_path):
    root, state = make(tmp_path / "v", {"a.md": "x"}), str(tmp_path / "state")
    r = N.WatchReader(Layout.of(root), 0, state)
    first = r.initialOffset()
    assert first == {"version": 0} and r.read(first)[1] == first
    make(tmp_path / "v", {"b.md": "y"})
    os.remove(os.path.join(root, "a.md"))
    events, end = r.read(first)
    assert [(e[0], e[1]) for e in events] == [("b.md", "add"), ("a.md", "unlink")] and end == {"version": 1}
    again = N.WatchReader(Layout.of(root), 0, state)  # after a restart
    assert [(e[0], e[1]) for e in again.readBetweenOffsets(first, end)] == [("b.md", "add"), ("a.md", "unlink")] and again.read(end)[1] == end
    again.commit({"version": 5})
    assert os.listdir(state) == []


def test_own_writes_are_forgotten_one_by_one(spark, tmp_path):
    r = Runner(spark, Layout.of(make(tmp_path / "v", {"a.md": "x"})), Catalog.from_tables(spark), actions.Pipeline.of({"actions": ["index"]}))
    r._written = {"a.md": 10_000, "b.md": 10_000}
    own = lambda *rows: sorted((x.path, x.seq) for x in r._without_own(spark.createDataFrame(list(rows), EVENT)).collect())
    assert own(("a.md", "change", 10_050, 1, 1), ("c.md", "change", 10_000, 1, 2)) == [("c.md", 2)]
    assert own(("b.md", "unlink", None, None, 3)) == [("b.md", 3)] and set(r._written) == {"b.md"}
    assert own(("b.md", "change", 13_000, 1, 4)) == [("b.md", 4)] and not r._written  # a later change is no echo


def test_pipeline_over_a_scan(spark, tmp_path):
    root = make(tmp_path / "v", {"a.md": "---\ntag: x\n---\n", "b.md": "---\nstatus: done\ntag: y\n---\n", "c/bad.md": "---\n: [\n---\n"})
    cfg = {"actions": ["index", "normalize", "set seen=true"], "where": "LIST WHERE status = \"done\" OR file.name = \"bad\""}
    r = Runner(spark, Layout.of(root), Catalog.from_tables(spark), actions.Pipeline.of(cfg), write=True)
    run_scan(r)
    assert r.reports == [{"total": 2, "changed": 1, "skipped": 0, "failed": 1, "dry_run": False}]
    assert (tmp_path / "v/b.md").read_text() == "---\nstatus: done\ntags:\n- y\nseen: true\n---\n"
    assert (tmp_path / "v/a.md").read_text() == "---\ntag: x\n---\n" and r.catalog.files.count() == 3


def test_following_files(spark, tmp_path):
    root = make(tmp_path / "v", {"old.md": "x"})
    os.utime(os.path.join(root, "old.md"), (1, 1))
    seen = []
    p = actions.Pipeline.of({"actions": ["normalize"], "debounce": {"wait": 200, "maxWait": 1000}, "dryRun": True})
    r = Runner(spark, Layout.of(root), Catalog.from_tables(spark), p, hook=lambda df: seen.extend(df.select("path", "type").collect()))
    q = r.start(stable_ms=20, checkpoint=str(tmp_path / "cp"))
    try:
        deadline = time.time() + 90
        while q.lastProgress is None and time.time() < deadline:
            time.sleep(0.2)
        make(tmp_path / "v", {"new.md": "y"})
        while not any(x.path == "new.md" for x in seen) and time.time() < deadline:
            time.sleep(0.3)
        os.remove(os.path.join(root, "old.md"))
        while not any(x.path == "old.md" for x in seen) and time.time() < deadline:
            time.sleep(0.3)
    finally:
        q.stop()
    assert ("new.md", "add") in {(x.path, x.type) for x in seen} and ("old.md", "unlink") in {(x.path, x.type) for x in seen}
