import datetime as dt
import random

from tesserae.operators import orphans

T0 = 1_700_000_000_000
F_ = "path string, name_key string, path_key string, ctime bigint, mtime bigint, id string, kind string, key string"
L_ = "id bigint, source string, target string, target_key string, target_path_key string, at string, kind string, n string"
C_ = "change_id bigint, path string, type string, happened_at timestamp"


def tables(spark, files, links, changes, assets=("png",)):
    base = dt.datetime(2024, 1, 1)
    return (
        spark.createDataFrame([(a, b, c, d, e, "z", "z", "z") for a, b, c, d, e in links], L_),
        spark.createDataFrame([(p, n, k, c, m, "z", "z", "z") for p, n, k, c, m in files], F_),
        spark.createDataFrame([(i, p, t, base + dt.timedelta(seconds=s)) for i, p, t, s in changes], C_),
        spark.createDataFrame([(a,) for a in assets], "extension string"),
    )


def ids(t):
    return sorted(r.id for r in orphans.orphan_links(*t).collect())


def test_cases(spark):
    files = [("v/a.md", "a", "v/a", T0, T0 + 10), ("v/b.md", "b", " V/B ", T0 + 50, T0 + 50), ("w/c.md", "c", "w/c", T0, T0), ("w/d.md", "d", "w/d", T0, T0)]
    links = [
        (1, "v/a.md", "A", " A ", None),  # found: case and blanks
        (2, "v/a.md", "b", "b", None),  # created later
        (3, "v/b.md", "V/B", "zzz", "v/b "),  # found by path only
        (4, "v/b.md", "V/x", "a", "v/x"),  # the name is not looked at
        (5, "v/b.md", "c", "c", None),  # deleted
        (6, "v/b.md", "d", "d", None),  # deleted and back
        (7, "v/b.md", "x.PNG", "x", None),  # asset
        (8, "v/b.md", "", "none", None),
        (9, "v/b.md", "  ", "none", None),
        (10, "v/b.md", None, "none", None),
        (11, "gone.md", "none", "none", None),  # no source, no period
        (12, "w/c.md", "nowhere", "nowhere", None),  # a deleted source counts
        (12, "w/c.md", "nowhere", "nowhere", None),
        (13, "v/b.md", "odd", None, None),
    ]
    changes = [(1, "w/c.md", "add", 1), (2, "w/c.md", "unlink", 9), (3, "w/c.md", "change", 5), (4, "w/d.md", "unlink", 1), (5, "w/d.md", "add", 2), (2, "w/c.md", "unlink", 9)]
    t = tables(spark, files, links, changes)
    assert ids(t) == [2, 4, 5, 12, 13]
    assert {r.period for r in orphans.orphan_links(*t).collect()} == {"2023-11"}
    assert {(r.vault, r.n_orphans) for r in orphans.orphan_counts(*t).collect()} == {("v", 4), ("w", 1)}


def test_empty_tables(spark):
    assert ids(tables(spark, [], [], [])) == []
    t = tables(spark, [("v/a.md", None, None, None, T0)], [(1, "v/a.md", "a", "a", None)], [])
    assert ids(t) == [1]  # a note without ctime and keys suits nobody


def test_hot_key_against_a_loop(spark, monkeypatch):
    rnd = random.Random(5)
    files = [(f"v{i % 7}/n{i}.md", f"n{i % 40}", f"v{i % 7}/n{i}", T0 + rnd.randrange(100), T0 + rnd.randrange(100)) for i in range(120)]
    links = []
    for i in range(900):
        hot = i % 3 == 0
        key = "n0" if hot else f"n{rnd.randrange(60)}"
        links.append((i, rnd.choice(files)[0], key, key, f"v{rnd.randrange(7)}/n{rnd.randrange(130)}" if rnd.random() < 0.4 and not hot else None))
    mtime = {f[0]: f[4] for f in files}
    want = []
    for i, s, _, k, p in links:
        ok = any((f[2] == p if p is not None else f[1] == k) and f[3] <= mtime[s] for f in files)
        if not ok:
            want.append(i)
    t = tables(spark, files, links, [])
    assert ids(t) == sorted(want)
    for share in (0.0, 1.0):  # all groups are heavy, none is
        monkeypatch.setattr(orphans, "HEAVY_SHARE", share)
        assert ids(t) == sorted(want) and sum(r.n_orphans for r in orphans.orphan_counts(*t).collect()) == len(want)
    counts = orphans.orphan_counts(*t)
    assert sum(r.n_orphans for r in counts.collect()) == len(want)
