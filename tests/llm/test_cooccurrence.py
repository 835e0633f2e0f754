import os
import random
from collections import Counter
from itertools import combinations

import pytest

from tesserae.llm import cooccurrence as C

T = "file_path string, tag string, basket string, item string, n string, fresh string"


def tags(spark, rows):
    return spark.createDataFrame([(f, t, "z", "z", "z", "z") for f, t in rows], T)


def brute(baskets):
    return Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))


def held(table):
    return {(r.item_a, r.item_b): r.n for r in table.pairs.collect()}


def of(spark, d):
    return spark.createDataFrame([(b, t) for b, s in d.items() for t in s], "basket string, item string")


def files(table, name):
    root = f"{table.directory.removeprefix('file://')}/{name}"
    return {(b, f) for b, v in table.buckets[name].items() for f in os.listdir(f"{root}/v={v}/b={b}")}


@pytest.mark.parametrize("wide,few", [(500, 10**6), (2, 0)])
def test_updates_against_brute_force(spark, monkeypatch, wide, few):
    monkeypatch.setattr(C, "WIDE", wide)  # 2: baskets of three and more go the way of wide ones
    monkeypatch.setattr(C, "BROADCAST_ITEMS", few)
    rnd = random.Random(11)
    make = lambda: {rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 6))}
    baskets = {f"b{i}": make() for i in range(30)}
    table = C.update(C.create(spark, side=2), of(spark, baskets))
    assert held(table) == brute(baskets)
    for k in range(10 if wide == 500 else 3):  # some change, one is repeated unchanged, some go, new ones come
        changed = {f"b{rnd.randrange(30)}": make() for _ in range(4)} | {"b29": baskets["b29"]} | {f"new{k}{j}": {"a", "z"} for j in range(2)}
        gone = {f"b{rnd.randrange(20)}", f"new{k - 1}0", "never"} - set(changed)
        table = C.update(table, of(spark, changed), spark.createDataFrame([(g,) for g in gone], "basket string"))
        baskets = {b: s for b, s in (baskets | changed).items() if b not in gone}
        n = Counter(t for s in baskets.values() for t in s)
        assert held(table) == brute(baskets) and table.n_baskets == len(baskets)
        assert {r.item: r.n for r in table.marginals.collect()} == dict(n)
        assert all(r.n_a == n[r.item_a] and r.n_b == n[r.item_b] for r in table.pairs.collect())


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    d = f"file://{tmp_path}/pairs"
    first = C.update(C.create(spark, d, side=4), of(spark, {f"b{i}": {f"i{i % 40}", f"i{(i * 7 + 1) % 40}", f"i{(i * 3 + 2) % 40}"} for i in range(200)}))
    before = {n: files(first, n) for n in C.SCHEMAS}
    loaded = C.load_table(spark, d)  # another session finds the same version
    assert loaded == first and held(loaded) == held(first)
    second = C.update(loaded, of(spark, {"b0": {"i0", "i1", "i2", "i5"}}))  # gains i5
    after = {n: files(second, n) for n in C.SCHEMAS}
    assert second.n_baskets == 200 and C.load_table(spark, d).version == 2
    rewritten = {n: {b for b, _ in after[n] - before[n]} for n in C.SCHEMAS}
    assert len(rewritten["baskets"]) == len(rewritten["items"]) == 1
    assert 0 < len(rewritten["pairs"]) <= 2 * 4 - 1  # the row and the column of i5
    assert held(first) != held(second)  # the version before can still be read
    assert C.update(second, of(spark, {"b0": {"i0", "i1", "i2", "i5"}})) is second
    with pytest.raises(ValueError):
        C.create(spark, d)


def test_dirty_tags_and_scores(spark):
    rows = [(f"n{i}", t) for i in range(5) for t in ("#A ", "a", " b")] + [(f"m{i}", "c") for i in range(20)]
    rows += [("n0", None), ("n0", "#"), ("n0", ""), (None, "a"), ("n1", "#A ")]
    df = tags(spark, rows)
    table = C.update(C.create(spark), C.baskets_of(df))
    got = C.associations(table).collect()
    assert [(r.tag_a, r.tag_b, r.n_ab, r.n_a, r.n_b, r.n, r.lift) for r in got] == [("a", "b", 5, 5, 5, 25, 5.0)]
    assert C.associated(C.associations(table)).count() == 1 and C.associated(C.associations(table), 6).count() == 0
    assert C.associations(table, min_support=6).count() == 0


def test_equal_baskets_and_empty_table(spark):
    df = tags(spark, [(f"n{i}", t) for i in range(300) for t in "abc"])
    assert held(C.update(C.create(spark), C.baskets_of(df))) == {("a", "b"): 300, ("a", "c"): 300, ("b", "c"): 300}
    none = tags(spark, [])
    table = C.update(C.create(spark), C.baskets_of(none))
    assert held(table) == {} and table.n_baskets == 0 and C.associations(table).count() == 0
