import random

import pytest

from tesserae.llm import packing as K

S = "doc_id bigint, n_tokens int, fill int, items string, key string"


def pack(spark, sizes, parts=4, capacity=100):
    df = spark.createDataFrame([(i, n, 0, "z", "z") for i, n in enumerate(sizes)], S).repartition(parts, "doc_id")
    return K.pack(df, capacity=capacity)


def check(spark, sizes, **kw):
    capacity = kw.get("capacity", 100)
    rows = pack(spark, sizes, **kw).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.container_id, []).append(r)
    for rs in by.values():
        assert sum(r.n_tokens for r in rs) == rs[0].fill <= capacity
    seen: dict = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append((r.part_no, r.token_start, r.n_tokens))
    for i, n in enumerate(sizes):
        if not n or n < 0:
            assert i not in seen
            continue
        parts = sorted(seen[i])
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(x for *_, x in parts) == n
        assert len(parts) == -(-n // capacity) and all(a == p * capacity for p, a, _ in parts)
    return by


@pytest.mark.parametrize("seed", range(3))
def test_random_sizes(spark, seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randrange(1, 30), rnd.randrange(1, 101), rnd.randrange(90, 350)]) for _ in range(600)]
    by = check(spark, sizes)
    assert len(by) <= 1.03 * -(-sum(sizes) // 100) + 2


def test_defined_cases(spark):
    assert len(check(spark, [None, 0, -5, 50, 50, 100, 250])) == 5  # 50 + 50, 100, 100, 100 and the rest of 50
    assert check(spark, []) == {}
    assert len(check(spark, [51] * 40, parts=8)) == 40  # nothing fits together: it ends all the same
    assert len(check(spark, [34] * 6 + [66] * 6, parts=12)) <= 8  # pairs that lie in different partitions; alone they would take 12


def test_windows(spark, monkeypatch):
    assert len(check(spark, [60, 40] * 50, parts=1)) == 50
    real = K._pack

    def small(*a):
        K.WINDOW = 10
        return real(*a)

    monkeypatch.setattr(K, "WINDOW", 10)
    monkeypatch.setattr(K, "_pack", small)
    monkeypatch.setattr(K, "ROWS_PER_TASK", 8)
    check(spark, [random.Random(1).randrange(1, 100) for _ in range(200)], parts=3)
    check(spark, [70] * 60, parts=2)


def test_best_fit_takes_the_tightest():
    assert K.best_fit([60, 50, 40, 30, 10, 9], 100) == [[0, 2], [1, 3, 4, 5]]
    assert K.best_fit([], 10) == [] and K.best_fit([10, 10], 10) == [[0], [1]]


def test_report(spark):
    r = K.packing_report(pack(spark, [50, 50, 30]), 100).first()
    assert (r.n_containers, r.n_tokens, r.fullest, r.least_containers, float(r.unused_share)) == (2, 130, 100, 2, 0.35)
    assert K.packing_report(pack(spark, []), 100).first().n_containers == 0
