import random

import pytest

from tesserae.llm import neardup as N

F = "path string, content string, key string, cls string, node string, sig string, a0 string, similarity string"


def frame(spark, rows):
    return spark.createDataFrame([(p, t, "z", "z", "z", "z", "z", "z") for p, t in rows], F)


def words(rnd, n, pool=4000):
    return [f"w{rnd.randrange(pool)}" for _ in range(n)]


def edited(rnd, ws, k):
    ws = list(ws)
    for _ in range(k):
        i = rnd.randrange(len(ws))
        ws[i : i + 1] = rnd.choice([[], [f"e{rnd.randrange(10**6)}"], [ws[i], f"e{rnd.randrange(10**6)}"]])
    return ws


def corpus(seed=1, edits=14, groups=40):
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        base = words(rnd, rnd.randrange(60, 250))
        for m in range(rnd.randrange(1, 6)):
            rows.append((f"g{g}/m{m}.md", "---\nt: 1\n---\n" * (m % 2) + " ".join(edited(rnd, base, rnd.randrange(0, edits)))))
    rows += [(f"single{i}.md", " ".join(words(rnd, 80))) for i in range(200)]
    return rows


def brute(rows, threshold):
    sets = {p: set(s.tolist()) for p, t in rows if (s := N.shingles(t)) is not None}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def pairs(df):
    return {(r.key_a, r.key_b) for r in df.collect()}


def test_against_brute_force(spark):
    rows = corpus()
    want = brute(rows, 0.7)
    got = pairs(N.similar_pairs(frame(spark, rows)))
    assert len(want) > 40 and got <= want and len(got) >= 0.995 * len(want)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 1.0])
def test_recall_at_thresholds(spark, monkeypatch, threshold):
    """Small nodes are made rare, so that most pairs depend on deeper splits too."""
    monkeypatch.setattr(N, "SMALL", 8)
    rows = corpus(7, 40, 120)
    want = brute(rows, threshold)
    got = pairs(N.similar_pairs(frame(spark, rows), threshold=threshold))
    assert got <= want and len(got) >= 0.97 * len(want) and (threshold == 1.0 or len(want) > 30)


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.5, 0.7, 0.9])
def test_plan_keeps_the_target(threshold):
    p = N.plan(threshold)
    assert all(N.expected_recall(p, threshold, k) >= N.RECALL for k in (1, 2, 5, N.LEVELS + 1))
    assert N.expected_recall(p, min(1.0, threshold + 0.05), 3) > N.expected_recall(p, threshold, 3)
    for bad in ((0, 0.9), (1.1, 0.9), (0.5, 1.0), (0.01, 0.999)):
        with pytest.raises(ValueError):
            N.plan(*bad)


def test_hot_nodes_are_passed_on(spark, monkeypatch):
    """Every node counts as hot until the last level."""
    monkeypatch.setattr(N, "SAMPLE", 1)
    monkeypatch.setattr(N, "HOT", 2)
    monkeypatch.setattr(N, "LEVELS", 2)
    rows = corpus(5)[:100]
    want = brute(rows, 0.7)
    got = pairs(N.similar_pairs(frame(spark, rows)))
    assert got <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("levels", [1, 3])
def test_large_nodes_lose_nothing(spark, monkeypatch, levels):
    """Nodes of more than four texts are split, and at the last level compared block by block."""
    monkeypatch.setattr(N, "SMALL", 4)
    monkeypatch.setattr(N, "LEVELS", levels)
    rnd = random.Random(2)
    base = words(rnd, 120)
    rows = corpus(3)[:120] + [(f"same{i}.md", " ".join(edited(rnd, base, 3))) for i in range(40)]
    want = brute(rows, 0.7)
    got = pairs(N.similar_pairs(frame(spark, rows)))
    assert got <= want and len(got) >= (0.999 if levels == 1 else 0.97) * len(want)


def test_copies_count_as_one_class(spark):
    rnd = random.Random(4)
    text, near = words(rnd, 100), None
    near = [*text[:-1], "last"]
    rows = [(f"c{i}", " ".join(text)) for i in range(30)] + [("near", " ".join(near)), ("near", " ".join(near)), ("far", " ".join(words(rnd, 100)))]
    got = pairs(N.similar_pairs(frame(spark, rows)))
    assert len(got) == 30 * 29 // 2 + 30 and all(a < b for a, b in got)
    groups = {r.key: (r.group_key, r.n_links) for r in N.groups(frame(spark, rows)).collect()}
    assert groups["c7"] == ("c0", 1) and groups["near"] == ("c0", 1) and groups["far"] == ("far", 0)


def test_no_cases(spark):
    rows = [("a", None), ("b", ""), ("c", " ".join(["x"] * 19)), ("d", "x y " * 9 + "z"), (None, "w " * 40), ("e", "---\n" + "a b c " * 20 + "\n---\nshort"), ("f", "漢字 " * 30), ("g", "漢字 " * 31)]
    assert pairs(N.similar_pairs(frame(spark, rows))) == {("f", "g")}
    assert {r.key for r in N.groups(frame(spark, rows)).collect()} == {"f", "g"}
    assert N.similar_pairs(frame(spark, [])).count() == 0 and N.groups(frame(spark, [])).count() == 0


def test_body_and_words():
    assert N.body("---\na: 1\n---\ntext") == "text" and N.body("---\n---\nx") == "x" and N.body("---\nopen") == "---\nopen"
    assert N.shingles("A_b c! " * 20).tolist() == N.shingles("a b C " * 20).tolist()


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("d", "e")] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a string, b string")
    got = dict(N.components(df).collect())
    assert got["c"] == "a" and got["e"] == "d" and {got[f"n{i:03d}"] for i in range(61)} == {"n000"}
