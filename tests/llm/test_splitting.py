import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import splitting as S


def check(text, most=4000, overlap=200):
    p = S.plan(text, most, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(0 < z - a <= most for a, z, _ in p)
    for (_, z, _), (a, z2, _) in zip(p, p[1:]):
        assert a == z - overlap and z2 > z
    first = text[p[0][0] : p[0][1]]
    assert first + "".join(text[a + overlap : z] for a, z, _ in p[1:]) == text
    return p


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n\r#`é́日。", min_size=101, max_size=1500), st.integers(40, 100), st.integers(0, 15))
def test_any_text(text, most, overlap):
    check(text, most, overlap)


@pytest.mark.parametrize("text", ["x" * 100_000, "ab " * 9000, "\r\n" * 5000, "é" * 9001, "日本語。" * 4000, "# h\n" * 3000, " " * 4001, "a" * 4000 + "\n"])
def test_extremes(text):
    check(text)


def test_natural_boundaries_win():
    part = "word " * 300 + "end.\n"
    text = "".join(f"# Part {i}\n\n{part}{part}\n" for i in range(5))
    p = check(text)
    assert {k for *_, k in p[:-1]} == {"heading"} and all(text[z] == "#" for _, z, _ in p[:-1])
    words = "lorem ipsum " * 900
    assert all(words[z - 1] == " " for _, z, _ in check(words)[:-1])
    lines = "x\r\n" * 3000
    assert all(lines[z - 1 : z + 1] != "\r\n" for _, z, _ in check(lines)[:-1])
    fenced = "```\n" + "# no heading\n" * 100 + "```\n"
    assert "heading" not in {k for *_, k in check(fenced * 5)}


def test_no_better_plan_by_brute_force():
    """The programme's cost equals that of an exhaustive search over its own boundaries."""
    import itertools

    import numpy as np

    text = "one two. three\n\nfour five. six seven\n# eight nine ten. eleven\n\ntwelve. thirteen fourteen"
    most, overlap = 40, 5
    pos, kind = S.boundaries(text, most - overlap)
    pen = dict(zip(pos.tolist(), S.PENALTY[kind].tolist()))
    share = len(text) / np.ceil((len(text) - overlap) / (most - overlap))

    def cost(cuts):
        total, last = 0.0, 0
        for c in cuts:
            size = c - last
            if size > (most if last == 0 else most - overlap) or (last == 0 and c <= overlap):
                return float("inf")
            total += pen[c] + (size / share - 1) ** 2
            last = c
        return total

    inner = pos[:-1].tolist()
    best = min(cost([*c, len(text)]) for r in range(1, 5) for c in itertools.combinations(inner, r))
    assert cost([z for _, z, _ in S.plan(text, most, overlap)]) == pytest.approx(best)


def test_table(spark):
    rows = [("a", "x " * 3000), ("a", "x " * 3000), ("b", "y" * 4000), ("c", None), ("d", ""), ("e", "z\n" * 2001)]
    df = spark.createDataFrame([(p, t, 1, "k") for p, t in rows], "path string, content string, piece_no int, text string")
    got = S.split_oversized(df).collect()
    assert {r.path for r in got} == {"a", "e"} and all(len(r.piece) <= 4000 for r in got)
    a = sorted((r for r in got if r.path == "a"), key=lambda r: r.piece_no)
    assert [r.piece_no for r in a] == list(range(1, a[0].n_pieces + 1)) and a[1].piece.startswith(a[0].piece[-200:])
    assert S.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.split_oversized(df, overlap=2000)
