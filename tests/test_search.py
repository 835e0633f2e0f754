import pytest
from pyspark.sql import functions as F

from tesserae.engine import Engine
from tesserae.operators import search as fts
from tesserae.plans.catalog import Catalog
from tesserae.plans.dql.syntax import NotIndexed

FILES = [
    ("a.md", "a", "The granite quarry, quarry of granite"),
    ("b.md", "b", "Granite only " + "filler words here " * 30),
    ("c.md", "c", "前端单元测试 的说明"),
    ("d.md", "d", "单元 and 测试 apart, 元测试 near"),
    ("quarry/granite.md", "granite", "nothing"),
    ("e.md", "e", None),
    ("f.md", "f", 'odd "quotes" NEAR (and) 100% of it'),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, name string, content string").cache()


def paths(df):
    return [r.path for r in df.collect()]


def test_all_terms_ranked(files):
    assert paths(fts.search(files, "granite QUARRY"))[0] in ("a.md", "quarry/granite.md")
    assert set(paths(fts.search(files, "granite QUARRY"))) == {"a.md", "quarry/granite.md"}


def test_ideographs(files):
    got = paths(fts.search(files, "前端单元测试"))
    assert got[0] == "c.md" and "d.md" in got


def test_short_terms_and_literals(files):
    assert paths(fts.search(files, "of it")) == ["a.md", "f.md"]
    assert paths(fts.search(files, "100%")) == ["f.md"] and paths(fts.search(files, '"quotes" (and)')) == ["f.md"]
    with pytest.raises(ValueError):
        fts.search(files, " x ")


def test_snippet(spark):
    df = spark.createDataFrame([("p", "p", "  " + "x" * 30 + " needle " + "y" * 60)], "path string, name string, content string")
    assert fts.search(df, "needle").first().snippet == "… " + "x" * 19 + " [needle] " + "y" * 43 + " …"


@pytest.fixture(scope="module")
def index(files, tmp_path_factory):
    return fts.GramIndex.write(files, f"file://{tmp_path_factory.mktemp('index')}", 3)


def test_index_is_kept_and_versioned(spark, files, index, tmp_path):
    assert fts.GramIndex.open(spark, index.directory) == index and index.n_files == len(FILES)
    assert fts.GramIndex.ensure(files, index.directory) == index
    d = f"file://{tmp_path}"
    with pytest.raises(NotIndexed):
        fts.GramIndex.open(spark, d)
    assert fts.GramIndex.ensure(files, d).n_files == len(FILES)
    (tmp_path / f".{fts.DESCRIPTION}.crc").unlink()
    (tmp_path / fts.DESCRIPTION).write_text('{"version": 1}')
    with pytest.raises(NotIndexed):
        fts.GramIndex.open(spark, d)
    assert fts.GramIndex.ensure(files.limit(2), d).n_files == 2  # built anew


def test_index_gives_the_same(files, index):
    for text in ("granite quarry", "granite filler", "单元测试", "前端单元测试", "quarry of", "ran", "nowhere", "aaa", "100%", "granite GRANITE", "of it"):
        plain, indexed = (fts.search(files, text, i, with_score=not text.startswith("of")).collect() for i in (None, index))
        key = lambda r: (r.path, r.snippet)
        assert [key(r) for r in plain] == [key(r) for r in indexed]
        if plain and "score" in plain[0]:
            assert [r.score for r in indexed] == pytest.approx([r.score for r in plain])


def test_overlapping_occurrences(spark, tmp_path):
    df = spark.createDataFrame([("p1", "n", "aaaaa banana"), ("p2", "n", "anana aaa"), ("p3", "aa", "a🖕🖕x🖕")], "path string, name string, content string")
    index = fts.GramIndex.write(df, f"file://{tmp_path}", 2)
    counts = lambda t: {r.path: r.c for r in index.counts(t).join(index.lengths, ["f0", "f1"]).collect()}
    assert counts("aaa") == {"p1": 3, "p2": 1} and counts("ana") == {"p1": 2, "p2": 2}
    assert counts("anana") == {"p1": 1, "p2": 1} and counts("aaaaaa") == {} and counts("🖕🖕x") == {"p3": 1}


def test_a_page_reads_contents_of_the_page_only(spark, files, index):
    e = Engine(Catalog.from_tables(spark, files=files.withColumn("folder", F.lit(""))), index)
    r = e.search("granite", offset=1, size=1)
    assert r.total == 3 and r.returned == 1 and r.rows[0]["path"] == paths(fts.search(files, "granite"))[1]
    plan = fts.count_hits(files, "granite quarry", index)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan
