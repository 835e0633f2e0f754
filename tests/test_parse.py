import json
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from tests.vault import catalog

from tesserae.operators import parse as P


def kinds(text, kind):
    return [n for n in P.parse(text)[1] if n["type"] == kind]


def test_counts(spark):
    c = catalog(spark)
    assert c.files.count() == 6 and c.tasks.count() == 5 and c.blocks.count() == 1
    assert c.tags.filter("in_frontmatter").count() == 3
    links = {(r.source, r.target, r.is_embed) for r in c.links.collect()}
    assert ("Start.md", "Plan", True) in links and ("Start.md", "logo.png", True) in links and not any(t == "no" for _, t, _ in links)
    assert len([x for x in links if x[0] == "Daily/2026-01-01.md"]) == 1  # equal base names of one note count once
    row = c.files.filter("path = 'Work/Plan.md'").first()
    assert (row["name"], row.name_key, row.path_key, row.extension, row.folder) == ("Plan", "plan", "work/plan", "md", "Work")


def test_frontmatter():
    assert P.split_frontmatter("---\na: yes\nb: 2026-07-15\nc: [1, x]\n---\nbody") == ({"a": "yes", "b": "2026-07-15T00:00:00.000Z", "c": [1, "x"]}, "body", 5)
    assert P.split_frontmatter("---\na: [\n---\nx")[0] == {} and P.split_frontmatter("---\nno end")[1] == "---\nno end"
    assert P.split_frontmatter("---\n---\nx") == ({}, "x", 2)
    assert P.frontmatter_tags({"tags": "#a, b  c"}) == ["a", "b", "c"] and P.frontmatter_tags({"tag": ["x y", 3, "x"]}) == ["x", "y", "x"]
    json.dumps(P.split_frontmatter("---\nd: 2026-01-01 10:00:00+02:00\n---\n")[0])


def test_links():
    one = kinds("[[A/B#^id|  x ]]", "wikilink")[0]
    assert (one["target"], one["block_id"], one["alias"]) == ("A/B", "id", "x")
    assert kinds("[[]] [[ ]]", "wikilink") == []
    md = kinds('![a](b.png "t") [x](y) [no\n](z)', "markdownLink")
    assert [(n["target"], n["title"], n["image"]) for n in md] == [("b.png", "t", True), ("y", None, False)]
    assert [(n["line"], n["column"]) for n in kinds("---\na: 1\n---\n\n😂 [[x]]", "wikilink")] == [(5, 4)]


def test_code_is_masked():
    text = "a `x` ``y`z`` `open\n~~~\n#t\n~~~~\n```js\n#u"
    m = P.mask_code(text)
    assert len(m) == len(text) and m.count("\n") == text.count("\n") and "x" not in m.split("\n")[0][:6] and "#" not in m and "`open" in m


def test_tags_tasks_fields():
    assert [n["value"] for n in kinds("#a/b #1 x#no #é_1 #a/b", "tag")] == ["a/b", "é_1"]
    assert [(n["status"], n["text"]) for n in kinds("- [x] a \n  * [?] b\n- [] c", "task")] == [("x", "a"), ("?", "b")]
    assert P.inline_fields("a:: 1\n- b:: 2\n[c:: 3] (d:: 4)\nA:: 5\ne::\n") == [("A", "5", 4), ("b", "2", 2), ("c", "3", 3), ("d", "4", 3)]
    c = kinds("> [!Note]- T\n> one\n>two\nx", "callout")[0]
    assert (c["value"], c["title"], c["foldable"], c["content"]) == ("note", "T", True, "one\ntwo")
    assert [n["text"] for n in kinds("==a== ==b==", "highlight")] == ["a", "b"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab`~#[]()!|\n\r -*:>^=x​", max_size=120))
def test_never_fails(text):
    fm, nodes = P.parse(text)
    assert isinstance(fm, dict) and len(P.mask_code(text)) == len(text)


def test_linear_time():
    begin = time.time()
    P.parse("[" * 50_000 + "`" * 20_001 + "a:: " * 30_000 + "(k:: " * 20_000)
    assert time.time() - begin < 5
