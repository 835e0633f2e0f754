import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.vault import NOTES, frame

from tesserae.operators import actions, lint, meta
from tesserae.operators.profiles import get_profile


def test_broken_links(spark):
    notes = frame(spark).select("path", "content")
    every = notes.select("path").unionByName(spark.createDataFrame([("img/logo.png",), ("img/x.png",)], "path string"))
    got = {(r.file, r.target): (r.reason, r.suggestions) for r in lint.check_links(notes, every).collect()}
    assert got[("Food/Plan.md", "[[Missing]]")] == ("not_found", None)
    assert got[("Start.md", "![[Plan]]")] == ("ambiguous_target", ["Food/Plan.md", "Work/Plan.md"])
    assert got[("Daily/2026-01-01.md", "[[Plan]]")] == ("ambiguous_target", ["../Food/Plan.md", "../Work/Plan.md"])
    assert got[("Food/Recipe.md", "../Work/None.md")][0] == "not_found"
    assert got[("Food/Recipe.md", "..\\Start.md")][0] == "backslash_path"
    assert len(got) == 5
    assert lint.check_links(notes, every, lint.Ignore(paths=["Food/*"], targets=["*Plan*"])).count() == 0
    assert lint.exit_code(lint.check_links(notes, every)) == 1


def test_all_files_of_a_common_name_are_suggested(spark):
    notes = spark.createDataFrame([("start.md", "[[home]] and [x](none/home.md)")], "path string, content string")
    every = spark.createDataFrame([("start.md",), *((f"d{i:02d}/home.md",) for i in range(70))], "path string")
    got = {r.reason: r.suggestions for r in lint.check_links(notes, every).collect()}
    assert got["ambiguous_target"] == got["not_found"] == [f"d{i:02d}/home.md" for i in range(70)]


def test_outside_vault_and_decoding(spark):
    cases = {
        ("a.md", "../x.md"): (None, "outside_vault"),
        ("d/a.md", "b%20c.md#h"): ("d/b c.md", None),
        ("a.md", "mailto:x@y"): (None, None),
        ("a.md", "#h"): (None, None),
        ("a.md", "//host/x"): (None, None),
        ("d/e/a.md", ".././../x/./y.md"): ("x/y.md", None),
        ("d/a.md", "..\\b.md"): ("b.md", "backslash_path"),
        ("d/a.md", "/b+c.md"): ("d/b+c.md", None),
        ("d/a.md", "50%/b%20.md"): ("d/50%/b%20.md", None),  # an escape that is none: nothing is decoded
        ("d/a.md", "b%FF.md"): ("d/b%FF.md", None),
        ("d/a.md", ".."): (".", None),
        ("d/a.md", ""): (None, None),
    }
    df = spark.createDataFrame(list(cases), "file string, target string")
    got = df.select("file", "target", *lint.resolved_path(F.col("file"), F.col("target"))).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == cases


def test_suggestions_as_rows(spark):
    every = spark.createDataFrame([(f"d{i}/home.md",) for i in range(5)] + [("a.md",)], "path string")
    links = spark.createDataFrame([("a.md", "home"), ("a.md", "none")], "file string, target string")
    r = lint.resolve_wikilinks(links, lint.target_index(every, lists=False))
    assert {(x.target, x.reason) for x in r.collect()} == {("home", "ambiguous_target"), ("none", "not_found")}
    assert sorted(x.path for x in lint.suggestion_rows(r, every).collect()) == [f"d{i}/home.md" for i in range(5)]


def test_metadata_rules(spark):
    f = spark.createDataFrame([("a.md", '{"title":null,"kind":["x","z"]}'), ("b.md", "{}"), ("c/d.md", '{"kind":"x","title":1}'), ("e.md", None)], "path string, frontmatter string")
    p = lint.resolve_profile("p", {"p": {"required": ["title"], "enums": {"kind": ["x"]}}})
    got = [(r.file, r.rule, r.target) for r in lint.check_metadata(f, p).collect()]
    assert got == [("a.md", lint.ENUM_RULE, "kind"), ("b.md", lint.REQUIRED_RULE, "title"), ("e.md", lint.REQUIRED_RULE, "title")]
    assert lint.check_metadata(f, lint.resolve_profile("p", {"p": {"required": ["z"], "include": "c/**"}})).count() == 1


def test_profiles():
    own = {"a": {"extends": "b", "required": ["x"], "enums": {"k": ["2"]}}, "b": {"extends": "llm-wiki", "required": ["y"], "enums": {"k": ["1"]}, "include": "n/**"}, "c": {"extends": "c"}, "d": {"extends": "?"}}
    p = lint.resolve_profile("a", own)
    assert p.required == ("type", "y", "x") and p.enums == {"k": ("1", "2")} and p.include == "n/**"
    for bad in ("c", "d", "nope"):
        with pytest.raises(ValueError):
            lint.resolve_profile(bad, own)
    with pytest.raises(ValueError):
        lint.lint(None, None, ["metadata"])
    with pytest.raises(ValueError):
        lint.lint(None, None, ["style"])


@pytest.mark.parametrize("text", [*NOTES.values(), "﻿---\r\na: 1 # c\r\nb:\r\n  - x\r\n---\r\nbody\r\n", "---\na: 1\n---", "", "---\nopen"])
def test_round_trip(text):
    assert meta.split_document(text).text() == text


def test_edits_keep_the_rest():
    doc = meta.split_document("---\n# head\na: 1  # one\n\"b c\": [x]\nd: |\n  text\n---\nbody")
    meta.rename_key(doc, "a", "z")
    meta.set_key(doc, "n", ["p", "q"])
    meta.unset_key(doc, "b c")
    assert doc.text() == "---\n# head\nz: 1  # one\nd: |\n  text\nn:\n- p\n- q\n---\nbody"
    for old, new in (("none", "x"), ("z", "d")):
        with pytest.raises(ValueError):
            meta.rename_key(doc, old, new)


def test_normalize():
    doc = meta.split_document("---\ntag: '#a, b a'\ntags: [\"#c\", c]\nalias: one two\ncssclass: x y\n---\n")
    assert meta.normalize(doc)
    assert doc.data() == {"tags": ["c", "a", "b"], "aliases": ["one two"], "cssclasses": ["x", "y"]}
    assert meta.normalize(doc) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("#ab, \t", max_size=6), st.integers(0, 9)), max_size=5), st.text("#ab, ", max_size=8))
def test_normalize_is_idempotent(items, one):
    doc = meta.split_document("body")
    meta.set_key(doc, "tags", items)
    meta.set_key(doc, "tag", one)
    meta.normalize(doc)
    first = doc.text()
    assert meta.normalize(doc) == [] and doc.text() == first


def test_apply_and_coerce():
    doc = meta.split_document("text")
    done = meta.apply_profile(doc, get_profile("ssg-blog"), 1_700_000_000_500, 0, {"draft": "true", "tags": "a, b"})
    assert doc.data()["pubDate"] == "2023-11-14T22:13:20Z" and doc.data()["draft"] is True and doc.data()["tags"] == ["a", "b"] and done
    assert meta.diff_profile(doc, get_profile("ssg-blog"))["required"] == ["title", "description"]
    assert [meta.coerce(x, "auto") for x in ("1", "-2.5", "true", "null", "1e3", "x")] == [1, -2.5, True, None, "1e3", "x"]
    for raw, kind in (("", "number"), ("yes", "boolean"), ("x", "what")):
        with pytest.raises(ValueError):
            meta.coerce(raw, kind)


def test_bulk_edit_and_errors(spark):
    df = spark.createDataFrame([("a", "---\ntag: x\n---\n"), ("b", "---\n: [\n---\n"), ("c", None)], "path string, content string")
    got = {r.path: r for r in meta.edit(df, lambda doc, row: meta.normalize(doc)).collect()}
    assert got["a"].changed and got["b"].error and not got["b"].changed and not got["c"].changed


def test_rename_policies_and_actions():
    for mode, result in (("skip", {"a": [1], "b": [2]}), ("overwrite", {"b": [1]}), ("merge", {"b": [2, 1]})):
        doc = meta.split_document("---\na: [1]\nb: [2]\n---\n")
        meta.rename_or(doc, "a", "b", mode)
        assert doc.data() == result
    for bad in ("fly", "set x", "rename a", "apply nothing", ""):
        with pytest.raises(ValueError):
            actions.Action.of(bad)
    for cfg in ({}, {"actions": ["index"], "ifExists": "?"}, {"actions": ["index"], "onError": "?"}):
        with pytest.raises(ValueError):
            actions.Pipeline.of(cfg)
