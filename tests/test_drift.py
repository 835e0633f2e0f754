import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tesserae.operators import drift

FILES = "path string, ctime bigint, frontmatter string, vault string, month string, v string, type string"


def ms(month, day=3):
    y, m = map(int, month.split("-"))
    return int(dt.datetime(y, m, day, tzinfo=dt.timezone.utc).timestamp() * 1000)


def files(spark, rows):
    """Rows (vault, month, frontmatter); extra columns have the names the operator uses inside."""
    return spark.createDataFrame([(f"{v}/{i}.md", ms(m) if m else None, fm, "z", "z", "z", "z") for i, (v, m, fm) in enumerate(rows)], FILES)


def steps(df):
    return sorted((r.vault, r.period, r.field_before, r.field_after) for r in drift.steps_of(drift.registry(df)).collect())


def month(v, m, *fms):
    return [(v, m, f) for f in fms]


def test_each_kind_of_step(spark):
    rows = [
        *month("a", "2024-01", '{"title":"x","mood":"calm","n":1}', '{"title":"y","mood":"busy","n":2}', '{"title":"z","mood":"calm","n":3,"rare":1}'),
        *month("a", "2024-03", '{"title":"x","feeling":"calm","n":"1"}', '{"title":"y","feeling":"busy","n":"2"}', '{"title":"q","feeling":"calm","n":"3","new":[1]}', '{"feeling":"busy","title":"t","n":"4","new":[2]}', '{"feeling":"busy","title":"t","n":"4","new":[2]}'),
        *month("b", "2024-01", '{"a":1}'),
    ]
    assert steps(files(spark, rows)) == [("a", "2024-03", "", "new"), ("a", "2024-03", "mood", "feeling"), ("a", "2024-03", "n", "n")]


def test_other_kinds_of_values_are_no_rename(spark):
    rows = [
        *month("a", "2024-01", *(f'{{"due":"2024-01-{d:02d}"}}' for d in range(1, 9))),
        *month("a", "2024-02", *('{"mood":"calm"}', '{"mood":"tired"}') * 4),
    ]
    assert steps(files(spark, rows)) == [("a", "2024-02", "", "mood"), ("a", "2024-02", "due", "")]


def test_dirt(spark):
    rows = [
        *month("a", "2024-01", '{"x":1,"y":null}', '{"x":2,"y":null}', '{"x":', None, ""),  # 2 of 5 carry x
        *month("a", "2024-02", '{"x":1}', "[1]", '"t"'),  # 1 of 3
        *month("a", "2024-03", '{"x":true}', '{"x":"1"}'),  # a tie of types: boolean
        ("a", None, '{"x":1}'),
        *month("c", "2024-01"),
    ]
    df = files(spark, rows)
    want = [("a", "2024-03", "", "x")]
    assert steps(df) == want and steps(df.unionByName(df)) == want  # repeated rows count once
    fields = drift.templates_of(drift.registry(df))
    assert {(r.month, r.field, r.type) for r in fields.collect()} == {("2024-03", "x", "boolean")}
    assert steps(files(spark, [])) == []
    assert drift.versions(fields).first().fields == ["x:boolean"]


def registry_with_renames(df):
    """The registry, with other vaults that went through the same rename: it holds everywhere."""
    r = drift.registry(df)
    step = F.array(F.struct(*(F.lit(x).alias(n) for n, x in (("step", "rename"), ("field_before", "mood"), ("field_after", "feeling"), ("type_before", "string"), ("type_after", "string")))))
    other = df.sparkSession.createDataFrame([(f"x{i}",) for i in range(3)], "vault string").select("vault", F.lit("2030-01").alias("month"), F.lit("f").alias("fingerprint"), F.array(F.lit("feeling:string")).alias("fields"), F.lit("e").alias("parent"), F.lit("2029-12").alias("parent_month"), step.alias("steps"))
    return r.unionByName(other)


def test_registry_chains_versions(spark):
    rows = [
        *month("a", "2024-01", '{"mood":"calm","n":1}', '{"mood":"busy","n":2}'),
        *month("a", "2024-02", '{"feeling":"calm","n":"1"}', '{"feeling":"busy","n":"2"}'),
        *month("a", "2024-04", '{"feeling":"calm","n":3,"new":[1]}', '{"feeling":"busy","n":4,"new":[2]}'),
        *month("a", "2024-05", "{}", None),
    ]
    df = files(spark, rows)
    r = {x.month: x for x in drift.registry(df).collect()}
    assert r["2024-01"].parent is None and r["2024-02"].parent == r["2024-01"].fingerprint and r["2024-04"].parent_month == "2024-02"
    assert [s.step for s in r["2024-02"].steps] == ["cast", "rename"] and r["2024-05"].fields == [] and len(r["2024-05"].steps) == 3
    t = {x.path: x for x in drift.unify(df, drift.registry(df), {"new": None}).collect()}
    first = t["a/0.md"]
    assert first.version == r["2024-01"].fingerprint and first.field_feeling == "calm" and first.field_n == 1.0
    assert "rename mood to feeling" in first.applied and "cast n on the way to string, number" in first.applied
    assert "default new" not in first.applied  # it left again
    assert len(t) == 8 and t["a/7.md"].applied == []


def test_fields_that_entered_later_get_their_default(spark):
    rows = [*month("a", "2024-01", '{"t":"x"}', '{"t":"y","new":"z"}', '{"t":"y"}'), *month("a", "2024-02", '{"t":"x","new":"q"}', '{"t":"y","new":"r"}')]
    df = files(spark, rows)
    for given, value in ((None, None), ({"new": "none"}, "none")):
        t = {x.path: x for x in drift.unify(df, drift.registry(df), given).collect()}
        assert t["a/0.md"].field_new == value and "default new" in t["a/0.md"].applied
        assert t["a/1.md"].field_new == "z" and t["a/3.md"].applied == [] and t["a/3.md"].field_new == "q"


def test_one_table(spark):
    rows = [
        *month("a", "2024-01", '{"mood":"calm","n":1,"done":true,"due":"2024-01-02"}', '{"mood":"busy","n":2,"done":false}'),
        *month("a", "2024-02", '{"feeling":"calm","n":"3.5","done":"yes"}', '{"feeling":["busy","x"],"n":"a","done":"no"}', '{"feeling":"busy","n":7}'),
        *month("b", "2024-01", '{"mood":"calm"}', '{"mood":"busy"}'),
        *month("b", "2024-02", '{"feeling":"calm"}', '{"feeling":"busy"}'),
    ] * 2
    df = files(spark, rows)
    t = drift.unify(df, registry_with_renames(df))
    assert {c for c in t.columns if c.startswith("field_")} >= {"field_mood", "field_n", "field_done"} or "field_feeling" in t.columns
    got = {r.path.split("/")[1]: r.asDict() for r in t.collect()}
    name = "field_mood" if "field_mood" in t.columns else "field_feeling"
    assert got["2.md"][name] == "calm" and got["3.md"][name] == "busy, x" and got["0.md"][name] == "calm"
    assert got["2.md"]["field_done"] is True and got["0.md"]["field_done"] is True and got["3.md"]["field_n"] is None
    assert any("rename" in a for i in ("0.md", "2.md") for a in got[i]["applied"]) and any("cast n from string" in a for a in got["2.md"]["applied"])


def test_names_beyond_the_columns_are_kept(spark, monkeypatch):
    monkeypatch.setattr(drift, "MAX_COLUMNS", 1)
    monkeypatch.setattr(drift, "FREE_COLUMNS", 0)
    df = files(spark, month("a", "2024-01", '{"x":1,"y":2}', '{"x":3,"y":4}') + month("b", "2024-01", '{"x":5}'))
    got = {r.path: (r.field_x, r.other) for r in drift.unify(df, drift.registry(df)).collect()}
    assert got == {"a/0.md": (1.0, {"y": "2"}), "a/1.md": (3.0, {"y": "4"}), "b/2.md": (5.0, None)}


def test_no_value_is_lost(spark):
    rnd = random.Random(3)
    names = ["a", "A", "b", "c", "d", "é", "x y"]
    rows = [(v, m, json.dumps({n: rnd.choice([1, "t", True, [1], {"k": 1}, "2"]) for n in rnd.sample(names, rnd.randrange(6))})) for v in "uv" for m in ("2024-01", "2024-02", "2024-03") for _ in range(6)]
    df = files(spark, rows)
    t = drift.unify(df, drift.registry(df))
    fields = [c for c in t.columns if c.startswith("field_")]
    got = {r.path: sum(r[c] is not None for c in fields) + len(r.other or {}) for r in t.collect()}
    assert got == {f"{v}/{i}.md": len(json.loads(fm)) for i, (v, _, fm) in enumerate(rows)}


def test_table_keeps_fields_outside_templates(spark, monkeypatch):
    rows = month("a", "2024-01", '{"t":"x","rare":1,"T":"y"}', '{"t":"y","rare":2}', '{"t":"z","odd":{"k":[1]}}', '{"t":"x"}', '{"t":null}', None)
    df = files(spark, rows)
    for free, rare, odd in ((500, 1.0, None), (0, None, '{"k":[1]}')):
        monkeypatch.setattr(drift, "FREE_COLUMNS", free)
        got = {r.path: r.asDict() for r in drift.unify(df, drift.registry(df)).collect()}
        assert len(got) == 6 and got["a/5.md"]["other"] is None
        assert got["a/0.md"].get("field_rare") == rare and (got["a/2.md"]["other"] or {}).get("odd") == odd
        if free:
            assert got["a/5.md"]["field_odd"] is None and got["a/2.md"]["field_odd"] == '{"k":[1]}' and {got["a/0.md"][c] for c in got["a/0.md"] if c.lower().startswith("field_t")} == {"x", "y"}
        else:
            assert got["a/0.md"]["other"] == {"rare": "1", "T": '"y"'} and "other rare" in got["a/0.md"]["applied"]


def test_a_rename_seen_once_holds_in_its_vault_and_period(spark):
    rows = [
        *month("a", "2024-01", '{"mood":"calm"}', '{"mood":"busy"}'),
        *month("a", "2024-02", '{"feeling":"calm"}', '{"feeling":"busy"}', '{"feeling":"busy"}', '{"mood":"late"}'),
        *month("b", "2024-01", '{"mood":"dark"}'),
    ]
    df = files(spark, rows)
    s = drift.registry(df)
    assert [(r.field_before, r.field_after) for r in drift.steps_of(s).collect()] == [("mood", "feeling")]
    got = {r.path: (r.field_mood, r.field_feeling, r.applied) for r in drift.unify(df, s).collect()}
    assert got["a/0.md"] == (None, "calm", ["rename mood to feeling"]) and got["a/2.md"] == (None, "calm", [])
    assert got["a/5.md"] == ("late", None, []) and got["b/6.md"] == ("dark", None, [])


def test_names_that_differ_in_a_vault_stay_apart_and_conflicts_are_kept(spark):
    rows = [
        *month("a", "2024-01", '{"mood":"calm"}', '{"mood":"busy"}'),
        *month("a", "2024-02", '{"feeling":"calm"}', '{"feeling":"busy","mood":"old"}', '{"feeling":"calm"}'),
        *month("c", "2024-01", '{"mood":"dark","feeling":"cold"}', '{"mood":"dark","feeling":"warm"}'),
    ]
    df = files(spark, rows)
    t = {r.path: r for r in drift.unify(df, registry_with_renames(df)).collect()}
    assert (t["c/5.md"].field_mood, t["c/5.md"].field_feeling) == ("dark", "cold")
    both = t["a/3.md"]
    assert {both.field_mood, both.field_feeling, *(both.other or {}).values()} - {None} == {"busy", '"old"'}
    assert any(x.startswith("conflict mood in ") for x in both.applied)
    assert t["a/0.md"].version != t["a/2.md"].version == t["a/3.md"].version
