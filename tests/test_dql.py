import pytest
from tests.vault import catalog

from tesserae.engine import Engine
from tesserae.plans.dql import syntax as S
from tesserae.plans.dql.syntax import DqlSyntaxError, parse


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(catalog(spark))


def names(engine, q, col="file.name", **kw):
    return [r[col] for r in engine.query(q, **kw).rows]


def some(engine, q):
    return sorted(names(engine, q, "file.path"))


def test_headline_query(engine):
    r = engine.query("LIST FROM #area WHERE status = 'active' SORT file.mtime DESC LIMIT 10")
    assert r.columns == ["file.name", "file.path"] and r.rows == [{"file.name": "Start", "file.path": "Start.md"}]


def test_columns_and_dedup(engine):
    r = engine.query('TABLE status, file.name, status FROM "Work" SORT file.name')
    assert r.columns == ["file.name", "status"]
    assert [tuple(x.values()) for x in r.rows] == [("Old", "done"), ("Plan", "active")]
    assert engine.query("TABLE WITHOUT ID rating").columns == ["rating"]
    assert engine.query("LIST WITHOUT ID").columns == ["file.path"]


@pytest.mark.parametrize(
    "q, expected",
    [
        ("LIST FROM #work", ["Work/Old.md", "Work/Plan.md"]),
        ("LIST FROM [[Plan]]", ["Daily/2026-01-01.md", "Start.md"]),
        ("LIST FROM [[Food/Plan]]", ["Daily/2026-01-01.md"]),
        ('LIST FROM "food"', []),
        ('LIST WHERE contains(file.name, "PLA")', ["Food/Plan.md", "Work/Plan.md"]),
        ('LIST WHERE contains(file.tags, "area") OR rating = 0', ["Food/Recipe.md", "Start.md"]),
        ('LIST WHERE NOT contains(file.outlinks, "Start") AND rating != null', ["Food/Recipe.md"]),
        ('LIST WHERE contains(file.inlinks, "Daily/2026-01-01")', ["Food/Plan.md"]),  # links of one base name count once per note
        ('LIST WHERE contains(file.inlinks, "Plan") OR rating = 0', ["Food/Recipe.md", "Start.md"]),
        ("LIST WHERE rating", ["Work/Old.md", "Work/Plan.md"]),
        ("LIST WHERE !rating", ["Daily/2026-01-01.md", "Food/Plan.md", "Food/Recipe.md", "Start.md"]),
        ("LIST WHERE rating = null", ["Daily/2026-01-01.md", "Food/Plan.md", "Start.md"]),
        ("LIST WHERE rating > 4", ["Work/Old.md", "Work/Plan.md"]),  # text is above any number
        ('LIST WHERE rating = "7"', ["Work/Old.md"]),
        ("LIST WHERE flag = true", ["Food/Recipe.md"]),
        ('LIST WHERE status = "loud"', ["Daily/2026-01-01.md"]),  # the last inline field of a key
        ("LIST WHERE score > 100", ["Work/Old.md"]),
        ('LIST WHERE NOT (status = "active")', ["Daily/2026-01-01.md", "Work/Old.md"]),
        ('LIST WHERE NOT status REGEXP "^a"', ["Daily/2026-01-01.md", "Food/Plan.md", "Food/Recipe.md", "Work/Old.md"]),
        ('LIST WHERE regexmatch(status, "(")', []),
        ("LIST WHERE file.frontmatter", ["Food/Recipe.md", "Start.md", "Work/Old.md", "Work/Plan.md"]),
        ("LIST WHERE file.frontmatter = null", ["Daily/2026-01-01.md", "Food/Plan.md"]),
        ('LIST WHERE due < "2026-03-02"', ["Work/Plan.md"]),
        ("LIST WHERE length(file.tags) = 3", ["Start.md"]),
        ("LIST WHERE length(file.tags) >= 2", ["Start.md"]),
        ('LIST WHERE upper(status) = "DONE"', ["Work/Old.md"]),
        ("LIST WHERE round(rating) = 7", ["Work/Old.md"]),
        ('LIST WHERE file.size > "1" AND endswith(file.path, ".MD")', sorted(["Start.md", "Work/Plan.md", "Work/Old.md", "Food/Recipe.md", "Food/Plan.md", "Daily/2026-01-01.md"])),
        ('LIST WHERE file.mtime > "2026-01-01"', []),
    ],
)
def test_conditions(engine, q, expected):
    assert some(engine, q) == expected


def test_inlinks_by_path_and_name(engine):
    rows = {r["file.path"]: r["file.inlinks"] for r in engine.query("TABLE WITHOUT ID file.path, file.inlinks").rows}
    assert rows["Work/Plan.md"] == ["Start.md"]
    assert rows["Food/Plan.md"] == ["Daily/2026-01-01.md", "Start.md"]  # the bare embed names both
    assert rows["Start.md"] == ["Work/Old.md", "Work/Plan.md"] and rows["Work/Old.md"] == []


def test_group_and_flatten(engine):
    rows = engine.query("LIST GROUP BY status").rows
    assert {r["status"]: r["rows"] for r in rows}[None] == ["Food/Plan.md", "Food/Recipe.md"]
    assert [tuple(r.values()) for r in engine.query("TABLE status, count() GROUP BY status SORT status").rows] == [(None, 2), ("active", 2), ("done", 1), ("loud", 1)]
    assert sorted(names(engine, "LIST FROM #hub FLATTEN file.tags", "file.tags")) == ["area/home", "hub", "inbox"]
    assert engine.query('TABLE tag FROM "Work" FLATTEN file.tags').columns == ["file.name", "tag"]
    assert sorted(names(engine, 'LIST FROM "Work" WHERE flag = null FLATTEN file.frontmatter', "file.frontmatter"))[:2] == ["2026-03-01T00:00:00.000Z", "5"]


def test_tasks(engine):
    r = engine.query('TASK FROM "Work" WHERE completed')
    assert r.columns == ["task.text", "task.status", "task.due", "file.path"]
    assert sorted(x["task.text"] for x in r.rows) == ["closed [[Start]] #work", "read"]
    assert [x["task.due"] for x in engine.query('TASK FROM "Work" LIMIT 2').rows] == [None, "2026-02-03"]
    assert len(engine.query("TASK WHERE completed = false").rows) == 2


def test_paging(engine):
    r = engine.query("LIST SORT file.path LIMIT 5", offset=3, size=10)
    assert (r.total, r.returned, r.has_more) == (5, 2, False)
    r = engine.query("LIST", size=0)
    assert (r.total, r.rows, r.has_more) == (6, [], True)
    assert engine.query("LIST SORT rating DESC").rows[0]["file.name"] == "Old"
    assert [x["name"] for x in engine.list(folder="Work", name="PL").rows] == ["Plan"]
    assert [x["path"] for x in engine.list(tag="#work").rows] == ["Work/Old.md", "Work/Plan.md"]
    assert engine.read_note("Work/Plan.md", size=1).rows == [{"line": 0, "text": "- [ ] write 2026-02-03"}]


@pytest.mark.parametrize(
    "q",
    [
        "SELECT x", "LIST status", "TABLE length()", "LIST WHERE lower(a)", "LIST WHERE lower(a, \"b\") = 1", "LIST WHERE nope(a, \"b\")",
        "LIST WHERE contains(a)", 'LIST WHERE contains(a, "b") = 1', "LIST WHERE a < null", "LIST LIMIT -1", "LIST WHERE a = date(monday)",
        "LIST WHERE a = time(now)", "LIST WHERE !!a", "LIST SORT", 'LIST WHERE a = "open', "LIST WHERE a LIKE 'b'", "LIST WHERE limit = 1",
        "LIST SORT a FROM #b", "LIST WHERE a.b = 1", "LIST FLATTEN status", "LIST SORT file.tags", "TABLE count()", "LIST WHERE a ^ 1",
    ],
)
def test_errors(engine, q):
    with pytest.raises(DqlSyntaxError):
        engine.query(q)


def test_error_position_and_hint():
    with pytest.raises(DqlSyntaxError) as e:
        parse("LIST WHERE a LIKE 'b'")
    assert e.value.pos == 13 and "contains" in str(e.value)


def test_precedence_and_escapes():
    q = parse(r'LIST WHERE a = 1 OR NOT b = "x\"y" AND c')
    assert isinstance(q.where, S.Logic) and q.where.op == "or" and q.where.right.op == "and"
    assert q.where.right.left.expr.value == 'x"y'
    assert parse("list where a = date(today)", __import__("datetime").datetime(2026, 1, 2)).where.value == "2026-01-02"


def test_plan_has_no_nested_loop_and_no_python(engine):
    r = engine.query('LIST FROM #work WHERE status = "active" AND contains(file.inlinks, "Start") SORT file.mtime LIMIT 3')
    plan = r.all_rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "TakeOrdered" in plan
