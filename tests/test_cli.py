import json

from tests.vault import NOTES

from tesserae import cli


def call(spark, capsys, *args):
    code = cli.main(list(args), spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_from_files_to_answers(spark, tmp_path, capsys):
    for p, t in NOTES.items():
        (tmp_path / "v" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / p).write_text(t, encoding="utf-8")
    root, store = str(tmp_path / "v"), f"file://{tmp_path}/store"
    assert call(spark, capsys, "query", store, "LIST")[0] == 2  # nothing is indexed
    assert json.loads(call(spark, capsys, "index", store, root)[1]) == {"files": 6}
    code, out, _ = call(spark, capsys, "query", store, "TABLE status SORT file.path", "--size", "2")
    got = json.loads(out)
    assert code == 0 and got["total"] == 6 and got["returned"] == 2 and got["hasMore"]
    assert json.loads(call(spark, capsys, "search", store, "closed", "--size", "5")[1])["total"] == 1
    assert json.loads(call(spark, capsys, "list", store, "--folder", "Work")[1])["total"] == 2
    assert json.loads(call(spark, capsys, "read", store, "Start.md", "--size", "1")[1])["rows"][0]["text"] == "# Start"
    code, out, _ = call(spark, capsys, "lint", store)
    assert code == 1 and {d["reason"] for d in json.loads(out)} >= {"not_found", "ambiguous_target"}
    (tmp_path / "v/New.md").write_text("closed too")
    (tmp_path / "v/Food/Plan.md").unlink()
    dry = json.loads(call(spark, capsys, "scan", store, root, "--dry-run")[1])
    assert {d["dir"]: (d["added"], d["deleted"]) for d in dry["byDir"]} == {".": (1, 0), "Food": (0, 1)}
    assert call(spark, capsys, "scan", store, root)[0] == 0
    assert json.loads(call(spark, capsys, "search", store, "closed", "--size", "5")[1])["total"] == 2
    code, out, _ = call(spark, capsys, "meta", root, "--do", "set seen=true", "--write")
    assert code == 0 and len(json.loads(out)) == 6 and "seen: true" in (tmp_path / "v/New.md").read_text()
    assert call(spark, capsys, "meta", root, "--do", "fly")[0] == 2
    assert "query-notes" in call(spark, capsys, "recall", str(tmp_path / "none"), "--get", "query-notes")[1]
    assert json.loads(call(spark, capsys, "recall", str(tmp_path / "none"))[1]) == ["query-notes"]
