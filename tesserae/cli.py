"""Command line: ``python -m tesserae.cli COMMAND``.

A store is a folder (of any file system Spark can reach) with the written tables and, after ``index``, the search index.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine, Result
from .operators import actions, lint, meta, recall, scan
from .operators.parse import build_tables
from .plans.catalog import Catalog
from .plans.dql.syntax import NotIndexed
from .runtime import session
from .sources import notes as N
from .sources.layout import Layout
from .streaming.pipeline import Runner, run_scan


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserae")
    p.add_argument("--format", choices=("json", "yaml"), default="json")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *positional: str, page: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for a in positional:
            c.add_argument(a.rstrip("+"), nargs="+" if a.endswith("+") else None)
        if page:
            c.add_argument("--offset", type=int, default=0)
            c.add_argument("--size", type=int, default=None)
        return c

    command("index", "read all notes of the roots into the store", "store", "roots+")
    c = command("scan", "merge what changed since the store was written", "store", "roots+")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--rehash", action="store_true")
    c.add_argument("--batch", type=int, default=scan.BATCH)
    command("query", "run a query", "store", "text", page=True)
    command("search", "full-text search", "store", "text", page=True)
    c = command("list", "files by folder, tag and name", "store", page=True)
    for o in ("--folder", "--tag", "--name"):
        c.add_argument(o, default="")
    command("read", "lines of a note", "store", "path", page=True)
    c = command("lint", "broken links and metadata; exit code 1 if there are errors", "store")
    c.add_argument("--rule", action="append", choices=("links", "metadata"))
    c.add_argument("--profile")
    c.add_argument("--file", help="only this note")
    c = command("meta", "edit the frontmatter of all notes by a chain of actions", "roots+")
    c.add_argument("--do", action="append", required=True, help="normalize, set key=value, unset key, rename old new, apply profile")
    c.add_argument("--write", action="store_true", help="write the notes back; else only tell")
    c.add_argument("--if-exists", choices=actions.IF_EXISTS, default="skip")
    c = command("run", "run the pipeline of the settings over what a scan finds, or follow the files", "roots+")
    c.add_argument("--follow", action="store_true")
    c.add_argument("--write", action="store_true")
    c = command("recall", "skills by keyword, or one by name", "folder")
    c.add_argument("--keyword")
    c.add_argument("--get")
    return p


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


def _paged(r: Result) -> dict:
    return r.to_dict()


def run(args: argparse.Namespace, spark: SparkSession) -> tuple[object, int]:
    """(what to print, exit code)."""
    cmd = args.command
    if cmd == "index":
        catalog = Catalog(**build_tables(N.notes(spark, args.roots)))
        catalog.write(args.store)
        stored = Catalog.from_parquet(spark, args.store)
        Engine(stored).rebuild_index(f"{args.store}/search")
        return {"files": stored.files.count()}, 0
    if cmd == "scan":
        catalog = Catalog.from_parquet(spark, args.store)
        _, missing = N.present_roots(Layout.of(args.roots))
        listing = N.notes(spark, args.roots)
        by_dir = _rows(scan.by_dir(scan.diff(listing, catalog.files, missing, args.rehash)).orderBy("dir"))
        last = None
        for last in scan.scan_batches(catalog, listing, missing, args.rehash, args.dry_run, args.batch):
            print(json.dumps({"batch": last.batch, "done": last.done, "remaining": last.remaining}), file=sys.stderr)
        if last is not None and not args.dry_run and last.done:
            last.catalog.write(args.store)
            Engine(Catalog.from_parquet(spark, args.store)).rebuild_index(f"{args.store}/search")
        return {"byDir": by_dir, "dryRun": args.dry_run}, 0
    if cmd == "meta":
        layout = Layout.of(args.roots)
        chain = actions.editor(tuple(actions.Action.of(a) for a in args.do), args.if_exists)
        edited = meta.edit(N.notes(spark, args.roots), chain).cache()
        if args.write:
            meta.write_notes(edited, layout).count()
        return _rows(edited.filter("changed OR error IS NOT NULL").select("path", "changes", "error").orderBy("path")), int(not edited.filter("error IS NOT NULL").isEmpty())
    if cmd == "run":
        layout = Layout.of(args.roots)
        runner = Runner(spark, layout, Catalog.from_tables(spark), actions.Pipeline.of(N.merged_config(layout.roots[0]).get("pipeline") or {}), write=args.write)
        if args.follow:
            runner.start().awaitTermination()
        else:
            run_scan(runner)
        return runner.reports, int(any(r["failed"] for r in runner.reports))
    if cmd == "recall":
        skills = recall.load_skills(spark, args.folder)
        if args.get:
            return recall.render(recall.get(skills, args.get)), 0
        return (_rows(recall.recall(skills, args.keyword)) if args.keyword else recall.names(skills)), 0
    engine = Engine(Catalog.from_parquet(spark, args.store))
    if cmd == "lint":
        files = engine.catalog.files
        profile = lint.resolve_profile(args.profile, N.merged_config(".").get("profiles")) if args.profile else None
        notes = files.select("path", "content")
        found = lint.lint(notes if args.file is None else notes.filter(files.path == args.file), files.select("path"), args.rule, profile).cache()
        return _rows(found), lint.exit_code(found)
    if cmd == "search":
        return _paged(engine.with_index(f"{args.store}/search").search(args.text, args.offset, args.size)), 0
    if cmd == "query":
        return _paged(engine.query(args.text, args.offset, args.size)), 0
    if cmd == "list":
        return _paged(engine.list(args.folder, args.tag, args.name, args.offset, args.size)), 0
    return _paged(engine.read_note(args.path, args.offset, args.size)), 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or session("tesserae-cli", **{"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    try:
        out, code = run(args, spark)
    except (ValueError, NotIndexed, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    print(out if isinstance(out, str) else N.emit(out, args.format))
    return code


if __name__ == "__main__":
    sys.exit(main())
