"""Queries over the other operators: scans, events, lint, metadata, parsing and their sinks."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import keys as K
from ..operators import actions, events, lint, meta, parse, recall, scan, search
from ..operators.profiles import get_profile
from ..runtime import load, shared_dir, spread, vault_of
from ..sources import notes
from .vault_queries import _FOLDER, _TAG_AREA, _WITH, catalog


def _last_events(spark: SparkSession, d: str) -> DataFrame:
    last = F.max_by(F.struct("type", "mtime", "size"), F.struct("happened_at", "change_id")).alias("e")
    return load(spark, d, "changes").groupBy("path").agg(last).select("path", "e.*")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A later listing, and the notes as they were indexed: all files.  The last change event of each path tells what
    became of it: an unlinked one is gone, an added or changed one has the event's time and size (its own, where the
    event has none), and notes without an event stay as they are."""
    was = catalog(spark, d).files.select("path", "size", "mtime", "content")
    now = was.join(_last_events(spark, d).select("path", "type", F.col("mtime").alias("m"), F.col("size").alias("s")), "path", "full_outer")
    now = now.filter("type IS NULL OR type <> 'unlink'")
    return now.select("path", F.coalesce("s", "size").alias("size"), F.coalesce("m", "mtime").alias("mtime"), "content"), was


_SNAP = f"""{_WITH}, e AS (SELECT path, type, mtime AS m, size AS s FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY happened_at DESC, change_id DESC) = 1),
now AS (SELECT coalesce(f.path, e.path) AS path, coalesce(s, size) AS size, coalesce(m, mtime) AS mtime FROM f FULL OUTER JOIN e ON e.path = f.path WHERE type IS DISTINCT FROM 'unlink'),
diff AS (SELECT coalesce(now.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'added' WHEN now.path IS NULL THEN 'deleted'
  WHEN now.mtime IS DISTINCT FROM f.mtime OR now.size IS DISTINCT FROM f.size THEN 'modified' ELSE 'unchanged' END AS kind FROM now FULL OUTER JOIN f ON now.path = f.path)"""


def _rewritten(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A later listing in which the notes whose last event is a change have another content of equal size and time."""
    was = catalog(spark, d).files.select("path", "size", "mtime", "content")
    changed = _last_events(spark, d).filter("type = 'change'").select("path", F.lit(True).alias("c"))
    turned = F.when(F.col("c"), F.reverse("content")).otherwise(F.col("content"))
    return was.join(changed, "path", "left").select("path", "size", "mtime", turned.alias("content")), was


_REWRITTEN = f"""{_WITH}, e AS (SELECT path, type FROM changes QUALIFY row_number() OVER (PARTITION BY path ORDER BY happened_at DESC, change_id DESC) = 1)
SELECT f.path, CASE WHEN e.type = 'change' AND content <> array_to_string(list_reverse(regexp_extract_all(content, '(?s).')), '') THEN 'modified' ELSE 'unchanged' END AS kind FROM f LEFT JOIN e ON e.path = f.path"""


def scan1_diff(spark, d):
    return scan.diff(*_snapshots(spark, d))


def scan1_rehash(spark, d):
    return scan.diff(*_rewritten(spark, d), rehash=True)


def agg9_by_dir(spark, d):
    return scan.by_dir(scan.diff(*_snapshots(spark, d)))


def src6_events(spark, d):
    return scan.as_events(scan.diff(*_snapshots(spark, d)))


def src8_events_of_query(spark, d):
    return scan.events_of_paths(events.paths_of_query(Engine(catalog(spark, d)).query("LIST FROM #area").df))


def cht2_scan_page(spark, d):
    e = scan.as_events(scan.diff(*_snapshots(spark, d)))
    return e.orderBy("type", "path").offset(50).limit(40)


def _changes(spark, d) -> DataFrame:
    return load(spark, d, "changes").dropDuplicates(["change_id"])


_CH = "c AS (SELECT DISTINCT change_id, path, type, mtime, size, happened_at FROM changes)"


def str2_sessions(spark, d):
    c = _changes(spark, d).select(vault_of(F.col("path")).alias("vault"), F.col("happened_at").cast("timestamp").alias("ts"))
    s = events.sessions(c, "vault", "ts", "6 hours")
    return s.select("vault", "n_events", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


def str3_fold(spark, d):
    e = _changes(spark, d).select("path", "type", "mtime", "size", F.col("change_id").alias("seq"))
    return events.fold(e).select("path", "type", "mtime", "size")


def str4_match(spark, d):
    e = _changes(spark, d)
    return events.match(e, ["change", "unlink"], ["commons/**", "*/Home.md"]).select("change_id", "path", "type")


def str5_route(spark, d):
    live = events.paths_of_query(Engine(catalog(spark, d)).query("LIST GROUP BY status").df)
    return events.route(_changes(spark, d), ["unlink"], None, live).select("change_id", "path")


def str7_own_writes(spark, d):
    e = _changes(spark, d).select("path", "type", F.col("change_id").alias("seq"), F.col("happened_at").cast("timestamp").alias("ts"))
    writes = e.filter("type = 'add'").select("path", (F.col("ts") - F.expr("INTERVAL 1 SECOND")).alias("written_at"))
    return events.without_own_writes(e, writes).select("path", "seq")


def agg11_run_report(spark, d):
    e = _changes(spark, d).select("path", "type", "mtime", "size", F.col("change_id").alias("seq"))
    c = catalog(spark, d)
    p = actions.Pipeline.of({"actions": ["normalize", "set checked=true"], "on": ["add", "change"]})
    done = actions.run_actions(events.match(events.fold(e), list(p.on)), c.files, p)
    return events.run_report(done).select("total", "failed")


def _wikilinks(spark, d):
    links = load(spark, d, "links").dropDuplicates(["id"]).select("id", F.col("source").alias("file"), "target")
    index = lint.target_index(load(spark, d, "files").select("path"), lists=False)
    return lint.resolve_wikilinks(links, index)


def lnk2_wikilinks(spark, d):
    return _wikilinks(spark, d).select("id", "reason", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_found"))


def lnk3_markdown_links(spark, d):
    """Every link written as a Markdown link of one of five kinds: beside the note, above it, escaped, with backslashes, external."""
    links = load(spark, d, "links").dropDuplicates(["id"]).filter("target <> ''")
    t, kind = F.col("target"), F.col("id") % 5
    written = (
        F.when(kind == 0, F.concat(F.lit("./"), t, F.lit(".md#part")))
        .when(kind == 1, F.concat(F.lit("../"), t))
        .when(kind == 2, F.replace(t, F.lit(" "), F.lit("%20")))
        .when(kind == 3, F.concat(F.lit("x\\..\\"), t, F.lit(".md")))
        .otherwise(F.concat(F.lit("https://example.org/"), t))
    )
    index = lint.target_index(load(spark, d, "files").select("path"), lists=False)
    return lint.resolve_markdown_links(links.select("id", F.col("source").alias("file"), written.alias("target")), index).select("id", "reason")


def lnk1_suggestions(spark, d):
    """How many files bear the name of each ambiguous link."""
    links = load(spark, d, "links").dropDuplicates(["id"]).select("id", F.col("source").alias("file"), "target")
    paths = load(spark, d, "files").select("path")
    resolved = lint.resolve_wikilinks(links, lint.target_index(paths, lists=False))
    return lint.suggestion_rows(resolved, paths).groupBy("id").agg(F.count(F.lit(1)).alias("n_paths"), F.min("path").alias("first_path"))


def lnk4_check(spark, d):
    """All notes' links, with the number of files of the name instead of their list."""
    f = catalog(spark, d).files
    return lint.check_links(f.select("path", "content"), f.select("path"), lint.Ignore(targets=["*.png"]), suggest=False)


def _profile():
    own = {"base": {"required": ["title"]}, "note": {"extends": "base", "required": ["tags", "status"], "enums": {"status": ["active", "done", "draft"]}}}
    return lint.resolve_profile("note", own)


def lnt2_required(spark, d):
    return lint.check_metadata(catalog(spark, d).files, _profile()).filter("reason = 'required_missing'").select("file", "target")


def lnt3_enum(spark, d):
    return lint.check_metadata(catalog(spark, d).files, _profile()).filter("reason = 'enum_invalid'").select("file", "target", "message")


def lnk6_ignore(spark, d):
    ignore = lint.Ignore(paths=["commons/**"], rules={lint.REQUIRED_RULE: ["status"]})
    return lint.check_metadata(catalog(spark, d).files, _profile(), ignore).select("file", "rule", "target")


def met5_normal_lists(spark, d):
    lists = meta.list_columns(F.col("frontmatter"))
    return catalog(spark, d).files.select("path", *(F.array_join(c, "|").alias(k) for k, c in lists.items()))


def met7_prefill(spark, d):
    """What two profiles would fill in every note: derived fields that its frontmatter lacks."""
    f = catalog(spark, d).files
    body = search.body_of(F.coalesce("content", F.lit("")))
    filled = {}
    for name in ("pkm-note", "llm-wiki"):
        filled |= meta.prefill_columns(F.col("frontmatter"), get_profile(name), body, F.col("mtime"), F.col("ctime"))
    return f.select("path", *(c.alias(k) for k, c in filled.items()))


def fn11_coerce(spark, d):
    """Every tag and due date as a value of the kind its text shows."""
    raw = load(spark, d, "tags").select(F.col("tag").alias("raw")).unionByName(load(spark, d, "tasks").select(F.substring_index("due_date", "-", 1).alias("raw")))
    raw = raw.filter("raw IS NOT NULL").groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return raw.select("raw", "n", meta.auto_column(F.col("raw")).alias("value"))


def fn12_sha256(spark, d):
    body = search.body_of(F.coalesce("content", F.lit("")))
    return catalog(spark, d).files.select("path", meta.derived_column("sha256-body", body, F.col("mtime"), F.col("ctime")).alias("sha256"))


def met4_edit(spark, d):
    """Normal form of every note's frontmatter; how many change."""
    e = meta.normal_form(catalog(spark, d).files)
    return e.select("path", "changed", F.array_join("changes", "|").alias("changes"), "error")


def fn6_keys(spark, d):
    l = load(spark, d, "links").select("target").distinct()
    return l.select("target", K.link_key(F.col("target")).alias("link_key"), K.path_key(F.col("target")).alias("path_key"), K.is_asset(F.col("target")).alias("is_asset"))


def snk3_remove(spark, d):
    c = catalog(spark, d)
    left, _ = scan.remove(c, c.files.filter(F.col("folder") == "commons").select("path"))
    known = c.files.select("path").unionByName(load(spark, d, "changes").select("path"))
    _, existed = scan.remove(c, known.filter(vault_of(F.col("path")) == "commons"))
    asked = existed.agg(F.lit("existed").alias("relation"), F.count(F.when(F.col("existed"), 1)).alias("n_rows"))
    counts = [asked] + [getattr(left, n).agg(F.lit(n).alias("relation"), F.count(F.lit(1)).alias("n_rows")) for n in ("files", "tags", "tasks", "links")]
    return reduce(DataFrame.unionByName, counts)


def src5_build(spark, d):
    """All notes parsed into tables: rows per vault and table."""
    f = catalog(spark, d).files.select("path", "size", "mtime", "ctime", "content")
    out = None
    for name, df in parse.build_tables(f).items():
        owner = {"files": "path", "links": "source"}.get(name, "file_path")
        n = df.groupBy(vault_of(F.col(owner)).alias("vault")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("relation"), "vault", "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


def snk2_upsert(spark, d):
    """All notes are parsed and merged again: nothing is lost or doubled."""
    c = catalog(spark, d)
    f = scan.upsert(c, c.files.select("path", "size", "mtime", "ctime", "content")).files
    return f.groupBy(vault_of(F.col("path")).alias("vault")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("content")).alias("n_chars"))


def src1_notes(spark, d):
    """All notes written as files below the shared folder, then listed and read by the note source."""
    root = f"{shared_dir(spark).removeprefix('file://')}/notes-{uuid.uuid4().hex}"
    files = catalog(spark, d).files.select("path", F.coalesce("content", F.lit("")).alias("content"))

    def write(batches):
        for b in batches:
            for path, text in zip(b["path"], b["content"]):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
            yield b[["path"]]

    files.mapInPandas(write, "path string").agg(F.count(F.lit(1))).collect()
    read = notes.notes(spark, root)
    return read.select("path", "size", F.sha2("content", 256).alias("sha256"))


def str1_stream(spark, d):
    """Change events as a stream: each batch is written under its number, so one that is repeated replaces itself; then
    all are folded."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = load(spark, d, "changes").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 50).parquet(f"{d}/changes.parquet*")
    picked = stream.dropDuplicates(["change_id"]).select("path", "type", "mtime", "size", F.col("change_id").alias("seq"))
    query = (
        picked.writeStream.outputMode("append")
        .option("checkpointLocation", path + "-log")
        .trigger(availableNow=True)
        .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}") and None)
        .start()
    )
    query.awaitTermination()
    return events.fold(spark.read.schema(picked.schema).parquet(f"{path}/batch=*")).select("path", "type", "mtime", "size")


# ---- notes generated from the trade tables, parsed, and compared with the columns they came from ------------


def _generated(spark, d) -> dict[str, DataFrame]:
    part = spread(load(spark, d, "part"))
    text = F.concat(
        F.lit("---\ntitle: "), F.col("p_partkey"), F.lit("\nsize: "), F.col("p_size"), F.lit("\ntags: [t"), F.col("p_size"), F.lit(", part/x]\n---\n# Part\n\n"),
        F.lit("See [[Makers/"), F.col("p_partkey"), F.lit("#Use|it]] and ![[pic.png]] but `[[not]]` #kind/k"), F.col("p_size"), F.lit("\n"),
        F.lit("```\n#hidden [[hidden]]\n```\n- [x] order "), F.col("p_name"), F.lit(" by 2024-05-0"), F.col("p_size") % 9 + 1,
        F.lit("\nRating:: "), F.col("p_size"), F.lit("\nalso [rating:: "), F.col("p_partkey"), F.lit("] ==bold==\nEnd of it ^b"), F.col("p_size"),
    )
    notes = part.select(F.concat(F.lit("parts/"), "p_partkey", F.lit(".md")).alias("path"), F.lit(1).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime"), F.lit(0).cast("bigint").alias("ctime"), text.alias("content"))
    return parse.build_tables(notes)


def par1_frontmatter(spark, d):
    return _generated(spark, d)["files"].select("path", "name", "folder", F.get_json_object("frontmatter", "$.size").alias("size"))


def par3_links(spark, d):
    return _generated(spark, d)["links"].select("source", "target", "target_key", "target_path_key", "alias", "heading", "is_embed")


def par6_tags(spark, d):
    return _generated(spark, d)["tags"]


def par8_tasks(spark, d):
    return _generated(spark, d)["tasks"]


def par10_blocks(spark, d):
    return _generated(spark, d)["blocks"]


def par11_inline(spark, d):
    return _generated(spark, d)["inline_fields"]


_PATH = "'parts/' || p_partkey || '.md'"


def rec1_recall(spark, d):
    """Every tag as a skill, triggered by its parts."""
    t = load(spark, d, "tags").select(F.lower(F.trim("tag")).alias("name")).filter("name <> ''").distinct()
    none = F.array().cast("array<string>")
    skills = t.select("name", F.lit("").alias("description"), F.split("name", "/").alias("triggers"), none.alias("patterns"), none.alias("rules"))
    return recall.recall(skills, "type granite")


_RECALL = r"""WITH t AS (SELECT DISTINCT lower(trim(tag, ' ')) AS name FROM tags WHERE trim(tag, ' ') <> ''),
x AS (SELECT name, name AS t, 1.0 AS w FROM t UNION ALL SELECT name, unnest(string_split(name, '/')), 1.5 FROM t),
q AS (SELECT unnest(['type granite', 'type', 'granite']) AS q),
s AS (SELECT name, w * CASE WHEN t = q THEN 0.0 WHEN contains(t, q) OR contains(q, t) THEN 0.1 ELSE levenshtein(t, q) / CAST(greatest(length(t), length(q)) AS DOUBLE) END AS d FROM x, q)
SELECT name, round(min(d), 6) AS score FROM s GROUP BY name HAVING round(min(d), 6) <= 0.4"""

_LNK2 = r"""
WITH p AS (SELECT DISTINCT path FROM files), n AS (SELECT path FROM p WHERE lower(path) LIKE '%.md'),
x AS (SELECT DISTINCT id, target FROM links),
y AS (SELECT id, target, contains(target, '/') AS q, regexp_extract(target, '([^/]*)/*$', 1) AS base FROM x),
z AS (SELECT *, lower(regexp_extract(base, '.\.([^./]*)$', 1)) IN ('png','jpg','jpeg','gif','svg','webp','bmp','mp4','webm','mov','mp3','wav','ogg','pdf') AS asset FROM y),
s AS (SELECT lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^./]*$', '\1')) AS key, count(*) AS n FROM n GROUP BY 1),
b AS (SELECT lower(regexp_extract(path, '([^/]*)$', 1)) AS key, count(*) AS n FROM p GROUP BY 1),
k AS (SELECT DISTINCT lower(regexp_replace(path, '([^/])\.[^./]*$', '\1')) AS key, 1 AS n FROM n),
a AS (SELECT DISTINCT lower(path) AS key, 1 AS n FROM p),
r AS (SELECT z.id, coalesce(CASE WHEN asset AND q THEN a.n WHEN asset THEN b.n WHEN q THEN k.n ELSE s.n END, 0) AS n_found
FROM z LEFT JOIN a ON a.key = lower(target) LEFT JOIN b ON b.key = lower(base)
LEFT JOIN k ON k.key = lower(regexp_replace(target, '([^/])\.[^./]*$', '\1'))
LEFT JOIN s ON s.key = lower(regexp_replace(base, '(.)\.[^./]*$', '\1')))
SELECT id, CASE WHEN n_found = 0 THEN 'not_found' WHEN n_found > 1 THEN 'ambiguous_target' END AS reason, n_found FROM r
"""

_LNK3 = r"""
, p AS (SELECT DISTINCT lower(path) AS path FROM files),
x AS (SELECT DISTINCT id, regexp_extract(source, '^(.*/)?[^/]*$', 1) AS dir, target AS t FROM links WHERE target <> ''),
y AS (SELECT id, t, id % 5 AS kind, CASE WHEN id % 5 = 1 AND dir = '' THEN NULL WHEN id % 5 = 1 THEN regexp_replace(dir, '[^/]+/$', '') ELSE dir END || t || CASE WHEN id % 5 IN (0, 3) THEN '.md' ELSE '' END AS path FROM x),
z AS (SELECT id, kind, path, lower(path) IN (SELECT path FROM p) OR (NOT regexp_matches(path, '[^/]\.[^./]*$') AND lower(path) || '.md' IN (SELECT path FROM p)) AS hit FROM y)
SELECT id, CASE WHEN kind = 4 THEN NULL WHEN path IS NULL THEN 'outside_vault' WHEN kind = 3 THEN 'backslash_path' WHEN NOT hit THEN 'not_found' END AS reason FROM z
"""

_LNK1 = r"""
WITH n AS (SELECT DISTINCT path, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^./]*$', '\1')) AS key FROM files WHERE lower(path) LIKE '%.md'),
x AS (SELECT DISTINCT id, target FROM links WHERE NOT contains(target, '/')),
z AS (SELECT id, lower(regexp_replace(target, '(.)\.[^./]*$', '\1')) AS key FROM x
  WHERE lower(regexp_extract(target, '.\.([^./]*)$', 1)) NOT IN ('png','jpg','jpeg','gif','svg','webp','bmp','mp4','webm','mov','mp3','wav','ogg','pdf'))
SELECT id, count(*) AS n_paths, min(path) AS first_path FROM z JOIN n USING (key) GROUP BY id HAVING count(*) > 1
"""

_REQUIRED = f"""{_WITH}, q AS (SELECT f.path, unnest(['title', 'tags', 'status']) AS target, f.fm FROM f)
SELECT path AS file, target FROM q WHERE fm IS NULL OR NOT list_contains(json_keys(fm), target)"""

_ENUM = f"""{_WITH}, v AS (SELECT f.path, unnest(CASE WHEN json_type(f.fm, '$.status') = 'ARRAY' THEN json_extract_string(f.fm, '$.status[*]')
  WHEN json_type(f.fm, '$.status') IS NULL OR json_type(f.fm, '$.status') = 'NULL' THEN [] ELSE [json_extract_string(f.fm, '$.status')] END) AS value FROM f)
SELECT path AS file, 'status' AS target, 'value of status is not allowed: ' || value AS message FROM v WHERE value IS NOT NULL AND value NOT IN ('active', 'done', 'draft')"""

_FOLD = f"""WITH {_CH} SELECT path, t AS type, mtime, size FROM (SELECT path, list_reduce(list(type ORDER BY change_id), lambda a, b:
  CASE a WHEN 'none' THEN b WHEN 'add' THEN CASE WHEN b = 'unlink' THEN 'none' ELSE 'add' END
  WHEN 'change' THEN CASE WHEN b = 'unlink' THEN 'unlink' ELSE 'change' END ELSE CASE WHEN b = 'unlink' THEN 'unlink' ELSE 'change' END END) AS t,
  last(mtime ORDER BY change_id) AS mtime, last(size ORDER BY change_id) AS size FROM c GROUP BY path) WHERE t <> 'none'"""

_SESSIONS = f"""WITH {_CH}, e AS (SELECT split_part(path, '/', 1) AS vault, happened_at AS ts FROM c),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY vault ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM e),
s AS (SELECT *, sum(starts) OVER (PARTITION BY vault ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT vault, count(*) AS n_events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY vault, no"""

_OWN = f"""WITH {_CH}, w AS (SELECT DISTINCT path, happened_at - INTERVAL 1 SECOND AS at FROM c WHERE type = 'add'),
n AS (SELECT c.path, w.at, min(c.change_id) AS seq FROM c JOIN w ON w.path = c.path AND epoch_ms(c.happened_at) - epoch_ms(w.at) BETWEEN 0 AND 1999 GROUP BY 1, 2)
SELECT c.path, c.change_id AS seq FROM c LEFT JOIN (SELECT DISTINCT path, seq FROM n) n ON n.path = c.path AND n.seq = c.change_id WHERE n.seq IS NULL"""

_BODY = r"regexp_replace(coalesce(content, ''), '\A---[ \t]*\r?\n(?s:.*?\r?\n)??---[ \t]*(?:\r?\n|\z)', '')"

_PREFILL = f"""{_WITH}, t AS (SELECT path, json_keys(fm) AS keys, strftime(make_timestamp(CASE WHEN ctime > 0 AND ctime <= mtime THEN ctime ELSE mtime END * 1000), '%Y-%m-%dT%H:%M:%SZ') AS born,
  strftime(make_timestamp(mtime * 1000), '%Y-%m-%dT%H:%M:%SZ') AS changed, sha256({_BODY}) AS h FROM f)
SELECT path, CASE WHEN NOT coalesce(list_contains(keys, 'created'), false) THEN born END AS created, CASE WHEN NOT coalesce(list_contains(keys, 'modified'), false) THEN changed END AS modified,
  CASE WHEN NOT coalesce(list_contains(keys, 'timestamp'), false) THEN changed END AS "timestamp", CASE WHEN NOT coalesce(list_contains(keys, 'sha256'), false) THEN h END AS sha256 FROM t"""


def _normal_sql(name: str, singular: str, split: bool, mark: str) -> str:
    """The clean list of one key, in SQL: the items of the plural, then those of the singular form."""
    def items(k: str) -> str:
        text = f"json_extract_string(fm, '$.\"{k}\"')"
        plain = f"CASE WHEN json_type(fm, '$.\"{k}\"') = 'VARCHAR' THEN string_split_regex({text}, '[\\s,]+') ELSE [{text}] END" if split else f"[{text}]"
        return f"CASE WHEN json_type(fm, '$.\"{k}\"') = 'ARRAY' THEN json_extract_string(fm, '$.\"{k}\"[*]') WHEN coalesce(json_type(fm, '$.\"{k}\"'), 'NULL') = 'NULL' THEN [] ELSE {plain} END"

    some = " OR ".join(f"coalesce(json_type(fm, '$.\"{k}\"'), 'NULL') <> 'NULL'" for k in (name, singular))
    clean = f"list_transform(list_concat({items(name)}, {items(singular)}), lambda x: regexp_replace(x, '^[\\s{mark}]+|\\s+$', '', 'g'))"
    return f"CASE WHEN {some} THEN array_to_string(list_filter({clean}, lambda x, i: x <> '' AND list_position({clean}, x) = i), '|') END AS {name}"


_NORMAL = f"{_WITH} SELECT path, {_normal_sql('tags', 'tag', True, '#')}, {_normal_sql('aliases', 'alias', False, '')}, {_normal_sql('cssclasses', 'cssclass', True, '')} FROM f"

REGISTERED = {
    "scan1_diff": (scan1_diff, f"{_SNAP} SELECT path, kind FROM diff"),
    "scan1_rehash": (scan1_rehash, _REWRITTEN),
    "agg9_by_dir": (agg9_by_dir, _SNAP + r" SELECT coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') AS dir, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'modified') AS modified, count(*) FILTER (kind = 'deleted') AS deleted FROM diff WHERE kind <> 'unchanged' GROUP BY 1"),
    "src6_events": (src6_events, f"{_SNAP} SELECT path, CASE kind WHEN 'added' THEN 'add' WHEN 'modified' THEN 'change' ELSE 'unlink' END AS type FROM diff WHERE kind <> 'unchanged'"),
    "src8_events_of_query": (src8_events_of_query, f"{_WITH} SELECT f.path, 'change' AS type FROM f WHERE {_TAG_AREA}"),
    "cht2_scan_page": (cht2_scan_page, f"{_SNAP} SELECT path, CASE kind WHEN 'added' THEN 'add' WHEN 'modified' THEN 'change' ELSE 'unlink' END AS type FROM diff WHERE kind <> 'unchanged' ORDER BY 2, 1 LIMIT 40 OFFSET 50"),
    "str2_sessions": (str2_sessions, _SESSIONS),
    "str3_fold": (str3_fold, _FOLD),
    "str4_match": (str4_match, f"WITH {_CH} SELECT change_id, path, type FROM c WHERE type IN ('change', 'unlink') AND (starts_with(path, 'commons/') OR regexp_matches(path, '^[^/]*/Home\\.md$'))"),
    "str5_route": (str5_route, f"WITH {_CH} SELECT change_id, path FROM c WHERE type = 'unlink' AND path IN (SELECT path FROM files)"),
    "str7_own_writes": (str7_own_writes, _OWN),
    "agg11_run_report": (agg11_run_report, None),
    "lnk2_wikilinks": (lnk2_wikilinks, _LNK2),
    "lnk3_markdown_links": (lnk3_markdown_links, _WITH + _LNK3),
    "lnk1_suggestions": (lnk1_suggestions, _LNK1),
    "lnk4_check": (lnk4_check, None),
    "lnt2_required": (lnt2_required, _REQUIRED),
    "lnt3_enum": (lnt3_enum, _ENUM),
    "lnk6_ignore": (lnk6_ignore, f"SELECT file, rule, target FROM (SELECT file, 'metadata/required-missing' AS rule, target FROM ({_REQUIRED}) WHERE target <> 'status' UNION ALL SELECT file, 'metadata/enum-invalid', target FROM ({_ENUM})) WHERE NOT starts_with(file, 'commons/')"),
    "met4_edit": (met4_edit, None),
    "met5_normal_lists": (met5_normal_lists, _NORMAL),
    "fn11_coerce": (fn11_coerce, r"""SELECT raw, count(*) AS n, CASE WHEN raw IN ('true', 'false', 'null') THEN raw WHEN regexp_full_match(raw, '-?[0-9]+(\.[0-9]+)?') THEN CAST(CAST(raw AS DOUBLE) AS VARCHAR) ELSE to_json(raw) END AS value
        FROM (SELECT tag AS raw FROM tags UNION ALL SELECT split_part(due_date, '-', 1) FROM tasks) WHERE raw IS NOT NULL GROUP BY raw"""),
    "met7_prefill": (met7_prefill, _PREFILL),
    "fn12_sha256": (fn12_sha256, f"{_WITH} SELECT path, sha256({_BODY}) AS sha256 FROM f"),
    "fn6_keys": (fn6_keys, r"""WITH t AS (SELECT DISTINCT target, regexp_extract(target, '([^/]*)/*$', 1) AS base FROM links)
        SELECT target, lower(regexp_replace(base, '(.)\.[^./]*$', '\1')) AS link_key, lower(regexp_replace(target, '([^/])\.[^./]*$', '\1')) AS path_key,
        lower(regexp_extract(base, '.\.([^./]*)$', 1)) IN ('png','jpg','jpeg','gif','svg','webp','bmp','mp4','webm','mov','mp3','wav','ogg','pdf') AS is_asset FROM t"""),
    "snk3_remove": (snk3_remove, f"""{_WITH}, g AS (SELECT path FROM f WHERE folder = 'commons')
        SELECT 'existed' AS relation, count(DISTINCT path) AS n_rows FROM f WHERE split_part(path, '/', 1) = 'commons' UNION ALL
        SELECT 'files' AS relation, count(*) AS n_rows FROM f WHERE path NOT IN (SELECT path FROM g)
        UNION ALL SELECT 'tags', count(*) FROM tags WHERE file_path NOT IN (SELECT path FROM g)
        UNION ALL SELECT 'tasks', count(*) FROM k WHERE file_path NOT IN (SELECT path FROM g)
        UNION ALL SELECT 'links', count(*) FROM l WHERE source NOT IN (SELECT path FROM g)"""),
    "src5_build": (src5_build, None),
    "snk2_upsert": (snk2_upsert, f"{_WITH} SELECT split_part(path, '/', 1) AS vault, count(*) AS n_files, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM f GROUP BY 1"),
    "src1_notes": (src1_notes, f"{_WITH} SELECT path, CAST(octet_length(encode(coalesce(content, ''))) AS BIGINT) AS size, sha256(coalesce(content, '')) AS sha256 FROM f"),
    "str1_stream": (str1_stream, _FOLD),
    "par1_frontmatter": (par1_frontmatter, f"SELECT {_PATH} AS path, CAST(p_partkey AS VARCHAR) AS name, 'parts' AS folder, CAST(p_size AS VARCHAR) AS size FROM part"),
    "par3_links": (par3_links, f"""SELECT {_PATH} AS source, 'Makers/' || p_partkey AS target, CAST(p_partkey AS VARCHAR) AS target_key, 'makers/' || p_partkey AS target_path_key, 'it' AS alias, 'Use' AS heading, false AS is_embed FROM part
        UNION ALL SELECT {_PATH}, 'pic.png', 'pic', NULL, NULL, NULL, true FROM part"""),
    "par6_tags": (par6_tags, f"SELECT {_PATH} AS file_path, unnest(['t' || p_size, 'part/x']) AS tag, true AS in_frontmatter FROM part UNION ALL SELECT {_PATH}, 'kind/k' || p_size, false FROM part"),
    "par8_tasks": (par8_tasks, f"SELECT {_PATH} AS file_path, CAST(7 AS INTEGER) AS line_number, 'x' AS status, 'order ' || p_name || ' by 2024-05-0' || (p_size % 9 + 1) AS text, '2024-05-0' || (p_size % 9 + 1) AS due_date FROM part"),
    "par10_blocks": (par10_blocks, f"SELECT {_PATH} AS file_path, 'b' || p_size AS block_id, 'End of it' AS content, CAST(10 AS INTEGER) AS line_number FROM part"),
    "par11_inline": (par11_inline, f"SELECT {_PATH} AS file_path, 'rating' AS key, 'rating' AS key_norm, CAST(p_partkey AS VARCHAR) AS value, CAST(9 AS INTEGER) AS line_number FROM part"),
    "rec1_recall": (rec1_recall, _RECALL),
}


def queries():
    return {n: f for n, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in REGISTERED.items() if s}
