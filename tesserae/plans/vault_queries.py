"""Queries over the note tables: one per operator of the query language, with the SQL that must agree.

The six tables are the given ones; inline fields are bound from the due dates of tasks (key ``Due``,
the last line of a note counts), which exercises the union of frontmatter and inline fields.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import search as fts
from ..runtime import load, shared_dir
from .catalog import Catalog


def catalog(spark: SparkSession, d: str) -> Catalog:
    c = Catalog.from_parquet(spark, d)
    due = c.tasks.filter("due_date IS NOT NULL").select(
        "file_path", F.lit("Due").alias("key"), F.lit("due").alias("key_norm"), F.col("due_date").alias("value"), "line_number"
    )
    return c.with_tables(inline_fields=due)


def engine(spark: SparkSession, d: str) -> Engine:
    return Engine(catalog(spark, d))


def flat(df: DataFrame) -> DataFrame:
    """Plain column names and scalar values, so that results can be compared."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            c = F.array_join(F.sort_array(c), "|")
        elif kind.startswith("array"):
            c = F.array_join(F.transform(c, lambda x: F.concat_ws("~", x.status, x.text, x.due)), "|")
        out.append(c.alias(name.replace(".", "_").replace("()", "").replace("(", "_").replace(")", "")))
    return df.select(*out)


def run(dql: str, **kw):
    return lambda spark, d: flat(engine(spark, d).query(dql, **kw).df)


TODAY = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d")

_WITH = r"""
WITH f AS (SELECT DISTINCT path, name, name_key, path_key, extension, folder, size, mtime, ctime, content, frontmatter,
             CASE WHEN json_valid(frontmatter) THEN CAST(CASE WHEN json_type(frontmatter) = 'OBJECT' THEN frontmatter END AS JSON) END AS fm FROM files),
l AS (SELECT DISTINCT id, source, target, target_key, target_path_key FROM links),
k AS (SELECT DISTINCT file_path, line_number, status, text, due_date FROM tasks),
i AS (SELECT file_path, arg_max(due_date, line_number) AS due FROM k WHERE due_date IS NOT NULL GROUP BY file_path),
tg AS (SELECT file_path, list_sort(list(DISTINCT tag)) AS tags FROM tags WHERE tag IS NOT NULL GROUP BY file_path),
ol AS (SELECT source, list_sort(list(DISTINCT target)) AS outlinks FROM l GROUP BY source),
il AS (SELECT x.path, list_sort(list(DISTINCT x.source)) AS inlinks FROM (
  SELECT f.path, l.source FROM f JOIN l ON l.target_path_key = f.path_key WHERE l.target_path_key IS NOT NULL
  UNION SELECT f.path, l.source FROM f JOIN l ON l.target_key = f.name_key WHERE l.target_path_key IS NULL) x GROUP BY x.path)
"""


def _type(x: str) -> str:
    return f"coalesce(json_type(f.fm, '$.{x}'), 'NULL')"


def rank(x: str) -> str:
    return f"CASE WHEN {_type(x)} = 'NULL' THEN 0 WHEN {_type(x)} IN ('VARCHAR', 'ARRAY', 'OBJECT') THEN 2 ELSE 1 END"


def num(x: str) -> str:
    return (
        f"CASE WHEN {_type(x)} = 'BOOLEAN' THEN CASE json_extract_string(f.fm, '$.{x}') WHEN 'true' THEN 1.0 ELSE 0.0 END "
        f"WHEN {rank(x)} = 1 THEN CAST(json_extract_string(f.fm, '$.{x}') AS DOUBLE) END"
    )


def txt(x: str) -> str:
    return f"CASE WHEN {rank(x)} = 2 THEN json_extract_string(f.fm, '$.{x}') END"


def shown(x: str) -> str:
    """The value as text, whole numbers without a decimal point."""
    return (
        f"CASE {rank(x)} WHEN 1 THEN CASE WHEN ({num(x)}) = floor({num(x)}) THEN CAST(CAST({num(x)} AS BIGINT) AS VARCHAR) "
        f"ELSE CAST({num(x)} AS VARCHAR) END WHEN 2 THEN {txt(x)} END"
    )


def cmp_num(x: str, op: str, n: str) -> str:
    return f"CASE {rank(x)} WHEN 1 THEN ({num(x)}) {op} {n} WHEN 2 THEN {'true' if op in ('>', '>=', '!=') else 'false'} END"


def cmp_txt(x: str, op: str, s: str) -> str:
    return f"CASE {rank(x)} WHEN 1 THEN {'true' if op in ('<', '<=', '!=') else 'false'} WHEN 2 THEN ({txt(x)}) {op} '{s}' END"


def truthy(x: str, inline: str = "NULL") -> str:
    return (
        f"CASE WHEN {_type(x)} = 'NULL' THEN coalesce(length({inline}) > 0, false) WHEN {rank(x)} = 1 THEN ({num(x)}) <> 0 "
        f"WHEN {_type(x)} = 'VARCHAR' THEN length({txt(x)}) > 0 WHEN {_type(x)} = 'ARRAY' THEN json_array_length(f.fm, '$.{x}') > 0 "
        f"ELSE len(json_keys(f.fm, '$.{x}')) > 0 END"
    )


LIST = "f.name AS file_name, f.path AS file_path"


def listed(where: str, joins: str = "") -> str:
    return f"{_WITH} SELECT {LIST} FROM f {joins} WHERE {where}"


_TAG_AREA = "f.path IN (SELECT file_path FROM tags WHERE tag = 'area' OR lower(tag) LIKE 'area/%')"
_LINKS_HOME = "f.path IN (SELECT source FROM l WHERE target_key = 'home')"
_FOLDER = "(f.folder = 'commons' OR lower(f.folder) LIKE 'commons/%')"

# name, query, SQL
CASES: list[tuple[str, str, str]] = [
    ("prj1_list", "LIST", f"{_WITH} SELECT {LIST} FROM f"),
    ("prj2_table", "TABLE file.folder, file.size, status", f"{_WITH} SELECT f.name AS file_name, f.folder AS file_folder, f.size AS file_size, {shown('status')} AS status FROM f"),
    ("prj3_task", "TASK", f"{_WITH} SELECT k.text AS task_text, k.status AS task_status, k.due_date AS task_due, f.path AS file_path FROM k JOIN f ON f.path = k.file_path"),
    ("prj4_without_id", "TABLE WITHOUT ID file.path, rating", f"{_WITH} SELECT f.path AS file_path, {shown('rating')} AS rating FROM f"),
    ("prj4_list_without_id", 'LIST WITHOUT ID FROM "commons"', f"{_WITH} SELECT f.path AS file_path FROM f WHERE {_FOLDER}"),
    ("prj5_dedup", "TABLE file.name, file.mtime, file.mtime, file.name", f"{_WITH} SELECT f.name AS file_name, f.mtime AS file_mtime FROM f"),
    ("prj7_columns", "TABLE WITHOUT ID file.path, file.folder, file.extension, file.size, file.mtime, file.ctime",
     f"{_WITH} SELECT path AS file_path, folder AS file_folder, extension AS file_extension, size AS file_size, mtime AS file_mtime, ctime AS file_ctime FROM f"),
    ("prj8_frontmatter", "TABLE WITHOUT ID file.path, file.frontmatter", f"{_WITH} SELECT path AS file_path, coalesce(frontmatter, '{{}}') AS file_frontmatter FROM f"),
    ("prj9_tags", "TABLE WITHOUT ID file.path, file.tags", f"{_WITH} SELECT f.path AS file_path, coalesce(array_to_string(tg.tags, '|'), '') AS file_tags FROM f LEFT JOIN tg ON tg.file_path = f.path"),
    ("prj10_inlinks", "TABLE WITHOUT ID file.path, file.inlinks", f"{_WITH} SELECT f.path AS file_path, coalesce(array_to_string(il.inlinks, '|'), '') AS file_inlinks FROM f LEFT JOIN il ON il.path = f.path"),
    ("prj11_outlinks", "TABLE WITHOUT ID file.path, file.outlinks", f"{_WITH} SELECT f.path AS file_path, coalesce(array_to_string(ol.outlinks, '|'), '') AS file_outlinks FROM f LEFT JOIN ol ON ol.source = f.path"),
    ("prj12_tasks", "TABLE WITHOUT ID file.path, file.tasks",
     f"""{_WITH}, tk AS (SELECT file_path, string_agg(concat_ws('~', status, text, due_date), '|' ORDER BY line_number, status, text) AS tasks FROM k GROUP BY file_path)
     SELECT f.path AS file_path, coalesce(tk.tasks, '') AS file_tasks FROM f LEFT JOIN tk ON tk.file_path = f.path"""),
    ("prj13_inline", "TABLE WITHOUT ID file.path, due", f"{_WITH} SELECT f.path AS file_path, coalesce({shown('due')}, i.due) AS due FROM f LEFT JOIN i ON i.file_path = f.path"),
    ("flt1_tag", "LIST FROM #area", listed(_TAG_AREA)),
    ("flt1_tag_nested", "LIST FROM #type/salt", listed("f.path IN (SELECT file_path FROM tags WHERE tag = 'type/salt' OR lower(tag) LIKE 'type/salt/%')")),
    ("flt2_folder", 'LIST FROM "commons"', listed(_FOLDER)),
    ("flt2_whole_vault", 'LIST FROM ""', f"{_WITH} SELECT {LIST} FROM f"),
    ("flt3_link", "LIST FROM [[Home]]", listed(_LINKS_HOME)),
    ("flt4_number", "LIST WHERE rating >= 4", listed(cmp_num("rating", ">=", "4"))),
    ("flt4_text", "LIST WHERE status = \"active\"", listed(cmp_txt("status", "=", "active"))),
    ("flt4_mixed", "LIST WHERE created > 5", listed(cmp_num("created", ">", "5"))),
    ("flt4_mixed_text", 'LIST WHERE created < "2023"', listed(cmp_txt("created", "<", "2023"))),
    ("flt4_size", 'LIST WHERE file.size >= "900"', listed("f.size >= 900")),
    ("flt5_boolean", "LIST WHERE published = true", listed(cmp_num("published", "=", "1"))),
    ("flt6_logic", 'LIST WHERE (status = "active" OR rating > 3) AND file.size > 500', listed(f"(({cmp_txt('status', '=', 'active')}) OR ({cmp_num('rating', '>', '3')})) AND f.size > 500")),
    ("flt7_not", 'LIST WHERE NOT (status = "active")', listed(f"NOT ({cmp_txt('status', '=', 'active')})")),
    ("flt8_truthy", "LIST WHERE published", listed(truthy("published"))),
    ("flt8_truthy_inline", "LIST WHERE due", listed(truthy("due", "i.due"), "LEFT JOIN i ON i.file_path = f.path")),
    ("flt9_truthy_file", "LIST WHERE file.size", listed("f.size IS NOT NULL")),
    ("flt10_truthy_arrays", "LIST WHERE file.inlinks AND file.tags", listed("il.inlinks IS NOT NULL AND tg.tags IS NOT NULL", "LEFT JOIN il ON il.path = f.path LEFT JOIN tg ON tg.file_path = f.path")),
    ("flt11_frontmatter", "LIST WHERE file.frontmatter", listed("f.fm IS NOT NULL AND len(json_keys(f.fm)) > 0")),
    ("flt12_null", "LIST WHERE due = null", listed(f"{rank('due')} = 0 AND i.due IS NULL", "LEFT JOIN i ON i.file_path = f.path")),
    ("flt12_not_null", "LIST WHERE rating != null", listed(f"{rank('rating')} <> 0")),
    ("flt13_contains", 'LIST WHERE contains(file.name, "HOME")', listed("contains(lower(f.name), 'home')")),
    ("flt14_icontains", 'LIST WHERE icontains(title, "glacier")', listed(f"contains(lower({shown('title')}), 'glacier')")),
    ("flt15_startswith", 'LIST WHERE startswith(file.path, "COMMONS/")', listed("starts_with(lower(f.path), 'commons/')")),
    ("flt15_endswith", 'LIST WHERE endswith(file.name, "HOME")', listed("suffix(lower(f.name), 'home')")),
    ("flt16_tags", 'LIST WHERE contains(file.tags, "#area")', listed(_TAG_AREA)),
    ("flt16_tags_or", 'LIST WHERE contains(file.tags, "area") OR file.size > 5000', listed(f"{_TAG_AREA} OR f.size > 5000")),
    ("flt17_tags_any_case", 'LIST WHERE icontains(file.tags, "AREA")', listed("f.path IN (SELECT file_path FROM tags WHERE lower(tag) = 'area' OR lower(tag) LIKE 'area/%')")),
    ("flt18_outlinks", 'LIST WHERE NOT contains(file.outlinks, "[[Home]]")', listed(f"NOT ({_LINKS_HOME})")),
    ("flt19_inlinks", 'LIST WHERE contains(file.inlinks, "Home")',
     listed("list_has_any(il.inlinks, (SELECT list(path) FROM f WHERE name_key = 'home'))", "JOIN il ON il.path = f.path")),
    ("flt20_regex", 'LIST WHERE regexmatch(file.name, "^[A-Z][a-z]+ [a-z]+")', listed("regexp_matches(f.name, '^[A-Z][a-z]+ [a-z]+')")),
    ("flt20_regexp_infix", 'LIST WHERE NOT status REGEXP "^a"', listed(f"NOT coalesce(regexp_matches({shown('status')}, '^a'), false)")),
    ("flt21_array_text", 'LIST WHERE startswith(file.tags, "[\\"area")', listed("starts_with(lower(to_json(tg.tags)), '[\"area')", "JOIN tg ON tg.file_path = f.path")),
    ("flt22_completed", "TASK WHERE completed", f"{_WITH} SELECT k.text AS task_text, k.status AS task_status, k.due_date AS task_due, f.path AS file_path FROM k JOIN f ON f.path = k.file_path WHERE k.status IN ('x', 'X')"),
    ("flt22_open", 'TASK FROM "commons" WHERE completed = false', f"{_WITH} SELECT k.text AS task_text, k.status AS task_status, k.due_date AS task_due, f.path AS file_path FROM k JOIN f ON f.path = k.file_path WHERE k.status NOT IN ('x', 'X') AND {_FOLDER}"),
    ("agg1_group", "LIST GROUP BY status", f"{_WITH} SELECT {shown('status')} AS status, array_to_string(list_sort(list(DISTINCT f.path)), '|') AS rows FROM f GROUP BY 1"),
    ("agg3_count", "TABLE status, count(), length(rows) GROUP BY status", f"{_WITH} SELECT {shown('status')} AS status, count(DISTINCT f.path) AS count, count(DISTINCT f.path) AS length_rows FROM f GROUP BY 1"),
    ("agg3_extension", "TABLE file.extension, count() GROUP BY file.extension", f"{_WITH} SELECT extension AS file_extension, count(*) AS count FROM f GROUP BY 1"),
    ("agg5_bare", "TABLE file.folder, file.name, file.size, count() GROUP BY file.folder", f"{_WITH} SELECT folder AS file_folder, arg_min(name, path) AS file_name, arg_min(size, path) FILTER (path = least_path) AS file_size, count(*) AS count FROM (SELECT *, min(path) OVER (PARTITION BY folder) AS least_path FROM f) GROUP BY folder"),
    ("agg6_group_tags", "TABLE count() GROUP BY file.tags", f"{_WITH} SELECT count(DISTINCT f.path) AS count FROM f LEFT JOIN tg ON tg.file_path = f.path GROUP BY tg.tags"),
    ("agg7_group_flatten", "TABLE status, count() GROUP BY status FLATTEN file.tags", f"{_WITH} SELECT {shown('status')} AS status, count(DISTINCT f.path) AS count FROM f JOIN tg ON tg.file_path = f.path GROUP BY 1"),
    ("fla1_tags", "TABLE WITHOUT ID file.path, tag FLATTEN file.tags", f"{_WITH} SELECT f.path AS file_path, unnest(tg.tags) AS tag FROM f JOIN tg ON tg.file_path = f.path"),
    ("fla1_outlinks", "LIST FLATTEN file.outlinks", f"{_WITH} SELECT {LIST}, unnest(ol.outlinks) AS file_outlinks FROM f JOIN ol ON ol.source = f.path"),
    ("fla1_inlinks", 'LIST WITHOUT ID FROM "commons" FLATTEN file.inlinks', f"{_WITH} SELECT f.path AS file_path, unnest(il.inlinks) AS file_inlinks FROM f JOIN il ON il.path = f.path WHERE {_FOLDER}"),
    ("fla4_filter_before", "LIST WHERE file.size > 3000 FLATTEN file.tags", f"{_WITH} SELECT {LIST}, unnest(tg.tags) AS file_tags FROM f JOIN tg ON tg.file_path = f.path WHERE f.size > 3000"),
    ("srt1_multikey", "TABLE WITHOUT ID file.path, file.folder SORT file.folder DESC, file.mtime LIMIT 40", f"{_WITH} SELECT path AS file_path, folder AS file_folder FROM f ORDER BY folder DESC NULLS LAST, mtime NULLS FIRST, path LIMIT 40"),
    ("srt1_mixed_type", "TABLE WITHOUT ID file.path, created SORT created DESC LIMIT 60",
     f"{_WITH} SELECT f.path AS file_path, {shown('created')} AS created FROM f ORDER BY {rank('created')} DESC, {num('created')} DESC NULLS LAST, {txt('created')} DESC NULLS LAST, f.path LIMIT 60"),
    ("srt3_topk", "LIST FROM #area SORT file.mtime DESC LIMIT 10", f"{_WITH} SELECT {LIST} FROM f WHERE {_TAG_AREA} ORDER BY mtime DESC, path LIMIT 10"),
    ("fn1_lower", 'LIST WHERE lower(status) = "active"', listed(f"lower({shown('status')}) = 'active'")),
    ("fn1_upper", 'LIST WHERE upper(file.name) < "B"', listed("upper(f.name) < 'B'")),
    ("fn2_length", "LIST WHERE length(file.name) > 20", listed("length(f.name) > 20")),
    ("fn2_length_array", "LIST WHERE length(file.tags) >= 4", listed("len(tg.tags) >= 4", "JOIN tg ON tg.file_path = f.path")),
    ("fn3_round", "LIST WHERE round(hours) = 12",
     listed(f"CASE {rank('hours')} WHEN 1 THEN floor({num('hours')} + 0.5) = 12 WHEN 2 THEN coalesce(TRY_CAST(nullif(regexp_extract({txt('hours')}, '^\\s*([+-]?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE), 0) BETWEEN 11.5 AND 12.4999 END")),
    ("fn4_date", 'LIST WHERE created >= "2023-06-01" AND created < "2023-07-01"', listed(f"({cmp_txt('created', '>=', '2023-06-01')}) AND ({cmp_txt('created', '<', '2023-07-01')})")),
    ("fn4_today", "LIST WHERE created <= date(today) AND created > \"2023-06-01\"", listed(f"({cmp_txt('created', '<=', TODAY)}) AND ({cmp_txt('created', '>', '2023-06-01')})")),
]


def flt3_link_qualified(spark: SparkSession, d: str) -> DataFrame:
    """Notes that link to the note which most links name by its path."""
    by = catalog(spark, d).links.filter("target_path_key IS NOT NULL").groupBy("target_path_key").agg(F.count(F.lit(1)).alias("n"))
    top = by.orderBy(F.desc("n"), "target_path_key").first().target_path_key
    return flat(engine(spark, d).query(f"LIST FROM [[{top}#Top|x]]").df)


def flt23_list(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).list(folder="commons", tag="#type", name="A").df


def srt4_page(spark: SparkSession, d: str) -> DataFrame:
    return flat(engine(spark, d).query("LIST SORT file.mtime DESC", offset=20, size=30).df)


def agg8_total(spark: SparkSession, d: str) -> DataFrame:
    r = engine(spark, d).query("LIST LIMIT 300", offset=290, size=25)
    return r.all_rows.agg(F.count(F.lit(1)).alias("total"))


def cht1_read_note(spark: SparkSession, d: str) -> DataFrame:
    """Five lines of the longest note's body."""
    e = engine(spark, d)
    path = e.catalog.files.orderBy(F.desc(F.length("content")), "path").select("path").first().path
    return e.read_note(path, offset=1, size=5).df


def fts2_and(spark: SparkSession, d: str) -> DataFrame:
    return fts.search(catalog(spark, d).files, "glacier harvest").select("path", "name")


def fts3_ideographs(spark: SparkSession, d: str) -> DataFrame:
    return fts.search(catalog(spark, d).files, "採石場 灯台の").select("path", "name")


def fts4_like(spark: SparkSession, d: str) -> DataFrame:
    return fts.search(catalog(spark, d).files, "PR salt").select("path", "name")


def fts5_bm25(spark: SparkSession, d: str) -> DataFrame:
    r = fts.search(catalog(spark, d).files, "glacier", with_score=True)
    return r.select("path", F.round("score", 6).alias("score"))


def fts8_literals(spark: SparkSession, d: str) -> DataFrame:
    return fts.search(catalog(spark, d).files, "[x]").select("path", "name")


def fts7_snippet(spark: SparkSession, d: str) -> DataFrame:
    return fts.search(catalog(spark, d).files, "glacier harvest").select("path", "snippet")


def _indexed(spark: SparkSession, d: str):
    files = catalog(spark, d).files
    return files, fts.GramIndex.write(files, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")


def fts9_index(spark: SparkSession, d: str) -> DataFrame:
    """Every hit with its score, from the postings of an index that is built first."""
    _, index = _indexed(spark, d)
    return fts.indexed_hits(index, ["glacier"], True).select("path", F.round("score", 6).alias("score"))


def fts9_snippets(spark: SparkSession, d: str) -> DataFrame:
    """A search on the index, with the snippets of all hits."""
    files, index = _indexed(spark, d)
    return fts.search(files, "glacier harvest", index).select("path", "snippet")


_TEXT = "lower(concat_ws(chr(1), f.path, f.name, f.content))"
_HITS = f"{_WITH} SELECT f.path, f.name FROM f WHERE contains({_TEXT}, 'glacier') AND contains({_TEXT}, 'harvest')"


def _like(t: str) -> str:
    return f"(contains(lower(f.content), '{t}') OR contains(lower(f.name), '{t}'))"


_SNIPPET = r"""
, s AS (SELECT path, trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g'), ' ') AS flat FROM h),
p AS (SELECT path, flat, instr(lower(flat), 'glacier') AS a, instr(lower(flat), 'harvest') AS b FROM s),
q AS (SELECT *, CASE WHEN a > 0 AND (b = 0 OR a <= b) THEN a ELSE b END AS pos FROM p)
SELECT path, CASE WHEN pos = 0 THEN substr(flat, 1, 64) ELSE
  concat(CASE WHEN pos > 21 THEN '… ' ELSE '' END, substr(flat, greatest(pos - 20, 1), pos - greatest(pos - 20, 1)), '[', substr(flat, pos, 7), ']',
         substr(flat, pos + 7, 44), CASE WHEN pos + 7 + 44 <= length(flat) THEN ' …' ELSE '' END) END AS snippet FROM q
"""

_LEN = "greatest(length(coalesce(path, '')) - 2, 0) + greatest(length(coalesce(name, '')) - 2, 0) + greatest(length(coalesce(content, '')) - 2, 0)"
_BM25 = f"""{_WITH}, w AS (SELECT path, (length({_TEXT}) - length(replace({_TEXT}, 'glacier', ''))) / 7 AS tf, {_LEN} AS len FROM f),
n AS (SELECT count(*) AS n, avg(len) AS avglen, count(*) FILTER (tf > 0) AS held FROM w)
SELECT path, round(greatest(0.000001, ln((n - held + 0.5) / (held + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen)), 6) AS score
FROM w, n WHERE tf > 0"""

_FTS7 = f"{_WITH}, h AS (SELECT f.path, f.content FROM f WHERE contains({_TEXT}, 'glacier') AND contains({_TEXT}, 'harvest')) {_SNIPPET}"

OTHERS = {
    "flt23_list": (flt23_list, f"{_WITH} SELECT path, name, folder, mtime FROM f WHERE {_FOLDER} AND f.path IN (SELECT file_path FROM tags WHERE tag = 'type' OR starts_with(lower(tag), 'type/')) AND contains(lower(name), 'a')"),
    "flt3_link_qualified": (flt3_link_qualified, listed("f.path IN (SELECT source FROM l WHERE target_path_key = (SELECT target_path_key FROM l WHERE target_path_key IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))")),
    "srt4_page": (srt4_page, f"{_WITH} SELECT {LIST} FROM f ORDER BY mtime DESC, path LIMIT 30 OFFSET 20"),
    "agg8_total": (agg8_total, f"{_WITH} SELECT count(*) AS total FROM (SELECT * FROM f LIMIT 300)"),
    "cht1_read_note": (cht1_read_note, _WITH + r""", b AS (SELECT string_split(regexp_replace(content, '\A---[ \t]*\r?\n(?s:.*?\r?\n)??---[ \t]*(?:\r?\n|\z)', ''), chr(10)) AS l FROM f WHERE content IS NOT NULL ORDER BY length(content) DESC, path LIMIT 1)
        SELECT CAST(i - 1 AS INTEGER) AS line, l[i] AS text FROM b, generate_series(2, 6) t(i) WHERE i <= len(l)"""),
    "fts2_and": (fts2_and, _HITS),
    "fts3_ideographs": (fts3_ideographs, f"{_WITH} SELECT f.path, f.name FROM f WHERE contains({_TEXT}, '採石場') OR contains({_TEXT}, '灯台の')"),
    "fts4_like": (fts4_like, f"{_WITH} SELECT f.path, f.name FROM f WHERE {_like('pr')} AND {_like('salt')}"),
    "fts5_bm25": (fts5_bm25, _BM25),
    "fts7_snippet": (fts7_snippet, _FTS7),
    "fts8_literals": (fts8_literals, f"{_WITH} SELECT f.path, f.name FROM f WHERE contains({_TEXT}, '[x]')"),
    "fts9_index": (fts9_index, _BM25),
    "fts9_snippets": (fts9_snippets, _FTS7),
}


def queries():
    return {n: run(q) for n, q, _ in CASES} | {n: f for n, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, _, s in CASES} | {n: s for n, (_, s) in OTHERS.items() if s}
