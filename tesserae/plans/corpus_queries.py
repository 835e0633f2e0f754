"""Queries p1 and p3: drifting schemas and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, orphans
from ..runtime import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    steps = drift.steps_of(drift.registry(load(spark, d, "files")))
    return steps.select("vault", "period", "field_before", "field_after")


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    r = drift.registry(load(spark, d, "files"))
    return r.select("vault", "month", "fingerprint", "parent", F.array_join("fields", "|").alias("fields"))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "files")
    versions, counts = drift.survey(files)
    return drift.unify(files, versions, counts=counts)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_links(*(load(spark, d, t) for t in ("links", "files", "changes", "asset_types")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("id", "period")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(*(load(spark, d, t) for t in ("links", "files", "changes", "asset_types")))


def queries():
    return {"p1_found": p1_found, "p1_versions": p1_versions, "p1_table": p1_table, "p3_found": p3_found, "p3_counts": p3_counts}


_P3 = r"""
WITH last AS (SELECT path, arg_max(type, (happened_at, change_id)) AS t FROM changes GROUP BY path),
live AS (SELECT DISTINCT f.path, f.name_key, f.path_key, f.ctime FROM files f
         LEFT JOIN last ON last.path = f.path WHERE coalesce(last.t, '') <> 'unlink'),
keys AS (SELECT 'P' AS kind, lower(regexp_replace(path_key, '^\s+|\s+$', '', 'g')) AS key, min(ctime) AS c FROM live GROUP BY 1, 2
         UNION ALL
         SELECT 'N', lower(regexp_replace(name_key, '^\s+|\s+$', '', 'g')), min(ctime) FROM live GROUP BY 1, 2),
src AS (SELECT path, max(mtime) AS at FROM files GROUP BY path),
refs AS (SELECT DISTINCT l.id, l.source, CASE WHEN l.target_path_key IS NOT NULL THEN 'P' ELSE 'N' END AS kind,
         lower(regexp_replace(coalesce(l.target_path_key, l.target_key), '^\s+|\s+$', '', 'g')) AS key, src.at
         FROM links l JOIN src ON src.path = l.source
         WHERE regexp_replace(coalesce(l.target, ''), '\s', '', 'g') <> ''
           AND lower(regexp_extract(regexp_replace(l.target, '\s+$', ''), '\.([^./\\]+)$', 1)) NOT IN (SELECT lower(extension) FROM asset_types)),
orphan AS (SELECT refs.id, split_part(refs.source, '/', 1) AS vault, strftime(to_timestamp(refs.at / 1000) AT TIME ZONE 'UTC', '%Y-%m') AS period
           FROM refs LEFT JOIN keys ON keys.kind = refs.kind AND keys.key = refs.key AND keys.c <= refs.at
           WHERE keys.key IS NULL)
"""


_P1 = r"""
WITH d AS (SELECT DISTINCT ON (path) path, ctime, frontmatter FROM files WHERE ctime IS NOT NULL),
n AS (SELECT path, split_part(path, '/', 1) AS vault, strftime(make_timestamp(ctime * 1000), '%Y-%m') AS month,
  CASE WHEN json_valid(frontmatter) AND ltrim(frontmatter)[1] = '{' THEN CAST(frontmatter AS JSON) END AS fm FROM d),
m AS (SELECT vault, month, count(*) AS notes FROM n GROUP BY 1, 2),
e AS (SELECT vault, month, j.key AS field, CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array'
  WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type FROM n, json_each(n.fm) j WHERE fm IS NOT NULL AND j.type <> 'NULL'),
t AS (SELECT vault, month, field, type, count(*) AS n FROM e GROUP BY ALL),
c AS (SELECT vault, month, field, sum(n) AS carriers, arg_min(type, (-n, type)) AS type FROM t GROUP BY 1, 2, 3),
f AS (SELECT vault, month, list_sort(list(field || ':' || c.type)) AS fields FROM c JOIN m USING (vault, month) WHERE carriers * 2 > notes GROUP BY 1, 2),
v AS (SELECT vault, month, coalesce(array_to_string(fields, chr(10)), '') AS x, coalesce(array_to_string(fields, '|'), '') AS fields FROM m LEFT JOIN f USING (vault, month))
SELECT vault, month, sha256(x) AS fingerprint, sha256(lag(x) OVER (PARTITION BY vault ORDER BY month)) AS parent, fields FROM v
"""


def oracle_sql():
    return {
        "p1_versions": _P1,
        "p3_found": _P3 + "SELECT id, period FROM orphan",
        "p3_counts": _P3 + "SELECT vault, period, count(*) AS n_orphans FROM orphan GROUP BY 1, 2",
    }
