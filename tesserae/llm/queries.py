"""Queries p2, p4, p5, p6, p7 and p8 of this subpackage, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import load, spread
from . import abuse, cooccurrence, neardup, packing, splitting, tokens

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(load(spark, d, "files"))
    return pieces.filter("piece_no = 1 AND n_pieces > 1").select("path")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(load(spark, d, "files"))


def _pair_table(spark: SparkSession, d: str) -> cooccurrence.PairTable:
    """Loaded in two increments: the tags of the frontmatter, then the whole baskets of all notes."""
    tags = load(spark, d, "tags")
    table = cooccurrence.update(cooccurrence.create(spark), cooccurrence.baskets_of(tags.filter("in_frontmatter")))
    return cooccurrence.update(table, cooccurrence.baskets_of(tags))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    scores = cooccurrence.associations(_pair_table(spark, d))
    return cooccurrence.associated(scores).select("tag_a", "tag_b")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.associations(_pair_table(spark, d)).withColumn("lift", F.round("lift", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(spread(load(spark, d, "files").select("path", "content"))).select(
        F.col("key_a").alias("path_a"), F.col("key_b").alias("path_b")
    )


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(spread(load(spark, d, "files").select("path", "content"))).select(
        F.col("key").alias("path"), F.col("group_key").alias("group_path"), "n_links"
    )


def _documents(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(load(spark, d, "documents").select("doc_id", "text", *more))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_documents(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.token_counts(_documents(spark, d)))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = _documents(spark, d, "source", "page_id")
    model = abuse.fit(*abuse.labelled_words(documents, load(spark, d, "review_labels")))
    return abuse.score(documents, model)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("flagged").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d))


def queries() -> dict[str, Query]:
    return {
        "p2_found": p2_found,
        "p2_pieces": p2_pieces,
        "p4_found": p4_found,
        "p4_scores": p4_scores,
        "p5_found": p5_found,
        "p5_groups": p5_groups,
        "p6_ids": p6_ids,
        "p7_pack": p7_pack,
        "p7_report": p7_report,
        "p8_found": p8_found,
        "p8_scores": p8_scores,
        "p8_rates": p8_rates,
    }


_P4 = r"""
WITH t AS (
  SELECT DISTINCT file_path AS f, lower(regexp_replace(tag, '^[\s#]+|\s+$', '', 'g')) AS tag
  FROM tags WHERE tag IS NOT NULL AND file_path IS NOT NULL
), u AS (SELECT * FROM t WHERE tag <> ''),
m AS (SELECT tag, count(*) AS n FROM u GROUP BY tag HAVING count(*) >= 5),
v AS (SELECT u.f, u.tag FROM u JOIN m USING (tag)),
p AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab
      FROM v a JOIN v b ON a.f = b.f AND a.tag < b.tag GROUP BY 1, 2 HAVING count(*) >= 5),
n AS (SELECT count(DISTINCT f) AS n FROM u)
SELECT p.tag_a, p.tag_b, p.n_ab, x.n AS n_a, y.n AS n_b, n.n AS n,
       round(p.n_ab * CAST(n.n AS DOUBLE) / (x.n * y.n), 6) AS lift
FROM p JOIN m x ON x.tag = p.tag_a JOIN m y ON y.tag = p.tag_b CROSS JOIN n
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "SELECT DISTINCT path FROM files WHERE length(content) > 4000",
        "p4_found": f"SELECT tag_a, tag_b FROM ({_P4}) WHERE n_ab * n >= 4 * n_a * n_b",
        "p4_scores": _P4,
    }
