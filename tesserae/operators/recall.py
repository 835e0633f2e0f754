"""Fuzzy lookup in a small collection of documented skills."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.notes import read_json5

SKILL = "name string, description string, triggers array<string>, patterns array<string>, rules array<string>"
THRESHOLD, SHORTEST = 0.4, 2


#: The skill that is there where no folder of skills is.
FALLBACK = {"name": "query-notes", "description": "Ask for notes by tag, link, folder and field.", "triggers": ["query", "list notes", "table of notes"], "patterns": ["LIST FROM #tag WHERE field = value"], "rules": ["Quote texts.", "Limit long results."]}


def load_skills(spark: SparkSession, folder: str) -> DataFrame:
    """Skills of the ``*.json`` and ``*.json5`` files of a folder, the fallback where there is no such file; one without
    name, triggers or rules is an error."""
    rows = []
    for f in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
        if f.endswith((".json", ".json5")):
            with open(os.path.join(folder, f), encoding="utf-8") as h:
                d = (read_json5 if f.endswith("5") else json.loads)(h.read())
            if not isinstance(d, dict) or not d.get("name") or not isinstance(d.get("triggers"), list) or not isinstance(d.get("rules"), list):
                raise ValueError(f"{f}: a skill needs name, triggers and rules")
            rows.append(d)
    rows = [(d["name"], d.get("description"), d["triggers"], d.get("patterns") or [], d["rules"]) for d in rows or [FALLBACK]]
    return spark.createDataFrame(rows, SKILL)


def names(skills: DataFrame) -> list[str]:
    return [r.name for r in skills.select("name").orderBy("name").collect()]  # a small collection by its nature


def get(skills: DataFrame, name: str) -> dict:
    found = skills.filter(F.col("name") == name).first()
    if found is None:
        raise ValueError(f"no skill {name!r}; there are {', '.join(names(skills))}")
    return found.asDict()


def render_all(skills: DataFrame) -> str:
    return "\n".join(render(r.asDict()) for r in skills.orderBy("name").collect())


def recall(skills: DataFrame, keyword: str) -> DataFrame:
    """``(name, score)``, best (lowest) first: distance of the phrase and of its words to the name (weight 2) and
    the triggers (weight 1); 0 is exact, a contained word is near, above the threshold is no match."""
    q = keyword.strip().lower()
    words = list(dict.fromkeys([q, *(w for w in q.split() if len(w) >= SHORTEST)]))
    if len(q) < SHORTEST:
        return skills.select("name", F.lit(0.0).alias("score")).limit(0)
    terms = skills.select("name", F.explode(F.concat(F.array(F.struct(F.lower("name").alias("t"), F.lit(1.0).alias("w"))), F.transform("triggers", lambda t: F.struct(F.lower(t).alias("t"), F.lit(1.5).alias("w"))))).alias("x"))
    scores = []
    for w in words:
        t = F.col("x.t")
        far = F.levenshtein(t, F.lit(w)) / F.greatest(F.length(t), F.lit(len(w)))
        scores.append(F.when(t == w, 0.0).when(t.contains(w) | F.lit(w).contains(t), F.lit(0.1)).otherwise(far))
    best = F.least(*scores) if len(scores) > 1 else scores[0]
    return terms.groupBy("name").agg(F.round(F.min(best * F.col("x.w")), 6).alias("score")).filter(F.col("score") <= THRESHOLD).orderBy("score", "name")


def render(skill: dict) -> str:
    """A skill as Markdown."""
    out = [f"# {skill['name']}", ""]
    if skill.get("description"):
        out += [skill["description"], ""]
    for title, key in (("Triggers", "triggers"), ("Patterns", "patterns"), ("Rules", "rules")):
        if skill.get(key):
            out += [f"## {title}", "", *(f"- {x}" for x in skill[key]), ""]
    return "\n".join(out).rstrip() + "\n"
