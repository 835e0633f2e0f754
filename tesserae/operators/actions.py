"""Actions on changed notes, and the chain that runs them: index, normalize, parse, apply, set, unset, rename."""

from __future__ import annotations

import shlex
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from . import meta
from .profiles import get_profile

ARGUMENTS = {"index": 0, "normalize": 0, "parse": 0, "apply": 1, "set": 1, "unset": 1, "rename": 2}
IF_EXISTS = ("skip", "overwrite", "merge")


@dataclass(frozen=True)
class Action:
    name: str
    args: tuple[str, ...] = ()

    @classmethod
    def of(cls, text: str) -> Action:
        """``set status=done``, ``rename old new`` and so on."""
        words = shlex.split(text)
        if not words or words[0] not in ARGUMENTS:
            raise ValueError(f"unknown action {text!r}; known: {', '.join(ARGUMENTS)}")
        if len(words) - 1 != ARGUMENTS[words[0]]:
            raise ValueError(f"{words[0]} takes {ARGUMENTS[words[0]]} arguments")
        if words[0] == "set" and "=" not in words[1]:
            raise ValueError("set takes key=value")
        if words[0] == "apply":
            get_profile(words[1])
        return cls(words[0], tuple(words[1:]))


@dataclass(frozen=True)
class Pipeline:
    """What a change triggers."""

    actions: tuple[Action, ...]
    on: tuple[str, ...] | None = None
    paths: tuple[str, ...] = ()
    where: str | None = None
    wait: int = 300
    max_wait: int = 3000
    on_error: str = "continue"
    if_exists: str = "skip"
    dry_run: bool = False

    @classmethod
    def of(cls, config: dict) -> Pipeline:
        if not config.get("actions"):
            raise ValueError("a pipeline needs actions")
        mode, errors = config.get("ifExists", "skip"), config.get("onError", "continue")
        if mode not in IF_EXISTS:
            raise ValueError(f"ifExists is one of {', '.join(IF_EXISTS)}")
        if errors not in ("continue", "stop"):
            raise ValueError("onError is continue or stop")
        bounce = config.get("debounce") or {}
        return cls(
            tuple(Action.of(a) for a in config["actions"]),
            tuple(config["on"]) if config.get("on") else None,
            tuple(config.get("paths") or ()),
            config.get("where"),
            int(bounce.get("wait", 300)),
            int(bounce.get("maxWait", 3000)),
            errors,
            mode,
            bool(config.get("dryRun", False)),
        )


def editor(actions: tuple[Action, ...], if_exists: str = "skip") -> meta.Edit:
    """The editing actions of a chain, in order, as one change of a document."""

    def change(doc: meta.Document, row: dict) -> list[str]:
        done: list[str] = []
        for a in actions:
            if a.name == "normalize":
                done += meta.normalize(doc)
            elif a.name == "apply":
                done += meta.apply_profile(doc, get_profile(a.args[0]), int(row.get("mtime") or 0), row.get("ctime"))
            elif a.name == "set":
                key, _, raw = a.args[0].partition("=")
                meta.set_key(doc, key, meta.coerce(raw, "auto"))
                done.append(f"set {key}")
            elif a.name == "unset":
                if meta.unset_key(doc, a.args[0]):
                    done.append(f"unset {a.args[0]}")
            elif a.name == "rename":
                meta.rename_or(doc, *a.args, mode=if_exists)
                done.append(f"rename {a.args[0]} {a.args[1]}")
        return done

    return change


def run_actions(events: DataFrame, notes: DataFrame, pipeline: Pipeline) -> DataFrame:
    """``(path, type, new_content, changed, skipped, changes, error)`` of routed events and notes (path, content,
    mtime, ctime).  Deleted notes have nothing to edit and are skipped; a dry run changes nothing.

    ``parse`` reports a note's frontmatter that cannot be read as its error.  With ``on_error = stop`` nothing counts
    as changed from the first failing note on, in the order of the events (by ``first_seq``, else by path)."""
    edits = tuple(a for a in pipeline.actions if a.name not in ("index", "parse"))
    live = events.filter("type <> 'unlink'").select("path", "type")
    wanted = notes.join(live.select("path"), "path", "left_semi")
    if edits or any(a.name == "parse" for a in pipeline.actions):
        edited = meta.edit(wanted, editor(edits, pipeline.if_exists))  # reads the frontmatter before any edit
    else:
        edited = wanted.select("path", F.col("content").alias("new_content"), F.lit(False).alias("changed"), F.array().cast("array<string>").alias("changes"), F.lit(None).cast("string").alias("error"))
    place = F.col("first_seq") if "first_seq" in events.columns else F.lit(0)
    out = events.select("path", "type", F.struct(place.cast("bigint").alias("seq"), "path").alias("place")).join(edited, "path", "left")
    skip = F.lit(pipeline.dry_run) | (F.col("type") == "unlink") | (F.col("new_content").isNull() & F.col("error").isNull())
    if pipeline.on_error == "stop":
        out = cut(out, "actions")
        first = out.filter("error IS NOT NULL").agg(F.min("place").alias("first"))  # one row
        out = out.join(F.broadcast(first)).withColumn("stopped", F.col("first").isNotNull() & (F.col("place") > F.col("first")))
        skip = skip | F.col("stopped")
        out = out.withColumn("error", F.when(~F.col("stopped"), F.col("error")))
    return out.select(
        "path",
        "type",
        "new_content",
        (F.coalesce("changed", F.lit(False)) & ~skip).alias("changed"),
        (skip & F.col("error").isNull()).alias("skipped"),
        F.coalesce("changes", F.array().cast("array<string>")).alias("changes"),
        "error",
    )


def stop_on_error(results: DataFrame, pipeline: Pipeline) -> None:
    """Raise the error that stopped a run (there is one at most); notes before it are done, later ones untouched."""
    if pipeline.on_error == "stop":
        bad = results.filter("error IS NOT NULL").select("path", "error").first()
        if bad:
            raise RuntimeError(f"{bad.path}: {bad.error}")


Hook = Callable[[DataFrame], None]
