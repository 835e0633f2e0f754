"""Built-in metadata profiles: which fields a note should have, and which of them files can provide."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    key: str
    role: str  # required, recommended, optional
    type: str
    derive: str | None = None  # birthtime, mtime, sha256-body


@dataclass(frozen=True)
class Profile:
    name: str
    title: str
    fields: tuple[Field, ...]

    def field(self, key: str) -> Field | None:
        return next((f for f in self.fields if f.key == key), None)


# fixed values: the fields of the known conventions
BUILTIN: dict[str, Profile] = {
    "pkm-note": Profile(
        "pkm-note",
        "Personal note",
        (
            Field("tags", "recommended", "list"),
            Field("aliases", "optional", "list"),
            Field("cssclasses", "optional", "list"),
            Field("created", "recommended", "datetime", "birthtime"),
            Field("modified", "recommended", "datetime", "mtime"),
            Field("status", "optional", "string"),
        ),
    ),
    "llm-wiki": Profile(
        "llm-wiki",
        "Wiki page for language models",
        (
            Field("type", "required", "string"),
            Field("title", "recommended", "string"),
            Field("description", "recommended", "string"),
            Field("resource", "recommended", "url"),
            Field("tags", "recommended", "list"),
            Field("timestamp", "recommended", "datetime", "mtime"),
            Field("sha256", "optional", "string", "sha256-body"),
        ),
    ),
    "ssg-blog": Profile(
        "ssg-blog",
        "Post of a static site",
        (
            Field("title", "required", "string"),
            Field("pubDate", "required", "date", "birthtime"),
            Field("description", "required", "string"),
            Field("updatedDate", "optional", "date", "mtime"),
            Field("draft", "optional", "boolean"),
            Field("tags", "optional", "list"),
            Field("slug", "optional", "string"),
        ),
    ),
}


def get_profile(name: str) -> Profile:
    if name not in BUILTIN:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(BUILTIN)}")
    return BUILTIN[name]
