"""Roots of a collection and the keys of its files."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    """One root: keys are paths relative to it.  Several: prefixed by the name of their root."""

    roots: tuple[str, ...]

    @classmethod
    def of(cls, roots: str | list[str]) -> Layout:
        """Roots inside other roots are left out; two roots of one name cannot be told apart."""
        given = [roots] if isinstance(roots, str) else list(roots)
        uniq = list(dict.fromkeys(os.path.abspath(r) for r in given))
        if not uniq:
            raise ValueError("no roots given")
        top = [r for r in uniq if not any(r != q and r.startswith(q.rstrip(os.sep) + os.sep) for q in uniq)]
        names: dict[str, str] = {}
        for r in top:
            other = names.setdefault(os.path.basename(r), r)
            if other != r:
                raise ValueError(f"roots {other} and {r} have the same name")
        return cls(tuple(top))

    def owner(self, absolute: str) -> str | None:
        """The deepest root that holds a path."""
        holds = [r for r in self.roots if absolute == r or absolute.startswith(r.rstrip(os.sep) + os.sep)]
        return max(holds, key=len) if holds else None

    def key(self, absolute: str) -> str:
        root = self.owner(absolute)
        if root is None:
            return absolute.replace(os.sep, "/")
        rel = os.path.relpath(absolute, root).replace(os.sep, "/")
        return rel if len(self.roots) == 1 else f"{os.path.basename(root)}/{rel}"

    def absolute(self, key: str) -> str:
        if os.path.isabs(key):
            return key
        if len(self.roots) == 1:
            return os.path.join(self.roots[0], key)
        name, _, rest = key.partition("/")
        for r in self.roots:
            if os.path.basename(r) == name:
                return os.path.join(r, rest)
        raise ValueError(f"{key!r} is under none of the roots {[os.path.basename(r) for r in self.roots]}")
