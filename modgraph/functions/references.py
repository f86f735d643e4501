"""References as values: builders, accessors and their text, and the same accessors over tables of references."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = ("none", "crate", "self", "super")


@dataclass(frozen=True)
class GroupItem:
    """One item of a braced import. kind: simple, alias, self, glob or nested."""

    kind: str
    name: str = ""
    alias: str = ""
    prefix: tuple[str, ...] = ()
    items: tuple[GroupItem, ...] = ()

    @classmethod
    def of(cls, text: str) -> GroupItem:
        """``*`` is a glob, ``self`` the module itself, anything else a simple name."""
        return cls({"*": "glob", "self": "self"}.get(text, "simple"), text if text not in ("*", "self") else "")

    @classmethod
    def nested(cls, prefix: tuple[str, ...] | list[str], items: list[GroupItem]) -> GroupItem:
        return cls("nested", prefix=tuple(prefix), items=tuple(items))

    def __str__(self) -> str:
        if self.kind == "nested":
            path = "::".join(self.prefix)
            if not self.items:
                return path
            inner = ", ".join(map(str, self.items))
            bare = len(self.items) == 1 and self.items[0].kind == "simple"
            return f"{path}::{inner}" if bare else f"{path}::{{{inner}}}"
        text = {"glob": "*", "self": "self"}.get(self.kind, self.name)
        return f"{text} as {self.alias}" if self.alias else text


@dataclass(frozen=True)
class Reference:
    """A path with its prefix and what follows it (nothing, an alias, a glob or a group)."""

    segments: tuple[str, ...]
    prefix: str = "none"
    levels: int = 0
    alias: str | None = None
    glob: bool = False
    group: tuple[GroupItem, ...] | None = None

    @classmethod
    def of(cls, *segments: str) -> Reference:
        return cls(tuple(segments))

    def with_crate_prefix(self) -> Reference:
        return replace(self, prefix="crate", levels=0)

    def with_self_prefix(self) -> Reference:
        return replace(self, prefix="self", levels=0)

    def with_super(self, levels: int) -> Reference:
        return replace(self, prefix="super", levels=levels)

    def with_alias(self, alias: str) -> Reference:
        return replace(self, alias=alias, glob=False, group=None)

    def with_glob(self) -> Reference:
        return replace(self, alias=None, glob=True, group=None)

    def with_group(self, items: list[GroupItem]) -> Reference:
        return replace(self, alias=None, glob=False, group=tuple(items))

    @property
    def is_relative(self) -> bool:
        return self.prefix != "none"

    def is_from_crate(self, name: str) -> bool:
        return self.prefix == "none" and self.segments[:1] == (name,)

    @property
    def final_name(self) -> str | None:
        return self.alias if self.alias is not None else self.segments[-1] if self.segments else None

    def truncated(self, depth: int) -> Reference:
        """The first names; what followed the path goes if any name does."""
        if len(self.segments) <= depth:
            return self
        return replace(self, segments=self.segments[:depth], alias=None, glob=False, group=None)

    def __str__(self) -> str:
        start = {"crate": "crate::", "self": "self::", "super": "super::" * self.levels}.get(self.prefix, "")
        path = "::".join(self.segments)
        joint = "::" if path else ""
        if self.group is not None:
            end = f"{joint}{{{', '.join(map(str, self.group))}}}"
        elif self.glob:
            end = f"{joint}*"
        else:
            end = f" as {self.alias}" if self.alias is not None else ""
        return start + path + end


# ---- the same over columns prefix, segments, suffix and suffix_text


def is_relative() -> Column:
    return F.col("prefix") != "none"


def is_from_crate(name: str) -> Column:
    return (F.col("prefix") == "none") & F.coalesce(F.get("segments", F.lit(0)) == name, F.lit(False))


def has_glob() -> Column:
    return F.col("suffix") == "glob"


def has_group() -> Column:
    return F.col("suffix") == "group"


def final_name() -> Column:
    """The alias, else the last name; null of a reference without names."""
    return F.when(F.col("suffix") == "alias", F.col("suffix_text")).otherwise(F.get("segments", F.size("segments") - 1))
