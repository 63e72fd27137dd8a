"""Statements as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Name:
    """A column, perhaps qualified by its table."""

    column: str
    table: str | None = None


@dataclass(frozen=True)
class Distance:
    """Distance of a row's point to a literal or named point."""

    column: str
    point: tuple[float, float] | str
    metric: str = "haversine"


@dataclass(frozen=True)
class Compare:
    left: Name | Distance
    op: str
    value: Any


@dataclass(frozen=True)
class Between:
    left: Name
    low: Any
    high: Any


@dataclass(frozen=True)
class Inside:
    column: str
    ring: tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Match:
    column: str
    query: str


@dataclass(frozen=True)
class Similar:
    """``target``: numbers, or the text in quotes (a media file), or a Name (refused)."""

    target: Any
    k: int = 10
    column: str | None = None


@dataclass(frozen=True)
class All_:
    parts: tuple


@dataclass(frozen=True)
class Any_:
    parts: tuple


@dataclass(frozen=True)
class Item:
    """One result column: ``kind`` is star, column, aggregate or score."""

    kind: str
    name: Name | None = None
    function: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    how: str
    table: str
    left: Name
    right: Name


@dataclass(frozen=True)
class Key:
    by: Name | Distance
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    joins: tuple[Join, ...] = ()
    where: Any = None
    using: str | None = None
    metric: str | None = None
    group: tuple[Name, ...] = ()
    order: tuple[Key, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Features:
    """A feature vector that is computed when the statement runs."""

    file: str
    kind: str | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, Any], ...]
    where: Any = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any = None


@dataclass(frozen=True)
class Type:
    """``kind``: int, bigint, double or string; ``length`` in bytes where a VARCHAR names it."""

    kind: str
    length: int | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, Type], ...]
    key: str
    storage: str = "heap"
    if_missing: bool = False


@dataclass(frozen=True)
class DropTable:
    table: str
    if_there: bool = False


@dataclass(frozen=True)
class CreateIndex:
    table: str
    columns: tuple[str, ...]
    kind: str = "bplus_unclustered"
    name: str | None = None
    unique: bool = False
    if_missing: bool = False
    metric: str | None = None


@dataclass(frozen=True)
class DropIndex:
    name: str
    table: str | None = None
    if_there: bool = False


@dataclass(frozen=True)
class SetPoint:
    name: str
    point: tuple[float, float]


@dataclass(frozen=True)
class Transaction:
    action: str


@dataclass(frozen=True)
class Explain:
    statement: Any
    analyze: bool = False


@dataclass
class Query:
    """A SELECT built in Python: the same tree without the text."""

    table: str
    items: list[Item] = field(default_factory=lambda: [Item("star")])
    joins: list[Join] = field(default_factory=list)
    where: Any = None
    group: list[Name] = field(default_factory=list)
    order: list[Key] = field(default_factory=list)
    limit: int | None = None

    def statement(self) -> Select:
        return Select(tuple(self.items), self.table.lower(), tuple(self.joins), self.where, None, None, tuple(self.group), tuple(self.order), self.limit)
