"""The logical query: conditions that must all hold, relation paths, an order and a limit."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any


class PlanError(ValueError):
    """A query that can't be compiled."""


OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "like")
EXTRA_OPS = ("in", "between", "is_null", "not_null")  # extensions
SYMBOLS = {"=": "eq", "==": "eq", "!=": "ne", "<>": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "like": "like"}


@dataclass(frozen=True)
class Where:
    field: str
    op: str
    value: Any = None

    def __post_init__(self):
        if self.op not in OPS + EXTRA_OPS:
            raise PlanError(f"unknown operator {self.op!r}")
        if self.op == "like" and not isinstance(self.value, str):
            raise PlanError("like takes a string pattern")
        if self.op in OPS and (self.value is None or isinstance(self.value, list | dict | tuple | set)):
            raise PlanError(f"unsupported literal {self.value!r}")


@dataclass(frozen=True)
class OrderBy:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class QueryPlan:
    collection: str
    wheres: tuple[Where, ...] = ()
    includes: tuple[str, ...] = ()
    order_by: tuple[OrderBy, ...] = ()
    limit: int | None = None
    fields: tuple[str, ...] | None = None
    offset: int = 0

    def __post_init__(self):
        if self.limit is not None and (isinstance(self.limit, bool) or int(self.limit) < 1):
            raise PlanError("limit must be a positive number")

    def add(self, **changes: Any) -> QueryPlan:
        return replace(self, **changes)


def limit_of(value: Any) -> int:
    """A positive whole number; fractions are cut off."""
    if isinstance(value, bool) or not isinstance(value, int | float) or value < 1:
        raise PlanError("limit must be a positive number")
    return int(value)


@dataclass(frozen=True)
class Relation:
    """A path segment: rows of target whose target_key equals the source_key of a row."""

    name: str
    source_key: str
    target: str
    target_key: str


@dataclass
class CollectionConfig:
    """What the compiler knows of a collection."""

    id_field: str = "id"
    created_field: str | None = None
    updated_field: str | None = None
    sort_fields: tuple[str, ...] = ()
    exact_fields: tuple[str, ...] = ("slug", "title", "email")
    composites: tuple[tuple[str, str], ...] = ()
    relations: dict[str, Relation] = field(default_factory=dict)

    def configured(self, sort_fields: Sequence[str] | None = None, composites: Sequence[Sequence[str]] | None = None, exact_fields: Sequence[str] | None = None) -> CollectionConfig:
        """With other index fields; None leaves them, an empty list turns them off. Blank names are left out."""
        names = lambda x: tuple(sorted({n.strip() for n in x if n.strip()}))
        pairs = lambda x: tuple(sorted({(a.strip(), b.strip()) for a, b in x if a.strip() and b.strip()}))
        return replace(
            self,
            sort_fields=self.sort_fields if sort_fields is None else names(sort_fields),
            composites=self.composites if composites is None else pairs(composites),
            exact_fields=self.exact_fields if exact_fields is None else names(exact_fields),
        )

    def to_json(self) -> str:
        """The index fields, as they are kept beside a store."""
        return json.dumps({"sort_fields": self.sort_fields, "composites": self.composites, "exact_fields": self.exact_fields})

    def from_json(self, text: str) -> CollectionConfig:
        """This configuration with the kept index fields; what the text doesn't name stays."""
        return self.configured(**{k: v for k, v in json.loads(text).items() if k in ("sort_fields", "composites", "exact_fields")})

    def relate(self, relations: Sequence[Relation]) -> CollectionConfig:
        self.relations |= {r.name: r for r in relations}
        return self
