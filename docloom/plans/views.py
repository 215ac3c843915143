"""Access views: which collections and fields somebody may see, change and ask about."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from .plan import PlanError, QueryPlan


class AccessDenied(PlanError):
    pass


@dataclass(frozen=True)
class ViewDefinition:
    """Full access sees every field that isn't excluded; partial access sees what is included."""

    name: str
    parent: str | None = None
    full: bool = False
    collections: frozenset[str] = frozenset()
    mutations: frozenset[str] = frozenset()
    include: frozenset[str] = frozenset()
    additionally_include: frozenset[str] = frozenset()
    exclude: frozenset[str] = frozenset()
    masks: dict[str, Column] = field(default_factory=dict, hash=False, compare=False)


@dataclass(frozen=True)
class View:
    name: str
    full: bool
    collections: frozenset[str]
    mutations: frozenset[str]
    include: frozenset[str]
    exclude: frozenset[str]
    masks: dict[str, Column] = field(default_factory=dict, hash=False, compare=False)
    allow_hidden_predicates: bool = False

    def may_read(self, collection: str) -> bool:
        return collection in self.collections or "*" in self.collections

    def may_write(self, collection: str) -> bool:
        return collection in self.mutations or "*" in self.mutations

    def visible(self, collection: str, name: str) -> bool:
        """Exclusion wins; no list of included fields shows nothing."""
        return self.may_read(collection) and name not in self.exclude and (self.full or name in self.include)

    def check(self, plan: QueryPlan) -> None:
        """Hidden fields can't be asked about either, unless that is allowed."""
        if not self.may_read(plan.collection):
            raise AccessDenied(f"{self.name} may not read {plan.collection}")
        if not self.allow_hidden_predicates:
            for name in [w.field for w in plan.wheres] + [o.field for o in plan.order_by]:
                if not self.visible(plan.collection, name):
                    raise AccessDenied(f"{self.name} may not ask about {name}")

    def apply(self, df: DataFrame, collection: str) -> DataFrame:
        """Visible columns only, masked where the view has a mask; part of the plan, so hidden columns aren't read."""
        if not self.may_read(collection):
            raise AccessDenied(f"{self.name} may not read {collection}")
        return df.select(*[self.masks[c].alias(c) if c in self.masks else df[c] for c in df.columns if self.visible(collection, c)])


class Views:
    """Definitions by name, and which session uses which."""

    def __init__(self):
        self.definitions: dict[str, ViewDefinition] = {}
        self.sessions: dict[str, str] = {}

    def define(self, definition: ViewDefinition) -> None:
        self.definitions[definition.name] = definition

    def bind(self, session: str, view: str) -> None:
        self.sessions[session] = view

    def of_session(self, session: str) -> View:
        if session not in self.sessions:
            raise AccessDenied("no view is bound to the session")
        return self.resolve(self.sessions[session])

    def resolve(self, name: str) -> View:
        """A view with all it inherits. A missing parent or a cycle is an error."""
        chain: list[ViewDefinition] = []
        at: str | None = name
        while at is not None:
            if at not in self.definitions:
                raise PlanError(f"no view named {at}")
            if any(x.name == at for x in chain):
                raise PlanError(f"view {at} inherits from itself")
            chain.append(self.definitions[at])
            at = self.definitions[at].parent
        union = lambda *names: frozenset().union(*[getattr(x, n) for x in chain for n in names])
        masks: dict[str, Column] = {}
        for x in reversed(chain):
            masks |= x.masks
        return View(name, chain[0].full, union("collections"), union("mutations"), union("include", "additionally_include"), union("exclude"), masks)
