"""A facade in the shape of a server's endpoints: documents, queries, administration, counters. No network."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from . import frontends
from .catalog import BULK, Catalog
from .plan import PlanError
from .views import View


class Overloaded(RuntimeError):
    pass


@dataclass
class Metrics:
    """Counters of a service, for this process."""

    requests: int = 0
    failed: int = 0
    rejected: int = 0
    slow: int = 0
    inflight: int = 0
    latencies_ms: list[float] = field(default_factory=list)
    by_field: dict[str, int] = field(default_factory=dict)  # how often a field was asked about

    KEPT = 10_000  # latencies, the newest

    def observe(self, ms: float, good: bool) -> None:
        self.requests += 1
        self.failed += not good
        self.latencies_ms.append(ms)
        del self.latencies_ms[: -self.KEPT]


class Service:
    """Requests over one catalogue, a bounded number at a time."""

    def __init__(self, catalog: Catalog, most_requests: int = 64, slow_ms: float = 250.0, most_bulk: int = BULK):
        self.catalog, self.most_requests, self.slow_ms, self.most_bulk = catalog, most_requests, slow_ms, most_bulk
        self.metrics, self.slow_log, self.started = Metrics(), [], time.time()
        self._slots, self._lock = threading.BoundedSemaphore(most_requests), threading.Lock()

    def _request(self, what: str, run: Callable[[], Any]) -> Any:
        if not self._slots.acquire(blocking=False):
            with self._lock:
                self.metrics.rejected += 1
            raise Overloaded("too many requests; try again later")
        began, good = time.perf_counter(), False
        with self._lock:
            self.metrics.inflight += 1
        try:
            out = run()
            good = True
            return out
        finally:
            ms = (time.perf_counter() - began) * 1000
            with self._lock:
                self.metrics.inflight -= 1
                self.metrics.observe(ms, good)
                if ms > self.slow_ms:
                    self.metrics.slow += 1
                    self.slow_log = [*self.slow_log[-999:], {"what": what, "ms": ms}]
            self._slots.release()

    def health(self) -> dict[str, Any]:
        return {"ok": True}

    def query(self, collection: str, filter: dict[str, Any] | None = None, sort: dict[str, Any] | None = None, limit: int | None = None, include: list[str] | None = None, view: View | None = None) -> dict[str, Any]:
        """The rows of a document filter, collected; a large result is asked for as find()."""

        def run() -> dict[str, Any]:
            rows = [r.asDict(recursive=True) for r in self.find(collection, filter, sort, limit, include, view).collect()]
            return {"ok": True, "rows": rows, "count": len(rows)}

        return self._request(f"query {collection} {filter}", run)

    def find(self, collection: str, filter: dict[str, Any] | None = None, sort: dict[str, Any] | None = None, limit: int | None = None, include: list[str] | None = None, view: View | None = None) -> DataFrame:
        plan = frontends.find_plan(collection, filter, sort, limit, include)
        with self._lock:
            for name in {w.field for w in plan.wheres}:
                self.metrics.by_field[f"{collection}.{name}"] = self.metrics.by_field.get(f"{collection}.{name}", 0) + 1
        query = self.catalog.collection(collection, view)
        return type(query)(self.catalog, plan, view).df()

    def insert_one(self, collection: str, document: dict[str, Any], view: View | None = None) -> dict[str, Any]:
        return self._request(f"insert {collection}", lambda: {"ok": True, "affected": self.catalog.execute(frontends.insert_one(collection, document), view)})

    def update(self, collection: str, filter: dict[str, Any], update: dict[str, Any], view: View | None = None) -> dict[str, Any]:
        return self._request(f"update {collection} {filter}", lambda: {"ok": True, "affected": self.catalog.execute(frontends.update_where(collection, filter, update), view)})

    def delete(self, collection: str, filter: dict[str, Any], view: View | None = None) -> dict[str, Any]:
        return self._request(f"delete {collection} {filter}", lambda: {"ok": True, "affected": self.catalog.execute(frontends.delete_where(collection, filter), view)})

    def bulk(self, collection: str, documents: list[dict[str, Any]], durability: str = "strict", view: View | None = None) -> dict[str, Any]:
        run = lambda: {"ok": True, "inserted": self.catalog.bulk_insert(collection, documents, durability, self.most_bulk, view), "durability": durability}
        return self._request(f"bulk {collection}", run)

    def sync(self, collection: str) -> dict[str, Any]:
        """Commits are whole files that are there once they are named; nothing is left to write."""
        return {"ok": True, "collection": collection, "snapshot": self.catalog.store(collection).snapshot()}

    def configure(self, collection: str, **fields: Any) -> dict[str, Any]:
        self.catalog.configure(collection, **fields)
        return self.summary(collection, counted=False)

    def add_sort_index(self, collection: str, name: str) -> dict[str, Any]:
        return self.configure(collection, sort_fields=[*self.catalog.config(collection).sort_fields, name])

    def add_composite(self, collection: str, filter_field: str, order_field: str) -> dict[str, Any]:
        return self.configure(collection, composites=[*self.catalog.config(collection).composites, (filter_field, order_field)])

    def summary(self, collection: str, counted: bool = True) -> dict[str, Any]:
        """A collection's records, stored bytes and index fields."""
        config, store = self.catalog.config(collection), self.catalog.stores.get(collection)
        indexes = {"sort": list(config.sort_fields), "composite": [list(x) for x in config.composites], "exact": list(config.exact_fields), "state": "ready"}
        return {"ok": True, "collection": collection, "record_count": self.catalog.frame(collection).count() if counted else None, "bytes": store.bytes() if store else None, "indexes": indexes}

    def collections(self) -> dict[str, Any]:
        found = [self.summary(n) for n in sorted(self.catalog.configs)]
        return {"ok": True, "collections": found, "count": len(found)}

    def status(self) -> dict[str, Any]:
        names = sorted(self.catalog.configs)
        total = sum(r["record_count"] for r in self.catalog.record_counts(*names).collect()) if names else 0
        return {"ok": True, "uptime_seconds": int(time.time() - self.started), "collections": names, "total_records": total, "active": self.metrics.inflight, "most_requests": self.most_requests}

    def rebuild(self, collection: str, root: str) -> dict[str, Any]:
        """Write the collection's indexes under root, from its configuration."""
        from ..operators.indexes import IndexCatalogue

        config, frame = self.catalog.config(collection), self.catalog.frame(collection)
        there = set(frame.columns)
        if missing := [f for f in (*config.sort_fields, *(x for pair in config.composites for x in pair)) if f not in there]:
            raise PlanError(f"{collection} has no {missing}")
        made = IndexCatalogue(self.catalog.spark, root, tuple(f for f in config.exact_fields if f in there), config.sort_fields, config.composites)
        made.rebuild(frame, config.id_field)
        return {"ok": True, "hash": made.hash_fields, "range": made.range_fields, "composite": made.composites}
