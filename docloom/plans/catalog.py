"""Named collections over DataFrames, and the fluent queries on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..operators.versions import VersionStore
from ..sources.files import open_parquet
from .compile import compile_plan, compile_rows, include_count, include_rows
from .plan import SYMBOLS, CollectionConfig, OrderBy, PlanError, QueryPlan, Where, limit_of
from .views import AccessDenied, View

if TYPE_CHECKING:
    from .frontends import Mutation

DURABILITY = ("strict", "batch", "deferred")
BULK = 10_000  # documents of one bulk insert


class Catalog:
    """Collections by name. Frames are lazy; nothing is read before a query runs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: dict[str, DataFrame] = {}
        self.configs: dict[str, CollectionConfig] = {}
        self.stores: dict[str, VersionStore] = {}
        self.folder: str | None = None

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, configs: dict[str, CollectionConfig]) -> Catalog:
        catalog = cls(spark)
        catalog.folder, catalog.configs = folder, dict(configs)
        return catalog

    def add(self, name: str, frame: DataFrame, config: CollectionConfig | None = None) -> Catalog:
        self.frames[name], self.configs[name] = frame, config or CollectionConfig()
        return self

    def with_config(self, name: str, frame: DataFrame, config: CollectionConfig) -> Catalog:
        """A catalogue with one collection more; this one stays as it is."""
        out = Catalog(self.spark)
        out.folder, out.frames, out.configs, out.stores = self.folder, dict(self.frames), dict(self.configs), dict(self.stores)
        return out.add(name, frame, config)

    def attach(self, name: str, store: VersionStore, config: CollectionConfig | None = None) -> Catalog:
        """A collection that can be written: each query sees the store's newest commit."""
        config = config or CollectionConfig(store.key)
        if store.files.exists("indexes.json"):
            config = config.from_json(store.files.read("indexes.json"))
        self.stores[name], self.configs[name] = store, config
        return self

    def store(self, name: str) -> VersionStore:
        if name not in self.stores:
            raise PlanError(f"{name} can't be written")
        return self.stores[name]

    def configure(self, name: str, **fields: Any) -> CollectionConfig:
        """Other index fields (sort_fields, composites, exact_fields), kept beside the collection's store if it has one."""
        self.configs[name] = self.config(name).configured(**fields)
        if name in self.stores:
            self.stores[name].files.write("indexes.json", self.configs[name].to_json())
        return self.configs[name]

    def execute(self, change: Mutation, view: View | None = None) -> int:
        """Commit an insert, update or delete; the number of records concerned. A conflict with another writer raises."""
        store = self.store(change.collection)
        if view is not None:
            if not view.may_write(change.collection):
                raise AccessDenied(f"{view.name} may not change {change.collection}")
            if change.wheres:
                view.check(QueryPlan(change.collection, change.wheres))
        change_of = store.begin()
        if change.kind == "insert":
            return self.bulk_insert(change.collection, [change.values], view=view)
        if change.kind == "update":
            change_of.update(change.wheres, change.values)
        else:
            change_of.delete(change.wheres)
        n = change_of.staged[-1].count()
        if n:
            change_of.commit()
        return n

    def bulk_insert(self, name: str, documents: list[dict[str, Any]] | DataFrame, durability: str = "strict", most: int = BULK, view: View | None = None) -> int:
        """Insert documents, or put them in the place of those with their keys, as one commit; of one key's the last stays.

        A commit is whole in any mode; the mode is checked and otherwise only
        says what a caller expects. A list is bounded by most, a frame is not.
        """
        if durability not in DURABILITY:
            raise PlanError(f"unknown durability {durability!r}")
        if view is not None and not view.may_write(name):
            raise AccessDenied(f"{view.name} may not change {name}")
        store = self.store(name)
        if not isinstance(documents, DataFrame):
            if len(documents) > most:
                raise PlanError(f"more than {most} documents")
            if not documents:
                return 0
            if any(not isinstance(d.get(store.key), int) or isinstance(d.get(store.key), bool) for d in documents):
                raise PlanError(f"a document needs a whole number as {store.key}")
            if unknown := {k for d in documents for k in d} - set(store.fields):
                raise PlanError(f"the store has no {sorted(unknown)}")
            rows = [tuple(d.get(f) for f in store.fields) for d in documents]
            documents = self.spark.createDataFrame(rows, store.schema).coalesce(1)
        change = store.begin()
        change.upsert(documents)
        n = change.staged[-1].count()
        change.commit()
        return n

    def frame(self, name: str) -> DataFrame:
        """The collection's frame; a Parquet one is opened when it is first asked for."""
        if name in self.stores:
            return self.stores[name].read()
        if name not in self.frames:
            if self.folder is None or name not in self.configs:
                raise PlanError(f"no collection named {name}")
            self.frames[name] = open_parquet(self.spark, f"{self.folder}/{name}.parquet")
        return self.frames[name]

    def config(self, name: str) -> CollectionConfig:
        self.frame(name)
        return self.configs[name]

    def collection(self, name: str, view: View | None = None) -> Query:
        self.frame(name)
        return Query(self, QueryPlan(name), view)

    def record_counts(self, *names: str) -> DataFrame:
        """(collection, record_count), one row for each collection."""
        parts = [self.frame(n).agg(F.count("*").alias("record_count")).select(F.lit(n).alias("collection"), "record_count") for n in names or sorted(self.configs)]
        return reduce(DataFrame.union, parts)

    def register_views(self) -> None:
        """Each collection as a temporary view for spark.sql."""
        for name in self.configs:
            self.frame(name).createOrReplaceTempView(name)


class Query:
    """An immutable query under construction."""

    def __init__(self, catalog: Catalog, plan: QueryPlan, view: View | None = None):
        self.catalog, self.plan, self.view = catalog, plan, view

    def _with(self, **changes: Any) -> Query:
        return Query(self.catalog, self.plan.add(**changes), self.view)

    def where(self, field: str, op: str, value: Any = None) -> Query:
        """One more condition; earlier ones on the same field stay."""
        op = SYMBOLS.get(op.lower(), op.lower())
        return self._with(wheres=(*self.plan.wheres, Where(field, op, value)))

    def include(self, path: str) -> Query:
        return self._with(includes=(*self.plan.includes, path))

    def order_by(self, field: str, direction: str = "asc") -> Query:
        if direction.lower() not in ("asc", "desc"):
            raise PlanError(f"unknown direction {direction!r}")
        return self._with(order_by=(*self.plan.order_by, OrderBy(field, direction.lower() == "desc")))

    def limit(self, n: int) -> Query:
        return self._with(limit=limit_of(n))

    def offset(self, n: int) -> Query:
        return self._with(offset=n)

    def select(self, *fields: str) -> Query:
        return self._with(fields=fields)

    def df(self) -> DataFrame:
        return compile_plan(self.plan, self.catalog, self.view)

    def related(self, path: str) -> DataFrame:
        """Rows reached from the query's rows along a dotted path; repeats are kept, dangling references dropped."""
        return include_rows(compile_rows(self.plan, self.catalog, self.view), self.plan.collection, path, self.catalog, self.view)

    def include_count(self, path: str) -> DataFrame:
        """The query's rows with n_related, the number of records that each reaches."""
        return include_count(compile_rows(self.plan, self.catalog, self.view), self.plan.collection, path, self.catalog, self.view)

    def count(self) -> DataFrame:
        return self.df().agg(F.count("*").alias("n"))

    def group_by(self, *fields: str) -> Any:
        return self.df().groupBy(*fields)

    def fetch(self) -> list[Row]:
        return self.df().collect()

    def fetch_one(self) -> DataFrame:
        return self._with(limit=1).df()

    def stream(self, accept: Callable[[Row], bool]) -> tuple[int, int]:
        """Rows handed to accept until it refuses one: (accepted, seen)."""
        accepted = seen = 0
        for row in self._iterate():
            seen += 1
            if not accept(row):
                break
            accepted += 1
        return accepted, seen

    def _iterate(self) -> Iterator[Row]:
        return self.df().toLocalIterator()
