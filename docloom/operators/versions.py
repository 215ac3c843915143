"""Versioned records: what a snapshot sees, compaction, conflicts, and a store of append-only commits."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.plan import PlanError, Where
from ..sources.files import Files
from .predicates import conjunction


def latest(log: DataFrame, key: str, order: list[str], until: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """The newest version of each record at a snapshot, without deleted ones. Ranks are limited before the shuffle."""
    seen = log if until is None else log.where(until)
    newest = seen.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("_rank = 1").drop("_rank")
    return newest if deleted is None else newest.where(~deleted)


def version_counts(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("n_versions"))


def compacted(log: DataFrame, key: str, time_field: str, order: list[str], oldest: Any, floor: int) -> DataFrame:
    """Versions that the oldest snapshot or later ones need: newer ones, the baseline, and floor newest ones."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    base = F.max(F.when(F.col(time_field) <= oldest, F.col(time_field))).over(Window.partitionBy(key))
    marked = log.withColumn("_rank", rank).withColumn("_base", base)
    return marked.where((F.col(time_field) > oldest) | (F.col(time_field) == F.col("_base")) | (F.col("_rank") <= floor)).drop("_rank", "_base")


def conflicts(written: DataFrame, log: DataFrame, key: str, time_field: str, snapshot: Any) -> DataFrame:
    """Keys of the write set that somebody committed after the snapshot."""
    newer = log.where(F.col(time_field) > snapshot).select(key)
    return written.select(key).distinct().join(newer, key, "left_semi")


def last_of_each(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The last row of each key: by a column, which goes, or as the rows come."""
    by, rest = order or "_come", [c for c in rows.columns if c not in (key, order)]
    come = rows if order else rows.withColumn("_come", F.monotonically_increasing_id())
    newest = come.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("_row")) if rest else come.select(key).distinct()
    return newest.select(*[F.col(f"_row.`{c}`") if c in rest else F.col(f"`{c}`") for c in rows.columns if c != order])


def replayed(log: DataFrame, key: str, seq: str = "sequence") -> DataFrame:
    """Versions of a change log: each entry is a commit of its own, in its order, with commit time and operation number."""
    return log.withColumns({"_seq": F.col(seq).cast("long"), "_op": F.lit(0)}).where(F.col(key).isNotNull())


def upserted(base: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """base with the rows of changes instead of those of the same key; of several the last, by order if it is given."""
    changes = last_of_each(changes, key, order)
    return base.join(changes.select(key), key, "left_anti").select(*base.columns).unionByName(changes.select(*base.columns))


def updated(df: DataFrame, wheres: tuple[Where, ...], values: dict[str, Any], key: str) -> DataFrame:
    """All matching rows with the given fields; the key can't change."""
    if key in values:
        raise PlanError(f"{key} can't be changed")
    match = conjunction(wheres, df.schema)
    hit = F.lit(True) if match is None else F.coalesce(match, F.lit(False))
    return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) if c in df.columns else F.when(hit, F.lit(v)) for c, v in values.items()})


def remaining(df: DataFrame, wheres: tuple[Where, ...]) -> DataFrame:
    """Rows that a delete leaves: those that don't match, or whose fields are missing."""
    match = conjunction(wheres, df.schema)
    return df.where(F.lit(False)) if match is None else df.where(~F.coalesce(match, F.lit(False)))


class Conflict(RuntimeError):
    pass


class TooOld(PlanError):
    pass


@dataclass(frozen=True)
class Base:
    """What a compaction wrote: a folder with all that snapshots from oldest to last need."""

    folder: str = ""
    oldest: int = 0
    last: int = 0


class VersionStore:
    """Commits of one collection: Parquet folders, visible once their manifest entry is there.

    A commit writes its data under a name of its own and then publishes the entry
    of its sequence, which only one writer can; the others look for conflicts
    again and try the next one. A writer that dies leaves an unnamed folder and
    nothing else. A compaction publishes a base in the same way; folders that
    nothing names any more go by vacuum(). Records are rows of a fixed schema.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.files = Files(spark, self.path)

    @property
    def fields(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.schema).schema]

    def _base(self) -> Base:
        names = self.files.names("base")
        return Base(**json.loads(self.files.read(f"base/{names[-1]}"))) if names else Base()

    def _entries(self, after: int) -> list[int]:
        return [s for n in self.files.names("manifest") if (s := int(n)) > after]

    def snapshot(self) -> int:
        return max(self._entries(0), default=0) or self._base().last

    def log(self, snapshot: int | None = None) -> DataFrame:
        """All versions up to the snapshot: the record, _seq, _op and _deleted."""
        base = self._base()
        if snapshot is not None and base.folder and snapshot < base.oldest:
            raise TooOld(f"snapshots before {base.oldest} were compacted")
        folders = [base.folder] * bool(base.folder) + [self.files.read(f"manifest/{s:020d}") for s in self._entries(base.last) if snapshot is None or s <= snapshot]
        schema = f"{self.schema}, _seq long, _op int, _deleted boolean"
        found = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)
        return found if snapshot is None else found.where(F.col("_seq") <= snapshot)

    def read(self, snapshot: int | None = None) -> DataFrame:
        return latest(self.log(snapshot), self.key, ["_seq", "_op"], deleted=F.col("_deleted")).drop("_seq", "_op", "_deleted")

    def begin(self) -> Transaction:
        return Transaction(self, self.snapshot())

    def bytes(self) -> int:
        return self.files.size("data")

    def _commit(self, staged: DataFrame, snapshot: int) -> int:
        while True:
            now = self.snapshot()
            if now > snapshot:
                if snapshot < self._base().oldest:
                    raise Conflict("the snapshot was compacted")
                newer = self.log().where(F.col("_seq") > snapshot).select(self.key)
                if not staged.select(self.key).distinct().join(newer, self.key, "left_semi").isEmpty():
                    raise Conflict("a record was changed after the snapshot")
            sequence, folder = now + 1, f"c-{uuid.uuid4().hex}"
            staged.withColumn("_seq", F.lit(sequence).cast("long")).write.parquet(f"{self.path}/data/{folder}")
            if self.files.publish(f"manifest/{sequence:020d}", folder):
                return sequence
            self.files.delete(f"data/{folder}")

    def compact(self, oldest: int, floor: int = 1) -> int:
        """One folder that serves snapshots from oldest on instead of all commits so far; older snapshots can't be read any more."""
        last, before = self.snapshot(), self._base()
        if last <= before.last and oldest <= before.oldest:
            return last
        folder = f"m-{uuid.uuid4().hex}"
        kept = compacted(self.log(last), self.key, "_seq", ["_seq", "_op"], oldest, floor)
        kept.write.parquet(f"{self.path}/data/{folder}")
        text = json.dumps({"folder": folder, "oldest": max(oldest, before.oldest), "last": last})
        if not self.files.publish(f"base/{last:020d}-{max(oldest, before.oldest):020d}", text):
            self.files.delete(f"data/{folder}")
        return last

    def vacuum(self) -> int:
        """Delete entries and folders that no snapshot needs, once their readers and writers are done; how many folders."""
        base = self._base()
        for s in self._entries(0):
            if s <= base.last and s < self.snapshot():
                self.files.delete(f"manifest/{s:020d}")
        named = {base.folder, *[self.files.read(f"manifest/{s:020d}") for s in self._entries(0)]}
        gone = [n for n in self.files.names("data") if n not in named]
        for n in gone:
            self.files.delete(f"data/{n}")
        return len(gone)


@dataclass
class GroupCommit:
    """When what is pending is to be committed: after max_batch records, or max_interval seconds after the first of them."""

    max_batch: int = 1000
    max_interval: float | None = None
    pending: int = 0
    since: float | None = None

    def after(self, records: int, now: float) -> bool:
        """Whether a commit is due after so many more records; if so, nothing is pending any more."""
        self.pending += records
        self.since = now if self.since is None else self.since
        due = self.pending >= max(self.max_batch, 1) or (self.max_interval is not None and now - self.since >= self.max_interval)
        if due:
            self.pending, self.since = 0, None
        return due


class Transaction:
    """Staged changes over a snapshot. Reads see them; commit fails if another commit touched the same records."""

    def __init__(self, store: VersionStore, snapshot: int):
        self.store, self.snapshot, self.staged, self.status = store, snapshot, [], "active"

    def _stage(self, rows: DataFrame, deleted: bool) -> None:
        if self.status != "active":
            raise PlanError("the transaction is over")
        self.staged.append(rows.withColumn("_op", F.lit(len(self.staged))).withColumn("_deleted", F.lit(deleted)))

    def _changes(self) -> DataFrame:
        out = self.staged[0]
        for x in self.staged[1:]:
            out = out.unionByName(x)
        return latest(out, self.store.key, ["_op"])

    def upsert(self, rows: DataFrame) -> None:
        """Within one call the last row of a key wins; rows need the key, and other columns than the store's are refused."""
        if self.store.key not in rows.columns:
            raise PlanError(f"a record needs {self.store.key}")
        names = self.store.fields
        if unknown := set(rows.columns) - set(names):
            raise PlanError(f"the store has no {sorted(unknown)}")
        kinds = {f.name: f.dataType for f in self.store.spark.createDataFrame([], self.store.schema).schema}
        filled = rows.select(*[(F.col(f"`{n}`") if n in rows.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names])
        self._stage(last_of_each(filled, self.store.key), False)

    def update(self, wheres: tuple[Where, ...], values: dict[str, Any]) -> None:
        now = self.read()
        match = conjunction(wheres, now.schema)
        self._stage(updated(now if match is None else now.where(match), (), values, self.store.key), False)

    def delete(self, wheres: tuple[Where, ...]) -> None:
        now = self.read()
        match = conjunction(wheres, now.schema)
        self._stage(now if match is None else now.where(match), True)

    def read(self) -> DataFrame:
        """The snapshot with the transaction's own changes."""
        base = self.store.read(self.snapshot)
        if not self.staged:
            return base
        own = self._changes()
        return base.join(own.select(self.store.key), self.store.key, "left_anti").select(*base.columns).unionByName(own.where("not _deleted").select(*base.columns))

    def commit(self) -> int:
        if self.status != "active":
            raise PlanError("the transaction is over")
        self.status = "committed"
        if not self.staged:
            return self.snapshot
        changes = self._changes()
        if not changes.where(F.col(self.store.key).isNull()).isEmpty():
            self.status = "rolled back"
            raise PlanError(f"a record needs {self.store.key}")
        try:
            return self.store._commit(changes, self.snapshot)
        except Conflict:
            self.status = "rolled back"
            raise

    def rollback(self) -> None:
        self.staged, self.status = [], "rolled back"
