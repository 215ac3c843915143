"""From the logical query to one lazy DataFrame; Catalyst does the rest."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.predicates import conjunction
from .plan import CollectionConfig, OrderBy, PlanError, QueryPlan, Relation
from .views import AccessDenied, View

if TYPE_CHECKING:
    from .catalog import Catalog


def implicit_order(plan: QueryPlan, config: CollectionConfig, columns: list[str]) -> tuple[OrderBy, ...]:
    """Newest first where a limit has no order, unless the query names one record or one exact string."""
    if plan.order_by or plan.limit is None:
        return plan.order_by
    if any(w.field == config.id_field and w.op == "eq" for w in plan.wheres):
        return ()
    if len(plan.wheres) == 1 and plan.wheres[0].op == "eq" and isinstance(plan.wheres[0].value, str) and plan.wheres[0].field in config.exact_fields:
        return ()
    choices = [config.created_field, config.updated_field, *sorted(config.sort_fields)[:1]]
    name = next((c for c in choices if c and c in columns), None)
    return (OrderBy(name, True),) if name else ()


def ordering(order: tuple[OrderBy, ...], config: CollectionConfig, columns: list[str]) -> list[Column]:
    """Natural order, nulls lowest; ties by the record id in the direction of the last key."""
    for o in order:
        if o.field not in columns:
            raise PlanError(f"no field {o.field} to order by")
    keys = [F.col(f"`{o.field}`").desc_nulls_last() if o.descending else F.col(f"`{o.field}`").asc_nulls_first() for o in order]
    if order and config.id_field in columns and all(o.field != config.id_field for o in order):
        tie = F.col(f"`{config.id_field}`")
        keys.append(tie.desc_nulls_last() if order[-1].descending else tie.asc_nulls_first())
    return keys


def compile_rows(plan: QueryPlan, catalog: Catalog, view: View | None = None) -> DataFrame:
    """Filter, order and limit; all columns, for includes to join by."""
    df, config = catalog.frame(plan.collection), catalog.config(plan.collection)
    if view is not None:
        view.check(plan)
    if (wanted := conjunction(plan.wheres, df.schema)) is not None:
        df = df.where(wanted)
    if keys := ordering(implicit_order(plan, config, df.columns), config, df.columns):
        df = df.orderBy(*keys)
    if plan.offset:
        df = df.offset(plan.offset)
    return df if plan.limit is None else df.limit(plan.limit)


def compile_plan(plan: QueryPlan, catalog: Catalog, view: View | None = None) -> DataFrame:
    """Filter, order, limit, relations, projection, in this order."""
    df = compile_rows(plan, catalog, view)
    kept = _shown(df.columns, plan.collection, view)
    for path in plan.includes:
        df = with_include(df, plan.collection, path, catalog, view)
    df = df.select(*kept, *[F.col(f"`{p}`") for p in plan.includes])
    if plan.fields is not None:
        missing = [f for f in plan.fields if f not in df.columns]
        df = df.select(*[F.lit(None).alias(f) if f in missing else F.col(f"`{f}`") for f in plan.fields])
    return df


def _shown(columns: list[str], collection: str, view: View | None, names: dict[str, str] | None = None) -> list[Column]:
    """The columns that a view shows, masked; names: what a collection's columns are called in the frame."""
    called = names or {c: c for c in columns}
    if view is None:
        return [F.col(f"`{called[c]}`") for c in columns]
    return [view.masks[c].alias(called[c]) if c in view.masks else F.col(f"`{called[c]}`") for c in columns if view.visible(collection, c)]


def _steps(collection: str, path: str, catalog: Catalog, view: View | None) -> list[str]:
    """The collections along a path; each must be there and be readable."""
    at, out = collection, []
    for segment in path.split("."):
        relation = catalog.config(at).relations.get(segment)
        if relation is None:
            raise PlanError(f"{at} has no relation {segment}")
        at = relation.target
        if view is not None and not view.may_read(at):
            raise AccessDenied(f"{view.name} may not read {at}")
        out.append(at)
    return out


def include_rows(roots: DataFrame, collection: str, path: str, catalog: Catalog, view: View | None = None) -> DataFrame:
    """Rows reached from roots, with the roots' columns before those of each step. An empty path reaches nothing.

    roots: all columns of the collection; a view's choice and masks are applied
    to them and to each step at the end, after the joins by key.
    """
    if not path:
        return roots.select(*_shown(roots.columns, collection, view)).where(F.lit(False))
    at, here = roots, collection
    shown = _shown(roots.columns, collection, view)
    for segment, name in zip(path.split("."), _steps(collection, path, catalog, view)):
        relation = catalog.config(here).relations[segment]
        target = catalog.frame(name)
        called = {c: f"{segment}.{c}" if c in at.columns else c for c in target.columns}
        target = target.select(*[F.col(f"`{c}`").alias(n) for c, n in called.items()])
        joined = at.join(target, at[f"`{relation.source_key}`"] == target[f"`{called[relation.target_key]}`"])
        shown += _shown(list(called), name, view, called)
        at, here = joined, name
    return at.select(*shown)


def with_include(roots: DataFrame, collection: str, path: str, catalog: Catalog, view: View | None = None) -> DataFrame:
    """roots with a column named as the path: the related records, ordered by id; empty where there are none.

    A root's records make one row, so this is for relations of few; include_rows
    gives them as rows and include_count counts them.
    """
    if path in roots.columns:
        raise PlanError(f"{collection} has a column {path}, which the relation's would be taken for")
    config, target = catalog.config(collection), _steps(collection, path, catalog, view)[-1]
    steps = path.split(".")
    key, id_field = f"`{config.id_field}`", catalog.config(target).id_field
    reached = include_rows(roots.select(key, f"`{config.relations[steps[0]].source_key}`").distinct(), collection, path, catalog)
    names = {c: (f"{steps[-1]}.{c}" if f"{steps[-1]}.{c}" in reached.columns else c) for c in catalog.frame(target).columns}
    shown = [v.alias(k) for k, v in zip([c for c in names if view is None or view.visible(target, c)], _shown(list(names), target, view, names))]
    record = F.struct(F.col(f"`{names[id_field]}`").alias("_order"), F.struct(*shown).alias("record"))
    lists = reached.groupBy(F.col(key).alias("_root")).agg(F.transform(F.sort_array(F.collect_list(record)), lambda x: x["record"]).alias(path))
    joined = roots.join(lists, roots[key].eqNullSafe(lists["_root"]), "left").drop("_root")
    empty = F.array().cast(lists.schema[path].dataType)
    return joined.withColumn(path, F.coalesce(F.col(f"`{path}`"), empty))


def include_count(roots: DataFrame, collection: str, path: str, catalog: Catalog, view: View | None = None) -> DataFrame:
    """roots with the number of related records in n_related, counted before the join."""
    config = catalog.config(collection)
    _steps(collection, path, catalog, view)
    first = config.relations[path.split(".")[0]]
    keys = roots.select(F.col(f"`{first.source_key}`").alias("_key"))
    here = CollectionConfig(id_field="_key").relate([Relation(first.name, "_key", first.target, first.target_key)])
    inner = catalog.with_config("_keys", keys, here)
    if "." not in path:
        target = catalog.frame(first.target)
        counts = target.groupBy(F.col(f"`{first.target_key}`").alias("_key")).agg(F.count("*").alias("n_related"))
    else:
        counts = include_rows(keys.distinct(), "_keys", path, inner).groupBy("_key").agg(F.count("*").alias("n_related"))
    joined = roots.join(counts, roots[f"`{first.source_key}`"] == counts["_key"], "left")
    return joined.select(*_shown(roots.columns, collection, view), F.coalesce("n_related", F.lit(0)).cast("long").alias("n_related"))
