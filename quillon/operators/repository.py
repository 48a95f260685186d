"""Repositories: the methods of a model, made at run time from its keys."""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable, Mapping
from dataclasses import replace
from typing import Any

from ..plans.nodes import Condition, Expr, and_, col, count, nil
from ..plans.statements import Delete, Insert, Limit, Select, Update, Where, for_update, limit, on_conflict
from ..sources.model import CREATED_AT, DELETED_AT, UPDATED_AT, Key, Table, condition_by_struct, field_values, non_zero, not_deleted, table_of
from ..sources.store import NotFoundError
from .engine import Engine


def soft_delete_keys(table: Table) -> Table:
    """With soft deletion every unique key takes the deletion time too, so a deleted row frees its key."""
    deleted = _field(table, DELETED_AT)
    if deleted is None:
        return table
    keys = tuple(
        replace(k, fields=(*k.fields, deleted.field_name), columns=(*k.columns, deleted.name)) if k.unique and deleted.name not in k.columns else k
        for k in table.keys
    )
    return replace(table, keys=keys)


def _field(table: Table, name: str):
    snake = {DELETED_AT: "deleted_at", CREATED_AT: "created_at", UPDATED_AT: "updated_at"}[name]
    return next((c for c in table.columns if c.field_name in (name, snake)), None)


class Repository:
    """Methods by key have the key's fields in their names: ``fetch_by_id``, ``update_by_name_with_map`` …"""

    def __init__(self, engine: Engine, model: type, now: Callable[[], int] = lambda: int(time.time())):
        self.engine, self.model, self.now = engine, model, now
        self.table = soft_delete_keys(engine.database.tables.get(table_of(model).name) or table_of(model))
        for key in self.table.unique_keys():
            fields = [f for f in key.fields if f not in (DELETED_AT, "deleted_at")]
            if not fields:
                continue
            name = "_and_".join(f.lower() for f in fields)
            self._bind(name, key, fields)
        for f in {f for k in self.table.keys for f in k.fields}:
            setattr(self, f"batch_fetch_by_{f.lower()}_list", lambda values, f=f: self.batch_fetch(f, values))

    def _bind(self, name: str, key: Key, fields: list[str]) -> None:
        def where(values: tuple) -> Condition:
            if len(values) != len(fields):
                raise TypeError(f"{name} takes {len(fields)} values")
            return and_(*(self.table.f(f).eq(v) for f, v in zip(fields, values)), not_deleted(self.table))

        n = len(fields)
        setattr(self, f"fetch_by_{name}", lambda *v: self.fetch(where(v)))
        setattr(self, f"fetch_by_{name}_for_update", lambda *v: self.fetch(where(v), for_update()))
        setattr(self, f"update_by_{name}_with_map", lambda *a: self.update(where(a[:n]), a[n]))
        setattr(self, f"update_by_{name}_with_struct", lambda *a: self.update(where(a[:n]), non_zero(a[n], *a[n + 1 :])))
        setattr(self, f"delete_by_{name}", lambda *v: self.delete(where(v)))
        setattr(self, f"soft_delete_by_{name}", lambda *v: self.soft_delete(where(v)))

    def _stamped(self, model: Any, *names: str) -> Any:
        for name in names:
            c = _field(self.table, name)
            if c is not None and not getattr(model, c.field_name):
                setattr(model, c.field_name, self.now())
        return model

    # whole rows

    def create(self, model: Any, *zero_fields: str) -> Any:
        self._stamped(model, CREATED_AT, UPDATED_AT)
        done = self.engine.execute(self._insert(model, zero_fields, ()))
        auto = self.table.columns.autoincrement
        if auto is not None and done is not None:
            setattr(model, auto.field_name, done.first()[auto.name])
        return model

    def _insert(self, model: Any, zero_fields: tuple, additions: tuple) -> Insert:
        from ..plans.statements import returning

        values = non_zero(model, *zero_fields)
        columns, listed = self.table.columns_and_values_by_field_values(values)
        return Insert().into(self.table, *additions, returning()).values(columns, *listed)

    def create_on_duplicate_with_update_fields(self, model: Any, update_fields: list[str]) -> None:
        """Insert, or set the named fields where any unique key is taken; creation times stay."""
        if not update_fields:
            raise ValueError("name the fields to update")
        self._stamped(model, CREATED_AT, UPDATED_AT)
        values = non_zero(model, *update_fields)
        keyed = {f for k in self.table.unique_keys() for f in k.fields}
        deleted = _field(self.table, DELETED_AT)
        if deleted is not None:
            values.setdefault(deleted.field_name, 0)
        auto = self.table.columns.autoincrement
        kept = {c.field_name for c in (_field(self.table, CREATED_AT), auto) if c is not None}
        sets = [self.table.f(f).value_by(values.get(f, getattr(model, f))) for f in dict.fromkeys([*update_fields, *_names(_field(self.table, UPDATED_AT))]) if f not in kept and f not in keyed]
        columns, listed = self.table.columns_and_values_by_field_values(values)
        clash = [k for k in self.table.unique_keys() if set(k.fields) <= set(values)]
        target = on_conflict(*clash[0].columns) if len(clash) == 1 else on_conflict()
        self.engine.execute(Insert().into(self.table, target.do_update_set(*sets)).values(columns, *listed))

    def fetch(self, condition: Expr | None, *additions: Any) -> Any:
        return self.engine.one(Select().from_(self.table, Where(condition), *additions), self.model)

    def list(self, condition: Expr | None = None, *additions: Any) -> list[Any]:
        return self.engine.fetch(Select().from_(self.table, Where(and_(condition, not_deleted(self.table))), *additions), self.model)

    def count(self, condition: Expr | None = None, *additions: Any) -> int:
        return self.engine.scalar(Select(count()).from_(self.table, Where(and_(condition, not_deleted(self.table))), *additions))

    def batch_fetch(self, field_name: str, values: list[Any]) -> list[Any]:
        """Rows by a list of values; no values, no query."""
        return self.list(self.table.f(field_name).in_(list(values))) if values else []

    # changes

    def update(self, condition: Condition, values: Mapping[str, Any]) -> None:
        """Set fields; if no row is met, say whether there is one."""
        values = dict(values)
        for f in _names(_field(self.table, UPDATED_AT)):
            values.setdefault(f, self.now())
        n = self.engine.affected(Update(self.table).set(*self.table.assignments_by_field_values(values)).where(condition))
        if not n:
            raise NotFoundError("record not found")

    def delete(self, condition: Condition) -> None:
        self.engine.execute(Delete().from_(self.table, Where(condition)))

    def delete_by_struct(self, model: Any) -> None:
        self.delete(condition_by_struct(model, self.table))

    def soft_delete(self, condition: Condition) -> None:
        deleted = _field(self.table, DELETED_AT)
        if deleted is None:
            raise TypeError(f"{self.model.__name__} has no deletion time")
        values = {deleted.field_name: self.now()} | {f: self.now() for f in _names(_field(self.table, UPDATED_AT))}
        self.engine.execute(Update(self.table).set(*self.table.assignments_by_field_values(values)).where(condition))

    def condition_by_struct(self, model: Any) -> Condition:
        return condition_by_struct(model, self.table)

    # metadata

    def field_key(self, field_name: str) -> str:
        self.table.columns.of_fields(field_name)
        return field_name

    @property
    def index_field_names(self) -> list[str]:
        return sorted({f for k in self.table.keys for f in k.fields})

    @property
    def comments(self) -> dict[str, str]:
        return {c.field_name: c.comment for c in self.table.columns if c.comment}

    @property
    def col_descriptions(self) -> dict[str, list[str]]:
        return {c.field_name: list(c.description) for c in self.table.columns if c.description}

    @property
    def col_relations(self) -> dict[str, list[str]]:
        return {c.field_name: list(c.relation) for c in self.table.columns if c.relation}

    @property
    def primary_key(self) -> list[str]:
        return list(self.table.primary.fields) if self.table.primary else []

    @property
    def indexes(self) -> dict[str, list[str]]:
        return {k.name: list(k.fields) for k in self.table.keys if not k.unique}

    @property
    def unique_indexes(self) -> dict[str, list[str]]:
        return {k.name: list(k.fields) for k in self.table.keys if k.unique and not k.primary}


def _names(c: Any) -> list[str]:
    return [c.field_name] if c is not None else []
