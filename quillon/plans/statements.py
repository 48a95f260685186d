"""Statements: SELECT with its clauses, WITH, INSERT, UPDATE and DELETE."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from .nodes import Alias, Assignment, AutoAlias, Col, Condition, Distinct, Expr, Multi, Order, Raw, Scope, as_condition, nil, quote, sql_of


class Addition(Expr):
    """A clause behind FROM; clauses are written by rank, equal ranks in the order given."""

    rank = 99


@dataclass(frozen=True)
class Join(Addition):
    target: Any
    kind: str = ""
    on: Condition | None = None
    using: tuple[Col, ...] = ()
    rank = 0

    def on_(self, condition: Expr) -> Join:
        return replace(self, on=as_condition(condition))

    def using_(self, *columns: Col | str) -> Join:
        return replace(self, using=tuple(c if isinstance(c, Col) else Col(c) for c in columns))

    @property
    def is_nil(self) -> bool:
        """A join without a condition is dropped, unless it needs none."""
        return nil(self.on) and not self.using and self.kind not in ("CROSS",) and "NATURAL" not in self.kind

    def sql(self, scope: Scope) -> str:
        if not nil(self.on) and self.using:
            raise ValueError("a join takes ON or USING, not both")
        out = f"{self.kind} JOIN ".lstrip() + table_sql(self.target, scope)
        if not nil(self.on):
            out += f" ON {self.on.sql(scope)}"
        if self.using:
            out += f" USING ({', '.join(quote(c.name) for c in self.using)})"
        return out


KINDS = {"", "INNER", "CROSS", "LEFT", "RIGHT", "FULL", "LEFT OUTER", "RIGHT OUTER", "FULL OUTER", "NATURAL", "LEFT SEMI", "LEFT ANTI"}


def join(target: Any, *prefixes: str) -> Join:
    kind = " ".join(" ".join(prefixes).upper().split())
    if kind not in KINDS and not (kind.startswith("NATURAL ") and kind[8:] in KINDS):
        raise ValueError(f"unknown kind of join {kind!r}")
    return Join(target, kind)


def inner_join(target: Any) -> Join:
    return Join(target, "INNER")


def left_join(target: Any) -> Join:
    return Join(target, "LEFT")


def right_join(target: Any) -> Join:
    return Join(target, "RIGHT")


def full_join(target: Any) -> Join:
    return Join(target, "FULL")


def cross_join(target: Any) -> Join:
    return Join(target, "CROSS")


@dataclass(frozen=True)
class Where(Addition):
    condition: Expr | None
    rank = 1

    @property
    def is_nil(self) -> bool:
        return nil(self.condition)

    def sql(self, scope: Scope) -> str:
        return f"WHERE {self.condition.sql(scope)}"


def where(condition: Expr | None) -> Where:
    return Where(condition)


@dataclass(frozen=True)
class GroupBy(Addition):
    items: tuple
    condition: Expr | None = None
    rank = 2

    def having(self, condition: Expr | None) -> GroupBy:
        return replace(self, condition=condition)

    @property
    def is_nil(self) -> bool:
        return all(map(nil, self.items))

    def sql(self, scope: Scope) -> str:
        plain = [i.node if isinstance(i, Order) else i for i in self.items if not nil(i)]
        out = f"GROUP BY {', '.join(sql_of(i, scope) for i in plain)}"
        return out + (f" HAVING {self.condition.sql(scope)}" if not nil(self.condition) else "")

    def sorted_by(self) -> tuple[Order, ...]:
        """Items that also sort the groups."""
        return tuple(i for i in self.items if isinstance(i, Order) and not nil(i))


def group_by(*items: Expr | None) -> GroupBy:
    return GroupBy(items)


@dataclass(frozen=True)
class Combination(Addition):
    operator: str
    mode: str = ""
    other: Expr | None = None
    rank = 3

    def all(self, other: Expr) -> Combination:
        return self._with("ALL", other)

    def distinct(self, other: Expr) -> Combination:
        return self._with("DISTINCT", other)

    def _with(self, mode: str, other: Expr) -> Combination:
        if not isinstance(other, Select):
            raise TypeError("a set operation takes a SELECT on its right")
        if any(isinstance(a, (OrderBy, Limit)) and not a.is_nil for a in other.additions):
            raise ValueError("order and limit belong to the whole set operation, not to its right side")
        return replace(self, mode=mode, other=other)

    @property
    def is_nil(self) -> bool:
        return nil(self.other)

    def sql(self, scope: Scope) -> str:
        return f"{self.operator} {self.mode} {self.other.sql(scope)}"


def union() -> Combination:
    return Combination("UNION")


def intersect() -> Combination:
    return Combination("INTERSECT")


def except_() -> Combination:
    return Combination("EXCEPT")


@dataclass(frozen=True)
class OrderBy(Addition):
    items: tuple
    rank = 4

    @property
    def is_nil(self) -> bool:
        return all(map(nil, self.items))

    def sql(self, scope: Scope) -> str:
        return f"ORDER BY {', '.join(sql_of(i, scope) for i in self.items if not nil(i))}"


def order_by(*items: Expr | None) -> OrderBy:
    return OrderBy(items)


@dataclass(frozen=True)
class Limit(Addition):
    n: int
    skip: int = 0
    rank = 5

    def offset(self, m: int) -> Limit:
        return replace(self, skip=m)

    @property
    def is_nil(self) -> bool:
        """No or a negative limit means all rows; an offset alone does nothing."""
        return self.n <= 0

    def sql(self, scope: Scope) -> str:
        return f"LIMIT {self.n}" + (f" OFFSET {self.skip}" if self.skip > 0 else "")


def limit(n: int) -> Limit:
    return Limit(n)


@dataclass(frozen=True)
class ForUpdate(Addition):
    """No lock is needed: readers see one version, and commits compare versions."""

    rank = 98

    def sql(self, scope: Scope) -> str:
        return ""


def for_update() -> ForUpdate:
    return ForUpdate()


@dataclass(frozen=True)
class Comment(Addition):
    text: str
    rank = 97

    @property
    def is_nil(self) -> bool:
        return not self.text

    def sql(self, scope: Scope) -> str:
        return f"/* {self.text.replace('*/', '* /')} */"


def comment(text: str) -> Comment:
    return Comment(text)


@dataclass(frozen=True)
class Custom(Addition):
    node: Expr = None
    rank = 96

    @property
    def is_nil(self) -> bool:
        return nil(self.node)

    def sql(self, scope: Scope) -> str:
        return self.node.sql(scope)


def as_addition(node: Expr) -> Custom:
    return Custom(node)


def written(additions: tuple, scope: Scope) -> str:
    kept = sorted((a for a in additions if not nil(a)), key=lambda a: a.rank)
    return "".join(f" {text}" for a in kept if (text := a.sql(scope)))


def table_sql(table: Any, scope: Scope) -> str:
    """FROM or JOIN target: a table, an aliased one, or an aliased statement."""
    if isinstance(table, Alias):
        node, name = table.node, table.name
        inner = f"({node.sql(scope)})" if isinstance(node, Expr) and node.is_statement else table_name(node, scope)
        return f"{inner} AS {quote(name)}"
    if isinstance(table, Expr) and not hasattr(table, "columns"):
        return table.sql(scope)
    name = getattr(table, "qualified", table)
    return f"{scope.table(name)} AS {quote(name.split('.')[-1])}"


def table_name(table: Any, scope: Scope) -> str:
    if isinstance(table, Expr) and not hasattr(table, "columns"):
        return table.sql(scope)
    return scope.table(getattr(table, "qualified", table))


MODIFIERS = {"DISTINCT", "ALL"}


@dataclass(frozen=True)
class Select(Expr):
    """SELECT; without projection all columns, without table one row."""

    projection: Expr | None = None
    modifiers: tuple[str, ...] = ()
    table: Any = None
    additions: tuple = ()
    is_statement = True

    def from_(self, table: Any, *additions: Addition | None) -> Select:
        return replace(self, table=table, additions=self.additions + additions)

    def where(self, condition: Expr | None) -> Select:
        return replace(self, additions=(*self.additions, Where(condition)))

    def sql(self, scope: Scope) -> str:
        kept = tuple(a for a in self.additions if not nil(a))
        for a in self.additions:
            if isinstance(a, Join) and a.is_nil:
                warnings.warn(f"a join without a condition is dropped: {getattr(a.target, 'name', a.target)}", stacklevel=2)
        # joined statements name the table of each column
        inner = replace(scope, qualify=any(isinstance(a, Join) for a in kept))
        combined = any(isinstance(a, Combination) for a in kept)
        grouped = [o for a in kept if isinstance(a, GroupBy) for o in a.sorted_by()]
        if grouped and not any(isinstance(a, OrderBy) for a in kept):
            kept += (OrderBy(tuple(grouped)),)
        for m in self.modifiers:
            if m.upper() not in MODIFIERS:
                raise ValueError(f"unknown modifier {m!r}")
        unique = any(m.upper() == "DISTINCT" for m in self.modifiers) or isinstance(self.projection, Distinct)
        what = "*" if nil(self.projection) else _projected(self.projection, inner)
        if unique or combined:
            self._check_order(kept, what, inner)
        words = " ".join(["SELECT", *(m.upper() for m in self.modifiers), what])
        if self.table is None:
            return words + written(kept, inner)
        return f"{words} FROM {table_sql(self.table, inner)}{written(kept, inner)}"

    def _check_order(self, kept: tuple, what: str, scope: Scope) -> None:
        """After DISTINCT or a set operation only selected expressions can sort."""
        if what == "*":
            return
        known = set()
        for item in _items(self.projection):
            node = item.node if isinstance(item, Alias) else item
            known |= {sql_of(node, scope), sql_of(node, replace(scope, qualify=False))}
            if isinstance(item, (Alias, Col)):
                known.add(quote(item.name))
        for a in kept:
            for o in a.items if isinstance(a, OrderBy) else ():
                node = o.node if isinstance(o, Order) else o
                if not nil(node) and sql_of(node, scope) not in known:
                    raise ValueError(f"{sql_of(node, scope)} is sorted by but not selected")


def _items(projection: Expr) -> tuple:
    if isinstance(projection, Multi) and projection.connector == ", ":
        return tuple(x for i in projection.items if not nil(i) for x in _items(i))
    if isinstance(projection, Distinct):
        return projection.args
    return (projection,)


def _projected(projection: Expr, scope: Scope) -> str:
    """Qualified columns keep their bare names."""
    items = _items(projection)
    if isinstance(projection, Distinct):
        return "DISTINCT " + AutoAlias(items).sql(scope)
    return AutoAlias(items).sql(scope)


def select(projection: Expr | None = None, *modifiers: str) -> Select:
    return Select(projection, modifiers)


@dataclass(frozen=True)
class With(Expr):
    """Named statements before a main one; each has a declared list of columns."""

    parts: tuple = ()  # of (name, columns, build)
    recursive: bool = False
    main: Callable[..., Expr] | None = None
    levels: int | None = None
    is_statement = True

    def with_(self, table: Any, build: Callable[[Any], Expr]) -> With:
        return replace(self, parts=(*self.parts, (table, build)))

    def exec(self, main: Callable[..., Expr]) -> With:
        return replace(self, main=main)

    def max_levels(self, n: int) -> With:
        """Deepest recursion; Spark stops with an error beyond 100 unless told."""
        return replace(self, levels=n)

    @property
    def is_nil(self) -> bool:
        return not self.parts or self.main is None

    def sql(self, scope: Scope) -> str:
        names = [t.name for t, _ in self.parts]
        if len(set(names)) < len(names):
            raise ValueError("two common table expressions have one name")
        out, known = [], scope.names
        for table, build in self.parts:
            seen = known | {table.name} if self.recursive else known
            body = build(table).sql(replace(scope, names=seen, qualify=False))
            known = known | {table.name}
            deep = f" MAX RECURSION LEVEL {self.levels}" if self.recursive and self.levels else ""
            listed = ", ".join(quote(c.name) for c in table.columns)
            out.append(f"{quote(table.name)} ({listed}){deep} AS ({body})")
        main = self.main(*(t for t, _ in self.parts)).sql(replace(scope, names=known, qualify=False))
        return f"WITH {'RECURSIVE ' if self.recursive else ''}{', '.join(out)} {main}"


def with_(table: Any, build: Callable[[Any], Expr]) -> With:
    return With(((table, build),))


def with_recursive(table: Any, build: Callable[[Any], Expr]) -> With:
    return With(((table, build),), True)


@dataclass(frozen=True)
class OnConflict(Addition):
    """What an insert does with rows whose key is there: nothing, or assignments."""

    columns: tuple[Col, ...] = ()  # none: any unique key
    assignments: tuple[Assignment, ...] = ()

    def do_nothing(self) -> OnConflict:
        return replace(self, assignments=())

    def do_update_set(self, *assignments: Assignment) -> OnConflict:
        return replace(self, assignments=assignments)


def on_conflict(*columns: Col | str) -> OnConflict:
    return OnConflict(tuple(c if isinstance(c, Col) else Col(c) for c in columns))


def on_duplicate_key_update(*assignments: Assignment) -> OnConflict:
    return OnConflict((), assignments)


@dataclass(frozen=True)
class Returning(Addition):
    projection: Expr | None = None


def returning(projection: Expr | None = None) -> Returning:
    return Returning(projection)


@dataclass(frozen=True)
class Insert(Expr):
    modifiers: tuple[str, ...] = ()
    table: Any = None
    additions: tuple = ()
    columns: tuple[Col, ...] = ()
    rows: tuple = ()
    source: Expr | None = None
    is_statement = True

    def into(self, table: Any, *additions: Addition | None) -> Insert:
        return replace(self, table=table, additions=additions)

    def values(self, columns: Any, *values: Any) -> Insert:
        """Rows of values by column, or the rows of a statement."""
        listed = tuple(_columns(columns))
        if len(values) == 1 and isinstance(values[0], (Select, With)):
            return replace(self, columns=listed, source=values[0])
        if not listed or len(values) % len(listed) or not values:
            raise ValueError(f"{len(values)} values do not fill rows of {len(listed)} columns")
        n = len(listed)
        return replace(self, columns=listed, rows=tuple(values[i : i + n] for i in range(0, len(values), n)))


def _columns(columns: Any) -> list[Col]:
    if isinstance(columns, Multi):
        return list(columns.items)
    if isinstance(columns, Col):
        return [columns]
    return [c if isinstance(c, Col) else Col(c) for c in columns]


def insert(*modifiers: str) -> Insert:
    return Insert(modifiers)


@dataclass(frozen=True)
class Update(Expr):
    table: Any
    modifiers: tuple[str, ...] = ()
    assignments: tuple[Assignment, ...] = ()
    additions: tuple = ()
    is_statement = True

    def set(self, *assignments: Assignment | None) -> Update:
        return replace(self, assignments=tuple(a for a in assignments if a is not None))

    def where(self, condition: Expr | None, *additions: Addition | None) -> Update:
        return replace(self, additions=(Where(condition), *additions))


def update(table: Any, *modifiers: str) -> Update:
    return Update(table, modifiers)


@dataclass(frozen=True)
class Delete(Expr):
    table: Any = None
    additions: tuple = ()
    is_statement = True

    def from_(self, table: Any, *additions: Addition | None) -> Delete:
        return replace(self, table=table, additions=additions)


def delete() -> Delete:
    return Delete()
