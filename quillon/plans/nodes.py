"""Expression nodes: immutable, rendered to Spark SQL on demand.

A node that is nothing (an empty condition, an IN without arguments) is None
or ``is_nil``; whatever holds it drops it.
"""

from __future__ import annotations

import datetime
import decimal
import enum
import math
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Scope:
    """What names mean while a statement is rendered."""

    views: Mapping[str, str] = field(default_factory=dict)
    names: frozenset[str] = frozenset()  # of common table expressions
    qualify: bool = False

    def table(self, name: str) -> str:
        if name.split(".")[-1] in self.names:
            return quote(name.split(".")[-1])
        return self.views.get(name, name if "." in name and "`" in name else ".".join(map(quote, name.split("."))))


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: Any) -> str:
    """A value as a Spark SQL literal; sequences are listed, bytes stay one value."""
    if hook := getattr(value, "value_sql", None):
        return hook()
    if value is None:
        raise ValueError("a comparison or value with None is never true; use is_null(), or null() to write one")
    if isinstance(value, enum.Enum):
        value = value.value
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(int(value)) + ("L" if abs(value) > 2**31 - 1 else "")
    if isinstance(value, float):
        return f"double('{value!r}')" if math.isinf(value) or math.isnan(value) else f"{value!r}D"
    if isinstance(value, decimal.Decimal):
        return f"{value:f}BD"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, datetime.datetime):
        kind = "TIMESTAMP" if value.tzinfo else "TIMESTAMP_NTZ"
        return f"{kind} '{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, Mapping):
        return "map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in value.items()) + ")"
    if isinstance(value, (list, tuple, set, frozenset)):
        return ", ".join(map(literal, value))
    raise TypeError(f"no literal for {type(value).__name__}")


def sql_of(value: Any, scope: Scope) -> str:
    """SQL of a node, a statement (parenthesised) or a plain value."""
    if isinstance(value, Expr):
        text = value.sql(scope)
        return f"({text})" if value.is_statement else text
    return literal(value)


class Expr:
    """Base of all nodes."""

    is_nil = False
    is_statement = False
    aggregate = False

    def sql(self, scope: Scope) -> str:
        raise NotImplementedError

    def column(self, scope: Scope | None = None) -> Column:
        return F.expr(self.sql(scope or Scope()))

    def alias(self, name: str) -> Alias:
        return Alias(self, name)


def nil(node: Expr | None) -> bool:
    return node is None or node.is_nil


@dataclass(frozen=True)
class Raw(Expr):
    """A fragment whose ``?`` outside of quotes stand for values or nodes; ``exact`` ones hold none."""

    text: str
    args: tuple = ()
    exact: bool = False

    def __post_init__(self):
        if not self.exact and len(self._pieces()) - 1 != len(self.args):
            raise ValueError(f"{self.text!r} takes {len(self._pieces()) - 1} values, not {len(self.args)}")

    @property
    def is_nil(self) -> bool:
        return not self.text

    @property
    def aggregate(self) -> bool:
        return any(getattr(a, "aggregate", False) for a in self.args) or bool(AGGREGATES.search(self.text))

    def _pieces(self) -> list[str]:
        out, word, quoted, i = [], "", "", 0
        while i < len(self.text):
            ch = self.text[i]
            if quoted and ch == "\\" and quoted != "`":
                word += self.text[i : i + 2]
                i += 2
                continue
            if quoted:
                quoted = "" if ch == quoted else quoted
            elif ch in "'\"`":
                quoted = ch
            elif ch == "?":
                out.append(word)
                word = ""
                i += 1
                continue
            word += ch
            i += 1
        return [*out, word]

    def sql(self, scope: Scope) -> str:
        if self.exact:
            return self.text
        pieces = self._pieces()
        out = pieces[0]
        for arg, piece in zip(self.args, pieces[1:]):
            # the caller writes the parentheses around a statement
            out += (arg.sql(scope) if isinstance(arg, Expr) else literal(arg)) + piece
        return out


AGGREGATES = re.compile(r"\b(count|sum|avg|min|max|first|last|any_value|min_by|max_by|stddev\w*|var\w*|collect_\w+|approx_\w+|percentile\w*|bool_\w+)\s*\(", re.I)


def expr(text: str, *args: Any) -> Raw:
    return Raw(text, args)


def exactly(text: str) -> Raw:
    return Raw(text, (), True)


@dataclass(frozen=True)
class Deferred(Expr):
    """Made when rendered, with the scope at hand."""

    make: Callable[[Scope], Expr | None]

    def sql(self, scope: Scope) -> str:
        made = self.make(scope)
        return "" if nil(made) else made.sql(scope)


@dataclass(frozen=True)
class Null(Expr):
    def sql(self, scope: Scope) -> str:
        return "NULL"


def null() -> Null:
    return Null()


@dataclass(frozen=True)
class Multi(Expr):
    """Nodes joined by a connector; nothing ones are left out."""

    items: tuple
    connector: str = ", "

    @property
    def is_nil(self) -> bool:
        return all(map(nil, self.items))

    @property
    def aggregate(self) -> bool:
        return any(not nil(i) and i.aggregate for i in self.items)

    def sql(self, scope: Scope) -> str:
        return self.connector.join(sql_of(i, scope) for i in self.items if not nil(i))


def multi(*items: Expr | None) -> Multi:
    return Multi(items)


def multi_with(connector: str, *items: Expr | None) -> Multi:
    return Multi(items, f" {connector.strip()} " if connector.strip() not in (",",) else ", ")


@dataclass(frozen=True)
class Alias(Expr):
    node: Expr
    name: str

    @property
    def is_nil(self) -> bool:
        return not self.name or nil(self.node)

    @property
    def aggregate(self) -> bool:
        return self.node.aggregate

    def sql(self, scope: Scope) -> str:
        return f"{sql_of(self.node, scope)} AS {quote(self.name)}"


def alias(node: Expr, name: str) -> Alias:
    return Alias(node, name)


@dataclass(frozen=True)
class AutoAlias(Multi):
    """A projection list whose qualified columns keep their bare names."""

    def sql(self, scope: Scope) -> str:
        out = []
        for i in self.items:
            if not nil(i):
                text = sql_of(i, scope)
                out.append(f"{text} AS {quote(i.name)}" if isinstance(i, Col) and "." in text else text)
        return ", ".join(out)


def auto_alias(*items: Expr | None) -> AutoAlias:
    return AutoAlias(items)


@dataclass(frozen=True)
class Assignment(Expr):
    """``column = value`` of an insert or update."""

    target: Col
    value: Any

    def sql(self, scope: Scope) -> str:
        return f"{quote(self.target.name)} = {sql_of(self.value, scope)}"


@dataclass(frozen=True)
class Condition(Expr):
    """A boolean node; AND, OR and XOR drop what is nothing and keep groups apart."""

    node: Expr

    @property
    def is_nil(self) -> bool:
        return nil(self.node)

    @property
    def aggregate(self) -> bool:
        return self.node.aggregate

    def sql(self, scope: Scope) -> str:
        return self.node.sql(scope)

    def and_(self, *others: Condition | None) -> Condition:
        return and_(self, *others)

    def or_(self, *others: Condition | None) -> Condition:
        return or_(self, *others)

    def xor(self, *others: Condition | None) -> Condition:
        return xor(self, *others)


def _composed(connector: str, conditions: Iterable[Expr | None]) -> Condition:
    left = [as_condition(c) for c in conditions if not nil(c)]
    if len(left) == 1:
        return left[0]
    groups = tuple(Raw("(?)", (c,)) for c in left)
    return Condition(Multi(groups, f" {connector} "))


def and_(*conditions: Expr | None) -> Condition:
    return _composed("AND", conditions)


def or_(*conditions: Expr | None) -> Condition:
    return _composed("OR", conditions)


def xor(*conditions: Expr | None) -> Condition:
    """True if an odd number of conditions is; unknown if any is."""
    left = [as_condition(c) for c in conditions if not nil(c)]
    out = left[0] if left else empty_condition()
    for c in left[1:]:
        out = Condition(Raw("(?) <> (?)", (out, c)))
    return out


def as_condition(node: Expr) -> Condition:
    return node if isinstance(node, Condition) else Condition(node)


def empty_condition() -> Condition:
    return Condition(Raw(""))


def contains_pattern(value: Any, left: str, right: str) -> Any:
    """A LIKE pattern around a text; its own wildcards stay wildcards."""
    if isinstance(value, Expr):
        return Raw("concat(?, ?, ?)", (left, value, right))
    return f"{left}{value}{right}"


@dataclass(frozen=True)
class Col(Expr):
    """A column by name, optionally of a table (or of a table's alias)."""

    name: str
    table: str | None = None
    exact: bool = False
    field_name: str | None = None
    kind: Any = None

    def __post_init__(self):
        object.__setattr__(self, "name", self.name.lower())

    def sql(self, scope: Scope) -> str:
        if self.table and (scope.qualify or self.exact):
            return f"{quote(self.table.split('.')[-1])}.{quote(self.name)}"
        return quote(self.name)

    def of(self, table: Any) -> Col:
        return replace(self, table=getattr(table, "name", table))

    def full(self) -> Col:
        """Qualified in any statement."""
        return replace(self, exact=True)

    def expr(self, template: str, *args: Any) -> Raw:
        """A fragment whose ``#`` is this column."""
        out, values, given = "", [], iter(args)
        for ch in template:
            if ch == "#":
                out += "?"
                values.append(self)
            else:
                out += ch
                if ch == "?":
                    values.append(next(given))
        return Raw(out, tuple(values))

    def _compare(self, operator: str, value: Any) -> Condition:
        if value is None:
            literal(None)
        if isinstance(value, Expr) and value.is_statement:
            return Condition(Raw(f"? {operator} (?)", (self, value)))
        return Condition(Raw(f"? {operator} ?", (self, value)))

    def eq(self, value: Any) -> Condition:
        return self._compare("=", value)

    def neq(self, value: Any) -> Condition:
        return self._compare("<>", value)

    def gt(self, value: Any) -> Condition:
        return self._compare(">", value)

    def gte(self, value: Any) -> Condition:
        return self._compare(">=", value)

    def lt(self, value: Any) -> Condition:
        return self._compare("<", value)

    def lte(self, value: Any) -> Condition:
        return self._compare("<=", value)

    def between(self, low: Any, high: Any) -> Condition:
        return Condition(Raw("? BETWEEN ? AND ?", (self, low, high)))

    def not_between(self, low: Any, high: Any) -> Condition:
        return Condition(Raw("? NOT BETWEEN ? AND ?", (self, low, high)))

    def _among(self, word: str, values: tuple) -> Condition | None:
        if not values:
            return None
        if len(values) == 1:
            if hook := getattr(values[0], "condition_for", None):
                return as_condition(hook(self)) if word == "IN" else Condition(Raw("NOT (?)", (hook(self),)))
            if isinstance(values[0], (list, tuple, set, frozenset)) and not values[0]:
                return Condition(Raw("?", (word != "IN",)))  # an empty list holds nothing
        return Condition(Raw(f"? {word} ({', '.join('?' * len(values))})", (self, *values)))

    def in_(self, *values: Any) -> Condition | None:
        """Among values, the values of a list, or a statement's rows; without arguments no condition at all."""
        return self._among("IN", values)

    def not_in(self, *values: Any) -> Condition | None:
        return self._among("NOT IN", values)

    def like(self, value: Any) -> Condition:
        return Condition(Raw("? LIKE ?", (self, contains_pattern(value, "%", "%"))))

    def left_like(self, value: Any) -> Condition:
        """Ends with: the wildcard is on the left."""
        return Condition(Raw("? LIKE ?", (self, contains_pattern(value, "%", ""))))

    def right_like(self, value: Any) -> Condition:
        """Starts with: the wildcard is on the right."""
        return Condition(Raw("? LIKE ?", (self, contains_pattern(value, "", "%"))))

    def not_like(self, value: Any) -> Condition:
        return Condition(Raw("? NOT LIKE ?", (self, contains_pattern(value, "%", "%"))))

    def is_null(self) -> Condition:
        return Condition(Raw("? IS NULL", (self,)))

    def is_not_null(self) -> Condition:
        return Condition(Raw("? IS NOT NULL", (self,)))

    def value_by(self, value: Any) -> Assignment:
        return Assignment(self, null() if value is None else value)

    def incr(self, by: Any) -> Raw:
        return Raw("? + ?", (self, by))

    def dec(self, by: Any) -> Raw:
        return Raw("? - ?", (self, by))


def col(name: str, table: str | None = None) -> Col:
    return Col(name, table)


def cols(*names: str) -> Multi:
    return Multi(tuple(Col(n) for n in names))


@dataclass(frozen=True)
class Func(Expr):
    """A function call; without arguments it takes ``*``."""

    name: str
    args: tuple = ()

    @property
    def is_nil(self) -> bool:
        return not self.name

    @property
    def aggregate(self) -> bool:
        return bool(AGGREGATES.match(f"{self.name}(")) or any(getattr(a, "aggregate", False) for a in self.args)

    def sql(self, scope: Scope) -> str:
        name = self.name.upper()
        args = [a for a in self.args if not (isinstance(a, Expr) and a.is_nil)]
        if not args and name != "COUNT" and AGGREGATES.match(f"{name}("):
            raise ValueError(f"{name}(*) has no meaning; name a column")
        return f"{name}({', '.join(sql_of(a, scope) for a in args) or '*'})"


def func(name: str, *args: Any) -> Func:
    return Func(name, args)


def count(*args: Any) -> Func:
    return Func("COUNT", args or (1,))


def avg(*args: Any) -> Func:
    return Func("AVG", args)


def sum_(*args: Any) -> Func:
    return Func("SUM", args)


def min_(*args: Any) -> Func:
    return Func("MIN", args)


def max_(*args: Any) -> Func:
    return Func("MAX", args)


def first(value: Any, by: Any = None) -> Func:
    """The first value by an order; without one, any that comes first."""
    return Func("FIRST", (value,)) if by is None else Func("MIN_BY", (value, by))


def last(value: Any, by: Any = None) -> Func:
    return Func("LAST", (value,)) if by is None else Func("MAX_BY", (value, by))


@dataclass(frozen=True)
class Distinct(Expr):
    """DISTINCT before expressions: alone in a projection or inside an aggregate."""

    args: tuple

    def sql(self, scope: Scope) -> str:
        return "DISTINCT " + ", ".join(sql_of(a, scope) for a in self.args)


def distinct(*args: Any) -> Distinct:
    return Distinct(args)


@dataclass(frozen=True)
class Order(Expr):
    node: Expr
    direction: str = ""
    nulls: str = ""

    @property
    def is_nil(self) -> bool:
        return nil(self.node)

    @property
    def aggregate(self) -> bool:
        return self.node.aggregate

    def sql(self, scope: Scope) -> str:
        return f"({sql_of(self.node, scope)})" + (f" {self.direction}" if self.direction else "") + (f" NULLS {self.nulls.upper()}" if self.nulls else "")


def asc(node: Expr, nulls: str = "") -> Order:
    return Order(node, "ASC", nulls)


def desc(node: Expr, nulls: str = "") -> Order:
    return Order(node, "DESC", nulls)
