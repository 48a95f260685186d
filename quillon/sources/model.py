"""Tables: declared in code or derived from annotated dataclasses."""

from __future__ import annotations

import dataclasses
import functools
import re
import typing
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from ..functions.types import Flags, parse_tag, spark_type, zero_of
from ..plans.nodes import Assignment, Col, Condition, Expr, Multi, Raw, and_


def column(tag: str = "", **kwargs: Any) -> Any:
    """A dataclass field with a column tag such as ``f_name,size=128,default=''``."""
    return field(metadata={"db": tag}, **kwargs)


@dataclass(frozen=True)
class ColumnDef:
    name: str
    field_name: str
    kind: Any
    flags: Flags = Flags()
    tagged: bool = True
    path: tuple[str, ...] = ()  # attributes from the model to the value
    owner: type | None = None
    comment: str = ""
    description: tuple[str, ...] = ()
    relation: tuple[str, ...] = ()

    @property
    def spark(self) -> T.DataType:
        return spark_type(self.kind, self.flags)

    def struct_field(self) -> T.StructField:
        meta = {"comment": self.comment} if self.comment else {}
        return T.StructField(self.name, self.spark, self.flags.null, meta)


@dataclass(frozen=True)
class Key:
    """A primary, unique or plain index; Spark has no index, so the last is metadata only."""

    name: str
    fields: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    unique: bool = False
    method: str = ""
    expression: str = ""

    @property
    def primary(self) -> bool:
        return self.unique and self.name == "primary" or self.name.endswith("pkey")


def parse_index(spec: str) -> tuple[str, str, str, tuple[str, ...], str]:
    """(kind, name, method, fields, expression) of ``kind name/METHOD Field…`` or ``kind name (expression)``."""
    kind, _, rest = spec.strip().partition(" ")
    kind = kind.lower()
    if kind not in ("primary", "unique_index", "index"):
        raise ValueError(f"unknown kind of index in {spec!r}")
    if kind == "primary":
        return kind, "primary", "", tuple(rest.split()), ""
    name, _, rest = rest.strip().partition(" ")
    name, _, method = name.partition("/")
    if not name or not rest.strip():
        raise ValueError(f"an index needs a name and fields: {spec!r}")
    words = rest.split()
    if all(re.fullmatch(r"[A-Za-z_]\w*", w) for w in words):
        return kind, name.lower(), method.upper(), tuple(words), ""
    return kind, name.lower(), method.upper(), (), rest.strip()


class Columns(tuple):
    """Ordered columns of one table; at most one counts up by itself."""

    def __new__(cls, columns: Iterable[ColumnDef] = ()):
        out = super().__new__(cls, columns)
        if sum(c.flags.autoincrement for c in out) > 1:
            raise ValueError("a table has one autoincrement column at most")
        return out

    def named(self, *names: str) -> tuple[ColumnDef, ...]:
        """Columns by name, whatever its case; all without names."""
        by = {c.name: c for c in self}
        if missing := [n for n in names if n.lower() not in by]:
            raise KeyError(f"unknown column {missing[0]!r}")
        return tuple(by[n.lower()] for n in names) if names else tuple(self)

    def of_fields(self, *names: str) -> tuple[ColumnDef, ...]:
        """Columns by field name; all without names."""
        by = {c.field_name: c for c in self}
        if missing := [n for n in names if n not in by]:
            raise KeyError(f"unknown field {missing[0]!r}")
        return tuple(by[n] for n in names) if names else tuple(self)

    @property
    def autoincrement(self) -> ColumnDef | None:
        return next((c for c in self if c.flags.autoincrement), None)


@dataclass(frozen=True)
class Table:
    name: str
    columns: Columns = Columns()
    keys: tuple[Key, ...] = ()
    schema: str = ""
    description: tuple[str, ...] = ()
    model: type | None = None

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name

    def with_schema(self, schema: str) -> Table:
        return replace(self, schema=schema)

    def col(self, name: str) -> Col:
        """The column of a name as a node of this table."""
        c = self.columns.named(name)[0]
        return Col(c.name, self.name, field_name=c.field_name, kind=c.kind)

    def f(self, field_name: str) -> Col:
        """The column of a field as a node of this table."""
        return self.col(self.columns.of_fields(field_name)[0].name)

    def cols(self, *names: str) -> Multi:
        return Multi(tuple(self.col(c.name) for c in self.columns.named(*names)))

    def fields(self, *names: str) -> Multi:
        return Multi(tuple(self.col(c.name) for c in self.columns.of_fields(*names)))

    def key(self, name: str) -> Key:
        return next(k for k in self.keys if k.name == name.lower())

    @property
    def primary(self) -> Key | None:
        return next((k for k in self.keys if k.primary), None)

    def unique_keys(self) -> tuple[Key, ...]:
        return tuple(k for k in self.keys if k.unique or k.primary)

    def spark_schema(self) -> T.StructType:
        return T.StructType([c.struct_field() for c in self.columns if not c.flags.deprecated])

    def expr(self, template: str, *args: Any) -> Raw:
        """A fragment whose ``#`` is this table and ``#Field`` one of its columns."""
        values, given, out, at = [], iter(args), "", 0
        for m in re.finditer(r"#(\w*)|\?", template):
            out += template[at : m.start()] + "?"
            at = m.end()
            if m[0] == "?":
                values.append(next(given))
            elif m[1]:
                values.append(self.f(m[1]))
            else:
                values.append(Raw(".".join(f"`{p}`" for p in self.qualified.split(".")), (), True))
        return Raw(out + template[at:], tuple(values))

    def assignments_by_field_values(self, values: Mapping[str, Any]) -> tuple[Assignment, ...]:
        return tuple(self.f(k).value_by(v) for k, v in values.items())

    def columns_and_values_by_field_values(self, values: Mapping[str, Any]) -> tuple[list[Col], list[Any]]:
        """Columns and values, by field name in order."""
        names = sorted(values)
        return [self.f(n) for n in names], [values[n] for n in names]


class Tables(dict):
    """Tables by name in order; adding a name again moves it to the end."""

    def add(self, *tables: Table) -> Tables:
        for t in tables:
            self.pop(t.name, None)
            self[t.name] = t
        return self

    def by_model(self, name: str) -> Table | None:
        return next((t for t in self.values() if t.model is not None and t.model.__name__ == name), None)


def _is_model(kind: Any) -> bool:
    return isinstance(kind, type) and dataclasses.is_dataclass(kind)


@functools.lru_cache(maxsize=None)
def model_fields(model: type) -> tuple[ColumnDef, ...]:
    """Columns of a dataclass; untagged dataclass fields are flattened, ``-`` ones skipped."""
    if not _is_model(model):
        raise TypeError("a model is a dataclass")
    hints, out = typing.get_type_hints(model), []
    comments = getattr(model, "comments", {})
    descriptions, relations = getattr(model, "col_descriptions", {}), getattr(model, "col_relations", {})
    for f in dataclasses.fields(model):
        tag = f.metadata.get("db", "")
        if tag == "-" or f.name.startswith("_"):
            continue
        kind = hints[f.name]
        if _is_model(kind) and not tag:
            out += [replace(c, path=(f.name, *c.path)) for c in model_fields(kind)]
            continue
        name, flags = parse_tag(tag)
        out.append(
            ColumnDef(
                name or f.name.lower(), f.name, kind, flags, bool(tag), (f.name,), model, comments.get(f.name, ""),
                tuple(descriptions.get(f.name, ())), tuple(relations.get(f.name, ())),
            )
        )
    return tuple(out)


def generated_name(field_name: str) -> str:
    """The column name that generated repositories give an untagged field."""
    return f"f_{field_name.lower()}"


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def table_of(model: type) -> Table:
    """The table of a model class and its hooks."""
    columns = Columns({c.name: c for c in model_fields(model)}.values())
    keys = []
    for spec in getattr(model, "indexes", ()):
        kind, name, method, fields, expression = parse_index(spec)
        keys.append(Key(name, fields, tuple(c.name for c in columns.of_fields(*fields)) if fields else (), kind != "index", method, expression))
    if primary := getattr(model, "primary_key", ()):
        keys.append(Key("primary", tuple(primary), tuple(c.name for c in columns.of_fields(*primary)), True))
    for name, fields in getattr(model, "unique_indexes", {}).items():
        keys.append(Key(name.lower(), tuple(fields), tuple(c.name for c in columns.of_fields(*fields)), True))
    by = {k.name: k for k in keys}
    description = getattr(model, "table_description", None) or [x.strip() for x in (model.__doc__ or "").splitlines() if x.strip() and not x.strip().startswith("@")]
    if model.__doc__ and model.__doc__.startswith(f"{model.__name__}("):
        description = []  # made by dataclasses
    return Table(getattr(model, "__tablename__", None) or f"t_{snake(model.__name__)}", columns, tuple(by[k] for k in sorted(by)), "", tuple(description), model)


def parse_doc(doc: str | None) -> tuple[list[str], list[str], dict[str, str]]:
    """(description lines, index specs, relations) of a class's or field's text with ``@def`` and ``@rel`` lines."""
    plain, specs, relations = [], [], {}
    for line in map(str.strip, (doc or "").splitlines()):
        if line.startswith("@def "):
            specs.append(line[5:].strip())
        elif line.startswith("@rel "):
            target = line[5:].strip()
            relations[target.rpartition(".")[2]] = target
        elif line:
            plain.append(line)
    return plain, specs, relations


def value_at(model: Any, path: tuple[str, ...]) -> Any:
    for name in path:
        model = getattr(model, name, None)
        if model is None:
            return None
    return model


def field_values(model: Any, fields: Iterable[str] | None = None) -> dict[str, Any]:
    """Values of the tagged fields by field name, deprecated ones left out; or of the fields named."""
    wanted = None if fields is None else set(fields)
    out = {}
    for c in model_fields(type(model)):
        if c.tagged and not c.flags.deprecated and (wanted is None or c.field_name in wanted):
            out[c.field_name] = value_at(model, c.path)
    return out


def non_zero(model: Any, *zero_fields: str) -> dict[str, Any]:
    """Values that are set, and those named even if not; a column that counts up is never among them."""
    values = field_values(model)
    kinds = {c.field_name: c for c in model_fields(type(model))}
    return {
        k: v for k, v in values.items()
        if not kinds[k].flags.autoincrement and (k in zero_fields or v is not None and v != zero_of(kinds[k].kind))
    }


def columns_by_struct(model: type) -> Multi:
    """``t.c AS t__c`` for every column of the models nested in a class, and bare columns of its own."""
    out: list[Expr] = []
    hints = typing.get_type_hints(model)
    for f in dataclasses.fields(model):
        kind = hints[f.name]
        if _is_model(kind):
            table = table_of(kind).name if hasattr(kind, "__tablename__") else None
            for c in model_fields(kind):
                out.append(Col(c.name, table, exact=True).alias(f"{table}__{c.name}") if table else Col(c.name))
        else:
            name, _ = parse_tag(f.metadata.get("db", ""))
            out.append(Col(name or f.name))
    return Multi(tuple(out))


def condition_by_struct(model: Any, table: Table | None = None) -> Condition:
    """Equality on every set field, at least one of which an index covers; soft-deleted rows are left out."""
    table = table or table_of(type(model))
    values = non_zero(model)
    for k in [c for c in field_values(model) if table.columns.of_fields(c)[0].flags.autoincrement]:
        if (v := getattr(model, k)) not in (None, 0):
            values[k] = v
    indexed = {f for k in table.keys for f in k.fields}
    if not indexed & set(values):
        raise ValueError("a condition needs one indexed field that is set")
    out = [table.f(k).eq(v) for k, v in values.items() if k != DELETED_AT]
    return and_(*out, not_deleted(table))


DELETED_AT, CREATED_AT, UPDATED_AT = "DeletedAt", "CreatedAt", "UpdatedAt"


def not_deleted(table: Table) -> Condition | None:
    """``DeletedAt = 0`` for tables with soft deletion."""
    deleted = next((c for c in table.columns if c.field_name in (DELETED_AT, "deleted_at")), None)
    return table.col(deleted.name).eq(0) if deleted else None
