"""The engine: runs statements on Spark, changes on the store, several of them together."""

from __future__ import annotations

import contextlib
import copy
import dataclasses
import logging
import threading
import time
import typing
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from ..plans.nodes import Alias, AutoAlias, Col, Expr, Scope, nil, quote, sql_of
from ..plans.statements import Comment, Delete, Insert, OnConflict, Returning, Select, Update, Where, With, written
from ..sources.database import Database
from ..sources.model import Table, model_fields, non_zero, table_of
from ..sources.store import ConflictError, Entry, NotFoundError, Store, Version, with_parts

log = logging.getLogger("quillon")


class NestedTransaction(Exception):
    pass


class Cancelled(Exception):
    """The engine's work was cancelled; its transaction can't be committed."""


class Engine:
    """A database bound to a session and, for changes, to a store.

    ``sources`` are read-only tables beside the store's: paths or DataFrames
    by table name.
    """

    def __init__(self, spark: SparkSession, database: Database | None = None, store: Store | str | None = None, sources: dict[str, Any] | None = None):
        self.spark = spark
        self.database = database or Database("default")
        self.store = Store(spark, store) if isinstance(store, str) else store
        self.sources = dict(sources or {})
        self._views: dict[str, tuple[Any, str]] = {}
        self._overlay: dict[str, Entry] | None = None
        self._base: Version | None = None
        self._cancelled = threading.Event()
        self.group = ""

    # names

    def with_context(self, group: str) -> Engine:
        """A copy whose Spark jobs form a group that :meth:`cancel` ends; threads that use it call :meth:`enter` first."""
        out = copy.copy(self)
        out.group, out._cancelled, out._views = group, threading.Event(), {}
        return out

    def enter(self) -> Engine:
        self.spark.sparkContext.setJobGroup(self.group, self.group, True)
        return self

    def cancel(self) -> None:
        """End the group's running jobs; an open transaction can only be rolled back."""
        self._cancelled.set()
        if self.group:
            self.spark.sparkContext.cancelJobGroup(self.group)

    def create_database(self) -> None:
        """Make the store's folder, if it isn't there."""
        self.store.create()

    def create_schema(self, schema: str) -> None:
        self.store.create(schema)

    def drop_database(self) -> None:
        """Remove the store with all its tables, and what this engine knew of them."""
        if self._overlay is not None:
            raise NestedTransaction("a transaction is open")
        self.store.drop_all()
        for _, view in self._views.values():
            self.spark.catalog.dropTempView(view)
        self._views = {}

    def with_schema(self, schema: str) -> Engine:
        """A copy whose tables belong to a schema."""
        out = copy.copy(self)
        out.database, out._views = self.database.with_schema(schema), {}
        return out

    def _tables(self) -> dict[str, Entry]:
        if self._overlay is not None:
            return self._overlay
        return self.store.latest().tables if self.store else {}

    def frame(self, table: Table | str) -> DataFrame:
        """The rows of a table as they are now (inside a transaction, with its changes)."""
        name = getattr(table, "qualified", table)
        entry = self._tables().get(name)
        if entry is not None:
            return self.store.read(entry)
        source = self.sources.get(name)
        if source is None:
            return self.spark.table(name)
        return self.spark.read.parquet(source) if isinstance(source, str) else source

    def _view(self, name: str, source: Any, make: Callable[[], DataFrame]) -> str:
        held = self._views.get(name)
        if held is None or held[0] != source:
            view = f"q_{uuid.uuid4().hex}"
            make().createOrReplaceTempView(view)
            if held:
                self.spark.catalog.dropTempView(held[1])
            held = self._views[name] = (source, view)
        return held[1]

    def scope(self) -> Scope:
        views = {n: self._view(n, id(s) if not isinstance(s, str) else s, lambda n=n: self.frame(n)) for n, s in self.sources.items()}
        views |= {n: self._view(n, e.parts + (e.schema,), lambda e=e: self.store.read(e)) for n, e in self._tables().items()}
        return Scope({n: quote(v) for n, v in views.items()})

    # queries

    def sql(self, node: Expr) -> str:
        """The Spark SQL of a statement, with its values written in."""
        return node.sql(self.scope())

    def query(self, node: Expr | None) -> DataFrame | None:
        """The rows of a statement, lazily; nothing for nothing."""
        if nil(node):
            return None
        if isinstance(node, (Insert, Update, Delete)):
            return self.execute(node)
        text = self.sql(node)
        said = [a.text for a in getattr(node, "additions", ()) if isinstance(a, Comment)]
        if said:
            self.spark.sparkContext.setJobDescription(said[0])
        start = time.monotonic()
        out = self.spark.sql(text)
        log.debug("%.1f ms: %s", 1000 * (time.monotonic() - start), text)
        return out

    def fetch(self, node: Expr, target: type | None = None, many: bool = True) -> Any:
        """Rows as models, dicts or scalars: a list, or one (the last; NotFoundError if none)."""
        df = self.query(node)
        if many:
            return [bound(r, target) for r in df.collect()]
        # one row is expected; the last of several wins, without more than it on the driver
        last = df.tail(1)
        if not last:
            raise NotFoundError("record not found")
        return bound(last[0], target)

    def one(self, node: Expr, target: type | None = None) -> Any:
        return self.fetch(node, target, many=False)

    def scalar(self, node: Expr) -> Any:
        return self.one(node)[0]

    def each(self, node: Expr, target: type | None = None) -> Iterator[Any]:
        """Rows one by one, a partition at a time on the driver."""
        for row in self.query(node).toLocalIterator():
            yield bound(row, target)

    # changes

    def execute(self, node: Expr) -> DataFrame | None:
        """Run a change; its RETURNING rows if it has any."""
        if nil(node):
            return None
        if not isinstance(node, (Insert, Update, Delete)):
            return self.query(node)
        if self.store is None:
            raise ValueError("changes need a store")
        start = time.monotonic()
        if self._overlay is not None:
            out = self._apply(node)
        else:
            with self.transaction():
                out = self._apply(node)
        log.debug("%.1f ms: %s", 1000 * (time.monotonic() - start), self.change_text(node))
        return out

    def change_text(self, node: Insert | Update | Delete) -> str:
        """A change as text with its values written in, for logs."""
        scope, name = Scope(), quote(node.table.qualified)
        given = [a for a in node.additions if not nil(a) and not isinstance(a, (Where, OnConflict, Returning))]
        where = " WHERE " + self._condition(node, node.table, scope) if any(isinstance(a, Where) and not nil(a) for a in node.additions) else ""
        tail = where + "".join(f" {a.sql(scope)}" for a in given if a.sql(scope))
        sets = lambda items: ", ".join(f"{quote(a.target.name)} = {sql_of(a.value, scope)}" for a in items)
        if isinstance(node, Delete):
            return f"DELETE FROM {name}{tail}"
        if isinstance(node, Update):
            return f"UPDATE {name} SET {sets(node.assignments)}{tail}"
        columns = ", ".join(quote(c.name) for c in node.columns)
        rows = node.source.sql(scope) if node.source is not None else "VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else sql_of(v, scope) for v in r) + ")" for r in node.rows)
        conflict = next((a for a in node.additions if isinstance(a, OnConflict)), None)
        if conflict is not None:
            keys = "".join(f" ({', '.join(quote(c.name) for c in conflict.columns)})" if conflict.columns else "")
            tail += f" ON CONFLICT{keys} DO " + (f"UPDATE SET {sets(conflict.assignments)}" if conflict.assignments else "NOTHING")
        return " ".join(["INSERT", *node.modifiers, "INTO", f"{name} ({columns})", rows]) + tail

    def _apply(self, node: Expr) -> DataFrame | None:
        if isinstance(node, Insert):
            changed = self._insert(node)
        elif isinstance(node, Update):
            changed = self._update(node)
        else:
            changed = self._delete(node)
        wanted = next((a for a in getattr(node, "additions", ()) if isinstance(a, Returning)), None)
        if wanted is None:
            return None
        if nil(wanted.projection):
            return changed
        view = f"q_{uuid.uuid4().hex}"
        changed.createOrReplaceTempView(view)
        return self.spark.sql(f"SELECT {AutoAlias((wanted.projection,)).sql(Scope())} FROM {quote(view)}")

    def _entry(self, table: Table) -> Entry:
        entry = self._overlay.get(table.qualified)
        if entry is None:
            raise NotFoundError(f"table {table.qualified} does not exist")
        return entry

    def _insert(self, node: Insert) -> DataFrame:
        table, entry = node.table, self._entry(node.table)
        names = [c.name for c in node.columns]
        if node.source is not None:
            given = self.query(node.source).toDF(*(names or [f.name for f in entry.struct]))
        else:
            scope = self.scope()
            lines = ", ".join("(" + ", ".join("NULL" if v is None else sql_of(v, scope) for v in row) + ")" for row in node.rows)
            given = self.spark.sql(f"SELECT * FROM VALUES {lines} AS v({', '.join(map(quote, names))})")
        modifiers = {m.upper() for m in node.modifiers}
        if modifiers - {"IGNORE"}:
            raise ValueError(f"unknown modifiers {modifiers}")
        conflict = next((a for a in node.additions if isinstance(a, OnConflict)), None)
        if conflict is None and "IGNORE" in modifiers:
            conflict = OnConflict()
        new, next_id = self._completed(table, entry, given)
        if conflict is None:
            return self._append(table, entry, new, next_id)
        keys = [tuple(c.name for c in conflict.columns)] if conflict.columns else unique_keys(table, entry)
        return self._upsert(table, entry, new, next_id, keys, conflict)

    def _completed(self, table: Table, entry: Entry, given: DataFrame) -> tuple[DataFrame, int]:
        """Rows with all columns: given ones cast, others counted up, by default or null."""
        named = {c.name: c for c in table.columns}
        have, out, next_id = set(given.columns), [], entry.next_id
        auto = table.columns.autoincrement
        if auto is not None and auto.name not in have:
            # the store numbers rows itself; the folder's rows are numbered once and then read back
            given = self._numbered(given, auto.name, entry.next_id)
            next_id = entry.next_id + given.count()
            have.add(auto.name)
        elif auto is not None:
            top = given.agg(F.max(auto.name)).first()[0]
            next_id = max(entry.next_id, (top or 0) + 1)
        for f in entry.struct:
            c = named.get(f.name)
            if f.name in have:
                value = F.col(quote(f.name))
            elif c is not None and c.flags.default is not None:
                value = F.expr(default_sql(c.flags.default))
            else:
                value = F.lit(None)
            out.append(checked(value, f, f"{table.name}.{f.name}").alias(f.name))
        return given.select(*out), next_id

    def _numbered(self, given: DataFrame, name: str, start: int) -> DataFrame:
        """Consecutive numbers without one task seeing all rows: counts of partitions first."""
        path = self.store.add("_staged", given.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
        rows = self.spark.read.parquet(path)
        base, offsets = start, []
        for p, n, least in sorted(tuple(r) for r in rows.groupBy("_part").agg(F.count(F.lit(1)), F.min("_at")).collect()):
            offsets.append((p, base - least))
            base += n
        if not offsets:
            return given.withColumn(name, F.lit(None).cast("long"))
        shift = self.spark.createDataFrame(offsets, "_part int, _shift long")
        return rows.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")

    def _append(self, table: Table, entry: Entry, new: DataFrame, next_id: int, free: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
        """Add rows; the keys in ``free`` are known to clash with none."""
        part = self._add(table, entry, new)
        added = self.store.read(with_parts(entry, (part,)))
        old = self.store.read(entry)
        for key in unique_keys(table, entry):
            if key not in free:
                self._check_unique(key, old, added)
        self._overlay[table.qualified] = with_parts(entry, (*entry.parts, part), next_id)
        return added

    def _add(self, table: Table, entry: Entry, rows: DataFrame) -> str:
        """A new folder of a table's rows, sorted in its files by a BTREE index, so that readers skip by minima and maxima."""
        for key in entry.keys:
            if key["method"] == "BTREE" and not key["unique"] and key["columns"]:
                rows = rows.sortWithinPartitions(*key["columns"])
                break
        return self.store.add(table.qualified, rows)

    def _check_unique(self, columns: tuple[str, ...], old: DataFrame, new: DataFrame) -> None:
        """New rows may neither repeat a key among themselves nor one that is there; nulls never clash."""
        if not columns:
            return
        full = new.select(*columns).dropna()
        if not full.groupBy(*columns).count().where("count > 1").isEmpty() or not old.select(*columns).join(few(full), list(columns), "left_semi").isEmpty():
            raise ConflictError(f"duplicate value for unique key ({', '.join(columns)})")

    def _upsert(self, table: Table, entry: Entry, new: DataFrame, next_id: int, keys: list[tuple[str, ...]], conflict: OnConflict) -> DataFrame:
        """Insert rows whose keys are free; assign to the others, or leave them."""
        if not keys or not all(keys):
            return self._append(table, entry, new, next_id)
        fields = [f.name for f in entry.struct]
        staged = self.spark.read.parquet(self.store.add("_staged", new.withColumn("_row", F.monotonically_increasing_id())))
        # of new rows with one key the first (by all its columns) counts
        for key in keys:
            rank = F.row_number().over(_window(key, fields + ["_row"]))
            staged = staged.withColumn("_n", rank).where(F.col("_n").eqNullSafe(1) | F.expr(" OR ".join(f"{quote(k)} IS NULL" for k in key))).drop("_n")
        old, met, earlier = self.store.read(entry), None, F.lit(False)
        for key in keys:  # an equal join by each key; rows that an earlier key brought together are there already
            mine = few(staged.select(F.struct(*staged.columns).alias("excluded"), *(F.col(quote(k)).alias(f"_k{i}") for i, k in enumerate(key))))
            equal = [F.col(quote(k)) == F.col(f"_k{i}") for i, k in enumerate(key)]
            pairs = old.join(mine, equal).where(~earlier).select(*fields, "excluded")
            met = pairs if met is None else met.unionAll(pairs)
            same = F.lit(True)
            for k in key:
                same = same & F.coalesce(F.col(quote(k)) == F.col(f"excluded.{quote(k)}"), F.lit(False))
            earlier = earlier | same
        met = self.spark.read.parquet(self.store.add("_staged", met))
        fresh = staged.join(few(met.select("excluded._row").distinct()), "_row", "left_anti").select(*fields)
        parts, changed = entry.parts, None
        if conflict.assignments and not met.isEmpty():
            targets = {a.target.name: sql_of(a.value, Scope(qualify=True)) for a in conflict.assignments}
            view = f"q_{uuid.uuid4().hex}"
            met.createOrReplaceTempView(view)
            # a row is the old one by its columns and the table's name, and the new one by ``excluded``
            picked = ", ".join(f"{targets.get(f, quote(f))} AS {quote(f)}" for f in fields)
            rows = self.spark.sql(f"SELECT {picked} FROM {quote(view)} AS {quote(table.name)}")
            rows = rows.select(*(checked(F.col(quote(f.name)), f, f"{table.name}.{f.name}").alias(f.name) for f in entry.struct))
            primary = next((tuple(k["columns"]) for k in entry.keys if k["unique"] and k["name"] == "primary"), None)
            by = list(primary or (keys[0] if len(keys) == 1 else fields))
            gone = few(met.select(*by).distinct())
            touched, kept = self._split(entry, gone, by)
            rest = touched.join(gone, _null_safe(touched, gone, by), "left_anti")
            changed = self.spark.read.schema(rows.schema).parquet(self.store.add("_staged", rows))
            parts = (*kept, self._add(table, entry, rest.unionByName(changed)))
            for key in unique_keys(table, entry):
                if set(key) & set(targets):
                    self._check_unique(key, rest.unionByName(self.store.read(with_parts(entry, kept))), changed)
        added = self._append(table, with_parts(entry, parts), fresh, next_id, tuple(keys))
        return added if changed is None else added.unionByName(changed)

    def _split(self, entry: Entry, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, tuple[str, ...]]:
        """The rows of the folders that hold any of the keys, and the other folders."""
        rows = self.store.read(entry)
        files = rows.withColumn("_file", F.input_file_name()).join(keys, _null_safe(rows, keys, columns), "left_semi").select("_file").distinct()
        return self._folders(entry, files)

    def _folders(self, entry: Entry, files: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
        names = {r[0].rstrip("/").rpartition("/")[0].rpartition("/")[2] for r in files.collect()}
        hit = tuple(p for p in entry.parts if p.rpartition("/")[2] in names)
        return self.store.read(with_parts(entry, hit)), tuple(p for p in entry.parts if p not in hit)

    def _condition(self, node: Update | Delete, table: Table, scope: Scope | None = None) -> str:
        scope = scope or self.scope()
        parts = [a.condition.sql(scope) for a in node.additions if isinstance(a, Where) and not nil(a)]
        return " AND ".join(f"({p})" for p in parts) or "TRUE"

    def _touched(self, table: Table, entry: Entry, condition: str) -> tuple[DataFrame, tuple[str, ...]]:
        """Rows with ``_hit`` from the folders that have any, and the other folders; an unknown condition is no hit."""
        rows = self._where(table, self.store.read(entry).withColumn("_file", F.input_file_name()), condition)
        touched, kept = self._folders(entry, rows.select("_file").distinct())
        return touched, kept

    def _where(self, table: Table, rows: DataFrame, condition: str) -> DataFrame:
        view = f"q_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(view)
        return self.spark.sql(f"SELECT * FROM {quote(view)} AS {quote(table.name)} WHERE {condition}")

    def _update(self, node: Update) -> DataFrame:
        table, entry = node.table, self._entry(node.table)
        condition = self._condition(node, table)
        touched, kept = self._touched(table, entry, condition)
        values = {a.target.name: sql_of(a.value, self.scope()) for a in node.assignments}
        for c in table.columns:
            if c.flags.onupdate is not None and c.name not in values:
                values[c.name] = default_sql(c.flags.onupdate)
        if unknown := set(values) - {f.name for f in entry.struct}:
            raise KeyError(f"unknown column {sorted(unknown)[0]!r}")
        if not touched.columns or not len(entry.parts) - len(kept):
            return self.store.read(with_parts(entry, ()))
        view = f"q_{uuid.uuid4().hex}"
        touched.createOrReplaceTempView(view)
        # what a row was decides, so conditions and values see old values only
        picked = ", ".join(
            f"IF(_hit, {values[f.name]}, {quote(f.name)}) AS {quote(f.name)}" if f.name in values else quote(f.name) for f in entry.struct
        )
        hit = f"SELECT *, coalesce({condition}, FALSE) AS _hit FROM {quote(view)} AS {quote(table.name)}"
        rows = self.spark.sql(f"SELECT {picked}, _hit FROM ({hit}) AS {quote(table.name)}")
        rows = rows.select(*(checked(F.col(quote(f.name)), f, f"{table.name}.{f.name}").alias(f.name) for f in entry.struct), "_hit")
        part = self._add(table, entry, rows)
        marked = self.spark.read.parquet(part)
        new = with_parts(entry, (*kept, part))
        changed = marked.where("_hit").drop("_hit")
        for key in unique_keys(table, entry):
            if set(key) & set(values):
                rest = marked.where("NOT _hit").drop("_hit").unionByName(self.store.read(with_parts(entry, kept)))
                self._check_unique(key, rest, changed)
        self._overlay[table.qualified] = new
        return changed

    def _delete(self, node: Delete) -> DataFrame:
        table, entry = node.table, self._entry(node.table)
        condition = self._condition(node, table)
        touched, kept = self._touched(table, entry, condition)
        gone = self._where(table, touched, condition)
        left = self._where(table, touched, f"NOT coalesce({condition}, FALSE)")
        parts = kept if len(kept) == len(entry.parts) else (*kept, self._add(table, entry, left))
        self._overlay[table.qualified] = with_parts(entry, parts)
        return gone

    def compact(self, table: Table) -> None:
        """Rewrite a table's folders, of which each insert adds one, as one folder."""
        with self.transaction():
            entry = self._entry(table)
            if len(entry.parts) > 1:
                self._overlay[table.qualified] = with_parts(entry, (self._add(table, entry, self.store.read(entry)),))

    def affected(self, node: Update | Delete) -> int:
        """Run a change and say how many rows it met."""
        out = self.execute(dataclasses.replace(node, additions=(*node.additions, Returning())))
        return out.count()

    # models

    def insert(self, model: Any, *zero_fields: str, additions: tuple = ()) -> DataFrame | None:
        table = self._table_of(model)
        columns, values = table.columns_and_values_by_field_values(non_zero(model, *zero_fields))
        return self.execute(Insert().into(table, *additions).values(columns, *values))

    def assignments(self, model: Any, *zero_fields: str) -> tuple:
        return self._table_of(model).assignments_by_field_values(non_zero(model, *zero_fields))

    def _table_of(self, model: Any) -> Table:
        kind = model if isinstance(model, type) else type(model)
        return self.database.tables.get(table_of(kind).name) or table_of(kind)

    # transactions

    @property
    def in_transaction(self) -> bool:
        return self._overlay is not None

    def begin(self) -> Engine:
        if self._overlay is not None:
            raise NestedTransaction("a transaction is open")
        self._base = self.store.latest()
        self._overlay = dict(self._base.tables)
        return self

    def commit(self) -> None:
        if self._overlay is None:
            raise ValueError("no transaction is open")
        base, overlay = self._base, self._overlay
        self._base = self._overlay = None
        if self._cancelled.is_set():
            raise Cancelled(f"{self.group or 'work'} was cancelled")
        if overlay != base.tables:
            self.store.commit(base, overlay)

    def rollback(self) -> None:
        if self._overlay is None:
            raise ValueError("no transaction is open")
        self._base = self._overlay = None

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Engine]:
        """Commit at the end, roll back on any error; inside another one, be part of it."""
        if self._overlay is not None:
            yield self
            return
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()


class Tasks:
    """Steps that take effect together or not at all."""

    def __init__(self, engine: Engine):
        self.engine, self.steps = engine, []

    def with_(self, *steps: Callable[[Engine], Any]) -> Tasks:
        self.steps += steps
        return self

    def do(self) -> None:
        with self.engine.transaction():
            for step in self.steps:
                step(self.engine)


def _window(key: tuple[str, ...], columns: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*key).orderBy(*columns)


def _null_safe(left: DataFrame, right: DataFrame, columns: list[str]):
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def unique_keys(table: Table, entry: Entry) -> list[tuple[str, ...]]:
    """Columns of the unique keys: those stored, as the statement's table declares them; keys of an expression have none."""
    declared = {k.name: k.columns for k in table.keys}
    return [tuple(declared.get(k["name"], k["columns"])) for k in entry.keys if k["unique"] and k["columns"]]


#: Most bytes of the files behind a table that is sent to every task; rows in memory take a few times as much.
FEW_BYTES = 4 << 20


def few(df: DataFrame) -> DataFrame:
    """A broadcast of ``df`` if what it reads (written files, listed rows) has few bytes by the plan's statistics; else the join is left to Spark."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= FEW_BYTES else df


def default_sql(text: str) -> str:
    """A declared default as SQL; words without quotes stay expressions."""
    word = text.strip()
    return {"now()": "current_timestamp()", "current_timestamp": "current_timestamp()"}.get(word.lower(), word)


def checked(value, f: T.StructField, name: str):
    """A value cast to its column's type; null in a NOT NULL column and too long text are errors."""
    kind = f.dataType
    if isinstance(kind, T.VarcharType):
        value = value.cast("string")
        value = F.when(F.length(value) > kind.length, F.raise_error(F.lit(f"{name} is longer than {kind.length}"))).otherwise(value)
    else:
        value = value.cast(kind)
    if not f.nullable:
        value = F.coalesce(value, F.raise_error(F.lit(f"{name} is null")).cast(value_kind(kind)))
    return value


def value_kind(kind: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(kind, T.VarcharType) else kind


def bound(row: Row, target: type | None) -> Any:
    """A row as it is, as a dict, as a scalar or as a model.

    Columns meet fields by lower-cased name, or by ``table__column`` for
    nested models; others are ignored.  Null leaves a field's default.  A
    model with ``column_receivers`` gets its values through these.
    """
    if target is None:
        return row
    if target is dict:
        return row.asDict()
    if not dataclasses.is_dataclass(target):
        return row[0] if row[0] is None else target(row[0])
    values = {k.lower(): v for k, v in row.asDict().items() if v is not None}
    made = _filled(target, values)
    if hook := getattr(made, "column_receivers", None):
        for name, receive in hook().items():
            if name.lower() in values:
                receive(values[name.lower()])
    return made


def _filled(target: type, values: dict[str, Any], prefix: str = "") -> Any:
    hints, given = typing.get_type_hints(target), {}
    own = {c.field_name: c.name for c in model_fields(target) if len(c.path) == 1}
    for f in dataclasses.fields(target):
        kind = hints[f.name]
        if dataclasses.is_dataclass(kind):
            inner = f"{table_of(kind).name}__" if hasattr(kind, "__tablename__") else prefix
            given[f.name] = _filled(kind, values, inner)
        elif f.name in own:
            key = prefix + own[f.name]
            if key in values:
                given[f.name] = values[key]
            elif f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                given[f.name] = None
    return target(**given)


class ErrorMap:
    """Turns NotFoundError and ConflictError into a caller's own errors."""

    def __init__(self, error: BaseException | None):
        self.error, self.not_found, self.conflict, self.default = error, None, None, None

    def with_not_found(self, error: BaseException) -> ErrorMap:
        self.not_found = error
        return self

    def with_conflict(self, error: BaseException) -> ErrorMap:
        self.conflict = error
        return self

    def with_default(self, error: BaseException) -> ErrorMap:
        self.default = error
        return self

    def err(self) -> BaseException | None:
        if self.error is None:
            return None
        inner = unwrapped(self.error)
        if isinstance(inner, NotFoundError):
            return self.not_found or self.error
        if isinstance(inner, ConflictError):
            return self.conflict or self.error
        return self.default or self.error


def unwrapped(error: BaseException) -> BaseException:
    """The innermost cause."""
    while error.__cause__ is not None:
        error = error.__cause__
    return error
