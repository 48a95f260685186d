"""A server's catalogue through JDBC metadata: its tables, columns, defaults, comments, keys and indexes."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession, types as T

from ..functions.types import Flags
from .database import Database, ServerSource, _Described
from .model import ColumnDef, Columns, Key, Table

#: Error codes and states by which servers say that a database is unknown; fixed values.
UNKNOWN_CODES, UNKNOWN_STATES = (1049,), ("3D000", "XJ004")
#: Spark types by the numbers of java.sql.Types; fixed values.
KINDS = {
    -7: T.BooleanType(), 16: T.BooleanType(), -6: T.ByteType(), 5: T.ShortType(), 4: T.IntegerType(), -5: T.LongType(), 7: T.FloatType(),
    6: T.DoubleType(), 8: T.DoubleType(), 91: T.DateType(), 93: T.TimestampNTZType(), 2014: T.TimestampType(), -2: T.BinaryType(),
    -3: T.BinaryType(), -4: T.BinaryType(), 2004: T.BinaryType(),
}
SYSTEM = ("sys", "syscat", "syscs_diag", "syscs_util", "sysfun", "sysibm", "sysproc", "sysstat", "nullid", "sqlj", "information_schema", "pg_catalog", "mysql", "performance_schema")


@contextlib.contextmanager
def connection(spark: SparkSession, source: ServerSource) -> Iterator[Any]:
    """A JDBC connection of the driver, closed at the end."""
    jvm = spark._jvm
    options = dict(source.options)
    if driver := options.pop("driver", ""):
        jvm.java.lang.Class.forName(driver, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    given = jvm.java.util.Properties()
    for k, v in options.items():
        given.setProperty(k, v)
    held = jvm.java.sql.DriverManager.getConnection(source.url, given)
    try:
        yield held
    finally:
        held.close()


def run(spark: SparkSession, source: ServerSource, *statements: str) -> None:
    with connection(spark, source) as held:
        for text in statements:
            statement = held.createStatement()
            statement.execute(text)
            statement.close()


def unknown_database(error: Py4JJavaError) -> bool:
    cause = error.java_exception
    code, state = getattr(cause, "getErrorCode", None), getattr(cause, "getSQLState", None)
    try:
        return code() in UNKNOWN_CODES or state() in UNKNOWN_STATES
    except Exception:  # not a SQL error
        return False


def connected(spark: SparkSession, source: ServerSource, extensions: tuple[str, ...] = ()) -> bool:
    """Connect to a server's database, which is created if the server doesn't know it, and add extensions; whether it was created."""
    made = False
    try:
        with connection(spark, source):
            pass
    except Py4JJavaError as e:
        if not unknown_database(e):
            raise
        made = True
        root, name = source.root()
        if name:
            run(spark, root, f"CREATE DATABASE {name}")
        else:  # an embedded database is created by its own url
            with connection(spark, root):
                pass
    if extensions:
        run(spark, source, *(f"CREATE EXTENSION IF NOT EXISTS {e}" for e in extensions))
    return made


def _rows(result: Any, *names: str) -> list[tuple]:
    out = []
    while result.next():
        out.append(tuple(result.getObject(n) for n in names))
    result.close()
    return out


def _kind(number: int, size: int, scale: int | None) -> T.DataType:
    if number in (2, 3):
        return T.DecimalType(min(size or 38, 38), scale or 0)
    if number in (1, 12, -15, -9) and 0 < size <= 65535:
        return T.VarcharType(size)
    return KINDS.get(number, T.StringType())


def introspected(spark: SparkSession, source: ServerSource, name: str, schema: str = "") -> Database:
    """The tables of a schema (all but the server's own without one), as a database to compare declared tables with.

    Names are lower-cased; key columns stay in the index's order; an index that
    only repeats the primary key is left out.
    """
    out = Database(name, schema.lower())
    with connection(spark, source) as held:
        about = held.getMetaData()
        array = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 1)
        array[0] = "TABLE"
        for catalog, space, table, remarks in _rows(about.getTables(held.getCatalog(), schema or None, "%", array), "TABLE_CAT", "TABLE_SCHEM", "TABLE_NAME", "REMARKS"):
            if (space or "").lower() in SYSTEM:
                continue
            columns = []
            described = _rows(about.getColumns(catalog, space, table, "%"), "ORDINAL_POSITION", "COLUMN_NAME", "DATA_TYPE", "COLUMN_SIZE", "DECIMAL_DIGITS", "IS_NULLABLE", "COLUMN_DEF", "REMARKS", "IS_AUTOINCREMENT")
            for _, column, number, size, scale, null, default, comment, auto in sorted(described, key=lambda r: r[0]):
                grows = auto == "YES"
                flags = Flags(null=null == "YES", autoincrement=grows, default=None if grows or default in (None, "NULL") else default)
                columns.append(ColumnDef(column.lower(), column.lower(), _Described(_kind(number, size or 0, scale)), flags, comment=comment or ""))
            primary = sorted(_rows(about.getPrimaryKeys(catalog, space, table), "KEY_SEQ", "COLUMN_NAME"))
            keys = [Key("primary", (), tuple(c.lower() for _, c in primary), True)] if primary else []
            indexes: dict[str, list] = {}
            for index, free, column, place in _rows(about.getIndexInfo(catalog, space, table, False, True), "INDEX_NAME", "NON_UNIQUE", "COLUMN_NAME", "ORDINAL_POSITION"):
                if index and column:
                    indexes.setdefault(index, []).append((place, column.lower(), not free))
            for index, listed in sorted(indexes.items()):
                names = tuple(c for _, c, _ in sorted(listed))
                if not (primary and names == keys[0].columns and listed[0][2]):
                    keys.append(Key(index.lower(), (), names, listed[0][2]))
            out.tables.add(Table(table.lower(), Columns(columns), tuple(keys), schema.lower(), tuple([remarks] if remarks else ())))
    return out
