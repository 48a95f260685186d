"""Published queries on stores: sources, migration, transactions, repositories, row scanning, and columns with nulls.

Each has its SQL.  Those that yield text (a plan, a log line, an error's name)
are compared with that text.
"""

from __future__ import annotations

import dataclasses
import enum
import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .functions import types as codecs
from .operators.engine import Engine, ErrorMap, Tasks, unwrapped
from .operators.migrate import created, diff, entity_relations, entry_of, migrate, one
from .operators.repository import Repository, soft_delete_keys
from .plans import nodes as n, statements as s
from .sources.catalogue import connected, introspected, run
from .sources.database import Database, ServerSource, masked
from .sources.model import Key, column, generated_name, parse_doc, snake, table_of
from .sources.store import NotFoundError, scratch_root

Query = Callable[[SparkSession, str], DataFrame]


class Segment(enum.IntEnum):
    UNKNOWN = 0
    HOUSEHOLD = 1
    TRADE = 2


@dataclass
class Person:
    """A person.

    Second line.
    """

    id: int = column("f_id,autoincrement", default=0)
    name: str = column("f_name,size=128", default="")
    nick: str = column("f_nick,size=64,default=''", default="")
    nation: codecs.Int32 = column("f_nation,default=0", default=0)
    segment: Segment = column("f_segment,default=0", default=Segment.UNKNOWN)
    created_at: codecs.Timestamp = column("f_created_at,default=0", default=0)
    updated_at: codecs.Timestamp = column("f_updated_at,default=0", default=0)
    deleted_at: codecs.Timestamp = column("f_deleted_at,default=0", default=0)

    __tablename__ = "t_person"
    primary_key = ("id",)
    indexes = ("unique_index i_name name", "index i_nation/BTREE nation")
    comments = {"name": "full name"}
    col_descriptions = {"name": ("full name", "as written")}
    col_relations = {"nation": ("Nation", "n_nationkey")}


@dataclass
class Person2:
    """The next version: a name renamed, a column added, two gone, one wider."""

    id: int = column("f_id,autoincrement", default=0)
    name: str = column("f_name,deprecated=full_name", default="")
    full_name: str = column("f_full_name,size=128", default="")
    nick: str = column("f_nick,deprecated", default="")
    nation: int = column("f_nation,default=0", default=0)
    age: codecs.Int32 = column("f_age,default=7", default=0)

    __tablename__ = "t_person"
    primary_key = ("id",)
    indexes = ("index i_age age",)


P = table_of(Person)
CORE = ("f_id", "f_name", "f_nick", "f_nation", "f_created_at", "f_updated_at", "f_deleted_at")
#: What the table holds at first, by SQL; ``{…}`` take other expressions.
PEOPLE = (
    "SELECT c_custkey AS f_id, c_name AS f_name, {nick} AS f_nick, {nation} AS f_nation, CAST({created} AS BIGINT) AS f_created_at,"
    " CAST({updated} AS BIGINT) AS f_updated_at, CAST({deleted} AS BIGINT) AS f_deleted_at FROM customer"
)
#: The first customer by name, who is changed.
FIRST = "c_name = (SELECT MIN(c_name) FROM customer)"


def people_sql(**changes: str) -> str:
    plain = {"nick": "''", "nation": "c_nationkey", "created": "0", "updated": "0", "deleted": "0"}
    return PEOPLE.format(**{k: f"CASE WHEN {FIRST} THEN {changes[k]} ELSE {v} END" if k in changes else v for k, v in plain.items()})


def new_sql(**values: str) -> str:
    """A row more, with the next id."""
    v = {"id": "MAX(c_custkey) + 1", "name": "'new'", "nick": "''", "nation": "3", "created": "1000", "updated": "1000"} | values
    return f" UNION ALL SELECT (SELECT {v['id']} FROM customer), {v['name']}, {v['nick']}, CAST({v['nation']} AS INTEGER), CAST({v['created']} AS BIGINT), CAST({v['updated']} AS BIGINT), CAST(0 AS BIGINT)"


def people(spark: SparkSession, sf_dir: str, schema: str = "") -> Engine:
    """A store with all customers as people."""
    database = Database("bench", schema).register(Person)
    out = Engine(spark, database, scratch_root(spark), {"customer": f"{sf_dir}/customer.parquet"})
    migrate(out)
    table = database.table("t_person")
    out.execute(s.insert().into(table).values(table.cols("f_id", "f_name", "f_nation"), s.select(n.cols("c_custkey", "c_name", "c_nationkey")).from_("customer")))
    return out


def state(e: Engine, *names: str) -> DataFrame:
    return e.query(s.select(n.cols(*(names or CORE))).from_(e.database.table("t_person")))


def first_name(e: Engine) -> str:
    return e.scalar(s.select(n.min_(n.col("f_name"))).from_(P))


def on_people(change: Callable[[Engine], Any]) -> Query:
    """The table after a change."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = people(spark, sf_dir)
        change(e)
        return state(e)

    return query


def by_repository(change: Callable[[Repository, str], Any]) -> Query:
    """The table after a repository's change; it gets the name of the first person."""
    return on_people(lambda e: change(Repository(e, Person, now=lambda: 1000), first_name(e)))


def texts(make: Callable[[SparkSession, str], list[Any]]) -> Query:
    """Numbered lines."""
    return lambda spark, sf_dir: spark.createDataFrame([(i, str(x)) for i, x in enumerate(make(spark, sf_dir))], "i long, line string")


def texts_sql(*lines: str) -> str:
    rows = ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(lines))
    return f"SELECT CAST(i AS BIGINT) AS i, line FROM (VALUES {rows}) v(i, line)"


def error_of(run: Callable[[], Any]) -> str:
    try:
        run()
    except Exception as e:
        return type(unwrapped(e)).__name__
    return "none"


# sources


def _embedded(spark: SparkSession) -> ServerSource:
    """An in-memory database of the JDBC driver that Spark brings along, with one filled table."""
    source = ServerSource(f"jdbc:derby:memory:{uuid.uuid4().hex}", (("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver"),))
    connected(spark, source)
    run(
        spark, source,
        "CREATE TABLE t_user (f_id BIGINT NOT NULL GENERATED BY DEFAULT AS IDENTITY, f_name VARCHAR(128) DEFAULT '' NOT NULL, f_age INT, f_score DECIMAL(10,2), PRIMARY KEY (f_id))",
        "CREATE UNIQUE INDEX i_name ON t_user (f_name)", "CREATE INDEX i_age ON t_user (f_age, f_name)",
        "INSERT INTO t_user (f_name, f_age, f_score) VALUES ('a', 1, 1.5), ('b', 2, NULL), ('c', NULL, 3.25)",
    )
    return source


def _jdbc_create(spark: SparkSession, _: str) -> list[Any]:
    source = ServerSource(f"jdbc:derby:memory:{uuid.uuid4().hex}", (("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver"),))
    root, name = ServerSource("jdbc:postgresql://h:5432/shop?ssl=1").root()
    return [connected(spark, source), connected(spark, source), root.url, name]


def _jdbc_catalogue(spark: SparkSession, _: str) -> list[Any]:
    table = introspected(spark, _embedded(spark), "bench", "APP").table("t_user")
    columns = [f"{c.name} {c.spark.simpleString()} {c.flags.null} {c.flags.autoincrement} {c.flags.default}" for c in table.columns]
    return columns + [f"{k.name} {k.unique} {','.join(k.columns)}" for k in table.keys]


def _jdbc_migration(spark: SparkSession, _: str) -> list[Any]:
    """The steps from a server's table to a declared one."""

    @dataclass
    class User:
        id: int = column("f_id,autoincrement", default=0)
        name: str = column("f_name,size=128,default=''", default="")
        age: int = column("f_age,null", default=0)
        __tablename__ = "t_user"
        primary_key = ("id",)

    held = introspected(spark, _embedded(spark), "bench", "APP").table("t_user").with_schema("")
    return diff(table_of(User), entry_of(held))


def _logged(spark: SparkSession, sf_dir: str) -> list[Any]:
    """What the engine logs of its statements, without the times."""
    e, lines = people(spark, sf_dir), []
    handler, logger = logging.Handler(), logging.getLogger("quillon")
    handler.emit = lambda r: lines.append(r.getMessage().split(": ", 1)[1])
    level = logger.level
    logger.addHandler(handler)
    logger.setLevel(logging.DEBUG)
    try:
        e.execute(s.insert().into(P).values(P.cols("f_name", "f_nation"), "it's", 3))
        e.execute(s.update(P).set(P.col("f_nick").value_by("x")).where(P.col("f_name").eq("it's")))
        e.execute(s.delete().from_(P, s.where(P.col("f_name").eq("it's"))))
    finally:
        logger.removeHandler(handler)
        logger.setLevel(level)
    return lines


# migration


def _table_create(spark: SparkSession, sf_dir: str) -> list[Any]:
    e = Engine(spark, Database("bench").register(Person), scratch_root(spark))
    e.create_database()
    one(e, "create table", P)
    one(e, "create table", P)  # there already: nothing changes
    return [f"{f.name} {f.dataType.simpleString()}" for f in e._tables()["t_person"].struct]


def _database_life(spark: SparkSession, sf_dir: str) -> list[Any]:
    e = Engine(spark, Database("bench", "shop").register(Person), scratch_root(spark))
    out = [e.store.exists()]
    migrate(e)  # makes database and schema
    out += [e.store.exists(), e.store.exists("shop"), "shop.t_person" in e._tables()]
    e.drop_database()
    return out + [e.store.exists(), len(e._tables())]


def _step(*steps: Callable[[Engine], Any], names: tuple[str, ...] = CORE) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = people(spark, sf_dir)
        for step in steps:
            step(e)
        return e.frame("t_person").select(*names)

    return query


def _dropped(spark: SparkSession, sf_dir: str) -> list[Any]:
    e = people(spark, sf_dir)
    one(e, "drop table", P)
    return ["t_person" in e._tables(), error_of(lambda: e.execute(s.delete().from_(P)))]


def _unique_index(spark: SparkSession, sf_dir: str) -> list[Any]:
    """A unique index on repeated values fails, on single ones holds, and is free again once dropped."""
    e = people(spark, sf_dir)
    add = lambda *columns: one(e, "add index", P, name="i_more", key=Key("i_more", (), columns, True))
    clash = s.update(P).set(P.col("f_nick").value_by("n")).where(P.col("f_id").lte(2))
    out = [error_of(lambda: add("f_nation"))]
    one(e, "add index", P, name="i_pair", key=Key("i_pair", (), ("f_nick", "f_deleted_at", "f_id"), True))
    e.execute(s.update(P).set(P.col("f_nick").value_by(n.expr("CAST(`f_id` AS STRING)"))).where(None))
    add("f_nick")
    out.append(error_of(lambda: e.execute(clash)))
    one(e, "drop index", P, name="i_more")
    return out + [error_of(lambda: e.execute(clash))]


def _index_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether files of a table with a BTREE index hold its columns in order: rows that come before a smaller one."""
    e = people(spark, sf_dir)
    e.frame("t_person").selectExpr("f_nation", "input_file_name() AS file", "monotonically_increasing_id() AS at").createOrReplaceTempView(view := f"q_{uuid.uuid4().hex}")
    return spark.sql(f"SELECT count(*) AS n FROM (SELECT f_nation, lead(f_nation) OVER (PARTITION BY file ORDER BY at) AS next FROM {view}) WHERE next < f_nation")


def _planned(spark: SparkSession, sf_dir: str) -> list[Any]:
    e = people(spark, sf_dir)
    before = e.store.latest().number
    out = migrate(e, Database("bench").register(Person2), dry_run=True)
    return [*out, e.store.latest().number == before]


def _upgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = people(spark, sf_dir)
    new = Database("bench").register(Person2)
    migrate(e, new)
    assert migrate(e, new, dry_run=True) == []
    return e.frame("t_person").select("f_id", "f_full_name", "f_nation", "f_age")


def _kinds(spark: SparkSession, sf_dir: str) -> list[Any]:
    kinds = (bool, codecs.Int8, codecs.UInt8, codecs.Int16, codecs.UInt16, codecs.Int32, codecs.UInt32, int, codecs.UInt64, codecs.Float32, float, bytes, str, codecs.Timestamp, codecs.Datetime, codecs.Json, codecs.Geometry, Segment, list[str], dict[str, str])
    return [codecs.spark_type(k).simpleString() for k in kinds] + [codecs.spark_type(str, codecs.Flags(size=30000)).simpleString()]


def _relations(spark: SparkSession, sf_dir: str) -> list[Any]:
    from .registry import Nation

    t = entity_relations(Database("bench").register(Person, Nation))["tables"]["t_person"]
    c = t["columns"]
    return [c["f_nation"]["references"], c["f_segment"]["enum"], c["f_name"]["type"], t["description"], t["keys"]["i_name"]["columns"]]


# transactions and scanning


def _transactions(spark: SparkSession, sf_dir: str) -> list[Any]:
    e = people(spark, sf_dir)
    count = lambda: e.scalar(s.select(n.count()).from_(P))
    whole = count()
    e.begin()
    out = [error_of(e.begin)]
    e.execute(s.delete().from_(P))
    out.append(count())
    e.rollback()
    out.append(count() == whole)
    e.begin()
    e.execute(s.delete().from_(P))
    e.commit()
    return out + [count(), error_of(e.commit)]


def _nested_tasks(e: Engine) -> None:
    """A list inside a list is part of the outer one."""
    update = lambda name, value: s.update(P).set(P.col(name).value_by(value)).where(P.col("f_name").eq(first_name(e)))
    Tasks(e).with_(lambda x: x.execute(update("f_nick", "t")), lambda x: Tasks(x).with_(lambda y: y.execute(update("f_nation", 77))).do()).do()


def _cancelled(spark: SparkSession, sf_dir: str) -> list[Any]:
    e = people(spark, sf_dir).with_context("quillon-cancelled")
    e.begin()
    e.execute(s.delete().from_(P))
    e.cancel()
    out = [error_of(e.commit)]
    return out + [people(spark, sf_dir).scalar(s.select(n.count()).from_(P)) > 0]


@dataclass
class Received:
    """A model that takes two columns by itself."""

    id: int = column("f_id", default=0)
    seen: list = dataclasses.field(default_factory=list, metadata={"db": "-"})

    def column_receivers(self) -> dict[str, Callable[[Any], None]]:
        return {"f_name": lambda v: self.seen.append(v.upper()), "f_nation": self.seen.append}


def _iterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = people(spark, sf_dir)
    rows = [(m.id, m.name) for m in e.each(s.select().from_(P, s.where(P.col("f_nation").eq(3))), Person)]
    return spark.createDataFrame(rows, "f_id long, f_name string")


def _received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by receivers; others that no field has are left out."""
    e = people(spark, sf_dir)
    rows = e.fetch(s.select().from_(P, s.where(P.col("f_nation").eq(3))), Received)
    return spark.createDataFrame([(m.id, m.seen[0], m.seen[1], len(vars(m))) for m in rows], "f_id long, name string, nation int, n long")


def _errors(spark: SparkSession, sf_dir: str) -> list[Any]:
    e = people(spark, sf_dir)
    missing, taken = KeyError("missing"), KeyError("taken")

    def mapped(run: Callable[[], Any]) -> str:
        try:
            run()
        except Exception as x:
            return str(ErrorMap(x).with_not_found(missing).with_conflict(taken).err())
        return "none"

    lookup = lambda: e.one(s.select().from_(P, s.where(P.col("f_id").eq(-1))), Person)
    again = s.insert().into(P).values(P.cols("f_name"), first_name(e))

    def wrapped() -> None:
        try:
            lookup()
        except NotFoundError as x:
            raise RuntimeError("outer") from x

    return [mapped(lookup), mapped(lambda: e.execute(again)), error_of(lambda: e.execute(again)), error_of(wrapped), mapped(lambda: None)]


# models and metadata


def _inserted_model(e: Engine) -> None:
    e.insert(Person(name="new", nation=3, created_at=1000, updated_at=1000), "nick")


def _assigned_model(e: Engine) -> None:
    e.execute(s.update(P).set(*e.assignments(Person(nick="m", nation=0), "nation")).where(P.col("f_name").eq(first_name(e))))


def _assigned_map(e: Engine) -> None:
    e.execute(s.update(P).set(*P.assignments_by_field_values({"nick": "m", "nation": 9})).where(P.f("name").eq(first_name(e))))


def _inserted_map(e: Engine) -> None:
    columns, values = P.columns_and_values_by_field_values({"updated_at": 1000, "name": "new", "nation": 3, "created_at": 1000})
    e.execute(s.insert().into(P).values(columns, *values))


def _metadata(spark: SparkSession, sf_dir: str) -> list[Any]:
    r = Repository(people(spark, sf_dir), Person)
    return [r.index_field_names, r.comments, r.col_descriptions, r.col_relations, r.primary_key, r.indexes, r.unique_indexes, r.field_key("name")]


def _names(spark: SparkSession, sf_dir: str) -> list[Any]:
    doc = parse_doc("A person.\n@def primary ID\n@def unique_index i_name Name\n@rel Org.ID\nMore.")
    soft = soft_delete_keys(P)
    database = Database("bench").register(Person)
    return [
        *doc, [k.columns for k in soft.keys], generated_name("RealName"), snake("UserRole"), table_of(Received).name, list(database.tables),
        database.t(Person).name, [str(c) for c in created(P)][:2],
    ]


class Upper(str):
    """A value that is written inside a function."""

    def value_sql(self) -> str:
        return f"upper({n.literal(str(self))})"


def _picked(spark: SparkSession, sf_dir: str) -> list[Any]:
    names = lambda m: [c.name for c in m.items]
    return [
        names(P.fields("name", "id")), names(P.cols("F_NAME")), len(P.fields().items), error_of(lambda: P.f("missing")), error_of(lambda: P.col("missing")),
        n.literal(Upper("a")),
    ]


# nulls

NULLS = [(1, "a", 1), (2, None, 1), (3, "c", None), (None, "d", 2), (None, None, None), (3, "c", None)]
NULLS_SQL = "(VALUES (1, 'a', 1), (2, NULL, 1), (3, 'c', NULL), (NULL, 'd', 2), (NULL, NULL, NULL), (3, 'c', NULL)) x(k, v, p)"


def on_nulls(node: Callable[[], n.Expr]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame(NULLS, "k int, v string, p int")
        return Engine(spark, sources={"x": rows, "y": rows.selectExpr("k AS yk", "v AS yv")}).query(node())

    return query


K, V = n.col("k"), n.col("v")


def _where(condition: n.Expr) -> Callable[[], n.Expr]:
    return lambda: s.select(n.cols("k", "v")).from_("x", s.where(condition))


def _join(kind: Callable) -> Callable[[], n.Expr]:
    return lambda: s.select(n.cols("k", "v", "yv")).from_("x", kind("y").on_(n.as_condition(n.expr("`k` = `yk`"))))


def _null_join(kind: str) -> str:
    return f"SELECT k, v, yv FROM {NULLS_SQL} {kind} JOIN (SELECT k AS yk, v AS yv FROM {NULLS_SQL}) y ON k = yk"


STORE: dict[str, tuple[Query, str]] = {
    "schema_scan": (lambda spark, sf_dir: state(people(spark, sf_dir, "shop")), people_sql()),
    "jdbc_names": (
        texts(lambda spark, _: [ServerSource("jdbc:mysql://h:1/a?x=1").with_database("b").url, masked("mysql://u:secret@h/db"), ServerSource("jdbc:postgresql://h/db?user=a&password=secret")]),
        texts_sql("jdbc:mysql://h:1/b?x=1", "mysql://u:******@h/db", "ServerSource(jdbc:postgresql://h/db?user=a&password=******)"),
    ),
    "jdbc_create": (texts(_jdbc_create), texts_sql("True", "False", "jdbc:postgresql://h:5432/postgres?ssl=1", "shop")),
    "jdbc_scan": (
        lambda spark, _: _embedded(spark).read(spark, "t_user", "F_ID", 0, 4, 2).selectExpr("F_ID AS f_id", "F_NAME AS f_name", "F_AGE AS f_age"),
        "SELECT CAST(i AS BIGINT) AS f_id, n AS f_name, a AS f_age FROM (VALUES (1, 'a', 1), (2, 'b', 2), (3, 'c', NULL)) v(i, n, a)",
    ),
    "jdbc_catalogue": (
        texts(_jdbc_catalogue),
        texts_sql("f_id bigint False True None", "f_name varchar(128) False False ''", "f_age int True False None", "f_score decimal(10,2) True False None", "primary True f_id", "i_age False f_age,f_name", "i_name True f_name"),
    ),
    "jdbc_migration": (
        texts(_jdbc_migration),
        texts_sql("MODIFY COLUMN t_user f_age bigint;", "DROP INDEX t_user i_age;", "DROP INDEX t_user i_name;"),
    ),
    "query_log": (
        texts(_logged),
        texts_sql(
            "INSERT INTO `t_person` (`f_name`, `f_nation`) VALUES ('it\\'s', 3)", "UPDATE `t_person` SET `f_nick` = 'x' WHERE (`f_name` = 'it\\'s')", "DELETE FROM `t_person` WHERE (`f_name` = 'it\\'s')"
        ),
    ),
    "database_life": (texts(_database_life), texts_sql("False", "True", "True", "True", "False", "0")),
    "table_create": (
        texts(_table_create),
        texts_sql("f_id bigint", "f_name varchar(128)", "f_nick varchar(64)", "f_nation int", "f_segment int", "f_created_at bigint", "f_updated_at bigint", "f_deleted_at bigint"),
    ),
    "table_drop": (texts(_dropped), texts_sql("False", "NotFoundError")),
    "truncate": (_step(lambda e: one(e, "truncate", P)), people_sql() + " WHERE FALSE"),
    "add_column": (
        _step(lambda e: one(e, "add column", P, name="f_age", field=table_of(Person2).columns.named("f_age")[0].struct_field(), default="7"), names=("f_id", "f_age")),
        "SELECT c_custkey AS f_id, CAST(7 AS INTEGER) AS f_age FROM customer",
    ),
    "modify_column": (
        _step(lambda e: one(e, "modify column", P, name="f_nation", field=table_of(Person2).columns.named("f_nation")[0].struct_field(), default="0"), names=("f_id", "f_nation")),
        "SELECT c_custkey AS f_id, CAST(c_nationkey AS BIGINT) AS f_nation FROM customer",
    ),
    "unique_index": (texts(_unique_index), texts_sql("ConflictError", "ConflictError", "none")),
    "index_layout": (_index_layout, "SELECT CAST(0 AS BIGINT) AS n"),
    "data_types": (
        texts(_kinds),
        texts_sql(
            "boolean", "tinyint", "smallint", "smallint", "int", "int", "bigint", "bigint", "decimal(20,0)", "float", "double", "binary", "varchar(255)", "bigint", "timestamp_ntz", "string", "string", "int",
            "array<string>", "map<string,string>", "string",
        ),
    ),
    "migration_plan": (
        texts(_planned),
        texts_sql(
            "RENAME COLUMN t_person f_name TO f_full_name;", "DROP COLUMN t_person f_nick;", "MODIFY COLUMN t_person f_nation bigint NOT NULL DEFAULT 0;", "ADD COLUMN t_person f_age int NOT NULL DEFAULT 7;",
            "DROP INDEX t_person i_name;", "DROP INDEX t_person i_nation;", "ADD INDEX t_person i_age (f_age);", "True",
        ),
    ),
    "migration": (_upgraded, "SELECT c_custkey AS f_id, c_name AS f_full_name, CAST(c_nationkey AS BIGINT) AS f_nation, CAST(7 AS INTEGER) AS f_age FROM customer"),
    "enum_rows": (
        lambda spark, sf_dir: people(spark, sf_dir).frame("t_sql_meta_enum").select("f_table_name", "f_column_name", "f_value", "f_key"),
        "SELECT t AS f_table_name, c AS f_column_name, CAST(v AS INTEGER) AS f_value, k AS f_key FROM (VALUES ('t_person', 'f_segment', 1, 'HOUSEHOLD'), ('t_person', 'f_segment', 2, 'TRADE')) x(t, c, v, k)",
    ),
    "entity_relations": (
        texts(_relations),
        texts_sql("['nation', 'n_nationkey']", "{'UNKNOWN': 0, 'HOUSEHOLD': 1, 'TRADE': 2}", "varchar(128)", "['A person.', 'Second line.']", "['f_name']"),
    ),
    "transactions": (texts(_transactions), texts_sql("NestedTransaction", "0", "True", "0", "ValueError")),
    "nested_tasks": (on_people(_nested_tasks), people_sql(nick="'t'", nation="77")),
    "cancelled": (texts(_cancelled), texts_sql("Cancelled", "True")),
    "scan_iterator": (_iterated, "SELECT c_custkey AS f_id, c_name AS f_name FROM customer WHERE c_nationkey = 3"),
    "scan_receivers": (_received, "SELECT c_custkey AS f_id, upper(c_name) AS name, c_nationkey AS nation, CAST(2 AS BIGINT) AS n FROM customer WHERE c_nationkey = 3"),
    "error_classes": (texts(_errors), texts_sql("'missing'", "'taken'", "ConflictError", "NotFoundError", "none")),
    "insert_model": (on_people(_inserted_model), people_sql() + new_sql()),
    "assign_model": (on_people(_assigned_model), people_sql(nick="'m'", nation="0")),
    "assign_map": (on_people(_assigned_map), people_sql(nick="'m'", nation="9")),
    "insert_map": (on_people(_inserted_map), people_sql() + new_sql()),
    "repo_create": (by_repository(lambda r, name: r.create(Person(name="new", nation=3))), people_sql() + new_sql()),
    "repo_create_or_update": (
        by_repository(lambda r, name: [r.create_on_duplicate_with_update_fields(Person(name=x, nick="z", nation=3), ["nick"]) for x in (name, "new")]),
        people_sql(nick="'z'", updated="1000") + new_sql(id="MAX(c_custkey) + 2", nick="'z'"),  # the first one took an id, as servers do
    ),
    "repo_delete_by_struct": (by_repository(lambda r, name: r.delete_by_struct(Person(name=name))), f"{people_sql()} WHERE NOT ({FIRST})"),
    "repo_update_with_map": (by_repository(lambda r, name: r.update_by_name_with_map(name, {"nick": "u"})), people_sql(nick="'u'", updated="1000")),
    "repo_update_with_struct": (by_repository(lambda r, name: r.update_by_name_with_struct(name, Person(nick="u"), "nation")), people_sql(nick="'u'", nation="0", updated="1000")),
    "repo_fetch_for_update": (
        lambda spark, sf_dir: spark.createDataFrame([((m := (r := Repository(e := people(spark, sf_dir), Person)).fetch_by_name_for_update(first_name(e))).id, m.name)], "f_id long, f_name string"),
        f"SELECT c_custkey AS f_id, c_name AS f_name FROM customer WHERE {FIRST}",
    ),
    "repo_delete_by_key": (by_repository(lambda r, name: r.delete_by_name(name)), f"{people_sql()} WHERE NOT ({FIRST})"),
    "repo_soft_delete": (by_repository(lambda r, name: r.soft_delete_by_name(name)), people_sql(updated="1000", deleted="1000")),
    "repo_soft_deleted_key": (
        by_repository(lambda r, name: [r.soft_delete_by_name(name), r.create(Person(name=name, nation=3))]),
        people_sql(updated="1000", deleted="1000") + new_sql(name="(SELECT MIN(c_name) FROM customer)"),
    ),
    "repo_metadata": (
        texts(_metadata),
        texts_sql(
            "['deleted_at', 'id', 'name', 'nation']", "{'name': 'full name'}", "{'name': ['full name', 'as written']}", "{'nation': ['Nation', 'n_nationkey']}", "['id', 'deleted_at']", "{'i_nation': ['nation']}",
            "{'i_name': ['name', 'deleted_at']}", "name",
        ),
    ),
    "model_names": (
        texts(_names),
        texts_sql(
            "['A person.', 'More.']", "['primary ID', 'unique_index i_name Name']", "{'ID': 'Org.ID'}", "[('f_name', 'f_deleted_at'), ('f_nation',), ('f_id', 'f_deleted_at')]", "f_realname", "user_role", "t_received",
            "['t_person']", "t_person", "['CREATE TABLE t_person;', 'ADD INDEX t_person i_name UNIQUE (f_name);']",
        ),
    ),
    "pick_columns": (texts(_picked), texts_sql("['f_name', 'f_id']", "['f_name']", "8", "KeyError", "KeyError", "upper('a')")),
    "value_in_sql": (
        lambda spark, sf_dir: people(spark, sf_dir).query(s.select(n.cols("f_id", "f_name")).from_(P, s.where(n.as_condition(n.expr("upper(`f_name`) = ?", Upper("customer#000000001")))))),
        "SELECT c_custkey AS f_id, c_name AS f_name FROM customer WHERE upper(c_name) = upper('customer#000000001')",
    ),
    "custom_addition": (
        lambda spark, sf_dir: people(spark, sf_dir).query(s.select(n.cols("f_nation")).from_(P, s.as_addition(n.expr("DISTRIBUTE BY `f_nation` SORT BY `f_nation`")))),
        "SELECT c_nationkey AS f_nation FROM customer",
    ),
    "null_is": (on_nulls(_where(V.is_null())), f"SELECT k, v FROM {NULLS_SQL} WHERE v IS NULL"),
    "null_is_not": (on_nulls(_where(V.is_not_null())), f"SELECT k, v FROM {NULLS_SQL} WHERE v IS NOT NULL"),
    "null_neq": (on_nulls(_where(V.neq("a"))), f"SELECT k, v FROM {NULLS_SQL} WHERE v <> 'a'"),
    "null_xor": (on_nulls(_where(n.xor(K.gt(1), V.eq("a")))), f"SELECT k, v FROM {NULLS_SQL} WHERE (k > 1) <> (v = 'a')"),
    "null_not_in": (on_nulls(_where(K.not_in(s.select(n.cols("p")).from_("x")))), f"SELECT k, v FROM {NULLS_SQL} WHERE k NOT IN (SELECT p FROM {NULLS_SQL})"),
    "null_in": (on_nulls(_where(K.in_(s.select(n.cols("p")).from_("x")))), f"SELECT k, v FROM {NULLS_SQL} WHERE k IN (SELECT p FROM {NULLS_SQL})"),
    "null_join_inner": (on_nulls(_join(s.inner_join)), _null_join("INNER")),
    "null_join_left": (on_nulls(_join(s.left_join)), _null_join("LEFT")),
    "null_join_full": (on_nulls(_join(s.full_join)), _null_join("FULL")),
    "null_group": (
        on_nulls(lambda: s.select(n.auto_alias(n.col("p"), n.count(n.col("k")).alias("ks"), n.count().alias("n"), n.max_(n.col("v")).alias("vs"))).from_("x", s.group_by(n.col("p")))),
        f"SELECT p, COUNT(k) AS ks, COUNT(1) AS n, MAX(v) AS vs FROM {NULLS_SQL} GROUP BY p",
    ),
    "null_intersect": (
        on_nulls(lambda: dataclasses.replace(q := s.select(n.cols("k")).from_("x"), additions=(*q.additions, s.intersect().distinct(s.select(n.cols("p")).from_("x"))))),
        f"SELECT k FROM {NULLS_SQL} INTERSECT SELECT p FROM {NULLS_SQL}",
    ),
}


def queries() -> dict[str, Query]:
    return {k: run for k, (run, _) in STORE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: text for k, (_, text) in STORE.items()}
