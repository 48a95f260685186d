"""Models, changes, transactions, migration and repositories on temporary stores."""

import enum
import importlib.util
import json
import os
import subprocess
import sys
from dataclasses import dataclass
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from quillon.functions import types as codecs
from quillon.operators.engine import Engine, ErrorMap, NestedTransaction, Tasks
from quillon.operators.migrate import entity_relations, migrate
from quillon.operators.repository import Repository
from quillon.plans import nodes as n, statements as s
from quillon.sources import database as sources
from quillon.sources.catalogue import connected, run
from quillon.sources.database import Database, ServerSource, feature_database, masked
from quillon.sources.model import column, columns_by_struct, field_values, non_zero, parse_doc, parse_index, table_of
from quillon.sources.store import ConflictError, NotFoundError, VersionConflict


class Gender(enum.IntEnum):
    UNKNOWN = 0
    FEMALE = 1
    MALE = 2


@dataclass
class User:
    id: int = column("f_id,autoincrement", default=0)
    name: str = column("f_name,size=20", default="")
    gender: Gender = column("f_gender,default=0", default=Gender.UNKNOWN)
    nick: str | None = column("f_nick,null", default=None)
    created_at: codecs.Timestamp = column("f_created_at,default=0", default=0)
    updated_at: codecs.Timestamp = column("f_updated_at,default=0", default=0)
    deleted_at: codecs.Timestamp = column("f_deleted_at,default=0", default=0)

    __tablename__ = "t_user"
    primary_key = ("id",)
    indexes = ("unique_index i_name name", "index i_nick/BTREE nick")
    col_relations = {"nick": ("User", "id")}


@pytest.fixture()
def engine(spark, tmp_path):
    out = Engine(spark, Database("test").register(User), f"file://{tmp_path}/store")
    migrate(out)
    return out


U = table_of(User)


def names(engine):
    return sorted(r[0] for r in engine.query(s.select(n.cols("f_name")).from_(U)).collect())


def test_models():
    assert [c.name for c in U.columns][:4] == ["f_id", "f_name", "f_gender", "f_nick"]
    assert U.primary.columns == ("f_id",) and U.key("i_nick").method == "BTREE"
    assert non_zero(User(id=3, name="x")) == {"name": "x"}
    assert non_zero(User(name="x"), "gender") == {"name": "x", "gender": Gender.UNKNOWN}
    assert set(field_values(User(), ["nick"])) == {"nick"}
    assert U.spark_schema()["f_name"].dataType == T.VarcharType(20) and not U.spark_schema()["f_name"].nullable
    with pytest.raises(TypeError):
        table_of(int)
    with pytest.raises(KeyError):
        U.f("missing")
    with pytest.raises(ValueError):
        codecs.parse_tag("f,size=x")
    assert codecs.parse_tag("f_a,default='a,b=c'")[1].default == "'a,b=c'"
    assert parse_index("unique_index i_x/HASH (lower(f_name))")[4] == "(lower(f_name))"
    assert parse_doc("A user.\n@def primary ID\n@rel Org.ID")[1:] == (["primary ID"], {"ID": "Org.ID"})
    assert codecs.spark_type(list[str]) == T.ArrayType(T.StringType()) and codecs.spark_type(bytes) == T.BinaryType()
    with pytest.raises(TypeError):
        codecs.spark_type(complex)
    assert len(columns_by_struct(User).items) == 7


def test_names(monkeypatch):
    monkeypatch.setenv("PROJECT_FEATURE", "f1")
    assert feature_database("db").name == "db__f1"
    assert masked("mysql://u:secret@h/db?x=1") == "mysql://u:******@h/db?x=1"
    assert "secret" not in repr(ServerSource("jdbc:postgresql://h/db?user=a&password=secret"))
    assert ServerSource("jdbc:mysql://h:1/a?x=1").with_database("b").url == "jdbc:mysql://h:1/b?x=1"


def test_embedded_urls():
    for url in ("jdbc:derby:memory:a", "jdbc:derby:/a/b@c;create=true", "jdbc:h2:file:~/a", "jdbc:sqlite:file:///a/b", "jdbc:postgresql:shop"):
        assert ServerSource(url).embedded, url
    for url in ("jdbc:mysql://h:1/a?x=1", "jdbc:derby://h:1527/a", "jdbc:h2:tcp://h/a", "jdbc:sqlserver://h:1433;databaseName=a", "jdbc:oracle:thin:@h:1521:a", "jdbc:mysql:replication://h/a"):
        assert not ServerSource(url).embedded, url


def test_embedded_copy(spark, tmp_path, monkeypatch):
    source = ServerSource(f"jdbc:derby:memory:{tmp_path.name}", (("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver"),))
    connected(spark, source)
    kinds = "k BIGINT, s CHAR(3), v VARCHAR(9), c CLOB, b BLOB, f DOUBLE, d DECIMAL(20,5), day DATE, t TIMESTAMP, i SMALLINT, y BOOLEAN"
    row = "'a', 'b', 'c', CAST(X'00ff' AS BLOB), 0.1, 123456789012345.12345, '1970-01-01', '2000-02-29 01:02:03.456789', 7, TRUE"
    run(
        spark, source, f"CREATE TABLE held ({kinds})", f"CREATE TABLE bare ({kinds})", f"INSERT INTO held VALUES {', '.join(f'({i}, {row})' for i in range(100))}",
        "INSERT INTO held (s) VALUES (NULL), ('x'), ('x')",
    )
    monkeypatch.setattr(sources, "BATCH_BYTES", 20_000)  # several batches, and several tasks in each
    monkeypatch.setattr(sources, "TASK_BYTES", 5_000)
    for table, parts in (("held", 1), ("held", 3), ("bare", 2)):
        direct = source.read(spark, table, "K", 0, 100, parts)
        got = sources.copied(spark, direct)
        assert got.schema.simpleString() == direct.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, direct.collect())) and got.count() == (103 if table == "held" else 0)


def test_embedded_scan_on_executors(tmp_path, sf):
    """Executors of their own processes can't open the driver's database."""
    home = tmp_path / "home"  # executors' logs go below Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    code = f"""
from pyspark.sql import SparkSession
from quillon.registry_store import STORE
spark = (
    SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "600m")
    .config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
)
print(sorted(map(tuple, STORE["jdbc_scan"][0](spark, "{sf}").collect())))
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_", "_PYSPARK"))} | {
        "PYTHONPATH": str(Path(__file__).resolve().parent.parent), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"),
    }
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert done.stdout.strip() == "[(1, 'a', 1), (2, 'b', 2), (3, 'c', None)]", done.stderr[-2000:]


def test_changes(engine):
    for name in ("a", "b"):
        engine.insert(User(name=name))
    rows = engine.fetch(s.select().from_(U, s.order_by(n.asc(U.f("id")))), User)
    assert [(r.id, r.name, r.nick) for r in rows] == [(1, "a", None), (2, "b", None)]
    with pytest.raises(ConflictError):
        engine.insert(User(name="a"))
    with pytest.raises(Exception, match="longer than 20"):
        engine.insert(User(name="x" * 21))
    with pytest.raises(Exception, match="is null"):
        engine.execute(s.insert().into(U).values(U.cols("f_name"), None))
    assert names(engine) == ["a", "b"]
    engine.execute(s.update(U).set(U.f("nick").value_by("n")).where(U.f("nick").neq("zzz")))  # unknown is no hit
    assert engine.scalar(s.select(n.count()).from_(U, s.where(U.f("nick").is_null()))) == 2
    with pytest.raises(ConflictError):
        engine.execute(s.update(U).set(U.f("name").value_by("b")).where(U.f("id").eq(1)))
    engine.execute(s.update(U).set(U.f("name").value_by(n.func("upper", U.f("name")))).where(None))
    assert names(engine) == ["A", "B"]
    engine.execute(s.delete().from_(U, s.where(U.f("name").eq("A"))))
    assert names(engine) == ["B"]
    assert engine.scalar(s.select(n.max_(U.f("id"))).from_(U)) == 2
    with pytest.raises(NotFoundError):
        engine.one(s.select().from_(U, s.where(U.f("id").eq(99))), User)


def test_transactions(engine):
    with pytest.raises(ZeroDivisionError):
        Tasks(engine).with_(lambda e: e.insert(User(name="a")), lambda e: 1 / 0).do()
    assert names(engine) == []
    Tasks(engine).with_(lambda e: e.insert(User(name="a")), lambda e: Tasks(e).with_(lambda x: x.insert(User(name="b"))).do()).do()
    assert names(engine) == ["a", "b"]
    engine.begin()
    with pytest.raises(NestedTransaction):
        engine.begin()
    engine.execute(s.delete().from_(U))
    assert names(engine) == []
    engine.rollback()
    assert names(engine) == ["a", "b"]
    other = Engine(engine.spark, engine.database, engine.store)
    engine.begin()
    engine.insert(User(name="c"))
    other.insert(User(name="d"))
    with pytest.raises(VersionConflict):
        engine.commit()
    assert names(other) == ["a", "b", "d"]


def test_writes_at_scale(engine):
    """Changes meet stored rows by equal joins on the new rows' side, whatever the number of keys; literals are left as they are."""
    for name in ("a", "b"):
        engine.insert(User(name=name))
    seen = []
    joins = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString())
    add, empty = engine.store.add, type(engine.frame("t_user")).isEmpty
    engine.store.add = lambda name, df: (joins(df), add(name, df))[1]
    type(engine.frame("t_user")).isEmpty = lambda df: (joins(df), empty(df))[1]
    try:
        strange = "`t_user`.`f_name` and `f_nick`, `excluded`.`f_name`"
        node = s.insert().into(U, s.on_duplicate_key_update(U.f("nick").value_by(n.func("concat", n.expr("?", strange), U.f("name"), n.col("f_name", "excluded").full()))))
        engine.execute(node.values(U.cols("f_id", "f_name"), 1, "b", 77, "c"))
    finally:
        engine.store.add, type(engine.frame("t_user")).isEmpty = add, empty
    assert seen and not any("NestedLoop" in p or "Cartesian" in p for p in seen)
    rows = {r.id: (r.name, r.nick) for r in engine.fetch(s.select().from_(U), User)}
    assert rows == {1: ("a", f"{strange}ab"), 2: ("b", f"{strange}bb"), 77: ("c", None)}
    engine.compact(U)
    assert len(engine._tables()["t_user"].parts) == 1 and len(engine.fetch(s.select().from_(U), User)) == 3


def test_migration(engine):
    @dataclass
    class User2:
        id: int = column("f_id,autoincrement", default=0)
        name: str = column("f_name,deprecated=real_name", default="")
        real_name: str = column("f_real_name,size=40", default="")
        age: codecs.Int32 = column("f_age,default=7", default=0)
        nick: str = column("f_nick,deprecated", default="")

        __tablename__ = "t_user"
        primary_key = ("id",)

    engine.insert(User(name="a"))
    new = Database("test").register(User2)
    planned = [str(c) for c in migrate(engine, new, dry_run=True)]
    assert "RENAME COLUMN t_user f_name TO f_real_name;" in planned and "DROP COLUMN t_user f_nick;" in planned
    assert any(p.startswith("ADD COLUMN t_user f_age") for p in planned) and "f_nick" in engine.frame("t_user").columns
    migrate(engine, new)
    row = engine.frame("t_user").first()
    assert (row["f_real_name"], row["f_age"], row["f_gender"]) == ("a", 7, 0)  # undeclared columns stay
    assert migrate(engine, new, dry_run=True) == []


def test_enums_and_relations(engine):
    assert sorted(r["f_key"] for r in engine.frame("t_sql_meta_enum").collect()) == ["FEMALE", "MALE"]
    er = entity_relations(engine.database)["tables"]["t_user"]["columns"]
    assert er["f_gender"]["enum"]["MALE"] == 2 and er["f_nick"]["references"] == ["t_user", "f_id"]
    json.dumps(er)


def test_repository(engine):
    repo = Repository(engine, User, now=lambda: 1000)
    made = repo.create(User(name="a"))
    assert made.id == 1 and repo.fetch_by_name("a").created_at == 1000
    repo.create(User(name="b"))
    repo.update_by_id_with_map(1, {"nick": "x"})
    assert repo.fetch_by_id(1).nick == "x" and repo.fetch_by_id(1).updated_at == 1000
    with pytest.raises(NotFoundError):
        repo.update_by_id_with_map(77, {"nick": "x"})
    assert repo.count() == 2 and [u.name for u in repo.list(U.f("nick").eq("x"))] == ["a"]
    assert repo.batch_fetch_by_name_list([]) == [] and len(repo.batch_fetch_by_name_list(["a", "b"])) == 2
    repo.soft_delete_by_id(1)
    assert repo.count() == 1
    with pytest.raises(NotFoundError):
        repo.fetch_by_id(1)
    repo.delete_by_name("b")
    assert repo.count() == 0
    with pytest.raises(ValueError, match="indexed"):
        repo.condition_by_struct(User(gender=Gender.MALE))
    assert repo.primary_key == ["id", "deleted_at"] and "name" in repo.index_field_names


def test_errors():
    mine = KeyError("mine")
    try:
        try:
            raise NotFoundError("x")
        except NotFoundError as e:
            raise RuntimeError("outer") from e
    except RuntimeError as e:
        assert ErrorMap(e).with_not_found(mine).err() is mine and ErrorMap(e).with_conflict(mine).err() is e
    assert ErrorMap(None).err() is None


def test_codecs(spark):
    row = spark.range(1).select(
        codecs.timestamp_text(F.lit(0)).alias("a"), codecs.timestamp_write(F.lit("1960-01-01")).alias("b"), codecs.tristate_read(F.lit(0)).alias("c"),
        codecs.json_read(F.lit(""), "k int").alias("d"), codecs.json_write(F.lit(None).cast("struct<k:int>")).alias("e"),
    ).first()
    assert tuple(row) == ("1970-01-01T08:00:00+08:00", 0, None, None, "")


VALUES = st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=0, max_size=6)


@settings(max_examples=8, deadline=None)
@given(VALUES, VALUES)
def test_three_valued_logic(spark, left, right):
    """Predicates and set operations on columns with nulls, against Python."""
    a = spark.createDataFrame([(x,) for x in left], "x int")
    b = spark.createDataFrame([(x,) for x in right], "x int")
    e = Engine(spark, sources={"a": a, "b": b})
    x = n.col("x")
    got = sorted(r[0] for r in e.query(s.select(n.cols("x")).from_("a", s.where(n.xor(x.gt(0), x.lt(2))))).collect())
    assert got == sorted(v for v in left if v is not None and (v > 0) != (v < 2))
    got = [r[0] for r in e.query(s.select(n.cols("x")).from_("a", s.where(x.not_in(s.select(n.cols("x")).from_("b"))))).collect()]
    want = left if not right else [] if None in right else [v for v in left if v is not None and v not in right]
    assert sorted(map(str, got)) == sorted(map(str, want))
    both = e.query(s.select(n.cols("x")).from_("a", s.intersect().distinct(s.select(n.cols("x")).from_("b"))))
    assert {r[0] for r in both.collect()} == set(left) & set(right)


def test_plans(spark, sf):
    """Filters and columns reach the scan; top-k needs no full sort."""
    from quillon import registry

    e = registry.engine(spark, sf)
    text = e.query(s.select(n.cols("o_orderkey")).from_("orders", s.where(n.col("o_orderstatus").eq("F"))))._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text
    assert "TakeOrderedAndProject" in e.query(registry.PLAIN["topk"][0]())._jdf.queryExecution().toString()
