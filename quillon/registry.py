"""The engine's published queries, one for each operator, and their SQL.

Every query runs over whole tables.  A query is a statement built from nodes
and run by the engine; those on changes build a store, change it and return
the table's state.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import registry_store
from .functions import types as codecs
from .operators.engine import Engine, Tasks
from .operators.migrate import migrate, one
from .operators.repository import Repository
from .plans import nodes as n, statements as s
from .sources.database import Database
from .sources.model import Columns, ColumnDef, Table, column, columns_by_struct, table_of
from .sources.store import scratch_root

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, Database("bench"), None, {t: f"{sf_dir}/{t}.parquet" for t in NAMES})


def c(name: str) -> n.Col:
    """A column of the driver's tables, qualified by its prefix's table."""
    table = {"r": "region", "n": "nation", "c": "customer", "s": "supplier", "p": "part", "o": "orders", "l": "lineitem"}.get(name.split("_")[0])
    return n.col(name, table if name[1:2] == "_" else None)


def a(*items: Any) -> n.Expr:
    return n.auto_alias(*items)


@dataclass
class Nation:
    n_nationkey: int = column("n_nationkey")
    n_name: str = column("n_name")
    __tablename__ = "nation"


@dataclass
class Customer:
    c_custkey: int = column("c_custkey")
    c_name: str = column("c_name")
    __tablename__ = "customer"


@dataclass
class CustomerNation:
    customer: Customer
    nation: Nation


@dataclass
class Account:
    """Customers as a table of their own."""

    c_custkey: int = column("c_custkey", default=0)
    c_name: str = column("c_name,size=128", default="")
    c_nationkey: codecs.Int32 = column("c_nationkey", default=0)
    c_acctbal: float = column("c_acctbal", default=0.0)
    c_mktsegment: str = column("c_mktsegment,size=64,default='NONE'", default="")
    f_deleted_at: int = column("f_deleted_at,default=0", default=0)

    __tablename__ = "account"
    primary_key = ("c_custkey",)
    indexes = ("unique_index i_name c_name", "index i_segment/BTREE c_mktsegment")


ACCOUNT = table_of(Account)
CORE = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def accounts(spark: SparkSession, sf_dir: str) -> Engine:
    """A store that holds all customers."""
    out = Engine(spark, Database("bench").register(Account), scratch_root(spark), {t: f"{sf_dir}/{t}.parquet" for t in NAMES})
    migrate(out)
    out.execute(s.insert().into(ACCOUNT).values(ACCOUNT.cols(*CORE), s.select(n.cols(*CORE)).from_("customer")))
    return out


def state(e: Engine) -> DataFrame:
    return e.query(s.select(n.cols(*CORE)).from_(ACCOUNT))


def _flagship() -> n.Expr:
    kept = n.and_(c("o_orderstatus").eq("F"), c("l_discount").between(0.02, 0.05))
    return s.select(a(c("l_returnflag"), n.count().alias("n"), n.func("ROUND", n.sum_(c("l_quantity")), 2).alias("q"))).from_(
        "lineitem", s.join("orders").on_(c("l_orderkey").eq(c("o_orderkey"))), s.where(kept),
        s.group_by(c("l_returnflag")).having(n.Condition(n.expr("COUNT(1) > ?", 10))), s.order_by(n.asc(c("l_returnflag"))),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query(_flagship())


def _group(name: str) -> Table:
    columns = [ColumnDef("c_custkey", "c_custkey", int), ColumnDef("c_parent", "c_parent", int), ColumnDef("depth", "depth", codecs.Int32)]
    return Table(name, Columns(columns))


def _tree(levels: int | None = None) -> n.Expr:
    """Customers below customer 1 when a tenth of the key is the parent."""
    parent = n.expr("CAST(FLOOR(`customer`.`c_custkey` / 10) AS BIGINT)")

    def build(t: Table) -> n.Expr:
        start = s.select(a(c("c_custkey"), parent.alias("c_parent"), n.expr("0").alias("depth"))).from_("customer", s.where(c("c_custkey").eq(1)))
        step = s.select(a(c("c_custkey"), parent.alias("c_parent"), n.expr("? + 1", t.col("depth").full()).alias("depth"))).from_(
            "customer", s.inner_join(t).on_(n.as_condition(n.expr("? = ?", parent, t.col("c_custkey").full()))),
            s.where(c("c_custkey").gt(1)),
        )
        return _with(start, s.union().all(step))

    return s.with_recursive(_group("tree"), build).max_levels(levels or 50).exec(lambda t: s.select(n.cols("c_custkey", "c_parent", "depth")).from_(t))


def _two(kind: Callable, mode: str) -> n.Expr:
    left = s.select(n.cols("c_nationkey")).from_("customer", s.where(n.col("c_acctbal").gt(9000)))
    right = s.select(n.cols("s_nationkey")).from_("supplier")
    return _with(left, getattr(kind(), mode)(right))


def _where(condition: n.Expr | None, table: str = "orders", projection: tuple = ("o_orderkey", "o_custkey", "o_orderstatus")) -> n.Expr:
    return s.select(n.cols(*projection)).from_(table, s.where(condition))


def _on_orders(sql: str) -> str:
    return f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE {sql}"


def _on_customer(kind: str) -> str:
    return f"SELECT c_custkey, o_orderkey FROM customer {kind} JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000"


def _joined(make: Callable) -> n.Expr:
    on = n.and_(c("c_custkey").eq(c("o_custkey")), c("o_totalprice").gt(200000))
    return s.select(a(c("c_custkey"), c("o_orderkey"))).from_("customer", make("orders").on_(on))


O = lambda name: n.col(name)  # noqa: E731, E741
ORDERED = {
    "eq": (O("o_orderstatus").eq("F"), "o_orderstatus = 'F'"),
    "neq": (O("o_orderstatus").neq("F"), "o_orderstatus <> 'F'"),
    "gt": (O("o_totalprice").gt(150000), "o_totalprice > 150000"),
    "gte": (O("o_custkey").gte(1000), "o_custkey >= 1000"),
    "lt": (O("o_orderdate").lt(datetime.datetime(1997, 1, 1)), "o_orderdate < TIMESTAMP '1997-01-01'"),
    "lte": (O("o_custkey").lte(100), "o_custkey <= 100"),
    "between": (O("o_totalprice").between(1000, 50000), "o_totalprice BETWEEN 1000 AND 50000"),
    "not_between": (O("o_totalprice").not_between(1000, 50000), "o_totalprice NOT BETWEEN 1000 AND 50000"),
    "in_list": (O("o_custkey").in_(1, 2, 3, 5, 8), "o_custkey IN (1, 2, 3, 5, 8)"),
    "in_slice": (O("o_orderstatus").in_(["F", "P"]), "o_orderstatus IN ('F', 'P')"),
    "in_empty_slice": (O("o_custkey").in_([]), "FALSE"),
    "in_no_args": (O("o_custkey").in_(), "TRUE"),
    "not_in": (O("o_custkey").not_in(1, 2, 3), "o_custkey NOT IN (1, 2, 3)"),
    "like": (O("o_orderpriority").like("-"), "o_orderpriority LIKE '%-%'"),
    "left_like": (O("o_orderpriority").left_like("T"), "o_orderpriority LIKE '%T'"),
    "right_like": (O("o_orderpriority").right_like("1"), "o_orderpriority LIKE '1%'"),
    "not_like": (O("o_orderpriority").not_like("URG"), "o_orderpriority NOT LIKE '%URG%'"),
    "is_null": (O("o_custkey").is_null(), "o_custkey IS NULL"),
    "is_not_null": (O("o_custkey").is_not_null(), "o_custkey IS NOT NULL"),
    "and_": (n.and_(O("o_orderstatus").eq("F"), O("o_custkey").lt(500)), "o_orderstatus = 'F' AND o_custkey < 500"),
    "or_": (n.or_(O("o_orderstatus").eq("F"), O("o_custkey").lt(500)), "o_orderstatus = 'F' OR o_custkey < 500"),
    "xor": (n.xor(O("o_orderstatus").eq("F"), O("o_custkey").lt(500)), "(o_orderstatus = 'F') <> (o_custkey < 500)"),
    "nil_pruning": (n.and_(None, n.empty_condition(), O("o_custkey").in_(), O("o_custkey").eq(7)), "o_custkey = 7"),
    "col_eq_col": (O("o_orderkey").gt(O("o_custkey")), "o_orderkey > o_custkey"),
    "as_cond": (n.as_condition(n.expr("`o_custkey` % ? = ?", 7, 3)), "o_custkey % 7 = 3"),
}

PLAIN: dict[str, tuple[Callable[[], n.Expr], str]] = {
    "flagship": (
        _flagship,
        "SELECT l_returnflag, COUNT(1) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_discount BETWEEN 0.02 AND 0.05 GROUP BY l_returnflag HAVING COUNT(1) > 10",
    ),
    "select_star": (lambda: s.select().from_("nation"), "SELECT * FROM nation"),
    "select_cols": (lambda: s.select(n.cols("c_custkey", "c_name")).from_("customer"), "SELECT c_custkey, c_name FROM customer"),
    "select_distinct": (lambda: s.select(n.cols("o_orderstatus", "o_orderpriority"), "DISTINCT").from_("orders"), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "select_no_from": (lambda: s.select(a(n.expr("? + ?", 1, 2).alias("x"), n.expr("?", "it's").alias("y"))), "SELECT 3 AS x, 'it''s' AS y"),
    "alias": (lambda: s.select(n.alias(n.col("n_name"), "name")).from_("nation"), "SELECT n_name AS name FROM nation"),
    "multi_auto_alias": (
        lambda: s.select(a(c("n_name"), c("r_name"))).from_("nation", s.inner_join("region").on_(c("n_regionkey").eq(c("r_regionkey")))),
        "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "columns_by_struct": (
        lambda: s.select(_struct()).from_("customer", s.left_join("nation").on_(n.col("c_nationkey", "customer").eq(n.col("n_nationkey", "nation")))),
        "SELECT c_custkey AS customer__c_custkey, c_name AS customer__c_name, n_nationkey AS nation__n_nationkey, n_name AS nation__n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    ),
    "raw_expr": (
        lambda: s.select(a(n.col("c_custkey"), n.expr("upper(`c_name`)").alias("u"), n.exactly("substr(c_name, 1, 3)").alias("short"))).from_("customer"),
        "SELECT c_custkey, upper(c_name) AS u, substr(c_name, 1, 3) AS short FROM customer",
    ),
    "column_template": (lambda: s.select(a(n.col("c_custkey"), n.col("c_acctbal").expr("ROUND(# * ?, 2)", 3).alias("x"))).from_("customer"), "SELECT c_custkey, ROUND(c_acctbal * 3, 2) AS x FROM customer"),
    "table_template": (
        lambda: s.select(a(n.col("c_custkey"), ACCOUNT.expr("concat(#c_name, ?, #c_mktsegment)", "/").alias("x"))).from_("customer"),
        "SELECT c_custkey, c_name || '/' || c_mktsegment AS x FROM customer",
    ),
    "deferred_expr": (lambda: s.select(a(n.col("p_partkey"), n.Deferred(lambda scope: n.col("p_size").incr(1)).alias("x"))).from_("part"), "SELECT p_partkey, p_size + 1 AS x FROM part"),
    "with_comment": (lambda: s.select(n.cols("r_name")).from_("region", s.comment("all regions"), s.for_update()), "SELECT r_name FROM region"),
    "incr_dec": (lambda: s.select(a(n.col("p_partkey"), n.col("p_size").incr(5).alias("up"), n.col("p_size").dec(2).alias("down"))).from_("part"), "SELECT p_partkey, p_size + 5 AS up, p_size - 2 AS down FROM part"),
    "where_nil": (lambda: _where(None), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"),
    "join_on": (lambda: _joined(s.join), _on_customer("")),
    "join_inner": (lambda: _joined(s.inner_join), _on_customer("INNER")),
    "join_left": (lambda: _joined(s.left_join), _on_customer("LEFT")),
    "join_right": (lambda: _joined(s.right_join), _on_customer("RIGHT")),
    "join_full": (lambda: _joined(s.full_join), _on_customer("FULL")),
    "join_prefix": (lambda: _joined(lambda t: s.join(t, "LEFT", "OUTER")), _on_customer("LEFT OUTER")),
    "join_cross": (lambda: s.select(a(n.col("n_name"), n.col("r_name"))).from_("nation", s.cross_join("region")), "SELECT n_name, r_name FROM nation CROSS JOIN region"),
    "join_using": (
        lambda: s.select(n.cols("user_id", "n")).from_("events", s.inner_join(n.Alias(s.select(a(n.col("user_id"), n.count().alias("n"))).from_("events", s.group_by(n.col("user_id"))), "per")).using_("user_id")),
        "SELECT user_id, n FROM events JOIN (SELECT user_id, COUNT(1) AS n FROM events GROUP BY user_id) per USING (user_id)",
    ),
    "join_natural": (
        lambda: s.select(n.cols("n_nationkey", "n_name")).from_("nation", s.join(n.Alias(s.select(n.cols("n_nationkey")).from_("nation", s.where(n.col("n_regionkey").eq(1))), "x"), "NATURAL")),
        "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1",
    ),
    "join_incomplete": (lambda: s.select(n.cols("n_name")).from_("nation", s.left_join("region")), "SELECT n_name FROM nation"),
    "join_theta": (
        lambda: s.select(a(n.col("n_name", "nation"), n.col("s_suppkey", "supplier"))).from_("nation", s.inner_join("supplier").on_(n.and_(n.col("s_nationkey", "supplier").gt(n.col("n_nationkey", "nation")), n.col("n_regionkey", "nation").eq(2)))),
        "SELECT n_name, s_suppkey FROM nation JOIN supplier ON s_nationkey > n_nationkey AND n_regionkey = 2",
    ),
    "join_multi": (
        lambda: s.select(a(c("o_orderkey"), c("c_name"), c("n_name"), c("r_name"))).from_(
            "orders", s.inner_join("customer").on_(c("o_custkey").eq(c("c_custkey"))), s.inner_join("nation").on_(c("c_nationkey").eq(c("n_nationkey"))),
            s.left_join("region").on_(c("n_regionkey").eq(c("r_regionkey"))), s.where(c("o_orderstatus").eq("P")),
        ),
        "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P'",
    ),
    "join_self": (
        lambda: s.select(a(c("n_name").full().alias("a"), n.col("n_name", "x").full().alias("b"))).from_("nation", s.inner_join(n.Alias(_Named("nation"), "x")).on_(n.and_(n.col("n_regionkey", "nation").eq(n.col("n_regionkey", "x")), n.col("n_nationkey", "nation").lt(n.col("n_nationkey", "x"))))),
        "SELECT nation.n_name AS a, x.n_name AS b FROM nation JOIN nation x ON nation.n_regionkey = x.n_regionkey AND nation.n_nationkey < x.n_nationkey",
    ),
    "group_by": (
        lambda: s.select(a(n.col("l_returnflag"), n.col("l_linestatus"), n.count().alias("n"), n.func("ROUND", n.sum_(n.col("l_extendedprice")), 2).alias("total"))).from_("lineitem", s.group_by(n.col("l_returnflag"), n.col("l_linestatus"))),
        "SELECT l_returnflag, l_linestatus, COUNT(1) AS n, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1, 2",
    ),
    "having": (
        lambda: s.select(a(n.col("o_custkey"), n.count().alias("n"))).from_("orders", s.group_by(n.col("o_custkey")).having(n.as_condition(n.expr("COUNT(1) > ?", 12)))),
        "SELECT o_custkey, COUNT(1) AS n FROM orders GROUP BY o_custkey HAVING COUNT(1) > 12",
    ),
    "count": (lambda: s.select(n.count().alias("n")).from_("lineitem"), "SELECT COUNT(1) AS n FROM lineitem"),
    "count_col": (lambda: s.select(n.count(n.col("o_custkey")).alias("n")).from_("orders"), "SELECT COUNT(o_custkey) AS n FROM orders"),
    "count_distinct": (lambda: s.select(n.count(n.distinct(n.col("l_partkey"))).alias("n")).from_("lineitem"), "SELECT COUNT(DISTINCT l_partkey) AS n FROM lineitem"),
    "avg": (lambda: s.select(n.func("ROUND", n.avg(n.col("c_acctbal")), 2).alias("x")).from_("customer"), "SELECT ROUND(AVG(c_acctbal), 2) AS x FROM customer"),
    "sum": (lambda: s.select(n.sum_(n.col("p_size")).alias("x")).from_("part"), "SELECT CAST(SUM(p_size) AS BIGINT) AS x FROM part"),
    "min": (lambda: s.select(n.min_(n.col("o_orderdate")).alias("x")).from_("orders"), "SELECT MIN(o_orderdate) AS x FROM orders"),
    "max": (lambda: s.select(n.max_(n.col("o_totalprice")).alias("x")).from_("orders"), "SELECT MAX(o_totalprice) AS x FROM orders"),
    "first": (lambda: s.select(a(n.col("o_custkey"), n.first(n.col("o_orderkey"), n.col("o_orderkey")).alias("x"))).from_("orders", s.group_by(n.col("o_custkey"))), "SELECT o_custkey, MIN_BY(o_orderkey, o_orderkey) AS x FROM orders GROUP BY o_custkey"),
    "last": (lambda: s.select(a(n.col("o_custkey"), n.last(n.col("o_orderkey"), n.col("o_orderkey")).alias("x"))).from_("orders", s.group_by(n.col("o_custkey"))), "SELECT o_custkey, MAX_BY(o_orderkey, o_orderkey) AS x FROM orders GROUP BY o_custkey"),
    "distinct_fn": (lambda: s.select(n.distinct(n.col("c_mktsegment"))).from_("customer"), "SELECT DISTINCT c_mktsegment FROM customer"),
    "func": (lambda: s.select(a(n.col("p_partkey"), n.func("length", n.col("p_name")).alias("x"))).from_("part"), "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS x FROM part"),
    "func_star": (lambda: s.select(n.func("COUNT").alias("n")).from_("part"), "SELECT COUNT(*) AS n FROM part"),
    "group_by_sorted": (lambda: s.select(a(n.col("c_mktsegment"), n.count().alias("n"))).from_("customer", s.group_by(n.desc(n.col("c_mktsegment")))), "SELECT c_mktsegment, COUNT(1) AS n FROM customer GROUP BY 1"),
    "global_agg": (lambda: s.select(a(n.count().alias("n"), n.max_(n.col("l_quantity")).alias("top"))).from_("lineitem", s.where(n.col("l_returnflag").eq("R"))), "SELECT COUNT(1) AS n, MAX(l_quantity) AS top FROM lineitem WHERE l_returnflag = 'R'"),
    "order_asc": (lambda: s.select(n.cols("s_suppkey")).from_("supplier", s.order_by(n.asc(n.col("s_suppkey")), None)), "SELECT s_suppkey FROM supplier"),
    "order_desc": (lambda: s.select(n.cols("s_suppkey")).from_("supplier", s.order_by(n.desc(n.col("s_acctbal"), "last"), n.asc(n.col("s_suppkey"))), s.limit(20)), "SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20"),
    "order_expr": (lambda: s.select(n.cols("p_partkey")).from_("part", s.order_by(n.asc(n.expr("`p_partkey` % ?", 10)), n.desc(n.col("p_partkey"))), s.limit(30)), "SELECT p_partkey FROM part ORDER BY p_partkey % 10, p_partkey DESC LIMIT 30"),
    "limit": (lambda: s.select(n.cols("c_custkey")).from_("customer", s.order_by(n.asc(n.col("c_custkey"))), s.limit(10)), "SELECT c_custkey FROM customer ORDER BY 1 LIMIT 10"),
    "limit_zero": (lambda: s.select(n.cols("c_custkey")).from_("customer", s.limit(0)), "SELECT c_custkey FROM customer"),
    "limit_offset": (lambda: s.select(n.cols("c_custkey")).from_("customer", s.order_by(n.asc(n.col("c_custkey"))), s.limit(10).offset(5)), "SELECT c_custkey FROM customer ORDER BY 1 LIMIT 10 OFFSET 5"),
    "topk": (lambda: s.select(n.cols("o_orderkey", "o_totalprice")).from_("orders", s.order_by(n.desc(n.col("o_totalprice")), n.asc(n.col("o_orderkey"))), s.limit(25)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "union_order_limit": (
        lambda: _with(_two(s.union, "distinct"), s.order_by(n.desc(n.col("c_nationkey"))), s.limit(5)),
        "SELECT * FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier) ORDER BY 1 DESC LIMIT 5",
    ),
    "in_subquery": (lambda: _where(O("o_custkey").in_(s.select(n.cols("c_custkey")).from_("customer", s.where(n.col("c_acctbal").lt(0))))), _on_orders("o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")),
    "not_in_subquery": (lambda: _where(O("o_custkey").not_in(s.select(n.cols("c_custkey")).from_("customer", s.where(n.col("c_acctbal").gt(0))))), _on_orders("o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")),
    "exists": (
        lambda: s.select(n.cols("o_orderkey")).from_("orders", s.where(n.as_condition(n.expr("NOT EXISTS (?)", s.select(n.expr("1")).from_("lineitem", s.where(n.as_condition(n.expr("l_orderkey = orders.o_orderkey")))))))),
        "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    ),
    "scalar_subquery": (lambda: _where(O("o_totalprice").eq(s.select(n.max_(n.col("o_totalprice"))).from_("orders"))), _on_orders("o_totalprice = (SELECT MAX(o_totalprice) FROM orders)")),
    "with_simple": (
        lambda: s.with_(_rich("rich"), lambda t: s.select(n.cols("c_custkey", "c_nationkey")).from_("customer", s.where(n.col("c_acctbal").gt(9000)))).exec(lambda t: s.select(n.cols("k", "nation")).from_(t)),
        "SELECT c_custkey AS k, c_nationkey AS nation FROM customer WHERE c_acctbal > 9000",
    ),
    "with_chain": (
        lambda: s.with_(_rich("rich"), lambda t: s.select(n.cols("c_custkey", "c_nationkey")).from_("customer", s.where(n.col("c_acctbal").gt(9000))))
        .with_(_rich("few"), lambda t: s.select(n.cols("k", "nation")).from_(_rich("rich"), s.where(n.col("nation").lt(5))))
        .exec(lambda rich, few: s.select(a(n.col("nation"), n.count().alias("n"))).from_(few, s.group_by(n.col("nation")))),
        "SELECT c_nationkey AS nation, COUNT(1) AS n FROM customer WHERE c_acctbal > 9000 AND c_nationkey < 5 GROUP BY 1",
    ),
    "with_recursive": (
        _tree,
        "WITH RECURSIVE tree (c_custkey, c_parent, depth) AS (SELECT c_custkey, CAST(c_custkey // 10 AS BIGINT), 0 FROM customer WHERE c_custkey = 1 UNION ALL SELECT customer.c_custkey, CAST(customer.c_custkey // 10 AS BIGINT), depth + 1 FROM customer JOIN tree ON customer.c_custkey // 10 = tree.c_custkey WHERE customer.c_custkey > 1) SELECT * FROM tree",
    ),
    "with_nested": (
        lambda: s.with_(_rich("outer_part"), lambda t: s.with_(_rich("inner_part"), lambda u: s.select(n.cols("c_custkey", "c_nationkey")).from_("customer")).exec(lambda u: s.select(n.cols("k", "nation")).from_(u, s.where(n.col("nation").eq(3))))).exec(lambda t: s.select(n.count().alias("n")).from_(t)),
        "SELECT COUNT(1) AS n FROM customer WHERE c_nationkey = 3",
    ),
}
PLAIN |= {k: (lambda cond=cond: _where(cond), _on_orders(text)) for k, (cond, text) in ORDERED.items()}
for _word, _kind in (("union", s.union), ("intersect", s.intersect), ("except", s.except_)):
    for _mode in ("all", "distinct"):
        _sql = f"SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 {_word.upper()}{' ALL' if _mode == 'all' else ''} SELECT s_nationkey AS c_nationkey FROM supplier"
        PLAIN[f"{_word}_{_mode}"] = (lambda kind=_kind, mode=_mode: _two(kind, mode), _sql)


class _Named(n.Expr):
    """A table by name where an aliased node is wanted."""

    def __init__(self, name: str):
        self.name = name

    def sql(self, scope: n.Scope) -> str:
        return scope.table(self.name)


def _rich(name: str) -> Table:
    return Table(name, Columns([ColumnDef("k", "k", int), ColumnDef("nation", "nation", int)]))


def _with(node: s.Select, *additions: Any) -> s.Select:
    return replace(node, additions=(*node.additions, *additions))


def _struct() -> n.Expr:
    return columns_by_struct(CustomerNation)


BASE = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
NEW = "SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM (VALUES (900000001, 'new one', 1, 1.5, 'NONE'), (900000002, 'new two', 2, 2.5, 'TOYS')) v(c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)"
KEYS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
ROWS = (900000001, "new one", 1, 1.5, "NONE", 900000002, "new two", 2, 2.5, "TOYS")
#: A row whose key is taken by customer 1, and a free one.
CLASH = (1, "other", 3, 7.5, "TOYS", 900000001, "new one", 1, 1.5, "NONE")


def _values(node: s.Insert, rows: tuple = ROWS) -> s.Insert:
    return node.values(ACCOUNT.cols(*KEYS), *rows)


def _changed(*changes: Callable[[Engine], Any]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = accounts(spark, sf_dir)
        for change in changes:
            change(e)
        return state(e)

    return run


def _returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = accounts(spark, sf_dir)
    node = s.update(ACCOUNT).set(ACCOUNT.col("c_acctbal").value_by(0)).where(ACCOUNT.col("c_nationkey").eq(3), s.returning(ACCOUNT.cols("c_custkey", "c_acctbal")))
    return e.execute(node)


def _soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = accounts(spark, sf_dir)
    e.execute(s.update(ACCOUNT).set(ACCOUNT.col("f_deleted_at").value_by(1700000000)).where(ACCOUNT.col("c_mktsegment").eq("BUILDING")))
    return e.query(s.select(n.cols(*CORE)).from_(ACCOUNT, s.where(ACCOUNT.col("f_deleted_at").eq(0))))


def _rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task list whose last step fails leaves no trace."""
    e = accounts(spark, sf_dir)

    def fail(_: Engine) -> None:
        raise ValueError("stop")

    try:
        Tasks(e).with_(lambda x: x.execute(s.delete().from_(ACCOUNT)), fail).do()
    except ValueError:
        pass
    return state(e)


def _migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename, add and drop columns of a filled table."""
    e = accounts(spark, sf_dir)
    one(e, "rename column", ACCOUNT, name="c_name", to="c_title")
    one(e, "drop column", ACCOUNT, name="c_acctbal")
    return e.query(s.select(n.cols("c_custkey", "c_title", "c_nationkey")).from_(ACCOUNT))


def _repo(run: Callable[[Repository], Any], schema: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(run(Repository(accounts(spark, sf_dir), Account)), schema)

    return query


def _row(m: Account) -> tuple:
    return m.c_custkey, m.c_name, m.c_nationkey, float(m.c_acctbal), m.c_mktsegment


ROW = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _codec(table: str, *columns: Any) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).frame(table).select(*(x() if callable(x) else x for x in columns))


CHANGES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "insert_values": (_changed(lambda e: e.execute(_values(s.insert().into(ACCOUNT), ROWS[:5]))), f"{BASE} UNION ALL {NEW} WHERE c_custkey = 900000001"),
    "insert_multi": (_changed(lambda e: e.execute(_values(s.insert().into(ACCOUNT)))), f"{BASE} UNION ALL {NEW}"),
    "insert_default": (
        _changed(lambda e: e.execute(s.insert().into(ACCOUNT).values(ACCOUNT.cols("c_custkey", "c_name", "c_nationkey", "c_acctbal"), *ROWS[:4]))),
        f"{BASE} UNION ALL {NEW} WHERE c_custkey = 900000001",
    ),
    "insert_select": (
        _changed(lambda e: e.execute(s.insert().into(ACCOUNT).values(ACCOUNT.cols(*KEYS), s.select(a(n.col("s_suppkey").incr(800000000), n.col("s_name"), n.col("s_nationkey"), n.col("s_acctbal"), n.expr("?", "SUPPLY"))).from_("supplier")))),
        f"{BASE} UNION ALL SELECT s_suppkey + 800000000, s_name, s_nationkey, s_acctbal, 'SUPPLY' FROM supplier",
    ),
    "insert_ignore": (_changed(lambda e: e.execute(_values(s.insert("IGNORE").into(ACCOUNT), CLASH))), f"{BASE} UNION ALL {NEW} WHERE c_custkey = 900000001"),
    "upsert_nothing": (_changed(lambda e: e.execute(_values(s.insert().into(ACCOUNT, s.on_conflict("c_custkey").do_nothing()), CLASH))), f"{BASE} UNION ALL {NEW} WHERE c_custkey = 900000001"),
    "upsert_update": (
        _changed(lambda e: e.execute(_values(s.insert().into(ACCOUNT, s.on_conflict("c_custkey").do_update_set(ACCOUNT.col("c_mktsegment").value_by(n.col("c_mktsegment", "excluded").full()), ACCOUNT.col("c_acctbal").value_by(ACCOUNT.col("c_acctbal").incr(1)))), CLASH))),
        f"SELECT c_custkey, c_name, c_nationkey, IF(c_custkey = 1, c_acctbal + 1, c_acctbal) AS c_acctbal, IF(c_custkey = 1, 'TOYS', c_mktsegment) AS c_mktsegment FROM customer UNION ALL {NEW} WHERE c_custkey = 900000001",
    ),
    "upsert_duplicate_key": (
        _changed(lambda e: e.execute(_values(s.insert().into(ACCOUNT, s.on_duplicate_key_update(ACCOUNT.col("c_nationkey").value_by(9))), CLASH))),
        f"SELECT c_custkey, c_name, IF(c_custkey = 1, 9, c_nationkey) AS c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL {NEW} WHERE c_custkey = 900000001",
    ),
    "update": (
        _changed(lambda e: e.execute(s.update(ACCOUNT).set(ACCOUNT.col("c_mktsegment").value_by("POOR")).where(ACCOUNT.col("c_acctbal").lt(0)))),
        "SELECT c_custkey, c_name, c_nationkey, c_acctbal, IF(c_acctbal < 0, 'POOR', c_mktsegment) AS c_mktsegment FROM customer",
    ),
    "update_incr": (
        _changed(lambda e: e.execute(s.update(ACCOUNT).set(ACCOUNT.col("c_nationkey").value_by(ACCOUNT.col("c_nationkey").incr(100)), ACCOUNT.col("c_acctbal").value_by(n.expr("ROUND(`c_acctbal`, 0)"))).where(ACCOUNT.col("c_nationkey").gt(10)))),
        "SELECT c_custkey, c_name, IF(c_nationkey > 10, c_nationkey + 100, c_nationkey) AS c_nationkey, IF(c_nationkey > 10, ROUND(c_acctbal, 0), c_acctbal) AS c_acctbal, c_mktsegment FROM customer",
    ),
    "delete": (_changed(lambda e: e.execute(s.delete().from_(ACCOUNT, s.where(ACCOUNT.col("c_mktsegment").eq("BUILDING"))))), f"{BASE} WHERE c_mktsegment <> 'BUILDING'"),
    "soft_delete": (_soft_delete, f"{BASE} WHERE c_mktsegment <> 'BUILDING'"),
    "returning": (_returning, "SELECT c_custkey, CAST(0 AS DOUBLE) AS c_acctbal FROM customer WHERE c_nationkey = 3"),
    "transaction_rollback": (_rolled_back, BASE),
    "migrate_columns": (_migrated, "SELECT c_custkey, c_name AS c_title, c_nationkey FROM customer"),
    "timestamp_codec": (
        _codec("orders", "o_orderkey", lambda: codecs.timestamp_write(F.col("o_orderdate")).alias("secs"), lambda: codecs.timestamp_text(codecs.timestamp_write(F.col("o_orderdate"))).alias("text")),
        "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS secs, strftime(o_orderdate + INTERVAL 8 HOURS, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS text FROM orders",
    ),
    "datetime_trunc": (_codec("events", "event_id", lambda: codecs.datetime_seconds(F.col("ts")).alias("ts")), "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM events"),
    "bool_codec": (
        _codec("orders", "o_orderkey", lambda: codecs.tristate_read((F.col("o_custkey") % 3).cast("int")).alias("b"), lambda: codecs.tristate_write(codecs.tristate_read((F.col("o_custkey") % 3).cast("int"))).alias("i")),
        "SELECT o_orderkey, CASE o_custkey % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS b, CAST(o_custkey % 3 AS INTEGER) AS i FROM orders",
    ),
    "json_codec": (_codec("events", "event_id", lambda: codecs.json_read(F.col("props"), "k long")["k"].alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "repo_count": (_repo(lambda r: [(r.count(r.table.col("c_nationkey").lt(10)),)], "n long"), "SELECT COUNT(1) AS n FROM customer WHERE c_nationkey < 10"),
    "repo_list": (
        _repo(lambda r: [_row(m) for m in r.list(r.table.col("c_acctbal").gt(9500), s.order_by(n.asc(n.col("c_custkey"))), s.limit(20))], ROW),
        f"{BASE} WHERE c_acctbal > 9500 ORDER BY c_custkey LIMIT 20",
    ),
    "repo_batch_fetch": (_repo(lambda r: [_row(m) for m in r.batch_fetch_by_c_custkey_list([1, 5, 77])], ROW), f"{BASE} WHERE c_custkey IN (1, 5, 77)"),
    "repo_fetch_by_key": (_repo(lambda r: [_row(r.fetch_by_c_custkey(42))], ROW), f"{BASE} WHERE c_custkey = 42"),
    "repo_condition_by_struct": (
        _repo(lambda r: [(r.count(r.condition_by_struct(Account(c_mktsegment="BUILDING", c_nationkey=4))),)], "n long"),
        "SELECT COUNT(1) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 4",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        k: lambda spark, sf_dir, make=make: engine(spark, sf_dir).query(make()) for k, (make, _) in PLAIN.items()
    }
    return out | {k: run for k, (run, _) in CHANGES.items()} | registry_store.queries()


def oracle_sql() -> dict[str, str]:
    return {k: text for k, (_, text) in {**PLAIN, **CHANGES}.items()} | registry_store.oracle_sql()
