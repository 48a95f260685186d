"""Nodes and statements render to the SQL that is meant."""

import datetime
import decimal

import pytest

from quillon.plans import nodes as n, statements as s
from quillon.plans.nodes import Scope

S = Scope()


@pytest.mark.parametrize(
    ("node", "text"),
    [
        (n.col("A").eq(1), "`a` = 1"),
        (n.col("a").in_([1, 2]), "`a` IN (1, 2)"),
        (n.col("a").in_([]), "FALSE"),
        (n.col("a").not_in([]), "TRUE"),
        (n.col("a").like("x"), "`a` LIKE '%x%'"),
        (n.col("a").left_like("x"), "`a` LIKE '%x'"),
        (n.col("a").right_like("x"), "`a` LIKE 'x%'"),
        (n.and_(n.col("a").eq(1), None, n.or_(n.col("b").eq(2), n.col("c").is_null())), "(`a` = 1) AND ((`b` = 2) OR (`c` IS NULL))"),
        (n.xor(n.col("a").eq(1), n.col("b").eq(2)), "(`a` = 1) <> (`b` = 2)"),
        (n.count(), "COUNT(1)"),
        (n.func("COUNT"), "COUNT(*)"),
        (n.count(n.distinct(n.col("a"))), "COUNT(DISTINCT `a`)"),
        (n.expr("'?' = ? AND `a?` = ?", "it's", b"\x01"), "'?' = 'it\\'s' AND `a?` = X'01'"),
        (n.col("a").expr("# + ? + #", 2), "`a` + 2 + `a`"),
        (n.col("d").eq(datetime.date(2020, 1, 2)), "`d` = DATE '2020-01-02'"),
        (n.col("d").eq(decimal.Decimal("1.50")), "`d` = 1.50BD"),
        (n.Deferred(lambda scope: n.col("x") if scope.qualify else None), ""),
        (n.multi_with("+", n.col("a"), None, n.col("b")), "`a` + `b`"),
    ],
)
def test_node(node, text):
    assert node.sql(S) == text


def test_nothing():
    assert n.col("a").in_() is None and n.col("a").not_in() is None
    assert n.and_(None, n.empty_condition()).is_nil
    assert s.where(None).is_nil and s.limit(0).is_nil and s.limit(-1).is_nil and s.group_by().is_nil
    with pytest.raises(ValueError, match="is_null"):
        n.col("a").eq(None)
    with pytest.raises(ValueError, match="name a column"):
        n.avg().sql(S)


def test_select():
    assert s.select().from_("t").sql(S) == "SELECT * FROM `t` AS `t`"
    node = s.select(n.auto_alias(n.col("a", "t"))).from_("t", s.limit(5).offset(2), s.where(n.col("a", "t").gt(1)), s.order_by(n.desc(n.col("a"))))
    assert node.sql(S) == "SELECT `a` FROM `t` AS `t` WHERE `a` > 1 ORDER BY (`a`) DESC LIMIT 5 OFFSET 2"
    joined = s.select(n.auto_alias(n.col("a", "t"))).from_("t", s.left_join("u").on_(n.col("a", "t").eq(n.col("b", "u"))))
    assert joined.sql(S) == "SELECT `t`.`a` AS `a` FROM `t` AS `t` LEFT JOIN `u` AS `u` ON `t`.`a` = `u`.`b`"
    with pytest.warns(UserWarning, match="dropped"):
        assert "JOIN" not in s.select().from_("t", s.left_join("u")).sql(S)
    with pytest.raises(ValueError, match="not both"):
        s.select().from_("t", s.join("u").on_(n.col("a").eq(1)).using_("a")).sql(S)


def test_rejected():
    with pytest.raises(ValueError, match="not selected"):
        s.select(n.cols("a"), "DISTINCT").from_("t", s.order_by(n.asc(n.col("b")))).sql(S)
    with pytest.raises(ValueError, match="whole set"):
        s.union().all(s.select().from_("t", s.limit(1)))
    with pytest.raises(TypeError):
        s.union().all(n.col("a"))
    with pytest.raises(ValueError, match="unknown modifier"):
        s.select(None, "FAST").from_("t").sql(S)
    with pytest.raises(ValueError, match="fill rows"):
        s.insert().into("t").values(n.cols("a", "b"), 1, 2, 3)
    with pytest.raises(ValueError, match="one name"):
        from quillon.registry import _rich

        s.with_(_rich("x"), lambda t: s.select()).with_(_rich("x"), lambda t: s.select()).exec(lambda a, b: s.select()).sql(S)
