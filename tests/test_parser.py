import pytest

from quarrysql.plans import nodes as n
from quarrysql.plans import parser as p
from quarrysql.plans.lexer import ParseError


def test_precedence_is_standard():
    assert p.parse("a or b and c") == n.Binary("or", n.Name("a"), n.Binary("and", n.Name("b"), n.Name("c")))
    assert p.parse("not x = 1") == n.Unary("not", n.Binary("=", n.Name("x"), n.Literal(1)))
    assert p.parse("1 + 2 * 3") == n.Binary("+", n.Literal(1), n.Binary("*", n.Literal(2), n.Literal(3)))


def test_legacy_precedence():
    assert p.parse("a or b and c", True) == n.Binary("and", n.Binary("or", n.Name("a"), n.Name("b")), n.Name("c"))
    assert p.parse("not x = 1", True) == n.Binary("=", n.Unary("not", n.Name("x")), n.Literal(1))


@pytest.mark.parametrize("text, want", [
    ("x is not null", n.Binary("is not", n.Name("x"), n.Literal(None))),
    ("x not in (1, 'a')", n.Unary("not", n.Binary("in", n.Name("x"), n.Tuple((n.Literal(1), n.Literal("a")))))),
    ("t.x between 1 and 2", n.Between(n.Name("t.x"), n.Literal(1), n.Literal(2))),
    ("x NOT LIKE '%a'", n.Unary("not", n.Binary("like", n.Name("x"), n.Literal("%a")))),
    ("count(distinct x)", n.Call("count", (n.Name("x"),), True)),
    ("count()", n.Call("count", ())),
    ("cast(x AS BIGINT)", n.Cast(n.Name("x"), "BIGINT")),
    ("props ->> 'k'", n.Binary("->>", n.Name("props"), n.Literal("k"))),
    ("$1 = ?0", n.Binary("=", n.Position(1), n.Parameter(0))),
    ("case when a then 1 else 2.5 end", n.Case(((n.Name("a"), n.Literal(1)),), n.Literal(2.5))),
    ("`odd name`", n.Name("odd name")),
    ("(1, 2)", n.Tuple((n.Literal(1), n.Literal(2)))),
    ("TRUE", n.Literal(True)),
])
def test_expressions(text, want):
    assert p.parse(text) == want


def test_statement():
    s = p.parse_statement("SELECT DISTINCT a x, t.* FROM t JOIN u ON t.i = u.i WHERE a > 1 GROUP BY x HAVING n > 2 ORDER BY x DESC, 3 LIMIT 5 OFFSET 2")
    assert s.distinct and s.items == (n.As(n.Name("a"), "x"), n.Star("t"))
    assert s.order == (n.Order(n.Name("x"), True), n.Order(n.Literal(3)))
    assert (s.limit, s.offset) == (n.Literal(5), n.Literal(2))


def test_order_belongs_to_the_union():
    u = p.parse_statement("select a from t union all select b from u order by a limit 1")
    assert isinstance(u, n.UnionAll) and u.limit == n.Literal(1) and u.right.limit is None
    u = p.parse_statement("select a from t union all (select b from u limit 1)")
    assert u.right.limit == n.Literal(1)


@pytest.mark.parametrize("text", ["select", "select a from", "select a b c from t", "select a from t where", "select a; drop", "select a union select b", "case 1 end"])
def test_errors(text):
    with pytest.raises(ParseError):
        p.parse_statement(text)


def test_nested_table_functions_need_parentheses():
    with pytest.raises(ValueError):
        p.parse_from("flatten(files('/a'), 'f')")
    assert p.parse_from("flatten((files('/a')), 'f')") == n.TableCall("flatten", (n.TableCall("files", (n.Literal("/a"),)), n.Literal("f")))
