import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import ExpressionError, compile_expression, derive, parse_parent_ref


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 7, -3, "x", dt.date(2024, 1, 5)), (2, None, 0, None, None), (3, 0, 4, "", dt.date(2024, 3, 1))], "id int, a int, b int, s string, d date")


CASES = [
    ("a + b", [4.0, None, 4.0]),
    ("a / b", [7 / -3, None, 0.0]),
    ("a // b", [-3.0, None, 0.0]),
    ("b % 2", [1.0, 0.0, 0.0]),
    ("a % b", [-2.0, None, 0.0]),
    ("1 if not a else 0", [0.0, 1.0, 1.0]),
    ("1 if a or a + 1 > 0 else 0", [1.0, None, 1.0]),
    ("1 if b == 0 or a + 1 > 0 else 0", [1.0, 1.0, 1.0]),
    ("1 if a is None else 2", [2.0, 1.0, 2.0]),
    ("1 if 0 < b < 5 else 0", [0.0, 0.0, 1.0]),
    ("coalesce(a, -1)", [7.0, -1.0, 0.0]),
    ("min(a, b)", [-3.0, None, 0.0]),
    ("max(a, 1)", [7.0, None, 1.0]),
    ("abs(b)", [3.0, 0.0, 4.0]),
    ("round(2.5) + round(3.5)", [6.0, 6.0, 6.0]),
    ("days_between(d, '2024-02-01')", [27.0, None, -29.0]),
    ("1 if d >= '2024-02-01' else 0", [0.0, 0.0, 1.0]),
    ("1 if s == 'x' else 0", [1.0, 0.0, 0.0]),
    ("1 if a != None else 0", [0.0, 0.0, 0.0]),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_values(rows, source, want):
    got = [r["derived"] for r in derive(rows, source).orderBy("id").collect()]
    assert [None if x is None else float(x) for x in got] == pytest.approx(want)


@pytest.mark.parametrize("source", ["a in (1, 2)", "a[0]", "lambda: 1", "[x for x in a]", "a.b", "open('x')", "a is 3", "1 +", "b'x'"])
def test_rejected(source):
    with pytest.raises(ExpressionError):
        compile_expression(source)


def test_unknown_names(rows):
    for source in ("zz + 1", "parent(a).x"):
        with pytest.raises(ExpressionError):
            derive(rows, source)


def test_parent(spark, rows):
    parent = spark.createDataFrame([(7, 2.5)], "k int, price double")
    out = derive(rows, "b * parent(a).price", {"a": (parent, "k")})
    assert [r["derived"] for r in out.orderBy("id").collect()] == [-7.5, None, None]
    c = compile_expression("b * parent(a).price + random()")
    assert c.dependencies == ("b", "a") and c.uses_random and parse_parent_ref("parent(a).x") == parse_parent_ref("a.x") == ("a", "x")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-20, 20)), st.one_of(st.none(), st.integers(-20, 20))), min_size=1, max_size=12))
def test_against_python(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a int, b int")
    got = derive(df, "a // b if a > b else (b - a) % 7").orderBy("i").collect()
    for (a, b), r in zip(pairs, got, strict=True):
        if a is None or b is None:
            want = None
        elif a > b:
            want = None if b == 0 else a // b
        else:
            want = (b - a) % 7
        assert r["derived"] == want


def test_value_of_and_or_is_the_operand_that_decides(spark):
    rows = [(1, 0, 7, "", "x"), (2, 3, 0, "y", ""), (3, None, 5, None, "z"), (4, 0, 0, "", "")]
    df = spark.createDataFrame(rows, "id int, a int, b int, s string, t string")

    def got(expression):
        return [r["derived"] for r in derive(df, expression).orderBy("id").collect()]

    assert got("a or b") == [7, 3, 5, 0] and got("a and b") == [0, 0, None, 0]
    assert got("a or 5") == [5, 3, 5, 5] and got("a or b or 9") == [7, 3, 5, 9]
    assert got("s or t") == ["x", "y", "z", ""] and got("s and t") == ["", "", None, ""]
    assert got("(a or b) + 1") == [8, 4, 6, 1] and got("1 if a or b else 0") == [1, 1, 1, 0]
    assert got("1 if a or s else 0") == [0, 1, 0, 0]  # of different kinds: only whether it holds
