"""Two-valued predicate semantics and literal rules."""

import datetime as dt

import pytest

from graphloom.errors import GraphError
from graphloom.functions.builder import all_of, any_of, prop
from graphloom.operators.physical import bool_filter
from graphloom.plans import predicates as pr

P = prop("a", "p")


@pytest.fixture(scope="module")
def rows(spark):
    """id 1: p = 5; 2: p missing; 3: p explicitly null; 4: p = 7."""
    return spark.createDataFrame(
        [(1, 5, 1.5, "x", ["p", "f", "s"]), (2, None, None, None, []), (3, None, None, None, ["p"]), (4, 7, 2.5, "y", ["p", "f", "s"])],
        "id long, p long, f double, s string, __keys array<string>",
    )


CASES = [
    (P == 5, {1}),
    (P == None, {2, 3}),  # noqa: E711
    (P != 5, {4}),
    (P != None, {1, 4}),  # noqa: E711
    (P < 6, {1}),
    (P <= 5, {1}),
    (P > 6, {4}),
    (P >= 5, {1, 4}),
    (P.between(5, 7), {1, 4}),
    (P.between(5, 7, (False, True)), {4}),
    (P.between(5, 7, (False, False)), set()),
    (P.is_in([5, None, 9]), {1}),
    (P.is_in(list(range(15))), {1, 4}),
    (P.exists(), {1, 3, 4}),
    (P.is_null(), {2, 3}),
    (P.is_not_null(), {1, 4}),
    (~(P == 5), {4}),
    (~(P != 5), {1}),
    (~(P < 6), {4}),
    (~P.is_null(), {1, 4}),
    (~P.is_in([5]), {2, 3, 4}),
    (~P.between(5, 6), {2, 3, 4}),
    (~P.exists(), {2}),
    (~~(P == 5), {1}),
    (~all_of(P == 5, prop("a", "s") == "x"), {2, 3, 4}),
    (~any_of(P == 5, prop("a", "s") == "y"), {2, 3}),
    (any_of(P == 5, prop("a", "s") == "y"), {1, 4}),
    (all_of(), {1, 2, 3, 4}),
    (any_of(), set()),
    (~all_of(), set()),
    (~any_of(), {1, 2, 3, 4}),
    (all_of(P == 5, any_of()), set()),
    (prop("a", "f") == 2.5, {4}),
    (prop("a", "p") == 5.0, {1}),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_semantics(rows, i):
    expr, want = CASES[i]
    assert {r.id for r in bool_filter(rows, expr.node).collect()} == want


@pytest.mark.parametrize(
    ("expr", "code"),
    [
        (P.is_in([None]), "InListEmpty"),
        (P.is_in(list(range(10_001))), "InListTooLarge"),
        (P.is_in([1, "x"]), "TypeMismatch"),
        (P < None, "NullNotAllowed"),
        (P < True, "TypeMismatch"),
        (P < b"x", "TypeMismatch"),
        (P == float("nan"), "NonFiniteFloat"),
        (P.between(5, 1), "InvalidBounds"),
        (P.between(5, "a"), "TypeMismatch"),
        (P == b"x" * (pr.MAX_BYTES + 1), "BytesLiteralTooLarge"),
        (P == "five", "TypeMismatch"),
    ],
)
def test_errors(rows, expr, code):
    with pytest.raises(GraphError) as e:
        bool_filter(rows, expr.node)
    assert e.value.code == code


def test_limits():
    deep = P == 1
    for _ in range(pr.MAX_DEPTH + 1):
        deep = ~deep
    with pytest.raises(GraphError, match="PredicateTooDeep"):
        pr.check(deep.node)
    with pytest.raises(GraphError, match="PredicateTooLarge"):
        pr.check(any_of(*[P == i for i in range(pr.MAX_NODES + 1)]).node)


def test_literals():
    assert pr.literal({"t": "Bytes", "v": "aGk="}) == b"hi"
    assert pr.literal({"t": "DateTime", "v": 10**18}) == dt.datetime(2001, 9, 9, 1, 46, 40)
    for raw, code in (({"t": "Bytes", "v": "%"}, "BytesEncoding"), ({"t": "DateTime", "v": 1 << 64}, "DateTimeInvalid")):
        with pytest.raises(GraphError, match=code):
            pr.literal(raw)


def test_normalize_flattens_and_folds():
    a, b = (P == 1).node, (P == 2).node
    assert pr.normalize(pr.Group("and", (pr.Group("and", (a, b)), a))) == pr.Group("and", (a, b))
    assert pr.normalize(pr.Group("or", (a, pr.TRUE))) == pr.TRUE
    assert pr.normalize(pr.Group("and", (a, pr.TRUE))) == a
    assert pr.normalize(pr.Group("not", (pr.Group("not", (a,)),))) == a


def test_dates(spark):
    df = spark.sql("SELECT 1 AS id, DATE'2020-01-05' AS d, TIMESTAMP_NTZ'2020-01-05 10:00:00' AS t")
    for expr, n in [
        (prop("a", "d") == dt.date(2020, 1, 5), 1), (prop("a", "d") > dt.date(2020, 1, 5), 0), (prop("a", "t") > dt.datetime(2020, 1, 5, 9), 1), (prop("a", "d") == 18266, 1),
        (prop("a", "t") == 1_578_218_400_000, 1),
    ]:
        assert bool_filter(df, expr.node).count() == n
