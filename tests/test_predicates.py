import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from reference_eval import truth

from weir.errors import RegisterError
from weir.model import TableDef
from weir.plans import sql as S
from weir.plans.compile import Access, canonical, check, predicate, template, text
from weir.plans.sql import parse_predicate

T = TableDef(1, ("t",), (("a", "L"), ("b", "L"), ("x", "D"), ("s", "S"), ("f", "B")))
TOP, LOW = (1 << 63) - 1, -(1 << 63)
ROWS = [
    {"a": a, "b": b, "x": x, "s": s, "f": f}
    for a, b, x, s, f in [
        (1, 2, 1.0, "F", True),
        (None, 0, float("nan"), "f%_", False),
        (TOP, LOW, -0.0, None, None),
        (LOW, -1, float("inf"), "", True),
        (5, None, None, "aé\\b|c", False),
        (0, 0, 5.5, "abc", None),
        (-7, 3, -7.9, "ABC", True),
    ]
]

columns = st.sampled_from([S.Col(c) for c in "abxsf"])
literals = st.sampled_from([S.Lit(v, k) for v, k in ((0, "L"), (1, "L"), (5, "L"), (TOP, "L"), (1.0, "D"), (5.5, "D"), ("F", "S"), ("a%", "S"), ("_b_", "S"), ("aé\\b|c", "S"), (True, "B"), (None, "N"))])
values = st.recursive(columns | literals, lambda v: st.builds(lambda op, a, b: S.Arith(op, (a, b)), st.sampled_from("+-*/%"), v, v) | st.builds(lambda a: S.Arith("neg", (a,)), v), max_leaves=3)
leaves = (
    st.builds(S.Compare, st.sampled_from(["=", "<>", "<", "<=", ">", ">="]), values, values)
    | st.builds(S.IsNull, values, st.booleans())
    | st.builds(S.InList, values, st.lists(literals, max_size=4).map(tuple), st.booleans())
    | st.builds(S.Between, values, values, values, st.booleans())
    | st.builds(S.Like, values, values, st.booleans(), st.booleans())
)
predicates = st.recursive(leaves, lambda p: st.builds(lambda op, a, b: S.Logic(op, (a, b)), st.sampled_from(["AND", "OR"]), p, p) | st.builds(lambda a: S.Logic("NOT", (a,)), p), max_leaves=4)


@given(st.lists(predicates, min_size=40, max_size=40))
@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
def test_compiled_predicates_agree_with_the_evaluator(spark, nodes):
    df = spark.createDataFrame([tuple(r.values()) for r in ROWS], T.row_type()).coalesce(1)
    got = df.select(*[predicate(n, T, F.col).alias(f"p{k}") for k, n in enumerate(nodes)]).collect()
    for row, out in zip(ROWS, got, strict=True):
        for k, n in enumerate(nodes):
            assert out[k] == truth(n, row), (text(n), row)


@given(predicates)
@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
def test_canonical_text_keeps_meaning_and_parses_back(node):
    made = canonical(node)
    assert canonical(made) == made
    back = parse_predicate(text(made))
    for row in ROWS:
        assert truth(made, row) == truth(node, row)
        assert truth(back, row) == truth(node, row), text(made)


def test_commuted_predicates_are_one_and_literals_make_templates():
    a, b = (canonical(parse_predicate(p)) for p in ("a = 1 AND (s = 'F' AND b > 2)", "(b > 2) AND 'F' = s AND 1 = a"))
    assert text(a) == text(b)
    one, two = template(a, T), template(canonical(parse_predicate("a = 9 AND s = 'x' AND b > 0")), T)
    assert one[0].key == two[0].key and one[0].branches[0][1] == (Access("a", points=(one[1].index(1),)), Access("s", points=(one[1].index("F"),)), Access("b", low=(one[1].index(2),)))


def test_rejections():
    for bad in ("(a = 1) = f", "(a > 1) IS NULL", "a AND f", "nothing = 1"):
        try:
            check(parse_predicate(bad), T)
        except RegisterError:
            continue
        raise AssertionError(bad)


def test_depth_limit_is_exact_enough():
    assert parse_predicate("(" * 100 + "a = 1" + ")" * 100)
    try:
        parse_predicate("(" * 200 + "a = 1" + ")" * 200)
    except RegisterError:
        return
    raise AssertionError


def test_nan_is_unordered():
    assert truth(parse_predicate("x > 1"), {"x": math.nan}) is None
