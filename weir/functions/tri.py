"""Three-valued predicate and arithmetic semantics as Catalyst expressions.

Operands are (Column, type letter) with types B, L, D, S or N (the NULL
literal).  UNKNOWN is a NULL boolean.  Nothing here relies on implicit casts:
mixed numbers meet as doubles, other mixtures have a fixed result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I64_MAX = (1 << 63) - 1
TWO63 = 9.223372036854775807e18
NUMERIC = ("L", "D")

Operand = tuple[Column, str]


def _max() -> Column:
    return F.lit(I64_MAX).cast("long")


def _min() -> Column:
    return -_max() - F.lit(1).cast("long")


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def _any_null(*cols: Column) -> Column:
    out = cols[0].isNull()
    for c in cols[1:]:
        out = out | c.isNull()
    return out


def comparable(a: str, b: str) -> bool:
    return a == b or a in NUMERIC and b in NUMERIC


def _paired(a: Operand, b: Operand) -> tuple[Column, Column, str]:
    if a[1] == b[1]:
        return a[0], b[0], a[1]
    return a[0].cast("double"), b[0].cast("double"), "D"


def equal(a: Operand, b: Operand) -> Column:
    """NULL is UNKNOWN; NaN equals nothing; different kinds are FALSE."""
    if "N" in (a[1], b[1]):
        return unknown()
    if not comparable(a[1], b[1]):
        return F.when(_any_null(a[0], b[0]), unknown()).otherwise(F.lit(False))
    x, y, kind = _paired(a, b)
    if kind == "D":
        return F.when(_any_null(x, y), unknown()).when(F.isnan(x) | F.isnan(y), False).otherwise(x == y)
    return x == y


def compare(op: str, a: Operand, b: Operand) -> Column:
    if op == "=":
        return equal(a, b)
    if op == "<>":
        return ~equal(a, b)
    if "N" in (a[1], b[1]) or not comparable(a[1], b[1]) or a[1] == "B":
        return unknown()
    x, y, kind = _paired(a, b)
    made = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return F.when(F.isnan(x) | F.isnan(y), unknown()).otherwise(made) if kind == "D" else made


def in_list(a: Operand, items: list[Operand]) -> Column:
    """A match is TRUE; without one, a NULL in the list is UNKNOWN."""
    if not items:
        return F.when(a[0].isNull(), unknown()).otherwise(F.lit(False)) if a[1] != "N" else unknown()
    if a[1] == "N":
        return unknown()
    has_null = any(k == "N" for _, k in items)
    usable = [(c, k) for c, k in items if k != "N" and comparable(a[1], k)]
    miss = unknown() if has_null else F.lit(False)
    hit: Column = F.lit(False)
    if usable:
        wide = a[1] == "D" or any(k == "D" for _, k in usable)
        value = a[0].cast("double") if wide else a[0]
        hit = value.isin(*[c.cast("double") if wide else c for c, _ in usable])
        if wide:
            hit = ~F.isnan(value) & hit
    return F.when(a[0].isNull(), unknown()).when(hit, True).otherwise(miss)


def between(v: Operand, low: Operand, high: Operand) -> Column:
    """Any NULL operand is UNKNOWN."""
    if "N" in (v[1], low[1], high[1]):
        return unknown()
    return F.when(_any_null(v[0], low[0], high[0]), unknown()).otherwise(compare(">=", v, low) & compare("<=", v, high))


def like(a: Operand, pattern: Operand, fold: bool) -> Column:
    """``%`` and ``_`` only; no character escapes another."""
    if (a[1], pattern[1]) != ("S", "S"):
        return unknown()
    x, p = (F.lower(a[0]), F.lower(pattern[0])) if fold else (a[0], pattern[0])
    return F.call_function("like", x, F.replace(p, F.lit("|"), F.lit("||")), F.lit("|"))


def arithmetic(op: str, a: Operand, b: Operand) -> Operand:
    """+ - * saturate on integers; / is always a double; % truncates; kinds without meaning give NULL."""
    if a[1] not in NUMERIC or b[1] not in NUMERIC:
        return F.lit(None).cast("double"), "D" if "N" not in (a[1], b[1]) else "N"
    x, y = a[0], b[0]
    if op == "/":
        return x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0)), "D"
    if op == "%":
        m, n = truncated(a), truncated(b)
        return F.when((m == _min()) & (n == -1), F.lit(None).cast("long")).otherwise(F.try_mod(m, n)), "L"
    if "D" in (a[1], b[1]):
        x, y = x.cast("double"), y.cast("double")
        return {"+": x + y, "-": x - y, "*": x * y}[op], "D"
    tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    low = (x < 0) != (y < 0) if op == "*" else x < 0
    return F.when(_any_null(x, y), F.lit(None).cast("long")).otherwise(F.coalesce(tried, F.when(low, _min()).otherwise(_max()))), "L"


def truncated(a: Operand) -> Column:
    """A number as a 64-bit integer: truncated, saturated, NaN as 0."""
    x = a[0]
    if a[1] == "L":
        return x
    return F.when(F.isnan(x), F.lit(0).cast("long")).when(x >= TWO63, _max()).when(x <= -TWO63, _min()).otherwise(x.cast("long"))


def negate(a: Operand) -> Operand:
    if a[1] == "L":
        return F.when(a[0] == _min(), _max()).otherwise(-F.when(a[0] != _min(), a[0])), "L"
    if a[1] == "D":
        return -a[0], "D"
    return F.lit(None).cast("double"), "N" if a[1] == "N" else "D"


def finite(x: Column, kind: str) -> Column:
    """Whether a value can be summed."""
    if kind == "L":
        return x.isNotNull()
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
