"""From expression trees to Catalyst columns, canonical text and templates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.errors import TypeMismatch, UnsupportedSql
from weir.functions import tri
from weir.model import TYPES, TableDef
from weir.plans import sql as S

Leaf = Callable[[S.Lit], Column]


def check(node: object, table: TableDef) -> None:
    """Rejects unknown columns, predicates used as values and values used as predicates inside AND/OR/NOT."""
    for n in S.walk(node):
        if isinstance(n, S.Col):
            table.column_id(n.name)
        values = {S.Arith: lambda n: n.args, S.Compare: S.children, S.IsNull: S.children, S.Between: S.children, S.Like: S.children, S.InList: lambda n: (n.arg,)}.get(type(n))
        if values and any(isinstance(v, S.PREDICATES) for v in values(n)):
            raise UnsupportedSql("a predicate is used as a value")
        if isinstance(n, S.Logic):
            for a in n.args:
                if not isinstance(a, S.PREDICATES) and kind(a, table) not in ("B", "N"):
                    raise TypeMismatch("AND, OR and NOT take predicates")


def kind(node: object, table: TableDef) -> str:
    """Type letter of a value expression (B for predicates)."""
    if isinstance(node, S.Lit):
        return node.kind
    if isinstance(node, S.Col):
        return table.types[node.name]
    if isinstance(node, S.Arith):
        kinds = [kind(a, table) for a in node.args]
        if node.op == "neg":
            return kinds[0] if kinds[0] in ("L", "D", "N") else "D"
        if "N" in kinds:
            return "N"
        if any(k not in tri.NUMERIC for k in kinds) or node.op == "/":
            return "D"
        return "L" if node.op == "%" or kinds == ["L", "L"] else "D"
    return "B"


def literal(lit: S.Lit) -> Column:
    return F.lit(None) if lit.kind == "N" else F.lit(lit.value).cast(TYPES[lit.kind])


def value(node: object, table: TableDef, row: Callable[[str], Column], leaf: Leaf = literal) -> tri.Operand:
    if isinstance(node, S.Lit):
        return leaf(node), node.kind
    if isinstance(node, S.Col):
        return row(node.name), table.types[node.name]
    if isinstance(node, S.Arith):
        args = [value(a, table, row, leaf) for a in node.args]
        return tri.negate(args[0]) if node.op == "neg" else tri.arithmetic(node.op, *args)
    return predicate(node, table, row, leaf), "B"


def predicate(node: object | None, table: TableDef, row: Callable[[str], Column], leaf: Leaf = literal) -> Column:
    """The nullable boolean of a WHERE expression; no expression is TRUE."""
    if node is None:
        return F.lit(True)
    sub = lambda n: predicate(n, table, row, leaf)
    val = lambda n: value(n, table, row, leaf)
    if isinstance(node, S.Logic):
        args = [sub(a) for a in node.args]
        if node.op == "NOT":
            return ~args[0]
        out = args[0]
        for a in args[1:]:
            out = (out & a) if node.op == "AND" else (out | a)
        return out
    if isinstance(node, S.Compare):
        return tri.compare(node.op, val(node.left), val(node.right))
    if isinstance(node, S.IsNull):
        c, k = val(node.arg)
        if k == "N":
            return F.lit(not node.negated)
        return c.isNotNull() if node.negated else c.isNull()
    if isinstance(node, S.InList):
        made = tri.in_list(val(node.arg), [(leaf(i), i.kind) for i in node.items])
    elif isinstance(node, S.Between):
        made = tri.between(val(node.arg), val(node.low), val(node.high))
    elif isinstance(node, S.Like):
        made = tri.like(val(node.arg), val(node.pattern), node.fold)
    else:  # a bare value: a boolean is itself, anything else is UNKNOWN
        c, k = val(node)
        return c if k == "B" else tri.unknown()
    return ~made if node.negated else made


def matches(node: object | None, table: TableDef, row: Callable[[str], Column], leaf: Leaf = literal) -> Column:
    """Whether a row is in the result: TRUE only."""
    return F.coalesce(predicate(node, table, row, leaf), F.lit(False))


# -- canonical form


def canonical(node: object | None) -> object | None:
    """AND and OR flattened and sorted, operands of ``=`` sorted, IN lists sorted."""
    if isinstance(node, S.Logic):
        if node.op == "NOT":
            return S.Logic("NOT", (canonical(node.args[0]),))
        flat: list = []
        for a in node.args:
            a = canonical(a)
            flat += a.args if isinstance(a, S.Logic) and a.op == node.op else [a]
        return S.Logic(node.op, tuple(sorted(flat, key=text)))
    if isinstance(node, S.Compare):
        left, right = canonical(node.left), canonical(node.right)
        if node.op == "=" and text(right) < text(left):
            left, right = right, left
        return S.Compare(node.op, left, right)
    if isinstance(node, S.InList):
        return S.InList(canonical(node.arg), tuple(sorted(node.items, key=text)), node.negated)
    if isinstance(node, S.Between):
        return S.Between(canonical(node.arg), canonical(node.low), canonical(node.high), node.negated)
    if isinstance(node, S.Like):
        return S.Like(canonical(node.arg), canonical(node.pattern), node.negated, node.fold)
    if isinstance(node, S.IsNull):
        return S.IsNull(canonical(node.arg), node.negated)
    if isinstance(node, S.Arith):
        return S.Arith(node.op, tuple(canonical(a) for a in node.args))
    return node


def text(node: object | None, literal_text: Callable[[S.Lit], str] | None = None) -> str:
    """Unambiguous text of an expression; the empty text of no expression."""
    sub = lambda n: text(n, literal_text)
    no = lambda n: "NOT " if n.negated else ""
    if node is None:
        return ""
    if isinstance(node, S.Lit):
        if literal_text:
            return literal_text(node)
        if node.kind == "S":
            return "'" + str(node.value).replace("'", "''") + "'"
        return "NULL" if node.kind == "N" else repr(node.value) if node.kind == "D" else str(node.value).upper()
    if isinstance(node, S.Col):
        return '"' + node.name.replace('"', '""') + '"'
    if isinstance(node, S.Arith):
        return f"(-{sub(node.args[0])})" if node.op == "neg" else f"({sub(node.args[0])} {node.op} {sub(node.args[1])})"
    if isinstance(node, S.Compare):
        return f"{sub(node.left)} {node.op} {sub(node.right)}"
    if isinstance(node, S.Logic):
        if node.op == "NOT":
            return f"NOT ({sub(node.args[0])})"
        return "(" + f" {node.op} ".join(sub(a) for a in node.args) + ")"
    if isinstance(node, S.IsNull):
        return f"{sub(node.arg)} IS {no(node)}NULL"
    if isinstance(node, S.InList):
        return f"{sub(node.arg)} {no(node)}IN ({', '.join(sub(i) for i in node.items)})"
    if isinstance(node, S.Between):
        return f"{sub(node.arg)} {no(node)}BETWEEN {sub(node.low)} AND {sub(node.high)}"
    return f"{sub(node.arg)} {no(node)}{'ILIKE' if node.fold else 'LIKE'} {sub(node.pattern)}"


def predicate_hash(table: TableDef, where: object | None, projection: S.Projection) -> str:
    """128-bit digest of table, canonical text and projection."""
    suffix = projection.kind if projection.column is None else f"{projection.kind}:{table.column_id(projection.column)}"
    return hashlib.md5(f"{table.table_id}\n{text(canonical(where))}\n{suffix}".encode()).hexdigest()


# -- templates


@dataclass(frozen=True)
class Access:
    """What a branch needs of one column to be TRUE, by places of parameters: to equal one of ``points``, or to lie between ``low`` and ``high``."""

    column: str
    points: tuple[int, ...] = ()
    low: tuple[int, ...] = ()
    high: tuple[int, ...] = ()


@dataclass(frozen=True)
class Template:
    """A canonical predicate with its literals as parameters ``p0 ...`` (in order of appearance)."""

    where: object | None
    key: str
    kinds: tuple[str, ...]
    branches: tuple[tuple[object, tuple[Access, ...]], ...]  # what OR joins, each with the ways to find its candidates

    def leaf(self, params: Callable[[int], Column]) -> Leaf:
        """Literals by position, whichever order the compiler asks for them in."""
        place = {id(lit): k for k, lit in enumerate(_params(self.where))}
        return lambda lit: params(place[id(lit)]) if id(lit) in place else literal(lit)


def _params(where: object | None) -> list[S.Lit]:
    return [n for n in S.walk(where) if isinstance(n, S.Lit) and n.kind != "N"]


def _fresh(node: object | None) -> object | None:
    """A copy in which every literal is an object of its own."""
    if isinstance(node, S.Lit):
        return S.Lit(node.value, node.kind)
    if isinstance(node, (S.Arith, S.Logic)):
        return type(node)(node.op, tuple(_fresh(a) for a in node.args))
    if isinstance(node, S.Compare):
        return S.Compare(node.op, _fresh(node.left), _fresh(node.right))
    if isinstance(node, S.IsNull):
        return S.IsNull(_fresh(node.arg), node.negated)
    if isinstance(node, S.InList):
        return S.InList(_fresh(node.arg), tuple(_fresh(i) for i in node.items), node.negated)
    if isinstance(node, S.Between):
        return S.Between(_fresh(node.arg), _fresh(node.low), _fresh(node.high), node.negated)
    if isinstance(node, S.Like):
        return S.Like(_fresh(node.arg), _fresh(node.pattern), node.negated, node.fold)
    return node


def template(where: object | None, table: TableDef) -> tuple[Template, list]:
    """The template of a canonical predicate, and its parameter values."""
    where = _fresh(where)
    lits = _params(where)
    key = text(where, lambda lit: "NULL" if lit.kind == "N" else f"?{lit.kind}")
    place = {id(lit): k for k, lit in enumerate(lits)}

    def conjuncts(branch: object) -> tuple:
        return branch.args if isinstance(branch, S.Logic) and branch.op == "AND" else (branch,)

    def sides(c: S.Compare) -> tuple[S.Col, S.Lit, str] | None:
        """Column, literal and operator of a comparison of one with the other."""
        turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
        if isinstance(c.left, S.Col) and isinstance(c.right, S.Lit):
            return c.left, c.right, c.op
        if isinstance(c.right, S.Col) and isinstance(c.left, S.Lit):
            return c.right, c.left, turned.get(c.op, c.op)
        return None

    def points(branch: object) -> list[Access]:
        """The equalities and IN lists."""
        found = []
        for c in conjuncts(branch):
            column, items = None, ()
            if isinstance(c, S.Compare) and c.op == "=" and (pair := sides(c)):
                column, items = pair[0], (pair[1],)
            elif isinstance(c, S.InList) and not c.negated and isinstance(c.arg, S.Col):
                column, items = c.arg, tuple(i for i in c.items if i.kind != "N")
            if column is not None and items and all(i.kind == table.types[column.name] != "D" for i in items):
                found.append(Access(column.name, points=tuple(place[id(i)] for i in items)))
        return found

    def bounds(branch: object) -> list[Access]:
        """The numeric columns with bounds."""
        low: dict[str, list[int]] = {}
        high: dict[str, list[int]] = {}

        def bound(column: object, lit: object, side: dict[str, list[int]]) -> None:
            if isinstance(column, S.Col) and isinstance(lit, S.Lit) and table.types[column.name] in tri.NUMERIC and lit.kind in tri.NUMERIC:
                side.setdefault(column.name, []).append(place[id(lit)])

        for c in conjuncts(branch):
            if isinstance(c, S.Compare) and c.op in ("<", "<=", ">", ">=") and (pair := sides(c)):
                bound(pair[0], pair[1], low if pair[2][0] == ">" else high)
            elif isinstance(c, S.Between) and not c.negated:
                bound(c.arg, c.low, low)
                bound(c.arg, c.high, high)
        return [Access(n, low=tuple(low.get(n, ())), high=tuple(high.get(n, ()))) for n in sorted({*low, *high})]

    parts = where.args if isinstance(where, S.Logic) and where.op == "OR" else (where,)
    branches = tuple((b, (*points(b), *bounds(b))) for b in parts)
    return Template(where, key, tuple(lit.kind for lit in lits), branches), [lit.value for lit in lits]
