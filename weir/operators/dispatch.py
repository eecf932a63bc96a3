"""Dispatch: change events against standing queries.

Predicates that differ in literals only share a template.  The predicates of
templates with many members are filed under what one of their columns must
equal, or under runs of bins that its bounds cover, and an event is looked up
under its values and bins: one hash join for many templates, whatever their
shapes, with the template's own condition as the rest.  Templates with few
members are filters of one scan.  Predicates and bindings are driver-side lists
of known length; they are broadcast while they are small (``BROADCAST_ROWS``)
and joined by shuffle beyond.

An UPDATE is judged on both images in the same pass: joining on the new image
finds what entered or changed, joining on the old image finds what left.  No
shuffle is needed but the final one that makes each consumer appear once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weir.errors import ArityMismatch, DispatchError, MissingImage, UnknownTableId
from weir.model import TYPES, TableDef
from weir.operators.registry import Predicate, Registry
from weir.plans.compile import Access, Leaf, Template, matches, template

BROADCAST_ROWS = 200_000
#: Up to so many predicates of one template are filters of one scan instead of a join.
FILTERS = 4
FILTER_RUN = 64
#: Shapes (branches of templates) that share a join; the JVM compiles no method that tests many more.
JOIN_CONDITIONS = 6
MAX_LEVELS = 16

OLD_COMPLETE = "old_row IS NOT NULL AND size(old_missing) = 0"


def local_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A driver-side list as a local relation: no job reads it and its size is known to the optimizer."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [[] for _ in arrow]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), schema)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _image(side: str) -> Callable[[str], Column]:
    return lambda name: F.col(f"{side}.`{name}`")


def _touched(deps: Column) -> Column:
    """Whether an event can matter to a predicate that reads the columns ``deps``."""
    return (F.col("kind") != "update") | (F.size("changed") == 0) | (F.size(deps) == 0) | F.arrays_overlap("changed", deps)


def _strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


class _Group:
    """The predicates of one template with their parameters."""

    def __init__(self, table: TableDef, shape: Template, members: list[tuple[Predicate, list]]) -> None:
        self.table, self.shape, self.members = table, shape, members
        seen: dict[str, int] = defaultdict(int)
        self.columns = []  # of each parameter, by type and number within the type
        for kind in shape.kinds:
            self.columns.append(f"p{kind}{seen[kind]}")
            seen[kind] += 1

    def condition(self, side: str) -> Column:
        """The template over an image, as a join condition."""
        return matches(self.shape.where, self.table, _image(side), self.leaf())

    def leaf(self) -> Leaf:
        return self.shape.leaf(lambda k: F.col(self.columns[k]))

    def branches(self, side: str) -> list[tuple[Access | None, Column]]:
        """Per branch of an OR its access and its condition: what the branches before it left, so that each pair comes once."""
        out, before = [], F.lit(True)
        for branch, ways in self.shape.branches:
            hit = matches(branch, self.table, _image(side), self.leaf())
            out.append((min(ways, key=self.candidates, default=None), _touched(F.col("deps")) & hit & before))
            before = before & ~hit
        return out

    def candidates(self, access: Access) -> float:
        """About how many members an event meets by this access: values and places between bounds are taken to be alike likely."""
        if access.points:
            sets = [{v[k] for k in access.points} for _, v in self.members]
            return sum(map(len, sets)) / len(set().union(*sets))
        ends = [([float(v[k]) for k in access.low], [float(v[k]) for k in access.high]) for _, v in self.members]
        low, high = min(min(a + b) for a, b in ends), max(max(a + b) for a, b in ends)
        if not 0 < high - low < math.inf:
            return float(len(ends))
        return sum(max(0.0, min(b, default=high) - max(a, default=low)) for a, b in ends) / (high - low)


def grouped(predicates: Iterable[Predicate]) -> list[_Group]:
    by_key: dict[str, tuple[Template, list]] = {}
    table = None
    for p in predicates:
        table = p.table
        shape, values = template(p.where, p.table)
        by_key.setdefault(shape.key, (shape, []))[1].append((p, values))
    return [_Group(table, shape, members) for shape, members in by_key.values()]


class _Bins:
    """Bins of equal width over the bounds on one column, and dyadic runs of them.

    A value lies in one bin and so in one run of every level; an interval is a
    disjoint union of at most two runs a level.  So a value and an interval
    that may hold it meet in exactly one run.
    """

    def __init__(self, bounds: list[float]) -> None:
        self.levels = min(MAX_LEVELS, max(2, (2 * len(bounds)).bit_length()))
        self.low, width = min(bounds), max(bounds) - min(bounds)
        self.scale = (1 << self.levels) / width if 0 < width < math.inf else 1.0
        self.top = float((1 << self.levels) - 1)
        self.used: set[int] = set()

    def bin(self, x: float) -> int:
        return int(min(max(math.floor((x - self.low) * self.scale), 0.0), self.top))

    def bin_of(self, x: Column) -> Column:
        return F.least(F.greatest(F.floor((x.cast("double") - self.low) * self.scale).cast("double"), F.lit(0.0)), F.lit(self.top)).cast("long")

    def runs(self, low: float | None, high: float | None) -> list[int]:
        """Keys of the runs that an interval consists of (none for an empty one)."""
        a, b = 0 if low is None else self.bin(low), int(self.top) if high is None else self.bin(high)
        out, level = [], 0
        while a <= b:
            if a & 1:
                out.append((level, a))
                a += 1
            if a <= b and not b & 1:
                out.append((level, b))
                b -= 1
            a, b, level = a >> 1, b >> 1, level + 1
        self.used |= {k for k, _ in out}
        return [k << 40 | n for k, n in out]


class _Probes:
    """The keys under which predicates are filed and events look them up."""

    def __init__(self, table: TableDef, paths: list[tuple[_Group, Access]]) -> None:
        self.types = table.types
        self.points = sorted({a.column for _, a in paths if a.points})
        bounds: dict[str, list[float]] = defaultdict(list)
        for g, a in paths:
            if not a.points:
                bounds[a.column] += [float(v[k]) for _, v in g.members for k in (*a.low, *a.high)]
        self.bins = {c: _Bins(v) for c, v in bounds.items()}
        self.number = {("points", c): k for k, c in enumerate(self.points)} | {("bins", c): len(self.points) + k for k, c in enumerate(self.bins)}

    def keys(self, access: Access, values: list) -> list[tuple[int, int | None, str | None]]:
        """(probe, number, text) for each place where a predicate with these parameters is filed."""
        if access.points:
            probe, text_ = self.number["points", access.column], self.types[access.column] == "S"
            return [(probe, None, v) if text_ else (probe, int(v), None) for v in {values[k] for k in access.points}]
        low = max((float(values[k]) for k in access.low), default=None)
        high = min((float(values[k]) for k in access.high), default=None)
        return [(self.number["bins", access.column], key, None) for key in self.bins[access.column].runs(low, high)]

    def asked(self, side: str) -> Column:
        """All keys of an event (after the predicates were filed: levels that none uses are not asked)."""
        image, out = _image(side), []

        def key(kind: str, column: str, value: Column) -> None:
            out.append(F.struct(F.lit(self.number[kind, column]).alias("probe"), value.alias("key")))

        for c in self.points:
            key("points", c, F.when(image(c).isNotNull(), F.xxhash64(image(c))) if self.types[c] == "S" else image(c).cast("long"))
        for c, bins in self.bins.items():
            for level in sorted(bins.used):
                key("bins", c, F.shiftright(bins.bin_of(image(c)), level) + (level << 40))
        return F.array(*out)


def joined(events: DataFrame, side: str, groups: list[_Group], other: str | None = None) -> list[DataFrame]:
    """Events with the predicates of the groups that they match, each pair once: (events..., predicate_id, other).

    One join for ``JOIN_CONDITIONS`` shapes: predicates are filed under the
    values or intervals of one of their columns, events are looked up there,
    and the shape's own condition decides.  A branch without such a column
    meets every event.
    """
    out = []
    paths = [(g, k, access, on) for g in groups for k, (access, on) in enumerate(g.branches(side))]
    filed = [x for x in paths if x[2] is not None]
    runs = [filed[k : k + JOIN_CONDITIONS] for k in range(0, len(filed), JOIN_CONDITIONS)] + [[x] for x in paths if x[2] is None]
    for run in runs:
        used = sorted({c for g, *_ in run for c in g.columns})
        shapes = list(dict.fromkeys(g for g, *_ in run))
        probes = _Probes(run[0][0].table, [(g, access) for g, _, access, _ in run if access is not None])
        rows = []
        for n, (g, _, access, _) in enumerate(run):
            at = [g.columns.index(c) if c in g.columns else None for c in used]
            for p, values in g.members:
                own = (n, shapes.index(g), p.predicate_id, list(p.deps), *[None if k is None else values[k] for k in at])
                rows += [(*key, *own) for key in (probes.keys(access, values) if access is not None else [(0, None, None)])]
        fields = ["probe int", "number long", "text string", "way int", "shape int", "predicate_id long", "deps array<string>", *[f"{c} {TYPES[c[1]].simpleString()}" for c in used]]
        params = local_frame(events.sparkSession, rows, ", ".join(fields))
        condition = reduce(lambda c, x: c.when(F.col("way") == x[0], x[1][3]), enumerate(run), F.when(F.lit(False), F.lit(False)))
        seen = F.lit(False)
        if other:
            seen = reduce(lambda c, x: c.when(F.col("shape") == x[0], x[1].condition(other)), enumerate(shapes), F.when(F.lit(False), F.lit(False)))
        if run[0][2] is None:
            found = events.join(_small(params.drop("probe", "number", "text"), len(rows)), condition)
        else:
            key = F.coalesce("number", F.xxhash64("text")).alias("_key")
            asked = events.select("*", F.explode(probes.asked(side)).alias("_asked"))
            on = (F.col("_asked.probe") == F.col("probe")) & (F.col("_asked.key") == F.col("_key")) & condition
            found = asked.join(_small(params.select(key, *params.drop("number", "text").columns), len(rows)), on)
        out.append(found.select(*[F.col(f"`{c}`") for c in events.columns], "predicate_id", seen.alias("other")))
    return out


def _filters(events: DataFrame, side: str, predicates: list[Predicate], other: bool) -> DataFrame:
    """One scan for a few predicates: the ids that match, exploded."""

    def one(p: Predicate) -> Column:
        hit = _touched(_strings(p.deps)) & matches(p.where, p.table, _image(side))
        seen = matches(p.where, p.table, _image("old_row" if side == "new_row" else "new_row")) if other else F.lit(False)
        return F.when(hit, F.struct(F.lit(p.predicate_id).cast("long").alias("predicate_id"), seen.alias("other")))

    found = F.filter(F.array(*[one(p) for p in predicates]), lambda x: x.isNotNull())
    return events.select("*", F.explode(found).alias("_hit")).select("*", "_hit.predicate_id", "_hit.other").drop("_hit")


def match_side(events: DataFrame, side: str, predicates: list[Predicate], keep: list[str], other: bool = False) -> DataFrame | None:
    """(keep..., predicate_id, other): events whose ``side`` image is TRUE; ``other`` says whether the other image is too."""
    groups = grouped(predicates)
    singles = [p for g in groups if len(g.members) <= FILTERS for p, _ in g.members]
    many = [g for g in groups if len(g.members) > FILTERS]
    parts = [x.select(*keep, "predicate_id", "other") for x in joined(events, side, many, ("old_row" if side == "new_row" else "new_row") if other else None)]
    for k in range(0, len(singles), FILTER_RUN):
        parts.append(_filters(events, side, singles[k : k + FILTER_RUN], other).select(*keep, "predicate_id", "other"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _table(registry: Registry, table_id: int) -> TableDef:
    try:
        return registry.catalog.by_id(table_id)
    except Exception:
        raise UnknownTableId(str(table_id)) from None


def validated(events: DataFrame) -> DataFrame:
    """Events with ``error``: what a strict dispatch would raise."""
    needs_new = F.col("kind").isin("insert", "update") & F.col("new_row").isNull()
    needs_old = (F.col("kind") == "delete") & F.col("old_row").isNull()
    known = F.col("kind").isin("insert", "update", "delete", "truncate")
    return events.withColumn("error", F.when(~F.coalesce(known, F.lit(False)), "unknown_event_kind").when(needs_new | needs_old, MissingImage.code))


def check_events(events: DataFrame, table: TableDef, strict: bool) -> DataFrame:
    """Arity by schema; rows with errors are dropped, or raise where ``strict``."""
    for side in ("old_row", "new_row"):
        if len(events.schema[side].dataType.fields) != table.arity:
            raise ArityMismatch(f"{side} of table {table.table_id}")
    judged = validated(events)
    if strict:
        bad = judged.where("error IS NOT NULL").select("seq", "error").first()
        if bad:
            raise (MissingImage if bad["error"] == MissingImage.code else DispatchError)(f"event {bad['seq']}")
    return judged.where("error IS NULL").drop("error")


def subscription_matches(events: DataFrame, registry: Registry, table_id: int, strict: bool = False) -> DataFrame:
    """(seq, predicate_id, change) at predicate grain, before consumers are joined."""
    table = _table(registry, table_id)
    events = check_events(events, table, strict)
    predicates = registry.of_table(table_id, aggregate=False)
    if not predicates:
        return events.sparkSession.createDataFrame([], f"seq {events.schema['seq'].dataType.simpleString()}, predicate_id long, change string")
    full = F.coalesce(F.expr(OLD_COMPLETE), F.lit(False))
    parts = []

    def add(part: DataFrame | None, change: Column) -> None:
        if part is not None:
            parts.append(part.select("seq", "predicate_id", change.alias("change")))

    # what the new image matches: entered, or stayed
    fresh = events.where(F.col("kind").isin("insert", "update")).withColumn("full", full)
    entered = F.when(F.col("kind") == "insert", "inserted").when(F.col("full") & ~F.col("other"), "inserted").otherwise("updated")
    add(match_side(fresh, "new_row", predicates, ["seq", "kind", "full"], other=True), entered)
    # what only the old image matches: left
    stale = events.where((F.col("kind") == "delete") | ((F.col("kind") == "update") & full))
    gone = match_side(stale, "old_row", predicates, ["seq", "kind"], other=True)
    if gone is not None:
        add(gone.where((F.col("kind") == "delete") | ~F.col("other")), F.lit("deleted"))
    # a truncated table has left every result
    ids = local_frame(events.sparkSession, [(table_id, p.predicate_id) for p in predicates], "table_id int, predicate_id long")
    add(events.where("kind = 'truncate'").select("seq", "table_id").join(_small(ids, len(predicates)), "table_id"), F.lit("deleted"))
    return reduce(DataFrame.unionByName, parts)


def dispatch(events: DataFrame, registry: Registry, table_id: int, strict: bool = False) -> DataFrame:
    """(seq, consumer_id, change): each consumer at most once per change of an event."""
    found = subscription_matches(events, registry, table_id, strict)
    rows = sorted({(b.predicate_id, b.consumer_id) for b in registry.bindings.values() if registry.by_id[b.predicate_id].table.table_id == table_id})
    bound = local_frame(events.sparkSession, rows, f"predicate_id long, consumer_id {registry.consumer_type}")
    return found.join(_small(bound, len(rows)), "predicate_id").select("seq", "consumer_id", "change").distinct()


def notifications(dispatched: DataFrame) -> DataFrame:
    """One row per event: the consumers that saw the row enter, leave or change."""
    sets = [F.sort_array(F.collect_set(F.when(F.col("change") == c, F.col("consumer_id")))).alias(c) for c in ("inserted", "deleted", "updated")]
    return dispatched.groupBy("seq").agg(*sets)


def affected(dispatched: DataFrame) -> DataFrame:
    """(seq, consumer_id) of those that see a row now: entered or changed."""
    return dispatched.where(F.col("change").isin("inserted", "updated")).select("seq", "consumer_id").distinct()


def dispatch_all(events_by_table: dict[int, DataFrame], registry: Registry, strict: bool = False) -> DataFrame:
    """Dispatch of several tables' event logs: (table_id, seq, consumer_id, change)."""
    parts = [dispatch(e, registry, t, strict).withColumn("table_id", F.lit(t)) for t, e in events_by_table.items()]
    return reduce(DataFrame.unionByName, parts)
