"""Tables, catalogs and the shape of change events."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.errors import AmbiguousTable, CatalogError, EventBuildError, UnknownColumn, UnknownTable

#: The type lattice: bool, 64-bit integer, double, string.
TYPES: dict[str, T.DataType] = {"B": T.BooleanType(), "L": T.LongType(), "D": T.DoubleType(), "S": T.StringType()}
KINDS = ("insert", "update", "delete", "truncate")


@dataclass(frozen=True)
class TableDef:
    """One table: columns are (name, type letter) in ordinal order."""

    table_id: int
    names: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]
    primary_key: tuple[str, ...] = ()

    @property
    def types(self) -> dict[str, str]:
        return dict(self.columns)

    @property
    def arity(self) -> int:
        return len(self.columns)

    def column_id(self, name: str) -> int:
        for k, (n, _) in enumerate(self.columns):
            if n == name:
                return k
        raise UnknownColumn(name)

    def row_type(self) -> T.StructType:
        return T.StructType([T.StructField(n, TYPES[t]) for n, t in self.columns])

    def fingerprint(self) -> str:
        """Digest of the schema; two tables with equal columns and key have equal fingerprints."""
        return hashlib.md5(repr((self.columns, self.primary_key)).encode()).hexdigest()[:16]


@dataclass
class Catalog:
    """Tables by name.  Lookup is exact and case-sensitive."""

    tables: list[TableDef] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._by_id: dict[int, TableDef] = {}
        self._by_name: dict[str, TableDef] = {}
        given, self.tables = self.tables, []
        for t in given:
            self.add(t)

    def add(self, table: TableDef) -> None:
        if table.table_id in self._by_id or any(n in self._by_name for n in table.names):
            raise CatalogError(f"table {table.names} is defined twice")
        if len({n for n, _ in table.columns}) != table.arity:
            raise CatalogError(f"a column of {table.names} is defined twice")
        self.tables.append(table)
        self._by_id[table.table_id] = table
        self._by_name |= dict.fromkeys(table.names, table)

    def by_id(self, table_id: int) -> TableDef:
        try:
            return self._by_id[table_id]
        except KeyError:
            raise UnknownTable(str(table_id)) from None

    def resolve(self, name: str, schema: str | None = None) -> TableDef:
        """``schema.name`` before ``name``; both known with different ids is ambiguous."""
        plain = self._by_name.get(name)
        full = self._by_name.get(f"{schema}.{name}") if schema else None
        if plain and full and plain.table_id != full.table_id:
            raise AmbiguousTable(f"{schema}.{name}")
        if not (full or plain):
            raise UnknownTable(f"{schema}.{name}" if schema else name)
        return full or plain

    def lookup(self) -> dict[str, int]:
        """Every known name with its table id."""
        return {n: t.table_id for n, t in self._by_name.items()}


def event_schema(table: TableDef) -> T.StructType:
    """The typed event log of one table."""
    names = T.ArrayType(T.StringType())
    return T.StructType(
        [
            T.StructField("seq", T.LongType()),
            T.StructField("table_id", T.IntegerType()),
            T.StructField("kind", T.StringType()),
            T.StructField("pk", T.MapType(T.StringType(), T.StringType())),
            T.StructField("old_row", table.row_type()),
            T.StructField("new_row", table.row_type()),
            T.StructField("old_missing", names),
            T.StructField("new_missing", names),
            T.StructField("changed", names),
        ]
    )


NO_NAMES = "array<string>"


def _names(*values: Column) -> Column:
    return F.array(*values).cast(NO_NAMES)


def row_image(table: TableDef, prefix: str = "") -> Column:
    """A row struct from flat columns ``prefix + name``, cast to the catalog's types; NULL for columns not given is up to the caller."""
    return F.struct(*[F.col(f"`{prefix}{n}`").cast(TYPES[t]).alias(n) for n, t in table.columns])


def pk_map(table: TableDef, row: Column) -> Column:
    pairs = [F.struct(F.lit(k), row[k].cast("string")) for k in table.primary_key]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.array(*pairs))


def differs(a: Column, b: Column, kind: str) -> Column:
    """Whether two cells differ; NaN differs from itself, NULL doesn't."""
    apart = ~a.eqNullSafe(b)
    return (apart | F.coalesce(F.isnan(a), F.lit(False))) if kind == "D" else apart


def changed_columns(table: TableDef, old: Column, new: Column, old_missing: Column | None = None, new_missing: Column | None = None) -> Column:
    """Names of the columns whose cells are present in both images and differ, in ordinal order."""

    def one(name: str, kind: str) -> Column:
        apart = differs(old[name], new[name], kind)
        for missing in (old_missing, new_missing):
            if missing is not None:
                apart = apart & ~F.array_contains(missing, name)
        return F.when(apart, F.lit(name))

    return F.filter(F.array(*[one(n, k) for n, k in table.columns]), lambda x: x.isNotNull())


def events_from_snapshot(df: DataFrame, table: TableDef, kind: str, seq: str, prefix: str = "") -> DataFrame:
    """INSERT or DELETE events, one per row of ``df``."""
    if kind not in ("insert", "delete"):
        raise EventBuildError(f"a snapshot has no {kind} events")
    image, none = row_image(table, prefix), F.lit(None).cast(table.row_type())
    return df.select(F.col(seq).cast("long").alias("seq"), image.alias("_image")).select(
        "seq",
        F.lit(table.table_id).alias("table_id"),
        F.lit(kind).alias("kind"),
        pk_map(table, F.col("_image")).alias("pk"),
        (F.col("_image") if kind == "delete" else none).alias("old_row"),
        (F.col("_image") if kind == "insert" else none).alias("new_row"),
        _names().alias("old_missing"),
        _names().alias("new_missing"),
        _names().alias("changed"),
    )


def events_from_pairs(df: DataFrame, table: TableDef, seq: str, old_prefix: str = "old_", new_prefix: str = "new_", partial: Sequence[str] | None = None, derive: bool = True) -> DataFrame:
    """UPDATE events from old and new columns side by side.

    ``partial``: the only columns the old image has; the others are missing
    (``()``: no old image at all).  ``derive``: fill ``changed`` where the old
    image is complete.
    """
    new = row_image(table, new_prefix)
    lacking: list[str] = []
    if partial is None:
        old = row_image(table, old_prefix)
    elif not partial:
        old = F.lit(None).cast(table.row_type())
    else:
        lacking = [n for n, _ in table.columns if n not in partial]
        old = F.struct(*[(F.lit(None) if n in lacking else F.col(f"`{old_prefix}{n}`")).cast(TYPES[t]).alias(n) for n, t in table.columns])
    images = df.select(F.col(seq).cast("long").alias("seq"), old.alias("old_row"), new.alias("new_row"))
    full = derive and partial is None
    changed = changed_columns(table, F.col("old_row"), F.col("new_row")) if full else _names()
    return images.select(
        "seq",
        F.lit(table.table_id).alias("table_id"),
        F.lit("update").alias("kind"),
        pk_map(table, F.col("old_row" if partial is None else "new_row")).alias("pk"),
        "old_row",
        "new_row",
        _names(*[F.lit(x) for x in lacking]).alias("old_missing"),
        _names().alias("new_missing"),
        changed.alias("changed"),
    )


def truncate_events(df: DataFrame, table: TableDef, seq: str) -> DataFrame:
    none = F.lit(None).cast(table.row_type())
    pk = F.create_map().cast("map<string,string>")
    return df.select(F.col(seq).cast("long").alias("seq"), F.lit(table.table_id).alias("table_id"), F.lit("truncate").alias("kind"), pk.alias("pk"), none.alias("old_row"), none.alias("new_row"), *[_names().alias(c) for c in ("old_missing", "new_missing", "changed")])


class EventBuilder:
    """Builds single events by hand; rows are mappings from column to value, absent columns are missing."""

    def __init__(self, table: TableDef, seq: int = 0) -> None:
        self.table, self.seq = table, seq
        self.kind: str | None = None
        self._old: dict | None = None
        self._new: dict | None = None
        self._pk: list[tuple[str, object]] = []
        self._changed: list[str] = []

    def insert(self) -> EventBuilder:
        return self._as("insert")

    def update(self) -> EventBuilder:
        return self._as("update")

    def delete(self) -> EventBuilder:
        return self._as("delete")

    def truncate(self) -> EventBuilder:
        return self._as("truncate")

    def _as(self, kind: str) -> EventBuilder:
        self.kind = kind
        return self

    def old(self, row: dict) -> EventBuilder:
        self._old = self._row(row)
        return self

    def new(self, row: dict) -> EventBuilder:
        self._new = self._row(row)
        return self

    def pk(self, columns: Iterable[str], values: Iterable[object]) -> EventBuilder:
        columns, values = list(columns), list(values)
        if len(columns) != len(values):
            raise EventBuildError("primary key columns and values differ in number")
        if len(set(columns)) != len(columns):
            raise EventBuildError("a primary key column is given twice")
        for c in columns:
            self.table.column_id(c)
        self._pk = list(zip(columns, values, strict=True))
        return self

    def changed(self, columns: Iterable[str]) -> EventBuilder:
        self._changed = list(columns)
        for c in self._changed:
            self.table.column_id(c)
        return self

    def _row(self, row: dict) -> dict:
        for c in row:
            self.table.column_id(c)
        return dict(row)

    def build(self) -> tuple:
        """A row of :func:`event_schema`."""
        needs = {"insert": ("_new",), "update": ("_new",), "delete": ("_old",), "truncate": ()}.get(self.kind or "")
        if needs is None:
            raise EventBuildError("the event has no kind")
        if any(getattr(self, n) is None for n in needs):
            raise EventBuildError(f"an {self.kind} event needs its row image")
        names = [n for n, _ in self.table.columns]
        image = lambda r: None if r is None else tuple(r.get(n) for n in names)
        lacks = lambda r: [] if r is None else [n for n in names if n not in r]
        pk = {c: None if v is None else str(v) for c, v in self._pk}
        return (self.seq, self.table.table_id, self.kind, pk, image(self._old), image(self._new), lacks(self._old), lacks(self._new), self._changed)
