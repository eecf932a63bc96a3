"""Shared steps of the change-message parsers.

Every parser turns messages into the generic event log (``GENERIC``): one row
per change, cells as text by column name.  ``typed_events`` turns the rows of
one table into typed images.  Errors are values: a row with ``error`` set has
no other content, a message with one bad change has only its error, and
``strict`` raises instead.

Cells that are absent from an image are *missing*: they read as NULL and are
listed in ``old_missing`` / ``new_missing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.errors import WalParseError
from weir.model import Catalog, TableDef, changed_columns

#: A change's place: its message's position times this, plus its number in the message (an int).
SEQ_STEP = 10_000_000_000
GENERIC = "msg_id long, idx int, kind string, table_id int, pk map<string,string>, old map<string,string>, new map<string,string>, changed_only boolean, error string"
CELLS = "map<string,string>"
#: Change kinds by format, and the kinds that carry no row change.
KINDS = {
    "wal2json_v1": {"insert": "insert", "update": "update", "delete": "delete", "truncate": "truncate"},
    "wal2json_v2": {"I": "insert", "U": "update", "D": "delete", "T": "truncate"},
    "debezium": {"c": "insert", "r": "insert", "u": "update", "d": "delete", "t": "truncate"},
    "maxwell": {"insert": "insert", "bootstrap-insert": "insert", "update": "update", "delete": "delete"},
}


def lookup(values: dict, key: Column, type_: str) -> Column:
    """``values[key]``, or NULL."""
    if not values:
        return F.lit(None).cast(type_)
    made = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(made, key).cast(type_)


def table_ids(catalog: Catalog, schema: Column, name: Column, fallback: Column | None = None) -> tuple[Column, Column]:
    """(table id, error): ``schema.name`` before ``name``; two ids are ambiguous; the fallback schema is tried for what is unknown."""
    names = catalog.lookup()
    plain = lookup(names, name, "int")

    def full(s: Column) -> Column:
        return F.when(s.isNotNull(), lookup(names, F.concat_ws(".", s, name), "int"))

    first = full(schema)
    ambiguous = first.isNotNull() & plain.isNotNull() & (first != plain)
    found = F.coalesce(first, plain)
    if fallback is not None:
        second = full(fallback)
        found = F.coalesce(first, plain, second)
    error = F.when(ambiguous, "ambiguous_table").when(name.isNull(), "missing_field").when(found.isNull(), "unknown_table")
    return F.when(error.isNull(), found), error


def columns_of(catalog: Catalog, table_id: Column) -> Column:
    """Column names of a table id as an array."""
    made = [x for t in catalog.tables for x in (F.lit(t.table_id), F.array(*[F.lit(n) for n, _ in t.columns]))]
    return F.try_element_at(F.create_map(*made), table_id) if made else F.array().cast("array<string>")


def keys_of(catalog: Catalog, table_id: Column) -> Column:
    made = [x for t in catalog.tables for x in (F.lit(t.table_id), F.array(*[F.lit(n) for n in t.primary_key]).cast("array<string>"))]
    return F.try_element_at(F.create_map(*made), table_id) if made else F.array().cast("array<string>")


def cells(names: Column, values: Column) -> Column:
    """A map from two arrays; NULL where either is."""
    fit = (F.size(names) == F.size(values)) & (F.size(F.array_distinct(names)) == F.size(names)) & ~unnamed(names)
    return F.when(names.isNotNull() & values.isNotNull() & fit, F.map_from_arrays(names, values))


def unnamed(names: Column) -> Column:
    return F.coalesce(F.exists(names, lambda n: n.isNull()), F.lit(False))


#: Names of PostgreSQL types whose cells are integers, floats and booleans; all others are text.
PG_INTS = ("integer", "int", "int2", "int4", "int8", "smallint", "bigint", "serial", "bigserial", "smallserial", "oid")
PG_FLOATS = ("real", "float4", "double precision", "float8", "numeric", "decimal", "money")
PG_BOOLS = ("boolean", "bool")


def pg_type_error(types: Column, values: Column) -> Column:
    """The error of cells that their messages' own type names can't take: arrays are not read, numbers and booleans must be such."""
    lower = lambda t: F.lower(t)

    def bad(t: Column, v: Column) -> Column:
        named = F.when(lower(t).isin(*PG_INTS), to_cell(v, "L").isNull()).when(lower(t).isin(*PG_FLOATS), to_cell(v, "D").isNull()).when(lower(t).isin(*PG_BOOLS), to_cell(v, "B").isNull())
        return v.isNotNull() & F.coalesce(named, F.lit(False))

    # a NULL has no cell to convert
    array = F.exists(F.zip_with(types, values, lambda t, v: F.coalesce(F.startswith(t, F.lit("_")) & v.isNotNull(), F.lit(False))), lambda x: x)
    odd = F.exists(F.zip_with(types, values, bad), lambda x: x)
    return F.when(array, "malformed_payload").when(odd, "type_conversion")


def unknown_columns(catalog: Catalog, table_id: Column, *images: Column) -> Column:
    known = columns_of(catalog, table_id)
    out: Column = F.lit(False)
    for m in images:
        out = out | F.coalesce(F.size(F.array_except(F.map_keys(m), known)) > 0, F.lit(False))
    return out


def primary_key(catalog: Catalog, table_id: Column, row: Column, strict_names: Column | None = None) -> tuple[Column, Column]:
    """(pk, error): the key columns given by name, else those of the catalog, with their cells."""
    names = F.coalesce(F.when(F.size(strict_names) > 0, strict_names), keys_of(catalog, table_id)) if strict_names is not None else keys_of(catalog, table_id)
    names = F.coalesce(names, F.array().cast("array<string>"))
    lacking = F.coalesce(F.exists(names, lambda n: ~F.map_contains_key(row, n)), F.lit(False))
    pk = F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.try_element_at(row, n))))
    return F.when(~lacking & row.isNotNull(), pk).otherwise(F.create_map().cast(CELLS)), F.when(lacking, "missing_primary_key")


def held(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row.

    The optimizer pushes a filter on derived columns below their projection and
    with it all they are made of, so each message would be parsed once for
    every use of a cell in the filter.  It pushes none through a generator.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.explode(F.array(row)).alias("_row")).select("_row.*")


def finish(rows: DataFrame, strict: bool) -> DataFrame:
    """Generic rows; a message with an error is that error alone."""
    clean = rows.select(
        "msg_id",
        "idx",
        *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("kind", "table_id", "pk", "old", "new", "changed_only")],
        "error",
    )
    clean = held(clean)
    if strict:
        bad = clean.where("error IS NOT NULL").select("msg_id", "error").first()
        if bad:
            raise WalParseError(bad["error"], f"message {bad['msg_id']}")
    return clean


def is_tombstone(text: Column) -> Column:
    return F.trim(text) == "null"


def malformed(text: Column) -> Column:
    """Text that is no JSON object."""
    return F.coalesce(~F.startswith(F.ltrim(text), F.lit("{")) | F.try_parse_json(text).isNull(), F.lit(True))


def bad_cell(value: Column, kind: str) -> Column:
    """A cell that its column's type can't take: fractions in integers, overflow, other text."""
    if kind == "S":
        return F.lit(False)
    return value.isNotNull() & to_cell(value, kind).isNull()


def to_cell(value: Column, kind: str) -> Column:
    """Text to a typed cell, NULL where it can't be one."""
    if kind == "S":
        return value
    if kind == "L":
        whole = F.regexp_extract(value, r"^([+-]?\d+)(?:\.0*)?$", 1)
        return F.when(whole != "", whole.try_cast("long"))
    if kind == "B":
        low = F.lower(value)
        return F.when(low.isin("t", "true", "1"), True).when(low.isin("f", "false", "0"), False)
    return value.try_cast("double")


def typed_events(parsed: DataFrame, table: TableDef, strict: bool = False) -> DataFrame:
    """The events of one table with typed images; ``error`` is ``type_conversion`` where a cell doesn't fit.

    ``seq`` orders changes by message and place in it (a decimal, so that neither
    a far position nor a long transaction overflows it).  ``changed`` is derived
    where the old image is complete, or where the format says that the old
    image holds the changed cells only.
    """
    own = parsed.where((F.col("table_id") == table.table_id) & F.col("error").isNull())

    def image(m: str) -> Column:
        made = F.struct(*[to_cell(F.try_element_at(F.col(m), F.lit(n)), k).alias(n) for n, k in table.columns])
        return F.when(F.col(m).isNotNull(), made)

    def lacks(m: str) -> Column:
        names = F.array(*[F.when(~F.map_contains_key(F.col(m), n), F.lit(n)) for n, _ in table.columns])
        return F.when(F.col(m).isNotNull(), F.filter(names, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))

    bad: Column = F.lit(False)
    for m in ("old", "new"):
        for n, k in table.columns:
            bad = bad | F.coalesce(bad_cell(F.try_element_at(F.col(m), F.lit(n)), k), F.lit(False))
    rows = own.select(
        (F.col("msg_id").cast("decimal(20,0)") * F.lit(SEQ_STEP).cast("decimal(11,0)") + F.col("idx")).cast("decimal(38,0)").alias("seq"),
        "table_id",
        "kind",
        "pk",
        image("old").alias("old_row"),
        image("new").alias("new_row"),
        lacks("old").alias("old_missing"),
        lacks("new").alias("new_missing"),
        "changed_only",
        F.when(bad, "type_conversion").alias("error"),
    )
    if strict:
        first = rows.where("error IS NOT NULL").select("seq", "error").first()
        if first:
            raise WalParseError(first["error"], f"event {first['seq']}")
    old, new = F.col("old_row"), F.col("new_row")
    gate = (F.col("kind") == "update") & old.isNotNull() & new.isNotNull() & ((F.size("old_missing") == 0) | F.col("changed_only"))
    changed = F.when(gate, changed_columns(table, old, new, F.col("old_missing"), F.col("new_missing"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("changed", changed).drop("changed_only")


def message_of(seq: str = "seq") -> Column:
    """The position of the message that a change came in."""
    return F.expr(f"`{seq}` div {SEQ_STEP}BD")
