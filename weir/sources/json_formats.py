"""wal2json (v1, v2), Debezium and Maxwell messages.

All are ``from_json`` over a fixed envelope with rows as ``map<string,string>``,
so parsing stays in the JVM and works on batch and streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.model import Catalog
from weir.sources import common as C

_SET = "struct<keynames:array<string>,keytypes:array<string>,keyvalues:array<string>>"
V1 = f"struct<xid:bigint,change:array<struct<kind:string,schema:string,table:string,columnnames:array<string>,columntypes:array<string>,columnvalues:array<string>,oldkeys:{_SET}>>>"
_NAMED = "array<struct<name:string,type:string,value:string>>"
V2 = f"struct<action:string,schema:string,`table`:string,columns:{_NAMED},identity:{_NAMED},pk:array<struct<name:string,type:string>>>"
DEBEZIUM = "struct<before:map<string,string>,after:map<string,string>,source:struct<connector:string,db:string,schema:string,`table`:string>,op:string,ts_ms:bigint>"
MAXWELL = "struct<database:string,`table`:string,type:string,data:map<string,string>,old:map<string,string>,primary_key_columns:array<string>,ts:bigint,xid:bigint,commit:boolean>"



def _messages(messages: DataFrame, schema: str) -> DataFrame:
    """Messages without tombstones: the parsed envelope ``m`` and the JSON error ``_bad``."""
    rows = messages.select("msg_id", F.col("value").cast("string").alias("_text"))
    rows = C.held(rows).where(~F.coalesce(C.is_tombstone(F.col("_text")), F.lit(False)))
    bad = F.when(C.malformed(F.col("_text")), F.lit("json")).alias("_bad")
    return C.held(rows.select("msg_id", bad, F.from_json("_text", schema).alias("m")))


def _checked(rows: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds the errors of unknown columns."""
    found = C.unknown_columns(catalog, F.col("table_id"), F.col("old"), F.col("new"))
    return rows.withColumn("error", F.coalesce("error", F.when(found, "unknown_column")))


def wal2json_v1(messages: DataFrame, catalog: Catalog, strict: bool = False) -> DataFrame:
    """One message is one transaction of many changes; an unknown kind drops its change, an error its message.

    A message's changes are judged as an array, before they become rows, so
    that batches and streams see the same and no message is read twice.
    """

    def read(c: Column, idx: Column) -> Column:
        kind = C.lookup(C.KINDS["wal2json_v1"], c["kind"], "string")
        table_id, table_error = C.table_ids(catalog, c["schema"], c["table"])
        names, values, types, keys = c["columnnames"], c["columnvalues"], c["columntypes"], c["oldkeys"]
        new = F.when(kind.isin("insert", "update"), C.cells(names, values))
        old = F.when(kind.isin("update", "delete") & keys.isNotNull(), C.cells(keys["keynames"], keys["keyvalues"]))
        lacking = kind.isin("insert", "update") & (names.isNull() | C.unnamed(names)) | (kind == "delete") & keys.isNull() | C.unnamed(keys["keynames"])
        lengths = (F.size(names) != F.size(values)) | (names.isNotNull() & types.isNotNull() & (F.size(names) != F.size(types))) | (keys.isNotNull() & (F.size(keys["keynames"]) != F.size(keys["keyvalues"])))
        twice = (F.size(F.array_distinct(names)) < F.size(names)) | (F.size(F.array_distinct(keys["keynames"])) < F.size(keys["keynames"]))
        typed = F.coalesce(C.pg_type_error(types, values), C.pg_type_error(keys["keytypes"], keys["keyvalues"]))
        error = F.coalesce(table_error, F.when(lacking, "missing_field"), F.when(lengths, "array_length_mismatch"), F.when(twice, "duplicate_column"), typed)
        return F.struct(idx.alias("idx"), kind.alias("kind"), table_id.alias("table_id"), old.alias("old"), new.alias("new"), error.alias("error"))

    def judged(c: Column) -> Column:
        unknown = C.unknown_columns(catalog, c["table_id"], c["old"], c["new"])
        own, own_error = C.primary_key(catalog, c["table_id"], c["new"])
        truncate = c["kind"] == "truncate"
        pk = F.when(c["old"].isNotNull(), c["old"]).when(truncate, F.create_map().cast(C.CELLS)).otherwise(own)
        error = F.coalesce(c["error"], F.when(unknown, "unknown_column"), F.when(c["old"].isNull() & ~truncate, own_error))
        return F.struct(*[c[x].alias(x) for x in ("idx", "kind", "table_id")], pk.alias("pk"), c["old"].alias("old"), c["new"].alias("new"), error.alias("error"))

    rows = _messages(messages, V1)
    changes = F.filter(F.transform("m.change", read), lambda c: c["kind"].isNotNull())
    rows = C.held(rows.select("msg_id", F.coalesce("_bad", F.when(F.col("m.change").isNull(), "missing_field")).alias("_whole"), changes.alias("c")))
    rows = C.held(rows.select("msg_id", "_whole", F.transform("c", judged).alias("c")))
    first = F.get(F.filter("c", lambda c: c["error"].isNotNull()), 0)["error"]
    each = rows.select("msg_id", F.coalesce("_whole", first).alias("error"), F.explode(F.when(F.col("_whole").isNull(), F.col("c")).otherwise(F.array(F.lit(None)))).alias("c"))
    return C.finish(each.select("msg_id", F.coalesce("c.idx", F.lit(0)).alias("idx"), "c.kind", "c.table_id", "c.pk", "c.old", "c.new", F.lit(False).alias("changed_only"), "error"), strict)


def wal2json_v2(messages: DataFrame, catalog: Catalog, strict: bool = False) -> DataFrame:
    """One message is one change; transaction marks and unknown actions are skipped."""
    rows = _messages(messages, V2)
    kind = C.lookup(C.KINDS["wal2json_v2"], F.col("m.action"), "string")
    lack = F.when(F.col("_bad").isNull() & F.col("m.action").isNull(), "missing_field")
    rows = rows.withColumn("kind", kind).withColumn("_lack", lack).where("_bad IS NOT NULL OR _lack IS NOT NULL OR kind IS NOT NULL")
    table_id, table_error = C.table_ids(catalog, F.col("m.schema"), F.col("m.table"))
    name = lambda a: F.transform(a, lambda x: x["name"])
    value = lambda a: F.transform(a, lambda x: x["value"])
    columns, identity = F.col("m.columns"), F.col("m.identity")
    new = F.when(F.col("kind").isin("insert", "update"), C.cells(name(columns), value(columns)))
    old = F.when(F.col("kind").isin("update", "delete") & identity.isNotNull(), C.cells(name(identity), value(identity)))
    twice = lambda a: F.size(F.array_distinct(name(a))) < F.size(a)
    none = C.unnamed(name(columns)) | C.unnamed(name(identity))
    lacking = F.when(F.col("kind").isin("insert", "update") & columns.isNull() | (F.col("kind") == "delete") & identity.isNull() | none, "missing_field")
    type_ = lambda a: F.transform(a, lambda x: x["type"])
    typed = F.coalesce(C.pg_type_error(type_(columns), value(columns)), C.pg_type_error(type_(identity), value(identity)))
    error = F.coalesce("_bad", "_lack", table_error, lacking, F.when(twice(columns) | twice(identity), "duplicate_column"), typed)
    rows = _checked(rows.withColumn("table_id", table_id).withColumn("new", new).withColumn("old", old).withColumn("error", error), catalog)
    source = F.when(F.col("kind") == "insert", F.col("new")).when(F.col("kind") != "truncate", F.coalesce("old", "new"))
    pk, pk_error = C.primary_key(catalog, F.col("table_id"), source, name(F.col("m.pk")))
    rows = rows.withColumn("pk", pk).withColumn("error", F.coalesce("error", F.when(F.col("kind") != "truncate", pk_error)))
    return C.finish(rows.select("msg_id", F.lit(0).alias("idx"), "kind", "table_id", "pk", "old", "new", F.lit(False).alias("changed_only"), "error"), strict)


def _map_rows(rows: DataFrame, catalog: Catalog, table_id: Column, table_error: Column, new: Column, old: Column, key_names: Column | None, changed_only: bool, strict: bool) -> DataFrame:
    """The path that map-shaped formats share: kind, table, rows, key, event."""
    rows = rows.withColumn("table_id", table_id).withColumn("new", new).withColumn("old", old)
    lacking = F.when(F.col("kind").isin("insert", "update") & F.col("new").isNull() | (F.col("kind") == "delete") & F.col("old").isNull(), "missing_field")
    rows = _checked(rows.withColumn("error", F.coalesce("_bad", "_lack", table_error, lacking)), catalog)
    complete = F.col("old").isNotNull() & (F.size(F.array_except(C.columns_of(catalog, F.col("table_id")), F.map_keys("old"))) == 0)
    source = F.when(F.col("kind") == "delete", F.col("old")).when((F.col("kind") == "update") & complete, F.col("old")).when(F.col("kind") != "truncate", F.col("new"))
    pk, pk_error = C.primary_key(catalog, F.col("table_id"), source, key_names)
    rows = rows.withColumn("pk", pk).withColumn("error", F.coalesce("error", F.when(F.col("kind") != "truncate", pk_error)))
    return C.finish(rows.select("msg_id", F.lit(0).alias("idx"), "kind", "table_id", "pk", "old", "new", F.lit(changed_only).alias("changed_only"), "error"), strict)


def debezium(messages: DataFrame, catalog: Catalog, strict: bool = False) -> DataFrame:
    """Unwrapped envelopes; ``schema.table`` is tried before ``db.table``; message records are skipped."""
    rows = _messages(messages, DEBEZIUM)
    kind = C.lookup(C.KINDS["debezium"], F.col("m.op"), "string")
    lack = F.when(F.col("_bad").isNull() & (F.col("m.op").isNull() | F.col("m.source").isNull()), "missing_field")
    rows = rows.withColumn("kind", kind).withColumn("_lack", lack).where("_bad IS NOT NULL OR _lack IS NOT NULL OR kind IS NOT NULL")
    table_id, table_error = C.table_ids(catalog, F.col("m.source.schema"), F.col("m.source.table"), F.col("m.source.db"))
    new = F.when(F.col("kind").isin("insert", "update"), F.col("m.after"))
    old = F.when(F.col("kind").isin("update", "delete"), F.col("m.before"))
    return _map_rows(rows, catalog, table_id, table_error, new, old, None, False, strict)


def maxwell(messages: DataFrame, catalog: Catalog, strict: bool = False) -> DataFrame:
    """Maxwell rows: the old image of an update holds the changed cells only, that of a delete is its data."""
    rows = _messages(messages, MAXWELL)
    kind = C.lookup(C.KINDS["maxwell"], F.col("m.type"), "string")
    lack = F.when(F.col("_bad").isNull() & (F.col("m.type").isNull() | F.col("m.table").isNull()), "missing_field")
    rows = rows.withColumn("kind", kind).withColumn("_lack", lack).where("_bad IS NOT NULL OR _lack IS NOT NULL OR kind IS NOT NULL")
    table_id, table_error = C.table_ids(catalog, F.col("m.database"), F.col("m.table"))
    new = F.when(F.col("kind").isin("insert", "update"), F.col("m.data"))
    old = F.when(F.col("kind") == "update", F.col("m.old")).when(F.col("kind") == "delete", F.col("m.data"))
    return _map_rows(rows, catalog, table_id, table_error, new, old, F.col("m.primary_key_columns"), True, strict)


PARSERS = {"wal2json_v1": wal2json_v1, "wal2json_v2": wal2json_v2, "debezium": debezium, "maxwell": maxwell}
