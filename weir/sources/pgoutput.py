"""The pgoutput binary protocol.

It is stateful: a Relation message describes the table that later messages
refer to by number.  Relation messages are few; those that change something are
found first and sent to every task, and each change looks up the last one
before its position, so the messages of one slot are decoded in parallel.  Only
where they are too many for that (``MAX_VERSIONS``, or more tables in a slot
than its cache holds), or in a stream, a slot's messages are sorted by position
and decoded as a stream, with one slot's relations in memory.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.errors import AmbiguousTable, UnknownColumn, UnknownTable, WalParseError
from weir.model import Catalog, TableDef
from weir.ship import ship
from weir.sources.common import GENERIC, finish

MAX_RELATIONS = 65_536
MAX_VERSIONS = 100_000
#: Type numbers with cells other than text, and messages that carry no row change.
BOOL_OIDS, INT_OIDS, FLOAT_OIDS = frozenset({16}), frozenset({20, 21, 23, 26}), frozenset({700, 701, 1700})
CONTROL = frozenset(b"BCOYMSEcAPKrbp")
I64 = (-(1 << 63), (1 << 63) - 1)


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise WalParseError("malformed_payload", "the message ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise WalParseError("malformed_payload", "a name has no end")
        raw = self.take(end - self.at)
        self.at += 1
        return _utf8(raw)

    def done(self) -> None:
        if self.at != len(self.data):
            raise WalParseError("malformed_payload", "bytes after the message")


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        raise WalParseError("utf8", str(e)) from None


@dataclass(frozen=True)
class Relation:
    table: TableDef
    columns: tuple[str, ...]
    oids: tuple[int, ...]
    identity: tuple[int, ...]


class RelationCache:
    """At most ``limit`` relations; the one inserted longest ago goes first, inserting anew refreshes."""

    def __init__(self, limit: int = MAX_RELATIONS) -> None:
        self.limit, self.rows = limit, OrderedDict()

    def put(self, oid: int, relation: Relation) -> None:
        self.rows.pop(oid, None)
        self.rows[oid] = relation
        if len(self.rows) > self.limit:
            self.rows.popitem(last=False)

    def get(self, oid: int) -> Relation | None:
        return self.rows.get(oid)


_MISSING = object()


class Decoder:
    """Decodes one slot's messages in order; each gives a list of (kind, table_id, pk, old, new) with cells as text."""

    def __init__(self, catalog: Catalog, unchanged_is_missing: bool = False) -> None:
        self.catalog, self.cache, self.lenient = catalog, RelationCache(), unchanged_is_missing

    def decode(self, data: bytes) -> list[tuple]:
        if not data:
            return []
        r = _Reader(data[1:])
        made = {ord("R"): self._relation, ord("I"): self._insert, ord("U"): self._update, ord("D"): self._delete, ord("T"): self._truncate}.get(data[0])
        if made is None:
            return []
        out = made(r)
        r.done()
        return out

    def _relation(self, r: _Reader) -> list:
        oid, schema, name = r.number(">I"), r.text(), r.text()
        r.number(">B")
        names, oids, identity = [], [], []
        for k in range(r.number(">h")):
            flags, column = r.number(">B"), r.text()
            names.append(column)
            oids.append(r.number(">I"))
            r.number(">i")
            if flags & 1:
                identity.append(k)
        try:
            table = self.catalog.resolve(name, schema or None)
            for c in names:
                table.column_id(c)
        except AmbiguousTable as e:
            raise WalParseError("ambiguous_table", str(e)) from None
        except UnknownTable as e:
            raise WalParseError("unknown_table", str(e)) from None
        except UnknownColumn as e:
            raise WalParseError("unknown_column", str(e)) from None
        if len(set(names)) < len(names):
            raise WalParseError("duplicate_column", name)
        self.cache.put(oid, Relation(table, tuple(names), tuple(oids), tuple(identity)))
        return []

    def _known(self, oid: int) -> Relation:
        found = self.cache.get(oid)
        if found is None:
            raise WalParseError("unknown_table", f"relation {oid}")
        return found

    def _cells(self, r: _Reader, old: bool) -> list:
        out = []
        for _ in range(r.number(">h")):
            tag = r.take(1)
            if tag == b"n":
                out.append(None)
            elif tag == b"t":
                out.append(_utf8(r.take(r.number(">i"))))
            elif tag == b"u":
                if not (old or self.lenient):
                    raise WalParseError("malformed_payload", "an unchanged cell in a new row")
                out.append(_MISSING)
            else:
                raise WalParseError("malformed_payload", f"cell tag {tag!r}")
        return out

    def _image(self, rel: Relation, names: list[str], oids: list[int], cells: list) -> dict:
        return {n: _typed(c, o) for n, o, c in zip(names, oids, cells, strict=True) if c is not _MISSING}

    def _full(self, rel: Relation, r: _Reader, old: bool) -> dict:
        cells = self._cells(r, old)
        if len(cells) != len(rel.columns) or len(cells) != rel.table.arity:
            raise WalParseError("malformed_payload", "a row of another width")
        return self._image(rel, rel.columns, rel.oids, cells)

    def _key(self, rel: Relation, r: _Reader) -> dict:
        cells = self._cells(r, True)
        if rel.identity and len(cells) == len(rel.identity):
            at = rel.identity
        elif len(cells) == len(rel.columns):
            at = range(len(cells))
        else:
            raise WalParseError("malformed_payload", "a key of another width")
        full = len(cells) == len(rel.columns) and len(rel.identity) not in (0, len(cells))
        named = {rel.columns[k]: (c, rel.oids[k]) for k, c in zip(at, cells, strict=True)}
        if full:  # a key tuple as wide as the row is NULL outside the key
            named = {rel.columns[k]: named[rel.columns[k]] for k in rel.identity}
        return {n: _typed(c, o) for n, (c, o) in named.items() if c is not _MISSING}

    def _pk(self, rel: Relation, old: dict | None, new: dict | None) -> dict:
        if old is not None:
            names = [rel.columns[k] for k in rel.identity] or list(old)
            return {n: old[n] for n in names if n in old}
        return {n: (new or {}).get(n) for n in rel.table.primary_key}

    def _insert(self, r: _Reader) -> list:
        rel = self._known(r.number(">I"))
        if r.take(1) != b"N":
            raise WalParseError("malformed_payload", "a new row expected")
        new = self._full(rel, r, False)
        return [("insert", rel.table.table_id, self._pk(rel, None, new), None, new)]

    def _update(self, r: _Reader) -> list:
        rel, old = self._known(r.number(">I")), None
        tag = r.take(1)
        if tag in (b"K", b"O"):
            old = self._key(rel, r) if tag == b"K" else self._full(rel, r, True)
            tag = r.take(1)
        if tag != b"N":
            raise WalParseError("malformed_payload", "a new row expected")
        new = self._full(rel, r, False)
        return [("update", rel.table.table_id, self._pk(rel, old, new), old, new)]

    def _delete(self, r: _Reader) -> list:
        rel, tag = self._known(r.number(">I")), r.take(1)
        if tag not in (b"K", b"O"):
            raise WalParseError("malformed_payload", "an old row expected")
        old = self._key(rel, r) if tag == b"K" else self._full(rel, r, True)
        return [("delete", rel.table.table_id, self._pk(rel, old, None), old, None)]

    def _truncate(self, r: _Reader) -> list:
        count = r.number(">i")
        r.number(">B")
        oids = [r.number(">I") for _ in range(count)]
        known = [self.cache.get(o) for o in oids]
        return [("truncate", k.table.table_id, {}, None, None) for k in known if k is not None]


def _typed(cell: str | None, oid: int) -> str | None:
    """Checks a cell's text against its type number; booleans become true and false."""
    if cell is None:
        return None
    try:
        if oid in BOOL_OIDS:
            return {"t": "true", "f": "false"}[cell]
        if oid in INT_OIDS and not I64[0] <= int(cell) <= I64[1]:
            raise ValueError(cell)
        if oid in FLOAT_OIDS:
            float(cell)
    except (KeyError, ValueError):
        raise WalParseError("type_conversion", cell) from None
    return cell


class Versions:
    """The relations of all slots by position: what a message at a position refers to is the last one before it."""

    def __init__(self, catalog: Catalog, rows: list[tuple[str | None, int, int, bytes]]) -> None:
        self.at: dict[tuple, tuple[list[int], list[Relation]]] = {}
        decoder = Decoder(catalog)
        for slot, oid, msg_id, value in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
            decoder.decode(value)
            where, made = self.at.setdefault((slot, oid), ([], []))
            where.append(msg_id)
            made.append(decoder.cache.get(oid))
        self.slot, self.msg_id = None, 0

    def get(self, oid: int) -> Relation | None:
        where, made = self.at.get((self.slot, oid), ((), ()))
        k = bisect_left(where, self.msg_id)
        return made[k - 1] if k else None

    def put(self, oid: int, relation: Relation) -> None:
        """Known already."""


def _relation_versions(messages: DataFrame, catalog: Catalog) -> list[tuple] | None:
    """(slot, oid, position, message) of the Relation messages that change something; None where a stream must be decoded in order.

    That is where they are many, or where a slot has so many that the cache would drop some.
    """

    def valid(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for slot, msg_id, value in zip(frame["slot"], frame["msg_id"], frame["value"], strict=True):
                try:
                    Decoder(catalog).decode(bytes(value))
                    rows.append((slot, struct.unpack(">I", bytes(value)[1:5])[0], msg_id, value))
                except WalParseError:  # reported where messages are decoded
                    continue
            yield pd.DataFrame(rows, columns=["slot", "oid", "msg_id", "value"])

    found = messages.where(F.substring("value", 1, 1) == F.lit(bytearray(b"R"))).mapInPandas(valid, "slot string, oid long, msg_id long, value binary")
    before = F.lag("value").over(Window.partitionBy("slot", "oid").orderBy("msg_id"))
    rows = found.withColumn("before", before).where("before IS NULL OR before <> value").drop("before").limit(MAX_VERSIONS + 1).collect()
    per_slot = Counter(slot for slot, _ in {(r["slot"], r["oid"]) for r in rows})
    if len(rows) > MAX_VERSIONS or max(per_slot.values(), default=0) > MAX_RELATIONS:
        return None
    return [(r["slot"], r["oid"], r["msg_id"], bytes(r["value"])) for r in rows]


def pgoutput(messages: DataFrame, catalog: Catalog, strict: bool = False, unchanged_is_missing: bool = False) -> DataFrame:
    """Messages (slot, msg_id, value BINARY) to generic rows; msg_id is the position in the slot's log, each once in a slot."""
    spark = ship(messages.sparkSession)
    columns = [c.split()[0] for c in GENERIC.replace("map<string,string>", "m").split(", ")]
    rows = messages.select(F.col("slot").cast("string").alias("slot"), "msg_id", "value")
    known = None if messages.isStreaming else _relation_versions(rows, catalog)
    shared = None if known is None else spark.sparkContext.broadcast(known)  # at most MAX_VERSIONS messages

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, decoder = None, Decoder(catalog, unchanged_is_missing)
        versions = None if shared is None else Versions(catalog, shared.value)
        if versions is not None:
            decoder.cache = versions
        for frame in frames:
            out = []
            for s, msg_id, value in zip(frame["slot"], frame["msg_id"], frame["value"], strict=True):
                if versions is not None:
                    versions.slot, versions.msg_id = s, msg_id
                elif s != slot:
                    slot, decoder = s, Decoder(catalog, unchanged_is_missing)
                try:
                    made = decoder.decode(bytes(value or b""))
                    out += [(msg_id, k, kind, table, pk, old, new, False, None) for k, (kind, table, pk, old, new) in enumerate(made)]
                except WalParseError as e:
                    out.append((msg_id, 0, None, None, None, None, None, None, e.code))
            yield pd.DataFrame(out, columns=columns).astype({"table_id": "Int32", "changed_only": "boolean"})

    if shared is None:
        rows = rows.repartition("slot").sortWithinPartitions("slot", "msg_id")
    return finish(rows.mapInPandas(run, GENERIC), strict)


# -- encoder, for fixtures and replays


def encode_relation(oid: int, schema: str, name: str, columns: list[tuple[str, int, bool]]) -> bytes:
    """A Relation message; columns are (name, type number, part of the identity)."""
    out = b"R" + struct.pack(">I", oid) + schema.encode() + b"\0" + name.encode() + b"\0d" + struct.pack(">h", len(columns))
    for n, t, key in columns:
        out += struct.pack(">B", key) + n.encode() + b"\0" + struct.pack(">Ii", t, -1)
    return out


def encode_row(cells: list[str | None]) -> bytes:
    out = struct.pack(">h", len(cells))
    for c in cells:
        raw = b"" if c is None else c.encode()
        out += b"n" if c is None else b"t" + struct.pack(">i", len(raw)) + raw
    return out


def encode_change(kind: str, oid: int, new: list | None = None, old: list | None = None, key: bool = False) -> bytes:
    """An Insert, Update or Delete message."""
    out = {"insert": b"I", "update": b"U", "delete": b"D"}[kind] + struct.pack(">I", oid)
    if old is not None:
        out += (b"K" if key else b"O") + encode_row(old)
    return out + (b"N" + encode_row(new) if new is not None else b"")


def encode_truncate(oids: list[int]) -> bytes:
    return b"T" + struct.pack(">iB", len(oids), 0) + b"".join(struct.pack(">I", o) for o in oids)


REPLICA_IDENTITY_SQL = "SELECT relreplident = 'f' AS full_identity FROM pg_class WHERE oid = $1::regclass"
