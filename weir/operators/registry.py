"""Standing queries: registration, sharing of equal predicates, removal.

The registry lives on the driver; :meth:`Registry.subscriptions` and
:meth:`Registry.predicates` show it as DataFrames.  Equal predicates (same
table, canonical text and projection) are stored once and counted.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weir.errors import RegisterError, TypeMismatch
from weir.model import Catalog, TableDef
from weir.plans import sql as S
from weir.plans.compile import canonical, check, predicate_hash, text

SUM_KINDS = ("sum", "avg")


@dataclass(frozen=True)
class Request:
    """One standing query of a consumer; without ``session_id`` it is durable."""

    consumer_id: int | str
    sql: str
    session_id: int | str | None = None
    updated_at_unix_ms: int = 0


@dataclass(frozen=True)
class Registered:
    subscription_id: int
    table_id: int
    normalized: str
    predicate_hash: str
    created_new_predicate: bool
    projection: S.Projection


@dataclass(frozen=True)
class Removed:
    """What a removal took away."""

    bindings: int = 0
    predicates: int = 0
    consumers: int = 0


@dataclass
class Predicate:
    predicate_id: int
    table: TableDef
    where: object | None
    projection: S.Projection
    hash: str
    normalized: str
    deps: tuple[str, ...]
    refcount: int = 0
    updated_at_unix_ms: int = 0


@dataclass(frozen=True)
class Binding:
    subscription_id: int
    predicate_id: int
    consumer_id: int | str
    session_id: int | str | None
    updated_at_unix_ms: int


@dataclass
class Registry:
    catalog: Catalog
    dialect: str = "postgres"
    #: Spark types of the ids that consumers and sessions bring; subscriptions and predicates are numbered here.
    consumer_type: str = "bigint"
    session_type: str = "bigint"
    on_register: list = field(default_factory=list)  # called with each table whose registrations changed

    def __post_init__(self) -> None:
        self.by_id: dict[int, Predicate] = {}
        self.by_hash: dict[str, int] = {}
        self.bindings: dict[int, Binding] = {}
        self._known: dict[tuple, int] = {}
        self._next_predicate = self._next_subscription = 1
        self.version = 0

    # -- registration
    def compile(self, sql: str) -> tuple[TableDef, object | None, S.Projection]:
        """Table, canonical predicate and projection of a statement, fully checked."""
        statement = S.parse(sql, self.dialect)
        *schema, name = statement.table
        table = self.catalog.resolve(name, ".".join(schema) or None)
        p = statement.projection
        if p.column is not None:
            table.column_id(p.column)
            if p.kind in SUM_KINDS and table.types[p.column] not in ("L", "D"):
                raise TypeMismatch(f"{p.kind} of {p.column}")
        check(statement.where, table)
        return table, canonical(statement.where), p

    def code(self, sql: str) -> str:
        """``ok``, or the code of the error that registering a statement gives.  It doesn't depend on what is registered, and nothing is."""
        try:
            self.compile(sql)
        except RegisterError as e:
            return e.code
        return "ok"

    def register(self, request: Request) -> Registered:
        """Registers one query; the same query of the same consumer and scope gives its first subscription."""
        result = self._add(request)
        self._published({result.table_id})
        return result

    def register_batch(self, requests: Iterable[Request]) -> list[Registered | RegisterError]:
        """Results in input order; a failure doesn't stop the others."""
        out: list[Registered | RegisterError] = []
        for r in requests:
            try:
                out.append(self._add(r))
            except RegisterError as e:
                out.append(e.with_traceback(None))  # its frames hold the parser and all tokens
        self._published({r.table_id for r in out if isinstance(r, Registered)})
        return out

    def _add(self, request: Request) -> Registered:
        table, where, projection = self.compile(request.sql)
        digest = predicate_hash(table, where, projection)
        scope = (request.consumer_id, digest, request.session_id)
        stamp = request.updated_at_unix_ms or int(time.time() * 1000)
        created = digest not in self.by_hash
        if scope in self._known:
            b = self.bindings[self._known[scope]]
            return Registered(b.subscription_id, table.table_id, self.by_id[b.predicate_id].normalized, digest, False, projection)
        if created:
            deps = set(S.columns(where)) | ({projection.column} if projection.column else set())
            p = Predicate(self._next_predicate, table, where, projection, digest, text(where), tuple(sorted(deps)))
            self._next_predicate += 1
            self.by_id[p.predicate_id], self.by_hash[digest] = p, p.predicate_id
        p = self.by_id[self.by_hash[digest]]
        p.refcount += 1
        p.updated_at_unix_ms = max(p.updated_at_unix_ms, stamp)
        b = Binding(self._next_subscription, p.predicate_id, request.consumer_id, request.session_id, stamp)
        self._next_subscription += 1
        self.bindings[b.subscription_id] = b
        self._known[scope] = b.subscription_id
        return Registered(b.subscription_id, table.table_id, p.normalized, digest, created, projection)

    def _published(self, tables: set[int]) -> None:
        if tables:
            self.version += 1
            for hook in self.on_register:
                for t in sorted(tables):
                    hook(t)

    # -- removal
    def unregister(self, subscription_id: int) -> bool:
        return bool(self._remove([subscription_id]).bindings)

    def unregister_session(self, session_id: int | str) -> Removed:
        """All bindings of a session; durable ones stay."""
        return self._remove([s for s, b in self.bindings.items() if b.session_id == session_id and session_id is not None])

    def unregister_query(self, consumer_id: int | str, sql: str) -> Removed:
        """A consumer's bindings of one query, in any scope."""
        table, where, projection = self.compile(sql)
        found = self.by_hash.get(predicate_hash(table, where, projection))
        return self._remove([s for s, b in self.bindings.items() if (b.consumer_id, b.predicate_id) == (consumer_id, found)])

    def _remove(self, subscriptions: list[int]) -> Removed:
        consumers = {b.consumer_id for b in self.bindings.values()}
        gone = predicates = 0
        for s in subscriptions:
            b = self.bindings.pop(s, None)
            if b is None:
                continue
            gone += 1
            p = self.by_id[b.predicate_id]
            self._known.pop((b.consumer_id, p.hash, b.session_id), None)
            p.refcount -= 1
            if not p.refcount:
                predicates += 1
                del self.by_id[p.predicate_id], self.by_hash[p.hash]
        if gone:
            self.version += 1
        return Removed(gone, predicates, len(consumers - {b.consumer_id for b in self.bindings.values()}))

    # -- views
    def predicate_count(self, table_id: int) -> int:
        return sum(p.table.table_id == table_id for p in self.by_id.values())

    def subscription_count(self) -> int:
        return len(self.bindings)

    def of_table(self, table_id: int, aggregate: bool) -> list[Predicate]:
        return [p for p in self.by_id.values() if p.table.table_id == table_id and (p.projection.kind != "rows") == aggregate]

    def predicates(self, spark: SparkSession) -> DataFrame:
        rows = [(p.predicate_id, p.table.table_id, p.hash, p.normalized, list(p.deps), p.projection.kind, p.projection.column, p.refcount, p.updated_at_unix_ms) for p in self.by_id.values()]
        return spark.createDataFrame(rows, "predicate_id long, table_id int, hash string, normalized string, deps array<string>, projection string, agg_column string, refcount long, updated_at_unix_ms long")

    def subscriptions(self, spark: SparkSession) -> DataFrame:
        rows = [(b.subscription_id, b.predicate_id, b.consumer_id, b.session_id, b.updated_at_unix_ms) for b in self.bindings.values()]
        return spark.createDataFrame(rows, f"subscription_id long, predicate_id long, consumer_id {self.consumer_type}, session_id {self.session_type}, updated_at_unix_ms long")


def codes(statements: DataFrame, registry: Registry) -> DataFrame:
    """(statement, code) of rows (statement, sql), judged by the tasks that hold them; no SQL has no code."""
    catalog, dialect = registry.catalog, registry.dialect

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Registry(catalog, dialect)
        for b in batches:
            found = [None if sql is None else judge.code(sql) for sql in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.string())], names=["statement", "code"])

    key = statements.schema["statement"].dataType.simpleString()
    return statements.select("statement", "sql").mapInArrow(judged, f"statement {key}, code string")
