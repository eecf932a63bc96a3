"""Registry snapshots as Parquet with a manifest, and their background merge.

A snapshot of one table is a folder ``table_<id>/v<version>`` with its
predicates and bindings; the manifest that names the version is written last, to
the same file system, and swapped in by rename, so a reader sees the old or the
new snapshot whole.
"""

from __future__ import annotations

import json
import tomllib
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from pathlib import Path
from time import perf_counter

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.errors import ConfigError, MergeError, StorageError
from weir.files import Folder
from weir.model import Catalog, TableDef
from weir.operators.registry import Binding, Predicate, Registry
from weir.plans.compile import canonical, check, predicate_hash, text
from weir.plans.sql import Projection, parse_predicate

VERSION = 1
ROTATION_BYTES = 10 << 20
PREDICATE_BYTES, BINDING_BYTES = 1024, 128
PREDICATES = "predicate_id long, hash string, normalized string, projection string, agg_column string, updated_at_unix_ms long"
BINDINGS = "subscription_id long, predicate_id long, hash string, consumer_id long, session_id long, updated_at_unix_ms long"


@dataclass(frozen=True)
class MergeSettings:
    min_shards: int = 5
    interval_s: int = 3600


@dataclass(frozen=True)
class Config:
    """Settings of a stored registry; ``durability`` is required or best_effort."""

    storage_path: str = ""
    rotation_threshold: int = ROTATION_BYTES
    durability: str = "required"
    catalog_url: str = ""
    dialect: str = "postgres"
    merge: MergeSettings = field(default_factory=MergeSettings)

    def validate(self) -> Config:
        if not self.storage_path:
            raise ConfigError("storage_path is empty")
        if self.rotation_threshold <= 0 or self.merge.min_shards < 2 or self.merge.interval_s <= 0:
            raise ConfigError("thresholds must be positive, and merges take two shards at least")
        if self.durability not in ("required", "best_effort"):
            raise ConfigError(f"durability {self.durability}")
        return self


def load_config(path: str) -> Config:
    try:
        raw = tomllib.loads(Path(path).read_text())
        merge = MergeSettings(**raw.pop("merge", {}))
        catalog = raw.pop("catalog", {})
        return Config(**raw, **{k: v for k, v in (("catalog_url", catalog.get("url")), ("dialect", catalog.get("dialect"))) if v is not None}, merge=merge).validate()
    except (OSError, tomllib.TOMLDecodeError, TypeError) as e:
        raise ConfigError(str(e)) from e


def save_config(config: Config, path: str) -> None:
    config.validate()
    quote = json.dumps
    lines = [f"storage_path = {quote(config.storage_path)}", f"rotation_threshold = {config.rotation_threshold}", f"durability = {quote(config.durability)}", "", "[catalog]", f"url = {quote(config.catalog_url)}", f"dialect = {quote(config.dialect)}", "", "[merge]"]
    lines += [f"{k} = {v}" for k, v in asdict(config.merge).items()]
    Path(path).write_text("\n".join(lines) + "\n")


def frames(registry: Registry, spark: SparkSession, table_id: int) -> tuple[DataFrame, DataFrame]:
    """A table's predicates and bindings as they are stored."""
    own = [p for p in registry.by_id.values() if p.table.table_id == table_id]
    ids = {p.predicate_id: p.hash for p in own}
    predicates = [(p.predicate_id, p.hash, p.normalized, p.projection.kind, p.projection.column, p.updated_at_unix_ms) for p in own]
    bindings = [(b.subscription_id, b.predicate_id, ids[b.predicate_id], b.consumer_id, b.session_id, b.updated_at_unix_ms) for b in registry.bindings.values() if b.predicate_id in ids]
    types = BINDINGS.replace("consumer_id long", f"consumer_id {registry.consumer_type}").replace("session_id long", f"session_id {registry.session_type}")
    return spark.createDataFrame(predicates, PREDICATES), spark.createDataFrame(bindings, types)


class Store:
    """Snapshots below a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None) -> None:
        self.spark, self.folder = spark, Folder(spark, path)
        self.config = config or Config(storage_path=path)
        self.jobs: dict[str, tuple[int, Future]] = {}
        self.pool = ThreadPoolExecutor(4)

    # -- write
    def should_rotate(self, registry: Registry, table_id: int) -> bool:
        predicates = [p for p in registry.by_id.values() if p.table.table_id == table_id]
        bindings = sum(p.refcount for p in predicates)
        return PREDICATE_BYTES * len(predicates) + BINDING_BYTES * bindings > self.config.rotation_threshold

    def save(self, registry: Registry, table_id: int) -> dict:
        """Writes a snapshot; the registry is unchanged whatever happens."""
        table = registry.catalog.by_id(table_id)
        predicates, bindings = frames(registry, self.spark, table_id)
        return self._write(table, predicates, bindings)

    def _write(self, table: TableDef, predicates: DataFrame, bindings: DataFrame) -> dict:
        folder, name = f"table_{table.table_id}", f"v{uuid.uuid4().hex}"
        manifest = {"version": VERSION, "table_id": table.table_id, "schema_fingerprint": table.fingerprint(), "data": name}
        try:
            for kind, rows in (("predicates", predicates), ("bindings", bindings)):
                path = self.folder.of(folder, name, kind)
                rows.write.parquet(path)
                manifest[kind] = self.spark.read.parquet(path).count()
        except (OSError, Py4JJavaError, PySparkException) as e:
            raise StorageError(str(e)) from e
        self.folder.write(json.dumps(manifest), folder, "manifest.json")
        return manifest

    def register(self, registry: Registry, request) -> object:  # noqa: ANN001
        """Registers and, past the threshold, saves.  With required durability a failed save undoes a new registration."""
        before = registry.subscription_count()
        result = registry.register(request)
        if self.should_rotate(registry, result.table_id):
            try:
                self.save(registry, result.table_id)
            except Exception as e:
                if self.config.durability == "required":
                    if registry.subscription_count() > before:
                        registry.unregister(result.subscription_id)
                    raise e if isinstance(e, StorageError) else StorageError(str(e)) from e
        return result

    # -- read
    def manifest(self, table: TableDef) -> dict:
        """The validated manifest of a table."""
        place = (f"table_{table.table_id}", "manifest.json")
        if not self.folder.exists(*place):
            raise StorageError(f"table {table.table_id} has no snapshot")
        try:
            found = json.loads(self.folder.read(*place))
        except ValueError as e:
            raise StorageError(f"{self.folder.of(*place)}: {e}") from None
        if found.get("version") != VERSION:
            raise StorageError(f"snapshot version {found.get('version')}")
        if found.get("table_id") != table.table_id:
            raise StorageError(f"the snapshot is of table {found.get('table_id')}, not {table.table_id}")
        if found.get("schema_fingerprint") != table.fingerprint():
            raise StorageError(f"the schema of table {table.table_id} has changed")
        return found

    def read(self, table: TableDef) -> tuple[DataFrame, DataFrame]:
        found = self.manifest(table)
        paths = [self.folder.of(f"table_{table.table_id}", found["data"], k) for k in ("predicates", "bindings")]
        out = [self.spark.read.parquet(path) for path in paths]
        for k, path, df in zip(("predicates", "bindings"), paths, out, strict=True):
            if df.count() != found[k]:
                raise StorageError(f"{path} has not the {found[k]} rows of its manifest")
        return out[0], out[1]

    def load(self, catalog: Catalog, dialect: str = "postgres") -> Registry:
        """A registry with all stored tables; the next ids follow the largest stored ones.  Other folders are ignored."""
        registry = Registry(catalog, dialect)
        for name in self.folder.folders():
            number = name.removeprefix("table_")
            if name.startswith("table_") and number.isdigit() and self.folder.exists(name, "manifest.json"):
                table = catalog.by_id(int(number))
                self._fill(registry, table, *self.read(table))
        return registry

    def _fill(self, registry: Registry, table: TableDef, predicates: DataFrame, bindings: DataFrame) -> None:
        moved = {}
        registry.consumer_type, registry.session_type = (dict(bindings.dtypes)[c] for c in ("consumer_id", "session_id"))
        for r in predicates.orderBy("predicate_id").collect():
            where = canonical(parse_predicate(r["normalized"])) if r["normalized"] else None
            check(where, table)
            projection = Projection(r["projection"], r["agg_column"])
            p = Predicate(registry._next_predicate, table, where, projection, predicate_hash(table, where, projection), text(where), ())
            deps = {n for n in _columns(where)} | ({projection.column} if projection.column else set())
            p.deps, p.updated_at_unix_ms = tuple(sorted(deps)), r["updated_at_unix_ms"]
            registry._next_predicate += 1
            registry.by_id[p.predicate_id], registry.by_hash[p.hash] = p, p.predicate_id
            moved[r["predicate_id"]] = p
        for r in bindings.orderBy("subscription_id").collect():
            p = moved[r["predicate_id"]]
            b = Binding(r["subscription_id"], p.predicate_id, r["consumer_id"], r["session_id"], r["updated_at_unix_ms"])
            registry.bindings[b.subscription_id] = b
            registry._known[(b.consumer_id, p.hash, b.session_id)] = b.subscription_id
            p.refcount += 1
            registry._next_subscription = max(registry._next_subscription, b.subscription_id + 1)

    # -- merge
    def merge_in_background(self, registry: Registry, table_id: int, shards: list[tuple[DataFrame, DataFrame]]) -> str:
        """Starts the merge of several snapshots of one table; returns a job id."""
        job = uuid.uuid4().hex
        self.jobs[job] = (table_id, self.pool.submit(merge_shards, shards))
        return job

    def try_complete(self, registry: Registry, job: str) -> dict | None:
        """None while the job runs; then its report, after the merged snapshot is written with the live bindings only."""
        if job not in self.jobs:
            raise MergeError(f"no job {job}")
        table_id, future = self.jobs[job]
        if not future.done():
            return None
        del self.jobs[job]
        try:
            predicates, bindings, report = future.result()
        except MergeError:
            raise
        except Exception as e:  # a worker that fails concerns its own job only
            raise MergeError(f"the merge failed: {e}") from e
        live_rows = [(b.subscription_id,) for b in registry.bindings.values() if registry.by_id[b.predicate_id].table.table_id == table_id]
        live = self.spark.createDataFrame(live_rows, "subscription_id long")
        lost = live.join(bindings, "subscription_id", "left_anti").first()
        if lost:
            raise MergeError(f"the merge lacks live subscription {lost['subscription_id']}")
        kept = bindings.join(live, "subscription_id", "left_semi")
        used = predicates.join(kept.select("hash").distinct(), "hash", "left_semi")
        self._write(registry.catalog.by_id(table_id), used, kept)
        return report


def _columns(where: object) -> list[str]:
    from weir.plans.sql import columns

    return columns(where)


def merge_shards(shards: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, dict]:
    """Predicates by hash and bindings by subscription, the newest of each; ties go to the higher hash."""
    if not shards:
        raise MergeError("nothing to merge")
    began = perf_counter()
    predicates, bindings = shards[0]
    for p, b in shards[1:]:
        predicates, bindings = predicates.unionByName(p), bindings.unionByName(b)
    clash = predicates.groupBy("hash").agg(F.countDistinct("normalized", "projection", F.coalesce("agg_column", F.lit(""))).alias("n")).where("n > 1").first()
    if clash:
        raise MergeError(f"two predicates share the hash {clash['hash']}")
    newest = Window.partitionBy("hash").orderBy(F.desc("updated_at_unix_ms"), "predicate_id")
    out = predicates.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")
    newest = Window.partitionBy("subscription_id").orderBy(F.desc("updated_at_unix_ms"), F.desc("hash"))
    bound = bindings.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")
    bound = bound.drop("predicate_id").join(out.select("hash", "predicate_id"), "hash").select(*[c.split()[0] for c in BINDINGS.split(", ")])
    total, n, m = predicates.count(), out.count(), bound.count()
    report = {"input_shards": len(shards), "output_predicates": n, "output_bindings": m, "dedup_ratio": (total / n) if n else 1.0, "build_ms": int(1000 * (perf_counter() - began))}
    return out, bound, report
