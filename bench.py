"""Headline benchmarks; prints one JSON line.

Dispatch throughput: every order as an event against 100, 1,000 and 10,000
registrations (45 % equality, 45 % range, 9 % mixed, 1 % without an index, four
fifths of them from hot seeds, consumer ``i mod 5000``), to a no-op sink,
second of two runs.
"""

from __future__ import annotations

import json
import os
import random
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from weir import queries as Q  # noqa: E402
from weir.model import Catalog  # noqa: E402
from weir.operators import aggregate as A  # noqa: E402
from weir.operators import dispatch as D  # noqa: E402
from weir.operators.registry import Registry, Request  # noqa: E402
from weir.ship import ship  # noqa: E402

STATUS = ("F", "O", "P")


def predicate(n: int, seed: int) -> str:
    """The n-th registration's WHERE clause."""
    r = random.Random(seed)
    family, cust, low = n % 100, r.randrange(15_000), r.randrange(1_000, 490_000)
    if family < 45:
        return f"custkey = {cust} AND status = '{r.choice(STATUS)}'" if family % 3 else f"custkey = {cust} OR custkey = {r.randrange(15_000)}"
    if family < 90:
        return f"price BETWEEN {low} AND {low + 500}" if family % 2 else f"price >= {low} AND price < {low + 500} AND custkey > {cust}"
    if family < 99:
        return f"custkey = {cust} AND price > {low} OR status = '{r.choice(STATUS)}' AND price BETWEEN {low} AND {low + 200}"
    return f"price * 2 - custkey > {995_000 + low % 1000} AND priority ILIKE '%urg%'"


def registrations(count: int) -> list[Request]:
    r = random.Random(7)
    seeds = [r.randrange(2048) if r.random() < 0.8 else 10_000 + n for n in range(count)]
    return [Request(n % 5000, f"SELECT * FROM orders WHERE {predicate(s, s)}") for n, s in enumerate(seeds)]


def registry(count: int) -> Registry:
    made = Registry(Catalog([Q.ORDERS]))
    made.register_batch(registrations(count))
    return made


def timed(make: object, runs: int = 2) -> float:
    best = 0.0
    for _ in range(runs):
        began = time.perf_counter()
        out = make()
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()
        best = time.perf_counter() - began
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    table = Q.ORDERS.table_id
    events = Q.inserts(spark, sf_dir).repartition(int(cpus)).persist()
    n_events = events.count()
    updates = Q.updates(spark, sf_dir).repartition(int(cpus)).persist()
    updates.count()
    times: dict[str, float] = {}
    rates: dict[str, float] = {}
    for count in (100, 1_000, 10_000):
        made = registry(count)
        times[f"dispatch_insert_{count}"] = timed(lambda made=made: D.dispatch(events, made, table))
        rates[f"inserts_per_s_{count}"] = round(n_events / times[f"dispatch_insert_{count}"])
    for count in (100, 1_000):
        made = registry(count)
        times[f"dispatch_update_{count}"] = timed(lambda made=made: D.dispatch(updates, made, table))
        rates[f"updates_per_s_{count}"] = round(n_events / times[f"dispatch_update_{count}"])
    sums = Registry(Catalog([Q.ORDERS]))
    sums.register_batch(Request(n, f"SELECT SUM(price) FROM orders WHERE custkey = {n * 7}") for n in range(1_000))
    times["aggregate_deltas_1000"] = timed(lambda: A.aggregate_deltas(events, sums, table))
    times["register_10000"] = timed(lambda: registry(10_000) and None, 1)
    rates["registrations_per_s"] = round(10_000 / times["register_10000"])
    for key in ("d_upd", "a_delta", "s_dbz", "s_w2j1", "s_pgo", "x_merge"):
        times[key] = timed(lambda key=key: Q.QUERIES[key](spark, sf_dir), 1)
    events.unpersist()
    updates.unpersist()
    try:
        from weir.llm.queries import QUERIES as llm
    except ImportError:
        llm = {}
    for key, query in llm.items():
        times[key] = timed(lambda query=query: query(spark, sf_dir), 1)
    print(json.dumps({"metric": "dispatch_insert_10000", "value": times["dispatch_insert_10000"], "unit": "sec", "queries": times, "rates": rates, "events": n_events, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
