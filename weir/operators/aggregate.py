"""Standing aggregates as signed deltas.

Every event becomes weighted images (+1 new, -1 old); each aggregate query that
an image matches contributes a weighted count and sum.  Deltas are summed per
event and subscription and dropped where they cancel.  A TRUNCATE has no delta:
it starts a new epoch, and consumers begin anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.errors import AggregateUpdateRequiresOldRow, TruncateRequiresReset
from weir.functions.tri import finite
from weir.model import TableDef
from weir.operators.dispatch import FILTER_RUN, FILTERS, _image, _small, _strings, _table, _touched, check_events, grouped, joined, local_frame
from weir.operators.registry import Predicate, Registry
from weir.plans.compile import matches, predicate

AGG_KIND = {"count": "count", "count_column": "count", "sum": "sum", "avg": "avg"}
DELTAS = "seq long, subscription_id long, consumer_id long, agg_kind string, count_delta long, sum_delta double"


def weighted_rows(events: DataFrame, strict: bool = False) -> DataFrame:
    """``events`` exploded to (weight, row): the images an aggregate gains and loses.

    An UPDATE without a complete old image, and a TRUNCATE, have no weighted
    rows; ``strict`` raises for them.
    """
    if strict:
        bad = events.where("kind = 'truncate' OR kind = 'update' AND (old_row IS NULL OR size(old_missing) > 0)").select("seq", "kind").first()
        if bad:
            raise (TruncateRequiresReset if bad["kind"] == "truncate" else AggregateUpdateRequiresOldRow)(f"event {bad['seq']}")
    gain, lose = F.struct(F.lit(1).alias("weight"), F.col("new_row").alias("row")), F.struct(F.lit(-1).alias("weight"), F.col("old_row").alias("row"))
    complete = F.col("old_row").isNotNull() & (F.size("old_missing") == 0)
    images = F.when(F.col("kind") == "insert", F.array(gain)).when(F.col("kind") == "delete", F.array(lose)).when((F.col("kind") == "update") & complete, F.array(lose, gain))
    return events.select("seq", "kind", "changed", F.explode(images).alias("_w")).select("seq", "kind", "changed", "_w.weight", "_w.row")


def contribution(p: Predicate, table: TableDef) -> tuple[Column, Column]:
    """(count, sum) that one image adds to an aggregate, without its weight."""
    if p.projection.kind == "count":
        return F.lit(1).cast("long"), F.lit(0.0)
    value, kind = _image("row")(p.projection.column), table.types[p.projection.column]
    if p.projection.kind == "count_column":
        return value.isNotNull().cast("long"), F.lit(0.0)
    ok = finite(value, kind)
    total = F.when(ok, value.cast("double")).otherwise(F.lit(0.0))
    return (ok.cast("long") if p.projection.kind == "avg" else F.lit(0).cast("long")), total


def needs_old(events: DataFrame) -> DataFrame:
    """Events that aggregates can't follow, with the error a strict run raises."""
    bad = F.when(F.col("kind") == "truncate", TruncateRequiresReset.code).when((F.col("kind") == "update") & (F.col("old_row").isNull() | (F.size("old_missing") > 0)), AggregateUpdateRequiresOldRow.code)
    return events.select("seq", bad.alias("error")).where("error IS NOT NULL")


def aggregate_deltas(events: DataFrame, registry: Registry, table_id: int, strict: bool = False) -> DataFrame:
    """Non-zero deltas per event and subscription."""
    table = _table(registry, table_id)
    images = weighted_rows(check_events(events, table, strict), strict)
    spark = events.sparkSession
    predicates = registry.of_table(table_id, aggregate=True)
    parts = []
    singles: list[Predicate] = []
    by_use: dict[tuple, list[Predicate]] = {}
    for p in predicates:
        by_use.setdefault((p.projection.kind, p.projection.column), []).append(p)
    for used in by_use.values():
        groups = grouped(used)
        singles += [p for g in groups if len(g.members) <= FILTERS for p, _ in g.members]
        count, total = contribution(used[0], table)
        for found in joined(images, "row", [g for g in groups if len(g.members) > FILTERS]):
            parts.append(found.select("seq", "predicate_id", (F.col("weight") * count).alias("c"), (F.col("weight") * total).alias("s")))
    for k in range(0, len(singles), FILTER_RUN):

        def one(p: Predicate) -> Column:
            count, total = contribution(p, table)
            hit = _touched(_strings(p.deps)) & matches(p.where, table, _image("row"))
            return F.when(hit, F.struct(F.lit(p.predicate_id).cast("long").alias("predicate_id"), (F.col("weight") * count).alias("c"), (F.col("weight") * total).alias("s")))

        found = F.filter(F.array(*[one(p) for p in singles[k : k + FILTER_RUN]]), lambda x: x.isNotNull())
        parts.append(images.select("seq", F.explode(found).alias("h")).select("seq", "h.predicate_id", "h.c", "h.s"))
    if not parts:
        return spark.createDataFrame([], DELTAS.replace("consumer_id long", f"consumer_id {registry.consumer_type}"))
    rows = [(b.predicate_id, b.subscription_id, b.consumer_id, AGG_KIND[registry.by_id[b.predicate_id].projection.kind]) for b in registry.bindings.values() if registry.by_id[b.predicate_id].table.table_id == table_id and registry.by_id[b.predicate_id].projection.kind != "rows"]
    bound = _small(local_frame(spark, rows, f"predicate_id long, subscription_id long, consumer_id {registry.consumer_type}, agg_kind string"), len(rows))
    sums = reduce(DataFrame.unionByName, parts).groupBy("seq", "predicate_id").agg(F.sum("c").cast("long").alias("count_delta"), F.sum("s").alias("sum_delta"))
    return sums.where("count_delta <> 0 OR sum_delta <> 0").join(bound, "predicate_id").select("seq", "subscription_id", "consumer_id", "agg_kind", "count_delta", "sum_delta")


def consumer_deltas(deltas: DataFrame) -> DataFrame:
    """Deltas of a consumer's subscriptions of one kind added together."""
    summed = deltas.groupBy("seq", "consumer_id", "agg_kind").agg(F.sum("count_delta").alias("count_delta"), F.sum("sum_delta").alias("sum_delta"))
    return summed.where("count_delta <> 0 OR sum_delta <> 0")


def bootstrap(rows: DataFrame, registry: Registry, table_id: int) -> DataFrame:
    """Totals of every aggregate subscription over the rows of a table: (subscription_id, consumer_id, agg_kind, count_total, sum_total)."""
    table = _table(registry, table_id)
    image = rows.select(F.struct(*[F.col(f"`{n}`").alias(n) for n, _ in table.columns]).alias("row"))
    spark, parts = rows.sparkSession, []
    predicates = registry.of_table(table_id, aggregate=True)
    sums = []
    for p in predicates:
        count, total = contribution(p, table)
        hit = F.coalesce(predicate(p.where, table, _image("row")), F.lit(False))
        sums += [F.coalesce(F.sum(F.when(hit, count)), F.lit(0)).cast("long").alias(f"c{p.predicate_id}"), F.coalesce(F.sum(F.when(hit, total)), F.lit(0.0)).alias(f"s{p.predicate_id}")]
    if not predicates:
        return spark.createDataFrame([], f"subscription_id long, consumer_id {registry.consumer_type}, agg_kind string, count_total long, sum_total double")
    one = image.agg(*sums)
    parts = F.array(*[F.struct(F.lit(p.predicate_id).cast("long").alias("predicate_id"), F.col(f"c{p.predicate_id}").alias("count_total"), F.col(f"s{p.predicate_id}").alias("sum_total")) for p in predicates])
    rows_ = [(b.predicate_id, b.subscription_id, b.consumer_id, AGG_KIND[registry.by_id[b.predicate_id].projection.kind]) for b in registry.bindings.values() if b.predicate_id in {p.predicate_id for p in predicates}]
    bound = local_frame(spark, rows_, f"predicate_id long, subscription_id long, consumer_id {registry.consumer_type}, agg_kind string")
    return one.select(F.explode(parts).alias("t")).select("t.*").join(_small(bound, len(rows_)), "predicate_id").select("subscription_id", "consumer_id", "agg_kind", "count_total", "sum_total")


def _span(events: DataFrame, spans: int) -> Column:
    """The number of an event's span: events are cut into ``spans`` by quantiles of seq."""
    cuts = sorted(set(events.approxQuantile("seq", [k / spans for k in range(1, spans)], 0.002) if spans > 1 else []))
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col("seq").cast("double")))


def epochs(events: DataFrame, spans: int = 64) -> DataFrame:
    """Events with their epoch: the truncates of the table before them (a TRUNCATE opens the epoch it is in).

    Truncates are counted within spans of seq, from what the spans before them
    hold, so no event meets a truncate.  An event without a seq comes after all.
    """
    cut = F.when(F.col("kind") == "truncate", 1)
    rows = events.withColumn("_span", F.when(F.col("seq").isNull(), spans).otherwise(_span(events, spans)))
    before = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(F.col("table_id").alias("_of"), F.col("_span").alias("_at")).agg(F.count(cut).alias("_n"))
    held = held.select("_of", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    upto = Window.partitionBy("table_id", "_span").orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(held, (F.col("table_id") == F.col("_of")) & (F.col("_span") == F.col("_at")), "left")
    return out.select(*events.columns, F.coalesce(F.count(cut).over(upto) + F.col("_n"), F.lit(0)).cast("long").alias("epoch"))


def running_totals(deltas: DataFrame, start: DataFrame | None = None, spans: int = 64) -> DataFrame:
    """Deltas with totals up to each event, from bootstrap totals if given; avg is their quotient.

    A subscription's events are cut into ``spans`` by quantiles of seq; totals
    run within each span, from what the spans before it add up to, so no task
    orders all events of a subscription.
    """
    rows = deltas.withColumn("_span", _span(deltas, spans))
    before = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col("subscription_id").alias("_of"), F.col("_span").alias("_at")).agg(F.sum("count_delta").alias("_c"), F.sum("sum_delta").alias("_s"))
    sums = sums.select("_of", "_at", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s"))
    w = Window.partitionBy("subscription_id", "_span").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, (F.col("subscription_id") == F.col("_of")) & (F.col("_span") == F.col("_at")))
    out = out.select(*deltas.columns, (F.sum("count_delta").over(w) + F.col("_c")).alias("count_total"), (F.sum("sum_delta").over(w) + F.col("_s")).alias("sum_total"))
    if start is not None:
        base = start.select("subscription_id", F.col("count_total").alias("c0"), F.col("sum_total").alias("s0"))
        out = out.join(base, "subscription_id", "left").withColumn("count_total", F.col("count_total") + F.coalesce("c0", F.lit(0))).withColumn("sum_total", F.col("sum_total") + F.coalesce("s0", F.lit(0.0))).drop("c0", "s0")
    return out.withColumn("avg_total", F.col("sum_total") / F.nullif("count_total", F.lit(0)))
