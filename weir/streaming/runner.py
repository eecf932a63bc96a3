"""Structured Streaming around the same transforms as batch.

Dispatch has no state, so each micro-batch runs the batch transform against the
registry as it is at that moment.  Running aggregates keep one small state per
subscription.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weir.model import TableDef
from weir.operators.aggregate import aggregate_deltas
from weir.operators.dispatch import dispatch
from weir.operators.registry import Registry
from weir.ship import ship
from weir.sources.common import typed_events

Sink = Callable[[DataFrame, int], Any]


def dispatch_stream(events: DataFrame, registry: Registry, table_id: int, sink: Sink, checkpoint: str, deltas: Sink | None = None) -> StreamingQuery:
    """Feeds ``sink`` with the notifications (and ``deltas`` with the aggregate deltas) of every micro-batch."""

    def batch(frame: DataFrame, batch_id: int) -> None:
        frame = frame.persist()
        try:
            sink(dispatch(frame, registry, table_id), batch_id)
            if deltas is not None:
                deltas(aggregate_deltas(frame, registry, table_id), batch_id)
        finally:
            frame.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def message_stream(messages: DataFrame, parse: Callable, registry: Registry, table: TableDef, sink: Sink, checkpoint: str) -> StreamingQuery:
    """The same from raw change messages (msg_id, value)."""

    def batch(frame: DataFrame, batch_id: int) -> None:
        # parsed once: every group of predicates reads the events again
        events = typed_events(parse(frame, registry.catalog), table).where("error IS NULL").drop("error").persist()
        try:
            sink(dispatch(events, registry, table.table_id), batch_id)
        finally:
            events.unpersist()

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TOTALS = "subscription_id long, seq long, count_total long, sum_total double"


def running_totals_stream(deltas: DataFrame) -> DataFrame:
    """Totals per subscription over a stream of deltas; state is one count and one sum for each."""
    ship(deltas.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, total = state.get if state.exists else (0, 0.0)
        last = -1
        for f in frames:
            count += int(f["count_delta"].sum())
            total += float(f["sum_delta"].sum())
            last = max(last, int(f["seq"].max()))
        state.update((count, total))
        yield pd.DataFrame({"subscription_id": [key[0]], "seq": [last], "count_total": [count], "sum_total": [total]})

    return deltas.groupBy("subscription_id").applyInPandasWithState(step, TOTALS, "count_total long, sum_total double", "update", GroupStateTimeout.NoTimeout)
