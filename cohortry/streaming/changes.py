"""Change events keep the realtime segments up to date.

Each stream is a ``foreachBatch`` over distinct ids. The write is keyed by stream and
micro-batch, so a batch replayed after a failure changes nothing a second time.

``engine`` and ``clock`` are functions because facts, definitions and the time are read
afresh per batch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.joins import lookup_join
from ..plans.refresh import SegmentEngine
from ..session import written

Engines = Callable[[], SegmentEngine]
Clock = Callable[[], dt.datetime]

# What a change-log row refers to.
SEGMENT_ROW, CUSTOMER_ROW = "segment", "customer"

_QUERY_ID = "sql.streaming.queryId"


def _each_batch(events: DataFrame, handle: Callable[[DataFrame, str], None], name: str, checkpoint: str) -> DataStreamWriter:
    def run(batch: DataFrame, batch_id: int) -> None:
        # the id lives in the checkpoint: batches are the same ones only under the same id
        query_id = batch.sparkSession.sparkContext.getLocalProperty(_QUERY_ID)
        handle(batch, f"{name}-{query_id}-{batch_id}")

    return events.writeStream.foreachBatch(run).queryName(name).option("checkpointLocation", checkpoint)


def _customers(
    events: DataFrame, engine: Engines, clock: Clock, checkpoint: str, name: str, add_only: bool = False
) -> DataStreamWriter:
    def handle(batch: DataFrame, batch_name: str) -> None:
        engine().refresh_customers(batch, clock(), add_only=add_only, batch=batch_name)

    return _each_batch(events, handle, name, checkpoint)


def customer_registered(events: DataFrame, engine: Engines, clock: Clock, checkpoint: str) -> DataStreamWriter:
    """New customers join the realtime segments they match; nobody leaves one."""
    return _customers(events, engine, clock, checkpoint, "customer_registered", add_only=True)


def customer_saved(events: DataFrame, engine: Engines, clock: Clock, checkpoint: str) -> DataStreamWriter:
    """Saved customers join and leave the realtime segments as the rules say."""
    return _customers(events, engine, clock, checkpoint, "customer_saved")


def orders_placed(orders: DataFrame, engine: Engines, clock: Clock, checkpoint: str) -> DataStreamWriter:
    """New orders, as rows of ``sales_order``: only they are added to what is known of their customers.

    The customers for whom time alone may have changed an answer are evaluated with them.
    """

    def handle(batch: DataFrame, name: str) -> None:
        engine().place_orders(batch, clock(), batch=name)

    return _each_batch(orders, handle, "orders_placed", checkpoint)


def carts_changed(carts: DataFrame, engine: Engines, clock: Clock, checkpoint: str) -> DataStreamWriter:
    """The same for carts, as rows of ``quote``."""

    def handle(batch: DataFrame, name: str) -> None:
        engine().change_carts(batch, clock(), batch=name)

    return _each_batch(carts, handle, "carts_changed", checkpoint)


def order_placed(events: DataFrame, engine: Engines, clock: Clock, checkpoint: str) -> DataStreamWriter:
    """An order changes what is known of its customer, so just that customer is evaluated.

    Guest orders carry no customer and are skipped.
    """
    return _customers(events, engine, clock, checkpoint, "order_placed")


def cart_changed(events: DataFrame, engine: Engines, clock: Clock, checkpoint: str) -> DataStreamWriter:
    """The same for carts that were changed or merged."""
    return _customers(events, engine, clock, checkpoint, "cart_changed")


def change_log(entries: DataFrame, engine: Engines, clock: Clock, checkpoint: str) -> DataStreamWriter:
    """Rows (entity, row_id): changed segments are refreshed, changed customers re-evaluated."""

    def handle(batch: DataFrame, name: str) -> None:
        current, now = engine(), clock()
        changed = batch.where(F.col("entity") == SEGMENT_ROW)
        changed = changed.selectExpr("CAST(row_id AS INT) AS segment_id").distinct()
        definitions = current.segments.join(changed, "segment_id", "left_semi")
        current.refresh_definitions(definitions, now, batch=f"{name}-segments")
        customers = batch.where(F.col("entity") == CUSTOMER_ROW).selectExpr("row_id AS customer_id")
        current.refresh_customers(customers, now, batch=f"{name}-customers")

    return _each_batch(entries, handle, "change_log", checkpoint)


def login_lookup(events: DataFrame, members: Callable[[], DataFrame], sink: str, checkpoint: str) -> DataStreamWriter:
    """The number of segments of each customer who logs in.

    Memberships are counted for the customers of the batch only, then joined to the
    batch. One customer may own much of a batch: the join spreads or broadcasts.
    """

    def handle(batch: DataFrame, name: str) -> None:
        batch = written(batch, "logins")
        present = batch.select("customer_id").where("customer_id IS NOT NULL").distinct()
        rows = present.count()
        held = lookup_join(members(), present, "customer_id", rows, "left_semi")
        counts = held.groupBy("customer_id").agg(F.expr("count(*) AS segment_count"))
        found = lookup_join(batch, counts, "customer_id", rows, "left")
        found = found.withColumn("segment_count", F.expr("coalesce(segment_count, 0)"))
        found.write.mode("overwrite").parquet(f"{sink}/batch={name}")

    return _each_batch(events, handle, "login_lookup", checkpoint)


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything that is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
