"""Storing the facts by customer bucket, so that some customers can be read cheaply.

A micro-batch of changes needs the whole history of a few customers. In files laid out
by date that is a scan of everything; here it is a scan of the touched buckets. A bucket
is an ordinary Parquet partition of many files, not one task's worth of data: a customer
who owns a third of all orders makes a large partition that is still written and read
by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .shop import BUCKET, Shop, bucket_of

# item table -> the table that knows its customer, and the key between them
OWNERS = {
    "sales_order_item": ("sales_order", "order_id"),
    "quote_item": ("quote", "quote_id"),
    "wishlist_item": ("wishlist", "wishlist_id"),
}
CUSTOMER_TABLES = ("customer", "sales_order", "quote", "wishlist", "product_view")


def _store(table: DataFrame, path: str, key: str) -> DataFrame:
    """Write by bucket; AQE cuts large buckets into several files and joins small ones.

    Rows are sorted inside a file, so its row groups cover few customers or items each
    and a filter on the key skips most of them.
    """
    ordered = table.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, key)
    ordered.write.mode("errorifexists").partitionBy(BUCKET).parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def cluster_by_customer(shop: Shop, path: str, buckets: int = 256) -> Shop:
    """Write the customer-related tables below ``path``; a shop that reads them.

    Rows without a customer (guests) can match no rule and are left out.
    """
    bucket = F.expr(bucket_of(buckets))
    stored: dict[str, DataFrame] = {}
    for name in CUSTOMER_TABLES:
        known = getattr(shop, name).where("customer_id IS NOT NULL").withColumn(BUCKET, bucket)
        stored[name] = _store(known, f"{path}/{name}", "customer_id")
    for name, (owner, key) in OWNERS.items():
        owners = stored[owner].select(key, BUCKET)
        keys = shop.item_keys if name == "sales_order_item" else None
        owned = lookup_join(getattr(shop, name), owners, key, owners.count(), keys=keys)
        stored[name] = _store(owned, f"{path}/{name}", key)
    stored["item_keys"] = stored["sales_order_item"].select("order_id", "product_id", BUCKET)
    clustered = shop.with_tables(**stored)
    clustered.buckets = buckets
    return clustered
