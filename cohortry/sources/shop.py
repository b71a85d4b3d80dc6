"""The shop's fact tables, and the scans every operator starts from."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..session import BROADCAST_ROWS, dealt, int_setting

# Order states that do not count as a purchase.
VOID_STATES = ("canceled", "closed")


BUCKET = "customer_bucket"
CUSTOMER_FACTS = (
    "sales_order",
    "sales_order_item",
    "item_keys",
    "quote",
    "quote_item",
    "wishlist",
    "wishlist_item",
    "product_view",
)


def bucket_of(buckets: int) -> str:
    return f"CAST(pmod(xxhash64(customer_id), {buckets}) AS INT)"


def _table(name: str) -> cached_property:
    def get(shop: Shop) -> DataFrame:
        table = shop.tables[name]
        return table() if callable(table) else table

    return cached_property(get)


class Shop:
    """The fact tables by name, each a DataFrame or a function returning one.

    Functions are called on first use, so a query analyses only the tables it reads.
    ``count_catalog`` and ``count_orders`` bound the number of products and orders;
    they decide whether look-ups in them may be broadcast.
    """

    customer = _table("customer")
    customer_address = _table("customer_address")
    sales_order = _table("sales_order")
    sales_order_item = _table("sales_order_item")
    category_product = _table("category_product")
    quote = _table("quote")
    quote_item = _table("quote_item")
    wishlist = _table("wishlist")
    wishlist_item = _table("wishlist_item")
    product_view = _table("product_view")

    def __init__(
        self,
        tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
        count_catalog: Callable[[], int],
        count_orders: Callable[[], int],
        count_items: Callable[[], int] | None = None,
    ) -> None:
        self.tables = dict(tables)
        self.count_catalog = count_catalog
        self.count_orders = count_orders
        self.count_items = count_items or (lambda: self.item_keys.count())
        self.buckets: int | None = None  # set where the tables are stored by customer bucket

    @cached_property
    def item_keys(self) -> DataFrame:
        """(order_id, product_id) of every order item, straight from storage."""
        if "item_keys" in self.tables:
            table = self.tables["item_keys"]
            return table() if callable(table) else table
        return self.sales_order_item.select("order_id", "product_id")

    @cached_property
    def catalog_rows(self) -> int:
        return self.count_catalog()

    @cached_property
    def order_rows(self) -> int:
        return self.count_orders()

    @cached_property
    def item_rows(self) -> int:
        return self.count_items()

    def with_tables(self, **tables: DataFrame | Callable[[], DataFrame]) -> Shop:
        return Shop({**self.tables, **tables}, self.count_catalog, self.count_orders, lambda: self.item_rows)

    def for_customers(self, touched: DataFrame, touched_rows: int) -> Shop:
        """The same shop reduced to the facts of some customers.

        ``touched`` holds distinct ``customer_id``. If they are few enough to be broadcast,
        every table that carries the customer is reduced before anything is shuffled, and
        items follow their order, cart or wishlist; those semi joins carry no hint, the
        reduced side is small at run time and AQE sees that. The items of orders are the longest
        table: they are dealt to tasks by their number, as what one task sorts and merges
        would otherwise grow with them. If the customers are many, the facts
        have to be shuffled for their aggregation anyway, so only the population is reduced.
        Tables stored by customer bucket are read in the touched buckets only.
        """
        pruned = "true"
        if self.buckets:
            # at most one value per bucket
            bucket = touched.selectExpr(f"{bucket_of(self.buckets)} AS bucket").distinct().collect()
            pruned = f"{BUCKET} IN ({', '.join(str(row.bucket) for row in bucket) or 'NULL'})"

        def read(name: str) -> DataFrame:
            return getattr(self, name).where(pruned)

        def of(name: str) -> Callable[[], DataFrame]:
            return lambda: lookup_join(read(name), touched, "customer_id", touched_rows, "left_semi")

        def items(name: str, parent: str, key: str, rows: Callable[[], int] = lambda: 0) -> Callable[[], DataFrame]:
            # dealing the owners deals the items that meet them, wherever Catalyst puts this join
            return lambda: read(name).join(dealt(of(parent)().select(key), rows(), key), key, "left_semi")

        # of stored buckets only some are read, which AQE puts together
        item_rows = (lambda: 0) if self.buckets else (lambda: self.item_rows)

        if touched_rows > int_setting(touched.sparkSession, BROADCAST_ROWS):
            facts = CUSTOMER_FACTS if self.buckets else ()
            return self.with_tables(
                **{name: partial(read, name) for name in facts},
                # unique on both sides, so a plain semi join
                customer=lambda: read("customer").join(touched, "customer_id", "left_semi"),
            )
        return self.with_tables(
            customer=of("customer"),
            sales_order=of("sales_order"),
            sales_order_item=items("sales_order_item", "sales_order", "order_id", item_rows),
            item_keys=items("item_keys", "sales_order", "order_id", item_rows),
            quote=of("quote"),
            quote_item=items("quote_item", "quote", "quote_id"),
            wishlist=of("wishlist"),
            wishlist_item=items("wishlist_item", "wishlist", "wishlist_id"),
            product_view=of("product_view"),
        )

    def only(self, name: str, rows: DataFrame) -> Shop:
        """The shop as if ``rows`` of ``sales_order`` or ``quote`` were all the orders or carts there are, and no other facts."""
        facts = {"sales_order": ("order_id", ("sales_order_item", "item_keys")), "quote": ("quote_id", ("quote_item",))}
        key, items = facts[name]
        ids = rows.select(key)

        def of(item: str) -> Callable[[], DataFrame]:
            # a batch is small at run time, and AQE sees that
            return lambda: getattr(self, item).join(ids, key, "left_semi")

        def nothing(table: str) -> Callable[[], DataFrame]:
            return lambda: getattr(self, table).where("false")

        empty = {table: nothing(table) for table in CUSTOMER_FACTS}
        return self.with_tables(**{**empty, name: lambda: rows, **{item: of(item) for item in items}})

    def ordered_before(self, moment: str) -> Shop:
        """The shop as it was before ``moment``, as far as orders are concerned."""
        earlier = f"created_at < TIMESTAMP_NTZ '{moment}'"
        return self.with_tables(sales_order=lambda: self.sales_order.where(earlier))


    def carts_before(self, moment: str) -> Shop:
        """The shop as it was before ``moment``, as far as carts are concerned."""
        earlier = f"updated_at < TIMESTAMP_NTZ '{moment}'"
        return self.with_tables(quote=lambda: self.quote.where(earlier))


def population(customer: DataFrame) -> DataFrame:
    """Everyone who can be in a segment; id 0 is never a customer."""
    return customer.where("customer_id > 0")


def valid_orders(sales_order: DataFrame) -> DataFrame:
    """Orders that count, of known customers.

    Guest orders share one NULL customer. They can match nobody, so they are dropped
    here, at the scan, before they could pile up in one shuffle partition.
    """
    void = ", ".join(f"'{state}'" for state in VOID_STATES)
    return sales_order.where(f"state NOT IN ({void}) AND customer_id IS NOT NULL")


def active_carts(quote: DataFrame) -> DataFrame:
    return quote.where("is_active = 1 AND customer_id IS NOT NULL")


def top_level_items(quote_item: DataFrame) -> DataFrame:
    return quote_item.where("parent_item_id IS NULL")


def active_segments(segments: DataFrame, *modes: str) -> DataFrame:
    chosen = segments.where("is_active")
    return chosen.where(F.col("refresh_mode").isin(*modes)) if modes else chosen


def latest_carts(quote: DataFrame) -> DataFrame:
    """The most recently updated active cart of each customer (ties: highest id).

    ``max`` of a struct combines map-side, so a customer holding a third of all carts
    still sends one row per map task; a window would sort them all in one task.
    """
    newest = "max(struct(updated_at, quote_id, subtotal, items_count)) AS cart"
    return (
        active_carts(quote)
        .groupBy("customer_id")
        .agg(F.expr(newest))
        .select("customer_id", "cart.quote_id", "cart.updated_at", "cart.subtotal", "cart.items_count")
    )
