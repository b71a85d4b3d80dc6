"""Partial facts of all customers by bucket, kept up to date by adding what is new.

    facts/<features>/seq=N/customer_bucket=B/

The rows of a write become visible with the commit of the membership store that carries its number, so facts and
memberships change together or not at all. The facts of a customer are all rows since the customer was last computed
anew. Which columns there are follows from the features; other features are another folder. New facts must come once:
a batch that is replayed is recognised by its name, an order that comes again in another batch is not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import Feature, Wanted
from ..operators.joins import lookup_join
from ..operators.partials import kept_features, merged, partial_facts
from ..session import small_table
from .membership_store import MembershipStore
from .shop import BUCKET, Shop, bucket_of

MOST_OPEN = 32  # writes after which the rows of all customers are merged into one write
BUCKET_CUSTOMERS, MOST_BUCKETS = 20_000, 4096
_STATE = "reset boolean"


class FactStore:
    """``kinds`` are the kinds of facts that are kept; features of other facts are left alone."""

    def __init__(
        self, store: MembershipStore, shop: Shop, features: Iterable[Feature], kinds: Iterable[str], buckets: int | None = None
    ) -> None:
        self.store, self.buckets = store, buckets
        self.wanted = Wanted(kept_features(features, kinds))
        names = ",".join([*sorted(kinds), *(feature.name for feature in self.wanted.features)])
        self.name = hashlib.sha1(names.encode()).hexdigest()[:16]
        self.root = f"{store.root}/facts/{self.name}"
        self.schema = partial_facts(shop, self.wanted).schema
        self.kinds = (f"facts {self.name}", f"all facts {self.name}")

    # -- reading ---------------------------------------------------------------

    def _open(self) -> list[int]:
        """The writes to be read: the last one of everybody and those behind it."""
        part, whole = self.kinds
        rows = self.store.commits().where(F.col("kind").isin(part, whole)).select("kind", "seq", "customer_count").collect()
        last = max((row for row in rows if row.kind == whole), key=lambda row: row.seq, default=None)
        if last is None:
            return []
        self.buckets = last.customer_count  # as they were cut when the facts were built
        return sorted({row.seq for row in rows if row.seq >= last.seq})

    def is_built(self) -> bool:
        return bool(self._open())

    def rows(self, touched: DataFrame | None = None, touched_rows: int = 0, pending: int | None = None) -> DataFrame:
        """Merged partial facts of all or some customers. ``pending``: a write not committed yet that counts too."""
        seqs = self._open() + ([] if pending is None else [pending])
        if not seqs:
            return small_table(self.store.spark, [], self.schema)
        schema = f"{_ddl(self.schema)}, {_STATE}, seq int, {BUCKET} int"
        reader = self.store.spark.read.schema(schema).option("basePath", self.root)
        found = reader.parquet(*[f"{self.root}/seq={seq}" for seq in seqs])
        if touched is not None:
            # at most one value per bucket
            buckets = touched.selectExpr(f"{bucket_of(self.buckets)} AS bucket").distinct().collect()
            found = found.where(f"{BUCKET} IN ({', '.join(str(row.bucket) for row in buckets) or 'NULL'})")
            found = lookup_join(found, touched, "customer_id", touched_rows, "left_semi")
        since = F.expr("max(if(reset, seq, NULL)) OVER (PARTITION BY customer_id)")
        valid = found.withColumn("__since", since).where("__since IS NULL OR seq >= __since")
        return merged(valid.drop("reset", "seq", "__since", BUCKET), self.wanted)

    # -- writing ---------------------------------------------------------------

    def _write(self, seq: int, rows: DataFrame) -> None:
        bucketed = rows.withColumn(BUCKET, F.expr(bucket_of(self.buckets)))
        ordered = bucketed.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "customer_id")
        ordered.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/seq={seq}")

    def build(self, shop: Shop) -> None:
        """The facts of everybody, from the shop. Without a number of buckets, one for each ``BUCKET_CUSTOMERS``."""
        if self.buckets is None:
            self.buckets = max(1, min(MOST_BUCKETS, shop.customer.count() // BUCKET_CUSTOMERS))
        seq = self.store.next_seq()
        self._write(seq, partial_facts(shop, self.wanted).withColumn("reset", F.lit(False)))
        self.store.commit(seq, [(self.kinds[1], None, None, self.buckets, None)])

    def add(self, seq: int, fresh: Shop | None, renewed: DataFrame | None, history: Shop | None) -> list[tuple]:
        """Write the facts of ``fresh``, and all of ``history`` for the customers ``renewed``; the commit rows that make them visible.

        The customers of ``renewed`` get nothing from ``fresh``: it is part of their history.
        """
        parts = []
        if fresh is not None:
            rows = partial_facts(fresh, self.wanted)
            parts.append(rows if renewed is None else rows.join(renewed, "customer_id", "left_anti"))
        if renewed is not None:
            parts.append(partial_facts(history, self.wanted))
        marked = [part.withColumn("reset", F.lit(False)) for part in parts]
        if renewed is not None:
            marked.append(renewed.select("customer_id").withColumn("reset", F.lit(True)))
        rows = small_table(self.store.spark, [], self.schema).withColumn("reset", F.lit(False))
        for part in marked:
            rows = rows.unionByName(part, allowMissingColumns=True)
        self._write(seq, rows)
        return [(self.kinds[0], None, None, None, None)]

    def fold(self) -> bool:
        """Merge all rows into one write if there are many; whether there were."""
        if len(self._open()) <= MOST_OPEN:
            return False
        seq = self.store.next_seq()
        whole = small_table(self.store.spark, [], self.schema).unionByName(self.rows(), allowMissingColumns=True)
        self._write(seq, whole.withColumn("reset", F.lit(False)))
        self.store.commit(seq, [(self.kinds[1], None, None, self.buckets, None)])
        return True


def _ddl(schema) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)
