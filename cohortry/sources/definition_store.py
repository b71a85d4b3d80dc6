"""Stored segment definitions.

Every save or delete appends the rows it concerns as ``segments/seq=N``; the
current definition of a segment is its latest row. Definitions are written by people,
so this table stays small whatever the size of the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.lifecycle import upsert_segments
from ..session import small_table, written

_ROWS = f"{schemas.SEGMENTS}, deleted boolean"


def _numbered(rows: DataFrame, first: int) -> DataFrame:
    """The rows with successive numbers as ``segment_id``, in the order of their partitions.

    Stored before the partitions are counted, as they may come otherwise when read again.
    """
    # monotonically_increasing_id has the partition above 33 bits of the row's place in it
    placed = written(rows.withColumn("_place", F.monotonically_increasing_id()), "new-segments")
    placed = placed.withColumn("_part", F.expr("shiftright(_place, 33)"))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    number = F.expr(f"CAST({first} + _start + (_place & {(1 << 33) - 1}L) AS INT)")
    return placed.join(starts, "_part").withColumn("segment_id", number).select(*rows.columns)


class DefinitionStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root
        small_table(spark, [], _ROWS).write.mode("ignore").parquet(f"{root}/segments/seq=0")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"{_ROWS}, seq int").parquet(f"{self.root}/segments")

    def segments(self) -> DataFrame:
        fields = self._rows().drop("seq").columns
        latest = self._rows().groupBy("segment_id").agg(F.expr(f"max_by(struct({', '.join(fields)}), seq) AS row"))
        return latest.select("row.*").where("NOT deleted").drop("deleted")

    def save(self, changes: DataFrame, now: dt.datetime) -> DataFrame:
        """Create or update segments; the saved rows.

        ``changes`` has the columns to set, NULL leaving a field as it is. A row without
        ``segment_id`` becomes a new segment with the next free number.
        """
        top, seq = self._rows().selectExpr("coalesce(max(segment_id), 0)", "coalesce(max(seq), 0) + 1").first()
        given = changes.where("segment_id IS NOT NULL")
        new = _numbered(changes.where("segment_id IS NULL"), top + 1)
        current = self.segments().join(given, "segment_id", "left_semi")
        self._append(upsert_segments(current, given.unionByName(new), now), seq, deleted=False)
        return self.spark.read.schema(schemas.SEGMENTS).parquet(f"{self.root}/segments/seq={seq}")

    def delete(self, ids: DataFrame) -> DataFrame:
        """Delete segments; the ids that existed (segment_id), as they are stored."""
        seq = self._rows().selectExpr("coalesce(max(seq), 0) + 1").first()[0]
        gone = self.segments().join(ids.select("segment_id").distinct(), "segment_id", "left_semi")
        self._append(gone, seq, deleted=True)
        return self.spark.read.schema("segment_id int").parquet(f"{self.root}/segments/seq={seq}")

    def _append(self, rows: DataFrame, seq: int, deleted: bool) -> None:
        # AQE makes one file of the usual few rows, and several of very many
        marked = rows.withColumn("deleted", F.lit(deleted)).hint("rebalance")
        marked.write.mode("overwrite").parquet(f"{self.root}/segments/seq={seq}")
