"""Exact duplicates: two passes over Bloom bits find hashes that may repeat, and only their rows shuffle.

1. Each text is read once; its normalised text becomes a SHA-256 digest (stored with the id in the shared folder).
2. First pass: every digest sets two bits of one filter block. Bits set more than once are counted as such: a task
   sends its set bits as short sorted lists per block, and the merged filter keeps the bits set at least twice. It has
   ``BITS_A_ROW`` bits for each row, however many there are: where that is more than ``most_bits``, the digests are dealt
   to several ranges by hash, stored apart, and each range has a filter of its own, one after the other.
3. Second pass: a digest whose two bits are not both set twice is unique and passes straight on. The others are grouped
   by digest with map-side combining, and joined back to their rows, which AQE splits when one digest is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from cohortry.llm.text import SPACES, rows_by, slices
from cohortry.session import work_dir, written

BLOCK_BITS = 1 << 16
BITS_A_ROW = 16
MOST_BITS = 1 << 30


def digests(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_points (code points of the original text), digest of the text without white space."""
    rows = rows_by(documents, (doc_id, "doc_id"), (text, "text"))
    rows = rows.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_points"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found = [hashlib.sha256(x.translate(None, SPACES)).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], ["doc_id", "n_points", "digest"])

    return rows.mapInArrow(digest, f"doc_id {kind}, n_points long, digest binary")


def filter_sizes(rows: int, most_bits: int = MOST_BITS) -> tuple[int, int]:
    """Ranges, and bits of the filter of each: powers of two that give every row ``BITS_A_ROW``, at most ``most_bits`` a filter."""
    bits = max(BLOCK_BITS, 1 << (max(1, rows * BITS_A_ROW) - 1).bit_length())
    return max(1, bits // most_bits), min(most_bits, bits)


def _positions(found: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block and two offsets within it, from disjoint parts of the digest."""
    words = np.frombuffer(b"".join(found.to_pylist()), "<u4").reshape(-1, 8)
    return words[:, 0] % np.uint32(bits // BLOCK_BITS), (words[:, 1] & np.uint32(0xFFFF)), (words[:, 2] & np.uint32(0xFFFF))


def _bit_lists(bits: int):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, a, b = _positions(batch.column(0), bits)
            b = np.where(a == b, (b + 1) & 0xFFFF, b)  # always two bits
            keys, counts = np.unique(np.concatenate([block, block]).astype(np.uint64) << np.uint64(16) | np.concatenate([a, b]), return_counts=True)
            at = np.flatnonzero(np.diff(keys >> np.uint64(16), prepend=np.uint64(1 << 47)))
            ends = np.append(at[1:], len(keys))
            offsets = (keys & np.uint64(0xFFFF)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((keys[at] >> np.uint64(16)).astype(np.int64)),
                    pa.array([offsets[x:y].tobytes() for x, y in zip(at, ends)], pa.binary()),
                    pa.array([offsets[x:y][counts[x:y] > 1].tobytes() for x, y in zip(at, ends)], pa.binary()),
                ],
                ["block", "once", "twice"],
            )

    return lists


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; one block's bits are held at a time."""
    block, seen, twice = None, np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["block", "bits"])

    for batch in batches:
        for k, once, more in zip(*(c.to_pylist() for c in batch.columns)):
            if k != block:
                if block is not None:
                    yield done()
                block = k
                seen[:] = twice[:] = False
            at = np.frombuffer(once, "<u2")
            twice[at[seen[at]]] = True
            twice[np.frombuffer(more, "<u2")] = True
            seen[at] = True
    if block is not None:
        yield done()


def repeated_bits(found: DataFrame, bits: int) -> np.ndarray:
    """The filter of bits that at least two rows set, packed; ``bits`` / 8 bytes on the driver."""
    lists = found.select("digest").mapInArrow(_bit_lists(bits), "block long, once binary, twice binary")
    merged = lists.repartition("block").sortWithinPartitions("block").mapInArrow(_merged, "block long, bits binary")
    whole = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for row in merged.collect():
        whole[row.block] = np.frombuffer(row.bits, np.uint8)
    return whole


def _tested(shared: Broadcast, bits: int):
    """Whether a row's two bits were both set more than once."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = shared.value
        for batch in batches:
            if batch.num_rows:
                block, a, b = _positions(batch.column(2), bits)
                b = np.where(a == b, (b + 1) & 0xFFFF, b)
                maybe = np.ones(batch.num_rows, bool)
                for at in (a, b):
                    maybe &= (whole[block, at >> 3] >> (7 - (at & 7))) & 1 > 0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], ["doc_id", "n_points", "digest", "maybe"])

    return test


def exact_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row for each row of ``documents``.

    Texts are equal when they are without white space (NULL counts as empty). The longest original text stays, then
    the smallest doc_id; a NULL id loses against others. Rows that repeat an id are rows of their own: they count in
    group_size, and of such equal rows each that ties for the first place is kept. An empty table gives no rows. Extra
    columns are not looked at.
    """
    spark = documents.sparkSession
    ranges, bits = filter_sizes(documents.count(), most_bits)
    found = digests(documents, doc_id, text)
    # the last bytes of the digest deal; the filter looks at the first ones
    dealt = F.conv(F.hex(F.substring("digest", 29, 4)), 16, 10).cast("long") % ranges
    path = work_dir(spark, "digests")
    found.withColumn("range", dealt).write.partitionBy("range").parquet(path)
    stored = spark.read.schema(found.schema.add("range", "long")).parquet(path)
    kind = found.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_points long, digest binary, maybe boolean"
    tested = spark.createDataFrame([], schema)
    for number in range(ranges):
        part = stored.where(F.col("range") == number).drop("range")
        shared = spark.sparkContext.broadcast(repeated_bits(part, bits))
        tested = tested.unionByName(written(part.mapInArrow(_tested(shared, bits), schema), "tested-digests"))
        shared.destroy()
    alone = tested.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    maybe = tested.where("maybe").drop("maybe")
    first = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    # stored, so that the join reads two plain exchanges, which AQE can split
    groups = written(maybe.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "copies")
    won = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("n_points") == -F.col("first.less"))
    grouped = maybe.join(groups, "digest").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", won.alias("kept"), "digest")
    return alone.unionByName(grouped)
