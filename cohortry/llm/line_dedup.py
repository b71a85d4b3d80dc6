"""Lines that many documents share, found by hash in sorted ranges and returned as bits instead of text.

1. One scan turns every text into (hash of the line, document, position) rows, stored in the shared folder.
2. They are range-partitioned by hash and sorted within it by document and position; a window streams over each hash,
   whose first row is the document that keeps the line.
3. A hash that holds more than its share of rows is not sent to one range: such hashes (at most ``HOT_KEYS``, known from
   a histogram of hash buckets and an aggregate with map-side combining) are decided by a broadcast look-up.
4. The lines to drop become one compressed bitmap per document, 64 lines a word, words without drops left out. Only
   these meet the texts again.

DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortry.llm.text import lower_az, private, rows_by
from cohortry.session import written

WHITE = " \t\n\x0b\x0c\r"
HOT_KEYS = 10_000
HOT_ROWS = 20_000
HASH_BUCKETS = 1 << 16
WORD = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_index(documents: DataFrame, doc_id: str, text: str, least_points: int) -> DataFrame:
    """a, b (128-bit hash of the key), doc_id, version (hash of the text), pos, first (in its document), for long keys."""
    rows = rows_by(documents, (doc_id, "doc_id"), (text, "text"))
    keys = F.transform(_lines(F.col("text")), lambda x: lower_az(F.btrim(x, F.lit(WHITE))))
    hashed = F.transform(
        keys,
        lambda x, i: F.when(F.char_length(x) >= least_points, F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), i.alias("pos"))),
    )
    rows = rows.select("doc_id", F.xxhash64("text").alias("version"), F.sort_array(F.array_compact(hashed)).alias("keys"))
    rows = rows.select("doc_id", "version", F.posexplode("keys").alias("at", "key"), F.col("keys").alias("all"))
    before = F.get("all", F.col("at") - 1)
    again = (before["a"] == F.col("key.a")) & (before["b"] == F.col("key.b"))
    return rows.select("key.a", "key.b", "doc_id", "version", "key.pos", (~F.coalesce(again, F.lit(False))).cast("int").alias("first"))


def hot_keys(index: DataFrame, rows: int) -> DataFrame:
    """Hashes with more than their share of all rows, so at most ``HOT_KEYS``: a, b, n (documents), last (the largest id)."""
    bound = max(HOT_ROWS, rows // HOT_KEYS)
    bucket = F.pmod("a", F.lit(HASH_BUCKETS))
    full = index.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select("bucket")
    return (
        index.join(F.broadcast(full), bucket == F.col("bucket"), "left_semi")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("first").alias("n"), F.max("doc_id").alias("last"))
        .where(F.col("rows") > bound)
        .select("a", "b", "n", "last")
    )


def line_bitmaps(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_points: int = 40, least_documents: int = 5) -> DataFrame:
    """doc_id, version, dropped: the bitmap of lines to drop, as (word, bits) pairs; documents without drops have no row.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least ``least_points`` code
    points in at least ``least_documents`` documents stay only in the largest doc_id that holds them, there with all
    their lines. Each row counts as a document; rows that repeat an id have bitmaps of their own (``version`` is the
    hash of their text), and those with the largest id all keep the line. Rows without an id count but lose nothing.
    """
    index = written(line_index(documents, doc_id, text, least_points), "lines")
    hot = written(hot_keys(index, index.count()), "hot-lines")
    ranges = index.join(F.broadcast(hot), ["a", "b"], "left_anti").repartitionByRange("a", "b")
    whole = Window.partitionBy("a", "b").orderBy(F.col("doc_id").desc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    streamed = ranges.select("doc_id", "version", "pos", F.sum("first").over(whole).alias("n"), F.first("doc_id").over(whole).alias("last"))
    looked_up = index.join(F.broadcast(hot), ["a", "b"]).select("doc_id", "version", "pos", "n", "last")
    drops = streamed.unionByName(looked_up).where((F.col("n") >= least_documents) & (F.col("doc_id") < F.col("last")))
    words = drops.groupBy("doc_id", "version", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % WORD)).alias("bits"))
    return words.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def without_lines(documents: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``documents`` (as the struct ``doc``), n_lines, n_dropped, and kept (the text without those lines)."""
    key, version, words = private("key", "version", "words")
    entries = F.map_from_entries("dropped")
    dense = F.transform(F.sequence(F.lit(0), F.col("dropped")[F.size("dropped") - 1]["word"]), lambda w: F.coalesce(F.element_at(entries, w), F.lit(0).cast("long")))
    bits = bitmaps.select(F.col("doc_id").alias(key), F.col("version").alias(version), dense.alias(words))
    source = F.col(f"`{text}`")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("doc"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(source).alias("text_version"), source.alias("text"))
    joined = rows.join(bits, (F.col("id") == F.col(key)) & (F.col("text_version") == F.col(version)), "left")
    lines = _lines(F.col("text"))

    def stays(_line: Column, i: Column) -> Column:
        # beyond the last word nothing is dropped
        word = F.coalesce(F.get(F.col(words), F.floor(i / WORD).cast("int")), F.lit(0).cast("long"))
        return F.getbit(word, i % WORD) == 0

    kept = F.when(F.col(words).isNotNull(), F.filter(lines, stays))
    joined = joined.select("doc", "text", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return joined.select(
        "doc",
        "n_lines",
        F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("kept", "\n"), "text", F.lit("")).alias("kept"),
    )
