"""Near duplicates by an inverted join over MinHash coordinates, confirmed on full shingle sets.

1. One scan gives each text its number of different shingles, a fingerprint of the set, and a signature of ``COORDINATES``
   minima. Equal sets become one class, so copies take part once.
2. A class is posted under (coordinate, value) pairs. Two sets of the wanted similarity share at least ``threshold`` of
   them (all but one pair in a million), so after ordering the pairs from rare to frequent, the first
   ``COORDINATES - threshold + 1`` suffice: that is the prefix. The longest lists are thus skipped; what they would
   have added is counted by comparing signatures.
3. Each list first pairs its members with its smallest one only; pairs that agree in ``threshold`` coordinates and are
   confirmed are links. Linked classes form components, and only lists that
   still hold several are compared further, in cells of bounded size: a pair that collides in at least ``threshold``
   coordinates is a candidate, in the first list that both share.
4. Rows in some candidate pair are joined to their texts, and the pairs confirmed on the whole shingle sets inside the
   cell; only links leave it, never pairs.

Groups of copies thus cost a few links per member instead of all pairs, and no list is held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from cohortry.llm.components import components
from cohortry.llm.text import mixed, rows_by, slices, word_hashes
from cohortry.session import written

COORDINATES = 64
MISSED = 1e-6
CELL_ROWS = 500
BROADCAST_IDS = 500_000
FREQUENT_TOKENS = 1 << 20
FREQUENT_FROM = 2


@cache
def match_threshold(similarity: float, coordinates: int = COORDINATES, missed: float = MISSED) -> int:
    """The most collisions that all but ``missed`` of the pairs of that similarity have."""
    below = 0.0
    for n in range(coordinates + 1):
        below += comb(coordinates, n) * similarity**n * (1 - similarity) ** (coordinates - n)
        if below > missed:
            return max(1, n)
    return coordinates


@cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(7))
    return tuple(draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles (as sorted 64-bit hashes) of all texts, one after the other, and how many each has.

    Fewer words than a shingle count as one shingle of the whole sequence; no words give the empty set.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    step = np.uint64(0x9E3779B97F4A7C15)
    joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        joined = mixed(joined + hashes[k : k + len(joined)] * step)
    sets, sizes = [], np.zeros(len(texts), np.int64)
    for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
        if n >= words:
            found = np.unique(joined[end - n : end - words + 1])
        elif n:
            value = np.array([n], np.uint64)
            for word in hashes[end - n : end]:
                value = mixed(value * step + word)
            found = value
        else:
            continue
        sets.append(found)
        sizes[i] = len(found)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def signatures(documents: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), signature (COORDINATES unsigned 32-bit values; empty without words)."""
    rows = rows_by(documents, (doc_id, "doc_id"), (text, "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _factors()
        for part, texts in slices(batches, "text", 2 << 20):
            sets, sizes = shingle_sets(texts, words)
            full = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[full]
            f1, f2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            made = [b""] * len(texts)
            if len(full):
                f1[full] = np.add.reduceat(mixed(sets), starts)
                f2[full] = np.add.reduceat(mixed(sets ^ np.uint64(0xD6E8FEB86659FD93)), starts)
                values = np.empty((len(full), COORDINATES), "<u4")
                for j in range(COORDINATES):
                    values[:, j] = np.minimum.reduceat((sets ^ b[j]) * a[j], starts) >> np.uint64(16) & np.uint64(0xFFFFFFFF)
                for i, v in zip(full, values):
                    made[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(made, pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "signature"],
            )

    return rows.mapInArrow(sign, f"doc_id {kind}, n_shingles long, f1 long, f2 long, signature binary")


def _tokens(signature: np.ndarray) -> np.ndarray:
    """One 64-bit token per coordinate and value; its lowest 7 bits are the coordinate."""
    at = np.arange(COORDINATES, dtype=np.uint64)
    return mixed(signature.astype(np.uint64) << np.uint64(8) | at) & ~np.uint64(127) | at


def _stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            tokens, counts = np.unique(_tokens(_stacked(batch.column(0))), return_counts=True)
            often = counts >= FREQUENT_FROM
            yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], ["token", "n"])


def frequencies(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and about how often they occur.

    They only order the tokens of a signature, and any order that all signatures share gives the same links; so tokens
    that no batch holds several times, and those beyond the first FREQUENT_TOKENS, may count as rare.
    """
    found = classes.select("signature").mapInArrow(_frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).toArrow()
    tokens, counts = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _ordered(signature: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and their coordinates from rare to frequent."""
    tokens = _tokens(signature)
    count = np.zeros(tokens.shape, np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], tokens.ravel()), len(frequent[0]) - 1).reshape(tokens.shape)
        count = np.where(frequent[0][at] == tokens, frequent[1][at], 0)
    return tokens, np.lexsort((tokens, count), axis=1)


def _prefix_length(similarity: float) -> int:
    return COORDINATES - match_threshold(similarity) + 1


def postings(classes: DataFrame, frequent: Broadcast, similarity: float) -> DataFrame:
    """token, node: the prefix of every class."""
    length = _prefix_length(similarity)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens, order = _ordered(_stacked(batch.column(1)), frequent.value)
                prefix = np.take_along_axis(tokens, order[:, :length], 1).ravel()
                nodes = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), length)))
                yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), nodes], ["token", "node"])

    return classes.select("node", "signature").mapInArrow(post, f"token long, node {classes.schema['node'].dataType.simpleString()}")


def _by_cell(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list, list[list]]]:
    """Cells of rows sorted by their first ``columns`` columns, as lists by column."""
    key, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [c.to_pylist() for c in batch.columns]
        for row in zip(*values):
            if row[:columns] != key:
                if held:
                    yield key, held
                key, held = row[:columns], [[] for _ in row[columns:]]
            for into, value in zip(held, row[columns:]):
                into.append(value)
    if held:
        yield key, held


def _cell_pairs(cell: tuple, rows: list[list], frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in the cell of pairs from different components that collide often enough, and not in an earlier list."""
    (token, low, high), (block, _, component, signature) = cell, rows[:4]
    threshold, length = match_threshold(similarity), _prefix_length(similarity)
    values = np.frombuffer(b"".join(signature), "<u4").reshape(-1, COORDINATES)
    in_prefix = np.zeros(values.shape, bool)
    np.put_along_axis(in_prefix, _ordered(values, frequent)[1][:, :length], True, 1)
    block, at = np.array(block), token & 127
    _, component = np.unique(np.array(component), return_inverse=True)
    # the largest component needs no comparison within itself: the others come first and are compared with all that follow
    rank = np.argsort(component == np.bincount(component).argmax(), kind="stable")
    others = int((component != np.bincount(component).argmax()).sum())
    block, component, values, in_prefix = block[rank], component[rank], values[rank], in_prefix[rank]
    left, right = [], []
    for i in range(others):
        rest = np.flatnonzero((component[i + 1 :] != component[i]) & ((block[i + 1 :] != block[i]) | (low == high))) + i + 1
        equal = values[rest] == values[i]
        keep = equal.sum(axis=1) >= threshold
        both = equal[keep] & in_prefix[rest[keep]] & in_prefix[i]
        rest = rest[keep][both.argmax(axis=1) == at]
        left.append(np.full(len(rest), i))
        right.append(rest)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return rank[np.concatenate(left)], rank[np.concatenate(right)]


def _involved(frequent: Broadcast, similarity: float, kind: pa.DataType):
    """The rows of a cell that are in some pair."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _by_cell(batches, 3):
            chosen = np.unique(np.concatenate(_cell_pairs(cell, rows, frequent.value, similarity))).tolist()
            if chosen:
                kinds = [pa.int64(), kind, kind, pa.binary()]
                columns = [pa.array([x] * len(chosen), pa.int64()) for x in cell]
                columns += [pa.array([values[i] for i in chosen], t) for values, t in zip(rows, kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["token", "low", "high", "block", "node", "component", "signature"])

    return find


class _Groups:
    """What is connected so far."""

    def __init__(self):
        self.above: dict = {}

    def top(self, x):
        while (y := self.above.get(x, x)) != x:
            x = y
        return x

    def join(self, x, y) -> None:
        self.above[self.top(y)] = self.top(x)


def _alike(s: np.ndarray, t: np.ndarray, per_cent: int) -> bool:
    if 100 * min(len(s), len(t)) < per_cent * max(len(s), len(t)):
        return False
    common = len(np.intersect1d(s, t, assume_unique=True))
    return common > 0 and 100 * common >= per_cent * (len(s) + len(t) - common)


def _links(pairs: Iterator[tuple], sets: dict, per_cent: int, groups: _Groups) -> tuple[list, list]:
    """Of the pairs, those that hold on the full sets; a pair that is connected already is not looked at."""
    found_a, found_b = [], []
    for x, y in pairs:
        if x in sets and y in sets and groups.top(x) != groups.top(y) and any(_alike(s, t, per_cent) for s in sets[x] for t in sets[y]):
            groups.join(x, y)
            found_a.append(x)
            found_b.append(y)
    return found_a, found_b


def _sets_of(nodes: list, texts: list[str], words: int) -> dict:
    """Shingle sets by node; several where an id has several rows."""
    shingles, sizes = shingle_sets([x.encode() for x in texts], words)
    ends, sets = np.cumsum(sizes), {}
    for node, end, n in zip(nodes, ends, sizes):
        sets.setdefault(node, []).append(shingles[end - n : end])
    return sets


def _linked(frequent: Broadcast, similarity: float, words: int, per_cent: int, kind: pa.DataType):
    """Links of a cell whose rows carry their texts."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _by_cell(batches, 3):
            node, component, texts = rows[1], rows[2], rows[4]
            sets = _sets_of(node, texts, words)
            groups = _Groups()
            for n, c in zip(node, component):
                if groups.top(n) != groups.top(("component", c)):
                    groups.join(("component", c), n)
            # an id with several rows stands in the cell several times
            pairs = dict.fromkeys((node[i], node[j]) for i, j in zip(*_cell_pairs(cell, rows, frequent.value, similarity)))
            a, b = _links(pairs, sets, per_cent, groups)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    return link


def _confirmed(words: int, per_cent: int, kind: pa.DataType):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (a, b, text) in _by_cell(batches, 3):
            known = [i for i, x in enumerate(text) if x is not None]
            sets = _sets_of([a[i] for i in known], [text[i] for i in known], words)
            a, b = _links(((a[i], b[i]) for i in range(len(a)) if text[i] is None), sets, per_cent, _Groups())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    return confirm


def _colliding(similarity: float):
    threshold = match_threshold(similarity)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (_stacked(batch.column(2)) == _stacked(batch.column(3))).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(equal >= threshold))

    return count


def colliding(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough coordinates."""
    kind = pairs.schema["a"].dataType.simpleString()
    named = [classes.select(F.col("node").alias(x), F.col("signature").alias(f"signature_{x}")) for x in "ab"]
    rows = pairs.join(named[0], "a").join(named[1], "b").select("a", "b", "signature_a", "signature_b")
    return rows.mapInArrow(_colliding(similarity), f"a {kind}, b {kind}")


def texts_of(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """node, text of some documents. Their ids are broadcast only if they are few; else both sides shuffle."""
    ids = written(nodes.distinct(), "suspects")
    few = ids.count() <= BROADCAST_IDS
    return written(documents.join(F.broadcast(ids) if few else ids, "node", "left_semi"), "texts")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def confirmed(pairs: DataFrame, documents: DataFrame, words: int, per_cent: int) -> DataFrame:
    """a, b: links that connect, within each cell (three columns), what the pairs of sufficient similarity connect."""
    kind = pairs.schema["a"].dataType.simpleString()
    cell = pairs.columns[:3]
    nodes = pairs.select(*cell, F.explode(F.array("a", "b")).alias("node")).distinct()
    held = nodes.join(texts_of(nodes.select("node"), documents), "node").select(*cell, F.col("node").alias("a"), F.col("node").alias("b"), "text")
    rows = held.unionByName(pairs.select(*cell, "a", "b", F.lit(None).cast("string").alias("text")))
    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_confirmed(words, per_cent, _arrow(kind)), f"a {kind}, b {kind}")


def near_duplicates(documents: DataFrame, words: int = 5, per_cent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``documents``.

    Sets of ``words``-word shingles with 100 * intersection >= ``per_cent`` * union are linked; a component is what links
    connect, named by its smallest doc_id. Texts without words (NULL, empty, white space) are linked with nothing. Rows
    that repeat an id are one document that has the links of all its rows. Rows without an id are linked with nothing
    and have no component. An empty table gives no rows; extra columns are not looked at.

    Shingles are compared by 64-bit hash. Every link that is returned holds on the full sets; one pair in a million at
    the very threshold is not looked at.
    """
    spark = documents.sparkSession
    similarity = per_cent / 100
    rows = written(signatures(documents, words, doc_id, text), "signatures")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "signature")).alias("one"))
    classes = written(classes.select("f1", "f2", F.col("one.doc_id").alias("node"), F.col("one.signature").alias("signature")), "classes")
    frequent = spark.sparkContext.broadcast(frequencies(classes))

    posted = postings(classes, frequent, similarity)
    lists = posted.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    posted = written(posted.join(written(lists, "lists"), "token"), "postings")
    named = rows_by(documents, (doc_id, "node"), (text, "text")).where("node is not null")

    pairs = written(posted.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "star-pairs")
    pairs = written(colliding(pairs, classes, similarity), "star-candidates")
    crowded = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("cells")).where("cells > 1")
    cells = pairs.join(written(crowded, "crowded"), "a", "left")
    part = F.pmod(F.xxhash64("b"), F.coalesce("cells", F.lit(1).cast("long"))).alias("part")
    cells = cells.select(F.col("a").alias("hub"), part, F.lit(0).alias("star"), "a", "b")
    links = written(confirmed(cells, named, words, per_cent), "links")
    found = written(components(links), "components")

    whole = posted.join(found, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("component"))
    whole = written(whole, "labelled")
    mixed_lists = whole.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("token")
    open_ = whole.join(written(mixed_lists, "open"), "token", "left_semi").join(classes.select("node", "signature"), "node")
    blocks = F.ceil(F.col("n") / CELL_ROWS)
    cells = (
        open_.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component", "signature")
    )
    kind = classes.schema["node"].dataType.simpleString()
    cell = ("token", "low", "high")
    dealt = cells.repartition(*cell).sortWithinPartitions(*cell, "node")
    schema = f"token long, low long, high long, block long, node {kind}, component {kind}, signature binary"
    involved = written(dealt.mapInArrow(_involved(frequent, similarity, _arrow(kind)), schema), "involved")
    held = involved.join(texts_of(involved.select("node"), named), "node").select(*involved.columns, "text")
    dealt = held.repartition(*cell).sortWithinPartitions(*cell, "node")
    more = dealt.mapInArrow(_linked(frequent, similarity, words, per_cent, _arrow(kind)), f"a {kind}, b {kind}")
    links = links.unionByName(written(more, "more-links"))
    final = written(components(links), "components")

    named_classes = classes.join(final, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component_id"))
    labelled = rows.join(written(named_classes, "class-components"), ["f1", "f2"], "left")
    none = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return labelled.select("doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
