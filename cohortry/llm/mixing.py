"""Mixing sources to target weights: budgets down a tree of levels, then a token prefix of a seeded order in every leaf.

1. One scan gives every document its leaf and its tokens; leaves are summed with map-side combining.
2. The budget goes from the root to the leaves by weight. A child whose whole subtree cannot use its part (its tokens
   times the most epochs) leaves the rest to its siblings, by weight; only what no sibling can use goes to the level
   above. All of this is integer arithmetic in windows over the small table of leaves.
3. A leaf's budget is some whole epochs and a prefix of the next one, whose order is the MD5 of seed, epoch and id. The
   prefix ends in one of many buckets of that order, found from bucket sums; only that bucket's rows are sorted. So a leaf of
   any size is never sorted as a whole, and what remains is one cut value per leaf.

DataFrame functions throughout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortry.llm.text import private
from cohortry.session import written

BUCKET_ROWS = 5_000
MOST_BUCKETS = 1 << 22
BROADCAST_LEAVES = 100_000
BIG = "decimal(38,0)"


def words_of(text: Column) -> Column:
    """The number of words: runs of other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool = False) -> DataFrame:
    """Null-safe join on the keys, which the result holds once."""
    names = dict(zip(keys, private(*keys)))
    right = right.select(*(F.col(c).alias(names.get(c, c)) for c in right.columns))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()), F.lit(True))
    return left.join(F.broadcast(right) if small else right, on).drop(*names.values())


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    """Weight of a value; values that are not named, NULL too, weigh 1."""
    found = F.lit(1)
    for value, weight in weights.items():
        found = F.when(F.col(level) == value, F.lit(weight)).otherwise(found)
    return found.cast("long")


def _shared_out(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Adds budget to nodes that have given (the parent's budget), room and weight."""
    order = [F.when(F.col("weight") > 0, F.col("room") / F.col("weight")).asc_nulls_last(), F.col(level).asc_nulls_first()]
    own = Window.partitionBy(*parents)
    before = F.coalesce(F.sum("room").over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(own.orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("left", (F.col("given") - before).cast(BIG)).withColumn("rest", rest.cast(BIG))
    full = (F.col("weight") == 0) | (F.col("room") * F.col("rest") <= F.col("left") * F.col("weight"))
    nodes = nodes.withColumn("full", full)
    some = lambda c: F.max(F.when(~F.col("full"), F.col(c))).over(own)  # noqa: E731  as the first that is not full has it
    nodes = nodes.withColumn("open_left", some("left")).withColumn("open_rest", some("rest"))
    part = F.expr("cast(open_left * weight as decimal(38,0)) div open_rest")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("room")).otherwise(part).cast("long")).drop("left", "rest", "full", "open_left", "open_rest")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column, epochs: int) -> DataFrame:
    """levels, tokens, rows, budget of every leaf. ``budget``: an expression over the sum of tokens, called ``total``."""
    spots = [f"weight_{i}" for i in range(len(levels))]
    table = leaves.select("*", *(_weight(level, weights.get(level, {})).alias(w) for level, w in zip(levels, spots)))
    live = reduce(lambda a, b: a & b, (F.col(w) > 0 for w in spots))
    table = table.withColumn("room", F.when(live, F.col("tokens") * epochs).otherwise(0).cast(BIG))
    root = table.agg(F.sum("tokens").alias("total"), F.sum("room").alias("room"))
    given = root.select(F.least(budget.cast(BIG), F.col("room")).alias("given"))
    for depth, (level, spot) in enumerate(zip(levels, spots)):
        parents, here = list(levels[:depth]), list(levels[: depth + 1])
        nodes = table.groupBy(*here).agg(F.sum("room").cast(BIG).alias("room"), F.first(spot).alias("weight"))
        nodes = _joined(nodes, given, parents) if parents else nodes.join(given)
        given = _shared_out(nodes, parents, level).select(*here, F.col("budget").cast(BIG).alias("given"))
    return _joined(table.select(*levels, "tokens", "rows"), given.withColumnRenamed("given", "budget"), levels)


def _order(seed: int, id_: Column, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary"))


def cuts(rows: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column, epochs: int, seed: int, full: bool = False) -> DataFrame:
    """For every leaf of rows (id, tokens and the levels): whole epochs, and the last place of the prefix (NULL: none)."""
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    leaves = written(leaves, "leaves")
    found = budgets(leaves, levels, weights, budget, epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("cast(budget as decimal(38,0)) div tokens")).otherwise(0).cast("long")
    found = found.withColumn("epochs", whole).withColumn("prefix", (F.col("budget") - F.col("epochs") * F.col("tokens")).cast("long"))
    buckets = F.least(F.ceil(F.col("rows") / BUCKET_ROWS), F.lit(MOST_BUCKETS)).cast("long")
    found = written(found.select(*levels, "epochs", "prefix", buckets.alias("buckets")), "budgets")
    small = found.count() <= BROADCAST_LEAVES

    placed = _joined(rows, found.where("prefix > 0"), levels, small).withColumn("place", _order(seed, F.col("id"), F.col("epochs")))
    # the first 40 bits of the order, spread over the leaf's buckets
    high = F.conv(F.substring("place", 1, 10), 16, 10).cast("long")
    placed = placed.withColumn("bucket", F.shiftright(high * F.col("buckets"), 40))
    sums = placed.groupBy(*levels, "bucket").agg(F.sum("tokens").alias("held"), F.first("prefix").alias("prefix"))
    earlier = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    sums = sums.where(F.col("before") < F.col("prefix") if full else F.col("before") <= F.col("prefix")).groupBy(*levels).agg(F.max("bucket").alias("last"), F.max("before").alias("before"))
    sums = written(sums, "last-buckets")
    last = _joined(placed, sums, levels, small).where("bucket = last")
    up_to = F.sum("tokens").over(Window.partitionBy(*levels).orderBy("place"))  # rows of one place count together
    # either the prefix ends before the row that reaches beyond it, or with that row
    fits = "up_to <= prefix" if not full else "up_to - own < prefix"
    same_place = F.sum("tokens").over(Window.partitionBy(*levels, "place"))
    inside = last.withColumn("up_to", up_to + F.col("before")).withColumn("own", same_place).where(fits).groupBy(*levels).agg(F.max("place").alias("cut"))
    inside = _joined(sums, inside.withColumnRenamed("cut", "found"), levels).select(*levels, F.col("found").alias("cut"))
    # a prefix that ends before its last bucket's first row holds all rows of the buckets before
    ends = _joined(placed, sums, levels, small).where("bucket < last").groupBy(*levels).agg(F.max("place").alias("cut"))
    either = inside.unionByName(ends).groupBy(*levels).agg(F.max("cut").alias("cut"))
    none = found.select(*levels, "epochs", F.lit(None).cast("string").alias("cut"))
    either = _joined(found.select(*levels, "epochs"), either, levels)
    return written(none.unionByName(either).groupBy(*levels).agg(F.max("epochs").alias("epochs"), F.max("cut").alias("cut")), "cuts")


def mixed_copies(documents: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], budget: Column, tokens: Column, epochs: int = 1, seed: int = 0, doc_id: str = "doc_id", full: bool = False) -> DataFrame:
    """doc (all columns as a struct), the levels, n_tokens, copies: how often each document is taken, 0 included.

    ``levels``: name and expression of each level, from the top. ``weights``: by level and value, whole numbers from 0;
    values not named, NULL too, weigh 1, and a weight of 0 takes nothing. ``budget``: tokens wanted, an expression that may
    use the sum of all, ``total``. ``epochs``: how often a document may be taken.

    A prefix ends before the first document that does not fit; with ``full`` it ends with the document that reaches its
    end, so that every leaf gets its budget and one document's rest more at most. Rows that repeat an id have the same place in the order
    and are taken or left together; rows without an id share one place. Documents without tokens are taken with the
    prefix they lie in; in a leaf without any tokens, none is taken. An empty table gives no rows.
    """
    (doc,) = private("doc")
    named = list(levels)
    table = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias(doc), F.col(f"`{doc_id}`").alias("id"), tokens.alias("tokens"), *(x.alias(k) for k, x in levels.items()))
    rows = written(table.drop(doc), "mixing")
    found = cuts(rows, named, weights, budget, epochs, seed, full)
    small = found.count() <= BROADCAST_LEAVES
    taken = F.coalesce((_order(seed, F.col("id"), F.col("epochs")) <= F.col("cut")) & (F.col("epochs") < epochs), F.lit(False))
    copies = (F.col("epochs") + taken.cast("long")).alias("copies")
    return _joined(table, found, named, small).select(F.col(doc).alias("doc"), *named, F.col("tokens").alias("n_tokens"), copies)
