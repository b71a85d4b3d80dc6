"""Joins of a large table to a table that is unique on the join key.

Two ways, chosen by what is known about the unique side:

* its row count is proven to be below the broadcast bound -> broadcast hash join,
  the large side is not shuffled at all;
* otherwise a shuffled join in which every key that holds more than a bounded
  number of rows is spread over several shuffle partitions.

The result is the same in both ways; nothing is dropped or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, HOT_KEY_ROWS, int_setting

_SALT, _SALTS = "__salt", "__salts"
_NULL_SPREAD = 1_000_000
_NARROW = 8  # columns of the rows the broadcast bound is meant for


def lookup_join(
    large: DataFrame,
    unique: DataFrame,
    key: str | list[str],
    unique_rows: int,
    how: str = "inner",
    keys: DataFrame | None = None,
    repeats: bool = True,
) -> DataFrame:
    """Join ``large`` to ``unique`` (at most one row per ``key``).

    ``unique_rows`` is a proven upper bound for the rows of ``unique``, usually the
    footer count of the table it was derived from; a wide row counts as several narrow
    ones. ``keys`` is where the rows per key
    are counted if they must be; a stored table in place of a computed ``large`` saves
    computing that twice. Counting more rows than ``large`` has does no harm. Without
    ``repeats`` the caller needs equal rows of ``large`` once only: where they are shuffled, they are made distinct
    first, with map-side combining, as equal rows would also get the same salt.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type {how!r}")
    width = -(-len(unique.columns) // _NARROW)
    if unique_rows * width <= int_setting(large.sparkSession, BROADCAST_ROWS):
        return large.join(F.broadcast(unique), key, how)
    return spread_join(large if repeats else large.distinct(), unique, key, how, keys)


def spread_join(
    large: DataFrame, unique: DataFrame, key: str, how: str = "inner", keys: DataFrame | None = None
) -> DataFrame:
    """Shuffled join with hot keys spread out.

    A key with n rows gets ceil(n / hot_key_rows) salts, so the list of hot keys and
    the extra copies of their unique rows are both bounded by rows / hot_key_rows.
    The salt is a hash of the row, hence the same again when a lost task is rerun.
    NULL keys match nothing, so they may take any salt and spread evenly.
    """
    bound = int_setting(large.sparkSession, HOT_KEY_ROWS)
    hot = (
        (large if keys is None else keys)
        .groupBy(key)
        .agg(F.expr("count(*) AS __rows"))
        .where(f"__rows > {bound} AND {key} IS NOT NULL")
        .selectExpr(key, f"CAST(ceil(__rows / {bound}) AS INT) AS {_SALTS}")
    )
    row_hash = f"xxhash64({', '.join(f'`{column}`' for column in large.columns)})"
    salt = f"pmod({row_hash}, if({key} IS NULL, {_NULL_SPREAD}, coalesce({_SALTS}, 1)))"
    salted = (
        large.join(F.broadcast(hot), key, "left")
        .selectExpr(*[f"`{column}`" for column in large.columns], f"CAST({salt} AS INT) AS {_SALT}")
    )
    copies = (
        unique.join(F.broadcast(hot), key, "left")
        .withColumn(_SALT, F.expr(f"explode(sequence(0, coalesce({_SALTS}, 1) - 1))"))
        .drop(_SALTS)
    )
    return salted.join(copies, [key, _SALT], how).drop(_SALT)
