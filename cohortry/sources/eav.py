"""Attribute-value storage of customer attributes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def widen(values: DataFrame, attributes: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Long (entity_id, attribute_id, value) rows to one row per entity.

    ``attributes`` is the attribute catalogue (attribute_id, attribute_code); only the
    ``wanted`` codes are kept, each cast to the given type. Naming the pivot values
    keeps this a single aggregation: no extra job to discover them, and rows of other
    attributes are dropped before the shuffle. ``first`` combines map-side.
    """
    codes = attributes.where(F.col("attribute_code").isin(*wanted)).select("attribute_id", "attribute_code")
    long = values.join(codes, "attribute_id")
    wide = long.groupBy("entity_id").pivot("attribute_code", list(wanted)).agg(F.first("value", True))
    return wide.select(
        "entity_id", *[F.col(code).try_cast(kind).alias(code) for code, kind in wanted.items()]
    )
