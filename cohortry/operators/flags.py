"""EXISTS tests over fact rows, cheap for a few leaves and for hundreds of them.

Most EXISTS leaves ask for equality with a value ("bought SKU x", "used coupon y").
Testing hundreds of those on every row would cost rows x leaves. Instead the values of
all leaves on one column become a small table value -> bit set, which is broadcast
joined to the rows: one hash look-up per row, and ``bit_or`` merges the bits of a group
62 leaves at a time. All other tests, and columns with few leaves, stay one ``bool_or``
per leaf. Both kinds of aggregate combine map-side.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.values import any_of
from ..session import small_table
from .joins import lookup_join

WORD_BITS = 62
LOOKUP_FROM = 8  # equality leaves on one column from which the look-up table pays
FILTER_UP_TO = 16  # more tests than this are not repeated as a row filter

_VALUE = "__value"


@dataclass(frozen=True)
class Feature:
    """One column of the feature table.

    ``source`` names the fact it is computed from; ``default`` (a SQL literal) stands in
    for customers without facts. An EXISTS flag also has its row-level test ``row`` and,
    if the test is "``key`` is one of ``values``", these two.
    """

    name: str
    source: str
    row: str | None = None
    default: str | None = None
    key: str | None = None
    values: tuple[str, ...] | tuple[int, ...] = ()


@dataclass(frozen=True)
class _Lookup:
    key: str
    flags: tuple[Feature, ...]
    words: tuple[str, ...]

    def bit(self, position: int) -> tuple[int, int]:
        return divmod(position, WORD_BITS)

    def table(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """One row per value with the bits of the leaves that ask for it."""
        bits: dict[object, list[int]] = {}
        for position, flag in enumerate(self.flags):
            word, shift = self.bit(position)
            for value in flag.values:
                bits.setdefault(value, [0] * len(self.words))[word] |= 1 << shift
        kind = LongType() if isinstance(self.flags[0].values[0], int) else StringType()
        schema = StructType([StructField(_VALUE, kind), *[StructField(word, LongType()) for word in self.words]])
        records = [(value, *words) for value, words in bits.items()]
        return small_table(rows.sparkSession, records, schema), len(records)


class Flags:
    """The EXISTS flags of one fact: how to test rows, merge groups, read results."""

    def __init__(self, flags: Iterable[Feature]) -> None:
        by_key: dict[str, list[Feature]] = {}
        self.tests: list[Feature] = []
        for flag in flags:
            if flag.values:
                by_key.setdefault(flag.key, []).append(flag)
            else:
                self.tests.append(flag)
        self.lookups: list[_Lookup] = []
        for key, equal in by_key.items():
            if len(equal) < LOOKUP_FROM:
                self.tests += equal
                continue
            prefix = f"{equal[0].source}_{len(self.lookups)}"
            count = -(-len(equal) // WORD_BITS)
            words = tuple(f"__{prefix}_w{n}" for n in range(count))
            self.lookups.append(_Lookup(key, tuple(equal), words))
        self.words = [word for lookup in self.lookups for word in lookup.words]

    def __bool__(self) -> bool:
        return bool(self.tests or self.lookups)

    @property
    def columns(self) -> list[str]:
        """The columns that carry the flags through joins and aggregations."""
        return [*self.words, *[flag.name for flag in self.tests]]

    def prepare(self, rows: DataFrame) -> DataFrame:
        """Rows with the bits their values raise; a left join, so no row is lost."""
        for lookup in self.lookups:
            table, count = lookup.table(rows)
            rows = lookup_join(rows.withColumn(_VALUE, F.expr(lookup.key)), table, _VALUE, count, "left").drop(_VALUE)
        return rows

    def raised_by_row(self) -> str:
        """Does a prepared row raise any flag? ``true`` when asking would cost too much."""
        if len(self.tests) > FILTER_UP_TO:
            return "true"
        return any_of([f"{word} <> 0" for word in self.words] + [flag.row for flag in self.tests])

    def raised(self) -> str:
        """The same for a group."""
        return any_of([f"{word} <> 0" for word in self.words] + [flag.name for flag in self.tests])

    def aggregates(self) -> list[Column]:
        """Prepared rows to groups."""
        return [
            *[F.expr(f"bit_or({word}) AS {word}") for word in self.words],
            *[F.expr(f"bool_or({flag.row}) AS {flag.name}") for flag in self.tests],
        ]

    def merged(self) -> list[Column]:
        """Groups to larger groups."""
        return [
            *[F.expr(f"bit_or({word}) AS {word}") for word in self.words],
            *[F.expr(f"bool_or({flag.name}) AS {flag.name}") for flag in self.tests],
        ]

    def readings(self) -> dict[str, str]:
        """Per flag the expression that reads it from the carrying columns."""
        found = {flag.name: flag.name for flag in self.tests}
        for lookup in self.lookups:
            for position, flag in enumerate(lookup.flags):
                word, shift = lookup.bit(position)
                found[flag.name] = f"(shiftright({lookup.words[word]}, {shift}) & 1L) = 1L"
        return found
