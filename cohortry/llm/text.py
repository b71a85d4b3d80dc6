"""Texts in Arrow batches: bounded slices, words, and their 64-bit hashes as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Python's ``bytes.lower()``
and ``bytes.split()`` mean exactly that on UTF-8.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cohortry.session import ship

SPACES = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 4 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: An odd number = 3 modulo 8, so that differences of its powers keep few factors of two.
_BASE = 0x9E3779B97F4A7C13
_MASK = (1 << 64) - 1
_LETTER = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_LETTER[list(SPACES)] = _LETTER[32]
_POWERS: list[np.ndarray] = []


def private(*names: str) -> list[str]:
    """Column names that no table of the caller can hold."""
    tag = uuid.uuid4().hex[:12]
    return [f"_{name}_{tag}" for name in names]


def lower_az(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the quick way for texts that are plain ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


@cache
def _trimming():
    """What gives free pages of the C library's heap back; None where that library cannot."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def release() -> None:
    """Gives memory that is free again back to the system: workers stay for later stages, and would hold on to it."""
    pa.default_memory_pool().release_unused()
    if trim := _trimming():
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to about ``limit`` bytes of text (one longer text stands alone), with the texts as bytes; NULL is empty.

    After the last one, the memory that they took goes back to the system.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            part = batch.slice(at, to - at)
            values = part.column(part.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            yield part, [x or b"" for x in values]
            at = to
        del batch, column, ends, part, values
    release()


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse, tables = pow(_BASE, -1, 1 << 64), []
        for b in (_BASE, inverse):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            tables.append(np.cumprod(factors, dtype=np.uint64))
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


def spans(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and where each word begins and ends."""
    letters = np.frombuffer(buffer, np.uint8)
    space = np.concatenate([[True], _IS_SPACE[letters], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return letters, edges[0::2], edges[1::2]


def _summed(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any range follows, and the factors that bring ranges to the same place."""
    power, inverse = _powers(len(letters) + 1)
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(_LETTER[letters] * power[: len(letters)], out=sums[1:])
    return sums, inverse


def span_hashes(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes, blind to the case of A-Z."""
    sums, inverse = _summed(letters)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _hashed(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    letters, starts, ends = spans(buffer)
    return span_hashes(letters, starts, ends), starts


def subwords(texts: list[bytes], lengths: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed subwords: bucket of each and the text it is from, in no order, and the words of each text.

    Subwords are the word itself and its byte ranges of the given lengths, where a space stands before every word. Texts
    are cut behind spaces into pieces of bounded size, so the caller passes whole texts of any length.
    """
    buckets, owners, words = [], [], np.zeros(len(texts), np.int64)
    for group in pieces(texts):
        buffer = b" " + b"\n".join(part for _, part in group) + b"\n"
        letters, starts, ends = spans(buffer)
        if not len(starts):
            continue
        sums, inverse = _summed(letters)
        of_word = np.repeat([i for i, _ in group], np.diff(np.searchsorted(starts, np.cumsum([0] + [len(part) + 1 for _, part in group]) + 1)))
        np.add.at(words, of_word, 1)
        found = mixed((sums[ends] - sums[starts]) * inverse[starts])
        buckets.append((found >> np.uint64(64 - bits)).astype(np.int32))
        owners.append(of_word.astype(np.int32))
        # every position belongs to the word that it is in or directly before
        sizes = ends - starts + 1
        position = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - position
        position += np.repeat(starts - 1, sizes)
        owner = np.repeat(of_word, sizes).astype(np.int32)
        for n in lengths:
            at = position[left >= n]
            found = mixed((sums[at + n] - sums[at]) * inverse[at] + np.uint64(n))
            buckets.append((found >> np.uint64(64 - bits)).astype(np.int32))
            owners.append(owner[left >= n])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), words
    return np.concatenate(buckets), np.concatenate(owners), words


def pieces(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[tuple[int, bytes]]]:
    """Texts with their numbers in groups of at most about ``limit`` bytes; longer ones are cut behind a space."""
    group, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            to = at + limit
            if to < len(text):
                cut = max(text.rfind(bytes([s]), at, to) for s in SPACES)
                if cut < at:  # one word longer than a piece
                    cut = min((x for s in SPACES if (x := text.find(bytes([s]), to)) >= 0), default=len(text) - 1)
                to = cut + 1
            part = text[at:to]
            if group and size + len(part) > limit:
                yield group
                group, size = [], 0
            group.append((i, part))
            size += len(part)
            at = to
    if group:
        yield group


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for group in pieces(texts):
        found, starts = _hashed(b"\n".join(part for _, part in group))
        stops = np.cumsum([len(part) + 1 for _, part in group])
        np.add.at(counts, [i for i, _ in group], np.diff(np.searchsorted(starts, stops), prepend=0))
        hashes.append(found)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


class Recent:
    """Results of a function by word: those met lately, in two generations of at most about ``limit`` each.

    ``now`` holds every word of the last call of ``learn``."""

    def __init__(self, function, limit: int = 200_000):
        self.function, self.limit = function, limit
        self.now: dict = {}
        self.before: dict = {}

    def learn(self, words: set) -> None:
        if len(self.now) > self.limit:
            self.before, self.now = self.now, {}
        fresh = words - self.now.keys()
        again = fresh & self.before.keys()
        self.now.update((w, self.before[w]) for w in again)
        if fresh := list(fresh - again):
            self.now.update(zip(fresh, self.function(fresh)))


def rows_by(table: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Only the named columns, renamed: extra columns of the caller never meet ours.

    Where the workers would not find this package by themselves, Spark sends it to them first."""
    ship(table.sparkSession.sparkContext)
    return table.select(*(F.col(f"`{old}`").alias(new) for old, new in columns))
