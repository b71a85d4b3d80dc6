"""Spelling variants: words one insertion, deletion or replacement apart, by bitsets over positions and letters.

Two words that differ by one code point agree before the first difference and behind it. So every word joins groups of
a region ``[lo, hi)`` of the shorter word's places: the first difference lies inside, and the members share all ``lo``
code points before the region and all behind it. Each word is in the groups of its own length and of the one below,
where it is the longer of a pair. Groups of more than ``MOST_MEMBERS`` words halve their region until it is one place
wide, which leaves at most the alphabet squared: no group grows with the vocabulary, and no two groups find a pair twice.

A task takes sorted groups and lays their words out in 64-bit slots. Per slot, place and letter one bitset says which
words have that letter there. A word is looked up in all slots of its group at once: the words that agree so far (no
error) and those that agree but for one replaced, inserted or deleted code point (one error, places shifted by one
where needed) are advanced letter by letter with a few operations on whole bitsets. As the words of a group lie by
falling count, the lowest bit left is the near word with the largest count, and the population count is their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortry.llm.text import rows_by
from cohortry.session import written

RUN = "[A-Za-z\\u00C0-\\u00FF]"
MOST_MEMBERS = 2048
SLOT = 64
#: Bitsets (8 bytes each) and look-ups that a task holds at a time; one group is never split.
CHUNK_SETS = 1 << 20
CHUNK_LOOKUPS = 1 << 17
BROADCAST_GROUPS = 50_000

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_points: int = 7, least_times: int = 2, spoil: int = 31) -> DataFrame:
    """word, n: maximal runs of ``RUN`` with A-Z lower-cased, those of ``least_points`` and more that occur ``least_times``.

    A run whose crc32 with its document's id is divisible by ``spoil`` loses one code point first (0: none does). NULL
    texts have no runs, a NULL id is written as an empty one. Equal rows count each. Extra columns are not looked at.
    """
    rows = rows_by(documents, (doc_id, "id"), (text, "text"))
    # shorter runs can't become long enough; maximal runs, as a match is greedy and begins where a run begins
    run = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = rows.select("id", F.explode(F.expr(f"regexp_extract_all(text, '{RUN}{{{least_points},}}', 0)")).alias("run"))
    found = found.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), run.alias("word"))
    if spoil:
        found = found.withColumn("h", F.crc32(F.concat_ws(":", "id", "word").cast("binary")))
        cut = "cast(h % char_length(word) as int)"
        without = F.expr(f"concat(substring(word, 1, {cut}), substring(word, {cut} + 2))")
        found = found.withColumn("word", F.when(F.col("h") % spoil == 0, without).otherwise(F.col("word"))).where(F.char_length("word") >= least_points)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times)


def _keyed(rows: DataFrame) -> DataFrame:
    """With the key of what the members of a region share."""
    return rows.withColumn("key", F.expr("xxhash64(substring(word, 1, lo), right(word, greatest(size - hi, 0)))"))


def regions(words: DataFrame, most_members: int = MOST_MEMBERS) -> DataFrame:
    """size, lo, hi, key, word, n: every word in all its groups, none of which holds more than it must.

    ``size`` is the length of the shorter word of the pairs looked for; ``hi`` = size + 1 stands for a difference at
    the end of the longer word.
    """
    halves = "explode(array(struct(0 as lo, size div 2 as hi), struct(size div 2 as lo, size + 1 as hi)))"
    rows = words.select("word", "n", F.expr("explode(array(char_length(word), char_length(word) - 1))").alias("size")).where("size > 0")
    rows = _keyed(rows.select("*", F.expr(halves).alias("region")).where("region.lo < region.hi").select("size", "region.lo", "region.hi", "word", "n"))
    settled, group = None, ["size", "lo", "hi", "key"]
    while True:
        hot = written(rows.groupBy(*group).count().where(f"count > {most_members} and hi - lo > 1").drop("count"), "hot-regions")
        many = hot.count()
        if not many:
            return rows if settled is None else settled.unionByName(rows)
        # at most a row for each ``most_members`` rows; few are broadcast, many are joined
        hot = F.broadcast(hot) if many <= BROADCAST_GROUPS else hot
        calm = rows.join(hot, group, "left_anti")
        settled = calm if settled is None else settled.unionByName(calm)
        middle = "(lo + hi) div 2"
        parts = f"explode(array(struct(lo, {middle} as hi), struct({middle} as lo, hi)))"
        split = rows.join(hot, group, "left_semi").select("size", F.expr(parts).alias("region"), "word", "n").select("size", "region.lo", "region.hi", "word", "n")
        rows = written(_keyed(split), "split-regions")


class _Region:
    """Groups of one region: words of ``size`` and ``size`` + 1 code points, a group's words by falling count."""

    def __init__(self, size: int, lo: int, hi: int, groups: np.ndarray, words: list[str]):
        self.size, self.lo, self.hi = size, lo, hi
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet, letters = np.unique(codes, return_inverse=True)
        self.longer = lengths > size
        self.letters = np.full((len(words), size + 1), len(self.alphabet), np.int32)
        self.letters[np.arange(size + 1) < lengths[:, None]] = letters
        # groups begin a slot of their own unless they fit into the rest of the one before
        sizes = np.diff(np.append(groups, len(words)))
        first = np.zeros(len(sizes), np.int64)
        at = 0
        for k, n in enumerate(sizes.tolist()):
            if at % SLOT + n > SLOT:
                at = -(-at // SLOT) * SLOT
            first[k] = at
            at += n
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(words)) - groups[owner] + first[owner]
        self.slot, self.bit = place // SLOT, place % SLOT
        self.slots = int(self.slot.max()) + 1
        self.word_at = np.full(self.slots * SLOT, -1, np.int64)
        self.word_at[place] = np.arange(len(words))
        self.first, self.last = first[owner] // SLOT, (first + sizes - 1)[owner] // SLOT

    def bitsets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By slot, place and letter the words with that letter there; by slot the words of the two lengths.

        The last letter stands for none, the last place is empty, so that places may be asked for beyond the end.
        """
        sets = np.zeros((self.slots, self.size + 2, len(self.alphabet) + 1), np.uint64)
        lengths = np.zeros((2, self.slots), np.uint64)
        places = np.arange(self.size + 1)
        for bit in range(SLOT):
            # one word at most for each slot: no index occurs twice
            own = np.flatnonzero(self.bit == bit)
            sets[self.slot[own][:, None], places, self.letters[own]] |= np.uint64(1 << bit)
            lengths[self.longer[own].astype(int), self.slot[own]] |= np.uint64(1 << bit)
        sets[:, :, -1] = 0
        return sets, lengths[0], lengths[1]

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words with near words, how many, and the first of them."""
        sets, short, long = self.bitsets()
        span = self.last - self.first + 1
        upto = np.cumsum(span)
        at = 0
        while at < len(span):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK_LOOKUPS, "right")))
            word = np.repeat(np.arange(at, to), span[at:to])
            begin = np.cumsum(span[at:to]) - span[at:to]
            slot = self.first[word] + np.arange(len(word)) - begin[word - at]
            found = np.zeros(len(word), np.uint64)
            for longer, look in ((False, self._up), (True, self._down)):
                own = np.flatnonzero(self.longer[word] == longer)
                if len(own):
                    found[own] = look(sets, short[slot[own]], long[slot[own]], slot[own], self.letters[word[own]])
            counts = np.add.reduceat(np.bitwise_count(found).astype(np.int64), begin)
            lowest = np.log2((found & (~found + np.uint64(1))).astype(np.float64), where=found > 0, out=np.zeros(len(found))).astype(np.int64)
            place = np.where(found > 0, slot * SLOT + lowest, len(self.word_at))
            best = np.minimum.reduceat(place, begin)
            hit = np.flatnonzero(counts)
            yield np.arange(at, to)[hit], counts[hit], self.word_at[best[hit]]
            at = to

    def _inside(self, kept: np.ndarray, same: np.ndarray, place: int) -> np.ndarray:
        """Only words whose first difference lies in the region: equal up to ``lo`` and not up to ``hi``."""
        if place == self.lo:
            kept = kept & same
        if place == self.hi:
            kept = kept & ~same
        return kept

    def _up(self, sets, short, long, slot, letters) -> np.ndarray:
        """Words of the same length with one code point replaced, and of one more with one inserted."""
        same = np.full(len(slot), _ALL)
        replaced, inserted = np.zeros(len(slot), np.uint64), np.zeros(len(slot), np.uint64)
        kept = self._inside(np.full(len(slot), _ALL), same, 0)
        for i in range(self.size):
            here, shifted = sets[slot, i, letters[:, i]], sets[slot, i + 1, letters[:, i]]
            inserted = (inserted | same) & shifted
            replaced = (replaced & here) | (same & ~here)
            same = same & here
            kept = self._inside(kept, same, i + 1)
        return (replaced & short | (inserted | same) & long) & kept

    def _down(self, sets, short, long, slot, letters) -> np.ndarray:
        """Words of one code point less, which the longer word has beside theirs."""
        same, deleted = np.full(len(slot), _ALL), np.zeros(len(slot), np.uint64)
        kept = self._inside(np.full(len(slot), _ALL), same, 0)
        for i in range(self.size + 1):
            shifted = sets[slot, i - 1, letters[:, i]] if i else deleted
            deleted = (deleted & shifted) | same
            same = same & sets[slot, i, letters[:, i]]
            if i < self.size:
                kept = self._inside(kept, same, i + 1)
        return deleted & short & kept


def _looked_up(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of whole groups, sorted; those with a partner inside their group are looked up region by region."""
    columns = [table.column(k).combine_chunks() for k in range(4)]
    size, lo, hi, key = (c.to_numpy(zero_copy_only=False) for c in columns)
    new_region = np.zeros(len(size), bool)
    new_region[0] = True
    new_region[1:] = (size[1:] != size[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    new_group = new_region.copy()
    new_group[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new_group)
    counts = np.diff(np.append(starts, len(size)))
    partners = np.repeat(counts > 1, counts)
    rows = np.flatnonzero(partners)
    if not len(rows):
        return
    region, group = np.cumsum(new_region)[rows], np.cumsum(new_group)[rows]
    words = table.column(4).take(pa.array(rows)).to_pylist()
    times = table.column(5).combine_chunks().to_numpy(zero_copy_only=False)[rows]
    edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(rows))
    at = 0
    while at < len(edges) - 1:
        # groups of one region, as many as fit into a chunk of bitsets
        first = edges[at]
        most = max(1, CHUNK_SETS // ((int(size[rows[first]]) + 2) * 32) * SLOT // 2)
        to = int(np.searchsorted(edges, first + most, "right")) - 1
        to = max(at + 1, min(to, int(np.searchsorted(edges, np.searchsorted(region, region[first], "right")))))
        end, k = edges[to], rows[first]
        part = _Region(int(size[k]), int(lo[k]), int(hi[k]), edges[at:to] - first, words[first:end])
        for word, n, best in part.near():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([words[first + w] for w in word], pa.string()),
                    pa.array(n, pa.int64()),
                    pa.array([words[first + w] for w in best], pa.string()),
                    pa.array(times[first + best], pa.int64()),
                ],
                ["word", "n_near", "near", "near_n"],
            )
        at = to


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in tables that end where a group ends; a group has bounded size, so a table has too."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 1 << 16:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[-1].as_py() for k in range(4)]
        cut = table.num_rows
        same = np.ones(cut, bool)
        for k, value in enumerate(last):
            same &= table.column(k).to_numpy() == value
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from _looked_up(table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held:
        yield from _looked_up(pa.Table.from_batches(held))


def near_words(words: DataFrame, most_members: int = MOST_MEMBERS) -> DataFrame:
    """word, n_near, near, near_n: for words with near words their number and the first by count, then code points."""
    rows = regions(words, most_members)
    group = ["size", "lo", "hi", "key"]
    rows = rows_by(rows, *((c, c) for c in [*group, "word", "n"]))
    parts = rows.repartition(*group).sortWithinPartitions(*group, F.desc("n"), "word")
    found = parts.mapInArrow(_found, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.near", (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for rows of word, form: where following forms ends. Steps double, as each form stands for many more words."""
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        reached = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return reached


def variants(words: DataFrame, times: int = 10, most_members: int = MOST_MEMBERS) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct ``words`` (word, n).

    Near words differ by one code point inserted, deleted or replaced. ``form`` is the near word with the largest n
    (ties: smallest by code points) if that is at least ``times`` the word's n, else NULL; ``root`` follows the forms to
    the last. NULL and empty words are left out; an empty table gives no rows. A task holds a few groups of bounded
    size, and bitsets as long as the longest word of them.
    """
    words = written(rows_by(words, ("word", "word"), ("n", "n")).where("word is not null and word <> ''"), "words")
    found = written(near_words(words, most_members), "near-words")
    is_form = F.col("near_n") >= times * F.col("n")
    whole = words.join(found, "word", "left").select(
        "word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n")
    )
    whole = written(whole, "forms")
    last = roots(whole.where("form is not null"))
    return whole.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
