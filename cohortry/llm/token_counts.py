"""Token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays.

A slice of texts is cut into pre-tokens. Those not met before by this worker become one flat array of symbols with
sequence bounds; each round finds every sequence's lowest-rank pair, merges all its occurrences at once, and drops the
sequences in which nothing is left to merge. What counts is the number of surviving symbols.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from cohortry.llm.text import Recent, rows_by, slices

#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NO_RANK = np.iinfo(np.int32).max
#: A space before more white space or the end: only then can a run of white space reach beyond one space.
LOOSE_SPACE = regex.compile(r" (?:\s|$)")


def byte_names() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The merge table of a vocabulary file; the counts of pre-tokens, and of words behind a space, met so far."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        ids = spec["model"]["vocab"]
        names = byte_names()
        self.symbol = np.array([ids[names[b]] for b in range(256)], np.int64)
        self.width = max(ids.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        self._index(keys)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known = Recent(self._merged_words)
        self.spaced = Recent(lambda words: self._plain([" " + w for w in words]))

    def _index(self, keys: np.ndarray) -> None:
        """Open addressing in a table of few collisions: a pair is found within ``reach`` places of its own."""
        self.table, self.rank_at = np.full(1 << 20, -1, np.int64), np.full(1 << 20, NO_RANK, np.int32)
        self.reach, place, todo = 0, self._place(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.table[place[todo] + self.reach & 0xFFFFF] < 0]
            _, first = np.unique(place[free] + self.reach & 0xFFFFF, return_index=True)
            free = free[first]
            at = place[free] + self.reach & 0xFFFFF
            self.table[at], self.rank_at[at] = keys[free], free
            todo = np.setdiff1d(todo, free)
            self.reach += 1

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        rank = np.where(self.table[place] == keys, self.rank_at[place], NO_RANK)
        for step in range(1, self.reach):
            open_ = np.flatnonzero(rank == NO_RANK)
            at = place[open_] + step & 0xFFFFF
            rank[open_] = np.where(self.table[at] == keys[open_], self.rank_at[at], NO_RANK)
        return rank

    def merged(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each word has in the end."""
        sizes = np.array([len(w) for w in words], np.int64)
        result = sizes.copy()
        symbols = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), sizes)
        while len(symbols) > 1:
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            rank = np.full(len(symbols), NO_RANK, np.int32)
            inner = np.flatnonzero(of[:-1] == of[1:])
            rank[inner] = self.rank(symbols[inner] * self.width + symbols[inner + 1])
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(of)))
            live = np.repeat(least < NO_RANK, lengths)
            hit = (rank == np.repeat(least, lengths)) & (rank < NO_RANK)
            # in a run of overlapping pairs (the same symbol again and again) every second one is merged
            begins = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            where = np.flatnonzero(hit)
            run = np.repeat(begins, np.diff(np.append(np.searchsorted(where, begins), len(where))))
            where = where[(where - run) % 2 == 0]
            symbols[where] = self.made[rank[where]]
            keep = live
            keep[where + 1] = False
            np.subtract.at(result, of[where], 1)
            symbols, of = symbols[keep], of[keep]
        return result

    def _merged_words(self, words: list[str]) -> list[int]:
        result = []
        for at in range(0, len(words), 20_000):
            result += self.merged([w.encode() for w in words[at : at + 20_000]]).tolist()
        return result

    def _plain(self, texts: list[str]) -> list[int]:
        """Counts of texts without special strings."""
        pieces = [PRE_TOKEN.findall(x) for x in texts]
        self.known.learn(set().union(*pieces))
        return [sum(map(self.known.now.__getitem__, words)) for words in pieces]

    def counts(self, texts: list[str]) -> list[int]:
        """Where every space stands before something else, no pre-token crosses one, and words are counted by look-up."""
        result, whole, cut = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            parts = [text]
            if self.special and (found := self.special.findall(text)):
                result[i] = len(found)
                parts = self.special.split(text)
            for part in parts:
                if LOOSE_SPACE.search(part):
                    whole.append((i, part))
                else:
                    first, *words = part.split(" ")
                    whole.append((i, first))
                    cut.append((i, words))
        self.spaced.learn(set().union(*(words for _, words in cut)))
        for i, words in cut:
            result[i] += sum(map(self.spaced.now.__getitem__, words))
        for (i, _), n in zip(whole, self._plain([part for _, part in whole])):
            result[i] += n
        return result


@cache
def _merges(definition: str) -> Merges:
    return Merges(definition)


def token_counts(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of ``documents``.

    ``vocabulary``: path of a byte-level BPE in the JSON form of the ``tokenizers`` library; the driver reads it and
    its text travels with the tasks. The counts are the library's without begin, end or added tokens; special strings
    inside a text are one token each. NULL counts as empty (0 bytes, 0 tokens); repeated rows each give a row.
    """
    with open(vocabulary, encoding="utf-8") as file:
        definition = documents.sparkSession.sparkContext.broadcast(file.read())
    rows = rows_by(documents, (doc_id, "doc_id"), (text, "text")).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(definition.value)
        for part, texts in slices(batches, "text"):
            found = pa.array(merges.counts([x.decode("utf-8", "replace") for x in texts]), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], ["doc_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
