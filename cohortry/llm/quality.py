"""Text quality by a generalised additive model with pairwise interactions, learnt by cyclic boosting.

A text is a row of numbers about its words, signs, lines and repetitions (``FEATURES``), computed over the whole text.
Every number has bins, cut at quantiles of the rows that teach. Shallow trees on one number at a time, each fitted to
what all others leave unexplained, are added up into one table per number (cyclic boosting: every number has its turn
in every round); then the pairs of numbers that explain most of the rest get tables of two numbers the same way. A
score is the logistic of the sum of the looked-up bins, so scoring is a few additions per text for whole batches.

Fitting uses at most ``MOST_ROWS`` labelled rows, chosen by hash among all; only their numbers go to the driver. Scoring
is one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortry.llm.text import pieces, rows_by, slices, word_hashes
from cohortry.session import written

FEATURES = (
    "words", "letters a word", "longest word", "capital share", "digit share", "mark share", "sign share", "words with signs",
    "words all in capitals", "words without letters", "short words", "words a line", "repeated lines", "distinct words",
    "commonest word", "same word again", "repeated triples",
)
MOST_ROWS = 20_000
BINS = 48
PAIR_BINS = 12
PAIRS = 8
ROUNDS = 60
PAIR_ROUNDS = 30
RATE = 0.2
SMOOTH = 1.0

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 capital, 4 digit, 8 mark of punctuation, 16 other sign, 32 white space, 64 inside a character
_KIND[[*range(97, 123), *range(192, 256)]] = 1
_KIND[65:91] = 1 | 2
_KIND[48:58] = 4
_KIND[list(b".,;:'-\"()?")] = 8
_KIND[list(b" \t\n\x0b\x0c\r")] = 32
_KIND[128:192] = 64
_KIND[_KIND == 0] = 16


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` per text; all zeros for a text without words."""
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    sums = np.zeros((n, 11))  # characters, letters, capitals, digits, marks, signs; words with signs, all capitals, without letters, short; words
    longest = np.zeros(n, np.int64)
    for group in pieces(texts):
        buffer = b"\n".join(part for _, part in group) + b"\n"
        kind = _KIND[np.frombuffer(buffer, np.uint8)]
        space = kind == 32
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        if not len(starts):
            continue
        of = np.array([i for i, _ in group])
        owner = of[np.searchsorted(np.cumsum([len(part) + 1 for _, part in group]), starts, "right")]
        held = {}
        for name, bits in (("characters", 1 | 4 | 8 | 16), ("letters", 1), ("capitals", 2), ("digits", 4), ("marks", 8), ("signs", 16)):
            running = np.concatenate([[0], np.cumsum((kind & bits) > 0)])
            held[name] = running[ends] - running[starts]
        word = [
            held["signs"] > 0, (held["capitals"] > 1) & (held["capitals"] == held["letters"]), held["letters"] == 0,
            held["letters"] <= 2, np.ones(len(starts)),
        ]
        for k, values in enumerate([*held.values(), *word]):
            sums[:, k] += np.bincount(owner, values, n)
        np.maximum.at(longest, owner, held["characters"])
    count = np.maximum(sums[:, 10], 1)
    characters, letters = np.maximum(sums[:, 0], 1), np.maximum(sums[:, 1], 1)
    out[:, 0] = np.log2(1 + sums[:, 10])
    out[:, 1] = sums[:, 1] / count
    out[:, 2] = np.log2(1 + longest)
    out[:, 3], out[:, 4] = sums[:, 2] / letters, sums[:, 3] / characters
    out[:, 5], out[:, 6] = sums[:, 4] / count, sums[:, 5] / count
    out[:, 7:11] = sums[:, 6:10] / count[:, None]
    lines = [[x for x in text.split(b"\n") if x.strip()] for text in texts]
    out[:, 11] = np.log2(1 + sums[:, 10] / np.maximum([len(x) for x in lines], 1))
    out[:, 12] = [1 - len(set(x)) / len(x) if x else 0 for x in lines]
    _repetitions(texts, out)
    out[sums[:, 10] == 0] = 0
    return out


def _repetitions(texts: list[bytes], out: np.ndarray) -> None:
    hashes, counts = word_hashes(texts)
    if not len(hashes):
        return
    n = len(texts)
    owner = np.repeat(np.arange(n), counts)
    size = np.maximum(counts, 1)
    order = np.lexsort((hashes, owner))
    of, word = owner[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (word[1:] != word[:-1])]))
    times = np.diff(np.append(first, len(word)))
    # beside the count of distinct words, its share of what a text of that length may have
    out[:, 13] = np.bincount(of[first], minlength=n) / size
    most = np.zeros(n)
    np.maximum.at(most, of[first], times)
    out[:, 14] = most / size
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])])
    out[:, 15] = np.bincount(owner, same, n) / size
    if len(hashes) > 2:
        whole = np.flatnonzero(owner[2:] == owner[:-2])
        triple = hashes[whole] * np.uint64(3) + hashes[whole + 1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[whole + 2]
        order = np.lexsort((triple, owner[whole]))
        of, triple = owner[whole][order], triple[order]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (triple[1:] != triple[:-1])]) if len(of) else np.zeros(0, bool)
        out[:, 16] = 1 - np.bincount(of, new, n) / np.maximum(np.bincount(of, minlength=n), 1)
        out[np.bincount(of, minlength=n) == 0, 16] = 0


@dataclass
class Model:
    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def sums(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], rows[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], rows[:, k], "right") for pair in self.pairs for k in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[a], coarse[b]]
        return total

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _logistic(self.sums(features(texts)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins at quantiles, none twice; the lowest value is below the first cut."""
    found = np.unique(np.quantile(values, np.arange(1, bins) / bins))
    return found[found > values.min()]


def _cut(slope: np.ndarray, bend: np.ndarray) -> tuple[float, int]:
    """The best place to split ordered bins in two, and what it gains."""
    if len(slope) < 2:
        return 0.0, 0
    left, weight = np.cumsum(slope)[:-1], np.cumsum(bend)[:-1]
    all_slope, all_bend = slope.sum(), bend.sum()
    value = left**2 / (weight + SMOOTH) + (all_slope - left) ** 2 / (all_bend - weight + SMOOTH) - all_slope**2 / (all_bend + SMOOTH)
    at = int(value.argmax())
    return float(value[at]), at + 1


def _tree(slope: np.ndarray, bend: np.ndarray, depth: int) -> np.ndarray:
    """Step per bin of a tree of that depth over ordered bins."""
    gain, at = _cut(slope, bend) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(slope), slope.sum() / (bend.sum() + SMOOTH))
    return np.concatenate([_tree(slope[:at], bend[:at], depth - 1), _tree(slope[at:], bend[at:], depth - 1)])


def _pair_tree(slope: np.ndarray, bend: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut of the first number, and one of the second on either side (or the other way round): gain and steps."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros(slope.shape))
    for turned in (False, True):
        s, b = (slope.T, bend.T) if turned else (slope, bend)
        base = s.sum() ** 2 / (b.sum() + SMOOTH)
        for at in range(1, len(s)):
            value, steps = -base, np.zeros(s.shape)
            for side in (slice(0, at), slice(at, None)):
                across, weight = s[side].sum(axis=0), b[side].sum(axis=0)
                steps[side] = _tree(across, weight, 1)
                value += (2 * across * steps[side][0] - (weight + SMOOTH / 2) * steps[side][0] ** 2).sum()
            if value > best[0]:
                best = (float(value), steps.T if turned else steps)
    return best


def train(rows: np.ndarray, good: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Model:
    """Tables by cyclic boosting on the logistic loss."""
    share = min(1 - 1e-3, max(1e-3, good.mean()))
    model = Model([_edges(c, BINS) for c in rows.T], [_edges(c, PAIR_BINS) for c in rows.T], float(np.log(share / (1 - share))), [], [], [])
    fine = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, rows.T)]
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(model.pair_edges, rows.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(rows), model.base)
    for _ in range(rounds):
        for k, bins in enumerate(fine):
            chance = _logistic(total)
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(bins, good - chance, size), np.bincount(bins, chance * (1 - chance), size), 2)
            model.tables[k] += step
            total += step[bins]

    def by_pair(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).reshape(shape)

    def fitted(a: int, b: int) -> tuple[float, np.ndarray]:
        chance = _logistic(total)
        return _pair_tree(by_pair(a, b, good - chance), by_pair(a, b, chance * (1 - chance)))

    all_pairs = [(a, b) for a in range(rows.shape[1]) for b in range(a)]
    gains = {pair: fitted(*pair)[0] for pair in all_pairs}
    model.pairs = sorted(all_pairs, key=lambda p: (-gains[p], p))[:pairs]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            step = RATE * fitted(a, b)[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def numbers(rows: DataFrame) -> DataFrame:
    """good, numbers (doubles) of rows with good and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found = features(texts).astype("<f8")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["good", "numbers"])

    return rows.select("good", "text").mapInArrow(count, "good int, numbers binary")


def fit(
    documents: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", label_id: str = "doc_id", most_rows: int = MOST_ROWS,
) -> Model | None:
    """The model from labelled rows whose id satisfies ``learn``, a condition on the column ``id`` (None: all).

    Several labels of a document count as good if one is; rows without an id or label teach nothing, a NULL text counts as
    empty. None without any row that teaches.
    """
    learn = F.lit(True) if learn is None else learn
    known = rows_by(labels, (label_id, "id"), (label, "good")).where("id is not null and good is not null").where(learn)
    known = known.groupBy("id").agg(F.max(F.col("good").cast("int")).alias("good"))
    rows = rows_by(documents, (doc_id, "id"), (text, "text")).where("id is not null")
    # labels of documents that are not in the table must not use up the bound
    known = known.join(rows.select("id").distinct(), "id", "left_semi")
    chosen = written(known.orderBy(F.xxhash64("id", F.lit(12)), "id").limit(most_rows), "quality-labels")
    # of several texts of an id the first teaches
    taught = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("good").alias("good"), F.min("text").alias("text"))
    found = numbers(taught.select("good", "text")).collect()  # at most ``most_rows`` short rows
    if not found:
        return None
    found = sorted((r.good, bytes(r.numbers)) for r in found)  # the order of tasks must not matter
    return train(np.array([np.frombuffer(x, "<f8") for _, x in found]), np.array([float(g > 0) for g, _ in found]))


def scored(documents: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``documents`` and the probability of being good; 0.5 where nothing was learnt.

    NULL and empty texts get the score of a text without words. A column named like the score is replaced.
    """
    others = [c for c in documents.columns if c != score or c == text]
    rows = rows_by(documents, *((c, c) for c in others))
    if model is None:
        return rows.withColumn(score, F.lit(0.5))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(texts), pa.float64())], [*part.schema.names, score])

    return rows.mapInArrow(rate, StructType([*(documents.schema[c] for c in others), StructField(score, DoubleType())]))
