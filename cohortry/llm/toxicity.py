"""Toxicity by non-negative positive-unlabelled learning of a linear model over hashed subwords.

Confirmed toxic texts are the positives; all texts, whose labels are not looked at, are the unlabelled set. The risk of
the negatives is estimated as that of the unlabelled minus the prior times that of the positives, and where this
difference falls below zero the step is taken the other way, so that a flexible model can't make it ever smaller. Only
subwords that stand out among the positives have a weight. A text's value is the sum of these, damped by its length; a
logistic curve, fitted to positives kept out of the training and all unlabelled texts by the same risk, turns it into a
probability. No text is ever taken for a negative.

1. Tasks count how many texts hold each bucket; the sums give the telling buckets.
2. The texts, reduced to their telling buckets, are stored; most have none and are only counted.
3. Every step of the descent is one pass of the tasks over these, which adds up losses and gradients in two levels.

The positives are at most ``MOST_POSITIVE`` labelled rows, chosen by hash among all; scoring is one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortry.llm.text import rows_by, slices, subwords
from cohortry.session import written

BITS = 18
LENGTHS = (4, 6)
MOST_POSITIVE = 4_000
STEPS = 60
RATE = 1.0
#: Tasks' sums are added up by this many tasks before they go to the driver.
ADDERS = 4
#: Stored texts that a task of a step reads; small tables still have eight tasks.
STEP_ROWS = 100_000
#: Values of texts are counted in steps of this size, up to this one, to fit the curve.
VALUE_STEP, MOST_VALUE = 0.02, 200.0
#: Standard deviations by which a bucket's share among the positives must stand out.
CLEAR = 4.0


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    shift: float

    def values(self, texts: list[bytes]) -> np.ndarray:
        buckets, owners, words = subwords(texts, LENGTHS, BITS)
        held = np.flatnonzero(self.weights[buckets])
        keys, counts = np.unique(owners[held].astype(np.int64) << BITS | buckets[held], return_counts=True)
        return np.bincount(keys >> BITS, self.weights[keys & (1 << BITS) - 1] * _value(counts, words[keys >> BITS]), len(texts))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _logistic(self.slope * self.values(texts) + self.shift)


def _value(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a subword adds to its text: less than in proportion, so that neither repetition nor length decides."""
    return np.log1p(counts) / np.cbrt(np.maximum(words, 1))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _added(rows: DataFrame, sums: int) -> np.ndarray:
    """The sum of all rows of ``values`` (``sums`` doubles each), added up by ``ADDERS`` tasks and then by the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sums)
        for batch in batches:
            for values in batch.column(0).to_pylist():
                total += np.frombuffer(values, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["values"])

    parts = rows.repartition(ADDERS).mapInArrow(add, "values binary").collect()
    return np.sum([np.frombuffer(r["values"], "<f8") for r in parts], axis=0) if parts else np.zeros(sums)


def _one_row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["values"])


def bucket_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the texts (column ``text``) hold each bucket, and how many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1)
        for part, found in slices(batches, "text", 1 << 20):
            buckets, owners, _ = subwords(found, LENGTHS, BITS)
            held = np.unique(owners.astype(np.int64) << BITS | buckets) & (1 << BITS) - 1
            total[:-1] += np.bincount(held, minlength=1 << BITS)
            total[-1] += part.num_rows
        if total[-1]:
            yield _one_row(total)

    total = _added(texts.select("text").mapInArrow(count, "values binary"), (1 << BITS) + 1)
    return total[:-1], int(total[-1])


def encoded(rows: DataFrame, telling: np.ndarray) -> DataFrame:
    """role, spots, values of the rows (role, text) with telling buckets: their places among these, and what they add."""
    spot_of = np.cumsum(telling) - 1
    shared = rows.sparkSession.sparkContext.broadcast((telling, spot_of.astype("<i4")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", 1 << 20):
            buckets, owners, words = subwords(texts, LENGTHS, BITS)
            held = shared.value[0][buckets]
            keys, counts = np.unique(owners[held].astype(np.int64) << BITS | buckets[held], return_counts=True)
            values = _value(counts, words[keys >> BITS]).astype("<f4")
            bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) << BITS)
            spots = shared.value[1][keys & (1 << BITS) - 1]
            some = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(some)),
                    *(pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in some], pa.binary()) for x in (spots, values)),
                ],
                ["role", "spots", "values"],
            )

    return rows.select("role", "text").mapInArrow(encode, "role string, spots binary, values binary")


@dataclass
class _Texts:
    """Sparse rows: telling buckets and values of all, and where each begins."""

    spots: np.ndarray
    values: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, spots: list[bytes], values: list[bytes]) -> _Texts:
        sizes = [len(x) // 4 for x in spots]
        return cls(np.frombuffer(b"".join(spots), "<i4"), np.frombuffer(b"".join(values), "<f4"), np.cumsum([0, *sizes]))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owners(), weights[self.spots] * self.values, len(self))

    def gradient(self, of_text: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.spots, of_text[self.owners()] * self.values, n)


def _passed(table: DataFrame, sums: int, add: Callable[[_Texts], np.ndarray]) -> np.ndarray:
    """The sum of ``add`` over all stored texts, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sums)
        for batch in batches:
            if batch.num_rows:
                total += add(_Texts.of(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield _one_row(total)

    return _added(table.select("spots", "values").mapInArrow(run, "values binary"), sums)


class Unlabelled:
    """The stored texts with telling buckets, and how many have none."""

    def __init__(self, table: DataFrame, empty: int, n: int):
        self.table, self.empty, self.n = table.coalesce(max(8, (n - empty) // STEP_ROWS)), empty, n

    def negatives(self, weights: np.ndarray, bias: float) -> tuple[float, float, np.ndarray]:
        """Taken for negative: the mean loss, and the mean gradients by bias and weights."""

        def add(texts: _Texts) -> np.ndarray:
            values = texts.sums(weights) + bias
            score = _logistic(values)
            return np.concatenate([[np.logaddexp(0, values).sum(), score.sum()], texts.gradient(score, len(weights))])

        total = _passed(self.table, len(weights) + 2, add)
        total[:2] += self.empty * np.array([np.logaddexp(0, bias), _logistic(np.float64(bias))])
        total /= self.n
        return float(total[0]), float(total[1]), total[2:]

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """How many texts have a value in each step from -``MOST_VALUE`` up."""
        steps = int(2 * MOST_VALUE / VALUE_STEP) + 1
        place = lambda values: np.rint((np.clip(values, -MOST_VALUE, MOST_VALUE) + MOST_VALUE) / VALUE_STEP).astype(np.int64)
        total = _passed(self.table, steps, lambda texts: np.bincount(place(texts.sums(weights)), minlength=steps).astype(float))
        total[place(np.zeros(1))] += self.empty
        return total


def telling_buckets(positive: np.ndarray, unlabelled: np.ndarray, texts: tuple[int, int]) -> np.ndarray:
    """Buckets that clearly more positive texts hold than unlabelled ones: all others would only fit noise.

    By bucket how many texts of either kind hold it, and how many texts there are of either kind.
    """
    n = [max(1, x) for x in texts]
    rate = (positive + unlabelled + 1) / (n[0] + n[1] + 2)
    distance = (positive / n[0] - unlabelled / n[1]) / np.sqrt(rate * (1 - rate) * (1 / n[0] + 1 / n[1]))
    return (distance >= CLEAR) & (positive >= 3)


def non_negative_fit(positive: _Texts, unlabelled, prior: float, weights: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad on the logistic loss of the non-negative positive-unlabelled risk, over all texts at each step."""
    w, bias = np.zeros(weights), float(np.log(prior / (1 - prior)))
    squares, bias_squares = np.full(weights, 1e-12), 1e-12
    for _ in range(steps):
        values = positive.sums(w) + bias
        score = _logistic(values)
        n = max(1, len(positive))
        loss_u, slope_u, step_u = unlabelled.negatives(w, bias)
        negative = loss_u - prior * np.logaddexp(0, values).mean()
        as_positive, as_negative = positive.gradient(score - 1, weights) / n, positive.gradient(score, weights) / n
        if negative >= 0:
            step, slope = prior * (as_positive - as_negative) + step_u, prior * float((score - 1).mean() - score.mean()) + slope_u
        else:
            step, slope = prior * as_negative - step_u, prior * float(score.mean()) - slope_u
        squares += step * step
        w -= RATE * step / np.sqrt(squares)
        bias_squares += slope * slope
        bias -= 0.1 * slope / np.sqrt(bias_squares)
    return w, bias


def curve(positive: np.ndarray, spread: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve that minimise the risk, by Newton steps.

    ``spread`` counts the unlabelled values. Loss as positive minus loss as negative is the value itself, so the risk is
    that of the unlabelled taken for negative, minus the prior times the mean value of the positives: a convex function.
    """
    centres = np.arange(len(spread)) * VALUE_STEP - MOST_VALUE
    held = np.flatnonzero(spread)
    x = np.stack([centres[held], np.ones(len(held))], 1)
    share = spread[held] / spread.sum()
    pull = prior * np.array([positive.mean(), 1.0])
    best = np.array([1.0, 0.0])
    ridge = np.array([1e-4, 0.0])
    for _ in range(100):
        p = _logistic(x @ best)
        slope = x.T @ (share * p) - pull + ridge * best
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 2 / max(1e-12, np.abs(step).max()))
        best -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(best[0]), float(best[1])


def fit(documents: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", label_id: str = "doc_id") -> Model | None:
    """The model from labelled rows whose id satisfies ``learn``, a condition on the column ``id`` (None: all); None without toxic rows.

    Several labels of a document count as toxic if one is. All rows, whatever their labels, are the unlabelled set.
    """
    learn = F.lit(True) if learn is None else learn
    known = rows_by(labels, (label_id, "id"), (label, "toxic")).where("id is not null and toxic is not null").where(learn)
    known = known.groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = known.groupBy("toxic").count().collect()
    toxic_rows, clean_rows = (sum(r["count"] for r in counts if r.toxic == k) for k in (1, 0))
    if not toxic_rows:
        return None
    prior = min(0.5, toxic_rows / max(1, toxic_rows + clean_rows))
    rows = rows_by(documents, (doc_id, "id"), (text, "text")).where("id is not null").where(learn)
    chosen = known.where("toxic = 1").select("id", F.xxhash64("id", F.lit(6)).alias("order")).orderBy("order", "id").limit(MOST_POSITIVE)
    role = F.when(F.pmod(F.xxhash64("id", F.lit(16)), F.lit(4)) == 0, "spare").otherwise("positive")
    # at most ``MOST_POSITIVE`` ids; of several texts of an id the first
    confirmed = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text")).select(role.alias("role"), "text")
    confirmed = written(confirmed, "toxicity-positives")
    texts = {r.role: r["count"] for r in confirmed.groupBy("role").count().collect()}
    if not texts:
        return None
    first, spare = ("positive", "spare") if len(texts) == 2 else (min(texts), min(texts))  # few: all have one role
    held, n_positive = bucket_counts(confirmed.where(F.col("role") == first))
    all_held, n = bucket_counts(rows)
    telling = telling_buckets(held, all_held, (n_positive, n))
    by_role: dict[str, list] = {"positive": [], "spare": []}
    for row in encoded(confirmed, telling).collect():
        by_role[row.role].append(row)
    table = written(encoded(rows.select(F.lit("").alias("role"), "text"), telling), "toxicity-texts")
    unlabelled = Unlabelled(table, n - table.count(), n)
    positive, kept_out = (_Texts.of([r.spots for r in by_role[k]], [r["values"] for r in by_role[k]]) for k in (first, spare))
    weights, bias = non_negative_fit(positive, unlabelled, prior, int(telling.sum()))
    values = np.zeros(texts[spare])  # those without telling buckets have the value 0
    values[: len(kept_out)] = kept_out.sums(weights)
    whole = np.zeros(1 << BITS, np.float32)
    whole[telling] = weights
    return Model(whole, *curve(values, unlabelled.spread(weights), prior))


def scored(documents: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``documents`` and the probability of being toxic; 0 where nothing toxic was ever seen.

    NULL and empty texts get the value of a text without subwords. Raises if ``score`` is a column already.
    """
    if score in documents.columns:
        raise ValueError(f"the documents have a column {score}")
    if model is None:
        return documents.withColumn(score, F.lit(0.0))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text, 1 << 20):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(texts), pa.float64())], [*part.schema.names, score])

    rows = rows_by(documents, *((c, c) for c in documents.columns))
    return rows.mapInArrow(rate, StructType([*documents.schema, StructField(score, DoubleType())]))
