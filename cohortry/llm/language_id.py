"""Language identification by averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is the mean of its subwords' vectors; a linear layer gives each language's value. As all of this is linear,
scoring needs one table of bucket by language. A temperature is fitted to rows kept out of the training, and so is the
confidence below which a prediction is marked as rejected.

Fitting uses at most ``MOST_ROWS`` rows of each language, chosen by hash among all; prediction is one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortry.llm.text import rows_by, slices, subwords

BITS = 16
LENGTHS = (2, 3, 4)
WIDTH = 16
MOST_ROWS = 800
EPOCHS = 6
ACCEPTED = 0.995
NO_LANGUAGE = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    temperature: float
    least: float

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability; ``und`` and 0 for a text without letters."""
        buckets, owners, _ = subwords(texts, LENGTHS, BITS)
        n = np.maximum(np.bincount(owners, minlength=len(texts)), 1)
        values = np.stack([np.bincount(owners, self.table[buckets, k], len(texts)) / n for k in range(len(self.languages))], 1)
        chances = _softmax(values * self.temperature)
        best = chances.argmax(axis=1)
        letters = np.array([LETTER.search(x.decode("utf-8", "replace")) is not None for x in texts], bool)
        names = [self.languages[k] if ok else NO_LANGUAGE for k, ok in zip(best, letters)]
        return names, np.where(letters, chances[np.arange(len(texts)), best], 0.0)


def _softmax(values: np.ndarray) -> np.ndarray:
    e = np.exp(values - values.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def encoded(rows: DataFrame) -> DataFrame:
    """language, spare, buckets, shares (of each bucket in the text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            buckets, owners, _ = subwords(texts, LENGTHS, BITS)
            keys, counts = np.unique(owners.astype(np.int64) << BITS | buckets, return_counts=True)
            bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) << BITS)
            ids = (keys & (1 << BITS) - 1).astype("<u2")
            shares = [(counts[a:b] / max(1, counts[a:b].sum())).astype("<f4").tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()), pa.array(shares, pa.binary())],
                ["language", "spare", "buckets", "shares"],
            )

    return rows.select("language", "spare", "text").mapInArrow(encode, "language string, spare boolean, buckets binary, shares binary")


def train(texts: list[tuple[np.ndarray, np.ndarray]], languages: np.ndarray, n: int, seed: int = 0, epochs: int = EPOCHS) -> np.ndarray:
    """The table of bucket by language after SGD over single texts in small batches."""
    draw = np.random.Generator(np.random.PCG64(seed))
    vectors = draw.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    layer = draw.normal(0, 0.1, (WIDTH, n)).astype(np.float32)
    batch, steps, step = 16, epochs * -(-len(texts) // 16), 0
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            rate = 5.0 * (1 - step / steps) + 0.05
            ids = np.concatenate([texts[i][0] for i in chosen]).astype(np.int64)
            shares = np.concatenate([texts[i][1] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(texts[i][0]) for i in chosen])
            mean = np.zeros((len(chosen), WIDTH), np.float32)
            np.add.at(mean, owner, vectors[ids] * shares[:, None])
            wrong = _softmax(mean @ layer)
            wrong[np.arange(len(chosen)), languages[chosen]] -= 1
            back = wrong @ layer.T
            layer -= rate / len(chosen) * (mean.T @ wrong)
            np.add.at(vectors, ids, -rate * 4 / len(chosen) * shares[:, None] * back[owner])
            step += 1
    return vectors @ layer


def calibrate(values: np.ndarray, languages: np.ndarray, accepted: float = ACCEPTED) -> tuple[float, float]:
    """The factor on the values with the least log loss, and the least confidence from which on predictions are right often enough."""
    factors = np.geomspace(0.05, 50, 61)
    rows = np.arange(len(values))
    losses = [-np.log(_softmax(values * f)[rows, languages] + 1e-12).mean() for f in factors]
    factor = float(factors[int(np.argmin(losses))])
    chances = _softmax(values * factor)
    confidence, right = chances.max(axis=1), chances.argmax(axis=1) == languages
    order = np.argsort(-confidence)
    share = np.cumsum(right[order]) / (np.arange(len(order)) + 1)
    fine = np.flatnonzero(share >= accepted)
    return factor, float(confidence[order][fine[-1]]) if len(fine) else 1.0


def fit(documents: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", language: str = "lang") -> Model | None:
    """The model from rows whose id satisfies ``learn``, a condition on the column ``id`` (None: all); None without any.

    Rows without text, language or id teach nothing.
    """
    learn = F.lit(True) if learn is None else learn
    rows = rows_by(documents, (doc_id, "id"), (text, "text"), (language, "language"))
    rows = rows.where("id is not null and text is not null and language is not null").where(learn)
    ids = rows.select("id", "language", F.xxhash64("id", F.lit(3)).alias("order"))
    counts = ids.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    # about twice the rows wanted of each language, then exactly those: the window sees no more than that
    fair = F.pmod("order", F.lit(1 << 30)) / (1 << 30) < 2 * MOST_ROWS / F.col("n")
    own = Window.partitionBy("language").orderBy(F.pmod("order", F.lit(1 << 30)), "id")
    chosen = ids.join(counts, "language").where(fair).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= MOST_ROWS)
    chosen = chosen.select(F.col("id").alias("chosen"), F.col("language").alias("named"))
    sample = rows.join(chosen, (F.col("id") == F.col("chosen")) & (F.col("language") == F.col("named"))).dropDuplicates(["id", "language"])
    spare = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(5)) == 0
    found = encoded(sample.select("language", spare.alias("spare"), "text")).collect()
    if not found:
        return None
    names = sorted({r.language for r in found})
    number = {x: i for i, x in enumerate(names)}
    texts = [(np.frombuffer(r.buckets, "<u2"), np.frombuffer(r.shares, "<f4")) for r in found]
    languages = np.array([number[r.language] for r in found])
    spare = np.array([r.spare for r in found])
    if spare.all() or len(set(languages[~spare])) < len(names) or not spare.any():
        spare[:] = False  # too few rows to keep any out
    learned = np.flatnonzero(~spare)
    table = train([texts[i] for i in learned], languages[learned], len(names))
    held = np.flatnonzero(spare) if spare.any() else learned
    values = np.array([texts[i][1] @ table[texts[i][0]] for i in held]).reshape(len(held), len(names))
    return Model(names, table.astype(np.float32), *calibrate(values, languages[held]))


def identified(documents: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per row. Texts without a letter, NULL too, are ``und`` with score 0.

    Without a model (nothing to learn from) every text is ``und`` and rejected. Extra columns are not looked at.
    """
    rows = rows_by(documents, (doc_id, "doc_id"), (text, "text"))
    if model is None:
        return rows.select("doc_id", F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            names, score = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names), pa.array(score, pa.float64()), pa.array(score < shared.value.least)], ["doc_id", "lang_pred", "score", "rejected"]
            )

    return rows.mapInArrow(name, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
