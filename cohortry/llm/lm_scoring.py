"""Documents scored by a gated recurrent language model that is trained on the corpus itself.

1. Words are counted over all training rows: tasks send sums per word, which Spark adds up into a stored table.
2. What the model predicts grows with the root of the distinct training words: the most frequent words have a symbol each
   (``SYMBOLS`` up to 262,144 distinct words, 8 times the root beyond), as many symbols are shared by the rarer and the
   unknown words, dealt by hash, and one is the end of a text. All are inputs as well, so every word teaches. It is trained
   in ``ROUNDS``; in each, every task runs truncated backpropagation over its share of that round's documents, and the
   weights of all tasks are averaged block by block. Every training document is met once. A task meets ``SYMBOL_TOKENS``
   tokens a symbol where there are so many, so that the weights that tasks send stay in proportion to the text.
3. Scoring is one scan: the state goes on through each whole document. A rarer word costs its shared symbol and its share
   in it. Counts of the ``LOOKUP`` most frequent words are at hand in the tasks; all others, a small part of the
   tokens, are joined by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortry.llm.gated_model import GatedModel, Trainer
from cohortry.llm.text import rows_by, slices, word_hashes
from cohortry.session import written

SYMBOLS = 4096
SYMBOL_WORDS = 1 << 18
SYMBOL_TOKENS = 48
LOOKUP = 1 << 19
WIDTH = 16
CLASSES = 64
ROUNDS = 4
LANES = 384
BLOCKS = 64
LEARN_TOKENS = 600_000
SCORE_TOKENS = 4_000_000
COUNTED_WORDS = 1_000_000


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each word once, with the sum of its counts."""
    tokens, counts = map(np.concatenate, zip(*parts))
    order = np.argsort(tokens)
    tokens = tokens[order]
    edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    return tokens[edges], np.add.reduceat(counts[order], edges) if len(edges) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # words are summed only where many wait: a merge costs as much as all words that are held
    parts, held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0

    def batch() -> pa.RecordBatch:
        words, counts = parts[0]
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["token", "n"])

    for _, texts in slices(batches, "text"):
        parts.append(np.unique(word_hashes(texts)[0], return_counts=True))
        held += len(parts[-1][0])
        if held > COUNTED_WORDS:
            parts = [_summed(parts)]
            held = len(parts[0][0])
            if held > COUNTED_WORDS // 2:
                yield batch()
                parts, held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    parts = [_summed(parts)]
    yield batch()


def symbols_for(distinct: int) -> int:
    """How many words have a symbol of their own: from ``SYMBOL_WORDS`` distinct words, in proportion to their root."""
    return int(SYMBOLS * max(1.0, (distinct / SYMBOL_WORDS) ** 0.5))


def shared_for(distinct: int) -> int:
    """How many symbols the words without an own one share."""
    return max(1, min(symbols_for(distinct), distinct - symbols_for(distinct)))


def _shared(tokens: np.ndarray, n: int) -> np.ndarray:
    return ((tokens >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


@dataclass
class Vocabulary:
    """Totals over the training rows, and the most frequent words, sorted, with counts and symbols.

    ``shared`` has the symbols of the words without an own one by hash; ``mass`` the log10 of what the counts of all
    words of a symbol add up to, pseudo-counts included, NaN for a symbol that one word owns."""

    documents: int
    tokens: int
    distinct: int
    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    symbol_counts: np.ndarray
    shared: np.ndarray
    mass: np.ndarray
    end: int

    @classmethod
    def of(cls, documents: int, words: int, distinct: int, table: tuple[np.ndarray, np.ndarray], sums: tuple[np.ndarray, np.ndarray], symbols: int) -> Vocabulary:
        """``sums``: tokens and distinct words by ``_shared``, of all words."""
        tokens, counts = table
        chosen = np.lexsort((tokens, -counts))[:symbols]
        at, own = _shared(tokens, len(sums[0])), _shared(tokens[chosen], len(sums[0]))
        rest = sums[0] - np.bincount(own, counts[chosen], len(sums[0]))
        rest_distinct = sums[1] - np.bincount(own, minlength=len(sums[1]))
        by_symbol = np.concatenate([counts[chosen], np.maximum(rest, 0.5), [max(1, documents)]]).astype(float)
        order = np.argsort(-by_symbol, kind="stable")
        number = np.empty(len(by_symbol), np.int32)
        number[order] = np.arange(len(by_symbol))
        shared = number[len(chosen) : -1]
        of_word = shared[at]
        of_word[chosen] = number[: len(chosen)]
        mass = np.full(len(by_symbol), np.nan)
        mass[shared] = np.log10(rest + 0.5 * (rest_distinct + 1))
        sort = np.argsort(tokens)
        return cls(documents, words + documents, distinct + (documents > 0), tokens[sort], counts[sort], of_word[sort], by_symbol[order], shared, mass, int(number[-1]))

    def __post_init__(self) -> None:
        # where the words of each range of hashes begin, and a last word that ends every search
        bits = max(1, len(self.words).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.words, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.searched = np.append(self.words, np.uint64((1 << 64) - 1))

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols, and counts (-1: not at hand)."""
        if not len(self.words):
            return self.shared[_shared(tokens, len(self.shared))], np.full(len(tokens), -1)
        at = self.first.take((tokens >> self.shift).astype(np.int64))
        behind = np.flatnonzero(self.searched.take(at) < tokens)
        while len(behind):
            at[behind] += 1
            behind = behind[self.searched.take(at.take(behind)) < tokens.take(behind)]
        known = (self.searched.take(at) == tokens) & (at < len(self.words))
        np.minimum(at, len(self.words) - 1, out=at)
        symbols = self.symbols.take(at)
        symbols[~known] = self.shared[_shared(tokens[~known], len(self.shared))]
        return symbols, np.where(known, self.counts.take(at), -1)

    def documents_of(self, symbols: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """One array of symbols per text, the end included."""
        ends = np.cumsum(counts)
        whole = np.insert(symbols, ends, self.end)
        return np.split(whole, (ends + np.arange(1, len(ends) + 1))[:-1])


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    """The frequent words are those of the highest steps of a logarithmic scale that hold at most LOOKUP words together."""
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("step")).collect()
    held, lowest = 0, None
    for row in steps:
        if held + row.words > LOOKUP:
            break
        held, lowest = held + row.words, row.step
    frequent = counts.where(step >= lowest) if lowest is not None else counts.limit(0)
    table = frequent.select("token", "n").toArrow()
    arrays = (table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy())
    distinct = sum(r.words for r in steps)
    n = shared_for(distinct)
    by_hash = counts.groupBy((F.shiftrightunsigned("token", 20) % n).alias("at")).agg(F.sum("n"), F.count(F.lit(1))).toArrow()
    sums = np.zeros((2, n), np.int64)
    sums[:, by_hash.column(0).to_numpy()] = by_hash.column(1).to_numpy(), by_hash.column(2).to_numpy()
    return Vocabulary.of(documents, sum(r.tokens for r in steps), distinct, arrays, (sums[0], sums[1]), symbols_for(distinct))


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; the mean of each block's values by weight."""
    block, total, weight = None, None, 0.0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], ["block", "values"])

    for batch in batches:
        for k, w, values in zip(*(c.to_pylist() for c in batch.columns)):
            if k != block:
                if block is not None:
                    yield done()
                block, total, weight = k, 0.0, 0.0
            total = total + w * np.frombuffer(values, "<f4").astype(float)
            weight += w
    if block is not None:
        yield done()


def train(rows: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> GatedModel:
    """The model after one pass over the rows (id, text), in rounds of local training and averaging."""
    context = rows.sparkSession.sparkContext
    model = GatedModel.new(words.symbol_counts, WIDTH, CLASSES)
    vocabulary_ = context.broadcast(words)
    tasks = max(1, words.tokens // (rounds * SYMBOL_TOKENS * len(words.symbol_counts)))
    for k in range(rounds):
        now = context.broadcast(model)
        rate = 0.1 * (1 - 0.6 * k / rounds)

        def learn(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            known, start = vocabulary_.value, now.value
            own = start.with_parameters(start.parameters().copy())
            trainer = Trainer(own, rate, LANES)
            waiting, held = [], 0

            def pass_on() -> None:
                # few symbols: fewer lanes, so that there still are steps to learn from
                trainer.lanes = int(np.clip(held // (trainer.window * 48), 8, LANES))
                trainer.learn(waiting, known.end)

            for _, texts in slices(batches, "text"):
                tokens, counts = word_hashes(texts)
                waiting += known.documents_of(known.look_up(tokens)[0], counts)
                held += len(tokens) + len(texts)
                if held >= LEARN_TOKENS:
                    pass_on()
                    waiting, held = [], 0
            pass_on()
            if trainer.tokens:
                for i, part in enumerate(np.array_split(own.parameters().astype("<f4"), BLOCKS)):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([float(trainer.tokens)]), pa.array([part.tobytes()], pa.binary())], ["block", "weight", "values"])

        share = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rounds)) == k).select("text")
        sent = share.coalesce(tasks).mapInArrow(learn, "block int, weight double, values binary")
        means = sent.repartition(BLOCKS, "block").sortWithinPartitions("block").mapInArrow(_averaged, "block int, values binary").collect()
        if means:
            model = model.with_parameters(np.concatenate([np.frombuffer(r["values"], "<f4") for r in sorted(means, key=lambda r: r.block)]))
    return model


def scored(documents: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10): one row for each row of ``documents``.

    Learns from rows whose id satisfies ``learn``, a condition on the column ``id`` (None: all; rows for which it is NULL
    teach nothing). NULL texts are empty: one token, the end. Rows that repeat an id are scored each by itself. Without
    training rows every symbol is as likely as its pseudo-count says. Words are told apart by a 64-bit hash.
    """
    spark = documents.sparkSession
    rows = rows_by(documents, (doc_id, "id"), (text, "text"))
    kind = rows.schema["id"].dataType.simpleString()
    learned = rows.where(F.lit(True) if learn is None else learn)
    counts = written(learned.select("text").mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "word-counts")
    words = vocabulary(counts, learned.count())
    model = spark.sparkContext.broadcast(train(learned, words))
    known = spark.sparkContext.broadcast(words)
    names = ["id", "version", "token", "times", "n_tokens", "n_known", "base", "score"]

    def heads(ids: list[pa.Array], versions: list[pa.Array], found: list[tuple[np.ndarray, ...]], texts: list[np.ndarray]) -> pa.RecordBatch:
        sizes, n_known, base, rest = map(np.concatenate, zip(*found))
        score = model.value.document_scores(texts, known.value.end) / np.log(10) + rest
        nothing = pa.nulls(len(sizes), pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(versions), nothing, nothing, *map(pa.array, (sizes + 1, n_known, base, score))], names)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the words of a group only the symbols stay, so that many texts take their steps together
        words = known.value
        ids, versions, found, waiting, held = [], [], [], [], 0
        for part, texts in slices(batches, "text"):
            id_, version = part.column(0), part.column(1)
            tokens, sizes = word_hashes(texts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            symbols, count = words.look_up(tokens)
            at_hand = count >= 0
            logs = np.where(at_hand, np.log10(np.maximum(count, 0) + 0.5), 0.0)
            base = np.bincount(owner, logs, len(sizes)) + np.log10(words.documents + 0.5)
            mass = words.mass[symbols]
            own = np.bincount(owner, np.where(np.isnan(mass), 0.0, logs - mass), len(sizes))
            n_known = np.bincount(owner, at_hand, len(sizes)).astype(np.int64) + (words.documents > 0)
            ids.append(id_)
            versions.append(version)
            found.append((sizes, n_known, base, own))
            waiting += words.documents_of(symbols, sizes)
            held += len(tokens)
            # words that are not at hand, once per text
            rest = np.flatnonzero(~at_hand)
            order = np.lexsort((tokens[rest], owner[rest]))
            t, o = tokens[rest][order], owner[rest][order]
            new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])])) if len(t) else np.zeros(0, np.int64)
            times, where = np.diff(np.append(new, len(t))), pa.array(o[new])
            for a in range(0, len(new), 1 << 16):
                b = min(len(new), a + (1 << 16))
                empty = [pa.nulls(b - a, x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([id_.take(where[a:b]), version.take(where[a:b]), pa.array(t[new[a:b]].view(np.int64)), pa.array(times[a:b]), *empty], names)
            if held >= SCORE_TOKENS:
                yield heads(ids, versions, found, waiting)
                ids, versions, found, waiting, held = [], [], [], [], 0
        if ids:
            yield heads(ids, versions, found, waiting)

    schema = f"id {kind}, version long, token long, times long, n_tokens long, n_known long, base double, score double"
    parts = written(rows.select("id", F.xxhash64("text").alias("version"), "text").mapInArrow(rate, schema), "scores")
    rare = parts.where("token is not null").select("id", "version", "token", "times").join(counts, "token", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.select("id", "version", (F.col("times") * F.log10(n + 0.5)).alias("logs"), F.when(n > 0, F.col("times")).otherwise(0).alias("seen"))
    heads = parts.where("token is null").select("id", "version", "n_tokens", "n_known", "base", "score")
    both = heads.unionByName(rare, allowMissingColumns=True).groupBy("id", "version")
    sums = both.agg(
        F.count("n_tokens").alias("rows"), *(F.max(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("logs", "seen")),
    )
    mass = float(np.log10(words.tokens + 0.5 * (words.distinct + 1)))
    # rows of the same id and text were summed together, so each has its part
    each = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return sums.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        (F.col("n_known") + F.expr("seen div rows")).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") / F.col("rows") - F.col("n_tokens") * mass).alias("base_score"),
        (F.col("score") + F.col("logs") / F.col("rows")).alias("score"),
        each.alias("copy"),
    ).drop("copy")
