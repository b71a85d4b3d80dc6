from __future__ import annotations

import collections
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import quality
from cohortry.llm.queries import queries

from .odd import documents, texts, words_of

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


def plain_features(text):
    """The same numbers, one text and one character at a time."""
    words = [w.decode("utf-8", "replace") for w in (text or "").encode().split()]
    if not words:
        return [0.0] * len(quality.FEATURES)
    capital = lambda c: "A" <= c <= "Z"
    letter = lambda c: capital(c) or "a" <= c <= "z" or ord(c) >= 128
    count = lambda test: sum(sum(map(test, w)) for w in words)
    mark, digit = (lambda c: c in ".,;:'-\"()?"), (lambda c: "0" <= c <= "9")
    sign = lambda c: not (letter(c) or mark(c) or digit(c))
    n, letters, capitals = len(words), count(letter), count(capital)
    own = [(sum(map(letter, w)), sum(map(capital, w)), sum(map(sign, w))) for w in words]
    lower = words_of(text)
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    triples = list(zip(lower, lower[1:], lower[2:]))
    return [
        math.log2(1 + n), letters / n, math.log2(1 + max(map(len, words))), capitals / max(letters, 1), count(digit) / max(sum(map(len, words)), 1),
        count(mark) / n, count(sign) / n, sum(s > 0 for _, _, s in own) / n, sum(c > 1 and c == k for k, c, _ in own) / n,
        sum(k == 0 for k, _, _ in own) / n, sum(k <= 2 for k, _, _ in own) / n, math.log2(1 + n / max(len(lines), 1)),
        1 - len(set(lines)) / len(lines), len(set(lower)) / n, max(collections.Counter(lower).values()) / n,
        sum(a == b for a, b in zip(lower, lower[1:])) / n, 1 - len(set(triples)) / len(triples) if triples else 0.0,
    ]


def plain_score(model, text):
    row = plain_features(text)
    bin_of = lambda edges, x: sum(x >= e for e in edges)
    total = model.base
    for edges, table, x in zip(model.edges, model.tables, row):
        total += table[bin_of(edges, x)]
    for (a, b), table in zip(model.pairs, model.pair_tables):
        total += table[bin_of(model.pair_edges[a], row[a]), bin_of(model.pair_edges[b], row[b])]
    return 1 / (1 + math.exp(-total))


def test_features_equal_those_of_a_plain_loop():
    held = [t for _, t in texts()] + ["A!! B!! a!! ß%% x | y\n\n  \nx | y\nx | y", "   x", "one two three " * 40, "z" * (3 << 20)]
    got = quality.features([(t or "").encode() for t in held])
    assert np.allclose(got, [plain_features(t) for t in held], atol=1e-9)


def test_cyclic_boosting_finds_a_pair():
    """Neither number alone tells anything, both together all: only a table of two numbers can."""
    draw = np.random.default_rng(2)
    rows = draw.random((3000, 3))
    good = ((rows[:, 0] > 0.5) ^ (rows[:, 2] > 0.5)).astype(float)
    model = quality.train(rows[:2000], good[:2000])
    assert model.pairs[0] == (2, 0)
    chances = 1 / (1 + np.exp(-model.sums(rows[2000:])))
    assert ((chances > 0.5) == good[2000:]).mean() > 0.9


@tables
def test_query_scores_as_a_plain_loop_and_judges_unseen_texts(spark):
    table, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.fit(table, labels, F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2)
    text = {r.doc_id: r.text for r in table.collect()}
    found = queries()["op12_quality"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in found) == sorted(text)
    for r in found:
        assert math.isclose(r.score, plain_score(model, text[r.doc_id]), abs_tol=1e-6) and r.predicted == (r.score >= 0.7)
    good = {r.doc_id: r.quality for r in labels.collect()}
    unseen = [(good[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in good]
    assert len(unseen) > 50 and sum(a == b for a, b in unseen) / len(unseen) >= 0.98


def test_odd_tables(spark):
    rows = texts()
    table = documents(spark, rows).withColumn("score", F.lit("x")).withColumn("numbers", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (1, 0), (11, 0), (10, 0), (13, 1), (None, 1), (2, None), (999, 0)], "doc_id long, quality int")
    model = quality.fit(table, labels)
    got = quality.scored(table, model)
    assert got.count() == len(rows) and got.columns[-1] == "score"
    for r in got.select("text", "score").collect():
        assert math.isclose(r.score, plain_score(model, r.text), abs_tol=1e-6)
    # whatever the order of the rows, the model is the same
    again = quality.fit(table.repartition(5), labels)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables))
    assert quality.fit(table, labels.limit(0)) is None
    assert {r.score for r in quality.scored(table, None).collect()} == {0.5}
    assert quality.scored(table.limit(0), model).collect() == []
