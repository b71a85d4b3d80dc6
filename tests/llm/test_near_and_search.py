from __future__ import annotations

import collections
import math
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest

from cohortry.llm import minhash_dedup, top_k as search
from cohortry.llm.components import components
from cohortry.llm.minhash_dedup import match_threshold, near_duplicates
from cohortry.llm.top_k import Shard, _pairs, top_k

from . import brute
from .odd import BASE, documents, texts, words_of
from pyspark.sql import functions as F

Bag = collections.Counter


@pytest.mark.parametrize(("words", "per_cent", "cell"), [(3, 85, 500), (5, 80, 4), (1, 60, 4)])
def test_near_duplicates(spark, monkeypatch, words, per_cent, cell):
    monkeypatch.setattr(minhash_dedup, "CELL_ROWS", cell)
    got = near_duplicates(documents(spark), words, per_cent).collect()
    assert Bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == Bag(brute.near(texts(), words, per_cent))


def test_a_group_that_drifts(spark, monkeypatch):
    """Neighbours are alike, the ends are not, and the smallest id is not in the middle."""
    monkeypatch.setattr(minhash_dedup, "CELL_ROWS", 8)
    draw = random.Random(2)
    words = [f"w{n}" for n in range(120)]
    rows = []
    for i in draw.sample(range(1000), 70):
        rows.append((i, " ".join(words)))
        for _ in range(draw.choice([1, 2, 6])):
            words[draw.randrange(120)] = f"n{draw.random()}"
    for i in range(2000, 2060):  # the same passage in texts that are not alike
        rows.append((i, BASE + " " + " ".join(f"o{i}x{n}" for n in range(12))))
    got = near_duplicates(documents(spark, rows), 3, 85).collect()
    assert Bag((r.doc_id, r.n_shingles, r.component_id) for r in got) == Bag(brute.near(rows, 3, 85))


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(documents(spark, [])).collect() == []
    got = near_duplicates(documents(spark, [(1, None), (2, ""), (2, "")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


def test_threshold_misses_few():
    for similarity in (0.8, 0.85, 0.95):
        n = match_threshold(similarity)
        assert sum(math.comb(64, k) * similarity**k * (1 - similarity) ** (64 - k) for k in range(n)) <= 1e-6 and n > 25


def test_components_of_a_chain_and_a_star(spark):
    links = [(n, n + 1) for n in range(60)] + [(500, n) for n in range(501, 560)] + [(7, 7), (None, 3)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert Bag(map(tuple, got)) == Bag([(n, 0) for n in range(61)] + [(n, 500) for n in range(500, 560)])


def plain_search(rows, asked, k, k1=1.2, b=0.75):
    bags = [(i, Bag(words_of(t))) for i, t in rows]
    mean = sum(sum(w.values()) for _, w in bags) / len(bags)
    df = Bag(w for _, bag in bags for w in bag)
    found = []
    for q, text in dict.fromkeys((i, t) for i, t in rows if i is not None and asked(i)):
        points = []
        for i, bag in bags:
            size = sum(bag.values())
            score = sum(
                round(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * (bag[w] * (k1 + 1) / (bag[w] + k1 * (1 - b + b * size / mean))) * 1e6)
                for w in set(words_of(text)) if w in bag
            )
            if score > 0:
                points.append((-score, i is None, i or 0, i))
        found += [(q, n + 1, p[3], -p[0]) for n, p in enumerate(sorted(points)[:k])]
    return found


@pytest.mark.parametrize("shard_words", [8_000_000, 900])
def test_top_k(spark, monkeypatch, shard_words):
    monkeypatch.setattr(search, "SHARD_WORDS", shard_words)
    got = top_k(documents(spark), F.col("id") % 3 == 1, k=5).collect()
    assert Bag(map(tuple, got)) == Bag(plain_search(texts(), lambda i: math.fmod(i, 3) == 1, 5))


def test_top_k_of_nothing(spark):
    assert top_k(documents(spark, []), F.col("id") % 3 == 1).collect() == []
    assert top_k(documents(spark, [(1, None), (4, " ")]), F.col("id") % 3 == 1).collect() == []


def test_queries_in_rounds_and_tasks_of_several_shards(spark, monkeypatch):
    for name, value in (("SHARD_WORDS", 100), ("ROUND_WORDS", 300), ("SHARDS_PER_TASK", 50)):
        monkeypatch.setattr(search, name, value)
    got = top_k(documents(spark), F.col("id") % 3 == 1, k=5).collect()
    assert Bag(map(tuple, got)) == Bag(plain_search(texts(), lambda i: math.fmod(i, 3) == 1, 5))


@pytest.mark.parametrize("kind", ["string", "date", "struct<a: long, b: string>"])
def test_top_k_with_ids_of_other_types(spark, monkeypatch, kind):
    """Ties go to the smaller id, in a shard, between the shards of a task and between tasks."""
    monkeypatch.setattr(search, "SHARD_WORDS", 10)
    made = {"string": "concat('d', 100 + id)", "date": "date_add(date'2020-01-01', cast(id as int))", "struct<a: long, b: string>": "struct(id as a, 'x' as b)"}
    rows = spark.range(90).selectExpr(f"cast({made[kind]} as {kind}) as doc_id", "concat('one two ', if(id % 2 = 0, 'three', 'four')) as text")
    ids = [r.doc_id for r in rows.orderBy("doc_id").collect()]
    got = top_k(rows, F.col("id") == F.expr(f"cast({made[kind].replace('id', '7')} as {kind})"), k=4).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.doc_id) for r in got] == [(ids[7], n + 1, ids[2 * n + 1]) for n in range(4)] and len({r.score for r in got}) == 1


@pytest.mark.parametrize("shard_words", [8_000_000, 100])
def test_queries_do_not_travel_with_the_documents(spark, monkeypatch, shard_words):
    """What the searching tasks are dealt are the documents, however many shards and queries there are."""

    def counted(*_):
        def rows(batches):
            n = sum(batch.num_rows for batch in batches)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n, uuid.uuid4().int >> 65, 0, 1)], ["query_id", "version", "doc_id", "score"])

        return rows

    monkeypatch.setattr(search, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(search, "_search", counted)
    assert sum(r.query_id for r in top_k(documents(spark), F.col("id") % 3 == 1).collect()) == len(texts())


@pytest.mark.parametrize("k", [3, 40, 600])
def test_queries_of_a_batch_get_what_each_gets_alone(k):
    draw = np.random.default_rng(7)
    names = np.array([f"w{n}" for n in range(900)])
    held = [" ".join(names[draw.zipf(1.2, 1 + i % 60).clip(1, 900) - 1]).encode() for i in range(3000)]
    asked = [np.unique(_pairs([text])[0]) for text in [*held[:40], b"", b"nowhere"]]
    words = np.unique(np.concatenate(asked))
    rarity = draw.uniform(0.5, 6, len(words))
    shard = Shard([_pairs(held)], 30.0, 1.2, 0.75)
    at = shard.known(words, rarity)
    numbers = [x[x >= 0] for x in (at[np.searchsorted(words, w)] for w in asked)]
    sums = np.zeros((len(asked), shard.n))
    for i, own in enumerate(numbers):
        for word in own:
            lists = slice(shard.start[word], shard.end[word])
            sums[i, shard.owner[lists]] += shard.weight[lists]
    least = np.sort(sums, axis=1)[:, -2] * (np.arange(len(asked)) % 2)
    query, found, scores = shard.best_of(numbers, k, least)
    assert 0 < len(shard.places) < len(words) and (scores == sums[query, found]).all()
    for i in range(len(asked)):
        last = max(1, least[i], np.sort(sums[i])[-k])
        assert set(np.flatnonzero(sums[i] >= last)) <= set(found[query == i])
        assert (scores[query == i] >= max(1, least[i])).all()


def _asked(held, texts_):
    """The texts as queries of a round over all the documents held."""
    bags = [np.unique(_pairs([text])[0]) for text in texts_]
    words = np.unique(np.concatenate(bags))
    numbers = np.concatenate([np.searchsorted(words, bag) for bag in bags]).astype(np.int32)
    df = Bag(w for text in held for w in np.unique(_pairs([text])[0]).tolist())
    rarity = np.array([math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) for w in words.tolist()])
    edges = np.cumsum([0] + [len(bag) for bag in bags])
    return search.Asked(pa.array(range(len(bags))), pa.array([0] * len(bags)), numbers, edges, words, rarity)


@pytest.mark.parametrize("places", [1, 1 << 20])
def test_the_best_of_shards_one_after_the_other(monkeypatch, places):
    """Bounds by earlier shards, an order of alike documents and batches change nothing; ties go to the smaller id."""
    monkeypatch.setattr(search, "BATCH_PLACES", places)
    draw = np.random.default_rng(9)
    names = np.array([[f"{kind}{n}" for n in range(120)] for kind in "abc"])
    held = [" ".join(names[i % 3][draw.zipf(1.3, 1 + i % 50).clip(1, 120) - 1]).encode() for i in range(900)] + [b"", b"z1 z2"] * 40
    asked, ids = _asked(held, held[:30] + [b"z1 z2"]), draw.permutation(len(held))
    results = []
    for cuts in ([0, len(held)], [0, 7, 300, 301, 640, len(held)]):
        best = search._Best(asked, 7)
        for low, high in zip(cuts, cuts[1:]):
            parts = [_pairs(held[low : (low + high) // 2]), _pairs(held[(low + high) // 2 : high])]
            order = search._alike_together(parts, best.telling)
            assert sorted(order) == list(range(high - low)) and len(parts) == 1
            assert parts[0][3].tolist() == [len(held[low + i].split()) for i in order]
            best.add(Shard(parts, 20.0, 1.2, 0.75), pa.array(ids[low:high][order]))
        results.append(best.batch().to_pylist())
    assert results[0] == results[1] and Bag(r["query_id"] for r in results[0]) == Bag({i: 7 for i in range(31)})
    plain = {i: t for i, t in zip(ids.tolist(), held)}
    assert [r["doc_id"] for r in results[0] if r["query_id"] == 30] == sorted(i for i, t in plain.items() if t == b"z1 z2")[:7]


def test_few_long_texts_are_asked_in_small_batches(monkeypatch):
    """Of a shard of few documents almost every word is common."""
    held = [" ".join(f"w{(i * 7919 + n * 31) % 5000}" for n in range(3000)).encode() for i in range(10)]
    asked, sizes = _asked(held, held * 5), []
    monkeypatch.setattr(search, "BATCH_PLACES", 1 << 14)
    best, plain = search._Best(asked, 3), Shard.best_of
    monkeypatch.setattr(Shard, "best_of", lambda self, own, *rest: sizes.append(len(own) * len(self.places)) or plain(self, own, *rest))
    best.add(Shard([_pairs(held)], 3000.0, 1.2, 0.75), pa.array(range(10)))
    assert max(sizes) <= 1 << 14 and [r["doc_id"] for r in best.batch().to_pylist()][::3] == list(range(10)) * 5


def test_pruning_is_exact_and_skips():
    draw = np.random.default_rng(5)
    names = np.array([f"w{n}" for n in range(400)])
    held = [" ".join(names[draw.zipf(1.3, 30).clip(1, 400) - 1]).encode() for _ in range(4000)]
    held[77] = b"rare1 rare2 rare3 " + held[77]
    shard = Shard([_pairs(held)], 30.0, 1.2, 0.75)
    words = np.array(_pairs([b"rare1 rare2 rare3 w1"])[0])
    rarity = draw.uniform(0.5, 6, len(words))
    everything = shard.best(words, rarity, 10_000)
    found, scores = shard.best(words, rarity, 3)
    order = np.argsort(-everything[1], kind="stable")
    assert sorted(scores, reverse=True)[:3] == list(everything[1][order[:3]]) and 77 in found


def test_weights_of_a_word_are_rounded_once(monkeypatch):
    """Common words have rows of places, rare ones lists; both give the sums of rounded weights, query after query."""
    draw = np.random.default_rng(6)
    names = np.array([f"w{n}" for n in range(300)])
    held = [" ".join(names[draw.zipf(1.3, 20).clip(1, 300) - 1]).encode() for _ in range(1000)]
    words = np.unique(_pairs(held)[0])
    rarity = draw.uniform(0.5, 6, len(words))
    plain = Shard([_pairs(held)], 20.0, 1.2, 0.75)
    sums = np.zeros(plain.n)
    edges = np.append(plain.block_start[plain.word_start], len(plain.owner))
    for k in range(len(words)):
        lists = slice(edges[k], edges[k + 1])
        sums[plain.owner[lists]] += np.rint(rarity[k] * plain.weight[lists] * 1e6)
    shard = Shard([_pairs(held)], 20.0, 1.2, 0.75)
    assert 0 < len(shard.places) < len(words)
    met = []
    meet = shard._meet
    monkeypatch.setattr(shard, "_meet", lambda at, rare: met.append(len(at)) or meet(at, rare))
    for _ in range(2):
        found, scores = shard.best(words, rarity, 2000)
        assert found.tolist() == np.flatnonzero(sums).tolist() and scores.tolist() == sums[sums > 0].tolist()
        few, best = shard.best(words[::2], rarity[::2], 3)
        assert len(few) >= 3 and min(best) > 0
    assert met == [len(words)]


def test_texts_leave_no_memory_behind(monkeypatch):
    """Workers are kept for later stages of a pipeline."""
    from cohortry.llm import text

    calls = []
    monkeypatch.setattr(text, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", None, "c"])], ["text"])
    assert [t for _, texts in text.slices(iter([batch, batch]), "text", 2) for t in texts] == [b"a b", b"", b"c"] * 2
    assert calls == [1]
