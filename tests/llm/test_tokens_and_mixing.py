from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortry.llm import mixing
from cohortry.llm.mixing import mixed_copies, words_of
from cohortry.llm.packing import RANKS, Encoder, classes, knapsack, packed, sequence_plan
from cohortry.llm.token_counts import Merges, token_counts

from . import brute
from .odd import documents, texts
from .odd import words_of as split

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
Bag = collections.Counter
PARTS = ["a", "A", " ", "  ", "\n", "\t", "b'", "'s", "'s,", "x1", "é", "é", "́", "世", "<|endoftext|>", "<|EndOfText|>", "<|", "!", "q.", "q,", ",", "\x1c", "\xa0", " ", "\x85", "\x0b", "aaaa", "ΑΣ"]


def scraps(n):
    draw = random.Random(8)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_counts_are_the_library_s():
    merges, library = Merges(open(BYTES, encoding="utf-8").read()), Tokenizer.from_file(BYTES)
    held = scraps(4000) + ["z" * 3000, "ab" * 1000 + "c"]
    assert merges.counts(held) == [len(e.ids) for e in library.encode_batch(held, add_special_tokens=False)]


def test_word_memory_may_be_small():
    merges, library = Merges(open(BYTES, encoding="utf-8").read()), Tokenizer.from_file(BYTES)
    merges.known.limit = merges.spaced.limit = 5
    held = scraps(300)
    for at in range(0, 300, 10):
        assert merges.counts(held[at : at + 10]) == [len(e.ids) for e in library.encode_batch(held[at : at + 10], add_special_tokens=False)]


def test_token_counts(spark):
    library = Tokenizer.from_file(BYTES)
    got = token_counts(documents(spark), BYTES, limit=10).collect()
    wanted = [(i, len((t or "").encode()), n, n > 10) for i, t in texts() for n in [len(library.encode(t or "", add_special_tokens=False).ids)]]
    assert Bag(map(tuple, got)) == Bag(wanted)
    assert token_counts(documents(spark, []), BYTES).collect() == []


def test_ids_are_the_library_s():
    library = Tokenizer.from_file(WORDS)
    # words longer than the pieces that texts are read in, and texts of many pieces
    held = [*scraps(4000), "Ab." * 500_000, "the The, <|endoftext|> a<|ENDOFTEXT|>b.\t" * 60_000]
    ids, counts = Encoder(open(WORDS, encoding="utf-8").read()).encode([x.encode() for x in held])
    got = np.split(ids, np.cumsum(counts)[:-1])
    for mine, theirs in zip(got, library.encode_batch(held, add_special_tokens=False), strict=True):
        assert mine.tolist() == theirs.ids


@pytest.mark.parametrize("most_words", [1, 40])
def test_ids_with_little_memory(most_words):
    encoder, library = Encoder(open(WORDS, encoding="utf-8").read(), most_words), Tokenizer.from_file(WORDS)
    held = scraps(600)
    for at in range(0, 600, 4):
        part = held[at : at + 4]
        ids, counts = encoder.encode([x.encode() for x in part])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert len(encoder.words) <= max(most_words, len(ids) + 4)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packed(spark, capacity):
    library = Tokenizer.from_file(WORDS)
    got = packed(documents(spark), WORDS, capacity=capacity).collect()
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in texts()]
    pieces = Bag((i, at, len(x[at : at + capacity]), zlib.crc32(np.array(x[at : at + capacity], "<u4").tobytes()), len(x)) for i, x in ids for at in range(0, len(x), capacity))
    assert Bag((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == pieces
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= capacity
    assert packed(documents(spark, []), WORDS).collect() == []


def test_places_are_taken_once_and_little_is_padded():
    draw = random.Random(1)
    for n in (1, 30, 500, 20_000):
        step = classes(2048)
        lengths = [min(2048, int(draw.lognormvariate(6, 1.2)) + 1) for _ in range(n)]
        counts = Bag(int(step[x]) for x in lengths)
        keys, first, position = sequence_plan(dict(counts))
        used = collections.defaultdict(int)
        taken = set()
        for size, k in counts.items():
            rank = np.arange(k) + size * RANKS
            at = np.searchsorted(keys, rank, "right") - 1
            for s, p in zip((first[at] + rank - keys[at]).tolist(), position[at].tolist()):
                assert (s, p) not in taken
                taken.add((s, p))
                used[s] += size
        assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
        if n >= 500:
            assert len(used) * 2048 < 1.02 * sum(lengths) + 2048


def test_knapsack_agrees_with_trying_all():
    sizes, prices = np.array([3, 5, 7]), np.array([0.3, 0.55, 0.72])
    best, _ = knapsack(sizes, prices, 24)
    tried = max(a * 0.3 + b * 0.55 + c * 0.72 for a in range(9) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 24)
    assert abs(best[24] - tried) < 1e-12


def mixed_rows(rows, langs):
    return [(i, len(split(t)), (source, lang)) for (i, t), source, lang in zip(rows, langs[0], langs[1])]


@pytest.mark.parametrize(
    ("share", "epochs", "bucket_rows", "full"),
    [(50, 1, 5000, False), (95, 1, 2, False), (100, 3, 2, True), (250, 3, 1, False), (0, 2, 5, True), (1000, 2, 3, False), (60, 2, 1, True)],
)
def test_mixing(spark, monkeypatch, share, epochs, bucket_rows, full):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows = texts() + [(5000 + n, "several words of text " * (n % 9)) for n in range(60)]
    weights = {"origin": {"src0": 5, "src12": 0}, "tongue": {"en": 3}}
    table = documents(spark, rows)
    got = mixed_copies(table, {"origin": F.col("source"), "tongue": F.col("lang")}, weights, F.expr(f"(total * {share}) div 100"), words_of(F.col("text")), epochs=epochs, seed=3, full=full).collect()
    sources = [[None, "src0", "src3", "src12", "src0"][k % 5] for k in range(len(rows))]
    langs = [[None, "en", "de"][k % 3] for k in range(len(rows))]
    wanted = brute.copies(mixed_rows(rows, (sources, langs)), weights, ["origin", "tongue"], lambda total: total * share // 100, epochs, 3, full)
    assert Bag((r.doc.doc_id, r.n_tokens, (r.origin, r.tongue), r.copies) for r in got) == Bag(wanted)


def test_mixing_nothing(spark):
    assert mixed_copies(documents(spark, []), {"origin": F.col("source")}, {}, F.col("total"), words_of(F.col("text"))).collect() == []


def test_shortages_go_to_siblings_first():
    assert brute.shared_out(100, {"a": (10, 1), "b": (200, 1), "c": (200, 2)}) == {"a": 10, "b": 30, "c": 60}


def test_mixing_runs_no_python(spark):
    table = documents(spark)
    plan = mixed_copies(table, {"origin": F.col("source")}, {}, F.expr("total div 2"), words_of(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
