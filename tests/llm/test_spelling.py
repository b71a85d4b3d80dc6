from __future__ import annotations

import collections
import random
import re
import zlib

import pytest

from cohortry.llm.spelling import regions, variants, word_counts

from .brute import LOWER
from .odd import documents, texts


def near(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    return sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, times=10):
    forms, rows = {}, []
    for word, n in words.items():
        found = sorted((-m, other) for other, m in words.items() if near(word, other))
        rows.append((word, n, len(found)))
        forms[word] = (found[0][1], -found[0][0]) if found and -found[0][0] >= times * n else (None, None)
    out = []
    for word, n, count in rows:
        root = word
        while forms[root][0]:
            root = forms[root][0]
        out.append((word, forms[word][0], root, n, count, forms[word][1]))
    return sorted(out)


def alike_words(seed, letters, longest, n):
    """Words and their neighbours; counts tie often and differ by a factor of ten often."""
    draw, words = random.Random(seed), {}
    for _ in range(n):
        word = "".join(draw.choice(letters) for _ in range(draw.randint(1, longest)))
        for k in [draw.randrange(len(word) + 1) for _ in range(4)]:
            words.setdefault(word, draw.choice([2, 3, 30, 400, 4000]))
            word = draw.choice([word[:k] + draw.choice(letters) + word[k:], word[:k] + draw.choice(letters) + word[k + 1 :], word[:k] + word[k + 1 :] or "x"])
    return words


@pytest.mark.parametrize("letters, longest, most_members", [("ab", 9, 2048), ("aé÷ÿ", 12, 4), ("abcdefgh", 70, 2048)])
def test_equal_to_all_pairs(spark, letters, longest, most_members):
    words = alike_words(3, letters, longest, 120)
    # one letter, many times: every place of an insertion is the same word
    words |= {"q" * k: 10**k for k in range(1, 8)} | {"z" * 3000: 5, "z" * 2999 + "y": 50, "z" * 3001: 500}
    table = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()], "word string, n long, key string, size int").repartition(3)
    assert sorted(tuple(r) for r in variants(table, most_members=most_members).collect()) == brute(words)


def test_groups_stay_small_when_all_words_begin_alike(spark):
    words = {f"prefix{a}{b}{c}same": 2 for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    sizes = [r["count"] for r in regions(table, 64).groupBy("size", "lo", "hi", "key").count().collect()]
    # a region of one place holds as many words as there are letters there, or pairs of letters
    assert max(sizes) <= 10 * 10 and sum(sizes) <= 4 * len(words) * 5
    got = {r.word: r.n_near for r in variants(table, most_members=64).collect()}
    assert set(got.values()) == {27} and len(got) == 1000


def test_counts_follow_the_hash_of_run_and_id(spark):
    rows = [(i, t) for i, t in texts()] + [(k, "Buchstäblich ÀÉcompléter-completer_complETER x" * 3) for k in range(200)]
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    expected = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = {r.word: r.n for r in word_counts(documents(spark, rows)).collect()}
    assert got == expected and len(expected) > 10


def test_nothing_to_group(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants(word_counts(empty)).collect() == []
    odd = spark.createDataFrame([(None, 3), ("", 4), ("a", 1)], "word string, n long")
    assert [tuple(r) for r in variants(odd).collect()] == [("a", None, "a", 1, 0, None)]
