from __future__ import annotations

import collections

import pytest

from cohortry.llm import exact_dedup, line_dedup
from cohortry.llm.exact_dedup import BLOCK_BITS, exact_duplicates, filter_sizes
from cohortry.llm.line_dedup import line_bitmaps, without_lines

from . import brute
from .odd import documents, texts

Bag = collections.Counter


@pytest.mark.parametrize("copies", [1, 40])
def test_exact_duplicates(spark, copies):
    rows = texts() * copies
    got = exact_duplicates(documents(spark, rows)).collect()
    assert Bag((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in got) == Bag(brute.exact(rows))


def test_exact_duplicates_with_several_filters(spark, monkeypatch):
    rows = [(i, f"text {i // 2 if i % 3 else i}") for i in range(9000)]
    asked = []
    real = exact_dedup.repeated_bits
    monkeypatch.setattr(exact_dedup, "repeated_bits", lambda found, bits: asked.append((found.count(), bits)) or real(found, bits))
    got = exact_duplicates(documents(spark, rows), most_bits=BLOCK_BITS).collect()
    assert Bag((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in got) == Bag(brute.exact(rows))
    # every row is in one range, and each range has bits enough
    assert len(asked) == 4 and sum(n for n, _ in asked) == 9000 and all(bits >= 16 * n for n, bits in asked)


def test_filters_grow_with_the_rows():
    assert filter_sizes(0) == (1, BLOCK_BITS) and filter_sizes(1 << 20) == (1, 1 << 24) and filter_sizes(1 << 32) == (64, 1 << 30)


def test_exact_duplicates_of_nothing(spark):
    assert exact_duplicates(documents(spark, [])).collect() == []


@pytest.mark.parametrize("hot_rows", [1, 20_000])
def test_lines(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot_rows)
    table = documents(spark)
    got = without_lines(table, line_bitmaps(table)).collect()
    assert Bag((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == Bag(brute.lines(texts()))
    assert all(len(r.doc) == len(table.columns) for r in got)


def test_many_lines(spark):
    """More lines than a word of the bitmap, dropped in several words."""
    shared = [f"shared line number {n:03d} that is longer than forty code points" for n in range(300)]
    rows = [(i, "\n".join(x for n, x in enumerate(shared) if (n + i) % 7 or i > 7)) for i in range(12)]
    table = documents(spark, rows)
    got = without_lines(table, line_bitmaps(table)).collect()
    assert Bag((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == Bag(brute.lines(rows))


def test_bitmaps_are_compressed(spark):
    rows = [(i, "\n".join([f"own {i} {n}" for n in range(200)] + ["a line that is shared and longer than forty points"])) for i in range(6)]
    found = line_bitmaps(documents(spark, rows)).collect()
    assert sorted((r.doc_id, [(w.word, w.bits) for w in r.dropped]) for r in found) == [(i, [(3, 1 << 8)]) for i in range(5)]


def test_lines_of_nothing(spark):
    table = documents(spark, [])
    assert without_lines(table, line_bitmaps(table)).collect() == []


def test_lines_run_no_python(spark):
    table = documents(spark)
    plan = without_lines(table, line_bitmaps(table))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
