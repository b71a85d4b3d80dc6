from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from cohortry.llm import queries as llm, toxicity

from ..check_oracle import compare, connect
from . import brute
from .odd import words_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


def test_all_are_registered():
    names = contract.queries().keys()
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names and llm.oracle_sql().keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, llm.queries()[name], llm.oracle_sql()[name]) is None


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # a mixed bag for every stage: NULLs, empty texts, copies, and a column that the operators use themselves
    odd = docs.limit(3).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars").unionByName(docs.limit(2).selectExpr("doc_id + 100000 as doc_id", "cast(null as string) as text", "lang", "cast(null as string) as source", "n_chars"))
    docs = docs.unionByName(odd).withColumn("score", F.lit("x")).withColumn("token", F.lit(1))
    kept = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], FOLDER).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert [x.columns for x in kept[1:-1]] == [docs.columns] * 4 and [x.dtypes for x in kept[1:-1]] == [docs.dtypes] * 4
    bags = [sorted(((r.doc_id, r.text) for r in x.select("doc_id", "text").collect()), key=str) for x in kept[:-1]]

    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    chances = model.scores([(t or "").encode() for _, t in bags[0]])
    assert bags[1] == [row for row, p in zip(bags[0], chances) if p < 0.7]
    assert bags[2] == sorted(((i, t if dropped == 0 else left) for (i, t), (_, _, dropped, left) in zip(bags[1], brute.lines(bags[1]))), key=str)
    component = brute.near(bags[2], 5, 80)
    assert bags[3] == [row for row, (i, _, c) in zip(bags[2], component) if i is None or i == c]
    rows = [(r.doc_id, len(words_of(r.text)), (_domain(r.source), r.lang, r.source)) for r in kept[3].collect()]
    weights = {"domain": llm.MIXING_WEIGHTS["domain"], "language": llm.MIXING_WEIGHTS["lang"], "origin": llm.MIXING_WEIGHTS["source"]}
    taken = brute.copies(rows, weights, list(weights), lambda total: total, 3, 11, full=True)
    assert sorted((i, n) for i, n, _, c in taken for _ in range(c) if i is not None) == sorted((i, len(words_of(t))) for i, t in bags[4] if i is not None)
    # as many words as there were, but for one document a leaf
    mixed, leaves = sum(len(words_of(t)) for _, t in bags[4]), {p for _, _, p in rows}
    assert sum(n for _, n, _ in rows) <= mixed <= sum(n for _, n, _ in rows) + sum(max(n for _, n, p in rows if p == leaf) for leaf in leaves)
    packed = kept[5].collect()
    assert {r.doc_id for r in packed} == {i for i, _ in bags[4]}
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)


def _domain(source):
    if source is None:
        return "other"
    return "web" if source == "src0" else "books" if source in {f"src{n}" for n in range(1, 10)} else "other"
