"""From raw documents to packed sequences: five stages, each written and read again before the next.

Every stage works on all that its predecessor kept; all but the last return the columns of ``documents``, with the text
as the stage leaves it. Rows whose id is NULL pass the stages that compare documents by id unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.llm import toxicity
from cohortry.llm.line_dedup import line_bitmaps, without_lines
from cohortry.llm.minhash_dedup import near_duplicates
from cohortry.llm.mixing import mixed_copies, words_of
from cohortry.llm.packing import packed
from cohortry.llm.queries import MIXING_WEIGHTS, domain_of
from cohortry.session import written

TOXIC_FROM = 0.7
EPOCHS = 3


def _as_before(docs: DataFrame, rows: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` out of the struct ``doc``, some of them replaced, in their types."""
    types = dict(docs.dtypes)
    return rows.select(*(changed.get(c, F.col("doc")[c]).cast(types[c]).alias(c) for c in docs.columns))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the texts whose probability of being toxic is at least ``TOXIC_FROM``; learns from all labelled rows."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text"))
    return _as_before(docs, toxicity.scored(rows, model, score="toxic_score").where(F.col("toxic_score") < TOXIC_FROM))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of 40 code points and more that five documents share, but for the one with the largest id.

    Documents stay, also those without any line left; n_chars follows the text. Texts that lose nothing are unchanged.
    """
    rows = without_lines(docs, line_bitmaps(docs, least_points=40, least_documents=5))
    text = F.when(F.col("n_dropped") == 0, F.col("doc.text")).otherwise(F.col("kept"))
    size = F.when(F.col("n_dropped") == 0, F.col("doc.n_chars")).otherwise(F.char_length("kept"))
    return _as_before(docs, rows, text=text, n_chars=size)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8: the smallest id.

    Texts without words are linked with nothing and stay; so do rows without an id.
    """
    found = written(near_duplicates(docs, words=5, per_cent=80), "near-duplicates")
    dropped = found.where("component_id <> doc_id").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("dropped_id"), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, shared out by domain, language and source.

    What leaves of small weight have too much goes to those of large weight, whose documents are taken up to ``EPOCHS``
    times, each time a row of its own; the words stay what they were, but for the last document of each leaf.
    """
    levels = {"domain": domain_of(F.col("source")), "language": F.col("lang"), "origin": F.col("source")}
    weights = {"domain": MIXING_WEIGHTS["domain"], "language": MIXING_WEIGHTS["lang"], "origin": MIXING_WEIGHTS["source"]}
    rows = mixed_copies(docs, levels, weights, F.expr("total"), words_of(F.col("text")), epochs=EPOCHS, seed=11, full=True)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return _as_before(docs, rows.where("copies > 0").select("doc", copies.alias("copy")))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_shared_lines),
    ("minhash_near_dedup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed_sequences),
]

#: Learned scores have no SQL; tests compare the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
