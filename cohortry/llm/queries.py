"""Registered queries over the documents, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortry.llm import language_id, lm_scoring, quality, toxicity
from cohortry.llm.conversations import repaired
from cohortry.llm.exact_dedup import exact_duplicates
from cohortry.llm.line_dedup import line_bitmaps, without_lines
from cohortry.llm.minhash_dedup import near_duplicates
from cohortry.llm.mixing import mixed_copies, words_of
from cohortry.llm.packing import packed
from cohortry.llm.spelling import variants, word_counts
from cohortry.llm.token_counts import token_counts
from cohortry.llm.top_k import top_k

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _fold(column: str, folds: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query()
def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    found = lm_scoring.scored(_table(spark, folder, "documents"), _fold("id", 5) != 1)
    return found.withColumn("held_out", _fold("doc_id", 5) == 1)


@_query(
    r"""
    WITH w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                    'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words
        FROM documents
    ),
    total AS (SELECT count(*) AS docs, sum(len(words))::DOUBLE / count(*) AS mean FROM w),
    p AS (SELECT doc_id, len(words) AS size, unnest(words) AS word FROM w),
    tf AS (SELECT doc_id, size, word, count(*)::DOUBLE AS times FROM p GROUP BY ALL),
    df AS (SELECT word, count(*)::DOUBLE AS n FROM tf GROUP BY word),
    impact AS (
        SELECT doc_id, word, round(ln(1 + (docs - n + 0.5) / (n + 0.5))
               * (times * (1.2 + 1) / (times + 1.2 * (1 - 0.75 + 0.75 * size / mean))) * 1e6)::BIGINT AS points
        FROM tf JOIN df USING (word), total
    ),
    s AS (
        SELECT q.doc_id AS query_id, d.doc_id, sum(points)::BIGINT AS score
        FROM tf q JOIN impact d USING (word) WHERE q.doc_id % 100 = 0 GROUP BY ALL
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
    """
)
def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(_table(spark, folder, "documents"), F.col("id") % 100 == 0, k=10)


@_query()
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = language_id.fit(documents, _fold("id", 5) != 0)
    found = language_id.identified(documents, model)
    return found.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


@_query()
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = toxicity.fit(documents, _table(spark, folder, "labels"), _fold("id", 3) != 1)
    found = toxicity.scored(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query(
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
               ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingle
        FROM w
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
        FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
    ),
    links AS (
        SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
        WHERE 100 * shared >= 85 * (na.n + nb.n - shared)
    ),
    reach AS (
        SELECT doc_id, doc_id AS seen FROM documents
        UNION
        SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.seen
    ),
    c AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
    SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
    FROM c LEFT JOIN n ON n.doc_id = c.doc_id
    """
)
def op4_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(_table(spark, folder, "documents"), words=3, per_cent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@_query(
    """
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
    k AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
        FROM l
    ),
    often AS (
        SELECT line_key, max(doc_id) AS last FROM k WHERE length(line_key) >= 40
        GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5
    ),
    marked AS (
        SELECT doc_id, pos, line, coalesce(k.doc_id <> often.last, false) AS dropped
        FROM k LEFT JOIN often USING (line_key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """
)
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    found = without_lines(documents, line_bitmaps(documents, least_points=40, least_documents=5))
    return found.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def domain_of(source: Column) -> Column:
    """The top of the tree: the one large source, the first nine others, and the rest."""
    return F.when(source == "src0", "web").when(source.rlike("^src[1-9]$"), "books").otherwise("other")


MIXING_WEIGHTS = {"domain": {"web": 5, "books": 3, "other": 4}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src3": 4, "src7": 2, "src12": 3}}


_MIXING_LEVEL = """
    {name}_nodes AS (
        SELECT {here}, sum(room) AS room, any_value(weight_{depth}) AS weight FROM leaves GROUP BY {here}
    ),
    {name}_ranked AS (
        SELECT {here_n}, n.room, n.weight, g.given - coalesce(sum(n.room) OVER (
                   PARTITION BY {parents_n} ORDER BY CASE WHEN n.weight > 0 THEN n.room::DOUBLE / n.weight END NULLS LAST, n.{level} NULLS FIRST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_, sum(n.weight) OVER (
                   PARTITION BY {parents_n} ORDER BY CASE WHEN n.weight > 0 THEN n.room::DOUBLE / n.weight END NULLS LAST, n.{level} NULLS FIRST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
        FROM {name}_nodes n JOIN {above} g ON {on}
    ),
    {name}_full AS (SELECT *, weight = 0 OR room * rest <= left_ * weight AS is_full FROM {name}_ranked),
    {name} AS (
        SELECT {here}, CASE WHEN is_full THEN room ELSE (
                   max(CASE WHEN NOT is_full THEN left_ END) OVER (PARTITION BY {parents}) * weight)
                   // max(CASE WHEN NOT is_full THEN rest END) OVER (PARTITION BY {parents}) END AS given
        FROM {name}_full
    ),"""


def _mixing_sql(weights: dict, budget: str, epochs: int, seed: int) -> str:
    levels = list(weights)
    case = lambda level: f"CASE {' '.join(f'WHEN {level} = {value!r} THEN {w}' for value, w in weights[level].items())} ELSE 1 END"
    steps, above = "", "root"
    for depth, level in enumerate(levels):
        here, parents = levels[: depth + 1], levels[:depth]
        steps += _MIXING_LEVEL.format(
            name=f"given_{level}", level=level, depth=depth, above=above, here=", ".join(here), here_n=", ".join(f"n.{x}" for x in here), parents=", ".join(parents) or "1",
            parents_n=", ".join(f"n.{x}" for x in parents) or "1", on=" AND ".join(f"n.{x} IS NOT DISTINCT FROM g.{x}" for x in parents) or "true",
        )
        above = f"given_{level}"
    keys = ", ".join(levels)
    return rf"""
    WITH d AS (
        SELECT doc_id, lang, source, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '^src[1-9]$') THEN 'books' ELSE 'other' END AS domain,
               len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::HUGEINT AS tokens
        FROM documents
    ),
    leaves AS (
        SELECT {keys}, sum(tokens)::HUGEINT AS tokens, {', '.join(f'{case(x)}::HUGEINT AS weight_{i}' for i, x in enumerate(levels))},
               CASE WHEN {' AND '.join(f'{case(x)} > 0' for x in levels)} THEN sum(tokens) * {epochs} ELSE 0 END::HUGEINT AS room
        FROM d GROUP BY {keys}
    ),
    root AS (SELECT least({budget}, sum(room))::HUGEINT AS given FROM (SELECT *, sum(tokens) OVER () AS total FROM leaves) GROUP BY total),
    {steps}
    cut AS (
        SELECT l.{', l.'.join(levels)}, l.tokens AS all_tokens, CASE WHEN l.tokens > 0 THEN g.given // l.tokens ELSE 0 END AS epochs, g.given
        FROM leaves l JOIN {above} g ON {' AND '.join(f'l.{x} IS NOT DISTINCT FROM g.{x}' for x in levels)}
    ),
    placed AS (
        SELECT d.*, c.epochs, c.given - c.epochs * c.all_tokens AS prefix, md5('{seed}:' || c.epochs || ':' || doc_id) AS place
        FROM d JOIN cut c ON {' AND '.join(f'd.{x} IS NOT DISTINCT FROM c.{x}' for x in levels)}
    )
    SELECT doc_id, {keys}, tokens::BIGINT AS n_tokens,
           (epochs + CASE WHEN prefix > 0 AND epochs < {epochs} AND sum(tokens) OVER (PARTITION BY {keys} ORDER BY place) <= prefix THEN 1 ELSE 0 END)::BIGINT AS copies
    FROM placed
    """


@_query(_mixing_sql(MIXING_WEIGHTS, "total * 4 // 5", 3, 11))
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    found = mixed_copies(documents, levels, MIXING_WEIGHTS, F.expr("(total * 4) div 5"), words_of(F.col("text")), epochs=3, seed=11)
    return found.select("doc.doc_id", *levels, "n_tokens", "copies")


@_query(
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
               sha256(regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20]', '', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept, text_sha256
    FROM d
    """
)
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@_query()
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


@_query()
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@_query(
    r"""
    WITH RECURSIVE steps AS (
        SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS step
    ),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
    r AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM runs WHERE length(run) >= 7 GROUP BY ALL
    ),
    h AS (
        SELECT run, n, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(id || ':' || run))), lambda i: ('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2))::BIGINT),
               lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295)) AS h
        FROM r, steps
    ),
    spoilt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM spoilt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS t(i)),
    pairs AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
    ),
    best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
    forms AS (
        SELECT w.word, CASE WHEN near_n >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
        FROM words w LEFT JOIN best USING (word)
    ),
    way AS (
        SELECT word, word AS form, 0 AS steps FROM forms
        UNION ALL SELECT way.word, f.form, steps + 1 FROM way JOIN forms f ON f.word = way.form WHERE f.form IS NOT NULL
    ),
    ends AS (SELECT word, arg_max(form, steps) AS root FROM way GROUP BY word)
    SELECT forms.*, root FROM forms JOIN ends USING (word)
    """
)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants(word_counts(_table(spark, folder, "documents"), least_points=7, least_times=2, spoil=31), times=10)


@_query()
def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = quality.fit(documents, _table(spark, folder, "labels"), _fold("id", 4) != 2)
    found = quality.scored(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query()
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(_table(spark, folder, "conversations"))
