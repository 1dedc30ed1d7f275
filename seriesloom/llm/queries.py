"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import byte_bpe, collocations, exact_dedup, hard_negatives, language, line_dedup, packing, positional_index, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity
from seriesloom.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents")).drop("kd", "kt")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.group(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut(table(spark, sf_dir, "documents"))
    return cut.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = line_dedup.strip_lines(table(spark, sf_dir, "documents"))
    return stripped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_exact_dedup, op3_quality_rules, op4_best_fit_packing, op5_simhash, op6_suffix_dedup,
        op7_byte_bpe, op8_toxicity, op9_language, op10_line_dedup, op11_hard_negatives,
        op12_collocations, op13_decontaminate,
    )
}

# all white space of the contracts, inside a character class
_WS = r"\x20\x09-\x0D"

SQL: dict[str, str] = {
    "op2_exact_dedup": rf"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[{_WS}]', '', 'g') AS body
            FROM documents
        ), k AS (
            SELECT doc_id, body,
                   first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY body) AS group_size
            FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k
    """,
    "op3_quality_rules": rf"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^{_WS}]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')) AS lines
            FROM documents
        ), w AS (
            SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t)
        ), r AS (
            SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
            FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM w), range(8) AS s(j)
            WHERE n > 1 GROUP BY doc_id
        ), c AS (
            SELECT doc_id, text, len(words) AS n_words,
                   length(regexp_replace(text, '[{_WS}]', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
                   length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_capitals,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM t LEFT JOIN r USING (doc_id)
        ), b AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
                    OR word_chars < 2 * n_words OR word_chars > 30 * n_words
                    OR 2 * n_capitals > word_chars OR 5 * n_exclamations > word_chars) AS kept
        FROM b
    """,
    "op10_line_dedup": rf"""
        WITH l AS (
            SELECT doc_id, i, lines[i] AS line,
                   translate(regexp_replace(lines[i], '^[{_WS}]+|[{_WS}]+$', '', 'g'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
        ), f AS (
            SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), m AS (
            SELECT l.*, coalesce(doc_id < top, false) AS lost FROM l LEFT JOIN f USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op11_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                   CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        ), n AS (
            SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
            FROM p JOIN s USING (anchor_id)
            WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
    "op12_collocations": """
        WITH p AS (
            SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                  FROM documents)
        ), g AS (
            SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
            FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, 6) AS s(m) WHERE len(w) >= m)
        ), f AS (
            SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL
        ), n AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
        ), c AS (
            SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 100
        ), o AS (
            SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS x
            ON x.lang = c.lang AND x.m > c.m AND 100 * x.a >= 100 * c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ')
        ), k AS (
            SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y
            FROM c ANTI JOIN o USING (lang, phrase), range(1, 5) AS s(k) WHERE k < m
        ), s AS (
            SELECT k.lang, k.phrase, a, k, u.f AS l, v.f AS r, n,
                   CAST(1000::HUGEINT * a * n // (u.f::HUGEINT * v.f) AS BIGINT) AS score
            FROM k JOIN f AS u ON u.lang = k.lang AND u.phrase = x JOIN f AS v ON v.lang = k.lang AND v.phrase = y JOIN n ON n.lang = k.lang
        ), b AS (
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
        FROM b QUALIFY rank <= 2000
    """,
    "op13_decontaminate": """
        WITH d AS (
            SELECT doc_id, w, len(w) AS n_words FROM (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                FROM documents)
        ), b AS (
            SELECT item_id, w, len(w) AS n FROM (
                SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                FROM benchmark)
            WHERE len(w) > 0
        ), q AS (
            SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS gram, least(n, 10) AS size
            FROM (SELECT item_id, w, n, unnest(range(1, greatest(n - 8, 2))) AS i FROM b)
        ), g AS (
            SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
            FROM (SELECT doc_id, w, size, unnest(range(1, n_words - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM q) WHERE n_words >= size)
        ), m AS (
            SELECT doc_id, i, size, item_id FROM g JOIN q USING (gram, size)
        ), h AS (
            SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, range(10) AS s(j) WHERE j < size GROUP BY doc_id
        ), t AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
        )
        SELECT doc_id, n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
}
