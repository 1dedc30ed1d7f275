"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts come first (base_counts). Every rule of rules() says when a text is rejected. On a
sample of SAMPLE_ROWS rows the cost of a rule (seconds) and its selectivity (share of rejected rows)
are measured, and the rules are chained in one CASE in the order of rejections per second: a row
pays for a rule only if no earlier rule rejected it. The order changes the time, never the verdict.

Defined cases: null and empty texts have no words, all counts 0 and fail the base rule; ties in
the order go by rule name; repeated rows are judged one by one; rows with a null id too; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import BLANKS

SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS, SAMPLE_CHARS = 500, 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def _bound(value: Column, body) -> Column:
    """Evaluate value once and use it in body as often as wanted."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words that lie in windows found more than once, from the window hashes in order."""

    def spread(ordered: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            before, after = F.get(ordered, k - 1)["h"], F.get(ordered, k + 1)["h"]
            return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

        starts = F.sort_array(F.transform(F.filter(ordered, twice), lambda x: x["i"]))
        none = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last"))

        def add(acc: Column, i: Column) -> Column:
            return F.struct((acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum"), i.alias("last"))

        return F.aggregate(starts, none, add, lambda acc: acc["sum"])

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_bound(ordered, spread))


def _windows(words: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - WINDOW + 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_bound(hashes, _covered))


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")

    def counts(s: Column) -> Column:
        return F.struct(
            F.size(s["words"]).cast("long").alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(s["lines"]) - F.size(F.array_distinct(s["lines"]))).cast("long").alias("n_dup_lines"),
            _windows(s["words"]).cast("long").alias("n_repeat_words"),
            F.size(s["lines"]).cast("long").alias("n_lines"),
        )

    return _bound(F.struct(words.alias("words"), lines.alias("lines")), counts)


def _capitals(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))


def rules() -> dict[str, Column]:
    """Rejections in terms of the base counts and the text."""
    return {
        "symbols": 100 * F.col("n_symbols") > 10 * F.col("word_chars"),
        "repeated_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "short_words": F.col("word_chars") < 2 * F.col("n_words"),
        "long_words": F.col("word_chars") > 30 * F.col("n_words"),
        "capitals": 2 * _capitals(F.col("text")) > F.col("word_chars"),
        "exclamations": 5 * (F.length("text") - F.length(F.translate("text", "!", ""))) > F.col("word_chars"),
    }


def _counted(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "text", base_counts(F.col("text")).alias("c")).select("doc_id", "text", "c.*")


def plan(rows: DataFrame) -> list[tuple[str, float, float]]:
    """(rule, seconds, rejected share) on a sample of (doc_id, text), best rejection per cost first.

    The sample is SAMPLE_ROWS texts of at most SAMPLE_CHARS characters from the first partitions
    that have them; the others are not read.
    """
    taken = rows.where(F.length("text") <= SAMPLE_CHARS).limit(SAMPLE_ROWS).collect()
    sample = _counted(rows.sparkSession.createDataFrame(taken, "doc_id long, text string")).cache()
    total = max(1, sample.count())
    measured = []
    for name, rejects in sorted(rules().items()):
        began = time.perf_counter()
        rejected = sample.where(rejects).count()
        measured.append((name, time.perf_counter() - began, rejected / total))
    sample.unpersist()
    return sorted(measured, key=lambda x: (-x[2] / x[1], x[0]))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed, kept and the rule that rejected the row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = _counted(rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = F.when(failed, F.lit("base"))
    conditions = rules()
    for name, _, _ in plan(rows):
        verdict = verdict.when(conditions[name], F.lit(name))
    judged = counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), verdict.alias("rejected_by"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*columns, F.col("rejected_by").isNull().alias("kept"))
