"""Operator 1, quality rules: a short-circuit cascade out of DataFrame functions only.

The base figures of a text come from whole-array functions. Repeated five-word windows are looked
for with 64-bit hashes: only texts in which a hash repeats (few) pay for sorting their windows. The
further rules are conditions on cheap figures; their cost (seconds on a sample) and selectivity
(share rejected there) are estimated first, and they are chained by rejection per cost in one CASE,
so that a text stops at the first rule that rejects it. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._state import discard, table, written

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Copies of the sample that a rule is timed on.
REPEAT = 5


@dataclass(frozen=True)
class Rule:
    """rejects: a condition on text, words (array) and the base figures; null counts as no rejection."""

    name: str
    rejects: str


#: Each asks for clear junk: a text of ordinary prose, list or table in any language passes them all.
RULES: tuple[Rule, ...] = (
    Rule("symbols", "n_symbols > 0.3 * n_words"),
    Rule("word_length", "word_chars < 1.5 * n_words OR word_chars > 40 * n_words"),
    Rule("duplicate_lines", "n_dup_lines > 5 AND n_dup_lines > 0.5 * n_lines"),
    Rule("shouting", "regexp_count(text, '\\\\p{Lu}') > 0.7 * word_chars AND n_words >= 20"),
    Rule("exclamation", "regexp_count(text, '[!?]{2,}') > 0.3 * n_words"),
    Rule("no_letters", "n_words >= 20 AND regexp_count(text, '\\\\p{L}') < 0.3 * word_chars"),
    Rule("few_word_types", "n_words >= 100 AND size(array_distinct(words)) < 0.05 * n_words"),
)


def base_figures(docs: DataFrame) -> DataFrame:
    """Adds words, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words to (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("text", text).withColumn("words", F.array_remove(F.split("text", SPACES, -1), ""))
    lines = F.filter(F.split("text", "\n", -1), lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r")) != "")
    window = lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)])
    out = out.withColumn("n_words", F.size("words").cast("long")).withColumn("lines", lines).withColumn("windows", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), window)))
    # Slow path, for texts in which a window repeats: sort (hash, place), mark places whose hash has a neighbour, and measure the union of the windows there.
    placed = F.array_sort(F.transform(F.col("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
    twice = F.filter(F.col("placed"), lambda x, i: (F.get(F.col("placed"), i - 1)["h"] == x["h"]) | (F.get(F.col("placed"), i + 1)["h"] == x["h"]))
    out = out.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform(F.col("at"), lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        *docs.columns,
        "words",
        "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def rule_order(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> list[Rule]:
    """rules by rejection per cost, both estimated on up to sample_rows rows of docs; equal ones keep their order.

    One task takes the first rows it meets and stops; only they get figures. Each rule then runs over
    REPEAT copies of them, twice, and the shorter time less that of an empty rule is its cost.
    """
    sample = written(docs.select("doc_id", "text").coalesce(1).limit(sample_rows), "rule-sample")
    figures = base_figures(sample).drop("doc_id").cache()
    try:
        n = figures.count()
        copies = figures.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))
        base = min(_seconds(copies, F.lit(False))[0] for _ in range(3))
        gain = {}
        for r in rules if n else []:
            runs = [_seconds(copies, F.expr(r.rejects)) for _ in range(2)]
            gain[r.name] = (runs[0][1] / (n * REPEAT)) / max(min(s for s, _ in runs) - base, 0.002)
        return sorted(rules, key=lambda r: -gain.get(r.name, 0.0))
    finally:
        figures.unpersist()
        discard(sample)


def _seconds(sample: DataFrame, condition: Column) -> tuple[float, int]:
    began = time.perf_counter()
    rejected = sample.agg(F.count_if(condition)).first()[0]
    return time.perf_counter() - began, rejected


def apply_rules(figures: DataFrame, order: Sequence[Rule]) -> DataFrame:
    """Adds base_failed, rejected_by (name of the first rule that rejects, null if none) and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    chain = F.when(failed, F.lit("base"))
    for r in order:
        chain = chain.when(F.expr(r.rejects), F.lit(r.name))
    return figures.withColumn("base_failed", failed).withColumn("rejected_by", chain).withColumn("kept", F.col("rejected_by").isNull())


def score_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """Figures and verdict for each row of docs (doc_id, text).

    Null text counts as empty: no words, so base_failed. Rows are judged one by one: a null or
    repeated doc_id and repeated rows change nothing, an empty table gives an empty table, and other
    columns are not read. Windows count as equal if their 64-bit hashes do.
    """
    narrow = docs.select("doc_id", "text")
    return apply_rules(base_figures(narrow), rule_order(narrow, rules, sample_rows)).drop("words", "text", "n_lines")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document."""
    return score_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
l AS (
  SELECT doc_id, text, words, len(words) AS n_words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
w AS (
  SELECT doc_id, unnest(range(0, n_words - 4)) AS p, words FROM l WHERE n_words >= 5),
g AS (SELECT doc_id, p, array_to_string(words[p + 1 : p + 5], ' ') AS gram FROM w),
twice AS (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
r AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words
  FROM g JOIN twice USING (doc_id, gram), range(0, 5) AS five(k) GROUP BY doc_id),
f AS (
  SELECT l.*, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM l LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.3 * n_words
            OR word_chars < 1.5 * n_words OR word_chars > 40 * n_words
            OR (n_dup_lines > 5 AND n_dup_lines > 0.5 * len(lines))
            OR (n_words >= 20 AND len(regexp_extract_all(text, '\p{Lu}')) > 0.7 * word_chars)
            OR len(regexp_extract_all(text, '[!?]{2,}')) > 0.3 * n_words
            OR (n_words >= 20 AND len(regexp_extract_all(text, '\p{L}')) < 0.3 * word_chars)
            OR (n_words >= 100 AND len(list_distinct(words)) < 0.05 * n_words)) AS kept
FROM b
"""
