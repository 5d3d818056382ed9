"""Operator 9, line dedup: DataFrame functions only.

Lines are exploded with their position, normalised and hashed, distinct documents are counted per
hash, lines over the threshold are dropped everywhere but in the holder with the largest doc_id, and
a text is put together again by position. Text never travels with the exploded rows: only doc_id, a
hash of the text, the position and two 64-bit hashes of the line do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._state import fresh, table, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(stripped: Column) -> Column:
    """A-Z in lower case and nothing else; lower() is the quick way where all is ASCII."""
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, t, pos, h1, h2): place and hashes of each line key of at least min_chars code points; t is the hash of the text."""
    each = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    long_enough = each.select("doc_id", "t", "pos", F.btrim("line", F.lit(SPACE)).alias("line")).where(F.char_length("line") >= min_chars)
    key = _folded(F.col("line"))
    return long_enough.select("doc_id", "t", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def repeated_lines(hashes: DataFrame, min_docs: int = 3) -> DataFrame:
    """(h1, h2, keeper) of each line that at least min_docs documents hold; keeper is the largest doc_id.

    Distinct documents are counted in two steps, by (line, document) and then by line, each of them
    aggregated before its shuffle, so a line that a third of all documents hold makes no hot task.
    """
    documents = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    return hashes.groupBy("h1", "h2").agg(documents.alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, n_lines: str = "_n_lines", n_dropped: str = "_n_dropped") -> DataFrame:
    """docs with repeated lines taken out of text, and the columns n_lines and n_dropped (these replace columns of their name).

    Rows with one doc_id are one document, and so are all rows with a null doc_id. Null or empty text
    is one empty line and becomes empty text. A null doc_id counts as smaller than any other, so such
    a document loses a repeated line that a document with a doc_id holds. Repeated rows lose the same
    lines. Further columns pass through unread, whatever their names; an empty table gives an empty table.
    """
    narrow = docs.select("doc_id", "text")
    hashes = written(line_hashes(narrow, min_chars), "line-hashes")
    # Written first: a join of two plain exchanges lets adaptive execution split the hashes of very common lines.
    many = written(repeated_lines(hashes, min_docs), "repeated-lines")
    loses = hashes.join(many, ["h1", "h2"]).where(F.coalesce(F.col("doc_id") < F.col("keeper"), F.col("keeper").isNotNull()))
    owner, whole, gone, at = fresh(docs, "owner", "whole", "gone", "lines")
    drops = loses.groupBy(F.col("doc_id").alias(owner), F.col("t").alias(whole)).agg(F.collect_set("pos").alias(gone))
    out = docs.join(drops, F.col("doc_id").eqNullSafe(F.col(owner)) & (F.xxhash64("text") == F.col(whole)), "left").withColumn(at, _lines(F.col("text")))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(at) - 1), F.col(gone)), lambda i: F.get(F.col(at), i))
    text = F.when(F.col(gone).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(stay, "\n"))
    out = out.withColumn(n_lines, F.size(at).cast("long")).withColumn(n_dropped, F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
    return out.withColumn("text", text).drop(owner, whole, gone, at)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document; edge cases as in dedup_lines."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
many AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 3),
marked AS (
  SELECT keyed.*, many.k IS NOT NULL AND coalesce(doc_id < keeper, keeper IS NOT NULL) AS gone FROM keyed LEFT JOIN many ON keyed.k = many.k)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
