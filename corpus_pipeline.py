"""Corpus pipeline: documents through five of the operators in linkloom.llm.

Each stage gets all that its predecessor kept. The stages but the last return the columns of
documents; the last returns doc_id, n_tokens, ids, ids_sha256 and decoded_sha256. Null texts are
empty texts; rows with a null doc_id are one document without id where documents are matched by id;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import byte_bpe, decontaminate, importance, line_dedup, ngram_join
from linkloom.llm._state import discard, fresh, shared_dir, table, temporary, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps (operator 5)."""
    names = fresh(docs, "score", "noisy", "passage", "kept")
    return importance.resample(docs, table(spark, sf_dir, "labels"), names=tuple(names)).where(names[-1]).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay only in the last document that holds them (operator 9); n_chars follows."""
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    out = line_dedup.dedup_lines(docs, n_lines=n_lines, n_dropped=n_dropped)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of similar ones (operator 3).

    Each row is judged by its own text. Of rows with one doc_id in one group one stays (the text of the
    smallest hash; of rows with that text too, the smallest row); a row with a null doc_id goes if it
    is similar to a document that has one. Rows without words are similar to nothing and all stay.
    """
    groups = written(ngram_join.group_rows(docs), "groups")
    own = groups.where("doc_id = component_id AND n_shingles > 0")
    several = own.groupBy("doc_id", "c").agg(F.min("h").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    other = groups.where(F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("component_id").isNotNull())).select("doc_id", "h")
    other = other.unionByName(own.join(several, ["doc_id", "c"]).where("h <> least").select("doc_id", "h"))
    gone = other.select(F.col("doc_id").alias("_gone"), F.col("h").alias("_text")).distinct()
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_text")), "left_anti").select(*docs.columns)
    twice = own.groupBy(F.col("doc_id").alias("_twice"), F.col("h").alias("_text")).count().where("count > 1").drop("count")
    if twice.isEmpty():
        return kept
    same = (F.col("doc_id") == F.col("_twice")) & (F.xxhash64("text") == F.col("_text"))
    once = kept.join(twice, same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return kept.join(twice, same, "left_anti").unionByName(once)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item (operator 4); each row is judged by its own text."""
    (row,) = fresh(docs, "row")
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    held = decontaminate.contaminated(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(row)).distinct()
    return docs.join(held, F.xxhash64("text") == F.col(row), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digest of their decoding (operator 8)."""
    import public_tokenizers

    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", tokens),
]

#: SQL has neither the resampling nor the tokenizer; tests/llm/test_ops.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next; a stage's own tables go with it."""
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark):
            made = stage(spark, docs, sf_dir)
            out = written(made, name.replace(" ", "-"), stays=True)
        discard(docs)
        docs = out
    return docs
