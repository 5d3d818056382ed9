"""Readers of SQL dumps (INSERT statements, gzip or plain) and page XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.titles import sql_unescape

TEXT = r"'((?:[^'\\]|\\.)*)'"
# Patterns of the dump format.
#: Pattern of one tuple and (column, group, cast) of what is read from it.
DUMPS = {
    "page": (rf"\((\d+),(-?\d+),{TEXT},([01]),[01],[\d.eE+-]+,", (("page_id", 1, "long"), ("ns", 2, "int"), ("title", 3, None), ("is_redirect", 4, "boolean"))),
    "linktarget": (rf"\((\d+),(-?\d+),{TEXT}\)", (("lt_id", 1, "long"), ("ns", 2, "int"), ("title", 3, None))),
    "redirect": (rf"\((\d+),(-?\d+),{TEXT},(?:NULL|{TEXT}),", (("rd_from", 1, "long"), ("rd_ns", 2, "int"), ("rd_title", 3, None), ("interwiki", 4, None))),
    "pagelinks": (r"\((\d+),(-?\d+),(\d+)\)", (("pl_from", 1, "long"), ("pl_from_ns", 2, "int"), ("lt_id", 3, "long"))),
    "categorylinks": (rf"\((\d+),{TEXT},'\d{{4}}-[^']*',{TEXT},'(page|subcat|file)',(\d+),(\d+)\)", (("cl_from", 1, "long"), ("cl_type", 4, None), ("lt_id", 6, "long"))),
}


def parse_tuples(lines: DataFrame, kind: str) -> DataFrame:
    """Rows of the tuples in a value column; a line never holds part of a tuple.

    Each captured group is extracted from the whole line at once, and the arrays are put side by side, so
    a line is scanned once per column and no tuple is matched again.
    """
    pattern, columns = DUMPS[kind]
    groups = [F.regexp_extract_all("value", F.lit(pattern), F.lit(group)).alias(name) for name, group, _ in columns]
    tuples = lines.select(*groups).select(F.inline(F.arrays_zip(*[name for name, _, _ in columns])))
    return tuples.select(*[(F.col(name).cast(cast) if cast else sql_unescape(F.col(name))).alias(name) for name, _, cast in columns])


def categories(targets: DataFrame) -> DataFrame:
    """(cat_id, lt_id, title) of the link targets in ns 14; cat_id counts from 0 in order of lt_id.

    Numbers are dealt out by ranges of lt_id: counts per range first, then ranks inside it, so that no
    task sorts all categories.
    """
    from pyspark.sql import Window

    own = targets.where("ns = 14").select("lt_id", "title").withColumn("range", F.floor(F.col("lt_id") / 100_000))
    before = own.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("first"))
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("range").orderBy("lt_id")) - 1).join(F.broadcast(before), "range")
    return ranked.select((F.col("first") + F.col("r")).cast("int").alias("cat_id"), "lt_id", "title")


def article_categories(links: DataFrame, cats: DataFrame, articles: DataFrame) -> DataFrame:
    """(page_id, cat_id) of the page links of categorylinks (cl_from, cl_type, lt_id) between articles and known categories."""
    own = links.where("cl_type = 'page'").join(articles.select(F.col("page_id").alias("cl_from")), "cl_from", "left_semi")
    return own.join(cats.select("lt_id", "cat_id"), "lt_id").select(F.col("cl_from").alias("page_id"), "cat_id")


def category_counters(links: DataFrame, cats: DataFrame, articles: DataFrame) -> DataFrame:
    """(reason, n) of the rows of categorylinks: subcat, file, not_article, not_category or kept."""
    j = links.join(articles.select(F.col("page_id").alias("cl_from"), F.lit(True).alias("a")), "cl_from", "left").join(cats.select("lt_id", F.lit(True).alias("c")), "lt_id", "left")
    reason = F.when(F.col("cl_type") != "page", F.col("cl_type")).when(F.col("a").isNull(), "not_article").when(F.col("c").isNull(), "not_category").otherwise("kept")
    return j.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def read_dump(spark: SparkSession, path: str, kind: str, partitions: int | None = None) -> DataFrame:
    """A gzip file is one task until its lines are dealt out over partitions."""
    lines = spark.read.text(path)
    return parse_tuples(lines.repartition(partitions) if partitions else lines, kind)


PAGE = T.StructType([
    T.StructField("ns", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
    T.StructField("revision", T.StructType([T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())]))])),
])


def read_pages_xml(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, ns, title, is_redirect, text) of a page export."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    return raw.select(F.col("id").alias("page_id"), "ns", "title", F.col("redirect").isNotNull().alias("is_redirect"), F.col("revision.text._VALUE").alias("text"))
