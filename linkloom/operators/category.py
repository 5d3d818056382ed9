"""Topic purity of communities from article categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequency(artcat: DataFrame) -> DataFrame:
    return artcat.groupBy("cat_id").agg(F.count(F.lit(1)).alias("freq"))


def counts(artcat: DataFrame, memb: DataFrame) -> DataFrame:
    """(comm, cat_id, cnt)."""
    return artcat.join(memb.select("page_id", "comm"), "page_id").groupBy("comm", "cat_id").agg(F.count(F.lit(1)).alias("cnt"))


def entropy(count: DataFrame) -> DataFrame:
    """(comm, n_cats, top_cat, top_cnt, entropy_norm): entropy over ln of the number of categories, 0 for one."""
    total = Window.partitionBy("comm")
    p = count.withColumn("p", F.col("cnt") / F.sum("cnt").over(total))
    out = p.groupBy("comm").agg(F.count(F.lit(1)).alias("n_cats"), F.max(F.struct("cnt", -F.col("cat_id"))).alias("top"), (-F.sum(F.col("p") * F.log("p"))).alias("h"))
    return out.select("comm", "n_cats", (-F.col("top")["col2"]).alias("top_cat"), F.col("top.cnt").alias("top_cnt"), F.when(F.col("n_cats") > 1, F.col("h") / F.log("n_cats")).otherwise(0.0).alias("entropy_norm"))


def names(artcat: DataFrame, memb: DataFrame, categories: DataFrame, max_freq: int = 20_000) -> DataFrame:
    """(comm, name, share, top3): the category of the best tf-idf, its share of the articles with one, the three most common (title, share).

    Categories more frequent than max_freq are not used; ties go to the smaller cat_id.
    """
    n = memb.agg(F.count(F.lit(1)).alias("n"))
    idf = frequency(artcat).where(F.col("freq") <= max_freq).crossJoin(F.broadcast(n)).select("cat_id", F.log(F.greatest(F.lit(1), "n") / F.greatest(F.lit(1), "freq")).alias("idf"))
    used = artcat.join(idf.select("cat_id"), "cat_id", "left_semi")
    with_cat = used.join(memb.select("page_id", "comm"), "page_id").groupBy("comm").agg(F.countDistinct("page_id").alias("m"))
    scored = counts(used, memb).join(idf, "cat_id").join(categories.select("cat_id", "title"), "cat_id").withColumn("score", F.round(F.col("cnt") * F.col("idf"), 9))
    best = scored.groupBy("comm").agg(F.max(F.struct("score", -F.col("cat_id"), "title", "cnt")).alias("b"))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("comm").orderBy(F.desc("cnt"), "cat_id"))).where("r <= 3").join(with_cat, "comm")
    three = ranked.groupBy("comm").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "title", (F.col("cnt") / F.col("m")).alias("share")))), lambda x: F.struct(x["title"].alias("title"), x["share"].alias("share"))).alias("top3"))
    return best.join(with_cat, "comm").join(three, "comm").select("comm", F.col("b.title").alias("name"), (F.col("b.cnt") / F.col("m")).alias("share"), "top3")


def nameable(name: DataFrame, memb: DataFrame, threshold: float = 0.3) -> DataFrame:
    sized = memb.groupBy("comm").agg(F.count(F.lit(1)).alias("n_c")).join(name, "comm", "left")
    ok = (F.col("n_c") >= 2) & (F.coalesce("share", F.lit(0.0)) >= threshold)
    return sized.agg(F.round(F.sum(F.when(ok, F.col("n_c")).otherwise(0)) / F.sum("n_c"), 6).alias("node_share"), F.round(F.count_if(ok) / F.count(F.lit(1)), 6).alias("comm_share"))
