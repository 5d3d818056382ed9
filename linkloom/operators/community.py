"""Figures of a membership over an undirected edge set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ends(und: DataFrame, memb: DataFrame) -> DataFrame:
    """(u, v, cu, cv): edges with the communities of both ends."""
    m = memb.select("page_id", "comm")
    return und.join(m.select(F.col("page_id").alias("u"), F.col("comm").alias("cu")), "u").join(m.select(F.col("page_id").alias("v"), F.col("comm").alias("cv")), "v")


def per_community(und: DataFrame, memb: DataFrame) -> DataFrame:
    """comm, n_c, e_in, e_out, boundary and the ratios; a cross edge counts once on each side; null where undefined."""
    e = ends(und, memb)
    sides = e.select(F.explode(F.array(F.struct(F.col("cu").alias("comm"), F.col("u").alias("n"), (F.col("cu") == F.col("cv")).alias("same"), F.lit(True).alias("first")), F.struct(F.col("cv").alias("comm"), F.col("v").alias("n"), (F.col("cu") == F.col("cv")).alias("same"), F.lit(False).alias("first")))).alias("s")).select("s.*")
    nodes = sides.groupBy("comm", "n").agg(F.count_if(F.col("same") & F.col("first")).alias("i"), F.count_if(~F.col("same")).alias("o"))
    sums = nodes.groupBy("comm").agg(F.sum("i").alias("e_in"), F.sum("o").alias("e_out"), F.count_if(F.col("o") > 0).alias("boundary"))
    z = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = memb.groupBy("comm").agg(F.count(F.lit(1)).alias("n_c")).join(sums, "comm", "left").select("comm", "n_c", z("e_in"), z("e_out"), z("boundary"))
    return out.select(
        "*",
        F.try_divide("e_out", F.col("e_in") + F.col("e_out")).alias("out_ratio"),
        F.try_divide("e_out", 2 * F.col("e_in") + F.col("e_out")).alias("conductance"),
        (2 * F.col("e_in") / F.col("n_c")).alias("avg_degree"),
        (F.col("boundary") / F.col("n_c")).alias("boundary_ratio"),
    )


def pairs(und: DataFrame, memb: DataFrame) -> DataFrame:
    """(a, b, w): edges between each two communities, a < b."""
    return ends(und, memb).where("cu <> cv").groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.count(F.lit(1)).alias("w"))


def weighted_percentiles(df: DataFrame, value: str, weight: str, shares: tuple[float, ...]) -> DataFrame:
    """(share, value): for each share the smallest value whose cumulative weight reaches it; null values and weights of 0 or less are left out.

    For one row per community: the running sum is over their distinct values, in one task. df is worked out once for all shares.
    """
    steps = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    run = steps.select("v", F.sum("w").over(Window.orderBy("v")).alias("cum"), F.sum("w").over(Window.partitionBy()).alias("total"))
    least = run.agg(*[F.min(F.when(F.col("cum") >= F.col("total") * s, F.col("v"))).alias(f"v{k}") for k, s in enumerate(shares)])
    return least.select(F.inline(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"v{k}").alias("value")) for k, s in enumerate(shares)])))


def weighted_median(df: DataFrame, value: str, weight: str, share: float = 0.5) -> DataFrame:
    """(weighted_median): weighted_percentiles for one share."""
    return weighted_percentiles(df, value, weight, (share,)).select(F.col("value").alias("weighted_median"))


SIZE_SHARES, RATIO_SHARES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99), (0.1, 0.25, 0.5, 0.75, 0.9)


def global_metrics(per: DataFrame) -> DataFrame:
    """One row over all communities; effective ones have two nodes or more, percentiles are exact and linear."""
    some = F.col("n_c") >= 2
    points = lambda name, column, shares, only=None: [F.round(F.percentile(F.when(only, F.col(column)) if only is not None else column, s), 6).alias(f"{name}_p{round(s * 100)}") for s in shares]
    below = lambda limit: F.round(F.try_divide(F.sum(F.when(some & (F.col("out_ratio") < limit), F.col("n_c")).otherwise(0)), F.sum("n_c")), 6)
    flat = per.agg(
        F.round(F.try_divide(F.sum("e_out") / 2, F.sum("e_in") + F.sum("e_out") / 2), 6).alias("cross_edge_fraction"),
        F.round(F.try_divide(F.max("n_c"), F.sum("n_c")), 6).alias("largest_share"),
        F.round(F.try_divide(F.sum("e_out"), F.sum("e_in") + F.sum("e_out")), 6).alias("mean_out_ratio_edge_weighted"),
        *points("size_all", "n_c", SIZE_SHARES), *points("size", "n_c", SIZE_SHARES, some),
        *points("out_ratio", "out_ratio", RATIO_SHARES, some), *points("conductance", "conductance", RATIO_SHARES, some),
        below(0.3).alias("node_share_out_lt_03"), below(0.5).alias("node_share_out_lt_05"),
        F.round(F.try_divide(F.sum("boundary"), F.sum("n_c")), 6).alias("boundary_ratio_node_weighted"),
        F.round(F.try_divide(2 * F.sum("e_in") + F.sum("e_out"), F.sum("n_c")), 6).alias("avg_degree_full"),
        F.count_if(F.col("n_c") == 1).alias("n_singletons"), F.count_if(some).alias("n_effective"), F.sum("n_c").alias("n_nodes"),
    )
    top5 = per.orderBy(F.desc("n_c"), "comm").limit(5).agg(F.sum("n_c").alias("top5"))
    median = weighted_median(per, "out_ratio", "n_c").select(F.round("weighted_median", 6).alias("node_weighted_median_out_ratio"))
    return flat.crossJoin(top5).crossJoin(median).withColumn("top5_share", F.round(F.try_divide("top5", "n_nodes"), 6)).drop("top5")


def size_stats(memb: DataFrame) -> DataFrame:
    """One row: communities, singletons, median size of the others, share of the largest and of the five largest."""
    sizes = memb.groupBy("comm").agg(F.count(F.lit(1)).alias("n_c"))
    top5 = sizes.orderBy(F.desc("n_c"), "comm").limit(5).agg(F.sum("n_c").alias("top5"))
    out = sizes.agg(F.count(F.lit(1)).alias("n_communities"), F.count_if(F.col("n_c") == 1).alias("n_singletons"), F.percentile(F.when(F.col("n_c") > 1, F.col("n_c")), 0.5).alias("median_nontrivial"), F.max("n_c").alias("largest"), F.sum("n_c").alias("n"))
    return out.crossJoin(top5).select("n_communities", "n_singletons", "median_nontrivial", F.round(F.col("largest") / F.col("n"), 6).alias("largest_share"), F.round(F.col("top5") / F.col("n"), 6).alias("top5_share"))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    some = F.col(value).isNotNull() & (F.col(weight) > 0)
    return df.where(some).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


def modularity(per: DataFrame, gamma: float = 1.0) -> DataFrame:
    totals = per.agg(F.sum(F.col("e_in") + F.col("e_out") / 2).alias("m"))
    part = F.col("e_in") / F.col("m") - gamma * F.pow((2 * F.col("e_in") + F.col("e_out")) / (2 * F.col("m")), 2)
    return per.crossJoin(F.broadcast(totals)).agg(F.round(F.sum(part), 6).alias("modularity"))


def rep_titles(deg: DataFrame, memb: DataFrame, articles: DataFrame, k: int = 3) -> DataFrame:
    """(comm, rep_titles): titles of the k nodes of highest degree, ties by id."""
    ranked = memb.select("page_id", "comm").join(deg, "page_id").withColumn("r", F.row_number().over(Window.partitionBy("comm").orderBy(F.desc("deg"), "page_id"))).where(F.col("r") <= k)
    named = ranked.join(articles.select("page_id", "title"), "page_id")
    return named.groupBy("comm").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]).alias("rep_titles"))


def clusters(per: DataFrame, pair: DataFrame, to: DataFrame) -> DataFrame:
    """Figures of clusters of communities; to: (comm, cluster)."""
    own = per.join(to, "comm").groupBy("cluster").agg(F.sum("n_c").alias("n2"), F.sum("e_in").alias("e_in2"))
    a, b = to.select(F.col("comm").alias("a"), F.col("cluster").alias("ca")), to.select(F.col("comm").alias("b"), F.col("cluster").alias("cb"))
    w = pair.join(a, "a").join(b, "b")
    inside = w.where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.sum("w").alias("e_between2"))
    leaving = w.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("cluster"), "w").groupBy("cluster").agg(F.sum("w").alias("e_out2"))
    out = own.join(inside, "cluster", "left").join(leaving, "cluster", "left").fillna(0)
    return out.withColumn("out_ratio2", F.try_divide("e_out2", F.col("e_in2") + F.col("e_between2") + F.col("e_out2")))
