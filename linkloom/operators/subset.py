"""Figures of a subset of articles: its links to the outside, communities inside it, its hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import community, graph


def node_traffic(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, ext_out, ext_in) of each node: directed links to and from articles outside the subset."""
    kinds = graph.classify_subset(edges, nodes).where("kind IN ('out', 'in')")
    own = kinds.select(F.when(F.col("kind") == "out", F.col("src")).otherwise(F.col("dst")).alias("page_id"), "kind")
    sums = own.groupBy("page_id").agg(F.count_if(F.col("kind") == "out").alias("ext_out"), F.count_if(F.col("kind") == "in").alias("ext_in"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return nodes.select("page_id").distinct().join(sums, "page_id", "left").select("page_id", zero("ext_out"), zero("ext_in"))


def leak_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, internal, outgoing and incoming links, share of outgoing ones that leave, nodes with a link outside."""
    kinds = graph.classify_subset(edges, nodes).agg(*[F.count_if(F.col("kind") == k).alias(c) for k, c in (("internal", "n_internal"), ("out", "n_out"), ("in", "n_in"))])
    some = node_traffic(edges, nodes).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("ext_out") + F.col("ext_in") > 0).alias("boundary_any"))
    out = kinds.crossJoin(some)
    return out.select("n_nodes", "n_internal", "n_out", "n_in", (F.col("n_out") / F.greatest(F.lit(1), F.col("n_internal") + F.col("n_out"))).alias("leak_ratio_out"), "boundary_any", (F.col("boundary_any") / F.greatest(F.lit(1), "n_nodes")).alias("boundary_any_ratio"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): links with both ends in the subset."""
    return graph.classify_subset(edges, nodes).where("kind = 'internal'").select("src", "dst")


def per_community(und: DataFrame, memb: DataFrame, traffic: DataFrame) -> DataFrame:
    """community.per_community of the subset's undirected edges, with ext_out, ext_in, ext, ext_ratio and boundary_any.

    boundary_any counts nodes with an edge to another community or a link outside the subset.
    """
    inside = community.per_community(und, memb)
    e = community.ends(und, memb).where("cu <> cv").select(F.explode(F.array("u", "v")).alias("page_id")).distinct().withColumn("crosses", F.lit(True))
    own = memb.select("page_id", "comm").join(traffic, "page_id", "left").join(e, "page_id", "left")
    some = F.coalesce("crosses", F.lit(False)) | (F.coalesce("ext_out", F.lit(0)) + F.coalesce("ext_in", F.lit(0)) > 0)
    sums = own.groupBy("comm").agg(F.coalesce(F.sum("ext_out"), F.lit(0)).alias("ext_out"), F.coalesce(F.sum("ext_in"), F.lit(0)).alias("ext_in"), F.count_if(some).alias("boundary_any"))
    out = inside.join(sums, "comm")
    return out.withColumn("ext", F.col("ext_out") + F.col("ext_in")).withColumn("ext_ratio", F.try_divide("ext_out", F.col("e_in") + F.col("e_out") + F.col("ext_out")))


def clusters(per: DataFrame, pair: DataFrame, to: DataFrame) -> DataFrame:
    """community.clusters with conductance2 and ext2 of a subset's clusters."""
    out = community.clusters(per, pair, to).join(per.join(to, "comm").groupBy("cluster").agg(F.sum("ext").alias("ext2")), "cluster")
    return out.withColumn("conductance2", F.try_divide("e_out2", 2 * (F.col("e_in2") + F.col("e_between2")) + F.col("e_out2")))


def hub_table(und: DataFrame, memb: DataFrame, traffic: DataFrame, articles: DataFrame, k: int = 30) -> DataFrame:
    """(rank, page_id, title, deg_internal, deg_outside, comm, flags): the k nodes with most links inside and outside, ties by id."""
    inside = graph.node_degrees(und, memb).withColumnRenamed("deg", "deg_internal")
    own = inside.join(traffic.select("page_id", (F.col("ext_out") + F.col("ext_in")).alias("deg_outside")), "page_id").join(memb.select("page_id", "comm"), "page_id")
    top = graph.top_hubs(own.withColumn("deg", F.col("deg_internal") + F.col("deg_outside")), articles, k)
    return top.select("rank", "page_id", "title", "deg_internal", "deg_outside", "comm", "flags")


def degree_points(und: DataFrame, memb: DataFrame) -> DataFrame:
    """(p50, p75, p90, p99, max_degree) of degrees inside the subset."""
    deg = graph.node_degrees(und, memb)
    return deg.agg(*[F.percentile("deg", s).alias(f"p{round(s * 100)}") for s in (0.5, 0.75, 0.9, 0.99)], F.max("deg").alias("max_degree"))


def title_to_page(pages: DataFrame, rdmap: DataFrame, title: str, follow: bool = True) -> DataFrame:
    """(page_id): the page of ns 0 with a title (spaces as underscores); follow: the article a redirect leads to, if any."""
    hit = pages.where((F.col("ns") == 0) & (F.col("title") == title.replace(" ", "_"))).select("page_id")
    if not follow:
        return hit
    return hit.join(rdmap.select(F.col("rd_from").alias("page_id"), "rd_final", F.lit(True).alias("is_rd")), "page_id", "left").select(F.when(F.col("is_rd"), F.col("rd_final")).otherwise(F.col("page_id")).alias("page_id")).where("page_id IS NOT NULL")
