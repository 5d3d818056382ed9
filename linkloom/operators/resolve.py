"""From raw link rows to resolved edges between articles, with one reason per dropped row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.sources.scratch import dealt, marked, parts_of


def redirect_map(redirects: DataFrame, pages: DataFrame, hops: int = 10) -> DataFrame:
    """(rd_from, rd_final): the article at the end of each redirect chain, null if none within the hops.

    Redirects to other namespaces or wikis are not part of the map.
    """
    ns0 = pages.where("ns = 0")
    first = redirects.where("rd_ns = 0 AND coalesce(interwiki, '') = ''").join(ns0.select(F.col("title").alias("rd_title"), F.col("page_id").alias("cur")), "rd_title", "left").select("rd_from", "cur")
    step = first.where("cur IS NOT NULL").select(F.col("rd_from").alias("cur"), F.col("cur").alias("nxt"))
    chase = first
    for _ in range(hops - 1):
        chase = chase.join(step, "cur", "left").select("rd_from", F.coalesce("nxt", "cur").alias("cur"))
    articles = ns0.where("NOT is_redirect").select(F.col("page_id").alias("cur"), F.col("page_id").alias("rd_final"))
    return chase.join(articles, "cur", "left").select("rd_from", "rd_final")


def link_ends(targets: DataFrame, pages: DataFrame, rdmap: DataFrame) -> DataFrame:
    """(lt_id, dst, t_reason, is_ns0): what each link target resolves to; t_reason is null where there is an article at the end.

    One row per target, those of other namespaces too (a lt_id that comes in several has a row for each), so the
    much larger table of links meets titles, pages and redirects in one join.
    """
    ns0 = pages.where("ns = 0").select(F.lit(0).alias("ns"), "title", F.col("page_id").alias("t_page"))
    named = targets.select("lt_id", F.col("ns").cast("int").alias("ns"), "title").join(ns0, ["ns", "title"], "left")
    final = named.join(rdmap.select(F.col("rd_from").alias("t_page"), "rd_final", F.lit(True).alias("is_rd")), "t_page", "left")
    dst = F.when(F.col("is_rd"), F.col("rd_final")).otherwise(F.col("t_page"))
    return final.select("lt_id", dst.alias("dst"), F.when(F.col("t_page").isNull(), "target_redlink").when(dst.isNull(), "target_dangling_redirect").alias("t_reason"), F.coalesce(F.col("ns") == 0, F.lit(False)).alias("is_ns0"))


def resolve_links(links: DataFrame, targets: DataFrame, pages: DataFrame, rdmap: DataFrame) -> DataFrame:
    """(src, dst, reason) for each link row; reason is the first step that drops it, or kept.

    The links are joined twice, with the resolved targets on lt_id and with the pages on pl_from; both
    keys are never null, and both joins are plain ones that adaptive execution broadcasts or splits. Links that
    note their parts are dealt out into so many for each.
    """
    n = parts_of(links)
    src = pages.where("ns = 0").select(F.col("page_id").alias("pl_from"), "is_redirect").join(rdmap.select(F.col("rd_from").alias("pl_from"), F.lit(True).alias("from_rd")), "pl_from", "left")
    j = dealt(links, n, "lt_id").join(dealt(link_ends(targets, pages, rdmap), n, "lt_id"), "lt_id", "left")
    j = dealt(j, n, "pl_from").join(dealt(src, n, "pl_from"), "pl_from", "left")
    reason = (
        F.when(F.col("pl_from_ns") != 0, "from_non_ns0")
        .when(F.col("from_rd"), "src_is_redirect")
        .when(F.col("is_redirect").isNull() | F.col("is_redirect"), "src_not_article")
        .when(~F.coalesce("is_ns0", F.lit(False)), "target_non_ns0")
        .when(F.col("t_reason").isNotNull(), F.col("t_reason"))
        .when(F.col("pl_from") == F.col("dst"), "self_loop")
        .otherwise("kept")
    )
    return marked(j.select(F.col("pl_from").alias("src"), "dst", reason.alias("reason")), n)


def redirect_counters(rdmap: DataFrame) -> DataFrame:
    """(n_redirects, n_found, n_dangling) of the redirect map."""
    return rdmap.agg(F.count(F.lit(1)).alias("n_redirects"), F.count("rd_final").alias("n_found"), F.count_if(F.col("rd_final").isNull()).alias("n_dangling"))


def text_links(pages_xml: DataFrame, strip_refs: bool = False) -> DataFrame:
    """(src, title) of the wiki links in page texts (page_id, ns, is_redirect, text) of articles, with prefixed ones marked (skipped)."""
    from linkloom.functions import titles

    rows = pages_xml.where("ns = 0 AND NOT is_redirect").select(F.col("page_id").alias("src"), F.explode(titles.wikilinks(titles.clean_wikitext(F.coalesce("text", F.lit("")), strip_refs))).alias("raw"))
    return rows.select("src", titles.normalize_title(F.col("raw")).alias("title"), titles.has_skipped_prefix(F.btrim("raw")).alias("skipped"))


def body_link_reasons(links: DataFrame, pages: DataFrame, rdmap: DataFrame) -> DataFrame:
    """(src, dst, reason) for each link of text_links: prefixed, empty, target_redlink, target_dangling_redirect, self_loop, duplicate or kept."""
    ends = link_ends(links.select("title").distinct().select(F.col("title").alias("lt_id"), F.lit(0).alias("ns"), "title"), pages, rdmap)
    j = links.join(ends.withColumnRenamed("lt_id", "title"), "title", "left")
    first = F.when(F.col("skipped"), "prefixed").when(F.col("title").isNull(), "empty").when(F.col("t_reason").isNotNull(), F.col("t_reason")).when(F.col("src") == F.col("dst"), "self_loop")
    j = j.select("src", F.when(first.isNull(), F.col("dst")).alias("dst"), first.alias("reason"))
    good = j.where("reason IS NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    twice = good.select("src", "dst", F.explode(F.sequence(F.lit(1), "n")).alias("i")).select("src", "dst", F.when(F.col("i") == 1, "kept").otherwise("duplicate").alias("reason"))
    return j.where("reason IS NOT NULL").unionByName(twice)


def body_edges(links: DataFrame, pages: DataFrame, rdmap: DataFrame) -> DataFrame:
    """Distinct (src, dst) from (src, title) pairs of page texts; red links, dangling redirects and self links go."""
    hit = links.join(pages.where("ns = 0").select("title", F.col("page_id").alias("dst")), "title")
    hit = hit.join(rdmap.select(F.col("rd_from").alias("dst"), "rd_final", F.lit(True).alias("is_rd")), "dst", "left")
    hit = hit.select("src", F.when(F.col("is_rd"), F.col("rd_final")).otherwise(F.col("dst")).alias("dst"))
    return hit.where("dst IS NOT NULL AND src <> dst").distinct()
