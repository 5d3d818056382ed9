"""Further queries: dump tables, subsets, statistics, names, geometry, viewer figures, audits, and invariants of the solvers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import titles
from linkloom.operators import audit, catalog, category, community, geometry, graph, layout, resolve, subset, view
from linkloom.sources import dumps

from . import solvers
from .catalog import AC, CNT, CROSS, NAMES, artcat, galaxies, named, per, query, r6

# Dump tables


def lines(df: DataFrame, table: str, tup) -> DataFrame:
    """The tuples of a frame as INSERT statements of fifty each."""
    numbered = df.select(tup.alias("tup"), F.pmod(F.xxhash64(*df.columns), F.lit(50)).alias("part"))
    return numbered.groupBy("part").agg(F.concat_ws(",", F.collect_list("tup")).alias("v")).select(F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), "v", F.lit(";")).alias("value"))


def quoted(c: str):
    return F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


@query("linktarget_parse", "SELECT lt_id, ns::INT AS ns, concat(title, chr(92), '''s') AS title FROM w_linktarget")
def _(w):
    odd = w.linktarget.select("lt_id", "ns", F.concat("title", F.lit("\\'s")).alias("title"))
    return dumps.parse_tuples(lines(odd, "linktarget", F.concat(F.lit("("), "lt_id", F.lit(","), "ns", F.lit(","), quoted("title"), F.lit(")"))), "linktarget")


@query("redirect_parse", "SELECT rd_from, rd_ns::INT AS rd_ns, rd_title, CASE WHEN rd_from % 3 = 0 THEN 'en' ELSE '' END AS interwiki FROM w_redirect")
def _(w):
    tup = F.concat(F.lit("("), "rd_from", F.lit(","), "rd_ns", F.lit(","), quoted("rd_title"), F.when(F.col("rd_from") % 3 == 0, ",'en'").when(F.col("rd_from") % 3 == 1, ",NULL").otherwise(",''"), F.lit(",'part')"))
    return dumps.parse_tuples(lines(w.redirect, "redirect", tup), "redirect")


@query("categorylinks_parse", "SELECT page_id AS cl_from, cl_type, cat_lt AS lt_id FROM w_artcat")
def _(w):
    tup = F.concat(F.lit("("), "page_id", F.lit(",'key\\'\\\\',"), F.lit("'2026-01-02 03:04:05','',"), quoted("cl_type"), F.lit(",1,"), "cat_lt", F.lit(")"))
    return dumps.parse_tuples(lines(w.artcat, "categorylinks", tup), "categorylinks")


query("categories_table", "SELECT (row_number() OVER (ORDER BY lt_id) - 1)::INT AS cat_id, lt_id, title FROM w_linktarget WHERE ns = 14")(lambda w: dumps.categories(w.linktarget))


def own_cats(w) -> DataFrame:
    return w.category.where("lt_id % 7 <> 0").select("lt_id", F.col("lt_id").alias("cat_id"), "title")


def own_catlinks(w) -> DataFrame:
    return w.artcat.select(F.col("page_id").alias("cl_from"), "cl_type", F.col("cat_lt").alias("lt_id"))


query("article_categories", "SELECT c.page_id, c.cat_lt AS cat_id FROM w_artcat c JOIN w_article a ON a.page_id = c.page_id WHERE cl_type = 'page' AND cat_lt % 7 <> 0")(lambda w: dumps.article_categories(own_catlinks(w), own_cats(w), w.article))
query("category_counters", "SELECT CASE WHEN cl_type <> 'page' THEN cl_type WHEN a.page_id IS NULL THEN 'not_article' WHEN cat_lt % 7 = 0 THEN 'not_category' ELSE 'kept' END AS reason, count(*) AS n FROM w_artcat c LEFT JOIN w_article a ON a.page_id = c.page_id GROUP BY 1")(lambda w: dumps.category_counters(own_catlinks(w), own_cats(w), w.article))
query("redirect_counters", "SELECT count(*) AS n_redirects, count(rd_final) AS n_found, count(*) - count(rd_final) AS n_dangling FROM w_rdmap")(lambda w: resolve.redirect_counters(w.rdmap()))

BODY = "concat('a [[Page_', page_id * 3 % 2000, '|x]] [[File:a]] <!-- [[Page_1]] --> [[page_', page_id, ']] [[Page ', page_id * 3 % 2000, '#s]] [[Nope_', page_id, ']] [[#top]]')"


@query(
    "body_link_reasons",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN skipped THEN 'prefixed' WHEN l.title = '' THEN 'empty' WHEN p.page_id IS NULL THEN 'target_redlink' WHEN rd.rd_from IS NOT NULL AND rd.rd_final IS NULL THEN 'target_dangling_redirect'
      WHEN src = coalesce(rd.rd_final, p.page_id) THEN 'self_loop' WHEN row_number() OVER (PARTITION BY src, coalesce(rd.rd_final, p.page_id), skipped OR l.title = '' OR p.page_id IS NULL OR (rd.rd_from IS NOT NULL AND rd.rd_final IS NULL) ORDER BY pos) > 1 THEN 'duplicate' ELSE 'kept' END AS reason
      FROM (SELECT page_id AS src, unnest([concat('Page_', page_id * 3 % 2000), 'File:a', concat('Page_', page_id), concat('Page_', page_id * 3 % 2000), concat('Nope_', page_id), '']) AS title, unnest([1, 2, 3, 4, 5, 6]) AS pos, unnest([false, true, false, false, false, false]) AS skipped FROM w_article) l
      LEFT JOIN w_page p ON p.title = l.title AND p.ns = 0 LEFT JOIN w_rdmap rd ON rd.rd_from = p.page_id) GROUP BY reason""",
)
def _(w):
    pages = w.article.select("page_id", F.lit(0).alias("ns"), F.lit(False).alias("is_redirect"), F.expr(BODY).alias("text"))
    return resolve.body_link_reasons(resolve.text_links(pages), w.page, w.rdmap()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# Graph and subsets

DEG = "(SELECT a.page_id, a.title, coalesce(o.n, 0) AS od, coalesce(i.n, 0) AS id FROM w_article a LEFT JOIN (SELECT src, count(*) AS n FROM w_edge GROUP BY src) o ON o.src = a.page_id LEFT JOIN (SELECT dst, count(*) AS n FROM w_edge GROUP BY dst) i ON i.dst = a.page_id)"
query(
    "dedup_meta",
    """SELECT n_directed, 0::BIGINT AS n_self_loops, n_undirected, round(1 - n_undirected / n_directed, 6) AS reciprocity_implied, round((SELECT sum(CASE WHEN k = 2 THEN 2 ELSE 0 END) / sum(k) FROM (SELECT count(*) AS k FROM (SELECT DISTINCT src, dst FROM w_edge) GROUP BY least(src, dst), greatest(src, dst))), 6) AS reciprocity
  FROM (SELECT count(*) AS n_directed FROM w_edge), (SELECT count(*) AS n_undirected FROM w_und)""",
)(lambda w: graph.dedup_meta(w.edges(), w.und()).select("n_directed", "n_self_loops", "n_undirected", *r6("reciprocity_implied", "reciprocity")))
query("hub_filter", f"SELECT u, v FROM w_und JOIN {DEG} a ON a.page_id = u JOIN {DEG} b ON b.page_id = v WHERE greatest(a.id, b.id) <= 18 AND greatest(a.od, b.od) <= 20")(lambda w: graph.drop_hub_edges(w.und(), graph.degrees(w.edges(), w.article), 18, 20))
query(
    "hub_filter_counters",
    f"""SELECT count_if(id > 18)::BIGINT AS nodes_in_capped, count_if(od > 20)::BIGINT AS nodes_out_capped, count_if(id > 18 OR od > 20)::BIGINT AS nodes_isolated, any_value(m - k) AS edges_dropped, round(any_value((m - k) / m), 6) AS dropped_share
  FROM {DEG}, (SELECT count(*) AS m FROM w_und), (SELECT count(*) AS k FROM w_und JOIN {DEG} a ON a.page_id = u JOIN {DEG} b ON b.page_id = v WHERE greatest(a.id, b.id) <= 18 AND greatest(a.od, b.od) <= 20)""",
)(lambda w: graph.hub_filter_counters(w.und(), graph.degrees(w.edges(), w.article), 18, 20).select("nodes_in_capped", "nodes_out_capped", "nodes_isolated", "edges_dropped", *r6("dropped_share")))
query("id_window_middle", "SELECT page_id, title FROM w_article ORDER BY page_id LIMIT 100 OFFSET (SELECT count(*) // 2 - 50 FROM w_article)")(lambda w: graph.id_window(w.article, 100, "middle"))

HOP = "(SELECT dst FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY (e.src * 7919 + e.dst * 104729) % 1000003, e.dst) AS r FROM (SELECT DISTINCT src, dst FROM w_edge) e JOIN {front} f ON f.page_id = e.src) WHERE r <= 6 AND dst IN (SELECT dst FROM (SELECT DISTINCT src, dst FROM w_edge) GROUP BY dst HAVING count(*) <= 14))"
H0 = "(SELECT page_id FROM w_article WHERE page_id IN (1, 2, 3))"
H1 = f"(SELECT DISTINCT dst AS page_id FROM {HOP.format(front=H0)} WHERE dst NOT IN {H0})"
H2 = f"(SELECT DISTINCT dst AS page_id FROM {HOP.format(front=H1)} WHERE dst NOT IN {H0} AND dst NOT IN {H1})"
query("bfs_capped", f"SELECT page_id, 0::INT AS hop FROM {H0} UNION ALL SELECT page_id, 1 FROM {H1} UNION ALL SELECT page_id, 2 FROM {H2}")(lambda w: graph.bfs(w.edges().distinct(), w.article.where("page_id IN (1, 2, 3)"), 2, 6, 14))
query("bfs_hop_log", f"SELECT hop, n AS new_nodes, sum(n) OVER (ORDER BY hop)::BIGINT AS total FROM (SELECT 0::INT AS hop, count(*) AS n FROM {H0} UNION ALL SELECT 1, count(*) FROM {H1} UNION ALL SELECT 2, count(*) FROM {H2}) WHERE n > 0")(lambda w: graph.hop_log(graph.bfs(w.edges().distinct(), w.article.where("page_id IN (1, 2, 3)"), 2, 6, 14)))

BOTH = "(SELECT a.page_id, a.title, coalesce(b.n, 0) AS bd, coalesce(l.n, 0) AS pl FROM w_article a LEFT JOIN (SELECT src, count(*) AS n FROM w_edge WHERE dst % 3 = 0 GROUP BY src) b ON b.src = a.page_id LEFT JOIN (SELECT src, count(*) AS n FROM w_edge GROUP BY src) l ON l.src = a.page_id)"


def both_degrees(w) -> DataFrame:
    out = lambda e: e.groupBy(F.col("src").alias("page_id")).agg(F.count(F.lit(1)).alias("out_deg"))
    return graph.body_vs_links(out(w.edges().where("dst % 3 = 0")), out(w.edges()))


def _points(c: str, shares=(0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) -> str:
    return ", ".join(f"round(quantile_cont({c}, {s}), 6) AS {c}_p{round(s * 100)}" for s in shares)


query(
    "compare_stats",
    f"""SELECT count(*) AS n, round(avg(pl), 6) AS pl_mean, round(avg(bd), 6) AS bd_mean, round(avg(ratio), 6) AS ratio_mean, {_points('pl')}, {_points('bd')}, {_points('ratio')}, round(corr(pl, bd), 6) AS pearson, count_if(bd = 0 AND pl >= 50)::BIGINT AS n_template, round(corr(rp, rb), 6) AS spearman, round(count_if(bd = 0 AND pl >= 50) / count(*), 6) AS template_share
  FROM (SELECT *, pl / greatest(1, bd) AS ratio, row_number() OVER (ORDER BY pl, page_id) AS rp, row_number() OVER (ORDER BY bd, page_id) AS rb FROM {BOTH} WHERE pl > 0 OR bd > 0)""",
)(lambda w: graph.compare_stats(both_degrees(w)))
query("top_inflated", f"SELECT page_id, title, bd, pl, round(pl / greatest(1, bd), 6) AS ratio FROM {BOTH} ORDER BY pl - bd DESC, page_id LIMIT 30")(lambda w: graph.top_inflated(both_degrees(w), w.article).select("page_id", "title", "bd", "pl", *r6("ratio")))

SUB = "(SELECT page_id FROM w_article WHERE page_id % 3 = 0)"
TRAFFIC = f"(SELECT n.page_id, (SELECT count(*) FROM w_edge WHERE src = n.page_id AND dst % 3 <> 0) AS ext_out, (SELECT count(*) FROM w_edge WHERE dst = n.page_id AND src % 3 <> 0) AS ext_in FROM {SUB} n)"
SMEMB = "(SELECT * FROM w_memb WHERE page_id % 3 = 0)"
SMU = "(SELECT * FROM w_mu WHERE u % 3 = 0 AND v % 3 = 0)"


def sub(w) -> DataFrame:
    return w.article.where("page_id % 3 = 0").select("page_id")


def sub_und(w) -> DataFrame:
    return graph.undirected(subset.induced(w.edges(), sub(w)))


def sub_memb(w) -> DataFrame:
    return w.memb.where("page_id % 3 = 0")


def sub_per(w) -> DataFrame:
    return subset.per_community(sub_und(w), sub_memb(w), subset.node_traffic(w.edges(), sub(w)))


query("subset_traffic", f"SELECT page_id, ext_out, ext_in FROM {TRAFFIC}")(lambda w: subset.node_traffic(w.edges(), sub(w)))
query("subset_leaks", f"SELECT n_nodes, n_internal, n_out, n_in, round(n_out / (n_internal + n_out), 6) AS leak_ratio_out, b AS boundary_any, round(b / n_nodes, 6) AS boundary_any_ratio FROM (SELECT count_if(src % 3 = 0 AND dst % 3 = 0)::BIGINT AS n_internal, count_if(src % 3 = 0 AND dst % 3 <> 0)::BIGINT AS n_out, count_if(src % 3 <> 0 AND dst % 3 = 0)::BIGINT AS n_in FROM w_edge), (SELECT count(*) AS n_nodes, count_if(ext_out + ext_in > 0)::BIGINT AS b FROM {TRAFFIC})")(lambda w: subset.leak_stats(w.edges(), sub(w)).select("n_nodes", "n_internal", "n_out", "n_in", *r6("leak_ratio_out"), "boundary_any", *r6("boundary_any_ratio")))
SPER = f"""(SELECT m.comm, m.n_c, coalesce(e.e_in, 0) AS e_in, coalesce(o.e_out, 0) AS e_out, m.ext_out, m.ext_in, m.boundary_any FROM
  (SELECT m.comm, count(*) AS n_c, sum(ext_out)::BIGINT AS ext_out, sum(ext_in)::BIGINT AS ext_in, count_if(ext_out + ext_in > 0 OR x.n IS NOT NULL)::BIGINT AS boundary_any FROM {SMEMB} m JOIN {TRAFFIC} t ON t.page_id = m.page_id LEFT JOIN (SELECT DISTINCT unnest([u, v]) AS n FROM {SMU} WHERE cu <> cv) x ON x.n = m.page_id GROUP BY m.comm) m
  LEFT JOIN (SELECT cu AS comm, count(*) AS e_in FROM {SMU} WHERE cu = cv GROUP BY 1) e ON e.comm = m.comm LEFT JOIN (SELECT comm, count(*) AS e_out FROM (SELECT unnest([cu, cv]) AS comm FROM {SMU} WHERE cu <> cv) GROUP BY comm) o ON o.comm = m.comm)"""
query("subset_metrics", f"SELECT comm, n_c, e_in, e_out, ext_out, ext_in, ext_out + ext_in AS ext, boundary_any, round(ext_out / nullif(e_in + e_out + ext_out, 0), 6) AS ext_ratio FROM {SPER}")(lambda w: sub_per(w).select("comm", "n_c", "e_in", "e_out", "ext_out", "ext_in", "ext", "boundary_any", *r6("ext_ratio")))
SPAIRS = f"(SELECT least(cu, cv) AS a, greatest(cu, cv) AS b, count(*) AS w FROM {SMU} WHERE cu <> cv GROUP BY 1, 2)"
query("subset_clusters", f"""SELECT k AS cluster, n2, e_in2, eb AS e_between2, eo AS e_out2, ext2, round(eo / nullif(2 * (e_in2 + eb) + eo, 0), 6) AS conductance2 FROM (SELECT k, n2, e_in2, ext2, coalesce((SELECT sum(w) FROM {SPAIRS} WHERE a % 5 = k AND b % 5 = k), 0)::BIGINT AS eb, coalesce((SELECT sum(w) FROM {SPAIRS} WHERE a % 5 <> b % 5 AND (a % 5 = k OR b % 5 = k)), 0)::BIGINT AS eo FROM (SELECT (comm % 5)::INT AS k, sum(n_c)::BIGINT AS n2, sum(e_in)::BIGINT AS e_in2, sum(ext_out + ext_in)::BIGINT AS ext2 FROM {SPER} GROUP BY 1))""")(lambda w: subset.clusters(sub_per(w), community.pairs(sub_und(w), sub_memb(w)), sub_memb(w).selectExpr("comm", "CAST(comm % 5 AS INT) AS cluster").distinct()).select("cluster", "n2", "e_in2", "e_between2", "e_out2", "ext2", *r6("conductance2")))
SDEG = f"(SELECT m.page_id, m.comm, coalesce(d.n, 0) AS di, t.ext_out + t.ext_in AS eo FROM {SMEMB} m JOIN {TRAFFIC} t ON t.page_id = m.page_id LEFT JOIN (SELECT k AS page_id, count(*) AS n FROM (SELECT unnest([u, v]) AS k FROM {SMU}) GROUP BY k) d ON d.page_id = m.page_id)"
query("hub_table", f"SELECT row_number() OVER (ORDER BY di + eo DESC, page_id)::INT AS rank, page_id, di AS deg_internal, eo AS deg_outside, comm FROM {SDEG} ORDER BY di + eo DESC, page_id LIMIT 30")(lambda w: subset.hub_table(sub_und(w), sub_memb(w), subset.node_traffic(w.edges(), sub(w)), w.article).select("rank", "page_id", "deg_internal", "deg_outside", "comm"))
query("subset_degree_points", f"SELECT quantile_cont(di, 0.5) AS p50, quantile_cont(di, 0.75) AS p75, round(quantile_cont(di, 0.9), 6) AS p90, round(quantile_cont(di, 0.99), 6) AS p99, max(di) AS max_degree FROM {SDEG}")(lambda w: subset.degree_points(sub_und(w), sub_memb(w)).select("p50", "p75", *r6("p90", "p99"), "max_degree"))
query("title_to_page", "SELECT 7::BIGINT AS asked, rd_final AS page_id FROM w_rdmap WHERE rd_from = 7 UNION ALL SELECT 16, page_id FROM w_page WHERE title = 'Page_16'")(lambda w: subset.title_to_page(w.page, w.rdmap(), "Page 7").select(F.lit(7).cast("long").alias("asked"), "page_id").unionByName(subset.title_to_page(w.page, w.rdmap(), "Page_16").select(F.lit(16).cast("long").alias("asked"), "page_id")))

# Communities and names

query("size_stats", "SELECT count(*) AS n_communities, count_if(n = 1)::BIGINT AS n_singletons, quantile_cont(n, 0.5) FILTER (WHERE n > 1) AS median_nontrivial, round(max(n) / sum(n), 6) AS largest_share, round(sum(n) FILTER (WHERE r <= 5) / sum(n), 6) AS top5_share FROM (SELECT n, row_number() OVER (ORDER BY n DESC, comm) AS r FROM (SELECT comm, count(*) AS n FROM w_memb GROUP BY comm))")(lambda w: community.size_stats(w.memb))
query("weighted_mean", "SELECT round(sum(v * n_c) / sum(n_c), 6) AS weighted_mean FROM (SELECT e_out / nullif(e_in + e_out, 0) AS v, n_c FROM w_comm) WHERE v IS NOT NULL")(lambda w: community.weighted_mean(per(w), "out_ratio", "n_c").select(*r6("weighted_mean")))
query("resolution_pick", "SELECT arg_min(r, CASE WHEN m < 50 THEN 1000 WHEN m BETWEEN 200 AND 3000 THEN 0 ELSE 100 END + abs(ln(greatest(m, 1) / 800))) AS resolution FROM (SELECT macro::DOUBLE AS r, sum(page_id % 7 + 1) * 1.0 * (CASE macro WHEN 0 THEN 0.01 WHEN 1 THEN 5 ELSE 0.3 END) AS m FROM w_memb GROUP BY macro)")(lambda w: catalog.pick_resolution(w.memb.groupBy(F.col("macro").cast("double").alias("resolution")).agg((F.sum(F.col("page_id") % 7 + 1) * F.when(F.first("macro") == 0, 0.01).when(F.first("macro") == 1, 5.0).otherwise(0.3)).alias("median_size"))))

CHOICES = "CASE page_id % 6 WHEN 0 THEN '日本の作家に関するスタブ' WHEN 1 THEN '日本の河川' WHEN 2 THEN 'すべてのスタブ記事' WHEN 3 THEN 'Topic' WHEN 4 THEN '作家の一覧' END"


@query(
    "name_choice",
    """SELECT page_id, CASE WHEN ok AND k = 0 THEN '日本の作家' WHEN ok AND k = 1 THEN '日本の河川' WHEN ok AND k = 3 THEN 'Topic' WHEN ok AND k = 4 THEN '作家' WHEN page_id % 2 = 0 THEN concat('Common ', page_id) WHEN page_id % 3 = 0 THEN '' ELSE concat(title, '等') END AS name,
  CASE WHEN ok AND k IN (0, 4) THEN 'category_stem' WHEN ok AND k IN (1, 3) THEN 'category' WHEN page_id % 2 = 0 THEN 'category' WHEN page_id % 3 = 0 THEN 'none' ELSE 'rep' END AS source FROM (SELECT page_id, title, page_id % 6 AS k, page_id % 10 >= 5 AS ok FROM w_page)""",
)
def _(w):
    top3 = F.expr("array(named_struct('title', concat('Common ', page_id), 'share', CASE WHEN page_id % 2 = 0 THEN 0.2D ELSE 0.1D END))")
    reps = F.expr("CASE WHEN page_id % 3 = 0 THEN array() ELSE array(title, 'other') END")
    share = F.when(F.col("page_id") % 10 >= 5, 0.5).otherwise(0.1)
    return w.page.select("page_id", titles.name_choice(F.expr(CHOICES), share, top3, reps).alias("c")).select("page_id", "c.name", "c.source")


def reps(w, level: str = "comm") -> DataFrame:
    return community.rep_titles(graph.node_degrees(w.und(), w.article), w.memb.select("page_id", F.col(level).alias("comm")), w.article)


def full_catalog(w) -> DataFrame:
    return catalog.galaxy_table(per(w), named(w), reps(w), w.memb, community.pairs(w.und(), w.memb), w.memb.selectExpr("comm", "CAST(comm % 4 AS INT) AS cluster").distinct())


REP = "(SELECT {k} AS comm, string_agg(title, ',' ORDER BY r) AS reps, max(title) FILTER (WHERE r = 1) AS first, count(*) AS n_reps FROM (SELECT m.{k}, a.title, row_number() OVER (PARTITION BY m.{k} ORDER BY d.deg DESC, m.page_id) AS r FROM w_memb m JOIN w_deg d ON d.page_id = m.page_id JOIN w_article a ON a.page_id = m.page_id) WHERE r <= 3 GROUP BY {k})"
SHARES = f"(SELECT comm, title, cnt, cnt / m AS share, row_number() OVER (PARTITION BY comm ORDER BY cnt DESC, cat_id) AS r FROM (SELECT s.*, c.title, k.m FROM {CNT} s JOIN w_category c ON c.lt_id = s.cat_id JOIN (SELECT m.comm, count(DISTINCT c.page_id) AS m FROM {AC} c JOIN w_memb m ON m.page_id = c.page_id GROUP BY m.comm) k ON k.comm = s.comm))"
FIRST = f"(SELECT comm, arg_min(title, o) AS title FROM (SELECT comm, name AS title, share, 0 AS o FROM {NAMES} UNION ALL SELECT comm, title, share, r FROM {SHARES} WHERE r <= 3) WHERE share >= 0.15 GROUP BY comm)"
query(
    "galaxy_catalog",
    f"""SELECT c.comm AS galaxy_id, (c.comm % 5)::INT AS macro_id, (c.comm % 4)::INT AS cluster_l2, n_c AS n_articles, e_in, e_out, round(e_out / nullif(e_in + e_out, 0), 6) AS out_ratio, n_c <= 1 AS is_dust, CASE WHEN n_c <= 1 THEN 'dust' WHEN n_c >= 1000 AND e_out / nullif(e_in + e_out, 0) >= 0.9 THEN 'medium' ELSE 'galaxy' END AS display_class,
  coalesce(f.title, concat(r.first, CASE WHEN r.n_reps > 1 THEN '等' ELSE '' END)) AS name, CASE WHEN f.title IS NULL THEN 'rep' ELSE 'category' END AS name_source, round(x.share, 6) AS name_share, r.reps AS reps, coalesce(n.n, 0) AS n_neighbors
  FROM w_comm c LEFT JOIN {NAMES} x ON x.comm = c.comm LEFT JOIN {FIRST} f ON f.comm = c.comm LEFT JOIN {REP.format(k='comm')} r ON r.comm = c.comm LEFT JOIN (SELECT g, count(*) AS n FROM (SELECT a AS g FROM w_pairs UNION ALL SELECT b FROM w_pairs) GROUP BY g) n ON n.g = c.comm""",
)(lambda w: full_catalog(w).select("galaxy_id", "macro_id", "cluster_l2", "n_articles", "e_in", "e_out", *r6("out_ratio"), "is_dust", "display_class", "name", "name_source", *r6("name_share"), F.array_join("rep_titles", ",").alias("reps"), "n_neighbors"))


def per_macro(w) -> DataFrame:
    return community.per_community(w.und(), w.memb.select("page_id", F.col("macro").alias("comm")))


query(
    "macro_table",
    f"""SELECT m.macro AS macro_id, m.n AS n_articles, m.n <= 1 AS is_dust, m.g AS n_galaxies, i.n AS e_in, o.n AS e_out, round(o.n / (i.n + o.n), 6) AS out_ratio, r.reps, t.top FROM (SELECT macro, count(*) AS n, count(DISTINCT comm) AS g FROM w_memb GROUP BY macro) m
  JOIN (SELECT cu % 5 AS macro, count(*) AS n FROM w_mu WHERE cu % 5 = cv % 5 GROUP BY 1) i ON i.macro = m.macro JOIN (SELECT macro, count(*) AS n FROM (SELECT unnest([cu % 5, cv % 5]) AS macro FROM w_mu WHERE cu % 5 <> cv % 5) GROUP BY macro) o ON o.macro = m.macro JOIN {REP.format(k='macro')} r ON r.comm = m.macro
  JOIN (SELECT macro, string_agg(comm::VARCHAR, ',' ORDER BY q) AS top FROM (SELECT macro, comm, row_number() OVER (PARTITION BY macro ORDER BY n DESC, comm) AS q FROM (SELECT macro, comm, count(*) AS n FROM w_memb GROUP BY ALL)) WHERE q <= 5 GROUP BY macro) t ON t.macro = m.macro""",
)(lambda w: catalog.macro_table(w.memb, per_macro(w), galaxies(w), reps(w, "macro")).select("macro_id", "n_articles", "is_dust", "n_galaxies", "e_in", "e_out", *r6("out_ratio"), F.array_join("rep_titles", ",").alias("reps"), F.array_join("top_galaxies", ",").alias("top")))

SIZES, RATIOS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99), (0.1, 0.25, 0.5, 0.75, 0.9)
EFF = "FILTER (WHERE n_c >= 2)"
query(
    "global_metrics",
    "SELECT round(sum(e_out) / 2 / (sum(e_in) + sum(e_out) / 2), 6) AS cross_edge_fraction, round(max(n_c) / sum(n_c), 6) AS largest_share, round(sum(e_out) / (sum(e_in) + sum(e_out)), 6) AS mean_out_ratio_edge_weighted, "
    + ", ".join([f"round(quantile_cont(n_c, {s}), 6) AS size_all_p{round(s * 100)}, round(quantile_cont(n_c, {s}) {EFF}, 6) AS size_p{round(s * 100)}" for s in SIZES] + [f"round(quantile_cont(o, {s}) {EFF}, 6) AS out_ratio_p{round(s * 100)}, round(quantile_cont(cd, {s}) {EFF}, 6) AS conductance_p{round(s * 100)}" for s in RATIOS])
    + """, round(coalesce(sum(n_c) FILTER (WHERE n_c >= 2 AND o < 0.3), 0) / sum(n_c), 6) AS node_share_out_lt_03, round(coalesce(sum(n_c) FILTER (WHERE n_c >= 2 AND o < 0.5), 0) / sum(n_c), 6) AS node_share_out_lt_05, round(sum(boundary) / sum(n_c), 6) AS boundary_ratio_node_weighted, round((2 * sum(e_in) + sum(e_out)) / sum(n_c), 6) AS avg_degree_full,
  count_if(n_c = 1)::BIGINT AS n_singletons, count_if(n_c >= 2)::BIGINT AS n_effective, sum(n_c)::BIGINT AS n_nodes, round(min(o) FILTER (WHERE cum >= total / 2), 6) AS node_weighted_median_out_ratio, round(sum(n_c) FILTER (WHERE r <= 5) / sum(n_c), 6) AS top5_share
  FROM (SELECT *, sum(CASE WHEN o IS NOT NULL THEN n_c END) OVER (ORDER BY o NULLS FIRST) AS cum, sum(CASE WHEN o IS NOT NULL THEN n_c END) OVER () AS total, row_number() OVER (ORDER BY n_c DESC, comm) AS r FROM (SELECT *, e_out / nullif(e_in + e_out, 0) AS o, e_out / nullif(2 * e_in + e_out, 0) AS cd FROM w_comm))""",
)(lambda w: community.global_metrics(per(w)))

# Geometry and layout figures

query("degree_sides", "SELECT m.page_id, count_if(s) AS int_deg, count_if(NOT s) AS ext_deg FROM w_memb m LEFT JOIN (SELECT unnest([u, v]) AS n, cu = cv AS s FROM w_mu) e ON e.n = m.page_id GROUP BY m.page_id".replace("count_if(s)", "count_if(s)::BIGINT").replace("count_if(NOT s)", "count_if(NOT s)::BIGINT"))(lambda w: layout.degree_sides(w.und(), w.memb))
query("bucket_counts", "SELECT comm, n_c AS n, e_in AS n_inner, e_out AS n_cross FROM w_comm")(lambda w: layout.bucket_counts(w.und(), w.memb))
DISC = "(SELECT a.radius AS a, b.radius AS b, greatest(sqrt((a.{p} - b.{p}) ** 2 + (a.{q} - b.{q}) ** 2), 1e-9) AS d FROM w_pos a JOIN w_pos b ON a.comm < b.comm)"
AREA = "SELECT {k}::INT AS view, round(coalesce(sum(a ** 2 * acos(greatest(-1, least(1, (d ** 2 + a ** 2 - b ** 2) / (2 * d * a)))) + b ** 2 * acos(greatest(-1, least(1, (d ** 2 + b ** 2 - a ** 2) / (2 * d * b)))) - 0.5 * sqrt(greatest(0, (a + b - d) * (d + a - b) * (d - a + b) * (d + a + b)))), 0) / (SELECT sum(pi() * radius ** 2) FROM w_pos), 6) AS overlap FROM {disc} WHERE d < a + b"
query("projection_overlap", " UNION ALL ".join(AREA.format(k=k, disc=DISC.format(p=p, q=q)) for k, p, q in ((0, "x", "y"), (1, "y", "z"), (2, "x", "z"))))(lambda w: layout.projection_overlap(w.pos(), layout.view_frames(w.spark, 4)).where("view < 3").select("view", *r6("overlap")))
query("overlap_within", "SELECT round(coalesce(sum(pi() * (s - d) ** 2 * (d ** 2 + 2 * d * s - 3 * (ra - rb) ** 2) / (12 * d)), 0) / (SELECT sum(pi() * 4 / 3 * radius ** 3) FROM w_pos), 6) AS overlap, count(*) AS n_pairs FROM (SELECT a.radius AS ra, b.radius AS rb, a.radius + b.radius AS s, greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), abs(a.radius - b.radius), 1e-9) AS d FROM w_pos a JOIN w_pos b ON a.comm < b.comm AND a.comm % 5 = b.comm % 5) WHERE d < s")(lambda w: layout.overlap_fraction(w.pos(), "macro").select(F.round("overlap", 6).alias("overlap"), "n_pairs"))
EIG = "(SELECT macro, n, q, p, acos(greatest(-1, least(1, (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2))) / 3 AS phi FROM (SELECT macro, n, q, p, (xx - q) / p AS a, (yy - q) / p AS b, (zz - q) / p AS c, xy / p AS d, xz / p AS e, yz / p AS f FROM (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) AS p FROM (SELECT *, (xx + yy + zz) / 3 AS q FROM (SELECT comm % 5 AS macro, count(*) AS n, covar_samp(x, x) AS xx, covar_samp(y, y) AS yy, covar_samp(z, z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz FROM w_pos GROUP BY 1)))))"
query("flatness", f"SELECT macro::INT AS macro, n, round(1 - greatest(0, q + 2 * p * cos(phi + 2 * pi() / 3)) / (q + 2 * p * cos(phi)), 6) AS flat FROM {EIG}")(lambda w: layout.flatness(w.pos(), "macro").select("macro", "n", *r6("flat")))
NEAR = "(SELECT a.comm AS i, b.comm AS j, row_number() OVER (PARTITION BY a.comm ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, b.comm) AS near FROM w_pos a JOIN w_pos b ON a.comm <> b.comm)"
STRONG = "(SELECT g, o, r, least(5, n) AS kk FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w DESC, o) AS r, count(*) OVER (PARTITION BY g) AS n FROM (SELECT a AS g, b AS o, w FROM w_pairs UNION ALL SELECT b, a, w FROM w_pairs)) WHERE r <= least(5, n))"
query("adjacency", f"SELECT round((SELECT avg(s) FROM (SELECT g, sum(CASE WHEN near <= kk THEN 1.0::DOUBLE ELSE 0 END) / max(kk) AS s FROM {STRONG} t JOIN {NEAR} n ON n.i = t.g AND n.j = t.o GROUP BY g)), 6) AS recall, (SELECT count(DISTINCT g) FROM {STRONG}) AS n, round(corr(rw, rd), 6) AS spearman FROM (SELECT row_number() OVER (ORDER BY w, pair) AS rw, row_number() OVER (ORDER BY d, pair) AS rd FROM (SELECT w, concat(a, '-', b) AS pair, round((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2, 9) AS d FROM w_pairs JOIN w_pos p ON p.comm = a JOIN w_pos q ON q.comm = b))")(lambda w: layout.adjacency(w.pos(), community.pairs(w.und(), w.memb)).select(*r6("recall"), "n", *r6("spearman")))


def spread(w) -> DataFrame:
    """Places for articles by plain arithmetic."""
    return w.memb.selectExpr("page_id", "comm", "CAST(page_id % 97 AS DOUBLE) AS x", "CAST(page_id % 89 AS DOUBLE) AS y", "CAST(page_id % 83 AS DOUBLE) AS z")


query("edge_length_cv", "SELECT cu AS comm, round(stddev_pop(d) / avg(d), 6) AS length_cv FROM (SELECT cu, sqrt((u % 97 - v % 97) ** 2 + (u % 89 - v % 89) ** 2 + (u % 83 - v % 83) ** 2) AS d FROM w_mu WHERE cu = cv) GROUP BY cu")(lambda w: layout.inner_recall(spread(w), w.und(), w.memb).select("comm", *r6("length_cv")))
query("ball_slots", "SELECT page_id, round(r * ring * cos(phi), 6) AS x, round(r * ring * sin(phi), 6) AS y, round(r * t, 6) AS z FROM (SELECT page_id, cbrt((page_id + 0.5) / 1000000) * 9 AS r, t, sqrt(greatest(0, 1 - t * t)) AS ring, (page_id + 42 * 0.6180339887498949) * 2.399963229728653 AS phi FROM (SELECT page_id, 1 - 2 * (page_id + 0.5) / 1000000 AS t FROM w_page))")(lambda w: w.page.select("page_id", *[F.round(c, 6).alias(n) for c, n in zip(geometry.ball_slots(F.col("page_id").cast("double"), F.lit(1000000.0), 9.0, 42), "xyz", strict=True)]))


def macro_places(w) -> DataFrame:
    own = w.memb.groupBy(F.col("macro").alias("macro_id")).agg(F.count(F.lit(1)).alias("n"))
    links = catalog.macro_pairs(community.pairs(w.und(), w.memb), w.memb.select("comm", F.col("macro").alias("macro_id")).distinct())
    return geometry.place_macros(own, links.select(F.col("macro_a").alias("a"), F.col("macro_b").alias("b"), "w"))


def galaxy_rows(w) -> DataFrame:
    own = w.memb.groupBy("comm", "macro").agg(F.count(F.lit(1)).alias("n"))
    return own.withColumn("display_class", F.when(F.col("comm") % 11 == 0, "medium").when(F.col("comm") == 7, "dust").otherwise("galaxy"))


def galaxy_places(w, mac: DataFrame) -> DataFrame:
    placed = geometry.place_galaxies(galaxy_rows(w), mac, community.pairs(w.und(), w.memb))
    return placed.unionByName(geometry.dust_shell(galaxy_rows(w).where("display_class = 'dust'"), mac)).join(galaxy_rows(w).select("comm", "display_class", "n"), "comm")


query("layout_macros", "SELECT macro AS macro_id, count(*) AS n, round(1000 * sqrt(count(*) / (SELECT count(*) FROM w_memb)), 6) AS radius FROM w_memb GROUP BY macro".replace("macro AS macro_id", "macro::BIGINT AS macro_id"))(lambda w: macro_places(w).select("macro_id", "n", *r6("radius")))
query("layout_macros_apart", "SELECT true AS hardly_overlap, (count(DISTINCT macro))::BIGINT AS n FROM w_memb")(lambda w: layout.overlap_fraction(macro_places(w).select(F.col("macro_id").alias("comm"), "x", "y", "z", "radius")).select((F.col("overlap") <= 0.021).alias("hardly_overlap")).crossJoin(macro_places(w).agg(F.count(F.lit(1)).alias("n"))))


@query("layout_global", "SELECT (comm % 5)::BIGINT AS macro, count(*) AS n, 0::BIGINT AS n_spill, 0::BIGINT AS n_lost FROM (SELECT DISTINCT comm FROM w_memb) GROUP BY 1")
def _(w):
    mac = macro_places(w).persist()
    placed = galaxy_places(w, mac).persist()
    spills = audit.spill_rows(placed, mac).groupBy("macro").agg(F.count(F.lit(1)).alias("n_spill"))
    lost = F.count_if(F.isnan("x") | F.col("x").isNull() | (F.col("radius") <= 0)).alias("n_lost")
    return placed.groupBy("macro").agg(F.count(F.lit(1)).alias("n"), lost).join(spills, "macro", "left").select("macro", "n", F.coalesce("n_spill", F.lit(0).cast("long")).alias("n_spill"), "n_lost")


def article_places(w, mode: str) -> DataFrame:
    unit = solvers.layout_local(w.und(), w.memb).join(layout.degree_sides(w.und(), w.memb), "page_id")
    return geometry.article_forces(unit, layout.sector_anchor(layout.cross_links(w.und(), w.memb), w.pos()), w.pos(), mode)


@query("article_forces", "SELECT m.comm, count(*) AS n, 0::BIGINT AS n_outside FROM w_memb m GROUP BY m.comm")
def _(w):
    placed = article_places(w, "sector").join(w.pos().select("comm", *[F.col(c).alias("g" + c) for c in "xyz"], "radius"), "comm")
    far = F.sqrt((F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2 + (F.col("z") - F.col("gz")) ** 2)
    return placed.groupBy("comm").agg(F.count(F.lit(1)).alias("n"), F.count_if(far > F.col("radius") * 1.0001).alias("n_outside"))


def from_arithmetic(w) -> DataFrame:
    """Articles in the unit ball by plain arithmetic, for a comparison of the force model with SQL."""
    return w.memb.selectExpr("page_id", "comm", "page_id % 10 / 20D AS x", "page_id % 7 / 20D AS y", "page_id % 3 / 20D AS z").join(layout.degree_sides(w.und(), w.memb), "page_id")


PULL = "0.05 * 0.5"
query(
    "article_force_step",
    f"""SELECT page_id, round(gx + sx + {PULL} * (tx - sx) + 0.0012, 1) AS x, round(gy + sy + {PULL} * (0 - sy) + 0.0012, 1) AS y FROM (SELECT m.page_id, p.x AS gx, p.y AS gy, m.page_id % 10 / 20 * p.radius * 0.92 AS sx, m.page_id % 7 / 20 * p.radius * 0.92 AS sy, p.radius * (0.35 + 0.65 * qe) * (CASE WHEN qi > 0.9 AND qe < 0.5 THEN 0.6 ELSE 1 END) AS tx
  FROM (SELECT m.page_id, m.comm, CASE WHEN n > 1 THEN (row_number() OVER (PARTITION BY comm ORDER BY e, page_id) - 1) / (n - 1) ELSE 0 END AS qe, CASE WHEN n > 1 THEN (row_number() OVER (PARTITION BY comm ORDER BY i, page_id) - 1) / (n - 1) ELSE 0 END AS qi FROM (SELECT m.page_id, m.comm, count(*) OVER (PARTITION BY m.comm) AS n, coalesce(d.e, 0) AS e, coalesce(d.i, 0) AS i FROM w_memb m LEFT JOIN (SELECT n AS page_id, count_if(NOT s) AS e, count_if(s) AS i FROM (SELECT unnest([u, v]) AS n, cu = cv AS s FROM w_mu) GROUP BY n) d ON d.page_id = m.page_id) m) m JOIN w_pos p ON p.comm = m.comm)""",
)(lambda w: geometry.article_forces(from_arithmetic(w), w.memb.selectExpr("page_id", "1.0D AS dx", "0.0D AS dy", "0.0D AS dz", "0.5D AS conf"), w.pos(), rounds=1).select("page_id", F.round(F.col("x").cast("double") + 0.0012, 1).alias("x"), F.round(F.col("y").cast("double") + 0.0012, 1).alias("y")))

# What a viewer shows

query("hues", "SELECT comm, round(h - floor(h), 6) AS hue FROM (SELECT comm, (comm % 5 * 0.6180339887 - floor(comm % 5 * 0.6180339887)) + (s - floor(s) - 0.5) * 0.07 + 1 AS h FROM (SELECT DISTINCT comm, sin((comm + 1) * 12.9898) * 43758.5453 AS s FROM w_memb))")(lambda w: w.memb.select("comm").distinct().select("comm", F.round(view.galaxy_hue(F.col("comm"), view.macro_hue(F.col("comm") % 5)), 6).alias("hue")))
STEP = "(t * t * (3 - 2 * t))"
query("levels", f"SELECT page_id, round({STEP}, 6) AS emerge, round(least(1, greatest(0.12, 2200 / greatest(page_id, 1))), 6) AS edges, round(least(1, greatest(0.2, 150 / greatest(page_id, 1))), 6) AS crosses, round(least(1, greatest(0.04, 1.7 / (page_id % 50 + 1))), 6) AS ink, round(3 + (page_id - 3) * 0.1, 6) AS z FROM (SELECT page_id, least(1, greatest(0, (page_id % 100 - 9) / 46)) AS t FROM w_page)")(lambda w: w.page.select("page_id", F.round(view.emerge_alpha(F.col("page_id") % 100), 6).alias("emerge"), F.round(view.edge_exposure(F.col("page_id")), 6).alias("edges"), F.round(view.cross_exposure(F.col("page_id")), 6).alias("crosses"), F.round(view.edge_ink(F.col("page_id") % 50, F.lit(1)), 6).alias("ink"), F.round(view.compress_z(F.col("page_id"), F.lit(3.0), 0.1), 6).alias("z")))
query("galaxy_hubs", "SELECT m.page_id, deg FROM w_memb m JOIN w_deg d ON d.page_id = m.page_id WHERE comm = 4 ORDER BY deg DESC, m.page_id LIMIT 14")(lambda w: view.hubs_of(w.memb, graph.node_degrees(w.und(), w.article), 4))
query("cross_targets", "SELECT DISTINCT o AS page_id, co AS comm FROM (SELECT v AS o, cv AS co, cu AS own FROM w_mu WHERE u = 21 UNION ALL SELECT u, cu, cv FROM w_mu WHERE v = 21) WHERE co <> own ORDER BY 1 LIMIT 12")(lambda w: view.cross_targets(w.und(), w.memb, 21))
query("neighbour_tiles", "SELECT CASE WHEN a = 4 THEN b ELSE a END AS comm, w FROM w_pairs WHERE a = 4 OR b = 4 ORDER BY w DESC, 1 LIMIT 8")(lambda w: view.neighbour_tiles(community.pairs(w.und(), w.memb), 4))
query("stride_sample", "SELECT u, v, cu FROM (SELECT *, row_number() OVER (PARTITION BY cu ORDER BY u, v) - 1 AS nth, greatest(1, count(*) OVER (PARTITION BY cu) // 10) AS st FROM w_mu WHERE cu = cv) WHERE nth % st = 0 AND nth // st < 10")(lambda w: view.stride_sample(community.ends(w.und(), w.memb).where("cu = cv").select("u", "v", "cu"), "cu", ["u", "v"], 10))
CAPPED = "(SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY other) AS r FROM (SELECT u AS page_id, v AS other FROM w_mu WHERE cu <> cv UNION ALL SELECT v, u FROM w_mu WHERE cu <> cv)) WHERE r <= 8)"
TDEG = f"(SELECT m.page_id, m.comm, count(e.n) AS deg FROM w_memb m LEFT JOIN (SELECT unnest([u, v]) AS n FROM w_mu WHERE cu = cv UNION ALL SELECT page_id FROM {CAPPED}) e ON e.n = m.page_id GROUP BY ALL)"


def tile_deg(w) -> DataFrame:
    return view.tile_degrees(w.und(), layout.cross_cap(w.und(), w.memb), w.memb)


query("tile_degrees", f"SELECT page_id, comm, deg FROM {TDEG}")(tile_deg)
query("tile_median_degree", f"SELECT comm, greatest(1, deg) AS median FROM (SELECT comm, deg, row_number() OVER (PARTITION BY comm ORDER BY deg, page_id) - 1 AS r, count(*) OVER (PARTITION BY comm) AS n FROM (SELECT *, row_number() OVER (PARTITION BY comm ORDER BY page_id) - 1 AS nth, greatest(1, count(*) OVER (PARTITION BY comm) // 16) AS st FROM {TDEG}) WHERE nth % st = 0) WHERE r = n // 2")(lambda w: view.median_degree(tile_deg(w), 16))
query("random_choice", "SELECT g.comm AS galaxy_id, (SELECT page_id FROM w_memb WHERE comm = g.comm ORDER BY (page_id * 7919 + 9 * 104729) % 1000003, page_id LIMIT 1) AS page_id FROM (SELECT comm FROM w_memb GROUP BY comm ORDER BY CASE WHEN count(*) < 10 THEN 1 ELSE 0 END, (comm * 7919 + 9 * 104729) % 1000003, comm LIMIT 1) g")(lambda w: view.random_article(w.memb, galaxies(w), 9, 10).select(F.col("comm").alias("galaxy_id"), "page_id"))
query("focus_pick", "SELECT comm, round(radius / greatest(radius, sqrt((x - 5) ** 2 + (y - 5) ** 2 + (z - 9) ** 2)) * radius / greatest(radius, sqrt((x - 4) ** 2 + (y - 4) ** 2 + (z - 1) ** 2)), 6) AS weight FROM w_pos ORDER BY 2 DESC, comm LIMIT 1")(lambda w: view.focus(w.pos(), (5.0, 5.0, 9.0), (4.0, 4.0, 1.0)).select("comm", *r6("weight")))

# Audits

OWNED = "(SELECT comm, comm % 5 AS macro_id, n, CASE WHEN comm % 11 = 0 THEN 'medium' WHEN comm = 7 THEN 'dust' ELSE 'galaxy' END AS display_class, CASE comm % 3 WHEN 0 THEN 'category' WHEN 1 THEN 'rep' ELSE 'none' END AS name_source, CASE comm % 4 WHEN 0 THEN concat('スタブ', comm) WHEN 1 THEN concat(1900 + comm, '年の一覧') WHEN 2 THEN '' ELSE concat('Name ', comm) END AS name FROM (SELECT comm, count(*) AS n FROM w_memb GROUP BY comm))"


def owned(w) -> DataFrame:
    g = w.memb.groupBy(F.col("comm").alias("galaxy_id")).agg(F.count(F.lit(1)).alias("n_articles"))
    return g.selectExpr("galaxy_id", "galaxy_id % 5 AS macro_id", "n_articles", "CASE WHEN galaxy_id % 11 = 0 THEN 'medium' WHEN galaxy_id = 7 THEN 'dust' ELSE 'galaxy' END AS display_class", "CASE galaxy_id % 3 WHEN 0 THEN 'category' WHEN 1 THEN 'rep' ELSE 'none' END AS name_source", "CASE galaxy_id % 4 WHEN 0 THEN concat('スタブ', galaxy_id) WHEN 1 THEN concat(1900 + galaxy_id, '年の一覧') WHEN 2 THEN '' ELSE concat('Name ', galaxy_id) END AS name")


query("names_crosstab", f"SELECT display_class, count_if(name_source = 'category')::BIGINT AS category, 0::BIGINT AS category_stem, count_if(name_source = 'rep')::BIGINT AS rep, count_if(name_source = 'none')::BIGINT AS \"none\" FROM {OWNED} GROUP BY display_class")(lambda w: audit.class_by_source(owned(w)))
query("suspect_names", f"SELECT label, count(*) AS n_galaxies, sum(n)::BIGINT AS n_articles FROM (SELECT n, unnest(CASE comm % 4 WHEN 0 THEN ['stub'] WHEN 1 THEN ['list', 'year'] ELSE [] END) AS label FROM {OWNED}) GROUP BY label")(lambda w: audit.suspect_names(owned(w)))
query("label_template", f"SELECT m.macro AS macro_id, m.n AS n_articles, left(concat('Representative_', m.macro), 16) AS default_label, t.top FROM (SELECT macro, count(*) AS n FROM w_memb GROUP BY macro) m LEFT JOIN (SELECT macro_id, string_agg(name, ',' ORDER BY r) AS top FROM (SELECT macro_id, name, row_number() OVER (PARTITION BY macro_id ORDER BY n DESC, comm) AS r FROM {OWNED} WHERE display_class <> 'dust' AND name <> '') WHERE r <= 5 GROUP BY macro_id) t ON t.macro_id = m.macro")(lambda w: audit.label_template(owned(w), w.memb.groupBy(F.col("macro").alias("macro_id")).agg(F.count(F.lit(1)).alias("n_articles")).withColumn("rep_titles", F.array(F.concat(F.lit("Representative_"), "macro_id")))).select("macro_id", "n_articles", "default_label", F.array_join("top", ",").alias("top")))


def own_tiles(w) -> DataFrame:
    return solvers.tiles(spread(w).withColumns({c: F.col(c) / 1000 for c in "xyz"}), w.und(), w.memb, w.article)


TILE = f"(SELECT m.comm, m.n, coalesce(e.n, 0) AS ne, coalesce(x.n, 0) AS nx FROM (SELECT comm, count(*) AS n FROM w_memb GROUP BY comm) m LEFT JOIN (SELECT cu AS comm, count(*) AS n FROM w_mu WHERE cu = cv GROUP BY cu) e ON e.comm = m.comm LEFT JOIN (SELECT m.comm, count(*) AS n FROM {CAPPED} c JOIN w_memb m ON m.page_id = c.page_id GROUP BY m.comm) x ON x.comm = m.comm)"
query("tile_roundtrip", f"SELECT comm, n, ne AS n_edges, nx AS n_cross, 12 + 12 * n + 8 * ne + 12 * nx AS bytes, false AS bad_size, 0::BIGINT AS bad_index, n AS n_titles, 0::BIGINT AS n_empty, 0::BIGINT AS n_local, true AS in_ball FROM {TILE}")(lambda w: solvers.read_tiles(own_tiles(w)))
query("tile_audit", f"SELECT 0::BIGINT AS missing, 0::BIGINT AS bad_size, 0::BIGINT AS bad_header, 0::BIGINT AS bad_index, 0::BIGINT AS titles_short, 0::BIGINT AS titles_empty, 0::BIGINT AS titles_local, sum(n)::BIGINT AS articles, sum(ne)::BIGINT AS inner_edges, sum(nx)::BIGINT AS cross_edges, sum(12 + 12 * n + 8 * ne + 12 * nx)::BIGINT AS bytes FROM {TILE}")(lambda w: audit.tile_counts(solvers.read_tiles(own_tiles(w)), w.memb.groupBy("comm").agg(F.count(F.lit(1)).alias("n"))))


query("tile_rows", f"SELECT m.comm, l.local_idx, a.title, round((m.page_id % 97) / 1000, 4) AS x, d.deg FROM w_memb m JOIN w_article a ON a.page_id = m.page_id JOIN {TDEG} d ON d.page_id = m.page_id JOIN (SELECT page_id, row_number() OVER (PARTITION BY comm ORDER BY page_id) - 1 AS local_idx FROM w_memb) l ON l.page_id = m.page_id")(lambda w: solvers.tile_rows(own_tiles(w)).select("comm", "local_idx", "title", F.round(F.col("x").cast("double"), 4).alias("x"), "deg"))


def shaped(w) -> DataFrame:
    return w.pos().withColumn("display_class", F.when(F.col("comm") % 11 == 0, "medium").when(F.col("comm") == 7, "dust").otherwise("galaxy"))


CLASSED = "(SELECT *, CASE WHEN comm % 11 = 0 THEN 'medium' WHEN comm = 7 THEN 'dust' ELSE 'galaxy' END AS cls FROM w_pos)"
query("layout_spills", f"SELECT comm, macro, round((d + radius) / 12, 6) AS ratio, round(d + radius - 12, 6) AS excess FROM (SELECT *, sqrt((x - 9) ** 2 + (y - 9) ** 2 + (z - 3) ** 2) AS d FROM {CLASSED} WHERE cls <> 'dust') WHERE (d + radius) / 12 > 1.02")(lambda w: audit.spill_rows(shaped(w), w.pos().selectExpr("macro AS macro_id", "9.0D AS x", "9.0D AS y", "3.0D AS z", "12.0D AS radius").distinct()).select("comm", "macro", *r6("ratio", "excess")))
LINKED = f"(SELECT DISTINCT unnest([a, b]) AS comm FROM w_pairs p JOIN {CLASSED} q ON q.comm = p.a JOIN {CLASSED} r ON r.comm = p.b WHERE q.cls = 'galaxy' AND r.cls = 'galaxy' AND q.macro = r.macro)"
query("layout_shapes", f"SELECT macro, count(*) AS n, count_if(cls = 'medium')::BIGINT AS n_medium, count_if(cls = 'galaxy' AND l.comm IS NULL)::BIGINT AS n_unlinked, round((count_if(cls = 'medium') + count_if(cls = 'galaxy' AND l.comm IS NULL)) / count(*), 6) AS bary_share FROM {CLASSED} c LEFT JOIN {LINKED} l ON l.comm = c.comm WHERE cls <> 'dust' GROUP BY macro")(lambda w: audit.macro_shapes(shaped(w), community.pairs(w.und(), w.memb)).select("macro", "n", "n_medium", "n_unlinked", *r6("bary_share")))
query("telemetry", "SELECT count(*) AS n, round(quantile_cont(s, 0.5), 4) AS p50, round(quantile_cont(s, 0.95), 4) AS p95, round(max(s), 4) AS max, round(avg(s), 4) AS mean FROM (SELECT page_id % 113 / 7 AS s FROM w_page)")(lambda w: audit.telemetry(w.page.select((F.col("page_id") % 113 / 7).alias("seconds"))))
query("layout_audit")(lambda w: audit.layout_summary(shaped(w), w.pos().selectExpr("macro AS macro_id", "9.0D AS x", "9.0D AS y", "3.0D AS z", "12.0D AS radius").distinct(), community.pairs(w.und(), w.memb), 4))

# Invariants of the solvers: a partition of all articles into connected communities that beats the plain one


def invariants(w, memb: DataFrame, most: int | None = None) -> DataFrame:
    """(n, n_rows, n_split, too_large): articles, rows, communities that are not connected, and those above a size that could be cut."""
    m = memb.select("page_id", "comm").persist()
    inner = community.ends(w.und(), m).where("cu = cv").select("u", "v")
    parts = solvers._connected(inner, m.select(F.col("page_id").alias("x"), F.lit(0).alias("c"))).withColumnRenamed("x", "page_id").join(m, "page_id")
    split = parts.groupBy("comm").agg(F.countDistinct("c").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_split"))
    size = m.agg(F.countDistinct("page_id").alias("n"), F.count(F.lit(1)).alias("n_rows"))
    large = m.groupBy("comm").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > (most or 1 << 60)).alias("too_large"))
    return size.crossJoin(split).crossJoin(large)


WHOLE = "SELECT count(*) AS n, count(*) AS n_rows, 0::BIGINT AS n_split, 0::BIGINT AS too_large FROM w_article"
query("detect_invariants", WHOLE)(lambda w: invariants(w, solvers.detect(w.und(), w.article)))
query("detect_cpm_invariants", WHOLE)(lambda w: invariants(w, solvers.detect(w.und(), w.article, 0.02, "cpm")))
query("detect_weighted_invariants", WHOLE)(lambda w: invariants(w, solvers.detect(graph.hub_weights(w.und(), graph.node_degrees(w.und(), w.article)), w.article)))
query("detect_modularity", "SELECT true AS above_brands FROM w_article LIMIT 1")(lambda w: community.modularity(community.per_community(w.und(), solvers.detect(w.und(), w.article))).select(F.col("modularity").alias("found")).crossJoin(community.modularity(per(w))).select((F.col("found") > F.col("modularity") + 0.05).alias("above_brands")))


def subdivided(w) -> DataFrame:
    return solvers.subdivide(w.und(), solvers.detect(w.und(), w.article), max_size=60).select("page_id", F.struct("comm", "part").alias("comm"))


query("subdivide_invariants", "SELECT count(*) AS n, count(*) AS n_rows, 0::BIGINT AS n_split FROM w_article")(lambda w: invariants(w, subdivided(w)).drop("too_large"))
query("l2_invariants", "SELECT count(DISTINCT comm) AS n, true AS fewer FROM w_memb")(lambda w: solvers.cluster(community.pairs(w.und(), w.memb)).agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("cluster") < F.count(F.lit(1))).alias("fewer")))
query("lpt_invariants", "SELECT count(*) AS n, true AS balanced FROM (SELECT DISTINCT comm FROM w_memb)")(lambda w: layout.lpt_bins(w.memb.groupBy("comm").agg(F.count(F.lit(1)).alias("n")), 4).join(w.memb.groupBy("comm").agg(F.count(F.lit(1)).alias("n")), "comm").groupBy("bin").agg(F.count(F.lit(1)).alias("k"), F.sum(F.pow("n", F.lit(1.93))).alias("cost"), F.max(F.pow("n", F.lit(1.93))).alias("item")).agg(F.sum("k").alias("n"), (F.max("cost") - F.min("cost") <= F.max("item")).alias("balanced")))
query("layout_local_invariants", "SELECT comm, n_c AS n, 0::BIGINT AS n_outside FROM w_comm")(lambda w: solvers.layout_local(w.und(), w.memb).groupBy("comm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) > 1.0001).alias("n_outside")))
