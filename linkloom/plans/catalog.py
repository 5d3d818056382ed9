"""All queries over the reference operators, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import titles
from linkloom.operators import catalog as cat
from linkloom.operators import category, community, graph, layout, resolve
from linkloom.sources import dumps

from . import solvers
from .wiki import Wiki, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, raw: bool = False):
    """Registers a function of a Wiki; sql is its oracle, over the views of the virtual wiki unless raw."""

    def register(f: Callable[[Wiki], DataFrame]) -> Callable[[Wiki], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Wiki(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql if raw else oracle(sql)
        return f

    return register


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# Parsing and text

@query("sqldump_parse_tuples", "SELECT page_id, ns::INT AS ns, concat(title, '''', chr(92), chr(10), 'x') AS title, is_redirect FROM w_page")
def _(w):
    escaped = F.concat("title", F.lit("\\'\\\\\\nx"))
    tup = F.concat(F.lit("("), "page_id", F.lit(","), "ns", F.lit(",'"), escaped, F.lit("',"), F.col("is_redirect").cast("int"), F.lit(",0,0.5,'20260101',NULL,1,1,'wikitext',NULL)"))
    lines = w.page.groupBy(F.floor(F.col("page_id") / 50)).agg(F.concat_ws(",", F.collect_list(tup)).alias("v")).select(F.concat(F.lit("INSERT INTO `page` VALUES "), "v", F.lit(";")).alias("value"))
    return dumps.parse_tuples(lines, "page")


@query("pagelinks_parse", "SELECT pl_from, pl_from_ns::INT AS pl_from_ns, lt_id, count(*) AS n FROM w_pagelinks GROUP BY ALL")
def _(w):
    lines = w.pagelinks.select(F.concat(F.lit("INSERT INTO `pagelinks` VALUES ("), "pl_from", F.lit(","), "pl_from_ns", F.lit(","), "lt_id", F.lit(");")).alias("value"))
    return dumps.parse_tuples(lines, "pagelinks").groupBy("pl_from", "pl_from_ns", "lt_id").agg(F.count(F.lit(1)).alias("n"))


RAW_TITLE = "CASE page_id % 6 WHEN 0 THEN concat('  page  ', page_id, '#a') WHEN 1 THEN concat(':Category:X ', page_id) WHEN 2 THEN concat('_a__b ', page_id, '_') WHEN 3 THEN '#only' WHEN 4 THEN title ELSE concat('é ', page_id) END"
NORMAL = "regexp_replace(replace(regexp_replace(trim(split_part(raw, '#', 1)), '^:+', ''), ' ', '_'), '_+', '_', 'g')"


@query("title_normalize", f"SELECT page_id, nullif(CASE WHEN regexp_matches(t, '^[a-z]') THEN concat(upper(t[1]), t[2:]) ELSE t END, '') AS normal FROM (SELECT page_id, trim({NORMAL}, '_') AS t FROM (SELECT page_id, {RAW_TITLE} AS raw FROM w_page))")
def _(w):
    return w.page.select("page_id", titles.normalize_title(F.expr(RAW_TITLE)).alias("normal"))


WIKITEXT = "concat('See [[Page_', page_id + 1, '|one]] <!-- [[No_1]] --> <nowiki>[[No_2]]</nowiki> and [[Page_', page_id * 2, '#x]]<ref>[[Ref_', page_id, ']]</ref><includeonly>[[No_3]]</includeonly>')"


@query("wikitext_clean_links", f"SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(t, '(?s)<nowiki\\b[^>]*>.*?</nowiki>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<includeonly\\b[^>]*>.*?</includeonly>', '', 'g'), '\\[\\[([^\\[\\]|]+)(?:\\|[^\\[\\]]*)?\\]\\]', 1)) AS target FROM (SELECT page_id, {WIKITEXT} AS t FROM w_page)")
def _(w):
    return w.page.select("page_id", F.explode(titles.wikilinks(titles.clean_wikitext(F.expr(WIKITEXT)))).alias("target"))


PREFIXED = "concat(CASE page_id % 5 WHEN 0 THEN 'File:' WHEN 1 THEN 'en:' WHEN 2 THEN 'cATEGORY talk:' WHEN 3 THEN 'Novel:' ELSE '' END, title)"


@query("prefix_skip", "SELECT page_id, page_id % 5 IN (0, 1, 2) AS skipped FROM w_page")
def _(w):
    return w.page.select("page_id", titles.has_skipped_prefix(F.expr(PREFIXED)).alias("skipped"))


YEARLY = "CASE page_id % 7 WHEN 0 THEN concat(page_id, '年') WHEN 1 THEN concat('日本の', title) WHEN 2 THEN concat(title, '一覧') WHEN 3 THEN concat(title, '_(曖昧さ回避)') WHEN 4 THEN '12月3日' WHEN 5 THEN concat('Category:', title) ELSE title END"


@query("hub_flags", f"""SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(t, '\\(曖昧さ回避\\)|曖昧さ回避$') THEN 'disambig' END, CASE WHEN regexp_matches(t, '一覧$|一覧_|^リスト|の一覧') THEN 'list' END,
  CASE WHEN regexp_matches(t, '^\\p{{Nd}}{{1,4}}年$|^\\p{{Nd}}{{1,4}}年の|^\\p{{Nd}}{{4}}年度') THEN 'year' END, CASE WHEN regexp_matches(t, '^\\p{{Nd}}{{1,2}}月\\p{{Nd}}{{1,2}}日$') THEN 'date' END,
  CASE WHEN regexp_matches(t, '^日本の|^日本における') THEN 'jp_geo' END, CASE WHEN regexp_matches(t, '^索引|^Wikipedia:|^Category:') THEN 'index' END) AS flags FROM (SELECT page_id, {YEARLY} AS t FROM w_page)""")
def _(w):
    return w.page.select("page_id", F.array_join(titles.hub_flags(F.expr(YEARLY)), ",").alias("flags"))


STEMMED = "CASE page_id % 5 WHEN 0 THEN concat('題', page_id, '関連のスタブ項目') WHEN 1 THEN concat('題', page_id, 'に関する記事') WHEN 2 THEN concat('題', page_id, 'の一覧') WHEN 3 THEN 'すべてのスタブ記事' ELSE title END"


@query("name_stem", "SELECT page_id, CASE WHEN page_id % 5 < 3 THEN concat('題', page_id) ELSE '' END AS stem FROM w_page")
def _(w):
    return w.page.select("page_id", titles.name_stem(F.expr(STEMMED)).alias("stem"))


@query("html_link_extract", "SELECT page_id, count(*) AS n, count(DISTINCT h) AS n_distinct FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages) GROUP BY page_id", raw=True)
def _(w):
    return w.spark.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("n_distinct"))


# Joins and resolution

query("redirect_chain", "SELECT rd_from, rd_final FROM w_rdmap")(lambda w: w.rdmap())
query("edge_resolution_counters", "SELECT reason, count(*) AS n FROM w_resolved GROUP BY reason")(lambda w: w.resolved().groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
query("edges_resolved", "SELECT src, dst, count(*) AS n FROM w_edge GROUP BY ALL")(lambda w: w.edges().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


@query("body_edges_distinct", "SELECT DISTINCT src, dst FROM (SELECT s.src, CASE WHEN rd.rd_from IS NOT NULL THEN rd.rd_final ELSE p.page_id END AS dst FROM (SELECT page_id AS src, concat('Page_', unnest([page_id * 3 % 2000, page_id + 6, page_id])) AS title FROM w_article) s JOIN w_page p ON p.title = s.title AND p.ns = 0 LEFT JOIN w_rdmap rd ON rd.rd_from = p.page_id) WHERE dst IS NOT NULL AND src <> dst")
def _(w):
    links = w.article.select(F.col("page_id").alias("src"), F.explode(F.expr("array(page_id * 3 % 2000, page_id + 6, page_id)")).alias("t")).select("src", F.concat(F.lit("Page_"), "t").alias("title"))
    return resolve.body_edges(links, w.page, w.rdmap())


@query("src_semi_anti", "SELECT (SELECT count(*) FROM w_pagelinks SEMI JOIN w_article ON pl_from = page_id) AS from_articles, (SELECT count(*) FROM w_pagelinks ANTI JOIN w_redirect ON pl_from = rd_from) AS not_from_redirects")
def _(w):
    a = w.pagelinks.join(w.article.select(F.col("page_id").alias("pl_from")), "pl_from", "left_semi").agg(F.count(F.lit(1)).alias("from_articles"))
    b = w.pagelinks.join(w.redirect.select(F.col("rd_from").alias("pl_from")), "pl_from", "left_anti").agg(F.count(F.lit(1)).alias("not_from_redirects"))
    return a.crossJoin(b)


@query("subset_classify", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN s AND d THEN 'internal' WHEN s THEN 'out' WHEN d THEN 'in' ELSE 'outside' END AS kind FROM (SELECT src % 3 = 0 AS s, dst % 3 = 0 AS d FROM w_edge)) GROUP BY kind")
def _(w):
    return graph.classify_subset(w.edges(), w.article.where("page_id % 3 = 0")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Graph figures

query("undirected_dedup", "SELECT u, v FROM w_und")(lambda w: w.und())
query("degrees", "SELECT a.page_id, coalesce(o.n, 0) AS out_deg, coalesce(i.n, 0) AS in_deg, coalesce(o.n, 0) + coalesce(i.n, 0) AS deg FROM w_article a LEFT JOIN (SELECT src, count(*) AS n FROM w_edge GROUP BY src) o ON o.src = a.page_id LEFT JOIN (SELECT dst, count(*) AS n FROM w_edge GROUP BY dst) i ON i.dst = a.page_id")(lambda w: graph.degrees(w.edges(), w.article))
DIRECTED = "(SELECT a.page_id, coalesce(o.n, 0) AS od, coalesce(o.n, 0) + coalesce(i.n, 0) AS deg FROM w_article a LEFT JOIN (SELECT src, count(*) AS n FROM w_edge GROUP BY src) o ON o.src = a.page_id LEFT JOIN (SELECT dst, count(*) AS n FROM w_edge GROUP BY dst) i ON i.dst = a.page_id)"
query("full_stats", f"""SELECT count(*) AS n_articles, sum(od)::BIGINT AS n_edges, round(sum(od) / count(*), 6) AS avg_out_degree, max(deg) AS max_degree, count_if(deg = 0)::BIGINT AS n_isolated,
  round(quantile_cont(deg, 0.5), 6) AS p50, round(quantile_cont(deg, 0.75), 6) AS p75, round(quantile_cont(deg, 0.9), 6) AS p90, round(quantile_cont(deg, 0.95), 6) AS p95, round(quantile_cont(deg, 0.99), 6) AS p99, round(quantile_cont(deg, 0.999), 6) AS p99_9,
  round(sum(deg) FILTER (WHERE r <= greatest(1, n // 1000)) / sum(deg), 6) AS share_top_0_1pct, round(sum(deg) FILTER (WHERE r <= greatest(1, n // 100)) / sum(deg), 6) AS share_top_1pct
  FROM (SELECT *, row_number() OVER (ORDER BY deg DESC) AS r, count(*) OVER () AS n FROM {DIRECTED})""")(lambda w: graph.full_stats(graph.degrees(w.edges(), w.article)))
query("top_hubs", f"SELECT d.page_id, deg, title FROM {DIRECTED} d JOIN w_article a ON a.page_id = d.page_id ORDER BY deg DESC, d.page_id LIMIT 60")(lambda w: graph.top_hubs(graph.degrees(w.edges(), w.article), w.article).select("page_id", "deg", "title"))
query("top1pct_incidence", "SELECT count(*) AS n_edges, count_if(u IN (SELECT page_id FROM t) OR v IN (SELECT page_id FROM t))::BIGINT AS n_touching FROM w_und".replace("(SELECT page_id FROM t)", "(SELECT page_id FROM w_deg ORDER BY deg DESC, page_id LIMIT (SELECT greatest(1, count(*) // 100) FROM w_article))"))(lambda w: graph.top_incidence(w.und(), graph.node_degrees(w.und(), w.article)))

# Communities

PER = "SELECT comm, n_c, e_in, e_out, boundary, round(e_out / nullif(e_in + e_out, 0), 6) AS out_ratio, round(e_out / nullif(2 * e_in + e_out, 0), 6) AS conductance, round(2 * e_in / n_c, 6) AS avg_degree, round(boundary / n_c, 6) AS boundary_ratio FROM w_comm"


def per(w) -> DataFrame:
    return community.per_community(w.und(), w.memb)


query("comm_metrics", PER)(lambda w: per(w).select("comm", "n_c", "e_in", "e_out", "boundary", *r6("out_ratio", "conductance", "avg_degree", "boundary_ratio")))
query("boundary_nodes", "SELECT comm, boundary FROM w_comm")(lambda w: per(w).select("comm", "boundary"))
query("comm_pairs", "SELECT a, b, w FROM w_pairs")(lambda w: community.pairs(w.und(), w.memb))
query("weighted_median", "SELECT round(min(v), 6) AS weighted_median FROM (SELECT v, sum(n_c) OVER (ORDER BY v) AS cum, sum(n_c) OVER () AS t FROM (SELECT e_out / nullif(e_in + e_out, 0) AS v, n_c FROM w_comm) WHERE v IS NOT NULL) WHERE cum >= t / 2")(lambda w: community.weighted_median(per(w), "out_ratio", "n_c").select(*r6("weighted_median")))
query("weighted_percentiles", " UNION ALL ".join(f"SELECT {s} AS share, round(min(v), 6) AS value FROM (SELECT v, sum(n_c) OVER (ORDER BY v) AS cum, sum(n_c) OVER () AS t FROM (SELECT conductance AS v, n_c FROM (SELECT e_out / nullif(2 * e_in + e_out, 0) AS conductance, n_c FROM w_comm)) WHERE v IS NOT NULL) WHERE cum >= t * {s}" for s in ("0.25::DOUBLE", "0.75::DOUBLE")))(lambda w: community.weighted_percentiles(per(w), "conductance", "n_c", (0.25, 0.75)).select("share", *r6("value")))
query("rep_titles", "SELECT comm, string_agg(title, ',' ORDER BY r) AS reps FROM (SELECT m.comm, a.title, row_number() OVER (PARTITION BY m.comm ORDER BY d.deg DESC, m.page_id) AS r FROM w_memb m JOIN w_deg d ON d.page_id = m.page_id JOIN w_article a ON a.page_id = m.page_id) WHERE r <= 3 GROUP BY comm")(lambda w: community.rep_titles(graph.node_degrees(w.und(), w.article), w.memb, w.article).select("comm", F.array_join("rep_titles", ",").alias("reps")))
query("top_pairs", "SELECT a, b, w FROM w_pairs ORDER BY w DESC, a, b LIMIT 50")(lambda w: cat.top_pairs(community.pairs(w.und(), w.memb), 50))
query("modularity", "SELECT round(sum(e_in / m - ((2 * e_in + e_out) / (2 * m)) ** 2), 6) AS modularity FROM w_comm, (SELECT sum(e_in) + sum(e_out) / 2 AS m FROM w_comm)")(lambda w: community.modularity(per(w)))
query("l2_aggregates", """SELECT k AS cluster, n2, e_in2, e_between2, e_out2, round(e_out2 / (e_in2 + e_between2 + e_out2), 6) AS out_ratio2 FROM (SELECT k, n2, e_in2,
  coalesce((SELECT sum(w) FROM w_pairs WHERE a % 5 = k AND b % 5 = k), 0)::BIGINT AS e_between2, coalesce((SELECT sum(w) FROM w_pairs WHERE a % 5 <> b % 5 AND (a % 5 = k OR b % 5 = k)), 0)::BIGINT AS e_out2 FROM (SELECT (comm % 5)::INT AS k, sum(n_c)::BIGINT AS n2, sum(e_in)::BIGINT AS e_in2 FROM w_comm GROUP BY 1))""")(lambda w: community.clusters(per(w), community.pairs(w.und(), w.memb), w.memb.selectExpr("comm", "CAST(comm % 5 AS INT) AS cluster").distinct()).select("cluster", "n2", "e_in2", "e_between2", "e_out2", *r6("out_ratio2")))

# Categories

AC = "(SELECT page_id, cat_lt AS cat_id FROM w_artcat WHERE cl_type = 'page')"


def artcat(w) -> DataFrame:
    return w.artcat.where("cl_type = 'page'").select("page_id", F.col("cat_lt").alias("cat_id"))


query("cat_frequency", f"SELECT cat_id, count(*) AS freq FROM {AC} GROUP BY cat_id")(lambda w: category.frequency(artcat(w)))
CNT = f"(SELECT m.comm, c.cat_id, count(*) AS cnt FROM {AC} c JOIN w_memb m ON m.page_id = c.page_id GROUP BY ALL)"
query("category_entropy", f"SELECT comm, count(*) AS n_cats, arg_max(cat_id, cnt * 1000000 - cat_id) AS top_cat, max(cnt) AS top_cnt, round(CASE WHEN count(*) > 1 THEN -sum(cnt / t * ln(cnt / t)) / ln(count(*)) ELSE 0 END, 6) AS entropy_norm FROM (SELECT *, sum(cnt) OVER (PARTITION BY comm) AS t FROM {CNT}) GROUP BY comm")(lambda w: category.entropy(category.counts(artcat(w), w.memb)).select("comm", "n_cats", "top_cat", "top_cnt", *r6("entropy_norm")))
NAMES = f"""(SELECT comm, title AS name, cnt, m, cnt / m AS share FROM (SELECT s.*, c.title, row_number() OVER (PARTITION BY s.comm ORDER BY round(cnt * ln(greatest(1, n) / greatest(1, freq)), 9) DESC, s.cat_id) AS r, k.m
  FROM {CNT} s JOIN (SELECT cat_id, count(*) AS freq FROM {AC} GROUP BY cat_id) f ON f.cat_id = s.cat_id JOIN w_category c ON c.lt_id = s.cat_id JOIN (SELECT m.comm, count(DISTINCT c.page_id) AS m FROM {AC} c JOIN w_memb m ON m.page_id = c.page_id GROUP BY m.comm) k ON k.comm = s.comm, (SELECT count(*) AS n FROM w_memb)) WHERE r = 1)"""


def named(w) -> DataFrame:
    return category.names(artcat(w), w.memb, w.category.select(F.col("lt_id").alias("cat_id"), "title"))


query("tfidf_names", f"SELECT comm, name, round(share, 6) AS share FROM {NAMES}")(lambda w: named(w).select("comm", "name", *r6("share")))
query("nameable_share", f"SELECT round(sum(CASE WHEN ok THEN n_c ELSE 0 END) / sum(n_c), 6) AS node_share, round(count_if(ok) / count(*), 6) AS comm_share FROM (SELECT c.n_c, c.n_c >= 2 AND coalesce(x.share, 0) >= 0.02 AS ok FROM w_comm c LEFT JOIN {NAMES} x ON x.comm = c.comm)")(lambda w: category.nameable(named(w), w.memb, 0.02))

# Catalog

query("containment_check", "SELECT comm, CASE WHEN count(DISTINCT s) > 1 THEN -1 ELSE arg_min(s, page_id) END::INT AS macro_id, count(DISTINCT s) AS n_macros FROM (SELECT m.page_id, comm, p.size % 5 AS s FROM w_memb m JOIN w_page p ON p.page_id = m.page_id) GROUP BY comm")(lambda w: cat.containment(w.memb.select("page_id", "comm").join(w.page.selectExpr("page_id", "CAST(size % 5 AS INT) AS macro"), "page_id")))
query("top_neighbors", "SELECT g, max(n) AS n_neighbors, string_agg(o || ':' || w, ',' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w DESC, o) AS r, count(*) OVER (PARTITION BY g) AS n FROM (SELECT a AS g, b AS o, w FROM w_pairs UNION ALL SELECT b, a, w FROM w_pairs)) WHERE r <= 8 GROUP BY g")(lambda w: cat.top_neighbors(community.pairs(w.und(), w.memb)).select("g", "n_neighbors", F.array_join(F.transform("top", lambda x: F.concat_ws(":", x["id"], x["w"])), ",").alias("top")))


def galaxies(w) -> DataFrame:
    return w.memb.groupBy(F.col("comm").alias("galaxy_id"), F.col("macro").alias("macro_id")).agg(F.count(F.lit(1)).alias("n_articles"))


query("top_galaxies", "SELECT macro_id, r::INT AS r, galaxy_id FROM (SELECT *, row_number() OVER (PARTITION BY macro_id ORDER BY n_articles DESC, galaxy_id) AS r FROM (SELECT comm AS galaxy_id, macro AS macro_id, count(*) AS n_articles FROM w_memb GROUP BY ALL) WHERE n_articles > 1) WHERE r <= 5")(lambda w: cat.top_galaxies(galaxies(w)))
query("macro_pairs", "SELECT least(a % 5, b % 5)::INT AS macro_a, greatest(a % 5, b % 5)::INT AS macro_b, sum(w)::BIGINT AS w FROM w_pairs WHERE a % 5 <> b % 5 GROUP BY 1, 2")(lambda w: cat.macro_pairs(community.pairs(w.und(), w.memb), w.memb.select("comm", F.col("macro").alias("macro_id")).distinct()))
REPS = "CASE page_id % 4 WHEN 0 THEN '1999年' WHEN 1 THEN '日本' ELSE title END"
query("display_class", f"SELECT page_id, CASE WHEN page_id % 9 <= 1 THEN 'dust' WHEN page_id % 4 <= 1 OR page_id % 3 = 0 THEN 'medium' ELSE 'galaxy' END AS display_class FROM w_page")(lambda w: w.page.select("page_id", titles.display_class(F.col("page_id") % 9, F.expr(f"array({REPS}, CASE WHEN page_id % 3 = 0 THEN 'ISBN' ELSE 'x' END, CASE WHEN page_id % 3 = 0 THEN 'ISSN' ELSE 'y' END)"), F.lit(0.5)).alias("display_class")))
query("label_override", "SELECT comm AS galaxy_id, CASE WHEN comm % 2 = 0 THEN concat('Label ', comm) ELSE left(concat('Representative_', comm), 16) END AS label FROM (SELECT DISTINCT comm FROM w_memb)")(lambda w: cat.labels(w.memb.select(F.col("comm").alias("galaxy_id")).distinct().withColumn("rep_titles", F.array(F.concat(F.lit("Representative_"), "galaxy_id"))), w.memb.select(F.col("comm").alias("galaxy_id")).distinct().select("galaxy_id", F.when(F.col("galaxy_id") % 2 == 0, F.concat(F.lit("Label "), "galaxy_id")).otherwise("  ").alias("label"))))


query("galaxy_search", "SELECT page_id AS id, title AS name FROM w_page WHERE contains(lower(title), 'e_11') ORDER BY CASE WHEN starts_with(lower(title), 'e_11') THEN 0 ELSE 1 END, page_id LIMIT 12")(lambda w: cat.search(w.page.select(F.col("page_id").alias("id"), F.col("title").alias("name")), "e_11"))

# Pruning and subsets

PRIO = "(u * 7919 + v * 104729) % 1000003"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY u ORDER BY {PRIO}, u, v) AS ru, row_number() OVER (PARTITION BY v ORDER BY {PRIO}, u, v) AS rv, count(*) OVER (PARTITION BY u) AS du, count(*) OVER (PARTITION BY v) AS dv FROM w_und)"
query("degree_budget_both", f"SELECT u, v FROM {RANKED} WHERE ru <= 4 AND rv <= 4")(lambda w: graph.degree_budget(w.und(), 4, "both"))
query("degree_budget_smart", f"SELECT u, v FROM {RANKED} WHERE ru <= 4 OR du <= 4 OR rv <= 4 OR dv <= 4")(lambda w: graph.degree_budget(w.und(), 4, "smart"))
query("hub_weights", "SELECT u, v, round(1 / (ln(2 + a.deg) * ln(2 + b.deg)), 6) AS w FROM w_und JOIN w_deg a ON a.page_id = u JOIN w_deg b ON b.page_id = v")(lambda w: graph.hub_weights(w.und(), graph.node_degrees(w.und(), w.article)).select("u", "v", *r6("w")))
query("id_window", "SELECT page_id, title FROM w_article ORDER BY page_id DESC LIMIT 100")(lambda w: graph.id_window(w.article, 100))
query("bfs_khop", "SELECT page_id, min(hop)::INT AS hop FROM (WITH RECURSIVE b AS (SELECT page_id, 0 AS hop FROM w_article WHERE page_id IN (1, 2, 3) UNION SELECT e.dst, b.hop + 1 FROM b JOIN (SELECT DISTINCT src, dst FROM w_edge) e ON e.src = b.page_id WHERE b.hop < 3) SELECT * FROM b) GROUP BY page_id")(lambda w: graph.bfs(w.edges().distinct(), w.article.where("page_id IN (1, 2, 3)"), 3))
query("body_vs_pagelinks", "SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.n, 0) AS bd, coalesce(b.n, 0) AS pl, round(coalesce(b.n, 0) / nullif(coalesce(a.n, 0), 0), 6) AS inflation FROM (SELECT src AS page_id, count(*) AS n FROM w_edge WHERE dst % 2 = 0 GROUP BY src) a FULL JOIN (SELECT src AS page_id, count(*) AS n FROM w_edge GROUP BY src) b ON a.page_id = b.page_id")(lambda w: graph.body_vs_links(w.edges().where("dst % 2 = 0").groupBy(F.col("src").alias("page_id")).agg(F.count(F.lit(1)).alias("out_deg")), w.edges().groupBy(F.col("src").alias("page_id")).agg(F.count(F.lit(1)).alias("out_deg"))).select("page_id", "bd", "pl", *r6("inflation")))
query("ego_network", "SELECT u, v FROM w_und WHERE u = 21 OR v = 21 ORDER BY u, v LIMIT 64")(lambda w: graph.ego(w.und(), 21))

# Layout

CROSS = "(SELECT page_id, own, g, count(*) AS w FROM (SELECT u AS page_id, cu AS own, cv AS g FROM w_mu WHERE cu <> cv UNION ALL SELECT v, cv, cu FROM w_mu WHERE cu <> cv) GROUP BY ALL)"
DIRS = f"(SELECT c.*, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz, greatest(sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2), 1e-9) AS norm, row_number() OVER (PARTITION BY c.page_id ORDER BY c.w DESC, c.g) AS r FROM {CROSS} c JOIN w_pos p ON p.comm = c.own JOIN w_pos q ON q.comm = c.g)"
query("local_prep_cross", f"SELECT page_id, g, w FROM {CROSS}")(lambda w: layout.cross_links(w.und(), w.memb).select("page_id", "g", "w"))
query("anchor_sum", f"SELECT page_id, sum(w)::BIGINT AS ext_deg, round(sum(w * dx / norm), 6) AS ax, round(sum(w * dy / norm), 6) AS ay, round(sum(w * dz / norm), 6) AS az FROM {DIRS} GROUP BY page_id")(lambda w: layout.anchor_sum(layout.cross_links(w.und(), w.memb), w.pos()).select("page_id", "ext_deg", *r6("ax", "ay", "az")))
query("sector_anchor", f"""SELECT page_id, round((w1 + CASE WHEN two THEN w2 ELSE 0 END) / ext, 6) AS conf, round(bx / greatest(sqrt(bx ** 2 + byy ** 2 + bz ** 2), 1e-9), 6) AS dx FROM (SELECT *, CASE WHEN two THEN w1 * x1 + w2 * x2 ELSE x1 END AS bx, CASE WHEN two THEN w1 * y1 + w2 * y2 ELSE y1 END AS byy, CASE WHEN two THEN w1 * z1 + w2 * z2 ELSE z1 END AS bz
  FROM (SELECT *, coalesce(w2 >= 0.5 * w1, false) AS two FROM (SELECT page_id, sum(w) AS ext, max(w) FILTER (WHERE r = 1) AS w1, max(w) FILTER (WHERE r = 2) AS w2, max(dx / norm) FILTER (WHERE r = 1) AS x1, max(dx / norm) FILTER (WHERE r = 2) AS x2, max(dy / norm) FILTER (WHERE r = 1) AS y1, max(dy / norm) FILTER (WHERE r = 2) AS y2, max(dz / norm) FILTER (WHERE r = 1) AS z1, max(dz / norm) FILTER (WHERE r = 2) AS z2 FROM {DIRS} GROUP BY page_id)))""")(lambda w: layout.sector_anchor(layout.cross_links(w.und(), w.memb), w.pos()).select("page_id", *r6("conf", "dx")))
query("rank_quantile", "SELECT page_id, round(CASE WHEN n > 0 THEN r / n ELSE 0 END, 6) AS q FROM (SELECT m.page_id, row_number() OVER (PARTITION BY comm ORDER BY deg, m.page_id) - 1 AS r, count(*) OVER (PARTITION BY comm) - 1 AS n FROM w_memb m JOIN w_deg d ON d.page_id = m.page_id)")(lambda w: layout.rank_quantile(w.memb.join(graph.node_degrees(w.und(), w.article), "page_id"), "comm", "deg", "page_id").select("page_id", *r6("q")))
query("galaxy_radius", "SELECT comm, round(r * least(1, 0.9 * R0 / cbrt(vol)), 6) AS radius FROM (SELECT *, sum(r ** 3) OVER (PARTITION BY macro) AS vol FROM (SELECT comm, macro, 1000.0 AS R0, greatest(0.6 * 1000.0 * sqrt(n / sum(n) OVER (PARTITION BY macro)), 1.5 * cbrt(n)) AS r FROM (SELECT comm, macro, count(*) AS n FROM w_memb GROUP BY ALL)))")(lambda w: layout.galaxy_radius(w.memb.groupBy("comm", "macro").agg(F.count(F.lit(1)).alias("n")), w.memb.groupBy("macro").agg(F.count(F.lit(1)).alias("n")).withColumn("radius", F.lit(1000.0))).select("comm", *r6("radius")))
query("radial_clamp", "SELECT comm, round(x * f, 6) AS x, round(y * f, 6) AS y, round(z * f, 6) AS z FROM (SELECT *, CASE WHEN d > greatest(20 - radius, 0) THEN greatest(20 - radius, 0) / d ELSE 1 END AS f FROM (SELECT *, sqrt(x ** 2 + y ** 2 + z ** 2) AS d FROM w_pos))")(lambda w: layout.clamp(w.pos(), 20.0).select("comm", *r6("x", "y", "z")))
query("recompose", "SELECT m.page_id, round(p.x + 1 + (m.page_id % 10 - p.x) * 2, 6) AS x, round(p.y + 1 + (1 - p.y) * 2, 6) AS y, round(p.z + 1 + (0 - p.z) * 2, 6) AS z FROM w_memb m JOIN w_pos p ON p.comm = m.comm")(lambda w: layout.recompose(w.memb.selectExpr("page_id", "comm", "page_id % 10 * 1.0D AS x", "1.0D AS y", "0.0D AS z"), w.pos(), w.pos().selectExpr("comm", "x + 1 AS x", "y + 1 AS y", "z + 1 AS z", "radius * 2 AS radius")).select("page_id", *r6("x", "y", "z")))
query("spill_list", "SELECT comm, round(d + radius - 12, 6) AS excess FROM (SELECT *, sqrt(x ** 2 + y ** 2 + z ** 2) AS d FROM w_pos) WHERE d + radius > 1.02 * 12 ORDER BY excess DESC, comm LIMIT 20")(lambda w: layout.spills(w.pos(), w.pos().selectExpr("macro", "0.0D AS x", "0.0D AS y", "0.0D AS z", "12.0D AS radius").distinct()).select("comm", *r6("excess")))
query("overlap_fraction", "SELECT round(coalesce(sum(pi() * (s - d) ** 2 * (d ** 2 + 2 * d * s - 3 * (ra - rb) ** 2) / (12 * d)), 0) / (SELECT sum(pi() * 4 / 3 * radius ** 3) FROM w_pos), 6) AS overlap, count(*) AS n_pairs FROM (SELECT a.radius AS ra, b.radius AS rb, a.radius + b.radius AS s, greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), abs(a.radius - b.radius), 1e-9) AS d FROM w_pos a JOIN w_pos b ON a.comm < b.comm) WHERE d < s")(lambda w: layout.overlap_fraction(w.pos()).select(F.round("overlap", 6).alias("overlap"), "n_pairs"))
query("membership_export", "SELECT m.page_id, title, comm, macro FROM w_memb m JOIN w_article a ON a.page_id = m.page_id")(lambda w: w.memb.join(w.article, "page_id").select("page_id", "title", "comm", "macro"))
query("parsed_pages", "SELECT count(*) AS n_rows, count_if(ns = 0)::BIGINT AS n_ns0, count_if(ns = 0 AND is_redirect)::BIGINT AS n_redirect, count_if(ns = 0 AND NOT is_redirect)::BIGINT AS n_article FROM w_page")(lambda w: w.page.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("ns") == 0).alias("n_ns0"), F.count_if((F.col("ns") == 0) & F.col("is_redirect")).alias("n_redirect"), F.count_if((F.col("ns") == 0) & ~F.col("is_redirect")).alias("n_article")))
query("tile_local_index", "SELECT page_id, comm, (row_number() OVER (PARTITION BY comm ORDER BY page_id) - 1)::INT AS local_idx FROM w_memb")(lambda w: layout.local_index(w.memb))
query("cross_cap", "SELECT page_id, other FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY other) AS r FROM (SELECT u AS page_id, v AS other FROM w_mu WHERE cu <> cv UNION ALL SELECT v, u FROM w_mu WHERE cu <> cv)) WHERE r <= 8")(lambda w: layout.cross_cap(w.und(), w.memb))
query("lpt_bins")(lambda w: layout.lpt_bins(w.memb.groupBy("comm").agg(F.count(F.lit(1)).alias("n")), 4))

# Solvers

query("detect_communities")(lambda w: solvers.detect(w.und(), w.article))
query("subdivide_communities")(lambda w: solvers.subdivide(w.und(), w.memb.selectExpr("page_id", "macro AS comm"), max_size=60))
query("l2_cluster")(lambda w: solvers.cluster(community.pairs(w.und(), w.memb)))
query("layout_local")(lambda w: solvers.layout_local(w.und(), w.memb))

from . import more  # noqa: E402, F401  the rest of the queries register themselves
