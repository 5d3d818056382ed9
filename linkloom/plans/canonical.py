"""The canonical chain from dump files to catalog, layout, tiles and audits, as stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.operators import audit, catalog, category, community, geometry, graph, layout, resolve
from linkloom.sources import arrays, dumps

from . import publish as out
from . import solvers
from .stages import Store, stage


def kept(resolved: DataFrame) -> DataFrame:
    return resolved.where("reason = 'kept'").select("src", "dst")


def articles(page: DataFrame) -> DataFrame:
    return page.where("ns = 0 AND NOT is_redirect").select("page_id", "title")


def numbered(memb: DataFrame, key: str) -> DataFrame:
    """memb with the communities in column key named 0, 1, ... by size, ties by their first article; one short row per community is sorted."""
    sizes = memb.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("page_id").alias("_first"))
    names = sizes.select(key, (F.row_number().over(Window.orderBy(F.desc("_n"), "_first")) - 1).alias("_name"))
    return memb.join(names, key).withColumn(key, F.col("_name")).drop("_name")


# Ingest

@stage("download", [], "downloads", group="ingest", store=True, always=True, base_url="", files="page,redirect,linktarget,pagelinks,categorylinks", folder="", workers=3)
def download(store: Store, base_url: str, files: str, folder: str, workers: int) -> DataFrame:
    wanted = [f"{base_url}{name}.sql.gz" for name in files.split(",")]
    wrong = arrays.download_all(wanted, folder or f"{store.base}/dumps", workers)
    if wrong:
        raise OSError(str(wrong))
    return store.spark.createDataFrame([(u,) for u in wanted], "url string")


def parsed(kind: str):
    def run(store: Store, folder: str, partitions: int) -> DataFrame:
        return dumps.read_dump(store.spark, f"{folder or store.base + '/dumps'}/*{kind}.sql*", kind, partitions or None)

    return run


for _kind in ("page", "redirect", "linktarget", "pagelinks", "categorylinks"):
    stage(f"parse_{_kind}", [], _kind, group="ingest", store=True, folder="", partitions=0)(parsed(_kind))


@stage("redirects", ["redirect", "page"], "rdmap", hops=10)
def redirects(redirect: DataFrame, page: DataFrame, hops: int) -> DataFrame:
    return resolve.redirect_map(redirect, page, hops)


@stage("edges", ["pagelinks", "linktarget", "page", "rdmap"], "resolved")
def edges(links: DataFrame, targets: DataFrame, page: DataFrame, rdmap: DataFrame) -> DataFrame:
    return resolve.resolve_links(links, targets, page, rdmap)


@stage("categories", ["linktarget"], "category")
def categories(targets: DataFrame) -> DataFrame:
    return dumps.categories(targets)


@stage("article_categories", ["categorylinks", "category", "page"], "artcat")
def article_categories(links: DataFrame, cats: DataFrame, page: DataFrame) -> DataFrame:
    return dumps.article_categories(links, cats, articles(page))


@stage("body_edges", ["page", "rdmap"], "body_resolved", group="optional", store=True, xml="", strip_refs=False, limit_pages=0)
def body_edges(store: Store, page: DataFrame, rdmap: DataFrame, xml: str, strip_refs: bool, limit_pages: int) -> DataFrame:
    pages = dumps.read_pages_xml(store.spark, xml or f"{store.base}/dumps/*pages-articles*.xml*")
    return resolve.body_link_reasons(resolve.text_links(pages.limit(limit_pages) if limit_pages else pages, strip_refs), page, rdmap)


# Graph and communities

@stage("stats", ["resolved", "page"], "full_stats")
def stats(resolved: DataFrame, page: DataFrame) -> DataFrame:
    return graph.full_stats(graph.degrees(kept(resolved), articles(page)))


@stage("hubs", ["resolved", "page"], "top_hubs", titles_needed=200)
def hubs(resolved: DataFrame, page: DataFrame, titles_needed: int) -> DataFrame:
    return graph.top_hubs(graph.degrees(kept(resolved), articles(page)), articles(page), titles_needed)


@stage("dedup", ["resolved"], "und")
def dedup(resolved: DataFrame) -> DataFrame:
    return graph.undirected(kept(resolved))


@stage("prune", ["und"], "und_pruned", group="experiment", budget=40, mode="smart")
def prune(und: DataFrame, budget: int, mode: str) -> DataFrame:
    return graph.degree_budget(und, budget, mode)


@stage("detect", ["und", "page"], "macros_of", resolution=1.0, objective="modularity", max_edges=0)
def detect(und: DataFrame, page: DataFrame, resolution: float, objective: str, max_edges: int) -> DataFrame:
    return numbered(solvers.detect(und, articles(page), resolution, objective, max_edges), "comm")


@stage("subdivide", ["und", "macros_of"], "membership", max_galaxy=10_000, min_size=100, depth=4, sub_resolution=1.0, sub_objective="modularity", seed=42)
def subdivide(und: DataFrame, macros: DataFrame, max_galaxy: int, min_size: int, depth: int, sub_resolution: float, sub_objective: str, seed: int) -> DataFrame:
    parts = solvers.subdivide(und, macros, max_galaxy, seed, min_size, sub_resolution, sub_objective, depth)
    return numbered(parts.select("page_id", F.struct("comm", "part").alias("comm"), F.col("comm").alias("macro")), "comm")


@stage("metrics", ["und", "membership"], "per_community")
def metrics(und: DataFrame, memb: DataFrame) -> DataFrame:
    return community.per_community(und, memb)


@stage("macro_metrics", ["und", "macros_of"], "per_macro")
def macro_metrics(und: DataFrame, memb: DataFrame) -> DataFrame:
    return community.per_community(und, memb)


@stage("global_metrics", ["per_community"])
def global_metrics(per: DataFrame) -> DataFrame:
    return community.global_metrics(per)


@stage("pairs", ["und", "membership"])
def pairs(und: DataFrame, memb: DataFrame) -> DataFrame:
    return community.pairs(und, memb)


@stage("cluster", ["pairs"], "clusters", cluster_resolution=1.0)
def cluster(pair: DataFrame, cluster_resolution: float) -> DataFrame:
    return solvers.cluster(pair, cluster_resolution)


@stage("cluster_metrics", ["per_community", "pairs", "clusters"], "per_cluster")
def cluster_metrics(per: DataFrame, pair: DataFrame, to: DataFrame) -> DataFrame:
    return community.clusters(per, pair, to)


@stage("export", ["membership", "page", "clusters"])
def export(memb: DataFrame, page: DataFrame, to: DataFrame) -> DataFrame:
    return memb.join(articles(page), "page_id").join(to, "comm", "left").select("page_id", "title", "comm", "macro", "cluster")


@stage("purity", ["artcat", "membership", "category"], max_cat_freq=20_000)
def purity(artcat: DataFrame, memb: DataFrame, cats: DataFrame, max_cat_freq: int) -> DataFrame:
    return category.names(artcat, memb, cats, max_cat_freq)


@stage("reps", ["und", "membership", "page"], "rep_titles")
def reps(und: DataFrame, memb: DataFrame, page: DataFrame) -> DataFrame:
    return community.rep_titles(graph.node_degrees(und, articles(page)), memb, articles(page))


@stage("catalog", ["per_community", "purity", "rep_titles", "membership", "pairs", "clusters"], "galaxies", top_neighbors=8)
def galaxies(per: DataFrame, names: DataFrame, rep: DataFrame, memb: DataFrame, pair: DataFrame, to: DataFrame, top_neighbors: int) -> DataFrame:
    return catalog.galaxy_table(per, names, rep, memb, pair, to, top_neighbors)


@stage("macros", ["membership", "per_macro", "galaxies", "und", "page"], "macros")
def macros(memb: DataFrame, per: DataFrame, gal: DataFrame, und: DataFrame, page: DataFrame) -> DataFrame:
    own = memb.select("page_id", F.col("macro").alias("comm"))
    return catalog.macro_table(memb, per, gal, community.rep_titles(graph.node_degrees(und, articles(page)), own, articles(page)))


@stage("macro_pairs", ["pairs", "galaxies"])
def macro_pairs(pair: DataFrame, gal: DataFrame) -> DataFrame:
    return catalog.macro_pairs(pair, gal.where("macro_id >= 0").select(F.col("galaxy_id").alias("comm"), "macro_id"))


# Layout

@stage("layout_macros", ["macros", "macro_pairs"], "macro_positions", macro_z_squash=1.0, macro_w_power=1.0, seed=42)
def layout_macros(mac: DataFrame, pair: DataFrame, macro_z_squash: float, macro_w_power: float, seed: int) -> DataFrame:
    own = mac.where("NOT is_dust").select("macro_id", F.col("n_articles").alias("n"))
    return geometry.place_macros(own, pair.select(F.col("macro_a").alias("a"), F.col("macro_b").alias("b"), "w"), seed, macro_z_squash, macro_w_power)


@stage("layout_global", ["galaxies", "macro_positions", "pairs"], "galaxy_positions", pack=0.6, r_expo=0.5, seed=42)
def layout_global(gal: DataFrame, mac: DataFrame, pair: DataFrame, pack: float, r_expo: float, seed: int) -> DataFrame:
    own = gal.select(F.col("galaxy_id").alias("comm"), F.col("macro_id").alias("macro"), F.col("n_articles").alias("n"), "display_class")
    placed = geometry.place_galaxies(own, mac, pair, pack, r_expo, seed)
    shell = geometry.dust_shell(own.join(placed.select("comm"), "comm", "left_anti"), mac, pack)
    return placed.unionByName(shell).join(own.select("comm", "display_class", "n"), "comm")


@stage("layout_local", ["und", "membership", "galaxy_positions"], "article_positions", anchor_mode="sector", sector_ratio=0.5, fr_norm="p98", ml_threshold=2000, seed=42)
def layout_local(und: DataFrame, memb: DataFrame, gal: DataFrame, anchor_mode: str, sector_ratio: float, fr_norm: str, ml_threshold: int, seed: int) -> DataFrame:
    unit = solvers.layout_local(und, memb, seed, fr_norm, ml_threshold).join(layout.degree_sides(und, memb), "page_id")
    cross = layout.cross_links(und, memb)
    if anchor_mode == "sector":
        anchors = layout.sector_anchor(cross, gal, sector_ratio)
    else:
        total = layout.anchor_sum(cross, gal)
        size = F.greatest(F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2), F.lit(1e-9))
        anchors = total.select("page_id", *[(F.col("a" + c) / size).alias("d" + c) for c in "xyz"], F.lit(1.0).alias("conf"))
    placed = geometry.article_forces(unit, anchors, gal, anchor_mode)
    return placed.select("page_id", "comm", *[F.col(c).cast("float").alias(c) for c in "xyz"])


@stage("recompose", ["article_positions", "galaxy_positions", "galaxy_positions_new"], "article_positions_new", group="optional")
def recompose(points: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    return layout.recompose(points, old, new)


# Delivery and audits

@stage("tiles", ["article_positions", "und", "membership", "page"], "tiles", cross_cap=8)
def tiles(points: DataFrame, und: DataFrame, memb: DataFrame, page: DataFrame, cross_cap: int) -> DataFrame:
    return solvers.tiles(points, und, memb, articles(page), cross_cap)


@stage("publish", ["tiles", "galaxies", "macros", "galaxy_positions", "macro_positions", "macro_pairs", "pairs"], "published", store=True, always=True, folder="", run="", cross_cap=8)
def publish(store: Store, tile: DataFrame, gal: DataFrame, mac: DataFrame, gpos: DataFrame, mpos: DataFrame, mpair: DataFrame, pair: DataFrame, folder: str, run: str, cross_cap: int) -> DataFrame:
    return out.publish(tile, gal, mac, gpos, mpos, mpair, pair, folder or f"{store.base}/spatial", run, cross_cap)


@stage("audit_tiles", ["tiles", "galaxies"], "audit_tiles", group="audit")
def audit_tiles(tile: DataFrame, gal: DataFrame) -> DataFrame:
    return audit.tile_counts(solvers.read_tiles(tile), gal.select(F.col("galaxy_id").alias("comm"), F.col("n_articles").alias("n")))


@stage("audit_names", ["galaxies"], "audit_names", group="audit")
def audit_names(gal: DataFrame) -> DataFrame:
    return audit.class_by_source(gal)


@stage("audit_labels", ["galaxies", "macros"], "macro_label_template", group="audit", top=5)
def audit_labels(gal: DataFrame, mac: DataFrame, top: int) -> DataFrame:
    return audit.label_template(gal, mac, top)


@stage("audit_layout", ["galaxy_positions", "macro_positions", "pairs"], "audit_layout", group="audit")
def audit_layout(gpos: DataFrame, mpos: DataFrame, pair: DataFrame) -> DataFrame:
    return audit.layout_summary(gpos, mpos, pair)


def open_store(spark: SparkSession, base: str) -> Store:
    return Store(spark, base)
