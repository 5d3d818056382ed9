"""Study of a subset: communities at several resolutions, one picked, its figures, hubs and clusters, as tables and a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.titles import resolution_tag
from linkloom.operators import catalog, community, graph, subset

from . import publish, solvers


def sweep(und: DataFrame, nodes: DataFrame, resolutions: tuple[float, ...] = (0.5, 1.0, 2.0), objective: str = "modularity") -> tuple[dict[float, DataFrame], DataFrame]:
    """The membership of each resolution, and (resolution, median_size, n_communities, cross_edge_fraction, modularity) of all.

    The edges are worked out once and kept for all resolutions.
    """
    und = und.persist()
    found, rows = {}, None
    for r in resolutions:
        found[r] = solvers.detect(und, nodes, r, objective).persist()
        per = community.per_community(und, found[r])
        row = per.agg(F.percentile("n_c", 0.5).alias("median_size"), F.count(F.lit(1)).alias("n_communities"), F.try_divide(F.sum("e_out") / 2, F.sum("e_in") + F.sum("e_out") / 2).alias("cross_edge_fraction")).crossJoin(community.modularity(per, r))
        row = row.select(F.lit(float(r)).alias("resolution"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return found, rows.persist()


def analyze(edges: DataFrame, nodes: DataFrame, articles: DataFrame, resolutions: tuple[float, ...] = (0.5, 1.0, 2.0), degree_budget: int | None = None, hub_caps: tuple[int, int] | None = None, title: str = "subset") -> dict:
    """Tables and a Markdown page on the articles nodes (page_id) of a graph of directed edges.

    degree_budget: at most so many edges per node go into detection; hub_caps: (in, out) degrees in the whole
    graph above which a node's edges do not. Figures are always of all edges inside the subset.
    """
    inside = subset.induced(edges, nodes)
    raw = graph.undirected(inside)
    und = graph.degree_budget(raw, degree_budget) if degree_budget else raw
    if hub_caps:
        und = graph.drop_hub_edges(und, graph.degrees(edges, articles), *hub_caps)
    found, swept = sweep(und, nodes, resolutions)
    best = catalog.pick_resolution(swept).first()[0]
    memb = found[best]
    traffic = subset.node_traffic(edges, nodes)
    per = subset.per_community(raw, memb, traffic).persist()
    pair = community.pairs(raw, memb).persist()
    to = solvers.cluster(pair)
    tables = {
        "sweep": swept,
        "per_community": per,
        "metrics": community.global_metrics(per),
        "leaks": subset.leak_stats(edges, nodes),
        "labels": community.rep_titles(graph.node_degrees(raw, nodes), memb, articles),
        "top_pairs": catalog.top_pairs(pair, 20),
        "hubs": subset.hub_table(raw, memb, traffic, articles),
        "degrees": subset.degree_points(raw, memb),
        "clusters": subset.clusters(per, pair, to),
        "membership": memb.join(to, "comm", "left"),
    }
    shown = {k: v for k, v in tables.items() if k != "membership"}
    return {"tag": resolution_tag(best), "resolution": best, "tables": tables, "report": publish.report(title, {"picked": resolution_tag(best), **shown})}
