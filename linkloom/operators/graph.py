"""Edge sets, degrees, pruning, subsets and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.sources.scratch import cut, dealt, parts_of

SHARES = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (u, v), u < v."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    return dealt(pairs, parts_of(edges), "u").distinct()


def dedup_meta(edges: DataFrame, und: DataFrame) -> DataFrame:
    """(n_directed, n_self_loops, n_undirected, reciprocity_implied, reciprocity): the implied one is 1 - unique / directed and
    counts repeated edges too, the other is the share of distinct directed edges whose reverse is there."""
    m = edges.agg(F.count(F.lit(1)).alias("n_directed"), F.count_if(F.col("src") == F.col("dst")).alias("n_self_loops"))
    ways = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg((F.max((F.col("src") < F.col("dst")).cast("int")) + F.max((F.col("src") > F.col("dst")).cast("int"))).alias("ways"))
    back = ways.agg(F.try_divide(F.sum(F.when(F.col("ways") == 2, 2).otherwise(0)), F.sum("ways")).alias("reciprocity"))
    n = und.agg(F.count(F.lit(1)).alias("n_undirected"))
    return m.crossJoin(n).crossJoin(back).select("n_directed", "n_self_loops", "n_undirected", (1 - F.try_divide("n_undirected", F.col("n_directed") - F.col("n_self_loops"))).alias("reciprocity_implied"), "reciprocity")


def degrees(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """(page_id, in_deg, out_deg, deg) of every article, from directed edges with repeats."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("page_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("page_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    sums = ends.groupBy("page_id").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return articles.select("page_id").join(sums, "page_id", "left").select("page_id", zero("in_deg").alias("in_deg"), zero("out_deg").alias("out_deg"), (zero("in_deg") + zero("out_deg")).alias("deg"))


def node_degrees(und: DataFrame, articles: DataFrame) -> DataFrame:
    """(page_id, deg) over undirected edges."""
    ends = und.select(F.explode(F.array("u", "v")).alias("page_id")).groupBy("page_id").agg(F.count(F.lit(1)).alias("deg"))
    return articles.select("page_id").join(ends, "page_id", "left").select("page_id", F.coalesce("deg", F.lit(0).cast("long")).alias("deg"))


def full_stats(deg: DataFrame) -> DataFrame:
    """One row: counts, mean, exact percentiles, share of all degree at the top 0.1 % and 1 % of nodes.

    Sums of the top nodes come from a count per distinct degree, so no node list is ever sorted in one task.
    """
    steps = deg.groupBy("deg").agg(F.count(F.lit(1)).alias("c"))
    n = deg.agg(F.count(F.lit(1)).alias("n"), F.sum("out_deg").alias("m"), F.sum("deg").alias("total"), F.max("deg").alias("max_degree"), F.count_if(F.col("deg") == 0).alias("n_isolated"), F.percentile("deg", F.array(*map(F.lit, SHARES))).alias("p"))
    above = steps.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("deg")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    top = lambda k: F.sum(F.col("deg") * F.greatest(F.lit(0), F.least("c", F.greatest(F.lit(1), F.expr(f"n div {k}")) - F.col("before"))))
    tops = above.crossJoin(F.broadcast(n.select("n"))).agg(top(1000).alias("t1000"), top(100).alias("t100"))
    out = n.crossJoin(tops)
    return out.select(
        F.col("n").alias("n_articles"), F.col("m").alias("n_edges"), F.round(F.col("m") / F.col("n"), 6).alias("avg_out_degree"), "max_degree", "n_isolated",
        *[F.round(F.col("p")[i], 6).alias(f"p{str(s * 100).rstrip('0').rstrip('.').replace('.', '_')}") for i, s in enumerate(SHARES)],
        F.round(F.col("t1000") / F.col("total"), 6).alias("share_top_0_1pct"), F.round(F.col("t100") / F.col("total"), 6).alias("share_top_1pct"),
    )


def top_hubs(deg: DataFrame, articles: DataFrame, k: int = 60) -> DataFrame:
    """The k nodes of highest degree, with rank, title and the classes of hub that the title tells."""
    from linkloom.functions.titles import hub_flags

    top = deg.orderBy(F.desc("deg"), "page_id").limit(k)
    named = top.join(articles.select("page_id", "title"), "page_id")
    return named.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("deg"), "page_id"))).withColumn("flags", hub_flags(F.col("title")))


def top_incidence(und: DataFrame, deg: DataFrame, parts: int = 100) -> DataFrame:
    """Edges that touch one of the top n div parts nodes (at least one) by degree; ties go by page_id.

    The degree at which the top ends comes from a count per distinct degree; only nodes of just that
    degree are ranked.
    """
    deg = cut(deg)
    steps = deg.groupBy("deg").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy(F.desc("deg")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    want = steps.agg(F.greatest(F.lit(1), F.expr(f"sum(c) div {parts}")).alias("want"))
    edge = steps.withColumn("before", before).crossJoin(F.broadcast(want)).where("before < want AND before + c >= want").select(F.col("deg").alias("at"), (F.col("want") - F.col("before")).alias("room"))
    marked = deg.select("page_id", "deg").crossJoin(F.broadcast(edge))
    tied = marked.where("deg = at").withColumn("r", F.row_number().over(Window.partitionBy("deg").orderBy("page_id"))).where("r <= room")
    top = marked.where("deg > at").select(F.col("page_id").alias("t")).unionByName(tied.select(F.col("page_id").alias("t"))).withColumn("hub", F.lit(True))
    a = und.join(top, F.col("u") == F.col("t"), "left").select("u", "v", F.col("hub").alias("hu"))
    b = a.join(top, F.col("v") == F.col("t"), "left")
    return b.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.coalesce("hu", F.lit(False)) | F.coalesce("hub", F.lit(False))).alias("n_touching"))


def priority(u: str = "u", v: str = "v") -> Column:
    """Reproducible, spread-out priority of an edge."""
    return (F.col(u) * 7919 + F.col(v) * 104729) % 1000003


def degree_budget(und: DataFrame, budget: int, mode: str = "smart") -> DataFrame:
    """Edges that stay under a budget per node. Ranks go by priority, for each endpoint column on its own.

    both: within the budget at both ends; smart: within it, or few edges anyway, at either end. Rank and
    number of edges of an endpoint come from one window over its edges.
    """
    order = [priority(), "u", "v"]

    def ranked(df: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key)
        r = F.row_number().over(w.orderBy(*order)) <= budget
        return df.withColumn(f"ok_{key}", r if mode == "both" else r | (F.count(F.lit(1)).over(w) <= budget))

    marked = ranked(ranked(und, "u"), "v")
    return marked.where(F.col("ok_u") & F.col("ok_v") if mode == "both" else F.col("ok_u") | F.col("ok_v")).select("u", "v")


def with_degrees(und: DataFrame, deg: DataFrame) -> DataFrame:
    d = deg.select("page_id", "deg")
    return und.join(d.select(F.col("page_id").alias("u"), F.col("deg").alias("du")), "u").join(d.select(F.col("page_id").alias("v"), F.col("deg").alias("dv")), "v")


def drop_hub_edges(und: DataFrame, deg: DataFrame, in_cap: int | None = None, out_cap: int | None = None) -> DataFrame:
    """Edges neither end of which has more than in_cap links to it or out_cap from it; deg is of the whole graph (in_deg, out_deg)."""
    fine = _below_caps(deg, in_cap, out_cap).where("fine").select("page_id")
    return und.join(fine.select(F.col("page_id").alias("u")), "u", "left_semi").join(fine.select(F.col("page_id").alias("v")), "v", "left_semi").select("u", "v")


def _below_caps(deg: DataFrame, in_cap: int | None, out_cap: int | None) -> DataFrame:
    fine = F.lit(True)
    for column, cap in (("in_deg", in_cap), ("out_deg", out_cap)):
        fine = fine & (F.col(column) <= cap) if cap is not None else fine
    return deg.select("page_id", "in_deg", "out_deg", fine.alias("fine"))


def hub_filter_counters(und: DataFrame, deg: DataFrame, in_cap: int, out_cap: int) -> DataFrame:
    """One row: nodes over each cap, nodes taken out, edges dropped and their share."""
    nodes = _below_caps(deg, in_cap, out_cap).agg(F.count_if(F.col("in_deg") > in_cap).alias("nodes_in_capped"), F.count_if(F.col("out_deg") > out_cap).alias("nodes_out_capped"), F.count_if(~F.col("fine")).alias("nodes_isolated"))
    kept = drop_hub_edges(und, deg, in_cap, out_cap).agg(F.count(F.lit(1)).alias("kept"))
    all_ = und.agg(F.count(F.lit(1)).alias("n"))
    return nodes.crossJoin(kept).crossJoin(all_).select("nodes_in_capped", "nodes_out_capped", "nodes_isolated", (F.col("n") - F.col("kept")).alias("edges_dropped"), ((F.col("n") - F.col("kept")) / F.greatest(F.lit(1), "n")).alias("dropped_share"))


def hub_weights(und: DataFrame, deg: DataFrame, alpha: float | None = None) -> DataFrame:
    """Edge weights that fall with the degrees of both ends: logarithmic, or a power alpha."""
    w = 1 / (F.log(2 + F.col("du")) * F.log(2 + F.col("dv"))) if alpha is None else 1 / F.pow(F.col("du") * F.col("dv"), F.lit(alpha))
    return with_degrees(und, deg).select("u", "v", w.alias("w"))


def id_window(articles: DataFrame, k: int, where: str = "late") -> DataFrame:
    """k articles in a row by id: the last (late), the first (early) or those from n div 2 - k div 2 on (middle)."""
    if where != "middle":
        return articles.orderBy(F.desc("page_id") if where == "late" else F.col("page_id")).limit(k)
    n = articles.count()
    return articles.orderBy("page_id").offset(max(0, n // 2 - k // 2)).limit(k)


def classify_subset(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, kind): internal, out, in or outside a node set."""
    a = nodes.select(F.col("page_id").alias("src"), F.lit(True).alias("s"))
    b = nodes.select(F.col("page_id").alias("dst"), F.lit(True).alias("d"))
    kind = F.when(F.col("s") & F.col("d"), "internal").when(F.col("s"), "out").when(F.col("d"), "in").otherwise("outside")
    return edges.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", kind.alias("kind"))


def bfs(edges: DataFrame, seeds: DataFrame, hops: int = 4, cap: int | None = None, max_in_degree: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """(page_id, hop) reached along out-links.

    cap: links per node and hop, by priority. Targets of more than max_in_degree links are left out,
    seeds stay whatever theirs. max_nodes: a hop that would pass it keeps its first nodes by priority.
    Each hop is written, so it costs one join of the edges with its frontier, however many came before.
    """
    few = cut(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_in_degree).select(F.col("dst").alias("page_id"))) if max_in_degree is not None else None
    seen = cut(seeds.select("page_id", F.lit(0).alias("hop")).distinct())
    frontier = seen
    for hop in range(1, hops + 1):
        links = edges.join(frontier.select(F.col("page_id").alias("src")), "src")
        if cap is not None:
            links = links.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(priority("src", "dst"), "dst"))).where(F.col("r") <= cap)
        found = links.select(F.col("dst").alias("page_id")).distinct().join(seen, "page_id", "left_anti")
        if few is not None:
            found = found.join(few, "page_id", "left_semi")
        if max_nodes is not None:
            found = found.orderBy(priority("page_id", "page_id"), "page_id").limit(max(0, max_nodes - seen.count()))
        frontier = cut(found.withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def hop_log(reached: DataFrame) -> DataFrame:
    """(hop, new_nodes, total) of a bfs."""
    per = reached.groupBy("hop").agg(F.count(F.lit(1)).alias("new_nodes"))
    return per.select("hop", "new_nodes", F.sum("new_nodes").over(Window.orderBy("hop")).alias("total"))


def ego(und: DataFrame, node: int, k: int = 64) -> DataFrame:
    return und.where((F.col("u") == node) | (F.col("v") == node)).orderBy("u", "v").limit(k)


def body_vs_links(body_deg: DataFrame, link_deg: DataFrame) -> DataFrame:
    """(page_id, bd, pl, inflation): out-degree in texts and in link tables, side by side."""
    j = body_deg.select("page_id", F.col("out_deg").alias("bd")).join(link_deg.select("page_id", F.col("out_deg").alias("pl")), "page_id", "full")
    z = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return j.select("page_id", z("bd").alias("bd"), z("pl").alias("pl"), F.try_divide(z("pl"), z("bd")).alias("inflation"))


def compare_stats(both: DataFrame) -> DataFrame:
    """One row over (page_id, bd, pl) of articles with a link in either: means, percentiles of both degrees and of pl / max(1, bd),
    Pearson and Spearman correlation (ranks with ties by page_id), and articles with 50 links or more of which the text has none."""
    some = both.where("pl > 0 OR bd > 0").withColumn("ratio", F.col("pl") / F.greatest(F.lit(1), "bd"))
    shares = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
    points = lambda c: [F.round(F.percentile(c, s), 6).alias(f"{c}_p{round(s * 100)}") for s in shares]
    ranks = spearman(some, "pl", "bd", "page_id")
    flat = some.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("pl", "bd", "ratio")], *points("pl"), *points("bd"), *points("ratio"), F.round(F.corr("pl", "bd"), 6).alias("pearson"), F.count_if((F.col("bd") == 0) & (F.col("pl") >= 50)).alias("n_template"))
    return flat.crossJoin(ranks.select(F.round("spearman", 6).alias("spearman"))).withColumn("template_share", F.round(F.col("n_template") / F.greatest(F.lit(1), "n"), 6))


def spearman(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Correlation of the ranks of two columns; equal values rank by key.

    A rank is the number of rows with a smaller value, from a count per distinct value, plus the place
    among the equal ones; so no window spans all rows.
    """
    out = df.select(key, a, b)
    for c in (a, b):
        steps = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        before = steps.select("v", F.coalesce(F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        out = out.join(before, F.col(c) == F.col("v")).withColumn(f"r_{c}", F.col("before") + F.row_number().over(Window.partitionBy(c).orderBy(key))).drop("v", "before")
    return out.agg(F.corr(f"r_{a}", f"r_{b}").alias("spearman"))


def top_inflated(both: DataFrame, articles: DataFrame, k: int = 30) -> DataFrame:
    """The k articles with most links beyond those of their text."""
    top = both.orderBy(F.desc(F.col("pl") - F.col("bd")), "page_id").limit(k)
    return top.join(articles.select("page_id", "title"), "page_id").select("page_id", "title", "pl", "bd", (F.col("pl") / F.greatest(F.lit(1), "bd")).alias("ratio"))
