"""Operators that solve per group in Python: communities, layouts, tiles."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import blocks, community, graph, kernels, layout
from linkloom.sources.scratch import cut

#: Edges up to which a whole graph is refined in one group.
LOCAL_EDGES = 2_000_000
#: Inner edges up to which a community is subdivided as one task.
PART_EDGES = 250_000
#: Articles of a galaxy whose share of the tile is encoded at a time.
TILE_NODES = 1 << 16


def _index(ids: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    return [np.searchsorted(ids, c) for c in columns]


def _move(edges: DataFrame, owner: DataFrame, m2: float, gamma: float, rounds: int = 8, sizes: DataFrame | None = None) -> DataFrame:
    """owner (x, c) after rounds in which nodes go where the quality gains most; edges (u, v, w), u = v inside a node.

    In a round the nodes of one half by hash move at once, so that two neighbours rarely swap places.
    sizes (x, k): articles of each node, for the cpm quality; without it the quality is modularity.
    """
    sides = edges.where("u <> v").select("u", "v", "w").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    strength = cut(sizes if sizes is not None else edges.select(F.explode(F.array("u", "v")).alias("x"), "w").groupBy("x").agg(F.sum("w").alias("k")))
    cost = gamma if sizes is not None else gamma / m2
    still = 0
    for r in range(rounds):
        volume = owner.join(strength, "x").groupBy("c").agg(F.sum("k").alias("vol"))
        near = sides.join(owner.select(F.col("x").alias("v"), "c"), "v").groupBy(F.col("u").alias("x"), "c").agg(F.sum("w").alias("w"))
        own = owner.join(strength, "x").select("x", F.col("c").alias("own"), "k").where(F.pmod(F.xxhash64("x", F.lit(r // 2)), F.lit(2)) == r % 2)
        choices = near.unionByName(owner.select("x", "c", F.lit(0.0).alias("w"))).groupBy("x", "c").agg(F.sum("w").alias("w"))
        gain = F.col("w") - F.lit(cost) * F.col("k") * (F.col("vol") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0))
        scored = choices.join(own, "x").join(volume, "c").select("x", "c", "own", F.round(gain, 9).alias("gain"))
        best = scored.groupBy("x").agg(F.max(F.struct("gain", (F.col("c") == F.col("own")).alias("stay"), (-F.col("c")).alias("c"))).alias("b")).select("x", (-F.col("b.c")).alias("to"))
        moved = cut(owner.join(best, "x", "left").select("x", F.coalesce("to", "c").alias("c"), (F.coalesce("to", "c") != F.col("c")).alias("moved")))
        still = 0 if moved.where("moved").count() else still + 1
        owner = moved.select("x", "c")
        if still == 2:  # neither half
            break
    return owner


def _connected(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """owner (x, c) with each community split into connected parts; c is the least node of the part. A node comes once."""
    strengths = cut(blocks.node_strengths(edges.select("u", "v", F.lit(1.0).alias("w"))))
    if strengths.isEmpty():
        return owner.select("x", F.col("x").alias("c"))
    if strengths.count() <= blocks.NODES:
        g = blocks.Blocks(edges.select("u", "v", F.lit(1.0).alias("w")), strengths)
        held = owner.join(strengths.select("x"), "x", "left_semi").select("x", "c").toArrow()
        comm = np.zeros(len(g.ids), np.int64)
        comm[np.searchsorted(g.ids, held.column("x").to_numpy())] = held.column("c").to_numpy()
        parts = blocks.looked_up(owner.select("x"), "x", g.ids, g.ids[g.connected(comm)], "part")
        return parts.select("x", F.coalesce("part", "x").alias("c"))
    inside = edges.join(owner.select(F.col("x").alias("u"), F.col("c").alias("cu")), "u").join(owner.select(F.col("x").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").select("u", "v")
    sides = cut(inside.unionByName(inside.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    now = owner.select("x", F.col("x").alias("c"))
    while True:
        near = sides.join(now.select(F.col("x").alias("v"), "c"), "v").groupBy(F.col("u").alias("x")).agg(F.min("c").alias("m"))
        step = now.join(near, "x", "left").select("x", F.least("c", "m").alias("n"), "c")
        up = step.select(F.col("x").alias("n"), F.col("n").alias("nn"))  # a root's own root, so that chains halve
        step = cut(step.join(up, "n", "left").select("x", F.least("n", "nn").alias("n"), "c"))
        if not step.where("n <> c").count():
            return step.select("x", "c")
        now = step.select("x", F.col("n").alias("c"))


def _solver(gamma: float, objective: str):
    """Refines one group of edges (u, v, w, k): k > 0 gives the articles of a node u = v, k = 0 and u = v the weight inside it."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["u", "v"])
        ids = np.unique(np.concatenate([g.u, g.v]))
        e, inner = g[g.u != g.v], g[g.u == g.v]
        inner, sized = inner[inner.k == 0], inner[inner.k > 0]
        loops, sizes = np.zeros(len(ids)), np.ones(len(ids))
        loops[np.searchsorted(ids, inner.u.to_numpy())] = inner.w.to_numpy(float)
        sizes[np.searchsorted(ids, sized.u.to_numpy())] = sized.k.to_numpy(float)
        label = kernels.louvain(len(ids), *_index(ids, e.u.to_numpy(), e.v.to_numpy()), e.w.to_numpy(float), gamma, loops=loops, objective=objective, sizes=sizes)
        return pd.DataFrame({"c": ids, "l": pd.Series(ids).groupby(label).transform("min")})

    return solve


def _detect_blocks(whole: DataFrame, strengths: DataFrame, articles: DataFrame, m2: float, gamma: float, cpm: bool, refined) -> DataFrame:
    """detect for more than LOCAL_EDGES edges and up to blocks.NODES nodes: the edges lie in blocks, a few numbers per node in memory."""
    cost = gamma if cpm else gamma / m2
    g = blocks.Blocks(whole, strengths)
    n = len(g.ids)
    mass = np.ones(n) if cpm else g.mass
    label = g.move(np.arange(n), mass, cost)
    while True:
        label = np.unique(label, return_inverse=True)[1]
        edges = g.contract(label)
        if edges.where("u <> v").count() <= LOCAL_EDGES:
            own = None
            if cpm:
                own = blocks.looked_up(edges.select(F.explode(F.array("u", "v")).alias("c")).distinct(), "c", np.arange(label.max() + 1), np.bincount(label), "k").select("c", F.col("k").cast("double").alias("k"))
            found = refined(edges, own).toArrow()
            to = np.arange(label.max() + 1)
            to[found.column("c").to_numpy()] = found.column("l").to_numpy()
            label = to[label]
            break
        h = blocks.Blocks(edges)
        to = h.ids[h.move(np.arange(len(h.ids)), np.bincount(label)[h.ids].astype(float) if cpm else h.mass, cost)]
        if len(np.unique(to)) == len(h.ids):  # nothing merges any more: these are the communities
            break
        label = to[np.searchsorted(h.ids, label)]
    label = g.connected(g.move(label, mass, cost))
    return blocks.looked_up(articles.select("page_id"), "page_id", g.ids, g.ids[label], "comm").select("page_id", F.coalesce("comm", "page_id").alias("comm"))


def detect(und: DataFrame, articles: DataFrame, gamma: float = 1.0, objective: str = "modularity", max_edges: int = 0) -> DataFrame:
    """(page_id, comm): communities of the whole graph, by modularity or cpm; max_edges: only that many edges, by priority, for a trial.

    An edge weighs what und has in column w, 1 without it.

    While there are more than LOCAL_EDGES weighted edges, nodes move in parallel rounds as modularity gains and
    their communities become the nodes of a smaller graph; the rest is refined in one group. The rounds read edges
    in blocks, with a few numbers per node in memory; above blocks.NODES nodes they are joins. After that
    the articles themselves move once more, so none is tied to what it was merged with, and
    communities are split into connected parts. Isolated articles are communities of their own.
    """
    if max_edges:
        und = und.orderBy(graph.priority(), "u", "v").limit(max_edges)
    cpm = objective == "cpm"
    whole = edges = und.select("u", "v", (F.col("w").cast("double") if "w" in und.columns else F.lit(1.0)).alias("w"))
    owner = articles.select("page_id", F.col("page_id").alias("c"))
    n_edges, total = edges.agg(F.count(F.lit(1)), F.sum("w")).first()
    m2, merged, fits = 2.0 * (total or 0.0), False, True

    def refined(edges: DataFrame, own: DataFrame | None) -> DataFrame:
        """(c, l): edges (u, v, w) solved in one group; own (c, k): articles of each node, for cpm."""
        rows = edges.withColumn("k", F.lit(0.0))
        if own is not None:
            rows = rows.unionByName(own.select(F.col("c").alias("u"), F.col("c").alias("v"), F.lit(0.0).alias("w"), "k"))
        return rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_solver(gamma, objective), "c long, l long")

    if n_edges > LOCAL_EDGES:
        strengths = cut(blocks.node_strengths(whole))
        if strengths.count() <= blocks.NODES:
            return _detect_blocks(whole, strengths, articles, m2, gamma, cpm, refined)
    while n_edges > LOCAL_EDGES:
        nodes = edges.select(F.explode(F.array("u", "v")).alias("x")).distinct()
        sizes = owner.groupBy(F.col("c").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("k")).join(nodes, "x", "left_semi") if cpm else None
        to = _move(edges, nodes.select("x", F.col("x").alias("c")), m2, gamma, sizes=sizes).withColumnRenamed("c", "to")
        if not to.where("x <> to").count():  # no move gains: these are the communities
            fits = False
            break
        owner = cut(owner.join(to, F.col("c") == F.col("x"), "left").select("page_id", F.coalesce("to", "c").alias("c")))
        a, b = to.select(F.col("x").alias("u"), F.col("to").alias("cu")), to.select(F.col("x").alias("v"), F.col("to").alias("cv"))
        edges = cut(edges.join(a, "u").join(b, "v").groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w")))
        n_edges, merged = edges.where("u <> v").count(), True

    if fits:
        own = None
        if cpm:
            ends = edges.select(F.explode(F.array("u", "v")).alias("c")).distinct()
            own = owner.join(ends, "c", "left_semi").groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("k"))
        owner = owner.join(refined(edges, own), "c", "left").select("page_id", F.coalesce("l", "c").alias("c"))
    if merged:
        linked = whole.select(F.explode(F.array("u", "v")).alias("x")).distinct()
        start = cut(owner.withColumnRenamed("page_id", "x").join(linked, "x", "left_semi"))
        ones = start.select("x", F.lit(1.0).alias("k")) if cpm else None
        final = _connected(whole, _move(whole, start, m2, gamma, sizes=ones)).select(F.col("x").alias("page_id"), F.col("c").alias("l"))
        owner = owner.join(final, "page_id", "left").select("page_id", F.coalesce("l", "c").alias("c"))
    return owner.select("page_id", F.col("c").alias("comm"))


def subdivide(und: DataFrame, memb: DataFrame, max_size: int, seed: int = 42, min_size: int = 0, gamma: float = 1.0, objective: str = "modularity", depth: int = 4) -> DataFrame:
    """(page_id, comm, part): each community cut further until its parts have max_size articles at most; communities of up to min_size stay whole.

    Communities of up to PART_EDGES inner edges are one task each. Larger ones are first cut by detect, all at
    once on their inner edges alone, so that there are more and smaller tasks.
    """
    kind = memb.schema["comm"].dataType.simpleString()
    inner = community.ends(und, memb).where("cu = cv").select(F.col("cu").alias("comm"), "u", "v")
    big = inner.groupBy("comm").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(PART_EDGES, LOCAL_EDGES)).select("comm")
    own = memb.select("page_id", "comm", F.lit(0).cast("long").alias("first"))
    if not big.isEmpty():
        big = cut(big)
        first = detect(inner.join(big, "comm", "left_semi").select("u", "v"), memb.join(big, "comm", "left_semi"), gamma, objective).select("page_id", F.col("comm").alias("cut"))
        own = cut(memb.select("page_id", "comm").join(first, "page_id", "left").select("page_id", "comm", F.coalesce("cut", F.lit(0)).alias("first")))
        a, b = own.select(F.col("page_id").alias("u"), F.col("first").alias("fu")), own.select(F.col("page_id").alias("v"), F.col("first").alias("fv"))
        inner = inner.join(a, "u").join(b, "v").where("fu = fv").select("comm", "u", "v", F.col("fu").alias("first"))
    else:
        inner = inner.withColumn("first", F.lit(0).cast("long"))
    rows = inner.unionByName(own.select("comm", F.col("page_id").alias("u"), F.col("page_id").alias("v"), "first"))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["u", "v"])
        ids = np.unique(g.u[g.u == g.v])
        e = g[g.u != g.v]
        part = kernels.subdivide(len(ids), *_index(ids, e.u.to_numpy(), e.v.to_numpy()), max_size, depth, seed, min_size, gamma, objective)
        return pd.DataFrame({"page_id": ids, "comm": g.comm.iloc[0], "first": g["first"].iloc[0], "part": part.astype("int64")})

    parts = rows.groupBy("comm", "first").applyInPandas(solve, f"page_id long, comm {kind}, first long, part long")
    return parts.select("page_id", "comm", F.when(F.col("first") == 0, F.col("part")).otherwise(F.xxhash64("first", "part")).alias("part"))


def cluster(pairs: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(comm, cluster): communities of the weighted graph of communities, which is one task."""
    kind = pairs.schema["a"].dataType.simpleString()

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["a", "b"])
        ids = np.unique(np.concatenate([g.a, g.b]))
        return pd.DataFrame({"comm": ids, "cluster": kernels.louvain(len(ids), *_index(ids, g.a.to_numpy(), g.b.to_numpy()), g.w.to_numpy(float), gamma).astype("int32")})

    return pairs.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(solve, f"comm {kind}, cluster int")


def layout_local(und: DataFrame, memb: DataFrame, seed: int = 42, norm: str = "p98", multilevel: int = 2000) -> DataFrame:
    """(page_id, comm, x, y, z): each community laid out in its own unit ball."""
    kind = memb.schema["comm"].dataType.simpleString()
    inner = community.ends(und, memb).where("cu = cv").select(F.col("cu").alias("comm"), "u", "v")
    rows = inner.unionByName(memb.select("comm", F.col("page_id").alias("u"), F.col("page_id").alias("v")))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["u", "v"])
        ids = np.unique(g.u[g.u == g.v])
        e = g[g.u != g.v]
        own = seed + abs(int(g.comm.iloc[0])) % (1 << 31)
        p = kernels.force_layout(len(ids), *_index(ids, e.u.to_numpy(), e.v.to_numpy()), np.ones(len(e)), seed=own, multilevel=multilevel, norm=norm).astype("float32")
        return pd.DataFrame({"page_id": ids, "comm": g.comm.iloc[0], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return rows.groupBy("comm").applyInPandas(solve, f"page_id long, comm {kind}, x float, y float, z float")


def tiles(placed: DataFrame, und: DataFrame, memb: DataFrame, articles: DataFrame, cross_cap: int = 8) -> DataFrame:
    """(comm, tile, titles): of each galaxy the binary tile and the JSON of its titles.

    placed: (page_id, comm, x, y, z). A tile has places, inner edges by local index, and up to cross_cap
    cross edges of each article as (local index, other galaxy, local index there).
    """
    local = layout.local_index(memb)
    kind = memb.schema["comm"].dataType.simpleString()
    at = placed.select("page_id", "x", "y", "z").join(local, "page_id").join(articles.select("page_id", "title"), "page_id", "left")
    blank = lambda name, t: F.lit(None).cast(t).alias(name)
    nodes = at.select("comm", F.lit(0).alias("what"), F.col("local_idx").cast("long").alias("a"), blank("g", "long"), blank("b", "long"), "x", "y", "z", "title")
    rest = [blank(c, "float") for c in "xyz"] + [blank("title", "string")]
    ids = lambda key, out, comm: local.select(F.col("page_id").alias(key), F.col("local_idx").cast("long").alias(out), F.col("comm").alias(comm))
    inner = und.join(ids("u", "a", "cu"), "u").join(ids("v", "b", "cv"), "v").where("cu = cv").select(F.col("cu").alias("comm"), F.lit(1).alias("what"), "a", blank("g", "long"), "b", *rest)
    cross = layout.cross_cap(und, memb, cross_cap).join(ids("page_id", "a", "comm"), "page_id").join(ids("other", "b", "co"), "other").select("comm", F.lit(2).alias("what"), "a", F.col("co").cast("long").alias("g"), "b", *rest)

    rows = nodes.unionByName(inner).unionByName(cross).withColumn("chunk", F.floor(F.col("a") / TILE_NODES))

    def encode(g: pa.Table) -> pa.Table:
        """The part of a tile from one range of its articles: places and titles, inner edges, or cross edges, in order."""
        what = g.column("what")[0].as_py()
        keys = (("a",), ("a", "b"), ("a", "g", "b"))[what]
        g = g.sort_by([(k, "ascending") for k in keys])
        columns, kind = (("x", "y", "z"), "<f4") if what == 0 else (keys, "<u4")
        data = np.stack([g.column(c).to_numpy().astype(kind) for c in columns], 1).tobytes()
        titles = json.dumps([t or None for t in g.column("title").to_pylist()], ensure_ascii=False) if what == 0 else None
        return pa.table([*(g.column(c).slice(0, 1) for c in ("comm", "what", "chunk")), pa.array([len(g)], pa.int64()), pa.array([data], pa.binary()), pa.array([titles], pa.string())], ["comm", "what", "chunk", "n", "data", "titles"])

    def build(g: pa.Table) -> pa.Table:
        g = g.sort_by([("what", "ascending"), ("chunk", "ascending")])
        what, count, titles = (g.column(c).to_numpy() if c != "titles" else g.column(c).to_pylist() for c in ("what", "n", "titles"))
        head, names, at = np.array([count[what == k].sum() for k in range(3)], "<u4").tobytes(), [], 0
        for n, part in zip(count[what == 0].tolist(), titles, strict=False):
            if "null" in part:  # perhaps a missing title
                part = json.dumps([f"local#{at + k}" if t is None else t for k, t in enumerate(json.loads(part))], ensure_ascii=False)
            names.append(part[1:-1])
            at += n
        tile = b"".join([head, *(x.as_buffer() for x in g.column("data"))])
        return pa.table([g.column("comm").slice(0, 1), pa.array([tile], pa.binary()), pa.array(['{"t": [' + ", ".join(names) + "]}"])], ["comm", "tile", "titles"])

    parts = rows.groupBy("comm", "what", "chunk").applyInArrow(encode, f"comm {kind}, what int, chunk long, n long, data binary, titles string")
    return parts.groupBy("comm").applyInArrow(build, f"comm {kind}, tile binary, titles string")


def _tile_by_tile(tiles: DataFrame, read, schema: str) -> DataFrame:
    """read(comm, tile, titles) -> columns, for one tile at a time, so that a task never holds several."""
    kind = tiles.schema["comm"].dataType.simpleString()

    def run(g: pa.Table) -> pa.Table:
        out = []
        for comm, tile, titles in zip(g.column("comm"), g.column("tile"), g.column("titles"), strict=True):
            columns = read(tile.as_buffer() if tile.is_valid else b"", titles.as_py())
            n = len(next(iter(columns.values())))
            out.append(pa.table({"comm": pa.repeat(comm, n), **columns}))
        return pa.concat_tables(out)

    return tiles.select("comm", "tile", "titles").groupBy("comm").applyInArrow(run, f"comm {kind}, {schema}")


def read_tiles(tiles: DataFrame) -> DataFrame:
    """(comm, n, n_edges, n_cross, bytes, bad_size, bad_index, n_titles, n_empty, n_local, in_ball) of each tile read again."""

    def read(tile, titles) -> dict:
        try:
            xyz, edges, cross = kernels.read_tile(tile)
            bad = False
        except ValueError:
            xyz, edges, cross, bad = np.empty((0, 3)), np.empty((0, 2), int), np.empty((0, 3), int), True
        names = json.loads(titles)["t"] if isinstance(titles, str) else []
        wrong = int((edges >= len(xyz)).any(1).sum() + (cross[:, 0] >= len(xyz)).sum())
        inside = bool((np.sqrt((xyz**2).sum(1)) <= 1.0001).all())
        return {"n": [len(xyz)], "n_edges": [len(edges)], "n_cross": [len(cross)], "bytes": [len(tile)], "bad_size": [bad], "bad_index": [wrong], "n_titles": [len(names)], "n_empty": [sum(not t for t in names)], "n_local": [sum(str(t).startswith("local#") for t in names)], "in_ball": [inside]}

    return _tile_by_tile(tiles, read, "n long, n_edges long, n_cross long, bytes long, bad_size boolean, bad_index long, n_titles long, n_empty long, n_local long, in_ball boolean")


def tile_rows(tiles: DataFrame) -> DataFrame:
    """(comm, local_idx, title, x, y, z, deg) of the articles in tiles, as a viewer takes them.

    Places that are no numbers become 0, edges with an index out of range are left out, titles that are
    missing are made up, and deg counts the inner and cross edges that are left.
    """

    def read(tile, titles) -> dict:
        xyz, edges, cross = kernels.read_tile(tile)
        n = len(xyz)
        inner, far = edges[(edges < n).all(1)].ravel(), cross[cross[:, 0] < n, 0]
        deg = np.bincount(inner, minlength=n) + np.bincount(far, minlength=n)
        names = json.loads(titles).get("t", []) if isinstance(titles, str) else []
        names = [names[k] if k < len(names) and names[k] else f"local#{k}" for k in range(n)]
        p = np.nan_to_num(xyz)
        return {"local_idx": np.arange(n), "title": pa.array(names, pa.string()), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "deg": deg}

    return _tile_by_tile(tiles, read, "local_idx long, title string, x float, y float, z float, deg long")
