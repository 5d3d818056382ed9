import json

import numpy as np

from linkloom.operators import blocks, catalog, community, geometry, graph, kernels, layout, resolve
from linkloom.plans import solvers, wiki


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_resolution_reasons(spark):
    pages = frame(spark, [(i, 0, f"P{i}", False) for i in range(5)] + [(10, 0, "R10", True), (11, 0, "R11", True), (12, 0, "R12", True), (20, 1, "T", False)], "page_id long, ns int, title string, is_redirect boolean")
    redirects = frame(spark, [(10, 0, "P1", ""), (11, 0, "R10", ""), (12, 0, "Missing", "")], "rd_from long, rd_ns int, rd_title string, interwiki string")
    rd = resolve.redirect_map(redirects, pages)
    assert {tuple(r) for r in rd.collect()} == {(10, 1), (11, 1), (12, None)}
    targets = frame(spark, [(1, 0, "P1"), (2, 0, "R11"), (3, 0, "R12"), (4, 0, "Nowhere"), (5, 14, "C")], "lt_id long, ns int, title string")
    links = frame(spark, [(0, 0, 1), (0, 0, 2), (0, 0, 3), (0, 0, 4), (0, 0, 5), (20, 1, 1), (10, 0, 1), (99, 0, 1), (1, 0, 2)], "pl_from long, pl_from_ns int, lt_id long")
    got = [(r.src, r.dst, r.reason) for r in resolve.resolve_links(links, targets, pages, rd).collect()]
    assert [x[2] for x in got].count("kept") == 2
    assert {x[2] for x in got} == {"kept", "target_dangling_redirect", "target_redlink", "target_non_ns0", "from_non_ns0", "src_is_redirect", "src_not_article", "self_loop"}


def test_target_in_two_namespaces_gives_two_rows(spark):
    pages = frame(spark, [(0, 0, "P0", False), (1, 0, "P1", False)], "page_id long, ns int, title string, is_redirect boolean")
    rd = frame(spark, [], "rd_from long, rd_final long")
    targets = frame(spark, [(7, 14, "C"), (7, 0, "Red"), (8, 0, "P1"), (8, 14, "P1")], "lt_id long, ns int, title string")
    links = frame(spark, [(0, 0, 7), (0, 0, 8), (0, 0, 9)], "pl_from long, pl_from_ns int, lt_id long")
    got = sorted((r.dst or 0, r.reason) for r in resolve.resolve_links(links, targets, pages, rd).collect())
    assert got == [(0, "target_non_ns0")] * 3 + [(0, "target_redlink"), (1, "kept")]


def test_article_forces_keep_all_digits(spark):
    unit = frame(spark, [(5, 1, 0.25, 0.0, 0.0, 0, 3)], "page_id long, comm int, x double, y double, z double, int_deg long, ext_deg long")
    anchors = frame(spark, [(5, 1.0, 0.0, 0.0, 0.5)], "page_id long, dx double, dy double, dz double, conf double")
    galaxies = frame(spark, [(1, 30.0, 0.0, 0.0, 1.0)], "comm int, x double, y double, z double, radius double")
    got = geometry.article_forces(unit, anchors, galaxies, rounds=1).first()
    assert abs(got.x - (30 + 0.23 + 0.025 * (0.35 - 0.23))) < 1e-12


def test_pagelinks_of_all_orders(spark):
    w = wiki.Wiki(spark, "/root/testdata/sf0.001")
    lines = [(r.l_orderkey, r.l_linenumber) for r in spark.table("lineitem").select("l_orderkey", "l_linenumber").collect()]
    per = {}
    for order, line in lines:
        per.setdefault(order, []).append(line)
    links = sum(a < b for at in per.values() for a in at for b in at)
    assert w.pagelinks.where("lt_id < 1000000").count() == links
    assert w.pagelinks.where("lt_id >= 1000000").count() == sum(line == 1 for _, line in lines)


def test_community_invariants(spark):
    rng = np.random.default_rng(1)
    e = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 40, (150, 2)).tolist() if a != b}
    und = frame(spark, sorted(e), "u long, v long")
    memb = frame(spark, [(i, i % 4) for i in range(41)], "page_id long, comm int")
    per = community.per_community(und, memb).collect()
    cross = sum(a % 4 != b % 4 for a, b in e)
    assert sum(r.n_c for r in per) == 41
    assert sum(r.e_out for r in per) == 2 * cross
    assert sum(r.e_in for r in per) + cross == len(e)
    assert sum(r.w for r in community.pairs(und, memb).collect()) == cross


def test_weighted_median(spark):
    df = frame(spark, [(1.0, 1), (2.0, 1), (3.0, 5), (None, 9), (9.0, 0)], "v double, w int")
    assert community.weighted_median(df, "v", "w").first()[0] == 3.0


def test_sector_anchor_and_quantile(spark):
    cross = frame(spark, [(0, 0, 1, 3), (0, 0, 2, 1), (1, 0, 1, 2), (1, 0, 2, 2)], "page_id long, own int, g int, w long")
    centers = frame(spark, [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "comm int, x double, y double, z double")
    got = {r.page_id: r for r in layout.sector_anchor(cross, centers).collect()}
    assert (got[0].dx, got[0].dy, got[0].conf) == (1.0, 0.0, 0.75)
    assert abs(got[1].dx - 0.5**0.5) < 1e-12 and got[1].conf == 1.0
    q = layout.rank_quantile(frame(spark, [(0, 10, 0), (0, 0, 1), (0, 5, 2), (1, 7, 3)], "c int, v int, k int"), "c", "v", "k").orderBy("k").collect()
    assert [r.q for r in q] == [1.0, 0.0, 0.5, 0.0]


def test_bfs_cap(spark):
    edges = frame(spark, [(0, i) for i in range(1, 9)] + [(1, 20)], "src long, dst long")
    seeds = frame(spark, [(0,)], "page_id long")
    assert graph.bfs(edges, seeds, 2).count() == 10
    assert graph.bfs(edges, seeds, 1, cap=3).count() == 4


def test_top_neighbors(spark):
    got = {r.g: [(x.id, x.w) for x in r.top] for r in catalog.top_neighbors(frame(spark, [(0, 1, 5), (0, 2, 5), (1, 2, 1)], "a int, b int, w long"), 2).collect()}
    assert got == {0: [(1, 5), (2, 5)], 1: [(0, 5), (2, 1)], 2: [(0, 5), (1, 1)]}


def test_weighted_percentiles_work_out_their_input_once(spark):
    df = frame(spark, [(1.0, 1), (2.0, 1), (3.0, 5), (None, 9), (9.0, 0)], "v double, w int")
    got = community.weighted_percentiles(df, "v", "w", (0.1, 0.2, 0.5))
    assert [tuple(r) for r in got.collect()] == [(0.1, 1.0), (0.2, 2.0), (0.5, 3.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + got._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_parts_follow_the_input(spark, monkeypatch):
    monkeypatch.setattr(wiki, "PART_BYTES", 1 << 12)
    w = wiki.Wiki(spark, "/root/testdata/sf0.001")
    assert w.parts > 8 and w.und() is w.und()
    for df in (layout.cross_links(w.und(), w.memb), layout.cross_cap(w.und(), w.memb)):
        assert "RepartitionByExpression [page_id" in df._jdf.queryExecution().optimizedPlan().toString() and f", {w.parts}" in df._jdf.queryExecution().optimizedPlan().toString()
    assert w.und().count() == w.edges().where("src <> dst").selectExpr("least(src, dst)", "greatest(src, dst)").distinct().count()


def two_cliques(k=8):
    e = [(i, j) for c in (0, k) for i in range(c, c + k) for j in range(i + 1, c + k)] + [(0, k)]
    return 2 * k, *map(np.array, zip(*e, strict=True))


def test_louvain_and_subdivide():
    n, a, b = two_cliques()
    label = kernels.louvain(n, a, b, np.ones(len(a)))
    assert len(set(label)) == 2 and len(set(label[:8])) == 1
    assert (label == kernels.louvain(n, a, b, np.ones(len(a)))).all()
    chain = np.arange(59)
    parts = kernels.subdivide(60, chain, chain + 1, 4)
    assert np.bincount(parts).max() <= 8


def test_detect_beyond_one_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n, k = 240, 12
    ids = rng.permutation(n) * 7  # ids say nothing about communities
    e = {(min(a, b), max(a, b)) for a, b in ((ids[i], ids[j]) for i in range(n) for j in range(i) if rng.random() < (0.5 if i % k == j % k else 0.02))}
    und = frame(spark, [(int(a), int(b)) for a, b in sorted(e)], "u long, v long")
    articles = frame(spark, [(int(i),) for i in ids] + [(10_000,)], "page_id long")

    def quality():
        memb = solvers.detect(und, articles).collect()
        c = {r.page_id: r.comm for r in memb}
        assert len(memb) == len(c) == n + 1 and list(c.values()).count(c[10_000]) == 1
        m = len(e)
        volume = {}
        for a, b in e:
            for x in (c[a], c[b]):
                volume[x] = volume.get(x, 0) + 1
        return sum(c[a] == c[b] for a, b in e) / m - sum(v * v for v in volume.values()) / (4 * m * m)

    one_group = quality()
    monkeypatch.setattr(solvers, "LOCAL_EDGES", 400)
    assert quality() > one_group - 0.03


def test_detect_beyond_one_group_writes_few_tables(spark, monkeypatch):
    written = []
    for module in (solvers, blocks):
        monkeypatch.setattr(module, "cut", lambda df, put=module.cut: written.append(1) or put(df))
    monkeypatch.setattr(solvers, "LOCAL_EDGES", 100)
    monkeypatch.setattr(blocks, "BLOCK_ENDS", 150)
    n, a, b = two_cliques(12)
    und = frame(spark, list(zip(a.tolist(), b.tolist(), strict=True)), "u long, v long")
    articles = frame(spark, [(i,) for i in range(n + 1)], "page_id long")
    for gamma, objective in ((1.0, "modularity"), (0.1, "cpm")):
        c = {r.page_id: r.comm for r in solvers.detect(und, articles, gamma, objective).collect()}
        assert len(c) == n + 1 and {c[i] for i in range(12)} == {0} and {c[i] for i in range(12, n)} == {12} and c[n] == n
    assert len(written) <= 10  # tables, not rounds


def test_connected_parts_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ENDS", 20)
    edges = frame(spark, [(i, i + 1) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 260)], "u long, v long")
    owner = frame(spark, [(i, int(i >= 130)) for i in [*range(100, 161), *range(200, 261), 999]], "x long, c long")
    got = {r.x: r.c for r in solvers._connected(edges, owner).collect()}
    assert got == {**{i: 100 if i < 130 else 130 for i in range(100, 161)}, **{i: 200 for i in range(200, 261)}, 999: 999}


def test_layout_and_tile():
    n, a, b = two_cliques()
    p = kernels.force_layout(n, a, b, np.ones(len(a)))
    assert np.isfinite(p).all() and (np.sqrt((p**2).sum(1)) <= 1 + 1e-9).all()
    data = kernels.tile_bytes(p, np.stack([a, b], 1), np.empty((0, 3), int))
    assert len(data) == 12 + 12 * n + 8 * len(a)
    xyz, edges, _ = kernels.read_tile(data)
    assert np.allclose(xyz, p.astype("f4")) and (edges == np.stack([a, b], 1)).all()


def test_tiles_are_encoded_in_ranges(spark, monkeypatch):
    rng = np.random.default_rng(4)
    memb = frame(spark, [(i, i % 2) for i in range(60)], "page_id long, comm int")
    und = frame(spark, sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, (300, 2)).tolist() if a != b}), "u long, v long")
    placed = frame(spark, [(i, i % 2, i / 100, -i / 200, 0.1) for i in range(60)], "page_id long, comm int, x float, y float, z float")
    articles = frame(spark, [(i, "null" if i == 7 else None if i % 9 == 0 else f"Tïtle \"{i}\"") for i in range(60)], "page_id long, title string")
    whole = {r.comm: (bytes(r.tile), r.titles) for r in solvers.tiles(placed, und, memb, articles).collect()}
    monkeypatch.setattr(solvers, "TILE_NODES", 7)
    cut = solvers.tiles(placed, und, memb, articles)
    assert {r.comm: (bytes(r.tile), r.titles) for r in cut.collect()} == whole
    names = json.loads(whole[1][1])["t"]
    assert names[3] == "null" and names[4] == "local#4" and names[0] == 'Tïtle "1"'
    assert whole[1][1] == json.dumps({"t": names}, ensure_ascii=False)
    read = {r.comm: r for r in solvers.read_tiles(cut).collect()}
    assert read[0].n == 30 and not read[0].bad_size and read[0].bad_index == 0 and solvers.tile_rows(cut).count() == 60
    assert not any("Pandas" in line for line in cut._jdf.queryExecution().optimizedPlan().toString().splitlines())
