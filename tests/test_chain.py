"""From dump files to tiles and audits, with the counts that the made-up dumps must give."""

import bz2
import gzip
import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom import __main__ as cli
from linkloom.operators import audit, geometry, graph, kernels, layout, resolve
from linkloom.plans import analysis, canonical, publish, solvers, stages
from linkloom.plans.stages import Store, execute
from linkloom.sources import arrays, dumps


def sql(text):
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dump(folder, table, rows, per_line=7):
    """Rows of SQL values as INSERT lines in a gzip file."""
    with gzip.open(f"{folder}/wiki-{table}.sql.gz", "wt", encoding="utf-8") as f:
        f.write(f"-- {table}\nCREATE TABLE `{table}` (x);\n")
        for lo in range(0, len(rows), per_line):
            f.write(f"INSERT INTO `{table}` VALUES " + ",".join("(" + ",".join(map(str, r)) + ")" for r in rows[lo : lo + per_line]) + ";\n")


TITLES = {1000: "東京_(曖昧さ回避)", 1001: "日本の鉄道駅一覧", 1002: "2024年", 1003: "テスト'記事"}


@pytest.fixture(scope="module")
def wiki(tmp_path_factory):
    """Sixty articles in three chains, redirects (direct, chained, dangling), one link for each reason to drop one."""
    base = tmp_path_factory.mktemp("wiki")
    folder = base / "dumps"
    folder.mkdir()
    title = {i: TITLES.get(i, f"Article_{i}") for i in range(1000, 1060)}
    page = [(i, 0, title[i], 0) for i in title] + [(2000 + k, 0, f"Redirect_{k}", 1) for k in range(4)] + [(2004, 1, "Talk", 1), (3000, 1, "Talk_2", 0), (3001, 14, "Cats", 0), (3002, 14, "Dogs", 0)]
    dump(folder, "page", [(i, ns, sql(t), r, 0, 0.25, "'2026'", "NULL", 1, 1, "'wikitext'", "NULL") for i, ns, t, r in page])
    targets = [(0, t) for t in title.values()] + [(0, f"Redirect_{k}") for k in range(4)] + [(0, f"Missing_{k}") for k in range(3)] + [(14, "Cats"), (14, "Dogs"), (1, "Talk_2")]
    lt = {t: n + 1 for n, t in enumerate(targets)}
    dump(folder, "linktarget", [(n, ns, sql(t)) for (ns, t), n in lt.items()])
    dump(folder, "redirect", [(2000, 0, sql(title[1000]), "''", "''"), (2001, 0, sql(title[1001]), "''", "''"), (2002, 0, sql("Redirect_0"), "NULL", "''"), (2003, 0, sql("Missing_0"), "''", "''"), (2004, 1, sql("Elsewhere"), "''", "''")])
    to = lambda t, ns=0: lt[ns, t]
    links = [(c + k, 0, to(title[c + k + 1])) for c in (1000, 1020, 1040) for k in range(19)]
    links += [(1000, 0, to(title[1020])), (1020, 0, to(title[1040])), (1040, 0, to(title[1000])), (1059, 0, to(title[1003]))]
    links += [(1010, 0, to("Redirect_0")), (1011, 0, to("Redirect_2")), (1012, 0, to(title[1003]))]
    links += [(3000, 1, to(title[1000])), (3001, 14, to(title[1001])), (2000, 0, to(title[1000])), (1005, 0, to("Missing_1")), (1006, 0, to("Redirect_3")), (1000, 0, to("Redirect_0")), (1007, 0, to("Cats", 14))]
    dump(folder, "pagelinks", links, 11)
    cats = [(1000, "page", "Cats"), (1001, "page", "Cats"), (1004, "page", "Cats"), (1002, "page", "Dogs"), (1003, "page", "Dogs"), (2000, "page", "Cats"), (3001, "subcat", "Dogs"), (1010, "file", "Cats")]
    dump(folder, "categorylinks", [(i, sql("K'\\" + str(i)), "'2026-01-01 00:00:00'", "''", f"'{kind}'", 1, to(c, 14)) for i, kind, c in cats])
    text = f"[[{title[1001]}|x]] [[article 1004]] [[Article 1005#s]] [[Article 1005]] [[{title[1000]}]] [[Category:Cats]] [[en:Tokyo]] <!-- [[Article_1006]] --> <nowiki>[[Article_1007]]</nowiki> <includeonly>[[Article_1008]]</includeonly> {{{{x|[[Article_1009]]}}}} <ref>[[Article_1011]]</ref> [[Red link]] [[Redirect 2|r]]"
    escaped = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    entry = lambda i, ns, t, body, rd="": f"<page><title>{t}</title><ns>{ns}</ns><id>{i}</id>{rd}<revision><id>1</id><text xml:space=\"preserve\">{body}</text></revision></page>"
    xml = "<mediawiki>" + entry(1000, 0, "A", escaped) + entry(1001, 0, "B", "[[Article_1004]]") + entry(1002, 0, "C", "") + entry(3000, 1, "T", "[[Article_1004]]") + entry(2000, 0, "R", "[[Article_1004]]", '<redirect title="A"/>') + "</mediawiki>"
    (folder / "wiki-pages-articles.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    return base


@pytest.fixture(scope="module")
def store(spark, wiki):
    store = Store(spark, str(wiki))
    code, manifest = execute(store, ["parse_page", "parse_linktarget", "parse_redirect", "parse_pagelinks", "parse_categorylinks"])
    assert code == 0, manifest
    code, manifest = execute(store, ["all"], {"shared": {"cross_cap": 4}}, ["subdivide.max_galaxy=12", "subdivide.min_size=4"])
    assert code == 0, manifest
    return store


def test_counts(store):
    reasons = {r.reason: r["count"] for r in store.read("resolved").groupBy("reason").count().collect()}
    assert reasons == {"kept": 64, "from_non_ns0": 2, "src_is_redirect": 1, "target_redlink": 1, "target_dangling_redirect": 1, "self_loop": 1, "target_non_ns0": 1}
    assert {(r.rd_from, r.rd_final) for r in store.read("rdmap").collect()} == {(2000, 1000), (2001, 1001), (2002, 1000), (2003, None)}
    assert {r.title for r in store.read("page").where("page_id < 1004").collect()} == set(TITLES.values())
    cats = store.read("category").collect()
    assert sorted((r.cat_id, r.title) for r in cats) == [(0, "Cats"), (1, "Dogs")]
    assert sorted((r.page_id, r.cat_id) for r in store.read("artcat").collect()) == [(1000, 0), (1001, 0), (1002, 1), (1003, 1), (1004, 0)]
    reasons = {r.reason: r.n for r in dumps.category_counters(store.read("categorylinks"), store.read("category"), canonical.articles(store.read("page"))).collect()}
    assert reasons == {"kept": 5, "not_article": 1, "subcat": 1, "file": 1}


def test_body_links(spark, store, wiki):
    assert execute(store, ["body_edges"])[0] == 0
    rows = store.read("body_resolved").collect()
    count = lambda reason: sum(r.reason == reason for r in rows)
    assert (count("prefixed"), count("target_redlink"), count("duplicate"), count("self_loop")) == (2, 1, 1, 2)
    assert sorted((r.src, r.dst) for r in rows if r.reason == "kept") == [(1000, 1001), (1000, 1004), (1000, 1005), (1000, 1009), (1000, 1011), (1001, 1004)]
    pages = dumps.read_pages_xml(spark, str(wiki / "dumps" / "*.xml.bz2"))
    assert pages.count() == 5
    stripped = resolve.body_link_reasons(resolve.text_links(pages, strip_refs=True), store.read("page"), store.read("rdmap"))
    assert stripped.where("reason = 'kept'").count() == 5


def test_catalog_and_layout(store):
    galaxies = store.read("galaxies").collect()
    assert sum(r.n_articles for r in galaxies) == 60 and {r.galaxy_id for r in galaxies} == set(range(len(galaxies)))
    assert {r.name_source for r in galaxies} <= {"category", "category_stem", "rep", "none"} and all(r.n_articles <= 12 for r in galaxies)
    assert sum(r.n_articles for r in store.read("macros").collect()) == 60
    assert audit.spill_rows(store.read("galaxy_positions"), store.read("macro_positions")).count() == 0
    placed = store.read("article_positions")
    assert placed.count() == 60 and placed.where("isnan(x) OR x IS NULL").count() == 0
    inside = placed.join(store.read("galaxy_positions").select("comm", F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"), "radius"), "comm")
    assert inside.where("sqrt(power(x - gx, 2) + power(y - gy, 2) + power(z - gz, 2)) > radius * 1.001 + 0.01").count() == 0


def test_published_files(store, wiki):
    boot = arrays.read_json(f"{wiki}/spatial/bootstrap.json")
    assert boot["meta"]["n_articles"] == 60 and boot["meta"]["schema_version"] == 1 and len(boot["galaxies"]) == boot["meta"]["n_galaxies"]
    memb = {r.page_id: r.comm for r in store.read("membership").collect()}
    local, members = {}, {}
    for p in sorted(memb):
        members.setdefault(memb[p], []).append(p)
    for c, ps in members.items():
        local |= {p: (c, k) for k, p in enumerate(ps)}
    und = {(r.u, r.v) for r in store.read("und").collect()}
    inner = set()
    for c, ps in members.items():
        data = (wiki / "spatial" / "tiles" / f"gal_{c:06d}.bin").read_bytes()
        xyz, edges, cross = kernels.read_tile(data)
        assert len(xyz) == len(ps) == boot["galaxies"][c][6]
        inner |= {(ps[a], ps[b]) for a, b in edges.tolist()}
        for a, g, b in cross.tolist():
            u, v = ps[a], members[g][b]
            assert (min(u, v), max(u, v)) in und and g != c
        names = json.loads((wiki / "spatial" / "tiles" / f"gal_{c:06d}.json").read_text())["t"]
        assert len(names) == len(ps) and "" not in names
    assert inner == {(u, v) for u, v in und if memb[u] == memb[v]}


def test_audits(store):
    code, manifest = execute(store, ["audit_tiles", "audit_names", "audit_labels", "audit_layout"])
    assert code == 0, manifest
    tiles = store.read("audit_tiles").first()
    assert tiles.articles == 60 and tiles.missing == tiles.bad_size == tiles.bad_header == tiles.titles_short == 0
    assert store.read("audit_layout").first().n_spill == 0


def test_skip_force_and_ledger(store, wiki):
    steps = stages.plan(store, ["all"])
    assert {status for s, status, _ in steps if not s.always} == {"skip"}
    assert "skip" in stages.format_plan(steps)
    store.write("und", store.read("und").localCheckpoint())
    assert {s.name: status for s, status, _ in stages.plan(store, ["detect", "stats"])} == {"detect": "run", "stats": "skip"}
    assert len(list((wiki / "manifests").glob("*.json"))) >= 2
    assert stages.run_name("20260101_first") == "20260101_first"
    for bad in ("", "..", "a/b", "/x", " x"):
        with pytest.raises(ValueError):
            stages.run_name(bad)


def test_command_line(store, wiki, capsys):
    assert cli.main(["stages"]) == 0 and "layout_global" in capsys.readouterr().out
    assert cli.main(["plan", "edges", "--base", str(wiki)]) == 0 and capsys.readouterr().out.startswith(("skip", "run"))
    assert cli.main(["run", "stats", "--base", str(wiki), "--force"]) == 0
    assert cli.main(["run", "wrong", "--base", str(wiki)]) == 2
    assert cli.main(["run", "prune", "--base", str(wiki), "--set", "prune.nothing=1"]) != 0
    assert cli.main(["analyze", "--base", str(wiki), "--size", "30", "--resolutions", "0.5,1"]) == 0
    assert "# subset" in (wiki / "report.md").read_text()


def test_subset_of_last_twenty(store):
    page = canonical.articles(store.read("page"))
    nodes = graph.id_window(page, 20).select("page_id")
    out = analysis.analyze(canonical.kept(store.read("resolved")), nodes, page, (1.0,), degree_budget=40)
    leaks = out["tables"]["leaks"].first()
    assert (leaks.n_internal, leaks.n_out, leaks.n_in) == (19, 2, 1)
    assert out["tag"] == "res1" and "## hubs" in out["report"]


# Files


def test_pairs_and_arrays(spark, tmp_path):
    arrays.register(spark)
    rows = [(i, i * 7 % 1000) for i in range(5000)]
    spark.createDataFrame(rows, "src int, dst int").repartition(3).write.format("int32pairs").mode("append").save(str(tmp_path / "pairs"))
    parts = sorted((tmp_path / "pairs").glob("part-*.bin"))
    assert len(parts) == 3
    got = {tuple(r) for p in parts for r in spark.read.format("int32pairs").load(str(p)).collect()}
    assert got == set(rows)
    for values in (np.arange(10, dtype="<i4"), np.linspace(0, 1, 7), np.array([True, False])):
        np.save(tmp_path / "a.npy", values)
        assert [r.value for r in spark.read.format("npy").load(str(tmp_path / "a.npy")).orderBy("idx").collect()] == values.tolist()
    np.savez(tmp_path / "z.npz", a=np.arange(5), b=np.arange(3) / 2)
    assert [r.value for r in spark.read.format("npy").option("key", "b").load(str(tmp_path / "z.npz")).orderBy("idx").collect()] == [0, 0.5, 1]
    assert arrays.save_npy(spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") * 2).alias("value")), str(tmp_path / "s.npy")) == 1000
    assert np.load(tmp_path / "s.npy").tolist() == list(range(0, 2000, 2))


def test_json_and_digests(spark, tmp_path):
    arrays.write_json(f"{tmp_path}/x/a.json", {"名": 1, "path": tmp_path})
    assert arrays.read_json(f"{tmp_path}/x/a.json")["名"] == 1
    (tmp_path / "old.json").write_bytes('{"名": "東京"}'.encode("cp932"))
    assert arrays.read_json(f"{tmp_path}/old.json") == {"名": "東京"} and arrays.read_json(f"{tmp_path}/none.json", 5) == 5
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert arrays.sha256_of(f"{tmp_path}/f.bin") == "ba7816bf8f01cfea" == arrays.file_digests(spark, f"{tmp_path}/f.bin").first().sha256
    assert arrays.sha256_of(f"{tmp_path}/f.bin", 2) == arrays.hashlib.sha256(b"ab").hexdigest()[:16]


def test_download(tmp_path):
    data = bytes(range(256)) * 50

    class Ranges(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if "missing" in self.path:
                return self.send_error(404)
            first = int(self.headers.get("Range", "bytes=0-")[6:-1])
            if first >= len(data):
                return self.send_error(416)
            self.send_response(206 if first else 200)
            self.send_header("Content-Length", str(len(data) - first))
            self.end_headers()
            self.wfile.write(data[first:])

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    (tmp_path / "a.gz").write_bytes(data[:1000])
    assert arrays.download(f"{url}/a.gz", f"{tmp_path}/a.gz") == len(data) and (tmp_path / "a.gz").read_bytes() == data
    assert arrays.download(f"{url}/a.gz", f"{tmp_path}/a.gz") == len(data)
    wrong = arrays.download_all([f"{url}/b.gz", f"{url}/missing.gz"], f"{tmp_path}/all")
    assert (tmp_path / "all" / "b.gz").read_bytes() == data and list(wrong) == [f"{url}/missing.gz"]
    server.shutdown()


# Solvers and geometry


def test_relax_and_cone():
    p = geometry.relax(np.zeros((12, 3)), np.full(12, 5.0), 200)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))[np.triu_indices(12, 1)]
    assert d.min() >= 10.2 * 0.99
    axis = np.array([0.0, 0.6, 0.8])
    for key in range(200):
        way, depth = geometry.cone(axis, key)
        assert abs(np.linalg.norm(way) - 1) < 1e-9 and way @ axis >= np.cos(geometry.CONE) - 1e-9 and 0.35 <= depth <= 0.95
    assert geometry.overlap(np.array([[0.0, 0, 0], [3, 0, 0]]), np.array([1.0, 1.0])) == 0


def test_force_layout_sizes():
    rng = np.random.default_rng(1)
    for n in (2, 40, 2500):
        a = np.arange(n - 1)
        p = kernels.force_layout(n, a, a + 1, np.ones(n - 1), seed=3)
        assert np.isfinite(p).all() and (np.sqrt((p**2).sum(1)) <= 1.0001).all()
        assert np.array_equal(p, kernels.force_layout(n, a, a + 1, np.ones(n - 1), seed=3))
    near = np.sqrt(((p[a] - p[a + 1]) ** 2).sum(1)).mean()
    other = rng.integers(0, n, (2000, 2))
    assert near < 0.3 * np.sqrt(((p[other[:, 0]] - p[other[:, 1]]) ** 2).sum(1)).mean()


def test_cpm_finds_cliques(spark):
    edges = [(c + i, c + j) for c in (0, 10, 20) for i in range(5) for j in range(i)] + [(0, 10), (10, 20)]
    und = spark.createDataFrame([(min(e), max(e)) for e in edges], "u long, v long")
    nodes = spark.createDataFrame([(c + i,) for c in (0, 10, 20) for i in range(5)], "page_id long")
    for objective, gamma in (("cpm", 0.5), ("modularity", 1.0)):
        found = {}
        for r in solvers.detect(und, nodes, gamma, objective).collect():
            found.setdefault(r.comm, set()).add(r.page_id)
        assert sorted(map(sorted, found.values())) == [[c + i for i in range(5)] for c in (0, 10, 20)]


def test_large_graphs_are_cut_in_rounds(spark, monkeypatch):
    """A limit that one community exceeds: detect and subdivide must still give connected parts of all nodes."""
    rng = np.random.default_rng(5)
    edges = {tuple(sorted((int(c * 50 + i), int(c * 50 + j)))) for c in range(8) for i, j in rng.integers(0, 50, (200, 2)) if i != j} | {(c * 50, c * 50 + 50) for c in range(7)}
    und = spark.createDataFrame(sorted(edges), "u long, v long")
    nodes = spark.range(400).select(F.col("id").alias("page_id"))
    whole = spark.createDataFrame([(i, 0) for i in range(400)], "page_id long, comm int")
    monkeypatch.setattr(solvers, "LOCAL_EDGES", 300)
    for objective, gamma in (("modularity", 1.0), ("cpm", 0.05)):
        memb = solvers.detect(und, nodes, gamma, objective)
        assert memb.count() == 400 and memb.select("page_id").distinct().count() == 400
        assert memb.select("comm").distinct().count() >= 8
    parts = solvers.subdivide(und, whole, 60)
    assert parts.select("page_id").distinct().count() == 400
    assert parts.groupBy("comm", "part").count().agg(F.max("count")).first()[0] <= 60


def test_layout_audit_finds_planted_spill(spark):
    macros = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 50.0), (1, 500.0, 0.0, 0.0, 50.0)], "macro_id int, x double, y double, z double, radius double")
    bodies = [(0, 0, 45.0, 0.0, 0.0, 10.0, "galaxy"), (1, 0, -20.0, 0.0, 0.0, 5.0, "medium")] + [(10 + k, 1, 500.0 + 10 * np.cos(k), 10 * np.sin(k * 1.7), 0.001 * (k % 3), 1.0, "galaxy") for k in range(12)]
    own = spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in b) for b in bodies], "comm int, macro int, x double, y double, z double, radius double, display_class string")
    (spill,) = audit.spill_rows(own, macros).collect()
    assert (spill.comm, round(spill.ratio, 3), round(spill.excess, 3)) == (0, 1.1, 5.0)
    shapes = {r.macro: r for r in audit.macro_shapes(own, spark.createDataFrame([(10, 11, 5)], "a int, b int, w long")).collect()}
    assert shapes[1].flat > 0.95 and shapes[1].true_disk and shapes[1].n_unlinked == 10 and shapes[0].flat is None
    frames = layout.view_frames(spark, 5)
    assert frames.count() == 8 and layout.projection_overlap(own, frames).where("overlap < 0").count() == 0


def test_report_and_preview(spark):
    page = publish.report("T", {"a": spark.createDataFrame([(1, None, 0.123456)], "x int, y string, z double"), "b": {"k": 12345}, "c": "text"})
    assert "| 1 | - | 0.1235 |" in page and "- k: 12,345" in page
    html = publish.preview(spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0, 4.0)], "comm int, macro int, x double, y double, z double, radius double"))
    assert "[1.0, 2.0, 3.0, 4.0, 0.0]" in html
    bins = publish.histogram(spark.range(100), "id", 0, 100, 4).orderBy("bin").collect()
    assert [r.n for r in bins] == [25, 25, 25, 25]
