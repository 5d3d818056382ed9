"""A virtual wiki derived from the driver's tables: portable SQL that Spark and DuckDB both run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from linkloom.sources.scratch import dealt, marked

#: Tables kept on disk, by session, folder and name.
_kept: dict[tuple[SparkSession, str, str], DataFrame] = {}
#: Bytes of lineitem's files for one part of the links: about half a million lines, a million links.
PART_BYTES = 6 << 20
TABLES = ("part", "lineitem", "supplier", "pages", "documents")

VIEWS = {
    "w_page": "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 50 = 13 THEN 14 ELSE 0 END AS ns, concat('Page_', p_partkey) AS title, p_partkey % 20 IN (7, 8, 9, 10, 11) AS is_redirect, p_size AS size, CAST(substr(p_brand, 7) AS INT) AS brand FROM part",
    "w_redirect": """SELECT page_id AS rd_from, 0 AS rd_ns, '' AS interwiki, concat(CASE WHEN page_id % 20 = 9 THEN 'Missing_' ELSE 'Page_' END,
        page_id + CASE page_id % 20 WHEN 7 THEN -6 WHEN 8 THEN -1 WHEN 10 THEN 1 WHEN 11 THEN -1 ELSE 0 END) AS rd_title FROM w_page WHERE ns = 0 AND is_redirect""",
    "w_linktarget": "SELECT page_id AS lt_id, ns, title FROM w_page UNION ALL SELECT 1000000 + s_suppkey, 0, concat('Red_', s_suppkey) FROM supplier",
    "w_pagelinks": """SELECT a.l_partkey AS pl_from, CASE WHEN a.l_partkey % 50 = 13 THEN 14 ELSE 0 END AS pl_from_ns, b.l_partkey AS lt_id
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber < b.l_linenumber
        UNION ALL SELECT l_partkey, CASE WHEN l_partkey % 50 = 13 THEN 14 ELSE 0 END, 1000000 + l_suppkey FROM lineitem WHERE l_linenumber = 1""",
    "w_article": "SELECT page_id, title FROM w_page WHERE ns = 0 AND NOT is_redirect",
    "w_memb": "SELECT page_id, CAST(page_id % 25 AS INT) AS comm, CAST(page_id % 5 AS INT) AS macro FROM w_page WHERE ns = 0 AND NOT is_redirect",
    "w_category": "SELECT s_suppkey AS lt_id, concat('Category_', s_suppkey) AS title FROM supplier",
    "w_artcat": "SELECT DISTINCT l_partkey AS page_id, l_suppkey AS cat_lt, CASE l_returnflag WHEN 'A' THEN 'page' WHEN 'R' THEN 'subcat' ELSE 'file' END AS cl_type FROM lineitem",
}

#: What the engine's operators compute, as SQL for the oracle.
ORACLE_ONLY = {
    "w_next": "SELECT r.rd_from, p.page_id AS nxt FROM w_redirect r JOIN w_page p ON p.title = r.rd_title AND p.ns = 0",
    "w_chase": """SELECT rd_from, nxt AS cur, 1 AS hop FROM w_next UNION ALL
        SELECT c.rd_from, n.nxt, c.hop + 1 FROM w_chase c JOIN w_next n ON n.rd_from = c.cur WHERE c.hop < 10""",
    "w_rdmap": """SELECT r.rd_from, a.page_id AS rd_final FROM w_redirect r
        LEFT JOIN (SELECT rd_from, arg_max(cur, hop) AS cur FROM w_chase GROUP BY rd_from) l ON l.rd_from = r.rd_from
        LEFT JOIN w_article a ON a.page_id = l.cur""",
    "w_resolved": """SELECT pl_from AS src, CASE WHEN rd.rd_from IS NOT NULL THEN rd.rd_final ELSE tp.page_id END AS dst,
        CASE WHEN pl_from_ns <> 0 THEN 'from_non_ns0' WHEN sr.rd_from IS NOT NULL THEN 'src_is_redirect' WHEN sa.page_id IS NULL THEN 'src_not_article'
             WHEN lt.lt_id IS NULL OR lt.ns <> 0 THEN 'target_non_ns0' WHEN tp.page_id IS NULL THEN 'target_redlink'
             WHEN rd.rd_from IS NOT NULL AND rd.rd_final IS NULL THEN 'target_dangling_redirect'
             WHEN pl_from = CASE WHEN rd.rd_from IS NOT NULL THEN rd.rd_final ELSE tp.page_id END THEN 'self_loop' ELSE 'kept' END AS reason
        FROM w_pagelinks l LEFT JOIN w_redirect sr ON sr.rd_from = l.pl_from LEFT JOIN w_article sa ON sa.page_id = l.pl_from
        LEFT JOIN w_linktarget lt ON lt.lt_id = l.lt_id LEFT JOIN (SELECT * FROM w_page WHERE ns = 0) tp ON lt.ns = 0 AND tp.title = lt.title
        LEFT JOIN w_rdmap rd ON rd.rd_from = tp.page_id""",
    "w_edge": "SELECT src, dst FROM w_resolved WHERE reason = 'kept'",
    "w_und": "SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM w_edge",
    "w_deg": "SELECT a.page_id, count(e.n) AS deg FROM w_article a LEFT JOIN (SELECT u AS n FROM w_und UNION ALL SELECT v FROM w_und) e ON e.n = a.page_id GROUP BY a.page_id",
    "w_mu": "SELECT u, v, a.comm AS cu, b.comm AS cv FROM w_und JOIN w_memb a ON a.page_id = u JOIN w_memb b ON b.page_id = v",
    "w_pairs": "SELECT least(cu, cv) AS a, greatest(cu, cv) AS b, count(*) AS w FROM w_mu WHERE cu <> cv GROUP BY 1, 2",
    "w_comm": """SELECT m.comm, m.n_c, coalesce(i.e_in, 0) AS e_in, coalesce(o.e_out, 0) AS e_out, coalesce(b.nb, 0) AS boundary
        FROM (SELECT comm, count(*) AS n_c FROM w_memb GROUP BY comm) m
        LEFT JOIN (SELECT cu AS comm, count(*) AS e_in FROM w_mu WHERE cu = cv GROUP BY 1) i ON i.comm = m.comm
        LEFT JOIN (SELECT comm, count(*) AS e_out FROM (SELECT cu AS comm FROM w_mu WHERE cu <> cv UNION ALL SELECT cv FROM w_mu WHERE cu <> cv) GROUP BY comm) o ON o.comm = m.comm
        LEFT JOIN (SELECT comm, count(DISTINCT n) AS nb FROM (SELECT cu AS comm, u AS n FROM w_mu WHERE cu <> cv UNION ALL SELECT cv, v FROM w_mu WHERE cu <> cv) GROUP BY comm) b ON b.comm = m.comm""",
    "w_pos": "SELECT comm, CAST(comm % 5 AS INT) AS macro, comm * 1.5::DOUBLE AS x, (comm * 7 % 11) * 2.0::DOUBLE AS y, (comm * 3 % 7) * 1.0::DOUBLE AS z, 1.0::DOUBLE + comm % 4 AS radius FROM (SELECT DISTINCT comm FROM w_memb)",
}


def ctes() -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in {**VIEWS, **ORACLE_ONLY}.items()) + "\n"


def oracle(body: str) -> str:
    return ctes() + body


class Wiki:
    """The base views of one scale as DataFrames; what derives from links is worked out by the operators."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        lines = spark.table("lineitem")
        size = int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
        for name, sql in VIEWS.items():
            spark.sql(sql).createOrReplaceTempView(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or f"w_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.spark.table(f"w_{name}")

    def rdmap(self) -> DataFrame:
        from linkloom.operators import resolve

        return resolve.redirect_map(self.redirect, self.page)

    def links(self) -> DataFrame:
        """w_pagelinks over lines that are dealt out by order, into parts that follow the input; they need no other exchange."""
        dealt(self.spark.table("lineitem"), self.parts, "l_orderkey").createOrReplaceTempView("lineitem_by_order")
        return marked(self.spark.sql(VIEWS["w_pagelinks"].replace("lineitem", "lineitem_by_order")), self.parts)

    def _keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table kept on disk for the session: the queries stand for stages that read a written table."""
        if (kept := _kept.get((self.spark, self.sf_dir, name))) is None:
            kept = _kept[self.spark, self.sf_dir, name] = make()
        if not kept.storageLevel.useDisk:  # new, or the session's cache was cleared
            kept.persist(StorageLevel.DISK_ONLY)
        return marked(kept, self.parts)

    def resolved(self) -> DataFrame:
        from linkloom.operators import resolve

        return self._keep("resolved", lambda: resolve.resolve_links(self.links(), self.linktarget, self.page, self.rdmap()))

    def edges(self) -> DataFrame:
        return marked(self.resolved().where("reason = 'kept'").select("src", "dst"), self.parts)

    def und(self) -> DataFrame:
        from linkloom.operators import graph

        return self._keep("und", lambda: graph.undirected(self.edges()))

    def pos(self) -> DataFrame:
        return self.memb.select("comm").distinct().selectExpr("comm", "CAST(comm % 5 AS INT) AS macro", "comm * 1.5D AS x", "(comm * 7 % 11) * 2.0D AS y", "(comm * 3 % 7) * 1.0D AS z", "1.0D + comm % 4 AS radius")
