"""Checks of published tiles, names and layouts: counts and lists, nothing is changed."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import layout

# Patterns of maintenance labels that must equal those of the data's conventions for right results.
SUSPECT = {
    "stub": r"スタブ",
    "disambiguation": r"曖昧さ回避",
    "list": r"一覧",
    "page_name": r"記事名|^(記事|語句|単語)(の一覧|$)",
    "people": r"存命人物|人物の一覧|^姓$|^名$",
    "identifier": r"(?i)識別子|ISBN|ISSN|DOI|NDL|VIAF|LCCN|CiNii|GND|allcinema|titlestyle",
    "year": r"^\p{Nd}{1,4}年|^(昭和|平成|大正|明治|慶応|江戸時代|\p{Nd}{1,2}世紀)$",
    "map": r"座標|Kartographer|地図",
    "wikidata": r"ウィキデータ",
}
SPILL = 1.02


def class_by_source(galaxies: DataFrame) -> DataFrame:
    """(display_class, category, category_stem, rep, none): galaxies of each class by where their name is from."""
    return galaxies.groupBy("display_class").pivot("name_source", ["category", "category_stem", "rep", "none"]).agg(F.count(F.lit(1))).fillna(0)


def suspect_names(galaxies: DataFrame) -> DataFrame:
    """(label, n_galaxies, n_articles) of names that look like maintenance labels; one name may count under several."""
    hits = F.filter(F.array(*[F.when(F.col("name").rlike(p), F.lit(k)) for k, p in SUSPECT.items()]), lambda x: x.isNotNull())
    return galaxies.where("name <> ''").select("n_articles", F.explode(hits).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_galaxies"), F.sum("n_articles").alias("n_articles"))


def label_template(galaxies: DataFrame, macros: DataFrame, k: int = 5) -> DataFrame:
    """(macro_id, n_articles, default_label, top): what a curator of macro labels starts from; top: names of the k largest named galaxies."""
    named = galaxies.where("display_class <> 'dust' AND name <> ''").withColumn("r", F.row_number().over(Window.partitionBy("macro_id").orderBy(F.desc("n_articles"), "galaxy_id"))).where(F.col("r") <= k)
    top = named.groupBy("macro_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("top"))
    label = F.coalesce(F.nullif(F.left(F.trim(F.get("rep_titles", F.lit(0))), F.lit(16)), F.lit("")), F.concat(F.lit("macro "), "macro_id"))
    return macros.where("n_articles > 1").select("macro_id", "n_articles", label.alias("default_label")).join(top, "macro_id", "left")


def tile_counts(read: DataFrame, galaxies: DataFrame) -> DataFrame:
    """One row over the tiles read again beside the galaxies (comm, n) there should be: missing ones, wrong sizes and headers,
    indices out of range, titles missing, empty or made up, and the totals."""
    j = galaxies.select("comm", F.col("n").alias("want")).join(read, "comm", "left")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if("bad_size").alias("bad_size"), F.count_if(F.col("n") != F.col("want")).alias("bad_header"), z("bad_index").alias("bad_index"),
        z(F.greatest(F.lit(0), F.col("n") - F.col("n_titles"))).alias("titles_short"), z("n_empty").alias("titles_empty"), z("n_local").alias("titles_local"),
        z("n").alias("articles"), z("n_edges").alias("inner_edges"), z("n_cross").alias("cross_edges"), z("bytes").alias("bytes"),
    )


def spill_rows(galaxies: DataFrame, macros: DataFrame) -> DataFrame:
    """(comm, macro, ratio, excess): galaxies (comm, macro, x, y, z, radius, display_class) that reach beyond SPILL of their macro's ball, dust aside."""
    m = macros.select(F.col("macro_id").alias("macro"), *[F.col(c).alias("m" + c) for c in "xyz"], F.col("radius").alias("room"))
    d = F.sqrt(sum(((F.col(c) - F.col("m" + c)) ** 2 for c in "yz"), (F.col("x") - F.col("mx")) ** 2))
    j = galaxies.where("display_class <> 'dust'").join(m, "macro").withColumn("ratio", (d + F.col("radius")) / F.greatest("room", F.lit(1e-9))).withColumn("excess", d + F.col("radius") - F.col("room"))
    return j.where((F.col("room") > 0) & (F.col("ratio") > SPILL)).select("comm", "macro", "ratio", "excess")


@lru_cache(maxsize=4096)
def null_flatness(n: int, samples: int = 200, seed: int = 12345) -> tuple[float, float]:
    """Mean and 90th percentile of the flatness of n places drawn alike in all directions: what a small group shows by chance."""
    rng = np.random.default_rng(seed)
    values = []
    for _ in range(samples):
        low, _, high = np.linalg.eigvalsh(np.cov(rng.normal(size=(n, 3)).T))
        values.append(1 - max(low, 0.0) / high)
    return round(float(np.mean(values)), 5), round(float(np.percentile(values, 90)), 5)


def macro_shapes(galaxies: DataFrame, pairs: DataFrame) -> DataFrame:
    """(macro, n, flat, null_mean, null_p90, true_disk, n_medium, n_unlinked, bary_share) of each macro's galaxies without dust.

    flat is null below four galaxies; true_disk: flatter than nine in ten groups of that size by chance. Unlinked
    are galaxies without a pair of two galaxies of their macro. The chance figures are worked out once per size.
    """
    own = galaxies.where("display_class <> 'dust'")
    reg = own.where("display_class = 'galaxy'").select("comm", "macro")
    a, b = reg.select(F.col("comm").alias("a"), F.col("macro").alias("ma")), reg.select(F.col("comm").alias("b"), F.col("macro").alias("mb"))
    linked = pairs.join(a, "a").join(b, "b").where("ma = mb").select(F.explode(F.array("a", "b")).alias("comm")).distinct().withColumn("linked", F.lit(True))
    kinds = own.join(linked, "comm", "left").groupBy("macro").agg(F.count_if(F.col("display_class") == "medium").alias("n_medium"), F.count_if((F.col("display_class") == "galaxy") & F.col("linked").isNull()).alias("n_unlinked"))
    flat = layout.flatness(own, "macro", 4)

    def chance(batches):
        for df in batches:
            null = [null_flatness(int(n)) if n >= 3 else (None, None) for n in df.n]
            yield df.assign(null_mean=[x for x, _ in null], null_p90=[x for _, x in null])

    sizes = flat.select("n").distinct().mapInPandas(chance, "n long, null_mean double, null_p90 double")
    j = flat.join(sizes, "n").join(kinds, "macro")
    return j.select("macro", "n", "flat", "null_mean", "null_p90", F.coalesce(F.col("flat") > F.col("null_p90"), F.lit(False)).alias("true_disk"), "n_medium", "n_unlinked", ((F.col("n_medium") + F.col("n_unlinked")) / F.col("n")).alias("bary_share"))


def layout_summary(galaxies: DataFrame, macros: DataFrame, pairs: DataFrame, least: int = 8) -> DataFrame:
    """One row: galaxies audited, spills, mean and 90th percentile of flatness over macros of least galaxies or more, true discs,
    and how flatness goes with the share of galaxies placed at the mean of their partners."""
    shapes = macro_shapes(galaxies, pairs)
    some = F.col("n") >= least
    flat = shapes.agg(F.count_if(some & F.col("flat").isNotNull()).alias("n_flat"), F.avg(F.when(some, F.col("flat"))).alias("flat_mean"), F.percentile(F.when(some, F.col("flat")), 0.9).alias("flat_p90"), F.count_if("true_disk").alias("n_true_disk"), F.corr("flat", "bary_share").alias("corr_flat_bary"), F.avg("bary_share").alias("bary_share_mean"))
    n = galaxies.where("display_class <> 'dust'").agg(F.count(F.lit(1)).alias("n_audited"))
    return n.crossJoin(spill_rows(galaxies, macros).agg(F.count(F.lit(1)).alias("n_spill"))).crossJoin(flat)


def telemetry(seconds: DataFrame) -> DataFrame:
    """(n, p50, p95, max, mean) of a column of seconds."""
    return seconds.agg(F.count("seconds").alias("n"), F.round(F.percentile("seconds", 0.5), 4).alias("p50"), F.round(F.percentile("seconds", 0.95), 4).alias("p95"), F.round(F.max("seconds"), 4).alias("max"), F.round(F.avg("seconds"), 4).alias("mean"))
