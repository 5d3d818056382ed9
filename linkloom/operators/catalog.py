"""The star schema: galaxies, macros and their pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def containment(memb: DataFrame) -> DataFrame:
    """(comm, macro_id, n_macros): the macro of a galaxy, -1 if its nodes are in several."""
    g = memb.groupBy("comm").agg(F.countDistinct("macro").alias("n_macros"), F.min_by("macro", "page_id").alias("first"))
    return g.select("comm", F.when(F.col("n_macros") > 1, -1).otherwise(F.col("first")).alias("macro_id"), "n_macros")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("o"), "w"), F.struct(F.col("b").alias("g"), F.col("a").alias("o"), "w"))).alias("p")).select("p.*")


def top_neighbors(pairs: DataFrame, k: int = 8) -> DataFrame:
    """(g, n_neighbors, top): the k neighbours of most edges, ties by id."""
    w = Window.partitionBy("g")
    ranked = both_ways(pairs).withColumn("r", F.row_number().over(w.orderBy(F.desc("w"), "o"))).withColumn("n_neighbors", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("r") <= k).groupBy("g").agg(F.first("n_neighbors").alias("n_neighbors"), F.transform(F.array_sort(F.collect_list(F.struct("r", "o", "w"))), lambda x: F.struct(x["o"].alias("id"), x["w"].alias("w"))).alias("top"))


def top_galaxies(galaxies: DataFrame, k: int = 5) -> DataFrame:
    """(macro_id, r, galaxy_id): the k largest galaxies of each macro, without dust."""
    r = F.row_number().over(Window.partitionBy("macro_id").orderBy(F.desc("n_articles"), "galaxy_id"))
    return galaxies.where("n_articles > 1").withColumn("r", r).where(F.col("r") <= k).select("macro_id", "r", "galaxy_id")


def macro_pairs(pairs: DataFrame, to_macro: DataFrame) -> DataFrame:
    a, b = to_macro.select(F.col("comm").alias("a"), F.col("macro_id").alias("ma")), to_macro.select(F.col("comm").alias("b"), F.col("macro_id").alias("mb"))
    j = pairs.join(a, "a").join(b, "b").where("ma <> mb")
    return j.groupBy(F.least("ma", "mb").alias("macro_a"), F.greatest("ma", "mb").alias("macro_b")).agg(F.sum("w").alias("w"))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.orderBy(F.desc("w"), "a", "b").limit(k)


def search(titles: DataFrame, text: str, k: int = 12) -> DataFrame:
    """(id, name) by prefix, then by substring, whatever the case."""
    name, q = F.lower("name"), text.lower()
    return titles.where(name.contains(q)).withColumn("rank", F.when(name.startswith(q), 0).otherwise(1)).orderBy("rank", "id").limit(k).select("id", "name")


def labels(galaxies: DataFrame, overrides: DataFrame, length: int = 16) -> DataFrame:
    """(galaxy_id, label): a non-empty override, else the start of the first representative title."""
    j = galaxies.join(overrides.select("galaxy_id", F.nullif(F.trim("label"), F.lit("")).alias("over")), "galaxy_id", "left")
    return j.select("galaxy_id", F.coalesce("over", F.left(F.get("rep_titles", F.lit(0)), F.lit(length))).alias("label"))


def pick_resolution(sizes: DataFrame, target: float = 800.0, band: tuple[int, int] = (200, 3000)) -> DataFrame:
    """The resolution whose median size is nearest to the target on a log scale; medians outside the band come after all
    inside it, those below 50 last; ties go to the smaller resolution."""
    m = F.col("median_size")
    behind = F.when(m < 50, 1000.0).when(m.between(*band), 0.0).otherwise(100.0)
    return sizes.agg(F.min_by("resolution", F.struct(behind + F.abs(F.log(F.greatest(m, F.lit(1.0)) / target)), "resolution")).alias("resolution"))


def macro_table(memb: DataFrame, per_macro: DataFrame, galaxies: DataFrame, reps: DataFrame) -> DataFrame:
    """(macro_id, n_articles, is_dust, n_galaxies, e_in, e_out, out_ratio, rep_titles, top_galaxies).

    memb: (page_id, macro); per_macro: figures of the macros as communities; galaxies: (galaxy_id,
    macro_id, n_articles); reps: (comm, rep_titles) of the macros. Galaxies without one macro (-1) are not counted.
    """
    size = memb.groupBy(F.col("macro").alias("macro_id")).agg(F.count(F.lit(1)).alias("n_articles"))
    n_gal = galaxies.where("macro_id >= 0").groupBy("macro_id").agg(F.count(F.lit(1)).alias("n_galaxies"))
    top = top_galaxies(galaxies).groupBy("macro_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "galaxy_id"))), lambda x: x["galaxy_id"]).alias("top_galaxies"))
    own = per_macro.select(F.col("comm").alias("macro_id"), "e_in", "e_out", "out_ratio")
    out = size.join(n_gal, "macro_id", "left").join(own, "macro_id", "left").join(reps.select(F.col("comm").alias("macro_id"), "rep_titles"), "macro_id", "left").join(top, "macro_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("macro_id", "n_articles", (F.col("n_articles") <= 1).alias("is_dust"), zero("n_galaxies"), zero("e_in"), zero("e_out"), "out_ratio", "rep_titles", "top_galaxies")


def named_galaxies(per: DataFrame, names: DataFrame, reps: DataFrame) -> DataFrame:
    """(comm, display_class, name, name_source, name_share, rep_titles) of each community."""
    from linkloom.functions import titles

    j = per.select("comm", "n_c", "out_ratio").join(names, "comm", "left").join(reps, "comm", "left")
    chosen = titles.name_choice(F.col("name"), F.col("share"), F.col("top3"), F.col("rep_titles"))
    j = j.select("comm", titles.display_class(F.col("n_c"), F.col("rep_titles"), F.col("out_ratio")).alias("display_class"), chosen.alias("c"), F.col("share").alias("name_share"), "rep_titles")
    return j.select("comm", "display_class", F.col("c.name").alias("name"), F.col("c.source").alias("name_source"), "name_share", "rep_titles")


def galaxy_table(per: DataFrame, names: DataFrame, reps: DataFrame, memb: DataFrame, pairs: DataFrame, clusters: DataFrame | None = None, k: int = 8) -> DataFrame:
    """The catalog's row of each galaxy. clusters: (comm, cluster), null where absent."""
    near = top_neighbors(pairs, k).withColumnRenamed("g", "comm")
    own = containment(memb).select("comm", "macro_id")
    out = per.select("comm", "n_c", "e_in", "e_out", "out_ratio").join(own, "comm").join(named_galaxies(per, names, reps), "comm").join(near, "comm", "left")
    out = out.join(clusters.select("comm", F.col("cluster").alias("cluster_l2")), "comm", "left") if clusters is not None else out.withColumn("cluster_l2", F.lit(None).cast("int"))
    return out.select(
        F.col("comm").alias("galaxy_id"), "macro_id", "cluster_l2", F.col("n_c").alias("n_articles"), "e_in", "e_out", "out_ratio", (F.col("n_c") <= 1).alias("is_dust"),
        "display_class", "name", "name_source", "name_share", "rep_titles", F.col("top").alias("top_neighbors"), F.coalesce("n_neighbors", F.lit(0).cast("long")).alias("n_neighbors"),
    )
