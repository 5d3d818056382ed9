"""What a viewer works out from published figures: colours, exposure, levels of detail, choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# They must equal those of the published viewer for equal pictures.
GOLDEN = 0.6180339887
EMERGE, RESOLVE = 9.0, 55.0
EDGE_REF, EDGE_FLOOR = 2200.0, 0.12
CROSS_REF, CROSS_FLOOR = 150.0, 0.2
EDGE_INK, INK_FLOOR = 0.85, 0.04


def fraction(x: Column) -> Column:
    return x - F.floor(x)


def hash01(i: Column, salt: float = 0.0) -> Column:
    """A number in [0, 1) that looks random but depends on i and salt alone."""
    return fraction(F.sin((i + 1) * 12.9898 + salt * 78.233) * 43758.5453)


def macro_hue(macro_id: Column) -> Column:
    return fraction(macro_id * GOLDEN)


def galaxy_hue(galaxy_id: Column, of_macro: Column) -> Column:
    """Near the hue of its macro; 0.6 stands for none."""
    return fraction(F.coalesce(of_macro, F.lit(0.6)) + (hash01(galaxy_id) - 0.5) * 0.07 + 1)


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / max(high - low, 1e-9)))
    return t * t * (3 - 2 * t)


def emerge_alpha(parent_px: Column) -> Column:
    """How far the members of a body of this size on the screen have appeared."""
    return smoothstep(EMERGE, RESOLVE, parent_px)


def edge_exposure(drawn: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(EDGE_FLOOR), EDGE_REF / F.greatest(drawn, F.lit(1))))


def cross_exposure(drawn: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(CROSS_FLOOR), CROSS_REF / F.greatest(drawn, F.lit(1))))


def edge_ink(deg_a: Column, deg_b: Column, k: float = EDGE_INK) -> Column:
    """Brightness of an edge by the degrees of its ends over the median: hubs draw faintly."""
    return F.least(F.lit(1.0), F.greatest(F.lit(INK_FLOOR), F.try_divide(F.lit(2.0 * k), deg_a + deg_b)))


def screen_px(radius: Column, distance: Column, height: float = 1080.0, fov: float = 50.0) -> Column:
    return radius * (height / 2) / F.tan(F.radians(F.lit(fov / 2))) / F.greatest(distance, F.lit(1e-6))


def compress_z(z: Column, center_z: Column, k: float) -> Column:
    """Height over a galaxy's centre times k, as the map view shows it."""
    return center_z + (z - center_z) * k


def hubs_of(memb: DataFrame, deg: DataFrame, galaxy: int, k: int = 14) -> DataFrame:
    """(page_id, deg): the k articles of a galaxy with most links, ties by id."""
    return memb.where(F.col("comm") == galaxy).select("page_id").join(deg, "page_id").orderBy(F.desc("deg"), "page_id").limit(k)


def cross_targets(und: DataFrame, memb: DataFrame, page: int, k: int = 12) -> DataFrame:
    """(page_id, comm): the first k articles of other galaxies that an article is linked with, by id."""
    own = memb.where(F.col("page_id") == page).select(F.col("comm").alias("own"))
    other = und.where((F.col("u") == page) | (F.col("v") == page)).select(F.when(F.col("u") == page, F.col("v")).otherwise(F.col("u")).alias("page_id"))
    return other.join(memb.select("page_id", "comm"), "page_id").crossJoin(F.broadcast(own)).where("comm <> own").select("page_id", "comm").distinct().orderBy("page_id").limit(k)


def neighbour_tiles(pairs: DataFrame, galaxy: int, k: int = 8) -> DataFrame:
    """(comm, w): the k galaxies with most links to one, ties by id."""
    other = F.when(F.col("a") == galaxy, F.col("b")).otherwise(F.col("a"))
    return pairs.where((F.col("a") == galaxy) | (F.col("b") == galaxy)).select(other.alias("comm"), "w").orderBy(F.desc("w"), "comm").limit(k)


def stride_sample(rows: DataFrame, group: str, order: list[str], cap: int) -> DataFrame:
    """Every n-th row of each group, n so that about cap stay, and no more than cap."""
    w = Window.partitionBy(group)
    stride = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / cap))
    ranked = rows.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_stride", stride)
    return ranked.where((F.pmod("_at", "_stride") == 0) & (F.floor(F.col("_at") / F.col("_stride")) < cap)).drop("_at", "_stride")


def tile_degrees(und: DataFrame, cross: DataFrame, memb: DataFrame) -> DataFrame:
    """(page_id, comm, deg): inner edges and capped cross links (page_id, other) of each article, as a tile shows them."""
    from .community import ends

    inner = ends(und, memb).where("cu = cv").select(F.explode(F.array("u", "v")).alias("page_id"))
    sums = inner.unionByName(cross.select("page_id")).groupBy("page_id").agg(F.count(F.lit(1)).alias("deg"))
    return memb.select("page_id", "comm").join(sums, "page_id", "left").select("page_id", "comm", F.coalesce("deg", F.lit(0).cast("long")).alias("deg"))


def median_degree(degrees: DataFrame, samples: int = 128) -> DataFrame:
    """(comm, median): the upper median of every n-th article's degree, n so that about samples are seen; at least 1."""
    w = Window.partitionBy("comm")
    at = F.row_number().over(w.orderBy("page_id")) - 1
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / samples))
    seen = degrees.withColumn("at", at).withColumn("step", step).where(F.pmod("at", "step") == 0)
    ranked = seen.withColumn("r", F.row_number().over(w.orderBy("deg", "page_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("r") == F.floor(F.col("n") / 2)).select("comm", F.greatest(F.lit(1), "deg").alias("median"))


def random_galaxy(galaxies: DataFrame, seed: int, least: int = 200) -> DataFrame:
    """One of the galaxies (galaxy_id, n_articles) with least articles or more, of all if there is none; the seed decides."""
    small = (F.col("n_articles") < least).cast("int")
    return galaxies.orderBy(small, pick(F.col("galaxy_id"), seed), "galaxy_id").limit(1)


def random_article(memb: DataFrame, galaxies: DataFrame, seed: int, least: int = 100) -> DataFrame:
    """(page_id, comm): one article of a galaxy that random_galaxy picks."""
    chosen = random_galaxy(galaxies, seed, least).select(F.col("galaxy_id").alias("comm"))
    return memb.select("page_id", "comm").join(F.broadcast(chosen), "comm").orderBy(pick(F.col("page_id"), seed), "page_id").limit(1).select("page_id", "comm")


def pick(key: Column, seed: int) -> Column:
    """Spread-out number of a key, in plain integer arithmetic."""
    return F.pmod(key * 7919 + seed * 104729, F.lit(1000003))


def focus(bodies: DataFrame, camera: tuple[float, float, float], target: tuple[float, float, float], eps: float = 0.02) -> DataFrame:
    """(comm, weight): the body in view: the one whose radius is largest beside its distances to camera and target, if that exceeds eps."""
    away = lambda p: F.sqrt(sum(((F.col(a) - v) ** 2 for a, v in zip("yz", p[1:], strict=True)), (F.col("x") - p[0]) ** 2))
    weight = F.col("radius") / F.greatest(F.col("radius"), away(camera)) * F.col("radius") / F.greatest(F.col("radius"), away(target))
    return bodies.select("comm", weight.alias("weight")).where(F.col("weight") > eps).orderBy(F.desc("weight"), "comm").limit(1)
