"""Positions, anchors and layout figures that need no solver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.sources.scratch import dealt, parts_of


def cross_links(und: DataFrame, memb: DataFrame) -> DataFrame:
    """(page_id, own, g, w): edges of each article to each other galaxy."""
    from .community import ends

    e = ends(und, memb).where("cu <> cv")
    sides = e.select(F.explode(F.array(F.struct(F.col("u").alias("page_id"), F.col("cu").alias("own"), F.col("cv").alias("g")), F.struct(F.col("v").alias("page_id"), F.col("cv").alias("own"), F.col("cu").alias("g")))).alias("s")).select("s.*")
    return dealt(sides, parts_of(und), "page_id").groupBy("page_id", "own", "g").agg(F.count(F.lit(1)).alias("w"))


def _directions(cross: DataFrame, centers: DataFrame) -> DataFrame:
    c = centers.select("comm", "x", "y", "z")
    at = lambda p, k: c.select(F.col("comm").alias(k), *[F.col(a).alias(p + a) for a in "xyz"])
    j = cross.join(at("o", "own"), "own").join(at("g", "g"), "g")
    d = j.select("*", *[(F.col("g" + a) - F.col("o" + a)).alias("d" + a) for a in "xyz"])
    norm = F.greatest(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2), F.lit(1e-9))
    return d.withColumn("norm", norm)


def anchor_sum(cross: DataFrame, centers: DataFrame) -> DataFrame:
    """(page_id, ext_deg, ax, ay, az): sum of unit vectors to linked galaxies, weighted by edges."""
    d = _directions(cross, centers)
    return d.groupBy("page_id").agg(F.sum("w").alias("ext_deg"), *[F.sum(F.col("w") * F.col("d" + a) / F.col("norm")).alias("a" + a) for a in "xyz"])


def sector_anchor(cross: DataFrame, centers: DataFrame, ratio: float = 0.5) -> DataFrame:
    """(page_id, dx, dy, dz, conf): direction of the galaxy with most edges, blended with the second if that has ratio of them."""
    r = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("w"), "g"))
    d = _directions(cross, centers).withColumn("r", r)
    one = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    g = d.groupBy("page_id").agg(F.sum("w").alias("ext"), one(1, "w").alias("w1"), one(2, "w").alias("w2"), *[(F.max(F.when(F.col("r") == k, F.col("d" + a) / F.col("norm")))).alias(f"{a}{k}") for k in (1, 2) for a in "xyz"])
    two = F.coalesce(F.col("w2") >= ratio * F.col("w1"), F.lit(False))
    g = g.select("*", *[F.when(two, F.col("w1") * F.col(f"{a}1") + F.col("w2") * F.col(f"{a}2")).otherwise(F.col(f"{a}1")).alias("b" + a) for a in "xyz"])
    n = F.greatest(F.sqrt(F.col("bx") ** 2 + F.col("by") ** 2 + F.col("bz") ** 2), F.lit(1e-9))
    conf = (F.col("w1") + F.when(two, F.col("w2")).otherwise(0)) / F.col("ext")
    return g.select("page_id", *[(F.col("b" + a) / n).alias("d" + a) for a in "xyz"], conf.alias("conf"))


def rank_quantile(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """rank / (n - 1) in the group, 0 for one row; ties by key."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(value, key)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(group)) - 1
    return df.withColumn("q", F.when(n > 0, r / n).otherwise(0.0))


def galaxy_radius(galaxies: DataFrame, macros: DataFrame, pack: float = 0.6, expo: float = 0.5) -> DataFrame:
    """(comm, radius): by share of the macro's articles, at least 1.5 n^(1/3), scaled down where the volumes exceed the macro."""
    j = galaxies.join(macros.select("macro", F.col("radius").alias("room"), F.col("n").alias("total")), "macro")
    own = F.greatest(pack * F.col("room") * F.pow(F.col("n") / F.col("total"), F.lit(expo)), 1.5 * F.cbrt(F.col("n").cast("double")))
    j = j.withColumn("own", own).withColumn("volume", F.sum(F.col("own") ** 3).over(Window.partitionBy("macro")))
    return j.select("comm", (F.col("own") * F.least(F.lit(1.0), 0.9 * F.col("room") / F.cbrt("volume"))).alias("radius"))


def clamp(points: DataFrame, limit: float) -> DataFrame:
    """Points drawn back so that centre distance plus radius stays within the limit."""
    d = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    room = F.greatest(F.lit(limit) - F.col("radius"), F.lit(0.0))
    f = F.when(d > room, room / d).otherwise(1.0)
    return points.select("comm", *[(F.col(a) * f).alias(a) for a in "xyz"], "radius")


def spills(galaxies: DataFrame, macros: DataFrame, slack: float = 1.02, k: int = 20) -> DataFrame:
    m = macros.select("macro", *[F.col(a).alias("m" + a) for a in "xyz"], F.col("radius").alias("R"))
    j = galaxies.join(m, "macro")
    d = F.sqrt(sum(((F.col(a) - F.col("m" + a)) ** 2 for a in "yz"), (F.col("x") - F.col("mx")) ** 2))
    return j.withColumn("excess", d + F.col("radius") - F.col("R")).where(d + F.col("radius") > slack * F.col("R")).orderBy(F.desc("excess"), "comm").limit(k).select("comm", "excess")


def recompose(points: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Articles moved with their galaxies: p' = c_new + (p - c_old) * r_new / r_old."""
    o = old.select("comm", *[F.col(a).alias("o" + a) for a in "xyz"], F.greatest("radius", F.lit(1e-6)).alias("ro"))
    n = new.select("comm", *[F.col(a).alias("n" + a) for a in "xyz"], F.greatest("radius", F.lit(1e-6)).alias("rn"))
    j = points.join(o, "comm").join(n, "comm")
    return j.select("page_id", *[(F.col("n" + a) + (F.col(a) - F.col("o" + a)) * F.col("rn") / F.col("ro")).alias(a) for a in "xyz"])


def _body_pairs(bodies: DataFrame, axes: str, within: str | None) -> DataFrame:
    """Pairs i < j of bodies (of one group, if within) with the place and radius of both; for the few bodies of one level or group."""
    side = lambda p, key: bodies.select(F.col("comm").alias(key), *[F.col(c).alias(p + c) for c in (*axes, "radius")], *([within] if within else []))
    a, b = side("a", "i"), side("b", "j")
    return a.join(b, within).where("i < j") if within else a.join(b, F.col("i") < F.col("j"))


def overlap_fraction(spheres: DataFrame, within: str | None = None) -> DataFrame:
    """(overlap, n_pairs): lens volume of overlapping pairs (of one group, if within) over the volume of all spheres."""
    p = _body_pairs(spheres, "xyz", within)
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 + (F.col("az") - F.col("bz")) ** 2)
    p = p.withColumn("d", F.greatest(d, F.abs(F.col("aradius") - F.col("bradius")), F.lit(1e-9))).withColumn("s", F.col("aradius") + F.col("bradius")).where("d < s")
    lens = F.pi() * (F.col("s") - F.col("d")) ** 2 * (F.col("d") ** 2 + 2 * F.col("d") * F.col("s") - 3 * (F.col("aradius") - F.col("bradius")) ** 2) / (12 * F.col("d"))
    total = spheres.agg(F.sum(F.pi() * 4 / 3 * F.col("radius") ** 3).alias("total"))
    return p.agg(F.coalesce(F.sum(lens), F.lit(0.0)).alias("lens"), F.count(F.lit(1)).alias("n_pairs")).crossJoin(total).select((F.col("lens") / F.col("total")).alias("overlap"), "n_pairs")


def view_frames(spark: SparkSession, views: int = 24, seed: int = 7) -> DataFrame:
    """(view, ux .. vz): planes to look along the axes (z, x, y) and random directions, as two unit vectors each."""
    rng = np.random.default_rng(seed)
    ways = [np.eye(3)[k] for k in (2, 0, 1)] + [e / np.linalg.norm(e) for e in rng.normal(size=(views, 3))]
    rows = []
    for k, w in enumerate(ways):
        u = np.cross(w, np.eye(3)[2] if abs(w[2]) < 0.99 else np.eye(3)[0])
        u /= np.linalg.norm(u)
        rows.append((k, *u.tolist(), *np.cross(w, u).tolist()))
    return spark.createDataFrame(rows, "view int, " + ", ".join(f"{p}{a} double" for p in "uv" for a in "xyz"))


def projection_overlap(spheres: DataFrame, frames: DataFrame) -> DataFrame:
    """(view, overlap): area that the discs of each two bodies share in a view, over the area of all discs."""
    p = _body_pairs(spheres, "xyz", None).crossJoin(F.broadcast(frames))
    shift = lambda f: sum((F.col(f + a) * (F.col("b" + a) - F.col("a" + a)) for a in "yz"), F.col(f + "x") * (F.col("bx") - F.col("ax")))
    p = p.withColumn("d", F.greatest(F.sqrt(shift("u") ** 2 + shift("v") ** 2), F.lit(1e-9))).where("d < aradius + bradius")
    d, a, b = F.col("d"), F.col("aradius"), F.col("bradius")
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    kite = (-d + a + b) * (d + a - b) * (d - a + b) * (d + a + b)
    area = a**2 * F.acos(clip((d**2 + a**2 - b**2) / (2 * d * a))) + b**2 * F.acos(clip((d**2 + b**2 - a**2) / (2 * d * b))) - 0.5 * F.sqrt(F.greatest(F.lit(0.0), kite))
    total = spheres.agg(F.sum(F.pi() * F.col("radius") ** 2).alias("total"))
    per = p.groupBy("view").agg(F.sum(area).alias("area"))
    return frames.select("view").join(per, "view", "left").crossJoin(total).select("view", (F.coalesce("area", F.lit(0.0)) / F.greatest("total", F.lit(1e-9))).alias("overlap"))


def flatness(points: DataFrame, group: str, least: int = 3) -> DataFrame:
    """(group, n, flat): 1 - smallest / largest eigenvalue of the covariance of each group's places, null below least points.

    The eigenvalues of a symmetric 3 x 3 matrix have a closed form, so this stays a single aggregation.
    """
    c = points.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(p, q).alias(p + q) for p, q in ("xx", "yy", "zz", "xy", "xz", "yz")])
    c = c.withColumn("q", (F.col("xx") + F.col("yy") + F.col("zz")) / 3)
    spread = (F.col("xx") - F.col("q")) ** 2 + (F.col("yy") - F.col("q")) ** 2 + (F.col("zz") - F.col("q")) ** 2 + 2 * (F.col("xy") ** 2 + F.col("xz") ** 2 + F.col("yz") ** 2)
    c = c.withColumn("p", F.sqrt(spread / 6))
    m = {k: (F.col(k) - F.col("q") if k[0] == k[1] else F.col(k)) / F.greatest("p", F.lit(1e-300)) for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    det = m["xx"] * (m["yy"] * m["zz"] - m["yz"] ** 2) - m["xy"] * (m["xy"] * m["zz"] - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - m["yy"] * m["xz"])
    c = c.withColumn("phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3)
    high, low = F.col("q") + 2 * F.col("p") * F.cos("phi"), F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + 2 * F.pi() / 3)
    return c.select(group, "n", F.when(F.col("n") >= least, F.when(high <= 1e-12, 0.0).otherwise(1 - F.greatest(low, F.lit(0.0)) / high)).alias("flat"))


def degree_sides(und: DataFrame, memb: DataFrame) -> DataFrame:
    """(page_id, int_deg, ext_deg): edges of each article inside its galaxy and to others."""
    from .community import ends

    e = ends(und, memb).select("u", "v", (F.col("cu") == F.col("cv")).alias("same"))
    sums = e.select(F.explode(F.array("u", "v")).alias("page_id"), "same").groupBy("page_id").agg(F.count_if("same").alias("int_deg"), F.count_if(~F.col("same")).alias("ext_deg"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return memb.select("page_id").join(sums, "page_id", "left").select("page_id", zero("int_deg"), zero("ext_deg"))


def bucket_counts(und: DataFrame, memb: DataFrame) -> DataFrame:
    """(comm, n, n_inner, n_cross): articles, inner edges and cross edges (on each side) of every galaxy, as the local layout takes them."""
    sides = degree_sides(und, memb).join(memb.select("page_id", "comm"), "page_id")
    return sides.groupBy("comm").agg(F.count(F.lit(1)).alias("n"), (F.sum("int_deg") / 2).cast("long").alias("n_inner"), F.sum("ext_deg").alias("n_cross"))


def cross_cap(und: DataFrame, memb: DataFrame, cap: int = 8) -> DataFrame:
    """(page_id, other): cross edges shown at each article, at most cap, by id of the other end."""
    from .community import ends

    e = ends(und, memb).where("cu <> cv").select(F.explode(F.array(F.struct(F.col("u").alias("page_id"), F.col("v").alias("other")), F.struct(F.col("v").alias("page_id"), F.col("u").alias("other")))).alias("s")).select("s.*")
    return dealt(e, parts_of(und), "page_id").withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("other"))).where(F.col("r") <= cap).select("page_id", "other")


def local_index(memb: DataFrame) -> DataFrame:
    return memb.select("page_id", "comm", (F.row_number().over(Window.partitionBy("comm").orderBy("page_id")) - 1).alias("local_idx"))


def lpt_bins(sizes: DataFrame, jobs: int, power: float = 1.93) -> DataFrame:
    """(comm, bin): galaxies (comm, n) dealt out greedily, the costliest first, each to the bin with the least cost so far.

    Greedy dealing is one sequence; it runs in one task over one short row per galaxy.
    """

    def deal(g: pa.Table) -> pa.Table:
        load, out = [0.0] * jobs, []
        for comm, n in sorted(zip(g.column("comm").to_pylist(), g.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0])):
            b = min(range(jobs), key=load.__getitem__)
            load[b] += n**power
            out.append((comm, b))
        return pa.table({"comm": pa.array([c for c, _ in out], g.schema.field("comm").type), "bin": pa.array([b for _, b in out], pa.int32())})

    kind = sizes.schema["comm"].dataType.simpleString()
    return sizes.select("comm", "n", F.lit(0).alias("one")).groupBy("one").applyInArrow(deal, f"comm {kind}, bin int")


def adjacency(points: DataFrame, pairs: DataFrame, k: int = 5) -> DataFrame:
    """(recall, n, spearman) of one level's few bodies: mean share of each body's strongest partners among its nearest (as many as it
    has partners, k at most), and the correlation of the ranks of weight and distance over linked pairs."""
    from .graph import spearman

    a = points.select(F.col("comm").alias("i"), *[F.col(c).alias("a" + c) for c in "xyz"])
    b = points.select(F.col("comm").alias("j"), *[F.col(c).alias("b" + c) for c in "xyz"])
    d2 = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 + (F.col("az") - F.col("bz")) ** 2
    near = a.join(b, F.col("i") != F.col("j")).withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(d2, "j"))).where(F.col("r") <= k).select("i", "j", F.col("r").alias("near"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), "w"), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), "w"))).alias("p")).select("p.*")
    strong = both.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("w"), "j"))).withColumn("kk", F.least(F.lit(k), F.count(F.lit(1)).over(Window.partitionBy("i")))).where(F.col("r") <= F.col("kk"))
    hits = strong.join(near, ["i", "j"], "left").groupBy("i").agg((F.count_if(F.col("near") <= F.col("kk")) / F.max("kk")).alias("share"))
    links = pairs.join(a.withColumnRenamed("i", "a"), "a").join(b.withColumnRenamed("j", "b"), "b").select(F.concat_ws("-", "a", "b").alias("pair"), "w", F.round(d2, 9).alias("d2"))
    return hits.agg(F.avg("share").alias("recall"), F.count(F.lit(1)).alias("n")).crossJoin(spearman(links, "w", "d2", "pair"))


def inner_recall(points: DataFrame, und: DataFrame, memb: DataFrame, k: int = 8, sample: int = 24) -> DataFrame:
    """(comm, recall, length_cv): how well places inside galaxies keep neighbourhoods, for galaxies of 2 k + 2 articles or more.

    recall: of up to sample articles with two links or more (by hash of id), the share of graph neighbours
    among the k nearest; length_cv: standard deviation of the lengths of inner edges over their mean. The
    sample bounds the distances to sample x size of each galaxy.
    """
    from .community import ends

    p = points.select("page_id", "comm", "x", "y", "z")
    inner = ends(und, memb).where("cu = cv").select(F.col("cu").alias("comm"), "u", "v")
    sides = inner.select("comm", F.explode(F.array(F.struct(F.col("u").alias("i"), F.col("v").alias("j")), F.struct(F.col("v").alias("i"), F.col("u").alias("j")))).alias("e")).select("comm", "e.*")
    sized = p.groupBy("comm").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * k + 2)
    able = sides.groupBy("comm", "i").agg(F.count(F.lit(1)).alias("deg")).where("deg >= 2").join(sized, "comm", "left_semi")
    chosen = able.withColumn("r", F.row_number().over(Window.partitionBy("comm").orderBy(F.xxhash64("i"), "i"))).where(F.col("r") <= sample).select("comm", "i", "deg")
    place = lambda pre, key: p.select("comm", F.col("page_id").alias(key), *[F.col(c).alias(pre + c) for c in "xyz"])
    d2 = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 + (F.col("az") - F.col("bz")) ** 2
    near = chosen.join(place("a", "i"), ["comm", "i"]).join(place("b", "j"), "comm").where("i <> j").withColumn("r", F.row_number().over(Window.partitionBy("comm", "i").orderBy(d2, "j"))).where(F.col("r") <= k)
    hits = near.join(sides, ["comm", "i", "j"], "left_semi").groupBy("comm", "i").agg(F.count(F.lit(1)).alias("hits"))
    share = chosen.join(hits, ["comm", "i"], "left").groupBy("comm").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.least(F.lit(k), "deg")).alias("recall"))
    lengths = inner.join(place("a", "u"), ["comm", "u"]).join(place("b", "v"), ["comm", "v"]).groupBy("comm").agg(F.try_divide(F.stddev_pop(F.sqrt(d2)), F.avg(F.sqrt(d2))).alias("length_cv"))
    return share.join(lengths, "comm", "left")
