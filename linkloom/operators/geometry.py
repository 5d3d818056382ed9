"""Places for macros, galaxies, dust and articles: slots and directions as column functions, solvers per group in numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels

# They must equal those of published layouts for equal places.
GOLDEN_ANGLE = 2.399963229728653
#: Three irrational factors: the fractional parts of their multiples spread evenly.
SPREAD = (0.6180339887498949, 0.7548776662466927, 0.5432109876543210)
TOTAL_RADIUS = 1000.0
CONE = 0.75  # half angle of the cone in which contributions of other macros are spread
OVERLAP = 0.02
GAP = 1.02


def ball_slots(rank: Column, n: Column, radius: Column | float, seed: int = 0) -> list[Column]:
    """x, y, z of slot number rank (from 0) of n that fill a ball evenly; the seed turns them about the axis."""
    y = 1 - 2 * (rank + 0.5) / n
    ring = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    phi = (rank + (seed % 97) * SPREAD[0]) * GOLDEN_ANGLE
    r = F.cbrt((rank + 0.5) / n) * radius
    return [r * ring * F.cos(phi), r * ring * F.sin(phi), r * y]


def sphere_slots(rank: Column, n: Column, radius: Column | float) -> list[Column]:
    """x, y, z of slot number rank of n that cover a sphere evenly."""
    y = 1 - 2 * (rank + 0.5) / n
    ring = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    return [ring * F.cos(rank * GOLDEN_ANGLE) * radius, ring * F.sin(rank * GOLDEN_ANGLE) * radius, y * radius]


def cone(axis: np.ndarray, key: int) -> tuple[np.ndarray, float]:
    """A unit vector within CONE of an axis and a depth of 0.35 to 0.95, both from the key alone."""
    u1, u2, u3 = ((key * f) % 1.0 for f in SPREAD)
    k = key % 997
    y = 1 - 2 * (k + 0.5) / 997
    helper = np.array([math.sqrt(max(0.0, 1 - y * y)) * math.cos(k * GOLDEN_ANGLE), math.sqrt(max(0.0, 1 - y * y)) * math.sin(k * GOLDEN_ANGLE), y])
    side = helper - axis * (helper @ axis)
    if np.linalg.norm(side) < 1e-9:
        helper = np.eye(3)[0 if abs(axis[0]) < 0.9 else 1]
        side = helper - axis * (helper @ axis)
    side /= np.linalg.norm(side)
    tilt, turn = CONE * math.sqrt(u1), 2 * math.pi * u2
    across = side * math.cos(turn) + np.cross(axis, side) * math.sin(turn)
    return axis * math.cos(tilt) + across * math.sin(tilt), 0.35 + 0.6 * u3


def _apart(i: np.ndarray, j: np.ndarray, dim: int) -> np.ndarray:
    """Unit directions, spread evenly by the numbers alone, for pairs of bodies in one place."""
    key = i * 31.0 + j + 1
    z = 2 * (key * SPREAD[0] % 1.0) - 1 if dim > 2 else np.zeros(len(key))
    turn, ring = 2 * np.pi * (key * SPREAD[1] % 1.0), np.sqrt(1 - z * z)
    return np.stack([ring * np.cos(turn), ring * np.sin(turn), z][:dim], 1)


def _slot(k: int, n: int, radius: float, seed: int) -> np.ndarray:
    """ball_slots for one body of a group."""
    y, phi, r = 1 - 2 * (k + 0.5) / n, (k + (seed % 97) * SPREAD[0]) * GOLDEN_ANGLE, radius * ((k + 0.5) / n) ** (1 / 3)
    ring = math.sqrt(max(0.0, 1 - y * y))
    return np.array([r * ring * math.cos(phi), r * ring * math.sin(phi), r * y])


def relax(places: np.ndarray, radii: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Bodies pushed apart until none is nearer to another than GAP times their radii, in at most so many rounds.

    Rows of pairs are taken in blocks, so memory grows with the number of bodies.
    """
    p = places.astype(float).copy()
    n = len(p)
    for _ in range(rounds if n > 1 else 0):
        shift, moved = np.zeros_like(p), False
        for lo in range(0, n, 512):
            d = p[None, :, :] - p[lo : lo + 512, None, :]
            dist = np.sqrt((d**2).sum(2))
            need = (radii[lo : lo + 512, None] + radii[None, :]) * GAP
            i, j = np.nonzero(np.triu(dist < need, lo + 1))
            if not len(i):
                continue
            moved = True
            way, far = d[i, j], dist[i, j]
            same = far < 1e-9
            way[same] = _apart(i[same] + lo, j[same], p.shape[1])
            far = np.where(same, np.sqrt((way**2).sum(1)), far)
            push = way / np.maximum(far, 1e-9)[:, None] * ((need[i, j] - far) / 2)[:, None]
            for c in range(p.shape[1]):
                shift[:, c] += np.bincount(j, push[:, c], n) - np.bincount(i + lo, push[:, c], n)
        p += shift
        if not moved:
            break
    return p


def overlap(places: np.ndarray, radii: np.ndarray) -> float:
    """Volume of the lenses of overlapping balls over the volume of all."""
    i, j = np.triu_indices(len(places), 1)
    d = np.maximum(np.sqrt(((places[i] - places[j]) ** 2).sum(1)), 1e-9)
    a, b = radii[i], radii[j]
    near = d < a + b
    d, a, b = np.maximum(d[near], np.abs(a - b)[near]), a[near], b[near]
    lens = np.pi * (a + b - d) ** 2 * (d**2 + 2 * d * (a + b) - 3 * (a - b) ** 2) / (12 * np.maximum(d, 1e-9))
    return float(lens.sum() / max(4 / 3 * np.pi * (radii**3).sum(), 1e-9))


def into_ball(places: np.ndarray, limit: np.ndarray) -> np.ndarray:
    far = np.sqrt((places**2).sum(1))
    return places * np.where(far > limit, limit / np.maximum(far, 1e-9), 1.0)[:, None]


def place_macros(macros: DataFrame, pairs: DataFrame, seed: int = 42, squash: float = 1.0, w_power: float = 1.0) -> DataFrame:
    """(macro_id, x, y, z, radius, n): balls of volume by share of articles, near what they are linked with and hardly overlapping.

    macros: (macro_id, n); pairs: (a, b, w). One level of macros is one task: forces, then rounds of
    pushing apart and spreading out by 6 % until the overlap is at most OVERLAP.
    """
    total = macros.agg(F.sum("n").alias("total"))
    rows = macros.crossJoin(F.broadcast(total)).select(F.lit(0).alias("one"), F.col("macro_id").cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("n").cast("double").alias("w"), (TOTAL_RADIUS * F.sqrt(F.col("n") / F.col("total"))).alias("r"))
    rows = rows.unionByName(pairs.select(F.lit(0).alias("one"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w"), F.lit(0.0).alias("r")))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        own = g[g.b < 0].sort_values("a")
        ids, radii = own.a.to_numpy(), own.r.to_numpy()
        e = g[(g.b >= 0) & g.a.isin(ids) & g.b.isin(ids)].sort_values(["a", "b"])
        w = e.w.to_numpy()
        w = (w / w.max()) ** w_power if len(w) else w
        p = kernels.force_layout(len(ids), np.searchsorted(ids, e.a.to_numpy()), np.searchsorted(ids, e.b.to_numpy()), w, seed=seed) * np.array([1, 1, squash]) * TOTAL_RADIUS * 1.6
        p = relax(p, radii, 250)
        for _ in range(60):
            if overlap(p, radii) <= OVERLAP:
                break
            p = relax(p, radii, 200) * 1.06
        p = relax(p, radii, 300)
        return pd.DataFrame({"macro_id": ids, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "radius": radii, "n": own.w.to_numpy().astype("int64")})

    return rows.groupBy("one").applyInPandas(solve, "macro_id long, x double, y double, z double, radius double, n long")


def _bridged(key: int, partners: list[tuple], placed: dict, room: float, radius: float, spare: np.ndarray) -> np.ndarray:
    """Mean of where a galaxy's partners are: placed ones of its macro, and points in cones towards other macros."""
    rim, sums, weights = max(room - radius, 0.05 * room), np.zeros(3), 0.0
    for other, w, other_macro, dx, dy, dz in partners:
        if other_macro is None:
            if (at := placed.get(other)) is None:
                continue
            sums += w * at
        else:
            axis = np.array([dx, dy, dz])
            far = np.linalg.norm(axis)
            if far < 1e-9:
                continue
            way, depth = cone(axis / far, key + 7 * other_macro)
            sums += w * way * rim * depth
        weights += w
    return sums / weights if weights > 0 else spare


def macro_galaxies(own: pd.DataFrame, links: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Places inside one macro's ball. own: comm, radius, medium, room, macro; links: g, o, w, o_macro, dx, dy, dz (null o_macro: same macro).

    Linked galaxies by forces, others at the mean of their partners or in a slot, all pushed apart; mediums
    at the mean of their partners, pushed out of the others; everything drawn back into the ball.
    """
    own = own.sort_values("comm")
    room, macro = float(own.room.iloc[0]), int(own.macro.iloc[0])
    radius = dict(zip(own.comm, own.radius, strict=True))
    regular, medium = own.comm[~own.medium].tolist(), own.comm[own.medium].tolist()
    among = set(regular)
    inner = links[links.o_macro.isna() & links.g.isin(among) & links.o.isin(among) & (links.g < links.o)].sort_values(["g", "o"])
    linked = sorted(set(inner.g) | set(inner.o))
    alone = [g for g in regular if g not in set(linked)]
    partners: dict[int, list[tuple]] = {}
    for g, o, w, m, dx, dy, dz in links.sort_values(["g", "o"])[["g", "o", "w", "o_macro", "dx", "dy", "dz"]].itertuples(index=False):
        partners.setdefault(g, []).append((o, w, None if pd.isna(m) else int(m), dx, dy, dz))
    place: dict[int, np.ndarray] = {}
    if linked:
        ids = np.array(linked)
        free = max(room - max(radius[g] for g in linked), 0.3 * room)
        w = inner.w.to_numpy(float)
        p = kernels.force_layout(len(ids), np.searchsorted(ids, inner.g.to_numpy()), np.searchsorted(ids, inner.o.to_numpy()), w / max(w.max(initial=0), 1e-9), seed=seed + macro) if len(ids) > 1 else np.zeros((1, 3))
        place = {g: p[k] * free for k, g in enumerate(linked)}
    rim = max(room - max((radius[g] for g in alone), default=0.0), 0.3 * room) * 0.9
    for k, g in enumerate(alone):
        place[g] = _bridged(seed + g, partners.get(g, []), place, room, radius[g], _slot(k, len(alone), rim, seed + macro))
    order = linked + alone
    p, r = np.array([place[g] for g in order]).reshape(-1, 3), np.array([radius[g] for g in order])
    p = into_ball(relax(p, r, 120), np.maximum(room - r, 0.05 * room))
    place = {g: p[k] for k, g in enumerate(order)}
    if medium:
        rm = np.array([radius[g] for g in medium])
        rim = np.maximum(room - rm, 0.05 * room)
        m = np.array([_bridged(seed + g, partners.get(g, []), place, room, radius[g], _slot(k, len(medium), rim[k] * 0.6, seed + macro)) for k, g in enumerate(medium)])
        for _ in range(30):
            before = m.copy()
            if len(p):
                d = m[:, None] - p[None]
                far, need = np.sqrt((d**2).sum(2)), (rm[:, None] + r[None]) * GAP
                i, j = np.nonzero(far < 1e-9)
                d[i, j] = _apart(i, j, 3)
                far[i, j] = np.sqrt((d[i, j] ** 2).sum(1))
                step = np.where(far < need, need - far, 0.0) / np.maximum(far, 1e-9)
                m = m + (step[:, :, None] * d).sum(1)
            m = into_ball(relax(m, rm, 4), rim)
            if np.array_equal(before, m):
                break
        place |= {g: m[k] for k, g in enumerate(medium)}
    ids = sorted(place)
    out = np.array([place[g] for g in ids]).reshape(-1, 3)
    return pd.DataFrame({"comm": ids, "macro": macro, "x": out[:, 0], "y": out[:, 1], "z": out[:, 2], "radius": [radius[g] for g in ids]})


def place_galaxies(galaxies: DataFrame, macros: DataFrame, pairs: DataFrame, pack: float = 0.6, expo: float = 0.5, seed: int = 42) -> DataFrame:
    """(comm, macro, x, y, z, radius) of galaxies (comm, macro, n, display_class) inside their macros (macro_id, x, y, z, radius, n).

    One task per macro takes its galaxies and their pairs. Dust has no place here; see dust_shell.
    """
    from .layout import galaxy_radius

    room = macros.select(F.col("macro_id").alias("macro"), "radius", "n")
    bodies = galaxies.where("display_class <> 'dust'")
    sized = bodies.join(galaxy_radius(bodies.select("comm", "macro", "n"), room, pack, expo), "comm").join(room.select("macro", F.col("radius").alias("room")), "macro")
    own = sized.select(F.col("macro").cast("long").alias("macro"), F.col("comm").cast("long").alias("comm"), "radius", (F.col("display_class") == "medium").alias("medium"), "room")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("o"), "w"), F.struct(F.col("b").alias("g"), F.col("a").alias("o"), "w"))).alias("p")).select("p.*")
    at = bodies.select("comm", "macro").join(macros.select(F.col("macro_id").alias("macro"), *[F.col(c).alias("m" + c) for c in "xyz"]), "macro")
    side = lambda p, key: at.select(F.col("comm").alias(key), F.col("macro").alias(p + "macro"), *[F.col("m" + c).alias(p + c) for c in "xyz"])
    links = both.join(side("s", "g"), "g").join(side("t", "o"), "o")
    links = links.select(F.col("smacro").cast("long").alias("macro"), F.col("g").cast("long").alias("g"), F.col("o").cast("long").alias("o"), F.col("w").cast("double").alias("w"), F.when(F.col("smacro") != F.col("tmacro"), F.col("tmacro").cast("double")).alias("o_macro"), *[(F.col("t" + c) - F.col("s" + c)).alias("d" + c) for c in "xyz"])

    def solve(g: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame({"comm": [], "macro": [], "x": [], "y": [], "z": [], "radius": []})
        return macro_galaxies(g, e, seed)

    local = own.groupBy("macro").cogroup(links.groupBy("macro")).applyInPandas(solve, "comm long, macro long, x double, y double, z double, radius double")
    centre = macros.select(F.col("macro_id").alias("macro"), *[F.col(c).alias("m" + c) for c in "xyz"])
    return local.join(centre, "macro").select("comm", "macro", *[(F.col(c) + F.col("m" + c)).alias(c) for c in "xyz"], "radius")


def dust_shell(dust: DataFrame, macros: DataFrame, pack: float = 0.6) -> DataFrame:
    """(comm, macro, x, y, z, radius) of dust (comm, macro), spread over a sphere around all macros (x, y, z, n).

    Slots go by the hash of the galaxy, counted in parts, so that no task sorts all of the dust.
    """
    parts = 256
    shell = macros.agg((F.coalesce(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)), F.lit(0.0)) * 1.5 + TOTAL_RADIUS * 0.2).alias("shell"), F.greatest(F.lit(1), F.sum("n")).alias("total"))
    dealt = dust.withColumn("part", F.pmod(F.xxhash64("comm"), F.lit(parts)))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    starts = counts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("first"), F.sum("c").over(Window.partitionBy()).alias("all"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("comm")) - 1).join(F.broadcast(starts), "part").crossJoin(F.broadcast(shell))
    x, y, z = sphere_slots((F.col("first") + F.col("r")).cast("double"), F.col("all"), F.col("shell"))
    return ranked.select(F.col("comm").cast("long").alias("comm"), F.col("macro").cast("long").alias("macro"), x.alias("x"), y.alias("y"), z.alias("z"), (pack * TOTAL_RADIUS * F.sqrt(1 / F.col("total"))).alias("radius"))


def article_forces(unit: DataFrame, anchors: DataFrame, galaxies: DataFrame, mode: str = "sector", rounds: int = 40, pull: float = 0.05, spring: float = 0.06) -> DataFrame:
    """(page_id, comm, x, y, z): articles drawn from their place in the unit ball towards what they are linked with outside.

    unit: (page_id, comm, x, y, z, int_deg, ext_deg); anchors: (page_id, dx, dy, dz, conf), a unit direction
    and how far it can be trusted; galaxies: (comm, x, y, z, radius). A round adds gain * (target - p) and
    spring * (start - p) and cuts at the surface. Both pulls are linear and the start lies inside, so rounds
    without a cut have a closed form, but the cut has none: the rounds are a fold within the row, and the
    whole model needs no Python.
    """
    from .layout import rank_quantile

    q = rank_quantile(rank_quantile(unit, "comm", "ext_deg", "page_id").withColumnRenamed("q", "q_ext"), "comm", "int_deg", "page_id").withColumnRenamed("q", "q_int")
    g = galaxies.select("comm", *[F.col(c).alias("g" + c) for c in "xyz"], F.col("radius").alias("R"))
    j = q.join(anchors.select("page_id", "dx", "dy", "dz", "conf"), "page_id", "left").join(g, "comm")
    if mode == "sector":
        band = F.col("R") * (0.35 + 0.65 * F.col("q_ext")) * F.when((F.col("q_int") > 0.9) & (F.col("q_ext") < 0.5), 0.6).otherwise(1.0)
        gain = pull * F.coalesce("conf", F.lit(0.0))
    else:
        band = F.col("R") * (0.55 + 0.45 * F.least(F.lit(1.0), F.col("ext_deg") / 20.0))
        gain = F.when(F.col("dx").isNotNull(), F.lit(pull)).otherwise(0.0)
    j = j.select("page_id", "comm", "gx", "gy", "gz", "R", gain.alias("gain"), *[(F.coalesce("d" + c, F.lit(0.0)) * band).alias("t" + c) for c in "xyz"], *[(F.col(c) * F.col("R") * 0.92).alias("s" + c) for c in "xyz"])
    start = F.struct(*[F.col("s" + c).cast("double").alias(c) for c in "xyz"])

    def step(p: Column, _: Column) -> Column:
        moved = {c: p[c] + F.col("gain") * (F.col("t" + c) - p[c]) + spring * (F.col("s" + c) - p[c]) for c in "xyz"}
        far = F.sqrt(sum((moved[c] ** 2 for c in "yz"), moved["x"] ** 2))
        cut = F.when(far > F.col("R"), F.col("R") / far).otherwise(1.0)
        return F.struct(*[(moved[c] * cut).alias(c) for c in "xyz"])

    return j.withColumn("p", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)).select("page_id", "comm", *[(F.col("g" + c) + F.col("p")[c]).alias(c) for c in "xyz"])
