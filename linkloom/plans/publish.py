"""Files for a viewer: tiles, titles, and one bootstrap file."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
CLASS_CODES = {"galaxy": 0, "medium": 1, "dust": 2}
MACRO_PAIRS, GALAXY_PAIRS = 400, 5000


def bootstrap(galaxies: DataFrame, macros: DataFrame, galaxy_positions: DataFrame, macro_positions: DataFrame, macro_pairs: DataFrame, pairs: DataFrame, run: str = "", cross_cap: int = 8, overrides: DataFrame | None = None, tag: str = "res1_sub") -> dict:
    """The bootstrap file's content: a short row for each macro and galaxy, and the strongest pairs.

    The viewer reads all galaxies at once, so the file, and what comes to the driver for it, has one short
    row per galaxy by design. overrides: (macro_id, label).
    """
    r2 = lambda c: F.round(c, 2).alias(c)
    label = F.left(F.get("rep_titles", F.lit(0)), F.lit(16))
    own = macros.select("macro_id", "n_articles", label.alias("label"))
    if overrides is not None:
        own = own.join(overrides.select("macro_id", F.nullif(F.trim("label"), F.lit("")).alias("over")), "macro_id", "left").withColumn("label", F.coalesce("over", "label"))
    at = macro_positions.select("macro_id", "x", "y", "z", "radius")
    mac = own.join(at, "macro_id", "left").fillna(0.0, ["x", "y", "z", "radius"]).orderBy("macro_id").select(r2("x"), r2("y"), r2("z"), r2("radius"), "n_articles", F.coalesce("label", F.lit("")).alias("label"))
    code = F.coalesce(*[F.when(F.col("g.display_class") == k, v) for k, v in CLASS_CODES.items()], F.lit(0))
    gal = galaxies.alias("g").join(galaxy_positions.select(F.col("comm").alias("galaxy_id"), "x", "y", "z", "radius"), "galaxy_id").orderBy("galaxy_id")
    gal = gal.select(r2("x"), r2("y"), r2("z"), F.round(F.greatest("radius", F.lit(0.5)), 2).alias("radius"), "macro_id", code.alias("class"), "n_articles", F.coalesce("name", F.lit("")).alias("name"), "e_in", "e_out")
    rows = lambda df: [list(r) for r in df.collect()]
    return {
        "meta": {"schema_version": SCHEMA_VERSION, "galaxy_tag": tag, "layout_run": run, "n_articles": galaxies.agg(F.sum("n_articles")).first()[0] or 0, "n_galaxies": galaxies.count(), "generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "cross_cap": cross_cap},
        "macros": rows(mac),
        "galaxies": rows(gal),
        "macro_pairs": rows(macro_pairs.orderBy(F.desc("w"), "macro_a", "macro_b").limit(MACRO_PAIRS).select("macro_a", "macro_b", "w")),
        "galaxy_pairs": rows(pairs.orderBy(F.desc("w"), "a", "b").limit(GALAXY_PAIRS).select("a", "b", "w")),
    }


def write_tiles(tiles: DataFrame, folder: str) -> DataFrame:
    """(comm, bytes): each tile and its titles as two files, written by the tasks into a folder that all of them share.

    A file is put in place by renaming, so a task that runs again writes the same file once more.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            os.makedirs(f"{folder}/tiles", exist_ok=True)
            for comm, tile, titles in zip(b.comm, b.tile, b.titles, strict=True):
                for name, data in ((f"gal_{comm:06d}.bin", bytes(tile)), (f"gal_{comm:06d}.json", titles.encode())):
                    with open(f"{folder}/tiles/.{name}.{os.getpid()}", "wb") as f:
                        f.write(data)
                    os.replace(f"{folder}/tiles/.{name}.{os.getpid()}", f"{folder}/tiles/{name}")
            yield pd.DataFrame({"comm": b.comm.astype("int64"), "bytes": b.tile.map(len).astype("int64")})

    return tiles.mapInPandas(write, "comm long, bytes long")


def publish(tiles: DataFrame, galaxies: DataFrame, macros: DataFrame, galaxy_positions: DataFrame, macro_positions: DataFrame, macro_pairs: DataFrame, pairs: DataFrame, folder: str, run: str = "", cross_cap: int = 8) -> DataFrame:
    """Writes bootstrap.json and the tiles below folder; (comm, bytes) of the tiles."""
    from linkloom.sources.arrays import write_json

    write_json(f"{folder}/bootstrap.json", bootstrap(galaxies, macros, galaxy_positions, macro_positions, macro_pairs, pairs, run, cross_cap))
    return write_tiles(tiles, folder.removeprefix("file://"))


def report(title: str, sections: dict[str, DataFrame | dict | str], rows: int = 50) -> str:
    """A Markdown page: a heading and a table (its first rows), or a list of figures, for each section."""
    out = [f"# {title}", ""]
    for head, what in sections.items():
        out += [f"## {head}", ""]
        if isinstance(what, DataFrame):
            out += ["| " + " | ".join(what.columns) + " |", "|" + "-|" * len(what.columns)]
            out += ["| " + " | ".join(_cell(v) for v in r) + " |" for r in what.limit(rows).collect()]
        elif isinstance(what, dict):
            out += [f"- {k}: {_cell(v)}" for k, v in what.items()]
        else:
            out.append(what)
        out.append("")
    return "\n".join(out)


def _cell(v) -> str:
    if v is None:
        return "-"
    if isinstance(v, float):
        return f"{v:.4g}"
    if isinstance(v, list):
        return ", ".join(map(_cell, v))
    return f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v).replace("|", "\\|")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """(bin, from, n): rows by equal bins between two bounds; what lies outside counts in the outer bins."""
    step = (high - low) / bins
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / step)))
    return df.where(F.col(column).isNotNull()).groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (low + F.col("bin") * step).alias("from"), "n")


PREVIEW = """<!doctype html><meta charset="utf-8"><title>{title}</title><body style="margin:0;background:#000"><canvas id="c"></canvas><script>
const bodies={bodies},c=document.getElementById("c"),g=c.getContext("2d");c.width=innerWidth;c.height=innerHeight;
const far=Math.max(1,...bodies.map(b=>Math.hypot(b[0],b[1])+b[3])),k=Math.min(c.width,c.height)/2/far;
for(const b of bodies){{g.beginPath();g.arc(c.width/2+b[0]*k,c.height/2-b[1]*k,Math.max(.5,b[3]*k),0,7);g.fillStyle=`hsla(${{b[4]*360}},60%,60%,.6)`;g.fill()}}
</script>"""


def preview(bodies: DataFrame, title: str = "layout", most: int = 5000) -> str:
    """An HTML page that draws the largest bodies (macro, x, y, z, radius) as discs, coloured by macro."""
    from linkloom.operators.view import macro_hue

    rows = bodies.orderBy(F.desc("radius"), "comm").limit(most).select(*[F.round(c, 2) for c in ("x", "y", "z", "radius")], F.round(macro_hue(F.col("macro")), 3))
    return PREVIEW.format(title=title, bodies=json.dumps([list(r) for r in rows.collect()]))
