"""Command line: python -m linkloom stages | plan | run | analyze, over a folder of artifacts."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from linkloom.plans import analysis, canonical, stages
from linkloom.sources.arrays import read_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("stages", help="list all stages with their parameters")
    for name in ("plan", "run"):
        c = sub.add_parser(name)
        c.add_argument("targets", nargs="+", help="stage names, or all for the canonical ones")
        c.add_argument("--base", default="data")
        c.add_argument("--config", help="JSON with defaults, shared and stages")
        c.add_argument("--set", action="append", default=[], metavar="STAGE.KEY=VALUE")
        c.add_argument("--force", action="store_true")
    a = sub.add_parser("analyze", help="study the articles of an id window")
    a.add_argument("--base", default="data")
    a.add_argument("--window", choices=("late", "early", "middle"), default="late")
    a.add_argument("--size", type=int, default=100_000)
    a.add_argument("--resolutions", default="0.5,1,2")
    a.add_argument("--out", default="report.md")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "stages":
        for s in stages.REGISTRY.values():
            print(f"{s.name:20} {s.group:10} {', '.join(s.inputs) or '-'} -> {s.output}  {s.params or ''}")
        return 0
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    store = canonical.open_store(spark, args.base)
    if args.command == "analyze":
        from linkloom.operators import graph

        page = store.read("page")
        articles = canonical.articles(page)
        nodes = graph.id_window(articles, args.size, args.window).select("page_id")
        out = analysis.analyze(canonical.kept(store.read("resolved")), nodes, articles, tuple(map(float, args.resolutions.split(","))))
        store.write_text(args.out, out["report"])
        return 0
    config = read_json(args.config, {}) if args.config else {}
    try:
        if args.command == "plan":
            print(stages.format_plan(stages.plan(store, args.targets, args.force)))
            return 0
        code, manifest = stages.execute(store, args.targets, config, args.set, args.force)
    except KeyError as e:
        print(e.args[0], file=sys.stderr)
        return 2
    for m in manifest:
        print(m["status"], m["stage"], m.get("error") or m.get("missing") or m.get("seconds", ""))
    return code


if __name__ == "__main__":
    sys.exit(main())
