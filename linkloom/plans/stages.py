"""Stages with parameters and artifacts: expand, plan, execute, and a manifest of each run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    output: str = ""
    group: str = "canonical"
    params: dict[str, Any] = field(default_factory=dict)
    always: bool = False
    store: bool = False


REGISTRY: dict[str, Stage] = {}


def stage(name: str, inputs: Iterable[str] = (), output: str | None = None, group: str = "canonical", always: bool = False, store: bool = False, **params: Any):
    """Registers f(*input frames, **params) as a stage; order of registration is order of execution. store: f gets the store first."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"stage {name} is registered twice")
        REGISTRY[name] = Stage(name, f, tuple(inputs), output or name, group, params, always, store)
        return f

    return register


def expand(targets: Iterable[str]) -> list[Stage]:
    """Stages of the targets in order of execution, once each; all means the canonical ones."""
    wanted: set[str] = set()
    for t in targets:
        if t != "all" and t not in REGISTRY:
            raise KeyError(f"unknown stage {t}")
        wanted |= {s.name for s in REGISTRY.values() if s.group == "canonical"} if t == "all" else {t}
    return [s for s in REGISTRY.values() if s.name in wanted]


def parameters(s: Stage, config: dict, overrides: Iterable[str] = ()) -> dict[str, Any]:
    """Defaults of the stage, then config["defaults"] and config["shared"] where the stage has such a parameter, then
    config["stages"][name], then "stage.key=value" with JSON values."""
    out = dict(s.params)
    for part in ("defaults", "shared"):
        out |= {k: v for k, v in config.get(part, {}).items() if k in out}
    own = dict(config.get("stages", {}).get(s.name, {}))
    for text in overrides:
        key, _, value = text.partition("=")
        name, _, param = key.partition(".")
        if name == s.name:
            try:
                own[param] = json.loads(value)
            except json.JSONDecodeError:
                own[param] = value
    if unknown := set(own) - set(out):
        raise KeyError(f"{s.name} has no parameters {sorted(unknown)}")
    return out | own


class Store:
    """Artifacts as Parquet folders below a base path of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, key: str) -> str:
        return f"{self.base}/{key}"

    def exists(self, key: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path(key)}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self.path(key))

    def write(self, key: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(key))

    def write_text(self, key: str, text: str) -> None:
        """A small text file, on any file system that Spark writes."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(key))
        out = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def fresh(self, output: str, inputs: Iterable[str]) -> bool:
        """Whether an artifact is there and no input was written after it."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()

        def written(key: str) -> int | None:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path(key)}/_SUCCESS")
            fs = p.getFileSystem(conf)
            return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else None

        own = written(output)
        return own is not None and all((t := written(k)) is None or t <= own for k in inputs)


def plan(store: Store, targets: Iterable[str], force: bool = False) -> list[tuple[Stage, str, list[str]]]:
    """(stage, run | skip | missing-input, missing inputs); outputs of earlier stages in the plan count as there."""
    out, coming = [], set()
    for s in expand(targets):
        missing = [k for k in s.inputs if k not in coming and not store.exists(k)]
        status = "missing-input" if missing else "run" if force or s.always or coming & set(s.inputs) or not store.fresh(s.output, s.inputs) else "skip"
        if status == "run":
            coming.add(s.output)
        out.append((s, status, missing))
    return out


def execute(store: Store, targets: Iterable[str], config: dict | None = None, overrides: Iterable[str] = (), force: bool = False) -> tuple[int, list[dict]]:
    """Exit code (0 done, 1 a stage failed, 2 an input is missing) and the manifest of what was done."""
    manifest: list[dict] = []
    steps = plan(store, targets, force)
    for s, status, missing in steps:
        if status == "missing-input":
            manifest.append({"stage": s.name, "status": status, "missing": missing})
            return 2, _ledger(store, manifest)
    for s, status, _ in steps:
        params, began = parameters(s, config or {}, overrides), time.time()
        try:
            if status == "run":
                store.write(s.output, s.run(*([store] if s.store else []), *[store.read(k) for k in s.inputs], **params))
            manifest.append({"stage": s.name, "status": "done" if status == "run" else status, "params": params, "seconds": round(time.time() - began, 3)})
        except Exception as e:  # the manifest tells which stage failed and why
            manifest.append({"stage": s.name, "status": "failed", "params": params, "error": str(e)[:500]})
            return 1, _ledger(store, manifest)
    return 0, _ledger(store, manifest)


def _ledger(store: Store, manifest: list[dict]) -> list[dict]:
    """Writes the manifest beside the artifacts, under a name by time and the stages run."""
    now = datetime.now(timezone.utc)
    label = "-".join(m["stage"] for m in manifest[:3]) or "nothing"
    store.write_text(f"manifests/{now:%Y%m%dT%H%M%S%f}_{label}.json", json.dumps({"written": now.isoformat(), "spark": store.spark.version, "stages": manifest}, indent=2, default=str))
    return manifest


def run_name(name: str) -> str:
    """A name of a layout run: no path, no separators, not empty."""
    if not name or name in (".", "..") or any(c in name for c in "/\\:") or name != name.strip():
        raise ValueError(f"not a run name: {name!r}")
    return name


def format_plan(steps: list[tuple[Stage, str, list[str]]]) -> str:
    """One line per stage: what happens, and what is missing."""
    return "\n".join(f"{status:14} {s.name} ({', '.join(s.inputs) or '-'} -> {s.output})" + (f"  missing: {', '.join(missing)}" if missing else "") for s, status, missing in steps)
