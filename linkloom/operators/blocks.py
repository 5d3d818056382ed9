"""Local moves and connected parts of a graph whose edges lie in blocks on disk, while a few numbers per node fit into memory.

A block holds all edges of a range of nodes, about BLOCK_ENDS edge ends. Every pass reads each block once, in
one task, with the numbers of all nodes as they were before the pass; what changed comes back to the driver. No
edge is shuffled after the blocks are written. Above NODES nodes these numbers no longer fit, and the callers
take rounds of joins instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.sources.scratch import cut

BLOCK_ENDS, NODES = 1_000_000, 16_000_000


def node_strengths(edges: DataFrame) -> DataFrame:
    """(x, k, d): of each node the weight of its edge ends and the number of ends of edges to others; edges (u, v, w), u = v inside a node."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("x"), "w", (F.col("u") != F.col("v")).alias("far"))
    return ends.groupBy("x").agg(F.sum("w").alias("k"), F.count_if("far").alias("d"))


def _turn(nodes: np.ndarray, half: int) -> np.ndarray:
    """Which nodes are in this half, by hash; the halves are other ones from round to round."""
    h = (nodes.astype(np.uint64) + np.uint64(half // 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(2) == half % 2


class Blocks:
    """Edges (u, v, w) by index: ids are the nodes in order, mass the weight at each of them."""

    def __init__(self, edges: DataFrame, strengths: DataFrame | None = None):
        self.spark = edges.sparkSession
        got = (node_strengths(edges) if strengths is None else strengths).toArrow()
        ids, mass, ends = (got.column(c).to_numpy() for c in ("x", "k", "d"))
        order = np.argsort(ids, kind="stable")
        self.ids, self.mass = ids[order], mass[order]
        total = np.cumsum(ends[order])
        block = ((total - ends[order]) // BLOCK_ENDS).astype(np.int32)
        self.first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, int)
        sent = self.spark.sparkContext.broadcast((self.ids, self.first))

        def index(batches):
            ids, first = sent.value
            for b in batches:
                u, v = (np.searchsorted(ids, b.column(c).to_numpy()).astype(np.int32) for c in ("u", "v"))
                far = u != v
                w = b.column("w").to_numpy()[far]
                a, z = np.concatenate([u[far], v[far]]), np.concatenate([v[far], u[far]])
                at = (np.searchsorted(first, a, "right") - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(a), pa.array(z), pa.array(np.concatenate([w, w]))], ["block", "a", "b", "w"])

        n = len(self.ids)

        def pack(g: pa.Table) -> pa.Table:
            _, first = sent.value
            k = g.column("block")[0].as_py()
            lo, hi = int(first[k]), int(first[k + 1]) if k + 1 < len(first) else n
            a, b, w = (g.column(c).to_numpy() for c in ("a", "b", "w"))
            order = np.lexsort((b, a))
            degree = np.bincount(a - lo, minlength=hi - lo).astype(np.int32)
            w = w[order] if len(w) and (w != 1).any() else np.zeros(0)
            return pa.table({"lo": pa.array([lo]), "degree": pa.array([degree.tobytes()], pa.binary()), "b": pa.array([b[order].tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary())})

        rows = edges.select("u", "v", F.col("w").cast("double").alias("w")).mapInArrow(index, "block int, a int, b int, w double")
        self.table = cut(rows.repartition(max(1, len(self.first)), "block").groupBy("block").applyInArrow(pack, "lo long, degree binary, b binary, w binary"))
        sent.destroy()

    def _each(self, f: Callable, schema: str) -> DataFrame:
        """f(lo, degree, a, b, w) -> record batch, for each block; a and b are indices of nodes, a in order."""

        def run(batches):
            for batch in batches:
                for row in range(len(batch)):
                    lo = batch.column("lo")[row].as_py()
                    degree, b, w = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("degree", np.int32), ("b", np.int32), ("w", np.float64)))
                    a = np.repeat(np.arange(lo, lo + len(degree), dtype=np.int32), degree)
                    yield f(lo, degree, a, b, w if len(w) else np.ones(len(b)))

        return self.table.mapInArrow(run, schema)

    def _changes(self, f: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Indices of nodes and their new numbers, from f(...) -> (indices, numbers) of each block."""

        def run(*block):
            x, c = f(*block)
            return pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()), pa.array([c.astype(np.int32).tobytes()], pa.binary())], ["x", "c"])

        got = self._each(run, "x binary, c binary").collect()
        return tuple(np.concatenate([np.frombuffer(r[c], np.int32) for r in got] or [np.zeros(0, np.int32)]) for c in ("x", "c"))

    def move(self, comm: np.ndarray, mass: np.ndarray, cost: float, passes: int = 12) -> np.ndarray:
        """Communities (by index) after passes in which nodes go where the quality gains most, first one half and then the other.

        Within a block the second half sees the moves of the first; other blocks see them in the next pass.
        """
        n, comm = len(self.ids), comm.astype(np.int32)
        for r in range(passes):
            sent = self.spark.sparkContext.broadcast((comm, mass, np.bincount(comm, mass, n)))

            def step(lo, degree, a, b, w, r=r, sent=sent):
                before, mass, volume = sent.value
                comm, volume = before.copy(), volume.copy()
                for half in (2 * r, 2 * r + 1):
                    turn = _turn(np.arange(lo, lo + len(degree)), half)
                    on = np.repeat(turn, degree)
                    x, c, ww = a[on], comm[b[on]], w[on]
                    order = np.argsort((x - lo).astype(np.int64) * n + c, kind="stable")
                    x, c, ww = x[order], c[order], ww[order]
                    if not len(x):
                        continue
                    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (c[1:] != c[:-1])]))
                    x, c, links = x[first], c[first], np.add.reduceat(ww, first)
                    own = comm[x] == c
                    gain = links - cost * mass[x] * (volume[c] - np.where(own, mass[x], 0.0))
                    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                    best = np.maximum.reduceat(gain, start)
                    at = np.repeat(np.arange(len(start)), np.diff(start, append=len(x)))
                    pick = np.flatnonzero(gain == best[at])
                    pick = pick[np.unique(at[pick], return_index=True)[1]]
                    node = x[start]
                    stay = -cost * mass[node] * (volume[comm[node]] - mass[node])
                    stay[at[own]] = gain[own]
                    go = best > stay + 1e-9
                    node, to = node[go], c[pick][go]
                    volume -= np.bincount(comm[node], mass[node], n)
                    volume += np.bincount(to, mass[node], n)
                    comm[node] = to
                x = np.flatnonzero(comm[lo : lo + len(degree)] != before[lo : lo + len(degree)]) + lo
                return x, comm[x]

            x, c = self._changes(step)
            sent.destroy()
            comm[x] = c
            if len(x) * 200 < n:
                break
        return comm

    def contract(self, comm: np.ndarray) -> DataFrame:
        """(u, v, w): weight between each two communities, u < v, and inside each, u = v."""
        k = int(comm.max()) + 1
        sent = self.spark.sparkContext.broadcast(comm.astype(np.int32))

        def sums(lo, degree, a, b, w):
            once = a < b
            ca, cb = sent.value[a[once]].astype(np.int64), sent.value[b[once]].astype(np.int64)
            key, back = np.unique(np.minimum(ca, cb) * k + np.maximum(ca, cb), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(key // k), pa.array(key % k), pa.array(np.bincount(back, w[once], len(key)))], ["u", "v", "w"])

        return cut(self._each(sums, "u long, v long, w double").groupBy("u", "v").agg(F.sum("w").alias("w")))

    def connected(self, comm: np.ndarray) -> np.ndarray:
        """For each node the least index of the connected part of its community that it is in."""
        root = np.arange(len(self.ids), dtype=np.int32)
        while True:
            sent = self.spark.sparkContext.broadcast((comm, root))

            def least(lo, degree, a, b, w, sent=sent):
                comm, root = sent.value
                same = comm[a] == comm[b]
                a, m = a[same], root[b[same]]
                if not len(a):
                    return a, m
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                x, m = a[first], np.minimum.reduceat(m, first)
                less = m < root[x]
                return x[less], m[less]

            x, m = self._changes(least)
            sent.destroy()
            if not len(x):
                return root
            np.minimum.at(root, root[x], m)  # the root as well, so that whole parts join
            np.minimum.at(root, x, m)
            while (root[root] != root).any():
                root = root[root]


def looked_up(nodes: DataFrame, key: str, ids: np.ndarray, values: np.ndarray, name: str) -> DataFrame:
    """nodes with a column of the value that ids give for the key, null for others."""
    sent = nodes.sparkSession.sparkContext.broadcast((ids, values))

    def run(batches):
        ids, values = sent.value
        for b in batches:
            x = b.column(key).to_numpy()
            at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
            yield b.append_column(name, pa.array(values[at].astype(np.int64), mask=ids[at] != x))

    return nodes.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema), f"{name} long"]))
