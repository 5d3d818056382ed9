"""Numpy kernels for one group: community refinement, force layout, tiles."""

from __future__ import annotations

import numpy as np


#: Edge ends up to which nodes move one after the other; above, half of them move at once first, and then so many rounds one by one.
SEQUENTIAL, POLISH = 60_000, 8


def _moves(k: int, src: np.ndarray, dst: np.ndarray, wt: np.ndarray, mass: np.ndarray, cost: float, rng: np.random.Generator, rounds: int = 40) -> np.ndarray:
    """Community of each node after rounds in which a random half moves where the quality gains most; edges are sorted by src."""
    comm, calm = np.arange(k), 0
    for _ in range(rounds):
        volume = np.bincount(comm, mass, k)
        turn = rng.random(k) < 0.5
        on = turn[src]
        key, back = np.unique(src[on] * np.int64(k) + comm[dst[on]], return_inverse=True)
        x, c, w = key // k, key % k, np.bincount(back, wt[on], len(key))
        own = comm[x] == c
        gain = w - cost * mass[x] * (volume[c] - np.where(own, mass[x], 0))
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, int)
        if not len(first):
            break
        best = np.maximum.reduceat(gain, first)
        at = np.repeat(np.arange(len(first)), np.diff(first, append=len(x)))
        pick = np.flatnonzero(gain == best[at])
        pick = pick[np.unique(at[pick], return_index=True)[1]]
        node = x[first]
        stay = -cost * mass[node] * (volume[comm[node]] - mass[node])
        stay[at[own]] = gain[own]
        go = best > stay + 1e-12
        comm[node[go]] = c[pick][go]
        calm = calm + 1 if go.sum() * 500 < k else 0
        if calm == 3:
            break
    return comm


def _one_by_one(comm: np.ndarray, at: np.ndarray, dst: np.ndarray, wt: np.ndarray, mass: np.ndarray, cost: float, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Community of each node after rounds in which nodes move one after the other, in random order; of equal gains the least community.

    The loop runs over plain lists, which take a fraction of the time of array elements; edges stay arrays.
    """
    k = len(comm)
    volume, own_of, mass_of, at = np.bincount(comm, mass, k).tolist(), comm.tolist(), mass.tolist(), at.tolist()
    ones = bool((wt == 1).all())
    for _ in range(rounds):
        moved = False
        for x in rng.permutation(k).tolist():
            lo, hi = at[x], at[x + 1]
            if lo == hi:
                continue
            own, m = own_of[x], mass_of[x]
            links: dict[int, float] = {}
            if ones:
                for y in dst[lo:hi].tolist():
                    c = own_of[y]
                    links[c] = links.get(c, 0.0) + 1.0
            else:
                for y, w in zip(dst[lo:hi].tolist(), wt[lo:hi].tolist(), strict=True):
                    c = own_of[y]
                    links[c] = links.get(c, 0.0) + w
            volume[own] -= m
            pull = cost * m
            best, most = -1, -np.inf
            for c, w in links.items():
                gain = w - pull * volume[c]
                if gain > most or (gain == most and c < best):
                    best, most = c, gain
            if most > links.get(own, 0.0) - pull * volume[own] + 1e-12:
                own_of[x], moved = best, True
                volume[best] += m
            else:
                volume[own] += m
        if not moved:
            break
    return np.array(own_of, np.int64)


def louvain(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, gamma: float = 1.0, seed: int = 42, passes: int = 10, loops: np.ndarray | None = None, objective: str = "modularity", sizes: np.ndarray | None = None) -> np.ndarray:
    """Community of each of n nodes by local moves and contraction, then split into connected parts.

    objective: modularity, or cpm (an edge inside counts 1, a pair of nodes inside costs gamma). loops:
    weight of the edges inside each node, where nodes stand for groups; sizes: articles that each stands for.
    """
    label, level = np.arange(n), (n, a, b, w, np.zeros(n) if loops is None else loops, np.ones(n) if sizes is None else sizes.astype(float))
    rng = np.random.default_rng(seed)
    m2 = 2.0 * (w.sum() + level[4].sum())
    if not m2:
        return label
    for _ in range(passes):
        k, a_, b_, w_, loops, size = level
        src, dst, wt = np.concatenate([a_, b_]), np.concatenate([b_, a_]), np.concatenate([w_, w_])
        order = np.argsort(src, kind="stable")
        src, dst, wt = src[order], dst[order], wt[order]
        at = np.searchsorted(src, np.arange(k + 1))
        mass, cost = (np.bincount(src, wt, k) + 2 * loops, gamma / m2) if objective == "modularity" else (size, gamma)
        comm = _moves(k, src, dst, wt, mass, cost, rng) if len(src) > SEQUENTIAL else np.arange(k)
        comm = _one_by_one(comm, at, dst, wt, mass, cost, rng, 20 if len(src) <= SEQUENTIAL else POLISH)
        names, comm = np.unique(comm, return_inverse=True)
        label = comm[label]
        if len(names) == k:
            break
        ca, cb = comm[a_], comm[b_]
        loops = np.bincount(comm, loops, len(names)) + np.bincount(ca[ca == cb], w_[ca == cb], len(names))
        lo, hi = np.minimum(ca, cb), np.maximum(ca, cb)
        cross = lo != hi
        key, back = np.unique(lo[cross] * len(names) + hi[cross], return_inverse=True)
        level = (len(names), key // len(names), key % len(names), np.bincount(back, w_[cross], len(key)), loops, np.bincount(comm, size, len(names)))
    return connected(n, a, b, label)


def connected(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels split so that each is connected, numbered by size, then first node."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    same = label[a] == label[b]
    for x, y in zip(a[same].tolist(), b[same].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    roots = np.array([find(x) for x in range(n)])
    names, back, size = np.unique(roots, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, -size))] = np.arange(len(names))
    return rank[back]


def subdivide(n: int, a: np.ndarray, b: np.ndarray, max_size: int, depth: int = 4, seed: int = 42, min_size: int = 0, gamma: float = 1.0, objective: str = "modularity") -> np.ndarray:
    """Recursive communities until none but those that cannot be cut is larger than max_size; groups of up to min_size nodes stay whole."""
    if n <= min_size:
        return np.zeros(n, np.int64)
    label = louvain(n, a, b, np.ones(len(a)), gamma, seed, objective=objective)
    if depth > 1:
        top = label.max() + 1
        size = np.bincount(label)
        order, ends = np.argsort(label, kind="stable"), np.cumsum(size)
        inside = np.flatnonzero(label[a] == label[b])
        inside = inside[np.argsort(label[a[inside]], kind="stable")]
        of = label[a[inside]]
        index = np.full(n, -1)
        for c in np.flatnonzero(size > max_size):
            nodes = order[ends[c] - size[c] : ends[c]]
            index[nodes] = np.arange(len(nodes))
            own = inside[np.searchsorted(of, c) : np.searchsorted(of, c, "right")]
            sub = subdivide(len(nodes), index[a[own]], index[b[own]], max_size, depth - 1, seed + 1, min_size, gamma, objective)
            if sub.max() > 0:
                label[nodes] = np.where(sub > 0, sub + top - 1, c)
                top += sub.max()
    return label


#: Nodes up to which every pair is pushed apart; above, each node is pushed by so many others at a time.
ALL_PAIRS, SAMPLE = 1500, 96


def _anneal(p: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, steps: int, rng: np.random.Generator, heat: float) -> np.ndarray:
    """Steps of Fruchterman-Reingold. Above ALL_PAIRS nodes the push on a node is estimated from SAMPLE others, drawn anew in
    each step, so a step takes n * SAMPLE instead of n * n."""
    n, dim = p.shape
    k = 1.0 / n ** (1 / dim)
    for t in range(steps):
        push = np.empty_like(p)
        if n <= ALL_PAIRS:
            for lo in range(0, n, 512):
                d = p[lo : lo + 512, None] - p[None]
                push[lo : lo + 512] = (d * (k * k / np.maximum((d**2).sum(2), 1e-9))[:, :, None]).sum(1)
        else:
            others = (np.arange(n)[:, None] + rng.integers(1, n, SAMPLE)[None, :]) % n
            for lo in range(0, n, 4096):
                d = p[lo : lo + 4096, None] - p[others[lo : lo + 4096]]
                push[lo : lo + 4096] = (d * (k * k / np.maximum((d**2).sum(2), 1e-9))[:, :, None]).sum(1) * (n - 1) / SAMPLE
        if len(a):
            d = p[a] - p[b]
            pull = d * (np.sqrt((d**2).sum(1)) * w / k)[:, None]
            for c in range(dim):
                push[:, c] += np.bincount(b, pull[:, c], n) - np.bincount(a, pull[:, c], n)
        size = np.maximum(np.sqrt((push**2).sum(1)), 1e-9)
        p = p + push / size[:, None] * np.minimum(size, heat * (1 - t / steps))[:, None]
    return p


def force_layout(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, dim: int = 3, steps: int = 80, seed: int = 42, multilevel: int = 2000, norm: str = "p98") -> np.ndarray:
    """Fruchterman-Reingold in the unit ball.

    From multilevel nodes on, communities are laid out first and their nodes start near them, which needs
    fewer steps. norm: p98 puts 98 % of the nodes inside the ball and draws the rest onto it, max the farthest.
    """
    if n == 1:
        return np.zeros((1, dim))
    rng = np.random.default_rng(seed)
    p = None
    if n >= multilevel and len(a):
        group = louvain(n, a, b, w, seed=seed, passes=3)
        k = int(group.max()) + 1
        if 8 <= k < n:
            ga, gb = group[a], group[b]
            cross = ga != gb
            key, back = np.unique(np.minimum(ga, gb)[cross] * k + np.maximum(ga, gb)[cross], return_inverse=True)
            cw = np.bincount(back, w[cross], len(key))
            coarse = force_layout(k, key // k, key % k, cw / max(cw.max(initial=0), 1e-9), dim, steps, seed + 1, multilevel=1 << 60)
            p = _anneal(coarse[group] + rng.normal(scale=0.02, size=(n, dim)), a, b, w, steps // 2, rng, 0.05)
    if p is None:
        p = _anneal(rng.normal(size=(n, dim)), a, b, w, steps, rng, 0.2)
    p = p - p.mean(0)
    r = np.sqrt((p**2).sum(1))
    p /= max(np.percentile(r, 98) if norm == "p98" else r.max(), 1e-9)
    return p / np.maximum(np.sqrt((p**2).sum(1)), 1.0)[:, None]


def tile_bytes(xyz: np.ndarray, edges: np.ndarray, cross: np.ndarray) -> bytes:
    """Little-endian: three counts, float positions, index pairs of inner edges, index triples of cross edges."""
    head = np.array([len(xyz), len(edges), len(cross)], "<u4")
    return b"".join((head.tobytes(), xyz.astype("<f4").tobytes(), edges.astype("<u4").tobytes(), cross.astype("<u4").tobytes()))


def read_tile(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, e, c = np.frombuffer(data, "<u4", 3)
    if len(data) != 12 + 12 * n + 8 * e + 12 * c:
        raise ValueError("tile of a wrong size")
    at = 12 + 12 * int(n)
    edges = np.frombuffer(data, "<u4", 2 * int(e), at).reshape(-1, 2)
    return np.frombuffer(data, "<f4", 3 * int(n), 12).reshape(-1, 3), edges, np.frombuffer(data, "<u4", 3 * int(c), at + 8 * int(e)).reshape(-1, 3)
