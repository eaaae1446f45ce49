"""Louvain kernels on graphs that fit one task: one layer or several, standard or with the explorer's older rules.

Nodes are visited in a fixed order and candidate communities in ascending order; only a
gain over zero moves a node, so equal inputs give equal partitions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

#: Sweeps over all nodes before a level ends anyway, and gains that count as zero.
SWEEPS, NOTHING = 50, 1e-12

Edges = Iterable[tuple[object, object, float]]


@dataclass
class Layer:
    """Neighbours with weights, weights of loops (counted at both ends), and sums."""

    around: list[dict[int, float]]
    loops: list[float]
    degree: list[float] = field(init=False)
    total: float = field(init=False)

    def __post_init__(self) -> None:
        self.degree = [sum(a.values()) + x for a, x in zip(self.around, self.loops, strict=True)]
        self.total = sum(self.degree)

    def merged(self, label: list[int], n: int) -> Layer:
        """One vertex for each label; links inside become loops."""
        out = Layer([defaultdict(float) for _ in range(n)], [0.0] * n)
        for i, around in enumerate(self.around):
            a = label[i]
            out.loops[a] += self.loops[i]
            for j, w in around.items():
                if label[j] == a:
                    out.loops[a] += w
                else:
                    out.around[a][label[j]] += w
        out.__post_init__()
        return out


def layer_of(index: dict[object, int], edges: Edges) -> Layer:
    around: list[dict[int, float]] = [defaultdict(float) for _ in index]
    loops = [0.0] * len(index)
    for u, v, w in edges:
        a, b = index[u], index[v]
        if a == b:
            loops[a] += 2 * w
        else:
            around[a][b] += w
            around[b][a] += w
    return Layer(around, loops)


def layer_of_arrays(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> Layer:
    """The same of vertices from 0 to n - 1 in arrays, without a tuple for each link; each pair u <= v comes once.

    Vertices meet their neighbours in the order of the links, as in layer_of.
    """
    loops = np.bincount(u[u == v], 2 * w[u == v], n).tolist()
    apart = u != v
    u, v, w = u[apart], v[apart], w[apart]
    place = np.arange(len(u))
    a, b = np.concatenate([u, v]), np.concatenate([v, u])
    order = np.lexsort([np.concatenate([place, place]), a])
    ends = np.searchsorted(a[order], np.arange(n + 1))
    b, w, shared = b[order], np.concatenate([w, w])[order], list(range(n))
    return Layer([dict(zip((shared[j] for j in b[lo:hi].tolist()), w[lo:hi].tolist(), strict=True)) for lo, hi in zip(ends[:-1], ends[1:],
        strict=True)], loops)


def moved(layers: list[Layer], weights: list[float], resolution: float, order: list[int], own_counts: bool = False) -> list[int]:
    """The community of every vertex after moving single ones until none gains.

    With own_counts the community that a vertex leaves counts the vertex itself, and its
    loop as a link to it, which makes leaving easier: the explorer's older rule.
    A vertex is passed over while neither its own community nor any around it has changed
    since it was last looked at: it would decide as it did.
    """
    n = len(order)
    label = list(range(n))
    inside = [layer.degree.copy() for layer in layers]
    scale = [w / layer.total if layer.total else 0.0 for w, layer in zip(weights, layers, strict=True)]
    used = [k for k in range(len(layers)) if scale[k]]
    # One weight for each neighbour: a single layer's own, scaled where they are summed, or all layers' scaled ones.
    alone = scale[used[0]] if len(used) == 1 else 1.0
    near = [_near([layers[k].around[i] for k in used], [scale[k] for k in used]) for i in range(n)]
    expected = [(layers[k].degree, inside[k], scale[k] * resolution / layers[k].total) for k in used]
    changed, seen, now = [0] * n, [-1] * n, 0  # when each community last changed, when each vertex was last looked at, and moves so far
    for _ in range(SWEEPS):
        improved = False
        for i in order:
            own, last = label[i], seen[i]
            others, weight = near[i]
            if changed[own] <= last:
                for j in others:
                    if changed[label[j]] > last:
                        break
                else:
                    continue
            seen[i] = now
            to: dict[int, float] = defaultdict(float)
            for j, w in zip(others, weight, strict=True):
                to[label[j]] += w
            if alone != 1.0:
                for c in to:
                    to[c] *= alone
            stay = to.pop(own, 0.0)
            for k, (degree, held, part) in zip(used, expected, strict=True):
                if own_counts:
                    stay += scale[k] * layers[k].loops[i]
                stay -= part * degree[i] * (held[own] - (0.0 if own_counts else degree[i]))
            best, gain = own, 0.0
            # What is expected of a community is no less than zero, so links alone must do.
            for c in sorted([c for c, w in to.items() if w - stay > NOTHING]):
                there = to[c] - stay
                for degree, held, part in expected:
                    there -= part * degree[i] * held[c]
                if there > gain + NOTHING:
                    best, gain = c, there
            if best != own:
                for layer, held in zip(layers, inside, strict=True):
                    held[own] -= layer.degree[i]
                    held[best] += layer.degree[i]
                label[i], improved = best, True
                now += 1
                changed[own] = changed[best] = now
        if not improved:
            break
    return label


def _near(around: list[dict[int, float]], scale: list[float]) -> tuple[list[int], list[float]]:
    """Neighbours in any layer, and their weights: of one layer as they are, of several scaled and summed."""
    if len(around) == 1:
        return list(around[0]), list(around[0].values())
    both: dict[int, float] = defaultdict(float)
    for a, s in zip(around, scale, strict=True):
        for j, w in a.items():
            both[j] += s * w
    return list(both), list(both.values())


def renumbered(label: list[int]) -> tuple[list[int], int]:
    """Communities numbered by their smallest member, and how many there are."""
    kept: dict[int, int] = {}
    return [kept.setdefault(c, len(kept)) for c in label], len(kept)


def modularity(layers: list[Layer], weights: list[float], label: list[int], resolution: float = 1.0) -> float:
    """Each layer's modularity by its weight, summed."""
    q = 0.0
    for layer, weight in zip(layers, weights, strict=True):
        if not layer.total:
            continue
        held: dict[int, float] = defaultdict(float)
        inner = 0.0
        for i, around in enumerate(layer.around):
            held[label[i]] += layer.degree[i]
            inner += layer.loops[i] + sum(w for j, w in around.items() if label[j] == label[i])
        q += weight * (inner / layer.total - resolution * sum(d * d for d in held.values()) / layer.total**2)
    return q


def multilevel(layers: list[Edges], weights: list[float], resolution: float = 1.0) -> tuple[list[dict[object, int]], float]:
    """Levels of Louvain over several layers of undirected weighted edges, finest first, and the last one's modularity.

    Communities are numbered by their smallest member.
    """
    layers = [list(edges) for edges in layers]
    names = sorted({x for edges in layers for u, v, _ in edges for x in (u, v)})
    index = {x: k for k, x in enumerate(names)}
    first = [layer_of(index, edges) for edges in layers]
    del layers
    return multilevel_of(names, first, weights, resolution)


def multilevel_of(names: list[object], first: list[Layer], weights: list[float], resolution: float = 1.0) -> tuple[list[dict[object, int]], float]:
    """The same of layers over vertices with names in ascending order."""
    now = first
    at, levels = list(range(len(names))), []
    while names:
        label, n = renumbered(moved(now, weights, resolution, list(range(len(now[0].loops)))))
        if n == len(label):
            break
        at = [label[v] for v in at]
        levels.append(dict(zip(names, at, strict=True)))
        if n <= 1:
            break
        now = [layer.merged(label, n) for layer in now]
    levels = levels or [dict(zip(names, at, strict=True))]
    return levels, modularity(first, weights, [levels[-1][x] for x in names], resolution)


def flat(ids: list[str], links: Iterable[tuple[str, str]]) -> tuple[dict[str, int], float]:
    """One pass with unit weights by the older rule: nodes in the order of their ids, communities by the order of `ids`.

    Returns the community of each node and the sum over linked pairs inside communities
    of weight less expectation, the older rule's modularity.
    """
    index = {x: k for k, x in enumerate(ids)}
    layer = layer_of(index, ((u, v, 1.0) for u, v in links if u in index and v in index))
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    label = moved([layer], [1.0], 1.0, order, own_counts=True)
    kept = {c: k for k, c in enumerate(sorted(set(label)))}
    return {x: kept[label[k]] for x, k in index.items()}, linked_modularity(layer, label)


def linked_modularity(layer: Layer, label: list[int], total: float | None = None) -> float:
    """Modularity with the expectation taken over linked pairs only; total is twice the weight of all links."""
    total = layer.total if total is None else total
    if not total:
        return 0.0
    q = 0.0
    for i, around in enumerate(layer.around):
        held = [(j, w) for j, w in around.items() if label[j] == label[i]]
        if layer.loops[i]:
            held.append((i, layer.loops[i]))
        q += sum(w - layer.degree[i] * layer.degree[j] / total for j, w in held)
    return q / total


@dataclass
class Nested:
    """A level of nested communities: members, the finer community each came from alone, and the level's modularity."""

    level: int
    community: dict[str, int]
    finer: dict[int, int | None]
    modularity: float


def nested(ids: list[str], links: Iterable[tuple[str, str]], most: int = 3, doubled: bool = True) -> list[Nested]:
    """Level 0 (every node alone) and up to `most` levels of communities of communities, by the older rule.

    Stops where a level would have one community or no fewer than the one before; then,
    after level 1, a root of all nodes ends the hierarchy. With `doubled`, sums over the
    links of merged levels count both directions as weight of their own, as the older rule
    does, so higher levels merge less.
    """
    index = {x: k for k, x in enumerate(ids)}
    layer = layer_of(index, ((u, v, 1.0) for u, v in links if u in index and v in index))
    found = [Nested(0, dict(index), {}, 0.0)]
    order, at = sorted(range(len(ids)), key=lambda k: ids[k]), list(range(len(ids)))
    total = layer.total
    for level in range(1, most + 1):
        if not ids:
            break
        held, layer.total = layer.total, total
        raw = moved([layer], [1.0], 1.0, order, own_counts=True)
        q = linked_modularity(layer, raw, total)
        layer.total = held
        kept = {c: k for k, c in enumerate(sorted(set(raw)))}
        if len(kept) <= 1 or len(kept) >= len(order):
            if level > 1:
                found.append(Nested(level, dict.fromkeys(ids, 0), {}, found[-1].modularity))
            break
        label = [kept[c] for c in raw]
        at = [label[v] for v in at]
        before = found[-1].community
        finer: dict[int, int | None] = {}
        for x, c in zip(ids, at, strict=True):
            finer[c] = before[x] if finer.setdefault(c, before[x]) == before[x] else None
        found.append(Nested(level, dict(zip(ids, at, strict=True)), finer, q))
        if len(kept) < 3:
            break
        layer = layer.merged(label, len(kept))
        total = 2 * layer.total if doubled else layer.total
        # Merged vertices are visited in the order of their numbers as text.
        order = sorted(range(len(kept)), key=str)
    return found
