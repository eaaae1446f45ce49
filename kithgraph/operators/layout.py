"""Positions: spherical seeds, force layouts of a graph's heaviest bodies, and spectral placement by group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.functions.columns import weight
from kithgraph.operators.octree import repulsion
from kithgraph.plans.staging import staged

#: The heaviest bodies that a force layout moves, its rounds, and how small a cell must be for its distance to act as one.
MOST_BODIES = {"spring": 5_000, "world": 100_000}
ROUNDS = {"spring": 400, "world": 300}
THETA = 0.8
#: Links that pull at once, bodies along a side of a tile of links, and the part of a tile's places that must be links for it to be kept whole.
LINKS_AT_ONCE, TILE, FULL = 1 << 15, 256, 0.25
AXES = ("pos_x", "pos_y", "pos_z")


def fnv1a(text: str) -> int:
    """64-bit FNV-1a of UTF-8."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def seed_positions(ids: pd.Series, radius: float) -> pd.DataFrame:
    """A point for each id, on shells from half the radius to the radius."""
    h = np.array([fnv1a(i) for i in ids], np.uint64)
    part = [((h >> np.uint64(k)) & np.uint64(0xFFFF)).astype(float) / 65536 for k in (0, 16, 32)]
    z, turn, r = 2 * part[0] - 1, 2 * np.pi * part[1], radius * (0.5 + part[2] / 2)
    flat = np.sqrt(1 - z * z)
    return pd.DataFrame({"pos_x": r * flat * np.cos(turn), "pos_y": r * flat * np.sin(turn), "pos_z": r * z})


def spherical_seed(nodes: DataFrame, radius: float) -> DataFrame:
    """id and a deterministic position."""

    def make(batches):
        for b in batches:
            yield pd.concat([b[["id"]].reset_index(drop=True), seed_positions(b["id"], radius)], axis=1)

    return nodes.select("id").mapInPandas(make, "id string, pos_x double, pos_y double, pos_z double")


def _attract(pos: np.ndarray, u: np.ndarray, v: np.ndarray, strength: Callable[[np.ndarray, slice], np.ndarray], move: np.ndarray) -> None:
    """Move both ends of each link (sorted by u) towards one another: by its difference times strength(distances, which links).

    Links are taken in runs that stay in the cache, so memory doesn't grow with their number.
    """
    axes, n = np.ascontiguousarray(pos.T), len(pos)
    for lo in range(0, len(u), LINKS_AT_ONCE):
        at = slice(lo, lo + LINKS_AT_ONCE)
        a, b = u[at].astype(np.intp), v[at].astype(np.intp)
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        d = np.repeat(axes[:, a[first]], np.diff(first, append=len(a)), axis=1)
        d -= axes.take(b, axis=1, mode="clip")
        d = d.astype(np.float32)  # differences, so seven digits of each pull are left
        r = np.sqrt(np.einsum("ij,ij->j", d, d))
        if r.min() < 1e-6:
            away, r = _apart(d.T, np.arange(lo, lo + len(a)))
            d = np.ascontiguousarray(away.T, np.float32)
        d *= strength(r, at).astype(np.float32, copy=False)
        for axis in range(len(d)):
            move[:, axis] += np.bincount(b, d[axis], n)
        move[a[first]] -= np.add.reduceat(d, first, axis=1, dtype=float).T


class Pulls:
    """Links by tiles of bodies: tiles that are full enough as matrices, which cost a tenth for each link, the rest one by one.

    Links between bodies that both stay where they are pull nothing and are left out.
    """

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, pull: np.ndarray, free: np.ndarray) -> None:
        self.side = -(-n // TILE)
        self.order = self._order(n, u, v)
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)

        def runs() -> Iterator[tuple[np.ndarray, ...]]:
            """Links by runs: both ends, pulls, both places in order, and the number of the tile."""
            for lo in range(0, len(u), LINKS_AT_ONCE):
                x, y, w = (c[lo : lo + LINKS_AT_ONCE] for c in (u, v, pull))
                held = free[x] | free[y]
                x, y, w = x[held], y[held], w[held]
                low, high = np.minimum(place[x], place[y]), np.maximum(place[x], place[y])
                yield x, y, w, low, high, (low // TILE).astype(np.int64) * self.side + high // TILE

        count = np.zeros(self.side * self.side, np.int64)
        for *_, tile in runs():
            count += np.bincount(tile, minlength=len(count))
        count[:: self.side + 1] *= 2  # a tile on the diagonal has each of its links at two places
        self.at = np.flatnonzero(count >= FULL * TILE * TILE)
        self.tiles = np.zeros((len(self.at), TILE, TILE), np.float32)
        number = np.full(len(count), -1)
        number[self.at] = np.arange(len(self.at))
        rest = []
        for x, y, w, low, high, tile in runs():
            k = number[tile]
            rest.append((x[k < 0], y[k < 0], w[k < 0]))
            low, high, w, k = low[k >= 0], high[k >= 0], w[k >= 0], k[k >= 0]
            self.tiles[k, low % TILE, high % TILE] = w
            own = low // TILE == high // TILE
            self.tiles[k[own], high[own] % TILE, low[own] % TILE] = w[own]
        self.u, self.v, self.pull = (np.concatenate(x) for x in zip(*rest, strict=True)) if rest else (u, v, pull)

    @staticmethod
    def _order(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Bodies so that linked ones are near: by the smallest body within two links, then by the number of links."""
        label = np.arange(n)
        for _ in range(2):
            near = label.copy()
            for lo in range(0, len(u), LINKS_AT_ONCE):
                a, b = (x[lo : lo + LINKS_AT_ONCE] for x in (u, v))
                np.minimum.at(near, a, label[b])
                np.minimum.at(near, b, label[a])
            label = near
        links = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
        return np.lexsort((np.arange(n), -links, label))

    def move(self, pos: np.ndarray, k: float, move: np.ndarray) -> None:
        """Add each link's pull times log(1 + distance / k) / distance times its difference, at both ends."""
        per = np.float32(1 / k)
        _attract(pos, self.u, self.v, lambda r, at: self.pull[at] * np.log(1 + r * per) / r, move)
        if not len(self.at):
            return
        # Distances in units of k: far below it a pull for its difference is constant, so squares may lose digits.
        d = pos.shape[1]
        p = np.zeros((d, self.side * TILE), np.float32)
        p[:, : len(pos)] = (pos[self.order] / k).T
        squares, ones = (p * p).sum(axis=0, keepdims=True), np.ones((1, p.shape[1]), np.float32)
        left, right = np.concatenate([-2 * p, squares, ones]).T.copy(), np.concatenate([p, ones, squares])
        sums = np.zeros((p.shape[1], d + 1))
        r, f = np.empty((2, TILE, TILE), np.float32)
        for at, whole in zip(self.at, self.tiles, strict=True):
            rows, cols = (slice(x * TILE, (x + 1) * TILE) for x in divmod(int(at), self.side))
            np.matmul(left[rows], right[:, cols], out=r)
            np.maximum(r, np.float32(1e-6), out=r)
            np.sqrt(r, out=r)
            np.add(r, np.float32(1), out=f)
            np.log(f, out=f)
            f /= r
            f *= whole
            sums[rows] += f @ right[: d + 1, cols].T
            if rows != cols:
                sums[cols] += f.T @ right[: d + 1, rows].T
        move[self.order] += (sums[:, :d] - p.T * sums[:, d:])[: len(pos)]


def _spots_apart(pos: np.ndarray, free: np.ndarray, move: np.ndarray) -> None:
    """A small step for free bodies on a spot where another one is, in a direction by their number, since no force parts them."""
    order = np.lexsort(pos.T)
    same = np.concatenate([[False], (np.diff(pos[order], axis=0) == 0).all(axis=1)])
    at = order[same]
    at = at[free[at]]
    turn = at * 2.399963  # the golden angle
    move[at] += 1e-6 * np.stack([np.cos(turn), np.sin(turn), np.where(at % 2, 0.5, -0.5)], axis=1)


def _stepped(pos: np.ndarray, move: np.ndarray, most: float, free: np.ndarray) -> np.ndarray:
    """Positions after moves of at most `most`; only free bodies move."""
    length = np.maximum(np.sqrt((move * move).sum(axis=1)), 1e-12)
    return pos + np.where(free, np.minimum(length, most) / length, 0.0)[:, None] * move


def _apart(d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences and distances of links, with a direction by the link's place for ends on one spot."""
    r = np.sqrt((d * d).sum(axis=1))
    same = r < 1e-6
    if same.any():
        turn = at[same] * 2.399963  # the golden angle
        d = d.copy()
        d[same] = 1e-6 * np.stack([np.cos(turn), np.sin(turn), np.where(at[same] % 2, 0.5, -0.5)], axis=1)
        r = np.maximum(r, 1e-6)
    return d, r


def spring_layout(ids: list[str], u: np.ndarray, v: np.ndarray, rounds: int = 400, start: np.ndarray | None = None, theta: float = THETA) -> np.ndarray:
    """Fruchterman-Reingold in three dimensions, cooling linearly, from known positions (rows without a null) or the spherical seed."""
    radius = 200.0 * np.sqrt(len(ids) / 1000.0 + 1)
    pos = started(ids, start, radius)
    if not len(u):
        return pos
    k = radius / np.sqrt(len(ids))
    free = np.ones(len(ids), bool)
    for t in range(rounds):
        move = repulsion(pos, np.ones(len(ids)), k * k, 1, theta)
        _attract(pos, u, v, lambda r, _: r / k, move)
        pos = np.clip(_stepped(pos, move, radius * (1 - t / rounds), free), -1e6, 1e6)
    return pos


def started(ids: list[str], start: np.ndarray | None, radius: float) -> np.ndarray:
    """Known positions, and seeds where there are none."""
    pos = seed_positions(pd.Series(ids, dtype=object), radius).to_numpy()
    if start is None:
        return pos
    known = np.isfinite(start).all(axis=1)
    if known.sum() > 1 and np.ptp(start[known, 2]) < 1e-6:
        start = np.column_stack([start[:, :2], np.where(known, pos[:, 2], np.nan)])  # out of a plane
    return np.where(known[:, None], start, pos)


def world_layout(
    ids: list[str],
    u: np.ndarray,
    v: np.ndarray,
    weight: np.ndarray,
    rounds: int = 300,
    gravity: float = 0.02,
    reach: float = 60_000.0,
    start: np.ndarray | None = None,
    pinned: np.ndarray | None = None,
    theta: float = THETA,
) -> np.ndarray:
    """Masses by degree, attraction by the logarithm of the distance, weak gravity.

    Bodies spread with their number; the mean link balances at the mean distance. Without
    pinned bodies the result is scaled so that the 95th percentile lies at `reach`; with
    them, they stay where they are and set the scale; forces are summed for the others only.
    """
    n = len(ids)
    pinned = np.zeros(n, bool) if pinned is None else pinned
    radius = 100.0 * np.cbrt(n / 1000.0 + 1)
    pos = started(ids, start, radius)
    fixed = _reach(pos[pinned]) if pinned.any() else 0.0
    k = (fixed or radius) / np.cbrt(n)
    mass = 1.0 + np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
    mean = mass.mean()
    pull = np.maximum(weight, 1e-9)
    pull = (pull / pull.mean() * k).astype(np.float32) if len(pull) else pull
    free = ~pinned
    pulls = Pulls(n, u, v, pull, free)
    for t in range(rounds):
        move = repulsion(pos, mass, (k / mean) ** 2, 1, theta, free)
        r = np.sqrt((pos * pos).sum(axis=1))
        move -= (gravity * k * mass / mean / np.maximum(r, 1e-9) * (r > 1e-9))[:, None] * pos
        pulls.move(pos, k, move)
        _spots_apart(pos, free, move)
        pos = _stepped(pos, move, max(4 * k * (1 - t / rounds), 0.01 * k), free)
    return pos if pinned.any() else pos * (reach / max(_reach(pos), 1e-9))


def _reach(pos: np.ndarray) -> float:
    """The nearest-rank 95th percentile of the distance from the origin."""
    r = np.sort(np.sqrt((pos * pos).sum(axis=1)))
    return float(r[max(0, int(np.ceil(0.95 * len(r))) - 1)]) if len(r) else 0.0


def layout(nodes: DataFrame, edges: DataFrame, kind: str = "spring", rounds: int | None = None, most: int | None = None) -> DataFrame:
    """id and position of nodes (id; val, pos_x, pos_y, pos_z, pinned where known) under edges (u, v, weight).

    The `most` heaviest nodes (by val, then id) are laid out in one task, as bodies of a
    tree; all others keep the position they have or get their seed where they are read.
    """
    most = MOST_BODIES[kind] if most is None else most
    rounds = ROUNDS[kind] if rounds is None else rounds
    have = set(nodes.columns)
    axes = [F.col(c).cast("double").alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in AXES]
    pinned = F.coalesce(F.col("pinned"), F.lit(False)) if "pinned" in have else F.lit(False)
    heavy = weight() if "val" in have else F.lit(0)
    rows = nodes.select("id", heavy.alias("_w"), *axes, pinned.alias("pinned"))
    # Numbers in the order of ids, in one task of at most `most` rows: links are then two numbers, not two texts.
    chosen = rows.orderBy(F.desc("_w"), "id").limit(most).drop("_w").withColumn("n", F.row_number().over(Window.orderBy("id")) - 1)
    chosen = staged(chosen, "layout-bodies")
    keys = chosen.select("id")
    among = edges.where("u <> v")
    for end in "uv":
        among = among.join(chosen.select(F.col("id").alias(end), F.col("n").alias(f"n{end}")), end)
    among = among.groupBy(F.least("nu", "nv").alias("n"), F.greatest("nu", "nv").alias("v")).agg(F.max(F.col("weight").cast("float"))
        .alias("weight"))
    both = chosen.unionByName(among, allowMissingColumns=True).repartition(1)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, links = [], []
        for b in batches:
            at = b.column("v").is_valid().to_numpy(zero_copy_only=False)
            links.append([b.column(c).to_numpy(zero_copy_only=False)[at].astype(t) for c, t in (("n", np.int32), ("v", np.int32), ("weight",
                np.float32))])
            if not at.all():
                bodies.append(b.filter(pa.array(~at)).to_pandas())
        if not bodies:
            return
        own = pd.concat(bodies).sort_values("n", ignore_index=True)
        ids = own["id"].tolist()
        u, v, w = (np.concatenate(x) for x in zip(*links, strict=True))
        links.clear()
        order = np.argsort(u.astype(np.int64) * len(ids) + v)
        u, v, w = u[order], v[order], w[order]
        start = own[list(AXES)].to_numpy(float)
        fixed = own["pinned"].to_numpy(bool) & np.isfinite(start).all(axis=1)
        if kind == "spring":
            pos = spring_layout(ids, u, v, rounds, start)
        else:
            pos = world_layout(ids, u, v, w, rounds, start=start, pinned=fixed)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string())} | {a: pos[:, k] for k, a in enumerate(AXES)})

    placed = both.mapInArrow(kernel, "id string, pos_x double, pos_y double, pos_z double")
    rest = rows.join(keys, "id", "left_anti")
    if rest.isEmpty():
        return placed
    radius = 1000.0 if kind == "spring" else 60_000.0
    seeds = spherical_seed(rest, radius).select("id", *(F.col(c).alias(f"_{c}") for c in AXES))
    known = rest.join(seeds, "id").select("id", *(F.coalesce(c, f"_{c}").alias(c) for c in AXES))
    return placed.unionByName(known)


def spectral(edges: DataFrame, members: DataFrame, rounds: int = 48) -> DataFrame:
    """id, group_id and a position from -1 to 1 in each group: power iterations on the normalised adjacency.

    Groups are macro groups of communities; each is solved in a task of its own.
    """
    a = members.select(F.col("id").alias("u"), "group_id")
    b = members.select(F.col("id").alias("v"), F.col("group_id").alias("gv"))
    inner = edges.join(a, "u").join(b, "v").where("group_id = gv").select("group_id", "u", "v", F.col("affinity").cast("double").alias("w"))
    own = members.select("group_id", F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("w"))

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(frame["u"].unique())
        u, v, w = np.searchsorted(ids, frame["u"]), np.searchsorted(ids, frame["v"]), frame["w"].to_numpy()
        strength = np.maximum(np.bincount(u, w, len(ids)) + np.bincount(v, w, len(ids)), 1e-12)
        norm = w / np.sqrt(strength[u] * strength[v])
        x = np.cos(1.0 + np.arange(len(ids)))
        for _ in range(rounds):
            x = x + np.bincount(u, norm * x[v], len(ids)) + np.bincount(v, norm * x[u], len(ids))
            x = x - x.mean()
            x = x / max(np.abs(x).max(), 1e-12)
        x = x if x[0] >= 0 else -x
        return pd.DataFrame({"group_id": frame["group_id"].iloc[0], "id": ids, "position": np.where(np.abs(x).max() > 0, x, 0.0)})

    kinds = {c: members.schema[c].dataType.simpleString() for c in ("group_id", "id")}
    return inner.unionByName(own).groupBy("group_id").applyInPandas(kernel, f"group_id {kinds['group_id']}, id {kinds['id']}, position double")


def shell_positions(nodes: DataFrame, radius: float) -> DataFrame:
    """id and a position between 1.3 and 1.6 radii, for communities without links."""

    def make(batches):
        for b in batches:
            unit = seed_positions(b["id"], 1.0).to_numpy()
            r = np.sqrt((unit * unit).sum(axis=1))
            scale = radius * (1.3 + 0.3 * (2 * r - 1)) / r
            yield pd.DataFrame({"id": b["id"], "pos_x": unit[:, 0] * scale, "pos_y": unit[:, 1] * scale, "pos_z": unit[:, 2] * scale})

    return nodes.select("id").mapInPandas(make, "id string, pos_x double, pos_y double, pos_z double")
