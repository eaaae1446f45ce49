"""Repulsion between many bodies by a tree of cells (an octree in space, a quadtree in the plane).

The tree is the order of the bodies' Morton codes: a cell of a level is a run of equal
code prefixes, so cells, their masses and centres are sums over runs. Groups of bodies that
share a small cell walk the tree at once, level by level: a cell that is small for its
distance from the whole group acts as one body, others are opened. With theta 0 every cell
is opened and the sum is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Levels of the tree; bodies that share a cell of the last one are one bucket.
DEPTH = 20
#: Bodies of a group at most, bodies of a cell that act one by one, and groups that walk the tree at once.
GROUP, FEW, _AT_ONCE = 256, 32, 1024
#: Masses that act on a group at once.
_RUN = 1024


@dataclass
class Level:
    first: np.ndarray  # the first body of each cell, in code order
    last: np.ndarray  # behind its last one
    mass: np.ndarray
    centre: np.ndarray
    child: np.ndarray  # the first of its cells in the next level
    children: np.ndarray


def _spread(x: np.ndarray, dimensions: int) -> np.ndarray:
    """The bits of each number with dimensions - 1 zeros between them."""
    out = np.zeros(len(x), np.uint64)
    for bit in range(DEPTH):
        out |= ((x >> np.uint64(bit)) & np.uint64(1)) << np.uint64(dimensions * bit)
    return out


class Tree:
    """Cells over bodies at positions (n, 2 or 3) with masses."""

    def __init__(self, pos: np.ndarray, mass: np.ndarray) -> None:
        dimensions = pos.shape[1]
        low = pos.min(axis=0)
        self.width = max(float((pos.max(axis=0) - low).max()), 1e-9) * (1 + 1e-9)
        grid = np.minimum((pos - low) / self.width * (1 << DEPTH), (1 << DEPTH) - 1).astype(np.uint64)
        code = np.zeros(len(pos), np.uint64)
        for axis in range(dimensions):
            code |= _spread(grid[:, axis], dimensions) << np.uint64(axis)
        self.order = np.argsort(code, kind="stable")
        code, self.pos, self.mass = code[self.order], pos[self.order], mass[self.order]
        mass_sums = np.concatenate([[0], np.cumsum(self.mass)])
        moment_sums = np.concatenate([np.zeros((1, dimensions)), np.cumsum(self.mass[:, None] * self.pos, axis=0)])
        self.levels: list[Level] = []
        for depth in range(DEPTH + 1):
            prefix = code >> np.uint64(dimensions * (DEPTH - depth))
            first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            last = np.append(first[1:], len(code))
            total = mass_sums[last] - mass_sums[first]
            centre = (moment_sums[last] - moment_sums[first]) / np.maximum(total, 1e-300)[:, None]
            if self.levels:
                above = self.levels[-1]
                above.child = np.searchsorted(first, above.first)
                above.children = np.searchsorted(first, above.last) - above.child
            none = np.zeros(len(first), np.int64)
            self.levels.append(Level(first, last, total, centre, none, none))
            if len(first) == len(code):
                break

    def cells(self) -> int:
        return sum(len(level.first) for level in self.levels)

    def repulsion(self, power: int, theta: float, free: np.ndarray | None = None) -> np.ndarray:
        """For each free body (all, if not given) the sum of mass / distance**power away from every other body; zero for the rest."""
        mine = np.arange(len(self.pos)) if free is None else np.flatnonzero(free[self.order])
        out = np.zeros_like(self.pos)
        if not len(mine):
            return out
        own, sums = self.pos[mine], np.zeros((len(mine), self.pos.shape[1]))
        first, last = self._groups(mine)
        begin, end = np.searchsorted(mine, first), np.searchsorted(mine, last)
        low, high = (f.reduceat(own, begin, axis=0) for f in (np.minimum, np.maximum))
        for lo in range(0, len(first), _AT_ONCE):
            at = slice(lo, lo + _AT_ONCE)
            self._walk(Groups(first[at], last[at], begin[at], end[at], low[at], high[at]), own, power, theta, sums)
        out[self.order[mine]] = sums
        return out

    def _groups(self, mine: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The largest cells with 1 to GROUP of the bodies mine (all, if not given), which walk the tree as one; last cells with more are cut."""
        mine = np.arange(len(self.pos)) if mine is None else mine
        found, above = [], np.zeros(len(self.pos), bool)
        before = np.zeros(len(self.pos) + 1, np.int64)
        before[mine + 1] = 1
        before = np.cumsum(before)
        for depth, level in enumerate(self.levels):
            held = before[level.last] - before[level.first]
            small = held <= GROUP
            new = small & (held > 0) & ~above[level.first]
            found.append((level.first[new], level.last[new]))
            above |= np.repeat(small, level.last - level.first)
            if depth == len(self.levels) - 1:
                for a, b in zip(level.first[~small], level.last[~small], strict=True):
                    cut = mine[before[a] : before[b] : GROUP]
                    found.append((cut, np.append(cut[1:], b)))
        first, last = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(first)
        return first[order], last[order]

    def _walk(self, groups: Groups, own: np.ndarray, power: int, theta: float, out: np.ndarray) -> None:
        """Add what all cells do to groups of bodies: cells small for their distance from a group's box as one body, small ones body by body."""
        group, cell, width = np.arange(len(groups.first)), np.zeros(len(groups.first), np.int64), self.width
        far, near = [], []
        for depth, level in enumerate(self.levels):
            deepest = depth == len(self.levels) - 1
            centre = level.centre[cell]
            gap2 = groups.gap2(group, centre)
            size = level.last[cell] - level.first[cell]
            apart = (level.last[cell] <= groups.first[group]) | (groups.last[group] <= level.first[cell])
            one = apart & (width * width < theta * theta * gap2)
            few = ~one & (size <= FEW)
            if deepest:
                one = ~few
            far.append((group[one], centre[one], level.mass[cell[one]]))
            near.append((group[few], level.first[cell[few]], size[few]))
            if deepest:
                break
            rest = ~(one | few)
            group, cell = group[rest], cell[rest]
            group, cell = _opened(group, level.child[cell], level.children[cell])
            width /= 2
        owner, start, size = (np.concatenate(x) for x in zip(*near, strict=True))
        owner, body = _opened(owner, start, size)
        owner, at, mass = (np.concatenate(x) for x in zip((owner, self.pos[body], self.mass[body]), *far, strict=True))
        # Beside a group squares lose digits; farther away what is rounded is far below what acting as one body leaves out.
        span = groups.high - groups.low
        close = groups.gap2(owner, at) <= ((span * span).sum(axis=1) / 256)[owner] if theta else np.ones(len(owner), bool)
        groups.act(own, owner[close], at[close], mass[close], power, out, np.float64)
        groups.act(own, owner[~close], at[~close], mass[~close], power, out, np.float32)


@dataclass
class Groups:
    """Groups of bodies: their cells' runs in code order, their own runs among the bodies that are moved, and their boxes."""

    first: np.ndarray
    last: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def gap2(self, group: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of points from the groups' boxes."""
        out = np.zeros(len(at))
        for axis in range(at.shape[1]):
            x = at[:, axis]
            gap = np.maximum(np.maximum(self.low[group, axis] - x, x - self.high[group, axis]), 0)
            out += gap * gap
        return out

    def act(self, own: np.ndarray, owner: np.ndarray, at: np.ndarray, mass: np.ndarray, power: int, out: np.ndarray, kind: type) -> None:
        """Add the sums of mass / distance**power that masses do to the groups that own them, by matrix products around each group's middle."""
        if not len(owner):
            return
        order = np.argsort(owner.astype(np.int16), kind="stable")  # a sort by digits; there are _AT_ONCE groups at most
        owner, at, mass = owner[order], at[order], mass[order].astype(kind)
        ends, d, middle = np.searchsorted(owner, np.arange(len(self.first) + 1)), at.shape[1], (self.low + self.high) / 2
        q = np.empty((d + 2, len(at)), kind)
        q[:d], q[d] = (at - middle[owner]).T, 1
        q[d + 1] = (q[:d] * q[:d]).sum(axis=0)
        lo = self.begin[0]
        p = (own[lo : self.end[-1]] - np.repeat(middle, self.end - self.begin, axis=0)).astype(kind)
        left = np.column_stack([-2 * p, (p * p).sum(axis=1), np.ones(len(p), kind)])
        room, least = np.empty(GROUP * _RUN, kind), kind(1e-6)  # fresh pages for each group would cost more than its sums
        for g in np.flatnonzero(ends[1:] > ends[:-1]):
            mine = slice(self.begin[g] - lo, self.end[g] - lo)
            rows = left[mine]
            sums = np.zeros((len(rows), d + 1), kind)
            for a in range(ends[g], ends[g + 1], _RUN):
                run = slice(a, min(a + _RUN, ends[g + 1]))
                cols = q[:, run]
                r2 = np.matmul(rows, cols, out=room[: len(rows) * cols.shape[1]].reshape(len(rows), cols.shape[1]))
                np.maximum(r2, least, out=r2)
                sums += np.divide(mass[run], r2 if power == 1 else r2 ** ((power + 1) / 2), out=r2) @ cols[: d + 1].T
            out[self.begin[g] : self.end[g]] += p[mine] * sums[:, -1:] - sums[:, :-1]


def _opened(owner: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner beside the numbers from its start on."""
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(owner, count), np.repeat(start, count) + step


def repulsion(pos: np.ndarray, mass: np.ndarray, strength: float = 1.0, power: int = 1, theta: float = 0.8, free: np.ndarray | None = None) -> np.ndarray:
    """strength * mass * mass / distance**power, away from one another; only of free bodies, if they are given."""
    return strength * mass[:, None] * Tree(pos, mass).repulsion(power, theta, free)
