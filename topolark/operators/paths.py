"""Walks around walls on a grid of cells, for a few points at a time: the work of one row or one drawing.

A window of cells is laid around the ends. For every cell and way out of it an array tells whether a wall meets the
step; costs then spread as a wave over the whole window until nothing changes, and a walk descends along them. A
window counts if no walk beyond it can be shorter, else it grows until it holds all walls.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

CELL, TOLERANCE = 6.0, 12.0
#: Cells that are tested against lines at a time, and sweeps of a wave between two looks whether it has come to rest.
TESTED, SWEEPS = 100_000, 4
#: Ways out of a cell; each also stands for its reverse.
WAYS = ((1, 0), (0, 1), (1, 1), (1, -1))

Point = tuple[float, float]


def turn_of(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    t = (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    return (t >= 1e-9).astype(np.int8) - (t <= -1e-9)


def boxed(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    low, high = np.minimum(a, b) - 1e-6, np.maximum(a, b) + 1e-6
    return (p[..., 0] >= low[..., 0]) & (p[..., 0] <= high[..., 0]) & (p[..., 1] >= low[..., 1]) & (p[..., 1] <= high[..., 1])


def meet(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether steps a-b meet walls c-d, touching included."""
    t = turn_of(a, b, c), turn_of(a, b, d), turn_of(c, d, a), turn_of(c, d, b)
    found = (t[0] != t[1]) & (t[2] != t[3])
    for turn, ends in zip(t, ((a, b, c), (a, b, d), (c, d, a), (c, d, b))):
        if not turn.all():
            found |= (turn == 0) & boxed(*ends)
    return found


class Walls:
    """Wall lines in buckets, asked whether a straight step meets one."""

    SIZE = 40.0

    def __init__(self, lines: np.ndarray):
        self.lines = np.asarray(lines, float).reshape(-1, 4)
        self.buckets: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, line in enumerate(self.lines):
            for cell in self.cells(*line):
                self.buckets[cell].append(k)

    def cells(self, x1: float, y1: float, x2: float, y2: float):
        xs, ys = (sorted((math.floor(a / self.SIZE), math.floor(b / self.SIZE))) for a, b in ((x1, x2), (y1, y2)))
        return [(i, j) for i in range(xs[0], xs[1] + 1) for j in range(ys[0], ys[1] + 1)]

    def crosses(self, a: Point, b: Point, ignore: float = 0.0) -> bool:
        """ignore: walls an end of which comes this near to an end of the step don't count."""
        near = sorted({k for cell in self.cells(*a, *b) for k in self.buckets.get(cell, ())})
        if not near:
            return False
        some = self.lines[near]
        hit = meet(np.array(a), np.array(b), some[:, :2], some[:, 2:])
        if ignore and hit.any():
            ends = some[hit].reshape(-1, 2, 1, 2) - np.array([a, b], float)
            return bool((np.hypot(ends[..., 0], ends[..., 1]).min((1, 2)) > ignore).any())
        return bool(hit.any())


def inside(points: np.ndarray, ring: list[Point]) -> np.ndarray:
    """Of each point (last axis) whether it lies in the ring."""
    a = np.asarray(ring, float)
    b, found = np.roll(a, -1, axis=0), np.zeros(points.shape[:-1], bool)
    for (ax, ay), (bx, by) in zip(a, b):
        if ay != by:
            spans = (ay > points[..., 1]) != (by > points[..., 1])
            found ^= spans & (points[..., 0] < ax + (points[..., 1] - ay) * (bx - ax) / (by - ay))
    return found


class Ground:
    """A window of cells from low to high, and which steps between them are free."""

    def __init__(self, lines: np.ndarray, low: np.ndarray, high: np.ndarray, ring: list[Point] | None = None, factor: float = 1.0):
        self.low, shape = low, tuple(high - low + 1)
        self.free = np.ones((len(WAYS), *shape), bool)
        corner = np.stack(np.meshgrid(*(np.arange(n) for n in shape), indexing="ij"), -1)
        points, ends = (corner + low) * CELL, np.asarray(lines, float).reshape(-1, 2, 2)
        a = np.maximum(np.floor(ends.min(1) / CELL).astype(int) - 1 - low, 0)
        size = np.maximum(np.minimum(np.ceil(ends.max(1) / CELL).astype(int) + 2 - low, shape) - a, 0)
        count = size.prod(1)
        # The cells of many lines' boxes are tested at a time.
        for some in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(np.cumsum(count) // TESTED)) + 1):
            k = np.repeat(some, count[some])
            at = np.arange(len(k)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            i, j = (a[k] + np.stack((at // size[k, 1], at % size[k, 1]), 1)).T
            hit = meet(points[i, j], points[i, j] + np.array(WAYS)[:, None] * CELL, ends[k, 0], ends[k, 1])
            for way, met in enumerate(hit):
                self.free[way, i[met], j[met]] = False
        #: What it costs to enter a cell, by the length of the step.
        self.toll = np.ones(shape) if not ring or factor <= 1 else np.where(inside(points, ring), 1.0, factor)

    def sides(self, k: int) -> tuple[tuple, tuple]:
        """Slices of the cells that way k leads from, and of those that it leads to."""
        (dx, dy), (nx, ny) = WAYS[k], self.toll.shape
        return (slice(0, nx - dx), slice(max(0, -dy), ny - max(0, dy))), (slice(dx, nx), slice(max(0, dy), ny - max(0, -dy)))

    def costs(self, source: np.ndarray) -> np.ndarray:
        """Least cost from a cell to every cell."""
        cost = np.full(self.toll.shape, np.inf)
        cost[tuple(source)] = 0.0
        steps = []
        for k, way in enumerate(WAYS):
            here, there = self.sides(k)
            for a, b in ((here, there), (there, here)):
                # What a step costs, for ever where a wall meets it.
                steps.append((cost[a], cost[b], np.where(self.free[k][here], CELL * math.hypot(*way) * self.toll[b], np.inf)))
        sums = [np.empty_like(step) for _, _, step in steps]
        while True:
            before = cost.copy()
            for _ in range(SWEEPS):
                for (a, b, step), sum_ in zip(steps, sums):
                    np.minimum(b, np.add(a, step, out=sum_), out=b)
            if np.array_equal(before, cost):
                return cost

    def descent(self, cost: np.ndarray, cell: np.ndarray) -> list[Point]:
        """Points from the source of the costs to a cell."""
        out = [tuple(int(v) for v in cell)]
        while cost[out[-1]] > 0:
            i, j = out[-1]
            ways = []
            for k, (dx, dy) in enumerate(WAYS):
                for sign in (1, -1):
                    u = (i + sign * dx, j + sign * dy)
                    if 0 <= u[0] < cost.shape[0] and 0 <= u[1] < cost.shape[1] and self.free[(k, *(u if sign < 0 else (i, j)))]:
                        ways.append((abs(cost[u] + CELL * math.hypot(dx, dy) * self.toll[i, j] - cost[i, j]), cost[u], u))
            out.append(min(w for w in ways if w[1] < cost[i, j])[2])
        return [tuple(float(v) for v in (np.array(c) + self.low) * CELL) for c in reversed(out)]


def entry(p: Point, lines: np.ndarray) -> np.ndarray | None:
    """The nearest cell around a point that no wall parts from it."""
    around = np.rint(np.array(p) / CELL).astype(int) + np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    for cell in around[np.argsort(np.hypot(*(around * CELL - np.array(p)).T), kind="stable")]:
        if not len(lines) or not meet(np.array(p), cell * CELL, lines[:, :2], lines[:, 2:]).any():
            return cell
    return None


def joined(*points: Point) -> list[Point]:
    return [p for k, p in enumerate(points) if k == 0 or p != points[k - 1]]


def close_lines(lines: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    ends = lines.reshape(-1, 2, 2)
    return lines[((ends.min(1) <= (high + 1) * CELL) & (ends.max(1) >= (low - 1) * CELL)).all(1)]


def fan(start: Point, ends: list[Point], lines: np.ndarray, margin: int) -> Iterator[list[Point] | None]:
    """A walk from start to each of the ends, or None, in one window of so many cells around the start; each is looked for when it's asked for."""
    lines = np.asarray(lines, float).reshape(-1, 4)
    source = entry(start, lines)
    if source is None:
        yield from [None] * len(ends)
        return
    low, high = source - margin, source + margin
    ground = Ground(close_lines(lines, low, high), low, high)
    cost = ground.costs(source - low)
    for end in ends:
        goal = entry(end, lines)
        if goal is None or (goal < low).any() or (goal > high).any() or np.isinf(cost[tuple(goal - low)]):
            yield None
        elif (goal == source).all() and not (len(lines) and meet(np.array(start), np.array(end), lines[:, :2], lines[:, 2:]).any()):
            yield [start, end]
        else:
            yield joined(start, *ground.descent(cost, goal - low), end)


def walk_within(start: Point, end: Point, lines: np.ndarray, margin: int, most: np.ndarray, ring: list[Point] | None = None, factor: float = 1.0) -> tuple[bool, list[Point] | None]:
    """(whether that is known, the cheapest walk or None), in a window of so many cells around the ends.

    most: the corners (low, high) of the window beyond which nothing is; lines: those that come into the window. Cells
    outside the ring, if one is given, cost factor times as much to enter.
    """
    lines = np.asarray(lines, float).reshape(-1, 4)
    source, goal = entry(start, lines), entry(end, lines)
    if source is None or goal is None:
        return True, None
    if (source == goal).all() and not (len(lines) and meet(np.array(start), np.array(end), lines[:, :2], lines[:, 2:]).any()):
        return True, [start, end]
    box = np.array([source, goal])
    low, high = np.maximum(box.min(0) - margin, most[0]), np.minimum(box.max(0) + margin, most[1])
    ground = Ground(close_lines(lines, low, high), low, high, ring, factor)
    cost = ground.costs(source - low)
    reached = cost[tuple(goal - low)]
    if not ((low == most[0]).all() and (high == most[1]).all()) and reached > 2 * CELL * (margin + 1):
        return False, None
    return True, None if np.isinf(reached) else joined(start, *ground.descent(cost, goal - low), end)


def corners(points: np.ndarray) -> np.ndarray:
    """The window (low, high) of cells that holds all points, with some room."""
    return np.array([np.floor(points.min(0) / CELL).astype(int) - 2, np.ceil(points.max(0) / CELL).astype(int) + 2])


def walk(start: Point, end: Point, lines: np.ndarray, ring: list[Point] | None = None, factor: float = 1.0) -> list[Point] | None:
    """The cheapest walk, in a window that grows until none beyond it can be cheaper."""
    lines, margin, known = np.asarray(lines, float).reshape(-1, 4), 4, False
    most = corners(np.concatenate((np.rint(np.array([start, end]) / CELL) * CELL, lines.reshape(-1, 2), np.asarray(ring or [start], float))))
    while not known:
        known, found = walk_within(start, end, lines, margin, most, ring, factor)
        margin *= 2
    return found


def kept_points(points: list[Point], walls: Walls, tolerance: float = TOLERANCE) -> list[int]:
    """Indexes that simplification keeps when a straight piece may neither stray nor cross a wall."""
    if len(points) <= 2:
        return list(range(len(points)))
    p, kept, stack = np.asarray(points, float), {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        base, inner = p[hi] - p[lo], p[lo + 1 : hi] - p[lo]
        length = float(np.hypot(*base))
        off = np.hypot(*inner.T) if length == 0 else np.abs(base[0] * inner[:, 1] - base[1] * inner[:, 0]) / length
        k = int(off.argmax())
        if off[k] > tolerance or walls.crosses(points[lo], points[hi]):
            kept.add(lo + 1 + k)
            stack += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
    return sorted(kept)


def simplified(path: list[Point] | None, walls: Walls) -> list[Point] | None:
    return None if path is None else [path[k] for k in kept_points(path, walls)]


def length_of(path: list[Point]) -> float:
    return sum(math.dist(a, b) for a, b in zip(path, path[1:]))
