"""Steps that are sequential by nature, as NumPy and Python functions of one group's rows.

Each takes one bounded group (a tile, a road, a component of a network); the DataFrame operators
that deal the groups out are beside the queries that use them.
"""

from __future__ import annotations

import heapq
from math import hypot

import numpy as np


def diffuse(image: np.ndarray, iterations: int, rate: float, k: float) -> np.ndarray:
    """Edge-preserving diffusion of a byte image, in place: each pixel but those at the border takes its four neighbours' differences, damped where they are large.

    The sweep goes down columns from the left, so a pixel sees its upper and left neighbours as
    already changed. Pixels of one anti-diagonal do not see each other, so each is done at once.
    """
    a = image.astype(np.uint8).astype(float)
    rows, cols = a.shape
    for _ in range(iterations):
        for d in range(2, rows + cols - 3):
            r = np.arange(max(1, d - cols + 2), min(rows - 2, d - 1) + 1)
            c = d - r
            here = a[r, c]
            step = 0.0
            for near in (a[r - 1, c], a[r + 1, c], a[r, c + 1], a[r, c - 1]):
                diff = near - here
                step = step + np.exp(-((np.abs(diff) / k) ** 2)) * diff
            a[r, c] = np.trunc(here + rate * step) % 256
    return a.astype(np.uint8)


def diffused(values: np.ndarray, iterations: int = 50, rate: float = 0.05, k: float = 20, passes: int = 2) -> np.ndarray:
    """Diffusion of values 0..1 as bytes, `passes` times. Missing values count 0."""
    a = np.nan_to_num(values)
    for _ in range(passes):
        a = diffuse(np.clip(a * 255, 0, 255), iterations, rate, k) / 255
    return a


def enhance_edges(values: np.ndarray, iterations: int = 50, rate: float = 0.05, k: float = 20, passes: int = 2, upper: float = 0.995) -> np.ndarray:
    """diffused(), then stretched to 0..1 with all over the upper quantile as 1."""
    a = diffused(values, iterations, rate, k, passes)
    lo, hi = a.min(), np.quantile(a, upper)
    return np.clip((a - lo) / (hi - lo), 0, 1) if hi > lo else np.zeros_like(a)


def simplify(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices stay, by splitting each stretch at its farthest vertex while that is over the tolerance from the chord."""
    keep = np.zeros(len(x), dtype=bool)
    if not len(x):
        return keep
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        px, py = x[a + 1 : b], y[a + 1 : b]
        dx, dy = x[b] - x[a], y[b] - y[a]
        n = dx * dx + dy * dy
        t = np.clip(((px - x[a]) * dx + (py - y[a]) * dy) / n, 0, 1) if n else np.zeros(len(px))
        d = np.hypot(px - x[a] - t * dx, py - y[a] - t * dy)
        far = int(np.argmax(d))
        if d[far] > tolerance:
            m = a + 1 + far
            keep[m] = True
            todo += [(a, m), (m, b)]
    return keep


def smooth(t: np.ndarray, v: np.ndarray, strength: float) -> np.ndarray:
    """Whittaker smoothing of v at places t: least squares plus `strength` times the squared second divided differences."""
    n = len(t)
    if n < 3:
        return v.astype(float)
    h = np.diff(t)
    d = np.zeros((n - 2, n))
    i = np.arange(n - 2)
    d[i, i], d[i, i + 1], d[i, i + 2] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    return np.linalg.solve(np.eye(n) + strength * (d.T @ d), v.astype(float))


def smooth_line(t: np.ndarray, x: np.ndarray, y: np.ndarray, strength: float = 50.0, outlier: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which vertices stay, x, y): a smoothed line; vertices `outlier` or more off it are dropped and the rest smoothed again, if over three stay. Equal places keep the first."""
    stay = np.r_[True, np.diff(t) > 0]
    sx, sy = smooth(t[stay], x[stay], strength), smooth(t[stay], y[stay], strength)
    fine = (np.abs(sx - x[stay]) < outlier) & (np.abs(sy - y[stay]) < outlier)
    if not fine.all() and fine.sum() > 3:
        at = np.flatnonzero(stay)[fine]
        stay = np.zeros(len(t), dtype=bool)
        stay[at] = True
        sx, sy = smooth(t[stay], x[stay], strength), smooth(t[stay], y[stay], strength)
    return stay, sx, sy


NEIGHBOURS = [(dx, dy, hypot(dx, dy)) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def least_cost(cells: dict[tuple[int, int], float], start: tuple[int, int], goal: tuple[int, int], res: float) -> tuple[float, list[tuple[int, int]]]:
    """(cost, cells of the path) over 8 neighbours; a step costs its length by the mean conductivity of both cells, and none leads between two of 0. Infinite and empty if there is no way."""
    best = {start: 0.0}
    came: dict[tuple[int, int], tuple[int, int]] = {}
    heap = [(0.0, start)]
    done = set()
    while heap:
        cost, at = heapq.heappop(heap)
        if at in done:
            continue
        if at == goal:
            path = [at]
            while path[-1] != start:
                path.append(came[path[-1]])
            return cost, path[::-1]
        done.add(at)
        own = cells[at]
        for dx, dy, far in NEIGHBOURS:
            to = (at[0] + dx, at[1] + dy)
            other = cells.get(to)
            if other is None or to in done or own + other <= 0:
                continue
            c = cost + 2 * far * res / (own + other)
            if c < best.get(to, float("inf")):
                best[to] = c
                came[to] = at
                heapq.heappush(heap, (c, to))
    return float("inf"), []


Line = list[tuple[float, float]]


def measures(line: Line) -> list[float]:
    out = [0.0]
    for (a, b), (c, d) in zip(line, line[1:]):
        out.append(out[-1] + hypot(c - a, d - b))
    return out


def place(line: Line, m: float) -> tuple[float, float]:
    """The point at a measure, kept within the line."""
    ms = measures(line)
    for i in range(len(line) - 1):
        if m <= ms[i + 1] or i == len(line) - 2:
            t = 0.0 if ms[i + 1] == ms[i] else min(1.0, max(0.0, (m - ms[i]) / (ms[i + 1] - ms[i])))
            return line[i][0] + t * (line[i + 1][0] - line[i][0]), line[i][1] + t * (line[i + 1][1] - line[i][1])
    return line[0]


def project(line: Line, p: tuple[float, float]) -> float:
    """The measure of the line's nearest point to p."""
    ms, best = measures(line), (float("inf"), 0.0)
    for i, ((a, b), (c, d)) in enumerate(zip(line, line[1:])):
        n = (c - a) ** 2 + (d - b) ** 2
        t = min(1.0, max(0.0, ((p[0] - a) * (c - a) + (p[1] - b) * (d - b)) / n)) if n else 0.0
        best = min(best, (hypot(p[0] - a - t * (c - a), p[1] - b - t * (d - b)), ms[i] + t * (ms[i + 1] - ms[i])))
    return best[1]


def meetings(line: Line, other: Line) -> list[tuple[float, float]]:
    """(measure on line, measure on other) of all places where two lines meet, parallel stretches apart."""
    out, ma, mb = [], measures(line), measures(other)
    for i, (p, q) in enumerate(zip(line, line[1:])):
        for j, (r, s) in enumerate(zip(other, other[1:])):
            ux, uy, vx, vy = q[0] - p[0], q[1] - p[1], s[0] - r[0], s[1] - r[1]
            det = ux * vy - uy * vx
            if det:
                t = ((r[0] - p[0]) * vy - (r[1] - p[1]) * vx) / det
                u = ((r[0] - p[0]) * uy - (r[1] - p[1]) * ux) / det
                if -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= u <= 1 + 1e-9:
                    out.append((ma[i] + t * (ma[i + 1] - ma[i]), mb[j] + u * (mb[j + 1] - mb[j])))
    return out


def cut(line: Line, m: float) -> tuple[Line, Line]:
    """Both parts of a line cut at a measure; each has the cut."""
    ms, p = measures(line), place(line, m)
    return [v for v, x in zip(line, ms, strict=True) if x < m - 1e-9] + [p], [p] + [v for v, x in zip(line, ms, strict=True) if x > m + 1e-9]


FAR = 999_999.0

#: Why a node could not be snapped.
TOO_FAR = "Distance from expected junction exceeds tolerance"
LOOPS = "Junction contains one loop and at least two other roads"
AT_END = "Junction weirdly occurs at exactly one end of a road"
NO_SPLIT = "Issue occured during a splitting operation"
APART = "Road doesn't seem to intersect with others inside node"


def snap_nodes(lines: dict[int, Line], nodes: list[dict], tolerance: float) -> list[tuple[float, float, str, str]]:
    """Moves, in place, the ends of lines that belong together at nodes; gives warnings (x, y, message, ids).

    A node has x, y, members (line_id, is_end, updatable) and bridge, the two members that are one
    road. Nodes go in order, as one may move a line that a later one uses. Two members meet at
    their middle; so do a loop and one road. Of more, the bridge's two lines are joined, the others
    are drawn on to it, and all meet at the mean of the places where they do so.
    """
    warnings: list[tuple[float, float, str, str]] = []

    def tip(member: tuple) -> tuple[float, float]:
        return lines[member[0]][-1 if member[1] else 0]

    def put(member: tuple, p: tuple[float, float]) -> None:
        line = list(lines[member[0]])
        line[-1 if member[1] else 0] = p
        lines[member[0]] = line

    for node in nodes:
        members = node["members"]
        if not any(m[2] for m in members):
            continue
        ids = ", ".join(str(i) for i in dict.fromkeys(m[0] for m in members))

        def warn(message: str, about: str = ids) -> None:
            warnings.append((node["x"], node["y"], message, about))

        one, two = node["bridge"]
        (ax, ay), (bx, by) = tip(one), tip(two)
        middle = (ax + bx) / 2, (ay + by) / 2
        if hypot(ax - bx, ay - by) / 2 > tolerance:
            warn(TOO_FAR)
            continue
        if len(members) == 2:
            put(one, middle)
            put(two, middle)
            continue
        roads = {m[0] for m in members}
        if len(roads) < len(members):
            if len(roads) == 2 and len(members) == 3:
                for m in members:
                    put(m, middle)
            else:
                warn(LOOPS)
            continue
        first = lines[one[0]] if one[1] else lines[one[0]][::-1]
        second = lines[two[0]][::-1] if two[1] else lines[two[0]]
        bridge = first[:-1] + [middle] + second[1:]
        expected = measures(first[:-1] + [middle])[-1]
        rest, hits, missed = [m for m in members if m not in (one, two)], {}, False
        for m in rest:
            line = lines[m[0]] if m[1] else lines[m[0]][::-1]
            (px, py), (qx, qy) = line[-2], line[-1]
            n = hypot(qx - px, qy - py) or 1.0
            drawn = line[:-1] + [(qx + FAR * (qx - px) / n, qy + FAR * (qy - py) / n)]
            found = [(abs(b - expected), b, a) for a, b in meetings(drawn, bridge)]
            if found:
                hits[m] = (min(found), drawn)
            else:
                missed = True
        worst = float("inf") if missed else max(h[0][0] for h in hits.values())
        if worst > tolerance:
            warn(TOO_FAR)
            continue
        at = sum(h[0][1] for h in hits.values()) / len(hits)
        if at <= 0:
            warn(AT_END)
            continue
        if at >= measures(bridge)[-1]:
            warn(NO_SPLIT)
            continue
        junction = place(bridge, at)
        left, right = cut(bridge, at)
        lines[one[0]] = left if one[1] else left[::-1]
        lines[two[0]] = right[::-1] if two[1] else right
        for m, ((_, _, along), drawn) in hits.items():
            kept = [v for v, x in zip(drawn, measures(drawn), strict=True) if x < along - 1e-9]
            if not kept:
                warn(APART, str(m[0]))
                continue
            new = kept + [junction]
            new = [v for k, v in enumerate(new) if not k or v != new[k - 1]]
            lines[m[0]] = new if m[1] else new[::-1]
    return warnings
