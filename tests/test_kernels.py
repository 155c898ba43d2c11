import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.operators import kernels as K


def naive_diffuse(img, n, lam, k):
    a = img.astype(np.uint8).copy()
    rows, cols = a.shape
    for _ in range(n):
        for c in range(1, cols - 1):
            for r in range(1, rows - 1):
                here, total = float(a[r, c]), 0.0
                for v in (a[r - 1, c], a[r + 1, c], a[r, c + 1], a[r, c - 1]):
                    d = float(v) - here
                    total += math.exp(-((abs(d) / k) ** 2)) * d
                a[r, c] = int(here + lam * total) % 256
    return a


def test_diffusion_is_the_sweep():
    r = np.random.default_rng(1)
    for shape in ((3, 3), (5, 9), (12, 7), (2, 4), (1, 1)):
        img = r.integers(0, 256, shape)
        assert np.array_equal(K.diffuse(img, 6, 0.2, 10), naive_diffuse(img, 6, 0.2, 10))
        assert np.array_equal(K.diffuse(img, 3, 0.05, 20), naive_diffuse(img, 3, 0.05, 20))


def test_enhanced_edges_are_within_one():
    out = K.enhance_edges(np.array([[np.nan, 0.2, 0.4], [0.1, 0.9, 1.0], [0.3, 0.3, 0.3]]))
    assert out.min() == 0 and out.max() == 1
    assert (K.enhance_edges(np.full((4, 4), 0.5)) == 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=2, max_size=30), st.floats(0.1, 10))
def test_simplified_lines_stay_near(points, tolerance):
    x, y = (np.array(v) for v in zip(*points))
    keep = K.simplify(x, y, tolerance)
    assert keep[0] and keep[-1]
    line = [p for p, k in zip(points, keep) if k]
    for p in points:
        q = K.place(line, K.project(line, p))
        assert math.hypot(p[0] - q[0], p[1] - q[1]) <= tolerance + 1e-6


def test_smoothing():
    t = np.arange(0, 100, 10.0)
    stay, x, y = K.smooth_line(t, 2 * t + 1, -t)
    assert stay.all() and np.allclose(x, 2 * t + 1) and np.allclose(y, -t)
    bad = -t.copy()
    bad[5] += 400
    stay, x, y = K.smooth_line(t, 2 * t, bad)
    assert not stay[5] and np.abs(np.diff(y)).max() < 200
    assert K.smooth_line(np.array([0.0, 0.0, 1.0]), np.zeros(3), np.ones(3))[0].tolist() == [True, False, True]


def bellman(cells, start, goal):
    dist = {c: math.inf for c in cells}
    dist[start] = 0
    for _ in cells:
        for (a, b), v in cells.items():
            for dx, dy, far in K.NEIGHBOURS:
                w = cells.get((a + dx, b + dy))
                if w is not None and v + w > 0:
                    dist[a + dx, b + dy] = min(dist[a + dx, b + dy], dist[a, b] + 2 * far * 2 / (v + w))
    return dist[goal]


def test_least_cost():
    r = random.Random(5)
    for _ in range(15):
        cells = {(i, j): r.choice([0.0, 0.1, 0.5, 1.0]) for i in range(6) for j in range(5) if r.random() < 0.9}
        cells[0, 0] = cells[5, 4] = 1.0
        cost, path = K.least_cost(cells, (0, 0), (5, 4), 2)
        want = bellman(cells, (0, 0), (5, 4))
        assert math.isinf(cost) and math.isinf(want) or abs(cost - want) < 1e-9
        assert not path or path[0] == (0, 0) and path[-1] == (5, 4)
    assert K.least_cost({(0, 0): 0.0, (1, 0): 0.0}, (0, 0), (1, 0), 1) == (math.inf, [])


def node(members, bridge, x=0, y=0):
    return {"x": x, "y": y, "members": members, "bridge": bridge}


def test_two_ends_meet_in_the_middle():
    lines = {1: [(0, 0), (9, 0)], 2: [(11, 2), (20, 0)]}
    a, b = (1, True, True), (2, False, False)
    assert K.snap_nodes(lines, [node([a, b], (a, b))], 5) == []
    assert lines[1][-1] == lines[2][0] == (10, 1)


def test_too_far_and_not_updatable():
    lines = {1: [(0, 0), (9, 0)], 2: [(31, 0), (40, 0)]}
    a, b = (1, True, True), (2, False, True)
    assert K.snap_nodes(lines, [node([a, b], (a, b))], 5)[0][2] == K.TOO_FAR
    still = (1, True, False), (2, False, False)
    assert K.snap_nodes(lines, [node(list(still), still)], 50) == [] and lines[1][-1] == (9, 0)


def test_third_road_is_drawn_on():
    lines = {1: [(0, 0), (10, 0)], 2: [(10, 0), (20, 0)], 3: [(11, 9), (11, 2)]}
    a, b, c = (1, True, True), (2, False, True), (3, True, True)
    assert K.snap_nodes(lines, [node([a, b, c], (a, b))], 5) == []
    assert lines[1][-1] == lines[2][0] == lines[3][-1] == (11, 0) and lines[3][0] == (11, 9)


def test_road_that_crosses_is_trimmed():
    lines = {1: [(0, 0), (10, 0)], 2: [(20, 0), (10, 0)], 3: [(9, -4), (9, 9)]}
    a, b, c = (1, True, True), (2, True, True), (3, False, True)
    assert K.snap_nodes(lines, [node([a, b, c], (a, b))], 5) == []
    assert lines[3] == [(9, 0), (9, 9)] and lines[2][-1] == lines[1][-1] == (9, 0)


def test_loops():
    lines = {1: [(0, 0), (5, 5), (1, 0)], 2: [(-9, 0), (0, 1)], 3: [(0, -9), (0, 0)]}
    one, two, road = (1, False, True), (1, True, True), (2, True, True)
    assert K.snap_nodes(lines, [node([one, two, road], (one, road))], 5) == []
    assert lines[1][0] == lines[1][-1] == lines[2][-1] == (0, 0.5)
    more = (3, True, True)
    assert K.snap_nodes(lines, [node([one, two, road, more], (one, road))], 5)[0][2] == K.LOOPS


@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=2, max_size=12), st.floats(0.01, 0.99))
def test_cut_keeps_the_length(line, share):
    total = K.measures(line)[-1]
    a, b = K.cut(line, share * total)
    assert abs(K.measures(a)[-1] + K.measures(b)[-1] - total) < 1e-6 * max(1, total)
