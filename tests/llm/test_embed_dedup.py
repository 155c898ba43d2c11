import numpy as np
import pytest

from wayfold.llm.embed_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, key string, v int"


def data():
    r = np.random.default_rng(3)
    rows = []
    for i in range(40):
        base = r.standard_normal(24)
        for _ in range(r.integers(1, 12)):
            rows.append((len(rows), (base + r.standard_normal(24) * r.choice([0.0, 0.05, 0.12, 0.2])).tolist(), int(i % 3)))
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(30)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, rows[0][1], None), (n + 4, [], 1), (n + 5, [1.0, None], 1), (n + 6, [2.0, 0.0], 1), (n + 7, [1.0, 0.0], 1), (n + 8, [float("inf"), 1.0], 1), (None, rows[0][1], 0)]
    return rows


def brute(rows):
    comp, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    def unit(v):
        if not v or any(x is None for x in v):
            return None
        x = np.array(v, dtype=np.float32).astype(float)
        return x / np.linalg.norm(x) if np.isfinite(x).all() and x.any() else None

    u = [unit(v) if i is not None and y is not None else None for i, v, y in rows]
    for i in range(len(rows)):
        for j in range(i):
            if u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d)) if d is not None else None
    return sorted(((d, links[i], low[find(i)], d is not None and d == low[find(i)]) for i, (d, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("cap", [4096, 5])
def test_against_brute_force(spark, cap):
    rows = data()
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    got = sorted(map(tuple, near_vectors(df, cap=cap).collect()), key=str)
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)
    assert sum(g[2] == w[2] and g[3] == w[3] for g, w in zip(got, want, strict=True)) >= 0.97 * len(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_vectors(df).collect() == []
