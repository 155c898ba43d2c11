import random

import numpy as np

from wayfold.llm.langid import held_out
from wayfold.llm.toxicity import BlockMaxIndex, assess, calibrate, fit


def test_index_equals_brute_force():
    r = random.Random(4)

    def vec():
        v = {t: r.choice([0.25, 0.5, 1.0]) for t in r.sample(range(30), r.randint(0, 6))}
        n = sum(x * x for x in v.values()) ** 0.5
        return {t: x / n for t, x in v.items()}

    vectors = [vec() for _ in range(900)]
    vectors += vectors[:100]
    index = BlockMaxIndex(vectors)
    for _ in range(150):
        q = vec()
        want = sorted(((-sum(x * v.get(t, 0) for t, x in q.items()), i) for i, v in enumerate(vectors)))
        want = [(-s, i) for s, i in want if s < 0][:15]
        got = index.nearest(q, 15)
        assert np.allclose([s for s, _ in got], [s for s, _ in want])
        sums = {i: -s for s, i in sorted(((-sum(x * v.get(t, 0) for t, x in q.items()), i) for i, v in enumerate(vectors)))}
        assert all(abs(sums[i] - s) < 1e-9 for s, i in got)


def test_isotonic():
    x, y = calibrate(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and y[1] == 0.5 and len(x) == 3


def rows():
    r = random.Random(6)
    out = []
    for i in range(800):
        bad = r.random() < 0.2
        ws = ["w%d" % r.randrange(50) for _ in range(r.randint(3, 40))] + ([r.choice(["vile", "foul"])] * 2 if bad else [])
        r.shuffle(ws)
        out.append((i, " ".join(ws), int(bad)))
    return out


def test_held_out_and_edges(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in data] + [(900, None, 0.1), (901, "", 0.1), (902, "vile " * 40000, 0.1), (None, "x", 0.1)], "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(3, None), (None, 1), (5, 7), (10**6, 1)], "doc_id long, toxic int")
    found, c = assess(docs, fit(docs, labels, ~held_out(mod=4, left=2)))
    got = {r.doc_id: r for r in found.select("doc_id", f"{c}.*").collect()}
    assert len(got) == 804 and all(0 <= r.score <= 1 for r in got.values())
    assert sum((got[i].score >= 0.3) == bool(y) for i, _, y in data) >= 0.98 * len(data)
    assert got[902].score >= 0.3 and got[902].evidence and got[900].score == got[901].score < 0.3 and not got[900].evidence


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    found, c = assess(docs, fit(docs, labels, ~held_out()))
    assert found.select(f"{c}.score").first()[0] == 0.5
    assert assess(docs.limit(0), fit(docs.limit(0), labels, ~held_out()))[0].count() == 0
