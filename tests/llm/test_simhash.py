import random

import pytest
import xxhash

from wayfold.llm.simhash import fingerprint, near_duplicates


def brute_print(text, words=3):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=3):
    fps = [brute_print(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        ids = [x for x in (low.get(r), d) if x is not None]
        low[r] = min(ids) if ids else None
    return sorted(((d, f"{fps[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    r = random.Random(7)
    vocabulary = ["w%d" % i for i in range(60)] + ["É", "ß", "Ü"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "one two"), (None, "one two"), (6, "a b c d " * 3000)]
    base = [r.choice(vocabulary) for _ in range(300)]
    for i in range(7, 150):
        ws = list(base) if i % 2 else [r.choice(vocabulary) for _ in range(r.randint(1, 40))]
        for _ in range(r.randint(0, 4)):
            ws[r.randrange(len(ws))] = r.choice(vocabulary)
        rows.append((i, " ".join(ws)))
    return rows + [(149, rows[-1][1])]


@pytest.mark.parametrize("cap", [8192, 8])
def test_against_brute_force(spark, cap):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, fp string, part int, key int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df, cap=cap).collect()), key=str)
    assert got == brute(rows)


def test_wide_radius(spark):
    rows = [r for r in corpus() if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df, radius=7).collect()), key=str)
    assert got == brute(rows, 7)


def test_empty_and_print(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    for t in ("A b", "a B c d e", "x " * 20000):
        assert fingerprint(t, 3) == brute_print(t)
