import hashlib
import random
import re

import pytest

from wayfold.llm.decontam import contamination, decontaminate

RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(t):
    return RX.findall((t or "").translate(LOW))


def brute(docs, items, n=10):
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for i, b in items:
            p = words(b)
            m = min(n, len(p))
            for s in range(len(p) - m + 1) if p else []:
                for at in range(len(w) - m + 1):
                    if w[at : at + m] == p[s : s + m]:
                        hit |= set(range(at, at + m))
                        ids |= {str(i)} - {"None"}
        ids = sorted(ids)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def tables():
    r = random.Random(3)
    v = ["a", "b", "É", "Ü9", "c0", "K"]
    items = [(i, r.choice([" ", "-", ". "]).join(r.choice(v) for _ in range(r.choice([2, 3, 9, 10, 14])))) for i in range(12)]
    items += [(7, "solo"), (100, "solo"), (None, "odd one"), (13, None), (14, ""), (15, "..."), items[0]]
    docs = [(i, " ".join(r.choice(v) for _ in range(r.randint(0, 60)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "x " * 30000 + items[5][1].upper()), (63, "so solo."), (63, "so solo."), (None, "Odd ONE"), (64, items[4][1] + "! " + items[4][1])]
    return docs, items


@pytest.mark.parametrize("slice_bytes", [2_000_000, 150])
def test_against_brute_force(spark, slice_bytes):
    docs, items = tables()
    d = spark.createDataFrame([(a, b, "q") for a, b in docs], "doc_id long, text string, contamination string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got, c = contamination(d, b, slice_bytes=slice_bytes)
    rows = got.select("doc_id", f"{c}.n_words", f"{c}.n_hit", f"{c}.n_items", f"{c}.items_sha256").collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, items)


def test_filter_and_empty(spark):
    d = spark.createDataFrame([(1, "the quick brown fox"), (2, "fine"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "Quick, brown")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate(d, b).collect()) == [2, 3]
    assert decontaminate(d, b.limit(0)).count() == 3
    assert decontaminate(d.limit(0), b).count() == 0
