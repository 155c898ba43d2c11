import random

import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm import simhash
from wayfold.llm.simhash import keep_one

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t, n=5):
    ws = t.lower().split()
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))}


def near_rows():
    r = random.Random(12)
    rows = []
    for g in range(25):
        base = ["%s%d" % (r.choice("abcdef"), r.randrange(400)) for _ in range(r.randint(80, 200))]
        for _ in range(r.randint(1, 5)):
            ws = list(base)
            for _ in range(r.choice([0, 1, 2, 12])):
                ws[r.randrange(len(ws))] = "new%d" % r.randrange(10**6)
            rows.append((len(rows), " ".join(ws)))
    return rows


def brute_keep(rows):
    comp = {i: i for i, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    return sorted({find(i) for i, _ in rows})


def test_keep_one_against_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in keep_one(df).collect()) == brute_keep(rows)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "x", "y", 0), (None, "q w e", None, None, 1), (7, "a b", "x", "y", 3), (7, "a b", "x", "y", 3)], SCHEMA)
    assert sorted((r.doc_id for r in keep_one(odd).collect()), key=str) == [1, 7, None]
    assert keep_one(df.limit(0)).count() == 0


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(3)
    words = ["the", "thing", "when", "where", "then", "other", "into", "river", "stone", "paper"]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", "s", "er"]) for _ in range(n))
    docs = [(i, text(60), "en", "s", 0) for i in range(40)]
    docs += [(100, docs[3][1], "en", "s", 0), (101, docs[4][1] + " more", "en", "s", 0), (102, "42 -- 17", "en", "s", 0), (103, None, "en", "s", 0), (104, text(30) + " token = abcdef123456 " + text(30), "en", "s", 0)]
    item = text(25)
    docs += [(105, text(20) + " " + item.upper() + " " + text(20), "en", "s", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def test_stages(spark, folder):
    path, docs = folder
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(out) == {*range(40), 104}
    assert all(r.round_trip for r in out.values())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {i: t for i, t, *_ in docs}
    texts[104] = texts[104].replace("token = abcdef123456", "[REDACTED]")
    assert all(r.ids == library.encode(texts[i]) for i, r in out.items())


def test_columns_stay(spark, folder):
    path, _ = folder
    df = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, path).columns == df.columns


def copies(n, seed):
    """n texts of one base, each with a block of 18 words of its own."""
    r = random.Random(seed)
    base = [f"b{seed}x{i}" for i in range(300)]
    out = []
    for k in range(n):
        at = r.randrange(283)
        out.append(" ".join([*base[:at], *(f"c{seed}x{k}x{i}" for i in range(18)), *base[at + 18 :]]))
    return out


@pytest.mark.parametrize("cap", [2048, 300])
def test_large_groups_of_near_copies(spark, cap):
    texts = copies(100, 1) + copies(700, 2) + copies(30, 3)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in keep_one(df, cap=cap).collect()) == brute_keep(rows)


def test_repeated_lines_do_not_make_duplicates(spark):
    line = " ".join(f"line{i}" for i in range(11))
    rows = [(k, " ".join([line] * n + [f"own{k}x{i}" for i in range(m)])) for k, (n, m) in enumerate([(40, 100)] * 6 + [(100, 300)] * 6)]
    assert brute_keep(rows) == list(range(12))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(df).collect()) == list(range(12))


def planted(pairs, seed):
    """Rows (2k, text) and (2k + 1, a text like it): text appended, one block changed, words changed, a line repeated."""
    r = random.Random(seed)
    rows = []
    for k in range(pairs):
        n = r.choice([60, 200, 800])
        ws = [f"w{k}x{i}" for i in range(n)]
        other, part = list(ws), r.uniform(0.07, 0.25)
        if k % 4 == 0:
            other += [f"a{k}x{i}" for i in range(int(n * part))]
        elif k % 4 == 1:
            m = max(1, int(n * part / 2) - 4)
            at = r.randrange(n - m)
            other[at : at + m] = [f"c{k}x{i}" for i in range(m)]
        elif k % 4 == 2:
            for _ in range(max(1, int(n * part / 10))):
                other[r.randrange(n)] = f"e{k}x{r.random()}"
        else:
            at = r.randrange(n - 11)
            other = ws[: at + 11] + ws[at : at + 11] * 5 + ws[at + 11 :]
        rows += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(other))]
    return rows


def test_recall_on_planted_pairs(spark):
    rows = planted(600, 5)
    alike = [k for k in range(600) if len((a := shingles(rows[2 * k][1])) & (b := shingles(rows[2 * k + 1][1]))) >= 0.8 * len(a | b)]
    assert 200 < len(alike) < 590
    kept = {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [k for k in alike if 2 * k + 1 not in kept]
    assert len(found) == len(alike), f"{len(found)} of {len(alike)}"
    assert len(kept) == 1200 - len(alike)


def brute_classes(rows, radius=3):
    """Components of the links of Jaccard similarity 0.8 or more within classes of SimHash fingerprints, by least row."""
    sets = [shingles(t) for _, t in rows]
    prints = []
    for s in sets:
        h = [xxhash.xxh64_intdigest(" ".join(x), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))

    def joined(link):
        comp = list(range(len(rows)))
        for k in range(len(rows)):
            for j in range(k):
                if comp[k] != comp[j] and link(j, k):
                    low, high = sorted((comp[j], comp[k]))
                    comp = [low if c == high else c for c in comp]
        return comp

    near = joined(lambda j, k: (prints[j] ^ prints[k]).bit_count() <= radius)
    return joined(lambda j, k: near[j] == near[k] and len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k]))


def test_simhash_gives_the_first_links(spark, monkeypatch):
    rows = near_rows() + [(1000 + k, " ".join([f"line{i}" for i in range(11)] * 40 + [f"own{k}x{i}" for i in range(60)])) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    plain = simhash.simhash_links
    monkeypatch.setattr(simhash, "simhash_links", lambda *a: found.append(plain(*a)) or found[0])
    keep_one(df).collect()
    node = {simhash.set_node(simhash.shingle_set(t, 5)): k for k, (_, t) in reversed(list(enumerate(rows)))}
    comp = [node[simhash.set_node(simhash.shingle_set(t, 5))] for _, t in rows]
    for r in found[0].collect():
        low, high = sorted((comp[node[r.a]], comp[node[r.b]]))
        comp = [low if c == high else c for c in comp]
    assert comp == brute_classes(rows)
    assert len({comp[k] for k in range(len(rows))}) < len({t for _, t in rows})


def test_few_files_hold_the_links(spark, tmp_path):
    """Many tasks make few rows: they are not to be written in a file each."""
    from wayfold.llm.store import gathered

    df = spark.range(0, 1000, 1, 100).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert len(gathered(df, "links").inputFiles()) <= spark.sparkContext.defaultParallelism
    assert gathered(df, "links").count() == 1000


def test_few_links_join_as_many_do(spark):
    from wayfold.llm.components import connected_components

    r = random.Random(4)
    links = [(r.randrange(-150, 150), r.randrange(-150, 150)) for _ in range(160)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    assert sorted(connected_components(df, few=1000).collect()) == sorted(connected_components(df).collect())
    assert connected_components(df.limit(0), few=1000).count() == 0
