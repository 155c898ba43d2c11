import random
import tracemalloc
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from wayfold.llm import sp_lattice as sp
from wayfold.llm.sp_lattice import Pieces, decode, encode, lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts(n=400):
    r = random.Random(9)
    bits = [" ", "  ", "the", "Über", "ing", "tion", ".", ",!", "é", "漢", "\n", "\t", "0", "12", "▁", "\U0001f600", "zzq", "é", "'s", "(", "ß", "queos", "rendre", "a", "aa", "===", "and", "Th"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("limit", [100_000_000, 1500])
def test_ids_are_the_library_s(spark, limit):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (901, ""), (902, "abc" * 300), (903, "word and " * 20000), (904, "a" * 399 + " " * 501), (None, "x y"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(a, b, [1]) for a, b in rows], "doc_id long, text string, piece_ids array<int>")
    ids, c = encode(df, PATH, limit=limit)
    back, d = decode(ids, PATH, c)
    got = sorted(((r[0], r[1], r[2], r[3]) for r in back.select("doc_id", "text", c, d).collect()), key=str)
    assert len(got) == len(rows)
    for i, t, x, y in got:
        assert x == (library.encode(t) if t else []), repr(t)
        assert y == (t or "") or "▁" in t, repr(t)
    assert encode(df.limit(0), PATH)[0].count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.sql("select cast(X'61FF62' as string) text")
    assert encode(df, PATH)[0].first().piece_ids == sentencepiece.SentencePieceProcessor(model_file=PATH).encode("a�b")


def merged(unit, p):
    part = list(unit)
    while True:
        r, i = min(((p.rank.get(a + b, sp.NEVER), k) for k, (a, b) in enumerate(zip(part, part[1:]))), default=(sp.NEVER, 0))
        if r == sp.NEVER:
            return [i for x in part for i in ([p.ids[x]] if x in p.ids else p.byte and [p.byte[b] for b in x.encode()] or [p.unknown])]
        part[i : i + 2] = [part[i] + part[i + 1]]


def rows_of(spark, units):
    return spark.createDataFrame([(k, u, 1) for k, u in enumerate(units)], "uid long, unit string, n long").repartition(4, "uid")


def test_survivors_are_the_merges(spark):
    """Small random vocabularies of pieces that rank after their parts, over two letters: ties and overlaps abound."""
    for seed in range(4):
        r = random.Random(seed)
        pieces = ["a", "b", "c"]
        for _ in range(r.randint(3, 12)):
            x = r.choice(pieces) + r.choice(pieces)
            if x not in pieces and len(x) < 9:
                pieces.append(x)
        many = [x for x in pieces if len(x) > 1]
        order = many + ["a", "b", "c"]
        p = Pieces({x: i for i, x in enumerate(order)}, {x: i for i, x in enumerate(order)}, {x: -float(i) for i, x in enumerate(order)}, [], 99, [], False, False, max(map(len, order)))
        try:
            p.spines
        except ValueError:
            continue
        units = sorted({"".join(r.choice("abcx" if r.random() < 0.1 else "ab") for _ in range(r.choice([1, 2, 5, 9, 14, 33, 80]))) for _ in range(150)})
        for row in lattice(rows_of(spark, units), p).collect():
            assert row.ids == merged(row.unit, p), (row.unit, many)


def test_viterbi_against_brute_force(spark):
    vocabulary = {"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -2.0, "aab": -3.0, "abab": -3.5, "c": -1.5, "bc": -3.5}
    order = sorted(vocabulary, key=lambda p: -vocabulary[p])
    p = Pieces({s: i for i, s in enumerate(vocabulary)}, {s: k for k, s in enumerate(order)}, vocabulary, [], 99, [], True, False, 4)
    r = random.Random(2)
    units = sorted({"".join(r.choice("abcx") for _ in range(r.randint(1, 40))) for _ in range(120)})
    low = min(vocabulary.values()) - 10

    def best(u):
        out = [0.0]
        for e in range(1, len(u) + 1):
            out.append(max([out[s] + vocabulary[u[s:e]] for s in range(max(0, e - 4), e) if u[s:e] in vocabulary] + ([out[e - 1] + low] if u[e - 1] not in vocabulary else [])))
        return out[-1]

    names = {i: s for s, i in p.ids.items()}
    found = lattice(rows_of(spark, units), p).collect()
    assert len(found) == len(units)
    for row in found:
        assert "".join(names.get(i, "x") for i in row.ids) == row.unit
        assert abs(sum(vocabulary[names[i]] if i != 99 else low for i in row.ids) - best(row.unit)) < 1e-6


def test_two_hashes_are_spark_s(spark):
    units = ["", "a", "▁thé", "\U0001f600"]
    df = spark.createDataFrame([(u,) for u in units], "unit string").select("unit", *(h.alias(n) for h, n in zip(sp._hashes("unit"), "hg")))
    for r in df.collect():
        a, b = (sp.xxhash.xxh64_intdigest(r.unit.encode(), s) for s in sp.SEEDS)
        assert (r.h % 2**64, r.g) == (a, b % 2**32)


def test_edges_are_folded_as_they_come(spark):
    """No grouping holds the edges as objects, and no unit is torn where a fold or a batch ends."""
    p = sp.pieces_of(PATH)
    units = ["▁" + u for u in ("the", "a" * 70, "漢", "Übergangsregelung" * 9, "thingonst", "x")] * 3
    plain = {u: merged(u, p) for u in units}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = lattice(rows_of(spark, units), p, at_once=7)
        assert "ObjectHashAggregate" not in found._jdf.queryExecution().toString()
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r.unit for r in got) == sorted(units)
    assert all(r.ids == plain[r.unit] for r in got)


def test_counts_of_units_that_a_task_passes_on_early(spark):
    cut = Pieces.load(PATH).cut()
    some = [t * 20 for t in texts()]
    want = Counter(cut.units(pa.array(some))[0].to_pylist())
    df = spark.createDataFrame([(t,) for t in some], "text string").repartition(3)
    for counted in (1, 20, 100_000):
        assert {r.unit: r.n for r in sp.count_units(df, cut, counted).collect()} == want


def test_cutting_takes_little_memory():
    """1 MB of text at once took 35 MB in NumPy alone."""
    cut = Pieces.load(PATH).cut()
    some = pa.array(["word and more, " * 200] * 1000)
    assert sum(len(cut.units(x)[1]) - 1 for x in sp.slices(some)) == 1000  # fills what cut keeps
    tracemalloc.start()
    try:
        for x in sp.slices(some):
            cut.units(x)
        assert tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()


def test_pieces_need_no_python_workers(spark):
    p = Pieces.load(PATH)
    table = sp.piece_table(spark.range(1), p)
    assert "PythonRDD" not in table._jdf.queryExecution().toRdd().toDebugString()
    assert table.dtypes == [("piece", "string"), ("x", "int")]
    assert {r.piece: r.x for r in table.collect()} == {s: k for s, k in p.rank.items() if s in p.spines}
    p.rank, p.spines = {}, {}
    assert sp.piece_table(spark.range(1), p).collect() == []


def test_workers_do_not_keep_the_table_of_units(spark):
    """Tables of units that were made of a broadcast went on with the worker, which outlives its task."""

    def kept(batches):
        import gc

        from wayfold.llm.sp_lattice import UnitIds

        gc.collect()
        n = sum(isinstance(x, UnitIds) for x in gc.get_objects())
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32())], names=["n"])

    df = spark.createDataFrame([(t,) for t in texts()], "text string").repartition(4)
    assert encode(df, PATH)[0].select("piece_ids").collect()
    assert {r.n for r in spark.range(0, 8, 1, 8).mapInArrow(kept, "n int").collect()} == {0}
