import random

from pyspark.sql import functions as F

from wayfold.llm.langid import fit, held_out, identify, keep_known

WORDS = {"xx": ["tha", "ing", "wher", "ond"], "yy": ["lich", "schn", "ung", "über"], "zz": ["ción", "mente", "ñora", "que"]}


def corpus():
    r = random.Random(2)
    rows = []
    for i in range(300):
        lang = r.choice(sorted(WORDS))
        text = " ".join("".join(r.choice(WORDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 80)))
        rows.append((i, text, lang if i % 9 else None, "s", lang))
    return rows + [(300, None, "xx", "s", "und"), (301, "", "yy", "s", "und"), (302, "123 -- !!", "zz", "s", "und"), (None, "tha tha ing", None, "s", "xx"), (304, "über " * 30000, "yy", "s", "yy"), (304, "über " * 30000, "yy", "s", "yy")]


SCHEMA = "doc_id long, text string, lang string, language string, truth string"


def test_held_out_accuracy_and_edges(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    found, c = identify(df, fit(df, ~held_out()))
    rows = found.select("doc_id", "truth", held_out().alias("h"), f"{c}.*").collect()
    assert len(rows) == len(corpus()) and all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (r.truth == "und") for r in rows)
    known = [r for r in rows if r.truth != "und"]
    assert sum(r.lang_pred == r.truth for r in known) >= 0.97 * len(known)
    assert any(r.h for r in known) and all(r.h for r in rows if r.doc_id is None)


def test_rejection_keeps_known_texts(spark):
    df = spark.createDataFrame([*corpus(), (400, "漢字仮名交", None, "s", "q")], SCHEMA)
    kept = keep_known(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {300, 301, 302, 400} and set(range(300)) <= ids


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None, "s", "q")], SCHEMA)
    for d in (df, df.limit(0)):
        found, c = identify(d, fit(d, F.lit(True)))
        assert all(tuple(r) == ("und", 0.0, 1.0, True) for r in found.select(f"{c}.*").collect())
