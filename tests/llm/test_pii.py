import datetime
import re

from pyspark.sql import functions as F

from wayfold.llm.pii import feistel, pseudonymise


def luhn(d):
    d = [int(c) for c in d if c.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def iban_ok(v):
    m = v[4:] + v[:4]
    return int("".join(str(int(c, 36)) for c in m)) % 97 == 1


ROWS = [
    (1, "card 4111 1111 1111 1111, again 4111111111111111 and bad 4111111111111112."),
    (2, "born 1984-02-29 not 1983-02-29; host 192.168.0.1 not 300.1.1.1; é"),
    (3, "ssn 219-09-9999 not 666-09-9999, call +1 (017) 555-7713 or +1 017.555.7713"),
    (4, "pay GB82WEST12345698765432 not GB83WEST12345698765432; mail a.b@x.org, a.b@x.org"),
    (5, None), (6, ""), (7, "no numbers"), (8, "x1 " * 30000), (8, "x1 " * 30000), (9, "1" * 50000), (10, "ends 219-09-9999"), (None, "192.168.0.1"),
]


def test_valid_linked_and_whole(spark):
    df = spark.createDataFrame([(a, b, "p") for a, b in ROWS], "doc_id long, text string, pii_text string")
    out = pseudonymise(df, "k")
    got = {r.doc_id: r for r in out.select("doc_id", "text", F.col("_pii_found").alias("found"), F.col("_pii_text").alias("new")).collect()}
    one = got[1].found
    assert [m.kind for m in one] == ["card", "card"] and all(luhn(m.pseudonym) for m in one)
    assert re.fullmatch(r"(\d{4} ){3}\d{4}", one[0].pseudonym) and one[0].pseudonym.replace(" ", "") == one[1].pseudonym != "4111111111111111"
    assert got[1].new == f"card {one[0].pseudonym}, again {one[1].pseudonym} and bad 4111111111111112."
    two = {m.kind: m.pseudonym for m in got[2].found}
    assert set(two) == {"date", "ip"} and datetime.date.fromisoformat(two["date"]) and all(0 <= int(o) < 256 for o in two["ip"].split("."))
    assert "1983-02-29" in got[2].new and "300.1.1.1" in got[2].new and got[2].new.endswith("; é")
    three = [(m.kind, m.pseudonym) for m in got[3].found]
    assert [k for k, _ in three] == ["ssn", "phone", "phone"] and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", three[1][1])
    assert re.sub(r"\D", "", three[1][1]) == re.sub(r"\D", "", three[2][1])
    four = [(m.kind, m.pseudonym) for m in got[4].found]
    assert [k for k, _ in four] == ["iban", "email", "email"] and iban_ok(four[0][1]) and len(four[0][1]) == 22 and four[1] == four[2]
    assert got[5].new is None and got[5].found == [] and got[6].new == "" and got[7].new == "no numbers" and got[8].new == got[8].text and got[9].new == got[9].text
    assert got[10].found[0].pseudonym == three[0][1] and got[10].new == "ends " + three[0][1]
    assert got[None].new == two["ip"]
    assert out.count() == len(ROWS) and pseudonymise(df.limit(0), "k").count() == 0


def test_permutation(spark):
    a, b, k = F.lit(7).cast("long"), F.lit(11).cast("long"), F.lit("key")
    out = spark.range(77).select("id", feistel(F.col("id"), a, b, k, F.lit("t")).alias("x")).select("id", "x", feistel(F.col("x"), a, b, k, F.lit("t"), back=True).alias("y")).collect()
    assert sorted(r.x for r in out) == list(range(77)) and all(r.id == r.y for r in out)


def test_all_digits_of_long_ibans_change(spark):
    def valid(country, bban):
        return next(v for c in range(2, 99) if iban_ok(v := f"{country}{c:02d}{bban}"))

    for country, bban in (("PL", "109010140000071219812874"), ("FR", "20041010050500013026068"), ("ES", "21000418450200051332"), ("HU", "117730161111101800000000")):
        values = [valid(country, bban[:-2] + f"{k:02d}") for k in range(100)]
        df = spark.createDataFrame([(i, f"pay {v} now") for i, v in enumerate(values)], "doc_id long, text string")
        new = [r.pii_found[0].pseudonym for r in pseudonymise(df, "k").collect()]
        assert all(iban_ok(v) and len(v) == len(values[0]) for v in new) and len(set(new)) == 100
        # the tail after the 18th digit is a real one only by chance
        assert sum(a[22:] == b[22:] for a, b in zip(values, new, strict=True)) < 40


def test_card_beside_other_numbers(spark):
    rows = ["4111111111111111 12/27", "4111 1111 1111 1111 123", "paid 20 4111111111111111", "20 4111-1111-1111-1111; 4111111111111112 12"]
    out = pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"]
    for row, card, got in zip(rows, cards, out, strict=True):
        assert [(m.kind, m.value) for m in got.pii_found] == [("card", card)]
        assert luhn(got.pii_found[0].pseudonym) and got.pii_text == row.replace(card, got.pii_found[0].pseudonym) != row
