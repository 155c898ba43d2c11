"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: What each kind looks like, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "date": r"(?<![0-9.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Dates are permuted within 400 Gregorian years, whose days are this product.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def mix(key: Column, tweak: Column, r: Column, value: Column) -> Column:
    """A number of 60 bits from the key, the format, the round and a half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, tweak, r.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, a: Column, b: Column, key: Column, tweak: Column, back: bool = False) -> Column:
    """A keyed permutation of the numbers under a * b (below 2^62): halves are added to in turn, modulo their own size."""
    start = F.struct(F.call_function("div", x, b).alias("l"), F.pmod(x, b).alias("r"))
    sign = -1 if back else 1

    def step(s: Column, r: Column) -> Column:
        left = r % 2 == 0
        return F.struct(
            F.when(left, F.pmod(s.l + sign * (mix(key, tweak, r, s.r) % a), a)).otherwise(s.l).alias("l"),
            F.when(left, s.r).otherwise(F.pmod(s.r + sign * (mix(key, tweak, r, s.l) % b), b)).alias("r"),
        )

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: s.l * b + s.r)


def permute_digits(digits: Column, key: Column, tweak: Column, back: bool = False) -> Column:
    """Digits to as many digits (1 to 18 of them)."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    out = feistel(digits.cast("long"), power(half), power(n - half), key, F.concat_ws(":", tweak, n.cast("string")), back)
    return F.lpad(out.cast("string"), n, "0")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, in which the last digit counts once, the one before it twice, and so on."""
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + F.when((n - i) % 2 == 0, digits.substr(i, F.lit(1)).cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), digits.substr(i, F.lit(1)).cast("int"))),
    )


def put_digits(value: Column, digits: Column) -> Column:
    """value with its digits, one after another, replaced by those of digits; all else stays."""
    done = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct((s.at + 1).alias("at"), F.concat(s.out, digits.substr(s.at, F.lit(1))).alias("out"))).otherwise(F.struct(s.at.alias("at"), F.concat(s.out, c).alias("out"))),
    )
    return done.out


def kind_of(value: Column) -> Column:
    """The kind of a validated value; null if it only looks like one: a bad check digit, date, octet, area or length."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    octets = F.split(value, r"\.")
    valid = {
        "email": F.lit(True),
        "date": F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date").between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date")),
        "ip": F.forall(octets, lambda o: (F.length(o) == F.length(o.cast("int").cast("string"))) & (o.cast("int") <= 255)),
        "phone": n.between(8, 15),
        "ssn": ~digits.substr(1, 3).isin("000", "666") & (digits.substr(1, 1) != "9") & (digits.substr(4, 2) != "00") & (digits.substr(6, 4) != "0000"),
        "card": n.between(13, 19) & (luhn_sum(digits) % 10 == 0),
    }
    full = {k: F.coalesce(value.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(False)) for k in PATTERNS}
    return reduce(lambda rest, k: F.when(full[k], F.when(iban_rest(value) == 1, F.lit("iban")) if k == "iban" else F.when(F.coalesce(valid[k], F.lit(False)), F.lit(k))).otherwise(rest), reversed(list(PATTERNS)), F.lit(None).cast("string"))


def card_within(value: Column) -> Column:
    """(n, back, value), back its place less than zero, of the longest valid card made of whole digit groups of value, the first of equal ones; null if there is none."""
    groups = F.split(value, "[ -]")
    first = lambda i: F.length(F.array_join(F.slice(groups, 1, i), "-")) + F.when(i > 0, 2).otherwise(1)
    run = lambda i, j: F.slice(groups, i + 1, j - i + 1)

    def span(i: Column, j: Column) -> Column:
        return F.struct(F.length(F.array_join(run(i, j), "")).alias("n"), (-first(i)).alias("back"), value.substr(first(i), F.length(F.array_join(run(i, j), "-"))).alias("value"))

    last = F.size(groups) - 1
    spans = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: span(i, j))))
    sized = F.filter(spans, lambda c: c.n.between(13, 19))
    return F.array_max(F.filter(sized, lambda c: luhn_sum(F.regexp_replace(c.value, "[^0-9]", "")) % 10 == 0))


def iban_rest(value: Column) -> Column:
    """An IBAN's remainder by 97, its first four characters last and letters as 10 to 35."""
    moved = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
    return F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + F.ascii(c) - 48) % 97).when(c == "", s).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )


def pseudonym(value: Column, kind: Column, key: Column) -> Column:
    """A value of the same kind, length and separators that is valid too; equal digits give equal ones, whatever the separators.

    card: all digits but the last are permuted, and the last one makes the Luhn sum right. date: a
    day of 400 years. ip: its four octets. phone: all digits but the first. ssn: its valid combinations. iban: all digits after the country, those after the 18th tweaked by the new ones before, with new check
    digits. email: a name of hexadecimal digits at example.com, for letters have no check to keep.
    """
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    body = permute_digits(digits.substr(F.lit(1), n - 1), key, F.lit("card"))
    check = ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    day = F.datediff(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    new_day = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(day, *(F.lit(d).cast("long") for d in DAYS), key, F.lit("date")).cast("int"))
    octets = F.split(value, r"\.")
    number = reduce(lambda s, i: s * 256 + F.get(octets, i).cast("long"), range(1, 4), F.get(octets, 0).cast("long"))
    address = feistel(number, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, F.lit("ip"))
    new_ip = F.concat_ws(".", *(F.shiftright(address, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)))
    phone = F.concat(digits.substr(1, 1), permute_digits(digits.substr(F.lit(2), n), key, F.lit("phone")))
    # areas 001-899 but 666, groups 01-99, serials 0001-9999
    area = digits.substr(1, 3).cast("long")
    old_ssn = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + digits.substr(4, 2).cast("long") - 1) * 9999 + digits.substr(6, 4).cast("long") - 1
    new_ssn = feistel(old_ssn, F.lit(898 * 11).cast("long"), F.lit(9 * 9999).cast("long"), key, F.lit("ssn"))
    new_area = F.call_function("div", new_ssn, F.lit(99 * 9999).cast("long"))
    ssn = F.concat(F.lpad((new_area + F.when(new_area >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.call_function("div", new_ssn, F.lit(9999).cast("long")) % 99 + 1).cast("string"), 2, "0"), F.lpad((new_ssn % 9999 + 1).cast("string"), 4, "0"))
    tail = F.substring(value, 5, 40)
    tail_digits = F.regexp_replace(tail, "[^0-9]", "")
    few = F.least(F.length(tail_digits), F.lit(18))
    head = F.when(few > 0, permute_digits(tail_digits.substr(F.lit(1), few), key, F.lit("iban"))).otherwise(F.lit(""))
    rest = tail_digits.substr(few + 1, F.lit(40))
    new_tail = put_digits(tail, F.concat(head, F.when(F.length(rest) > 0, permute_digits(rest, key, F.concat_ws(":", F.lit("iban"), head))).otherwise(F.lit(""))))
    country = F.substring(value, 1, 2)
    iban = F.concat(country, F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), new_tail))).cast("string"), 2, "0"), new_tail)
    return (
        F.when(kind == "card", put_digits(value, F.concat(body, check)))
        .when(kind == "date", F.date_format(new_day, "yyyy-MM-dd"))
        .when(kind == "ip", new_ip)
        .when(kind == "phone", put_digits(value, phone))
        .when(kind == "ssn", put_digits(value, ssn))
        .when(kind == "iban", iban)
        .when(kind == "email", F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(value)), 256), 1, 12), F.lit("@example.com")))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", prefix: str = "pii") -> DataFrame:
    """docs plus the columns {prefix}_found array<(kind, value, pseudonym)> and {prefix}_text, or with underscores before them if docs has such columns.

    Every match of PATTERNS in the whole text is validated; those that pass are replaced in
    {prefix}_text, the others stay as they are and are not listed. Of digit groups that are no card
    together, those that are one by themselves are replaced. Null texts stay null and list
    nothing. The key is a secret of the caller: with another one pseudonyms no longer link.
    """
    names = {c.lower() for c in docs.columns}
    while f"{prefix}_found" in names or f"{prefix}_text" in names or f"{prefix}_all" in names:
        prefix = f"_{prefix}"
    text, secret = F.col(text_col).cast("string"), F.lit(key)
    # each pattern takes a digit or an @, so texts without them are not searched
    matches = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.lit([]).cast("array<string>"))
    looks_card = lambda m: m.rlike(f"^(?:{PATTERNS['card']})$") & m.rlike("[ -]")
    tried = F.transform(matches, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value")))
    inner = F.transform(tried, lambda m: F.struct(m.kind.alias("kind"), m.value.alias("value"), F.when(m.kind.isNull() & looks_card(m.value), card_within(m.value)).alias("card")))
    validated = F.transform(
        inner,
        lambda m: F.struct(
            F.when(m.card.isNotNull(), F.lit("card")).otherwise(m.kind).alias("kind"),
            F.coalesce(m.card.value, m.value).alias("value"),
            F.when(m.card.isNotNull(), m.value.substr(F.lit(1), -m.card.back - 1)).otherwise(F.lit("")).alias("before"),
            F.when(m.card.isNotNull(), m.value.substr(-m.card.back + F.length(m.card.value), F.length(m.value))).otherwise(F.lit("")).alias("after"),
        ),
    )
    every = F.transform(validated, lambda m: F.struct(m.kind.alias("kind"), m.value.alias("value"), F.coalesce(pseudonym(m.value, m.kind, secret), m.value).alias("pseudonym"), m.before.alias("before"), m.after.alias("after")))
    listed = docs.withColumn(f"{prefix}_all", every)
    pieces = F.split(text, ANY)
    rebuilt = F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size(f"{prefix}_all")), f"{prefix}_all", lambda p, m: F.concat(p, m.before, m.pseudonym, m.after)), ""), F.element_at(pieces, -1))
    return listed.withColumns({f"{prefix}_found": F.transform(F.filter(f"{prefix}_all", lambda m: m.kind.isNotNull()), lambda m: F.struct(m.kind.alias("kind"), m.value.alias("value"), m.pseudonym.alias("pseudonym"))), f"{prefix}_text": F.when(F.size(f"{prefix}_all") == 0, text).otherwise(rebuilt)}).drop(f"{prefix}_all")
