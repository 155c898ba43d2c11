import random
import re

from wayfold.llm.secrets import findings, redact, scan, update_ledger


def brute(t):
    out = []
    for k, (kind, p, f, g, n) in enumerate([
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
        ("hex", r"[0-9a-f]+", 0, 0, 24),
    ]):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(p, t, f) if len(m[g]) >= n]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_base_rules():
    r = random.Random(1)
    bits = ["secret", "TOKEN", "password", "api_key", "ApiKey", ":", "=", " ", '"', "AKIA", "ABCDEFGHIJ0123456789", "deadbeef" * 4, "é", "ſecret", "x", "\n", "abc", "toKen"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert [s for s in scan(t) if s[0] in ("assign", "access", "hex")] == brute(t), t


def test_findings_and_redaction(spark):
    key = "AKIA" + "Z" * 16
    rows = [(1, f"é {key} and {key}"), (2, f"é {key} and {key}"), (3, None), (4, ""), (5, "plain " * 20000), (None, "token=abcdef"), (6, "token=" + "ab12" * 8), (6, "token=" + "ab12" * 8), (7, "-----BEGIN RSA PRIVATE KEY----- x")]
    df = spark.createDataFrame([(a, b, "p", b"s") for a, b in rows], "doc_id long, text string, path string, sha binary")
    got = sorted(((r.path, [(s.kind, s.start, s.end) for s in r.spans]) for r in findings(df).collect()), key=str)
    assert got == sorted(((a, scan(b or "")) for a, b in rows), key=str)
    clean = {r.text for r in redact(df).collect()}
    assert clean == {"é [REDACTED] and [REDACTED]", None, "", "plain " * 20000, "[REDACTED]", "[REDACTED] x"}
    assert findings(df.limit(0)).count() == 0


def test_ledger_grows_by_unseen_blobs_only(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "token=abcdef")], "doc_id long, text string")
    assert update_ledger(df, ledger)[1].count() == 2
    more = df.union(spark.createDataFrame([(4, "b"), (5, "a")], df.schema))
    assert update_ledger(more, ledger)[1].count() == 3
    assert sum(bool(r.spans) for r in findings(more, ledger).collect()) == 1
