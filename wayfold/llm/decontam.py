"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import free_name, with_struct
from .store import materialise

#: Bytes of benchmark text that are broadcast at once; a larger benchmark is searched in so many slices.
SLICE_BYTES = 2_000_000
_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
#: Bytes that are part of words stay, A-Z become small, others become spaces.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [0-9a-z and all beyond ASCII] of a text whose A-Z are made small; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class WuManber:
    """Finds all windows of some items in sequences of words. Windows of one length share tables."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = 10) -> None:
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)]
            if w:
                n = min(window, len(w))
                windows = by_length.setdefault(n, {})
                for i in range(len(w) - n + 1):
                    windows.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [item])
        self.size = len(self.ids) + 1
        self.tables = [self._tables(n, windows) for n, windows in sorted(by_length.items())]

    def _tables(self, n: int, windows: dict[tuple[int, ...], set]) -> tuple:
        """For windows of n words: n, words in a block, the shift of an unknown block, shifts, and windows by suffix and prefix block."""
        block = min(2, n)
        far = n - block + 1
        shift: dict[int, int] = {}
        bucket: dict[int, dict[int, list]] = {}
        for w, items in windows.items():
            for end in range(block, n + 1):
                k = self._key(w, end, block)
                shift[k] = min(shift.get(k, far), n - end)
            bucket.setdefault(self._key(w, n, block), {}).setdefault(self._key(w, block, block), []).append((w, items))
        return n, block, far, shift, bucket

    def _key(self, w: tuple[int, ...] | list[int], end: int, block: int) -> int:
        return w[end - 1] if block == 1 else w[end - 2] * self.size + w[end - 1]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of words inside occurrences, and the items that occur."""
        get, size = self.ids.get, self.size
        w = [get(x, 0) for x in words]
        spans: list[tuple[int, int]] = []
        found: set = set()
        for n, block, far, shift, bucket in self.tables:
            end, last = n, len(w)
            ask = shift.get
            while end <= last:
                k = w[end - 1] if block == 1 else w[end - 2] * size + w[end - 1]
                step = ask(k, far)
                if step:
                    end += step
                    continue
                start = end - n
                tests = bucket[k].get(self._key(w, start + block, block))
                if tests:
                    here = tuple(w[start:end])
                    for test, items in tests:
                        if test == here:
                            spans.append((start, end))
                            found |= items
                end += 1
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FIELDS = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, spans array<array<int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", name: str = "contamination", slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, str]:
    """(docs plus a struct column of FIELDS, that column's name: `name`, or that with underscores if docs has it).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one
    window. spans are the hit words, start to end, merged; items the occurring item_ids, sorted as
    strings. Null and empty texts have no words. An item with a null id marks words but counts as no
    item; repeated items count once. An empty benchmark hits nothing. A benchmark over slice_bytes
    is searched slice by slice: each slice is broadcast, and the spans and items that it finds are
    added to those before, so no more than one slice is ever in a task's memory.
    """
    spark = docs.sparkSession
    name = free_name(docs, name)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    now = docs
    for k in range(slices):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k) if slices > 1 else items
        sent = spark.sparkContext.broadcast([(r.item_id, r.text) for r in mine.collect()])
        step = free_name(now, "found")

        def make(sent=sent):
            table = WuManber(sent.value, window)

            def work(texts: list) -> list:
                out = []
                for t in texts:
                    w = words_of(t)
                    spans, found = table.search(w)
                    ids = sorted(found)
                    out.append((len(w), sum(b - a for a, b in spans), len(ids), ids, hashlib.sha256(",".join(ids).encode()).hexdigest(), [list(s) for s in spans]))
                return out

            return work

        now = with_struct(now, text_col, step, FIELDS, make)
        now = now.withColumnRenamed(step, name) if not k else _both(now, name, step)
        if k < slices - 1:
            now = materialise(now, "decontam")
    return now, name


def _both(df: DataFrame, a: str, b: str) -> DataFrame:
    """The findings of two slices as one."""
    x, y = F.col(a), F.col(b)
    spans = F.aggregate(
        F.array_sort(F.concat(x.spans, y.spans)),
        F.lit([]).cast("array<array<int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.get(F.get(acc, F.size(acc) - 1), F.lit(1)) >= s[0]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.array(F.get(F.get(acc, F.size(acc) - 1), F.lit(0)), F.greatest(F.get(F.get(acc, F.size(acc) - 1), F.lit(1)), s[1])))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    items = F.array_sort(F.array_union(x.items, y.items))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]))
    return df.withColumn(a, F.struct(x.n_words.alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), spans.alias("spans"))).drop(b)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with the columns that docs has."""
    found, name = contamination(docs, benchmark, window, text_col)
    return found.where(F.col(name).n_hit == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


#: DuckDB SQL for op7, by joining all windows of both tables.
SQL = r"""
WITH words AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w, doc_id FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, w[s : s + n - 1] AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, n, w[s : s + n - 1] AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, k)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""
