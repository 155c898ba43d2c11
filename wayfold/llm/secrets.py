"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise, new_path

#: Kind, pattern, group to measure, least length, and what a text must hold (in small letters where the pattern takes both).
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    ("hex", r"[0-9a-f]+", 0, 24, ()),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("PRIVATE KEY",)),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, ("eyJ",)),
    ("slack", r"xox[baprs]-[A-Za-z0-9-]+", 0, 20, ("xox",)),
)
BASE = 3
VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
_HEX = bytes(104 if b in b"0123456789abcdef" else 32 for b in range(256))
_COMPILED = [(k, re.compile(p, re.ASCII | (re.IGNORECASE if k == "assign" else 0)), g, n, need) for k, p, g, n, need in RULES]
#: As whole runs are taken, a run of 24 or more starts where `[0-9a-f]+` starts.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Blobs with findings up to this number are broadcast to redact; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed; leftmost non-overlapping matches of each kind, less those too short."""
    out = []
    small = None
    for order, (kind, rx, group, least, need) in enumerate(_COMPILED):
        if kind == "hex":
            if b"h" * 24 not in text.encode("utf-8", "surrogatepass").translate(_HEX):
                continue
            rx = _LONG_HEX
        elif kind == "assign":
            small = text.lower()
            if not any(x in small for x in need):
                continue
        elif not any(x in text for x in need):
            continue
        out += [(m.start(), order, kind, m.end()) for m in rx.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def _blobs(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))


def _has_files(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


LEDGER = f"sha binary, version string, spans {SPANS}"


def update_ledger(docs: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scans the blobs of docs that the ledger has not under this rule version; gives (path, sha) of every row, and the ledger.

    ledger is a folder of Parquet files of (sha, version, spans): a row for each blob and rule version
    ever scanned, to which this appends. Texts move once, to the row with the least path of each
    unseen blob; copies of a hot blob differ in path and so fall in many tasks. Nulls are scanned as
    empty texts; a blob whose path is null or repeated is scanned once for each such row and entered once.
    """
    spark = docs.sparkSession
    blobs = _blobs(docs, path_col, text_col)
    paths = materialise(blobs.select("path", "sha"), "paths")
    unseen = paths.groupBy("sha").agg(F.min("path").alias("path"))
    if _has_files(spark, ledger):
        known = spark.read.schema(LEDGER).parquet(ledger).where(F.col("version") == VERSION).select("sha")
        unseen = unseen.join(known, "sha", "left_anti")
    first = unseen.select(F.col("sha").alias("s"), F.col("path").alias("p"))
    todo = blobs.join(first.hint("shuffle_hash"), (F.col("sha") == F.col("s")) & F.col("path").eqNullSafe(F.col("p")), "left_semi").select("sha", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("sha"), pa.array([VERSION] * b.num_rows), pa.array(found, type=_SPANS)], names=["sha", "version", "spans"])

    todo.mapInArrow(run, LEDGER).dropDuplicates(["sha"]).write.mode("append").parquet(ledger)
    return paths, spark.read.schema(LEDGER).parquet(ledger).where(F.col("version") == VERSION)


def findings(docs: DataFrame, ledger: str | None = None, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, sha, spans) for each row of docs: what the ledger has of its blob; an empty list if nothing.

    A ledger that is not named begins empty in the shared folder. Repeated rows stay; no rows give none.
    """
    paths, known = update_ledger(docs, ledger or new_path(docs.sparkSession, "ledger"), path_col, text_col)
    secret = known.where(F.size("spans") > 0).select("sha", "spans")
    return paths.join(secret, "sha", "left").select("path", "sha", F.coalesce("spans", F.lit([]).cast(SPANS)).alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None, path_col: str = "doc_id", text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with each span of its secrets replaced by mark, by joining the findings back by content; other columns stay as they are."""
    _, known = update_ledger(docs, ledger or new_path(docs.sparkSession, "ledger"), path_col, text_col)
    secret = materialise(known.where(F.size("spans") > 0).select(F.col("sha").alias("_sha"), F.col("spans").alias("_spans")), "secrets")
    if secret.count() <= BROADCAST_ROWS:
        secret = F.broadcast(secret)
    text = F.col(text_col).cast("string")
    step = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s.end <= acc.at, acc).otherwise(
            F.struct(s.end.alias("at"), F.concat(acc.out, F.when(s.start > acc.at, text.substr(acc.at + 1, s.start - acc.at)).otherwise(F.lit("")), F.when(s.start >= acc.at, F.lit(mark)).otherwise(F.lit(""))).alias("out"))
        ),
    )
    clean = F.when(F.col("_spans").isNull(), text).otherwise(F.concat(step.out, text.substr(step.at + 1, F.length(text))))
    joined = docs.join(secret, F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)) == F.col("_sha"), "left")
    return joined.withColumn(text_col, clean).select(*(F.col(f"`{c}`") for c in docs.columns))
