"""Language identification by nearest clustered centroids of TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import free_name, with_struct
from .sums import summed

#: n-grams of 1 to 3 letters are hashed in so many bins.
BINS = 1 << 14
#: Labelled documents of each language, at most, that its centroids are fitted on.
FIT_DOCS = 1000
#: How many times FIT_DOCS documents of a language are fetched on the average, lest hashes that bunch leave too few.
SPARE = 1.3
#: Centroids of each language.
CLUSTERS = 4
#: Languages at most: all their centroids are broadcast, BINS x 4 bytes each.
MAX_LANGUAGES = 400
#: A text is rejected if its cosine is below this share of the least one among the documents fitted on.
REJECT_SHARE = 0.5
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def bins_of(text: str | None) -> np.ndarray:
    """How often each bin's n-grams of 1, 2 and 3 letters occur in the text in small letters, with runs of other characters as one space."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(BINS, dtype=np.int64)
    c = np.where(letter, c, np.uint32(32))
    c = np.concatenate([[np.uint32(32)], c[letter | np.concatenate([[True], letter[:-1]])], [np.uint32(32)]]).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + one[2:]
    shift = np.uint32(32 - 14)
    return np.bincount(np.concatenate([one[c != 32] >> shift, two >> shift, three >> shift]), minlength=BINS)


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins that occur and their weights (1 + ln tf) idf, of length 1."""
    at = np.flatnonzero(counts)
    w = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((w * w).sum())
    return at, (w / norm if norm else w).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray  # BINS x (languages x clusters)
    of: np.ndarray  # the language of each centroid
    least: float  # texts of a lesser cosine are rejected

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, cosine, distance, rejected); UNKNOWN if there is no letter or nothing was learned. Ties go to the language first in order."""
        counts = bins_of(text)
        if not self.languages or not counts.any():
            return UNKNOWN, 0.0, 1.0, True
        at, w = vector(counts, self.idf)
        cosine = w @ self.centroids[at]
        best = int(np.argmax(cosine))
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.languages[self.of[best]], score, 1 - score, score < self.least


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit centroids of unit rows, by spherical k-means that starts from rows far from one another."""
    first = x.mean(axis=0)
    picked = [int(np.argmax(x @ first))]
    while len(picked) < min(k, len(x)):
        far = (x @ x[picked].T).max(axis=1)
        if far.min() > 0.999:
            break
        picked.append(int(np.argmin(far)))
    c = x[picked]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows of docs where learn holds and text and language are not null.

    Document frequencies count all those rows. Centroids are fitted, one task a language, on up to
    FIT_DOCS whole documents of each, those of least hash of their id; of rows that repeat an id and a
    language, one counts there, that of the least text. A hash bar passes SPARE times as many on the
    average.
    """
    spark = docs.sparkSession
    rows = docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            total = np.zeros(BINS + 1, dtype=np.int64)
            for t in b.column("text"):
                total[:BINS] += bins_of(t.as_py()) > 0
                total[BINS] += 1
            yield total

    df = summed(rows.select("text"), frequencies)
    if not len(df):
        return Model(np.zeros(BINS), [], np.zeros((BINS, 0), dtype=np.float32), np.zeros(0, dtype=int), 0.0)
    idf = (np.log((1 + df[BINS]) / (1 + df[:BINS])) + 1).astype(np.float32)

    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sizes.count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages; MAX_LANGUAGES is {MAX_LANGUAGES}")
    # by a bar for the hash, not by rank: no task gathers a language to rank it
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    chosen = rows.join(F.broadcast(sizes), "lang").where(place <= F.lit(SPARE * FIT_DOCS) / F.col("n")).groupBy("lang", "id").agg(F.min("text").alias("text"), F.first(place).alias("place"))

    def own(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "id"]).head(FIT_DOCS)
        x = np.zeros((len(pdf), BINS), dtype=np.float32)
        for i, t in enumerate(pdf.text):
            at, w = vector(bins_of(t), idf)
            x[i, at] = w
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        c = cluster(x, CLUSTERS)
        near = float((x @ c.T).max(axis=1).min())
        return pd.DataFrame({"lang": key[0], "centroid": [v.astype("<f4").tobytes() for v in c], "least": near})

    found = sorted(chosen.groupBy("lang").applyInPandas(own, "lang string, centroid binary, least double").collect(), key=lambda r: (r.lang, bytes(r.centroid)))
    names = sorted({r.lang for r in found})
    centroids = np.stack([np.frombuffer(bytes(r.centroid), dtype="<f4") for r in found], axis=1) if found else np.zeros((BINS, 0), dtype=np.float32)
    return Model(idf, names, np.ascontiguousarray(centroids), np.array([names.index(r.lang) for r in found], dtype=int), REJECT_SHARE * min((r.least for r in found), default=0.0))


def identify(docs: DataFrame, model: Model, text_col: str = "text", name: str = "language") -> tuple[DataFrame, str]:
    """(docs plus a struct (lang_pred, score, distance, rejected), that column's name, with underscores if docs has it).

    Every whole text is compared with all centroids. Null texts and those without a letter are
    UNKNOWN with score 0, and rejected; so is all if nothing was learned.
    """
    name = free_name(docs, name)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [sent.value.classify(t) for t in texts]

    return with_struct(docs, text_col, name, "lang_pred string, score double, distance double, rejected boolean", make), name


def held_out(id_col: str = "doc_id", mod: int = 5, left: int = 0) -> Column:
    """Whether crc32 of the id as text leaves `left`; so does a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == left, F.lit(True))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is not rejected, with the columns of docs; learned from all rows that have a language."""
    found, c = identify(docs, fit(docs, F.lit(True)))
    return found.where(~F.col(c).rejected).select(*(F.col(f"`{x}`") for x in docs.columns))
