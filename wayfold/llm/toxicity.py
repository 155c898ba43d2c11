"""Toxicity by votes of the nearest labelled examples, found by exact TF-IDF cosine in a block-max inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import words_of
from .rows import free_name, with_struct

#: Labelled rows at most that become examples of the index, those of least hash of their id.
EXAMPLES = 20_000
#: Terms at most of the index; they must be this many times as frequent among toxic rows, and so significant.
TERMS, LIFT, CHI2, LEAST_DF = 50_000, 2.0, 20.0, 4
NEIGHBOURS, BLOCK = 15, 64
#: Different vectors whose scores a task remembers.
REMEMBERED = 20_000
#: Label rows up to this number are broadcast to fetch their texts; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


@dataclass
class BlockMaxIndex:
    """Exact top-k by inner product over examples in blocks; whole blocks are skipped by the greatest weight a term has in them."""

    vectors: list[dict[int, float]]
    postings: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    maxima: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        lists: dict[int, list] = {}
        for i, v in enumerate(self.vectors):
            for t, w in v.items():
                lists.setdefault(t, []).append((i, w))
        for t, pairs in lists.items():
            at = np.array([i for i, _ in pairs])
            w = np.array([x for _, x in pairs])
            blocks, start = np.unique(at // BLOCK, return_index=True)
            self.postings[t] = (at, w)
            self.maxima[t] = (blocks, np.maximum.reduceat(w, start), np.append(start, len(at)))

    def nearest(self, q: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with cosine over 0, nearest first, ties by example; `without` is left out."""
        bound = np.zeros(len(self.vectors) // BLOCK + 1)
        terms = sorted(t for t in q if t in self.postings)
        for t in terms:
            blocks, top, _ = self.maxima[t]
            bound[blocks] += q[t] * top
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int]] = []
        for blk in order.tolist():
            if bound[blk] <= 0 or len(best) == k and bound[blk] < -best[-1][0] - 1e-9:
                break
            if len(best) == k and bound[blk] <= -best[-1][0] + 1e-9 and blk * BLOCK > best[-1][1]:
                continue  # it can at most tie, and later examples lose ties
            score = np.zeros(BLOCK)
            for t in terms:
                blocks, _, start = self.maxima[t]
                j = int(np.searchsorted(blocks, blk))
                if j < len(blocks) and blocks[j] == blk:
                    at, w = self.postings[t]
                    own = slice(start[j], start[j + 1])
                    score[at[own] - blk * BLOCK] += q[t] * w[own]
            hits = np.flatnonzero(score > 0)
            best += [(-float(score[i]), blk * BLOCK + i) for i in hits.tolist() if blk * BLOCK + i != without]
            best = sorted(best)[:k]
        return [(-s, i) for s, i in best]


@dataclass
class Model:
    terms: dict[bytes, int]
    idf: np.ndarray
    index: BlockMaxIndex
    examples: list[tuple]  # (id, label) in the index's order
    none: float  # the share of toxic among examples without any term
    knots: tuple[np.ndarray, np.ndarray]  # votes, and how often the label is 1 at such votes
    met: dict = field(default_factory=dict)  # a task's vectors and their scores

    def vector(self, text: str | None) -> dict[int, float]:
        """TF-IDF weights of the text's terms, of length 1."""
        get = self.terms.get
        tf = Counter(n for n in map(get, words_of(text)) if n is not None)
        w = {t: (1 + np.log(c)) * self.idf[t] for t, c in tf.items()}
        norm = np.sqrt(sum(x * x for x in w.values()))
        return {t: float(x / norm) for t, x in w.items()}

    def score(self, text: str | None) -> tuple[float, list]:
        """The calibrated score, and the neighbours (id, label, cosine) as its evidence."""
        q = self.vector(text)
        if not q:
            return self.none, []
        key = tuple(sorted(q.items()))
        if key not in self.met:
            if len(self.met) >= REMEMBERED:
                self.met.clear()
            self.met[key] = self._judge(q)
        return self.met[key]

    def _judge(self, q: dict[int, float]) -> tuple[float, list]:
        near = self.index.nearest(q, NEIGHBOURS)
        if not near:
            return self.none, []
        raw = vote(near, self.examples, self.none)
        return float(np.interp(raw, *self.knots)) if len(self.knots[0]) else raw, [(self.examples[i][0], self.examples[i][1], s) for s, i in near]


def vote(near: list[tuple[float, int]], examples: list[tuple], prior: float) -> float:
    """The share of label 1, each neighbour weighing its cosine squared, with the prior as half a neighbour."""
    weight = sum(s * s for s, _ in near)
    return (sum(s * s * examples[i][1] for s, i in near) + 0.5 * prior) / (weight + 0.5)


def calibrate(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of label on raw, as the mean raw and label of each pooled step."""
    steps: list[list[float]] = []
    for x, y in sorted(zip(raw.tolist(), label.tolist(), strict=True)):
        steps.append([x, y, 1])
        while len(steps) > 1 and steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]:
            a = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], a, strict=True)]
    return np.array([s[0] / s[2] for s in steps]), np.array([s[1] / s[2] for s in steps])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the texts of docs that labels marks 0 or 1 where learn (of labels' id) holds.

    How often each word occurs in rows of either label counts all of them; the index takes the
    words that tell, and up to EXAMPLES rows. Rows without such words are told by their share alone.
    """
    spark = docs.sparkSession
    marks = labels.where(learn).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(marks, "id")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[0][w] for w in words], pa.int64()), pa.array([seen[1][w] for w in words], pa.int64())], names=["word", "n0", "n1"])
            seen[0].clear()
            seen[1].clear()
            return batch

        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                seen[y].update({*words_of(t), b""})
            if len(seen[0]) > 300_000:
                yield out()
        yield out()

    table = rows.select("text", "y").mapInArrow(count, "word binary, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = next(((r.n0, r.n1) for r in table.where(F.octet_length("word") == 0).collect()), (0, 0))
    none = (n1 + 1) / (n0 + n1 + 2)
    empty = Model({}, np.zeros(0), BlockMaxIndex([]), [], none, (np.zeros(0), np.zeros(0)))
    if not n0 or not n1:
        return empty
    a, b = F.col("n1"), F.col("n0")
    c, d = n1 - a, n0 - b
    n = float(n0 + n1)
    chi2 = n * F.pow((a * d - b * c).cast("double"), 2) / (F.lit(float(n0 * n1)) * (a + b) * (c + d + F.lit(1e-9)))
    told = table.where((F.octet_length("word") > 0) & (a + b >= LEAST_DF) & (a * float(n0) >= LIFT * b * float(n1))).withColumn("chi2", chi2).where(F.col("chi2") >= CHI2)
    picked = sorted((bytes(r.word), r.n0 + r.n1) for r in told.orderBy(F.desc("chi2"), "word").limit(TERMS).collect())
    terms = {w: i for i, (w, _) in enumerate(picked)}
    idf = np.array([np.log((1 + n) / (1 + df)) + 1 for _, df in picked])
    model = Model(terms, idf, BlockMaxIndex([]), [], none, (np.zeros(0), np.zeros(0)))

    sent = spark.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [sent.value.vector(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([list(x) for x in v], pa.list_(pa.int32())), pa.array([list(x.values()) for x in v], pa.list_(pa.float64()))], names=["id", "y", "terms", "weights"])

    chosen = labels.where(learn).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(EXAMPLES)
    found = rows.join(F.broadcast(chosen), "id", "left_semi").mapInArrow(sparse, f"id {kind}, y int, terms array<int>, weights array<double>").collect()
    found.sort(key=lambda r: (sorted(r.terms), r.id, r.y))
    bare = [r.y for r in found if not r.terms]
    model.none = (sum(bare) + n1 / n) / (len(bare) + 1)
    found = [r for r in found if r.terms]
    model.examples = [(r.id, r.y) for r in found]
    model.index = BlockMaxIndex([dict(zip(r.terms, r.weights, strict=True)) for r in found])
    raw, label = [], []
    for i, v in enumerate(model.index.vectors):
        near = model.index.nearest(v, NEIGHBOURS, without=i)
        if near:
            raw.append(vote(near, model.examples, model.none))
            label.append(model.examples[i][1])
    model.knots = calibrate(np.array(raw), np.array(label))
    return model


def assess(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> tuple[DataFrame, str]:
    """(docs plus a struct (score, evidence), that column's name, with underscores if docs has it).

    score, 0 to 1, is how often label 1 is right at such votes; a null, empty or term-free text has
    the share of label 1 among such rows, and no evidence. evidence lists the nearest examples with
    their label and cosine, nearest first, ties in the index's order.
    """
    name = free_name(docs, name)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts: list) -> list:
            out = []
            for t in texts:
                s, near = sent.value.score(t)
                out.append((min(1.0, max(0.0, s)), [{"example": str(i), "label": y, "cosine": c} for i, y, c in near]))
            return out

        return work

    return with_struct(docs, text_col, name, "score double, evidence array<struct<example:string,label:int,cosine:double>>", make), name
