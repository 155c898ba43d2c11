"""SentencePiece encoding by a relational lattice of pieces, and decoding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import free_name
from .store import discard, materialise, small_batches
from .words import tidy

SPACE = "▁"
#: Bytes at most of the table of units that is broadcast, the most frequent ones; the ids of the others are joined to the texts that hold them.
BROADCAST_BYTES = 120_000_000
#: Bytes of a unit in that table besides those of its ids, and of each id.
UNIT_BYTES, ID_BYTES = 16, 4
#: Units whose counts a task holds before it passes the rarer ones on, and bytes of text that it cuts at once, each of which takes some 35 bytes of memory.
COUNTED, AT_ONCE = 100_000, 400_000
#: Units whose lattices one task makes, and places of a unit that are looked at through one window.
PART_UNITS, STARTS = 20_000, 32
#: Edges in an Arrow batch, and those that are folded at once, of whole units.
BATCH, EDGES = 20_000, 200_000
#: A number that no piece has.
NEVER = 1 << 24


@dataclass
class Cut:
    """How texts fall into units: between two characters that no piece holds one after the other."""

    prefix: bool
    chars: np.ndarray  # code points that pieces of two or more characters hold, ascending
    inner: np.ndarray  # whether a piece holds one such character after another

    @cached_property
    def number(self) -> np.ndarray:
        """By code point: 0, or 1 and the place in chars."""
        out = np.zeros(0x110000, dtype=np.uint16)
        out[self.chars] = np.arange(1, len(self.chars) + 1)
        return out

    @cached_property
    def joined(self) -> np.ndarray:
        out = np.zeros((len(self.chars) + 1,) * 2, dtype=bool)
        out[1:, 1:] = self.inner
        return out.ravel()

    def __getstate__(self) -> dict:
        return {"prefix": self.prefix, "chars": self.chars, "inner": self.inner}

    def units(self, texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The units of all texts one after another, and where each text's begin; null texts have none."""
        marked = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), " ", SPACE)
        if self.prefix:
            marked = pc.if_else(pc.equal(marked, ""), marked, pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), marked, pa.scalar("", pa.large_string())))
        offsets = np.frombuffer(marked.buffers()[1], dtype=np.int64)[marked.offset : marked.offset + len(marked) + 1] if len(marked) else np.zeros(1, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        if lo == hi:
            return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, dtype=np.int64)
        data = marked.buffers()[2].slice(lo, hi - lo)
        code = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), dtype=np.uint32)
        width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
        at = np.cumsum(width, dtype=np.int64) - width
        kind = self.number[code].astype(np.int32)
        first = np.ones(len(code), dtype=bool)
        first[1:] = ~self.joined[kind[:-1] * (len(self.chars) + 1) + kind[1:]]
        texts_at = np.searchsorted(at, offsets - lo)
        first[texts_at[:-1][np.diff(offsets) > 0]] = True
        begins = np.append(at[first], hi - lo)
        before = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
        return pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), data), before[texts_at]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in runs of AT_ONCE bytes, or of one longer text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // AT_ONCE
    ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(size)) if len(size) else []
    at = 0
    for e in ends:
        yield texts.slice(at, int(e) - at)
        at = int(e)


@dataclass
class Pieces:
    """What a SentencePiece model file says: pieces, their ids and scores, and how it treats white space."""

    ids: dict[str, int]
    rank: dict[str, int]  # a piece's number by falling score, ties by id
    score: dict[str, float]
    byte: list[int]  # ids of the 256 bytes; empty without byte fallback
    unknown: int
    raw: list[bytes]  # by id: the bytes a piece stands for
    unigram: bool
    prefix: bool
    longest: int

    @staticmethod
    def load(path: str, unigram: bool | None = None) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without text normalisation are handled")
        plain = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        order = sorted(plain, key=lambda x: (-plain[x][1], plain[x][0]))
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type in (1, 4) else b"" for p in m.pieces]
        byte = {raw[i][0]: i for i, p in enumerate(m.pieces) if p.type == 6}
        raw[m.trainer_spec.unk_id] = " ⁇ ".encode()
        by_score = m.trainer_spec.model_type == 1 if unigram is None else unigram
        return Pieces({p: i for p, (i, _) in plain.items()}, {p: k for k, p in enumerate(order)}, {p: s for p, (_, s) in plain.items()}, [byte[b] for b in range(256)] if len(byte) == 256 else [], m.trainer_spec.unk_id, raw, by_score, m.normalizer_spec.add_dummy_prefix, max(map(len, plain), default=1))

    def cut(self) -> Cut:
        pairs = {(ord(a), ord(b)) for p in self.ids for a, b in zip(p, p[1:])}
        chars = np.array(sorted({c for ab in pairs for c in ab}), dtype=np.int64)
        inner = np.zeros((len(chars), len(chars)), dtype=bool)
        if pairs:
            a, b = np.searchsorted(chars, np.array(sorted(pairs)).T)
            inner[a, b] = True
        return Cut(self.prefix, chars, inner)

    @cached_property
    def level(self) -> dict[str, tuple[int, int]]:
        """The least and the greatest number of the pieces of equal score: merges of one level go from the left."""
        ends: dict[float, list[int]] = {}
        for s in sorted(self.rank, key=self.rank.get):
            ends.setdefault(self.score[s], [self.rank[s]] * 2)[1] = self.rank[s]
        return {s: tuple(ends[self.score[s]]) for s in self.rank}

    @cached_property
    def spines(self) -> dict[str, tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
        """For each piece of two or more characters that merges make, the prefixes and the suffixes that are symbols on the way, as (length, greatest number of a piece that is merged across their outer end before they are taken up)."""
        out = {}
        for piece in self.rank:
            if len(piece) < 2:
                continue
            part = list(piece)
            left, right = [], []
            while len(part) > 1:
                (lo, hi), i = min((self.level.get(a + b, (NEVER, NEVER)), k) for k, (a, b) in enumerate(zip(part, part[1:])))
                if lo == NEVER:
                    break
                if any(len(x) > 1 and self.level[x][0] > lo for x in part[i : i + 2]):
                    raise ValueError("a piece must not rank before the pieces that it is merged from")
                if i == 0:
                    left.append((len(part[0]), hi))  # a merge on the left goes before one of its level
                if i == len(part) - 2:
                    right.append((len(part[-1]), lo - 1))
                part[i : i + 2] = [part[i] + part[i + 1]]
            if len(part) == 1:
                out[piece] = ([*left, (len(piece), NEVER)], [*right, (len(piece), NEVER)])
        return out


@cache
def pieces_of(path: str, unigram: bool | None = None) -> Pieces:
    return Pieces.load(path, unigram)


def count_units(texts: DataFrame, cut: Cut, counted: int = COUNTED) -> DataFrame:
    """(unit, n): how often each unit occurs in all texts; counted in each task before the shuffle.

    A task holds the counts of at most twice `counted` units and those of one cut; beyond that it
    passes the rarer ones on, whose counts are summed up after the shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def total() -> pa.Table:
            t = pa.concat_tables(held).group_by("unit").aggregate([("n", "sum")])
            held.clear()
            return t.select(["unit", "n_sum"]).rename_columns(["unit", "n"])

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in t.to_batches(20_000):
                yield b.cast(pa.schema([("unit", pa.string()), ("n", pa.int64())]))

        for b in batches:
            for some in slices(b.column(0)):
                found = cut.units(some)[0].value_counts()
                held.append(pa.Table.from_arrays([found.field(0), found.field(1)], names=["unit", "n"]))
                rows += len(found)
                if rows > 2 * counted:
                    t = total()
                    if t.num_rows > counted:
                        # the more frequent ones stay, for they will be met again
                        order = pc.array_sort_indices(t.column("n"), order="descending")
                        yield from out(t.take(order[counted // 2 :]))
                        t = t.take(order[: counted // 2])
                    held.append(t)
                    rows = t.num_rows
                    del t
                    tidy()
        if held:
            yield from out(total())
        tidy()

    return texts.mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


class Fold:
    """The tokens of many units at once, from the edges of their lattices; what it holds of the pieces is small enough for every task.

    Units lie one after another: one of n characters has n + 1 places, and an edge is known by the
    place where it ends and its length. A step takes the next edge of every unit.
    """

    def __init__(self, p: Pieces) -> None:
        self.longest, self.unigram, self.none = p.longest, p.unigram, len(p.rank)
        order = sorted(p.rank, key=p.rank.get)
        self.ids = np.array([p.ids[s] for s in order], dtype=np.int32)
        self.score = np.array([p.score[s] for s in order])
        self.low = min(p.score.values(), default=0.0) - 10
        self.chars = {s: p.rank[s] for s in order if len(s) == 1}
        self.byte, self.unknown = p.byte, p.unknown
        # the last place is that of one character, which no greater symbol takes up
        ways = [([], [])] * self.none if p.unigram else [p.spines.get(s, ([], [])) for s in order]
        self.begins, self.ends = (self._lists([*(w[side] for w in ways), [(1, NEVER)]]) for side in (0, 1))

    @staticmethod
    def _lists(ways: list[list[tuple[int, int]]]) -> tuple[np.ndarray, ...]:
        """Where each list begins, how long it is, and the lengths and numbers of all."""
        size = np.array([len(w) for w in ways])
        return np.cumsum(size) - size, size, np.array([k for w in ways for k, _ in w], dtype=np.int32), np.array([r for w in ways for _, r in w], dtype=np.int32)

    def merges(self, base: np.ndarray, unit: np.ndarray, end: np.ndarray, size: np.ndarray, number: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
        """By place, the number and the length of the last token before it, as BPE gives it: Viterbi with one survivor an end.

        The BPE tokens of a text are the one path on which any two neighbours alone would be merged
        to themselves. So the last token before an end is that edge whose left neighbour, the last
        token before its start, goes with it: no symbol that ends the neighbour and one that begins
        the edge would have been merged before both are taken up by greater ones (of one level the
        left merge is first). Where no longer edge fits, it is one character.
        """
        across = np.full((places, self.longest + 1), NEVER + 1, dtype=np.int32)  # no edge is over all numbers
        across[end, size] = number
        last, length = np.full(places, self.none), np.ones(places, dtype=np.int64)
        order = np.argsort(end * (self.longest + 1) + self.longest - size)
        turn = np.arange(len(order)) - np.searchsorted(unit[order], np.arange(len(base)))[unit[order]]
        order = order[np.argsort(turn, kind="stable")]
        reach = np.concatenate([[0], np.cumsum(np.bincount(turn))])
        for lo, hi in zip(reach[:-1].tolist(), reach[1:].tolist(), strict=True):
            own = order[lo:hi]
            own = own[last[end[own]] == self.none]
            at = end[own] - size[own]
            fits = np.ones(len(own), dtype=bool)
            inner = np.flatnonzero(at > base[unit[own]])
            fits[inner] = ~self._crossed(across, last[at[inner]], number[own[inner]], at[inner])
            own = own[fits]
            last[end[own]], length[end[own]] = number[own], size[own]
        return last, length

    def _crossed(self, across: np.ndarray, before: np.ndarray, edge: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether symbols of the token before an edge and of the edge merge across its start."""
        (lx, nx, kx, rx), (ly, ny, ky, ry) = self.ends, self.begins
        pairs = nx[before] * ny[edge]
        row = np.repeat(np.arange(len(at)), pairs)
        step = np.arange(len(row)) - (np.cumsum(pairs) - pairs)[row]
        x, y = lx[before][row] + step // ny[edge][row], ly[edge][row] + step % ny[edge][row]
        both = kx[x] + ky[y]
        met = (both <= self.longest) & (across[at[row] + ky[y], np.minimum(both, self.longest)] <= np.minimum(rx[x], ry[y]))
        return np.bincount(row[met], minlength=len(at)) > 0

    def best(self, base: np.ndarray, n: np.ndarray, codes: np.ndarray, end: np.ndarray, size: np.ndarray, number: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
        """By place, the number and the length of the last token on the way of greatest score before it, of equal ones the shortest: Viterbi over a unigram model's scores."""
        across = np.full((places, self.longest + 1), self.none)
        across[end, size] = number
        score = np.append(self.score, -np.inf)
        kinds, kind = np.unique(codes, return_inverse=True)
        one = np.array([self.score[self.chars[chr(c)]] if chr(c) in self.chars else self.low for c in kinds.tolist()])[kind]
        last, length, total = np.full(places, self.none), np.ones(places, dtype=np.int64), np.zeros(places)
        for e in range(1, int(n.max(initial=0)) + 1):
            unit = np.flatnonzero(n >= e)
            at = base[unit] + e
            total[at] = total[at - 1] + one[at - unit - 1]
            for k in range(2, min(e, self.longest) + 1):
                way = total[at - k] + score[across[at, k]]
                better = way > total[at]
                total[at[better]], length[at[better]], last[at[better]] = way[better], k, across[at[better], k]
        return last, length

    def encode(self, units: pa.Array, unit: np.ndarray, end: np.ndarray, size: np.ndarray, number: np.ndarray) -> pa.ListArray:
        """The ids of units, by edges that end after so many characters of unit number `unit`; a character that is no piece has the ids of its bytes."""
        codes = np.frombuffer("".join(units.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
        n = pc.utf8_length(units).to_numpy().astype(np.int64)
        base = np.cumsum(n + 1) - (n + 1)
        end, places = base[unit] + end, int((n + 1).sum())
        last, length = self.best(base, n, codes, end, size, number, places) if self.unigram else self.merges(base, unit, end, size, number, places)
        now, of, found = base + n, np.arange(len(n)), []
        while now.size:
            found.append((now, of))
            now = now - length[now]
            left = now > base[of]
            now, of = now[left], of[left]
        at, of = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        order = np.argsort(at)
        at, of = at[order], of[order]
        token = last[at]
        bare = np.flatnonzero(token == self.none)
        kinds, kind = np.unique(codes[at[bare] - of[bare] - 1], return_inverse=True)
        lists = [self._char(chr(c)) for c in kinds.tolist()]
        token[bare] += kind
        many = np.concatenate([np.ones(self.none, dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64)])
        flat = np.concatenate([self.ids, np.array([i for x in lists for i in x], dtype=np.int32)])
        out = np.concatenate([[0], np.cumsum(np.bincount(of, weights=many[token], minlength=len(n)).astype(np.int64))])
        return pa.ListArray.from_arrays(pa.array(out, pa.int32()), pa.array(_runs(flat, (np.cumsum(many) - many)[token], many[token])))

    def _char(self, c: str) -> list[int]:
        if c in self.chars:
            return [int(self.ids[self.chars[c]])]
        return [self.byte[b] for b in c.encode()] if self.byte else [self.unknown]


def piece_table(units: DataFrame, p: Pieces) -> DataFrame:
    """(piece, x): the numbers of the pieces of two or more characters that can be edges.

    From an Arrow table, which the JVM reads itself: rows in a list would start more Python workers
    on the executors, under a daemon of their own that stays.
    """
    found = {s: number for s, number in p.rank.items() if len(s) > 1 and (p.unigram or s in p.spines)}
    return units.sparkSession.createDataFrame(pa.table({"piece": pa.array(list(found), pa.string()), "x": pa.array(list(found.values()), pa.int32())}))


def lattice(units: DataFrame, p: Pieces, at_once: int = EDGES) -> DataFrame:
    """(unit, n, ids) of units (uid, unit, n); rows of a uid are to be in one partition.

    Each unit's substrings of up to the longest piece's length are exploded and equi-joined to the
    piece table, whose size the vocabulary bounds. The edges that are found are folded, those of
    many units at once; neither the explosion nor the join with a broadcast table moves rows, so that
    a unit's edges follow its first row. A unit is looked at through windows of STARTS places, so
    that a long one costs as much a character as a short one. Empty units give no row.
    """
    length = F.length("unit")
    views = units.where(length > 0).select("unit", "n", F.explode(F.sequence(F.lit(0), F.call_function("div", length - 1, F.lit(STARTS)).cast("int"))).alias("w"))
    views = views.withColumn("part", F.col("unit").substr(F.col("w") * STARTS + 1, F.lit(STARTS + p.longest - 1)))
    starts = views.withColumn("s", F.explode(F.sequence(F.lit(0), F.least(F.lit(STARTS), F.length("part")) - 1)))
    # the row of length 1 at the first place keeps the unit
    least = F.when((F.col("w") == 0) & (F.col("s") == 0), 1).otherwise(2)
    most = F.least(F.lit(max(p.longest, 1)), F.length("part") - F.col("s"))
    spans = starts.where(most >= least).withColumn("k", F.explode(F.sequence(least, most)))
    first = F.col("k") == 1
    spans = spans.select((F.col("w") * STARTS + F.col("s") + F.col("k")).alias("e"), "k", F.when(first, F.col("unit")).alias("unit"), F.when(first, F.col("n")).alias("n"), F.col("part").substr(F.col("s") + 1, F.col("k")).alias("piece"))
    found = spans.join(F.broadcast(piece_table(units, p)), "piece", "left").where("k = 1 or x is not null").select("e", "k", "unit", "n", "x")
    fold = Fold(p)

    def folded(t: pa.Table) -> pa.RecordBatch:
        e, k = (t.column(c).to_numpy().astype(np.int64) for c in ("e", "k"))
        at = np.flatnonzero(k == 1)
        edges = np.flatnonzero(k > 1)
        unit, n = (t.column(c).take(pa.array(at)).combine_chunks() for c in ("unit", "n"))
        number = pc.fill_null(t.column("x"), 0).to_numpy()[edges]
        ids = fold.encode(unit, np.searchsorted(at, edges) - 1, e[edges], k[edges], number)
        return pa.RecordBatch.from_arrays([unit, n, ids], names=["unit", "n", "ids"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if rows + b.num_rows > at_once and (begins := np.flatnonzero(b.column("k").to_numpy() == 1)).size:
                yield folded(pa.Table.from_batches([*held, b.slice(0, int(begins[-1]))]))
                b = b.slice(int(begins[-1]))
                held, rows = [], 0
            held.append(b)
            rows += b.num_rows
        if rows:
            yield folded(pa.Table.from_batches(held))
        held.clear()
        tidy()

    return found.mapInArrow(run, "unit string, n long, ids array<int>")


def unit_table(texts: DataFrame, p: Pieces) -> DataFrame:
    """(unit, n, ids) of all units of all texts, written to the shared folder."""
    spark = texts.sparkSession
    counted = materialise(count_units(texts, p.cut()).withColumn("uid", F.monotonically_increasing_id()), "counted")
    # by number, for small rows become many: a part is not to grow with the table
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), counted.count() // PART_UNITS + 1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH))  # rows of an edge are short
    try:
        table = materialise(lattice(counted.repartition(parts, "uid"), p), "units")
    finally:
        spark.conf.set(key, before)
    discard(counted)
    return table


#: The seeds of the two hashes by which a unit is known in the broadcast table: 96 bits together.
SEEDS = (42, xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42))


def _hashes(unit: str) -> list[Column]:
    """As XXH64 with each of SEEDS: Spark chains the hash of several columns by seeds. Of the second, 32 bits."""
    return [F.xxhash64(unit), F.xxhash64(F.lit(1), unit).bitwiseAND((1 << 32) - 1)]


def _packed(table: DataFrame) -> dict[str, np.ndarray]:
    """The units' hashes in order, where each one's ids begin, and all ids.

    Executors sort and pack them, so that the driver gets plain bytes, one part after another, into
    arrays whose size BROADCAST_BYTES bounds.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            size, flat = np.diff(lists.offsets.to_numpy()).astype(np.uint32), lists.flatten().to_numpy().astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (b.column("h").to_numpy(), b.column("g").to_numpy().astype(np.uint32), size, flat)], names=["h", "g", "size", "flat"])

    n, ids, most = table.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.max(F.array_max("ids")), F.lit(0))).first()
    out = {"h": np.zeros(n, np.int64), "g": np.zeros(n, np.uint32), "at": np.zeros(n + 1, np.uint32), "flat": np.zeros(ids, np.uint16 if most < 1 << 16 else np.uint32)}
    h, g = _hashes("unit")
    i = j = 0
    for row in table.select(h.alias("h"), g.alias("g"), "ids").orderBy("h", "g").mapInArrow(run, "h binary, g binary, size binary, flat binary").toLocalIterator():
        size, flat = np.frombuffer(row.size, np.uint32), np.frombuffer(row.flat, np.uint32)
        out["h"][i : i + len(size)] = np.frombuffer(row.h, np.int64)
        out["g"][i : i + len(size)] = np.frombuffer(row.g, np.uint32)
        out["at"][i + 1 : i + 1 + len(size)] = j + np.cumsum(size)
        out["flat"][j : j + len(flat)] = flat
        i, j = i + len(size), j + len(flat)
    return out


def _runs(values: np.ndarray, begins: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of values that begin there, one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(begins - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class UnitIds:
    """Ids of texts, from the broadcast table of the units' ids.

    Made anew in each task from the worker's one copy of the table, so that nothing but Spark keeps
    that copy: it goes with the worker's next task that has no use for it.
    """

    def __init__(self, table: dict[str, np.ndarray], cut: Cut) -> None:
        self.h, self.g, self.at, self.flat = (table[k] for k in ("h", "g", "at", "flat"))
        self.cut = cut
        same = self.h[1:] == self.h[:-1]
        self.twins = int(same.sum())  # steps that reach any of the units of one first hash

    def find(self, units: list[bytes]) -> np.ndarray:
        """The place of each unit in the table, -1 if it is not there."""
        h, g = (np.fromiter((xxhash.xxh64_intdigest(u, s) for u in units), dtype=np.uint64, count=len(units)) for s in SEEDS)
        h, g = h.view(np.int64), g.astype(np.uint32)
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        for _ in range(self.twins):
            after = np.minimum(at + 1, len(self.h) - 1)
            at = np.where((self.h[at] == h) & (self.g[at] != g) & (self.h[after] == h), after, at)
        return np.where((self.h[at] == h) & (self.g[at] == g), at, -1)

    def encode(self, texts: pa.Array, rare: dict[bytes, list[int]]) -> pa.ListArray:
        """The ids of each text; rare has those of units that the table lacks."""
        units, reach = self.cut.units(texts)
        told = units.dictionary_encode()
        keys = told.dictionary.cast(pa.large_binary()).to_pylist()
        at = self.find(keys)
        there = np.maximum(at, 0)
        size = np.where(at >= 0, self.at[there + 1].astype(np.int64) - self.at[there], 0) if len(self.h) else np.zeros(len(at), dtype=np.int64)
        flat = _runs(self.flat, self.at[there].astype(np.int64), size) if len(self.h) else np.zeros(0, dtype=np.uint32)
        begins = np.cumsum(size) - size
        if (lacking := np.flatnonzero(at < 0)).size:
            lists = [rare[keys[i]] for i in lacking.tolist()]
            size[lacking] = [len(x) for x in lists]
            begins[lacking] = len(flat) + np.cumsum(size[lacking]) - size[lacking]
            flat = np.concatenate([flat, np.array([i for x in lists for i in x], dtype=np.uint32)])
        n = told.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[n])])
        return pa.ListArray.from_arrays(pa.array(ends[reach], pa.int32()), pa.array(_runs(flat, begins[n], size[n]).astype(np.int32)))


def least_count(table: DataFrame, limit: int) -> int:
    """Units that occur so often have a place in the broadcast table: the most frequent ones, as far as `limit` bytes reach."""
    cost = F.sum(F.lit(UNIT_BYTES) + ID_BYTES * F.size("ids"))
    total = 0
    for n, size in table.groupBy("n").agg(cost).orderBy(F.desc("n")).toLocalIterator():
        total += size
        if total > limit:
            return n + 1
    return 0


def encode(docs: DataFrame, path: str, text_col: str = "text", name: str = "piece_ids", limit: int = BROADCAST_BYTES, unigram: bool | None = None) -> tuple[DataFrame, str]:
    """(docs plus an array<int> column of ids, that column's name, with underscores if docs has it).

    The ids are those that the model's own library gives. Units (see Cut) are encoded once each, by
    unit_table(). The ids of the most frequent ones, as far as `limit` bytes reach, are broadcast; a
    text's other units get theirs by a join by unit, grouped by the text's hash and joined to the
    text. Null and empty texts have no ids; bytes that are no UTF-8 count as U+FFFD. Repeated rows
    and other columns of any name stay. No rows give no rows. With unigram, a model's pieces and
    scores are taken as a unigram model's, whatever it is.
    """
    spark, columns = docs.sparkSession, docs.columns
    small_batches(spark, 1000)
    name = free_name(docs, name)
    p = pieces_of(path, unigram)
    cut = p.cut()
    text = F.call_function("make_valid_utf8", F.col(text_col).cast("string"))
    table = unit_table(docs.select(text.alias("text")), p)
    least = least_count(table, limit)
    sent = spark.sparkContext.broadcast(_packed(table.where(F.col("n") >= least)))
    tidy()
    rare_col, text_at, h = free_name(docs, "rare_units"), free_name(docs, "piece_text"), free_name(docs, "text_hash")
    ready = docs.withColumn(text_at, text)
    if least:
        hashed = docs.where(text.isNotNull()).select(F.unhex(F.sha2(text, 256)).alias("h"), text.alias("text"))

        def missing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = UnitIds(sent.value, cut)
            for b in batches:
                rows: tuple[list, list] = ([], [])
                for hash_, t in zip(b.column("h").to_pylist(), b.column("text"), strict=True):
                    units = known.cut.units(pa.array([t]))[0].unique()
                    rare = units.filter(pa.array(known.find(units.cast(pa.large_binary()).to_pylist()) < 0))
                    rows[0].extend([hash_] * len(rare))
                    rows[1].extend(rare.to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.string())], names=["h", "unit"])
            tidy()

        rare = hashed.mapInArrow(missing, "h binary, unit string").distinct().join(table.where(F.col("n") < least).select("unit", "ids"), "unit")
        by_text = rare.groupBy("h").agg(F.collect_list(F.struct("unit", "ids")).alias(rare_col)).withColumnRenamed("h", h)
        ready = ready.join(by_text, F.unhex(F.sha2(text_at, 256)) == F.col(h), "left").drop(h)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = UnitIds(sent.value, cut)
        for b in batches:
            rare = {x["unit"].encode(): x["ids"] for more in b.column(rare_col).to_pylist() for x in more or ()} if least else {}
            kept = [c for k, c in zip(b.schema.names, b.columns, strict=True) if k in columns]
            at = 0
            for some in slices(b.column(text_at)):
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(some)) for c in kept), known.encode(some, rare)], names=[*columns, name])
                at += len(some)
        tidy()

    return ready.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])), name


def decode(df: DataFrame, path: str, ids_col: str, name: str = "decoded") -> tuple[DataFrame, str]:
    """(df plus the text of each row's ids, that column's name): pieces one after another, bytes that are no UTF-8 as U+FFFD, without the space that encoding puts first. Null ids give null."""
    p = pieces_of(path)
    name = free_name(df, name)
    codes = F.split(F.lit(",".join(x.hex() for x in p.raw)), ",")
    text = F.call_function("make_valid_utf8", F.unhex(F.array_join(F.transform(ids_col, lambda i: F.get(codes, i)), "")).cast("string"))
    return df.withColumn(name, F.when(text.startswith(" "), F.substring(text, 2, 2_000_000_000)).otherwise(text) if p.prefix else text), name
