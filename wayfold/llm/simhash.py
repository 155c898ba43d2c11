"""SimHash near-duplicates by the generalised pigeonhole principle; alike texts by SimHash, and by an exact prefix filter those that it leaves apart."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .groups import deal, together, unite, whole_groups
from .store import discard, gathered, materialise, small_batches
from .words import tidy

SEED = 42
#: Distinct fingerprints compared within one task's group; hotter keys are dealt out in pairs of blocks.
GROUP_CAP = 8192
#: Estimated costs, in microseconds, of one index row and of one candidate pair.
ROW_COST, PAIR_COST = 2.0, 0.01


def fingerprint(text: str | None, words: int) -> int:
    """64 bits; bit i is set if it is set in over half the XXH64 of the text's shingles."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return 0
    n = max(1, len(ws) - words + 1)
    shingles = [b" ".join(ws)] if n == 1 else map(b" ".join, zip(*(ws[i:] for i in range(words))))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n))


def majority(h: np.ndarray) -> int:
    """64 bits; bit i is set if it is set in over half of h."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, the 64 bits as a signed number) for each row; null and wordless texts have 0."""
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), words) for x in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])
        tidy()

    return wanted.mapInArrow(run, f"doc_id {kind}, fp long")


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """64 x 64: how many of all fingerprints have both bits set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), dtype=np.int64)
        for b in batches:
            bits = np.unpackbits(b.column("fp").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"i": list(range(64)), "c": total.tolist()}, schema=pa.schema([("i", pa.int32()), ("c", pa.list_(pa.int64()))]))

    rows = nodes.select("fp").mapInArrow(run, "i int, c array<long>").groupBy("i").agg(*(F.sum(F.col("c")[j]).alias(f"c{j}") for j in range(64))).collect()
    out = np.zeros((64, 64))
    for r in rows:
        out[r[0]] = [x or 0 for x in r[1:]]
    return out


def correlated_parts(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m lists of bits, as equal in length as may be; each gathers the bits that go most together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(p * (1 - p)) + 1e-9
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    left, parts = set(range(64)), []
    for k in range(m):
        width = len(left) // (m - k)
        own = [max(sorted(left), key=lambda b: r[b, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < width:
            own.append(max(sorted(left), key=lambda b: r[b, own].sum()))
            left.discard(own[-1])
        parts.append(sorted(own))
    return parts


def plan(both: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """The parts to index and the threshold of each, 0 or 1, of least estimated cost.

    General pigeonhole principle: if thresholds t_i of at least -1 sum to radius - m + 1, then any
    two fingerprints within the radius differ in at most t_i bits of some part i. For each number
    of parts, dynamic programming shares that sum out. A part's number of candidates is estimated
    from how often each of its bits is set in all fingerprints; -1 leaves a part out.
    """
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(2, 2 * radius + 3):
        need = radius - m + 1
        if not -m <= need <= m or m > 16:
            continue
        parts = correlated_parts(both, n, m)
        costs = []
        for bits in parts:
            equal = float(np.prod(1 - differ[bits]))
            one = equal * float(np.sum(differ[bits] / (1 - differ[bits])))
            pairs = n * n / 2
            costs.append({-1: 0.0, 0: ROW_COST * n + PAIR_COST * pairs * equal, 1: ROW_COST * n * (1 + len(bits) / 2) + PAIR_COST * pairs * (equal + one)})
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in costs:
            after: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, ts) in table.items():
                for t in (-1, 0, 1):
                    if s + t not in after or cost + c[t] < after[s + t][0]:
                        after[s + t] = (cost + c[t], [*ts, t])
            table = after
        if need in table and table[need][0] < best[0]:
            best = (table[need][0], [(b, t) for b, t in zip(parts, table[need][1], strict=True) if t >= 0])
    return best[1]


def signed(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def _probe(part: int, mask: Column) -> Callable[[Column], Column]:
    return lambda bit: F.struct(F.lit(part).alias("part"), F.col("fp").bitwiseAND(mask).bitwiseOR(bit).alias("key"), F.lit(True).alias("probe"))


def _index(nodes: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """A row (part, key, probe) for each part of a fingerprint and, at threshold 1, for each of its unset bits set."""
    rows = []
    for k, (bits, t) in enumerate(chosen):
        mask = F.lit(signed(bits))
        rows.append(F.array(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(mask).alias("key"), F.lit(False).alias("probe"))))
        if t:
            each = F.array(*(F.lit(signed([b])) for b in bits))
            unset = F.filter(each, lambda b: F.col("fp").bitwiseAND(b) == 0)
            rows.append(F.transform(unset, _probe(k, mask)))
    return nodes.select("fp", F.explode(F.concat(*rows)).alias("x")).select("fp", "x.*")


def _refine(rows: DataFrame, chosen: list[tuple[list[int], int]], radius: int, cap: int) -> DataFrame:
    """Hot keys are cut again: their other bits fall in radius + 1 runs, of which two near fingerprints share one."""
    hot = materialise(rows.groupBy("part", "key").count().where(F.col("count") > cap).select("part", "key", F.lit(True).alias("hot")), "hot")
    n = hot.count()
    rows = rows.withColumn("sub", F.lit(0))
    if not n:
        return rows
    marked = rows.join(F.broadcast(hot) if n <= 100_000 else hot, ["part", "key"], "left")
    cool = marked.where("hot is null").drop("hot")
    finer = []
    for k, (bits, _) in enumerate(chosen):
        rest = [b for b in range(64) if b not in bits]
        own = marked.where(F.col("hot") & (F.col("part") == k)).drop("hot")
        each = F.array(*(F.struct(F.lit(j + 1).alias("sub"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.lit(signed(rest[j :: radius + 1])))).alias("key")) for j in range(radius + 1)))
        finer.append(own.select("fp", "part", "probe", F.explode(each).alias("x")).select("fp", "part", "x.key", "probe", "x.sub"))
    for f in finer:
        cool = cool.unionByName(f)
    return cool


def near_links(nodes: DataFrame, radius: int = 3, cap: int = GROUP_CAP, pairs_up_to: int = 1) -> DataFrame:
    """(a, b): links within the radius that join just those distinct fingerprints that all links would join.

    Each group of equal keys is compared whole in its task, and only links between members that
    are not yet connected there are kept: at most one for each member, also in a dense group. With
    pairs_up_to, members that connect with no more than so many there keep all links among them.
    """
    n = nodes.count()
    chosen = plan(bit_counts(nodes), n, radius)
    rows = deal(_refine(_index(nodes, chosen), chosen, radius, cap), ["part", "sub", "key"], "fp", cap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g in whole_groups(batches, ["part", "sub", "key"]):
            fp, probe, own = (t.column(c).to_numpy() for c in ("fp", "probe", "own"))
            across = t.column("ba").to_numpy() != t.column("bb").to_numpy()
            bits = fp.view(np.uint64)
            parent = np.arange(len(fp))
            met: list[tuple[np.ndarray, np.ndarray]] = []
            i, step = np.arange(len(fp)), 1
            while i.size:
                i = i[i < len(fp) - step]
                i = i[g[i] == g[i + step]]
                j = i + step
                near = (np.bitwise_count(bits[i] ^ bits[j]) <= radius) & ~(probe[i] & probe[j]) & (~across[i] | (own[i] != own[j]))
                if near.any():
                    parent = unite(parent, i[near], j[near])
                    if pairs_up_to > 1:
                        met.append((i[near], j[near]))
                step += 1
            linked = np.flatnonzero(parent != np.arange(len(fp)))
            a, b = [fp[linked]], [fp[parent[linked]]]
            few = np.bincount(parent, minlength=len(fp)) <= pairs_up_to
            for x, y in met:
                own = few[parent[x]]
                a.append(fp[x[own]])
                b.append(fp[y[own]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return together(rows, ["part", "sub", "key"]).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, cap: int = GROUP_CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for each row of docs.

    Rows of equal fingerprint are one node; nodes within the radius are linked; component_id is the
    least doc_id that links reach. Null and wordless texts have fingerprint zero and link like any
    other. A null doc_id keeps its row; a component of null ids alone has null. Repeated rows
    stay. No rows give no rows. Other columns, whatever their names, are not looked at.
    """
    prints = materialise(fingerprints(docs, words, id_col, text_col), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = materialise(connected_components(near_links(nodes, radius, cap)), "roots")
    of = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    low = of.groupBy("root").agg(F.min("least").alias("component_id"))
    to = materialise(of.join(low, "root").select("fp", "component_id"), "components")
    return prints.join(to, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Ids to drop, and shared shingles, up to these numbers are broadcast; beyond them the join shuffles.
BROADCAST_IDS, BROADCAST_KEYS = 2_000_000, 1_000_000
#: Links up to this number are joined in one task; beyond it by rounds over all tasks.
FEW_LINKS = 500_000
#: Texts that tell which shingles are common, and the number of them from which a shingle is.
SAMPLE, COMMON = 4000, 8
#: Texts with their shingles compared within one task's group, and rounds in which a text goes to one key only.
SETS_CAP, ROUNDS = 2048, 3
#: Keys with up to so many candidate pairs for each node give pairs; nodes of the others are compared in whole groups.
PAIRS = 16


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different XXH64 of the text's word shingles, in ascending order."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(ws) - words + 1)
    shingles = [b" ".join(ws)] if n == 1 else map(b" ".join, zip(*(ws[i:] for i in range(words))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n))


def set_node(s: np.ndarray) -> int:
    """64 bits, as a signed number, that stand for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of each text of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])
        tidy()

    return docs.select("text").mapInArrow(run, "node long, shingles array<long>")


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of COMMON or more of about SAMPLE texts, in ascending order, and in how many each is."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n) + 1) if n > SAMPLE else docs
    found = shingle_sets(some, words).select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= COMMON).toArrow()
    s = found.column("s").to_numpy().view(np.uint64)
    order = np.argsort(s)
    return s[order], found.column("count").to_numpy()[order]


def prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, node, fp, size, sig, prefix): two texts that are as similar share a shingle of their prefixes.

    The prefix filter: in one order of all shingles, sets of n shingles with a Jaccard similarity of
    at least s share one of the first n - ceil(s n) + 1 of each. Any order does; common shingles
    come last, so that few texts share a prefix's shingle without being alike. sig counts the set's
    shingles in 64 buckets, 255 at most in each; fp is the SimHash of the set, each shingle once, so
    that a line that a text repeats does not decide it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = sent.value
        for b in batches:
            nodes, prints, sizes, sigs, out = [], [], [], [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), words)
                nodes.append(set_node(s))
                prints.append(majority(s))
                sizes.append(len(s))
                sigs.append(np.minimum(np.bincount((s & np.uint64(63)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes())
                p = len(s) - ceil(similarity * len(s) - 1e-9) + 1
                if len(common) and len(s):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, count[at], 0), kind="stable")]
                out.append(s[:p].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "node", "fp", "size", "sig", "prefix"])
        tidy()

    return docs.mapInArrow(run, f"doc_id {kind}, node long, fp long, size int, sig binary, prefix array<long>")


def spanning_links(sets: list[np.ndarray], comp: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links, each of a true similarity, that join just those sets that all links and equal `comp` would join.

    A search from set to set: those that a reached one links are reached and not looked at again,
    so alike sets take few comparisons, and no pair of unlike ones is left out.
    """
    size = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(token, np.cumsum(size)[:-1])
    mark = np.zeros(len(token), dtype=np.int32)
    _, comp = np.unique(comp, return_inverse=True)
    left = np.arange(len(sets))
    links: list[tuple[int, int]] = []
    while left.size:
        front = left[comp[left] == comp[left[0]]].tolist()
        left = left[comp[left] != comp[left[0]]]
        flat = np.concatenate([own[i] for i in left]) if left.size else None
        while front and left.size:
            x = front.pop()
            mark[own[x]] = 1
            starts = np.cumsum(size[left]) - size[left]
            both = np.add.reduceat(mark[flat], starts)
            mark[own[x]] = 0
            near = both >= similarity * (size[x] + size[left] - both) - 1e-9
            if near.any():
                links += [(x, int(y)) for y in left[near]]
                reached = np.isin(comp[left], comp[left[near]])
                front += left[reached].tolist()
                flat = flat[np.repeat(~reached, size[left])]
                left = left[~reached]
    return links


def verified_links(rows: DataFrame, sets: DataFrame, similarity: float, cap: int) -> DataFrame:
    """(a, b): links among the nodes of equal key in rows (key, node, comp), by their sets (node, shingles)."""
    dealt = deal(rows, ["key"], "node", cap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g in whole_groups(batches, ["key"], rows=cap):
            node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
            lists = t.column("shingles").combine_chunks()
            if isinstance(lists, pa.ChunkedArray):
                lists = pa.concat_arrays(lists.chunks)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            ends = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            a, b = [], []
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                for x, y in spanning_links([values[at[k] : at[k + 1]] for k in range(i, j)], comp[i:j], similarity) if j > i + 1 else ():
                    a.append(node[i + x])
                    b.append(node[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        tidy()

    return together(dealt.join(sets, "node").select("key", "ba", "bb", "node", "comp", "shingles"), ["key"]).mapInArrow(run, "a long, b long")


def may_link(rows: DataFrame, similarity: float, cap: int = GROUP_CAP) -> DataFrame:
    """The rows (key, node, pos, size, sig, comp) that may link there with one of another comp, with n, how many do of the key, and the other node.

    A key of few such pairs gives a row for each pair; else there is one for each node, and other is null.

    Three bounds leave no pair out: sets are too unlike in size; their first common shingle comes so
    late that too few are left behind it (each pair is looked at in its first common key); or their
    buckets' counts differ by more than the sets may.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g in whole_groups(batches, ["key"]):
            node, pos, size, comp = (t.column(c).to_numpy().astype(np.int64) for c in ("node", "pos", "size", "comp"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, 64)
            may = np.zeros(len(g), dtype=bool)
            count = np.zeros(int(g[-1]) + 1, dtype=np.int64)
            members = np.bincount(g, minlength=len(count))
            met: list[tuple[np.ndarray, np.ndarray]] = []
            i, step = np.arange(len(g)), 1
            while i.size:
                i = i[i < len(g) - step]
                i = i[g[i] == g[i + step]]
                j = i + step
                total = size[i] + size[j]
                least = similarity / (1 + similarity) * total - 1e-6
                ok = np.flatnonzero((comp[i] != comp[j]) & (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= least))
                for at in range(0, len(ok), 100_000):
                    k = ok[at : at + 100_000]
                    x, y = sig[i[k]], sig[j[k]]
                    k = k[(np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64) <= total[k] - 2 * least[k]]
                    may[i[k]] = may[j[k]] = True
                    np.add.at(count, g[i[k]], 1)
                    own = count[g[i[k]]] <= PAIRS * members[g[i[k]]]
                    met.append((i[k][own], j[k][own]))
                step += 1
            few = (count <= PAIRS * members)[g]
            a, b = (np.concatenate([m[e] for m in met] or [np.zeros(0, dtype=np.int64)]) for e in (0, 1))
            a, b = a[few[a]], b[few[a]]
            dense = np.flatnonzero(may & ~few)
            n = np.bincount(g, weights=may)[g].astype(np.int64)
            both = t.take(pa.array(np.concatenate([a, dense])))
            other = pa.array(np.concatenate([node[b], node[dense]]), mask=np.arange(len(a) + len(dense)) >= len(a))
            yield from both.select(["key", "node", "pos", "size", "sig", "comp"]).append_column("n", pa.array(n[np.concatenate([a, dense])])).append_column("other", other).combine_chunks().to_batches()

    return together(deal(rows, ["key"], "node", cap), ["key"]).mapInArrow(run, "key long, node long, pos int, size int, sig binary, comp long, n long, other long")


def wide_counts(sets: DataFrame) -> DataFrame:
    """(node, size, wide): each set's shingles in 1024 buckets, 255 at most in each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [x.values.to_numpy() for x in b.column("shingles")]
            wide = [np.minimum(np.bincount(x & 1023, minlength=1024), 255).astype(np.uint8).tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(x) for x in lists], pa.int32()), pa.array(wide, pa.binary())], names=["node", "size", "wide"])
        tidy()

    return sets.mapInArrow(run, "node long, size int, wide binary")


def linked_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sets (node, shingles) are as similar; only those whose buckets allow it meet with their sets."""
    counts = wide_counts(sets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, 1024) for c in ("x", "y"))
                most = (1 - similarity) / (1 + similarity) * b.column("total").to_numpy() + 1e-6
                yield b.select(["a", "b"]).filter(pa.array((np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64) <= most))

    sides = pairs.join(counts.select(F.col("node").alias("a"), F.col("wide").alias("x"), F.col("size").alias("p")), "a").join(counts.select(F.col("node").alias("b"), F.col("wide").alias("y"), F.col("size").alias("q")), "b")
    pairs = gathered(sides.select("a", "b", "x", "y", (F.col("p") + F.col("q")).alias("total")).mapInArrow(run, "a long, b long"), "pairs")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def simhash_links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, cap: int, radius: int) -> DataFrame:
    """(a, b): links that join those of nodes (node, fp) that are alike and that fingerprints within the radius lead to, one from another.

    All texts of a class of fingerprints are compared by their sets, not just those whose
    fingerprints are near: within a class no link is missed, and none is taken unseen.
    """
    prints = gathered(nodes.select("fp").distinct(), "prints")
    classes = connected_components(near_links(prints, radius), gathered, FEW_LINKS).withColumnRenamed("node", "fp")
    keyed = nodes.select("node", "fp").distinct().join(classes, "fp", "left").select("node", F.coalesce("root", "fp").alias("key"))
    several = keyed.groupBy("key").count().where("count > 1").select("key")
    rows = gathered(keyed.join(several, "key").select("key", "node", F.col("node").alias("comp")), "classes")
    return verified_links(rows, materialise(sets_of(rows.select("node")), "shingles"), similarity, cap)


def similar_components(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, cap: int, radius: int) -> DataFrame:
    """(node, root) for each of nodes (node, fp, size, sig, prefix) that links: components of all links, none left out.

    SimHash joins most of what is alike. The prefix filter then finds what it leaves apart: links
    between texts that are of different components by then. Of its keys, those with few candidates
    make pairs, each compared once. Of the other keys each node at first goes to one only, that with
    most nodes; keys whose nodes are joined by then are settled. All the rest are compared at last.
    """
    joined = gathered(connected_components(simhash_links(nodes, sets_of, similarity, cap, radius), gathered, FEW_LINKS), "joined")
    keys = nodes.select("node", F.posexplode("prefix").alias("pos", "key"))
    shared = gathered(keys.groupBy("key").count().where("count > 1").select("key"), "shared")
    # few of all keys as a rule: then the others leave before they are shuffled
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_KEYS else shared
    known = nodes.select("node", "size", "sig").dropDuplicates(["node"]).join(joined, "node", "left").select("node", "size", "sig", F.coalesce("root", "node").alias("comp"))
    found = materialise(may_link(keys.join(shared, "key").join(known, "node"), similarity), "candidates")
    wanted = gathered(found.select("node").union(found.where("other is not null").select("other")).distinct(), "wanted")
    n, sets = wanted.count(), materialise(sets_of(wanted), "shingles")
    links = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for k in range(ROUNDS + 1):
        pairs = gathered(found.where("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs")
        links = links.unionByName(linked_pairs(pairs, sets, similarity))
        dense = gathered(found.where("other is null").groupBy("key", "node").agg(*(F.first(c).alias(c) for c in ("pos", "size", "sig", "comp")), F.max("n").alias("n")), "dense")
        total = dense.count()
        last = k == ROUNDS or total <= 2 * n
        if total:
            some = dense if last else dense.groupBy("node").agg(F.max(F.struct("n", "key", "comp")).alias("x")).select("x.key", "node", "x.comp")
            links = links.unionByName(verified_links(some.select("key", "node", "comp"), sets, similarity, cap))
        roots = gathered(connected_components(links, gathered, FEW_LINKS), "roots")
        if last:
            break
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        now = dense.drop("n", "comp").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        discard(found)
        found = materialise(may_link(now, similarity), "candidates")
    return roots


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, cap: int = SETS_CAP, radius: int = 3) -> DataFrame:
    """The rows of docs less near-duplicates: of each group of alike texts the one with the least doc_id stays.

    Two texts are alike if their sets of different `words`-word shingles have a Jaccard similarity of
    at least `similarity`; groups are joined by all such pairs. Classes of SimHash fingerprints of
    the sets, linked within `radius` bits, give the first candidates, an exact prefix filter those
    between texts that these leave apart, so none is missed and none is taken without a comparison
    (shingles and equal sets are told by 64-bit hashes). Rows of a null id all stay; of rows that repeat an id, one stays.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    prints = materialise(prefixes(rows, words, similarity), "prefixes")
    nodes = gathered(prints.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    few = nodes.count() <= BROADCAST_IDS

    def sets_of(wanted: DataFrame) -> DataFrame:
        ids = nodes.join(wanted, "node").select(F.col("least").alias("doc_id")).distinct()
        texts = rows.join(F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
        return shingle_sets(texts, words).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))

    first = nodes.select("node", F.col("least").alias("doc_id"))
    sets = prints.join(F.broadcast(first) if few else first, ["node", "doc_id"], "left_semi")
    roots = similar_components(sets, sets_of, similarity, cap, radius).withColumnRenamed("node", "of")
    of = nodes.join(roots, nodes.node == roots.of, "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    to = gathered(of.join(of.groupBy("root").agg(F.min("least").alias("kept")), "root").select("node", "kept"), "kept")
    gone = gathered(prints.join(to, "node").where(F.col("doc_id") != F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    if prints.groupBy("doc_id").count().where("doc_id is not null and count > 1").head(1):
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id is null"))
    return out
