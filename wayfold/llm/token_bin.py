"""Token ids in binary files: frequency-ranked, byte-aligned, with control bytes apart from data bytes."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import discard, materialise, new_path, small_batches
from .sums import summed
from .words import TEXTS, WordIds, tidy

#: A block is closed once it holds so many ids; one longer document is a block of its own.
BLOCK_IDS = 1_000_000
#: Bounds of ranges at most that become one expression.
MAX_EDGES = 2000
_ENDED = re.compile(r"([^\W\d_]+)([^\w\s]+)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level BPE: itself if it prints in Latin-1, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = _byte_letters()
_SPACE = _BYTES[32]


def byte_level(said: dict) -> bool:
    """Whether a tokenizer file is a plain byte-level BPE, whose texts may be cut as UnitEncoder does."""
    model, before = said["model"], said["pre_tokenizer"] or {}
    bare = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return model["type"] == "BPE" and bare and said["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)


class UnitEncoder(WordIds):
    """Ids of whole texts by a byte-level BPE of the tokenizers library, which sees each different unit once.

    Such a tokenizer's pieces never go past a space that follows other than white space, nor from
    a letter to a mark, so a text may be cut there and the ids of its units put one after another.
    The strings of added tokens in a text are those tokens, as the library has it, and cut it too. A
    file of another kind has its texts encoded whole.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.marks: dict[str, list[int]] = {}
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        strings = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.odd = f"{type(self).odd}|{strings}" if strings else type(self).odd
        self.around = re.compile(f"({strings})" if strings else r"(?!)()")
        self.by_words = byte_level(json.loads(self.tokenizer.to_str())) and not any(t.lstrip or t.rstrip or t.single_word for t in added.values())

    def encode(self, texts: pa.Array, few: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.by_words:
            yield from super().encode(texts, few)
            return
        for at in range(0, len(texts), few):
            lists = [x.ids for x in self.tokenizer.encode_batch_fast([t or "" for t in texts.slice(at, few).to_pylist()], add_special_tokens=False)]
            yield np.fromiter(chain.from_iterable(lists), dtype=np.uint32), np.array([len(x) for x in lists], dtype=np.int64)

    def cut(self, text: str) -> list:
        keys: list = []
        for k, part in enumerate(self.around.split(text)):
            if k % 2:
                keys.append((part, "added"))
            elif part:
                keys += super().cut(part)
        return keys

    def _word(self, text: str) -> list[int]:
        """The ids of one word of the model, spelt in byte letters."""
        return [x.id for x in self.model.tokenize(text)]

    def _marks(self, text: str) -> list[int]:
        if text not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[text] = self._word(text.encode().decode("latin-1").translate(_BYTES))
        return self.marks[text]

    def learn(self, keys: list) -> list[list[int]]:
        lists, other = [], []
        for i, k in enumerate(keys):
            found = [self.added[k[0]]] if type(k) is tuple and len(k) == 2 else None
            if type(k) is str:
                m = None if k.isalpha() else _ENDED.fullmatch(k)
                core = k if m is None else m[1]
                if core.isalpha():  # a space and letters are one word of the model, marks after it another
                    found = self._word(_SPACE + core if core.isascii() else f" {core}".encode().decode("latin-1").translate(_BYTES))
                    if m is not None:
                        found += self._marks(m[2])
            if found is None:
                other.append(i)
            lists.append(found)
        for at in range(0, len(other), 2048):  # the library's own results are large
            few = other[at : at + 2048]
            for i, x in zip(few, self.tokenizer.encode_batch_fast([k[0] if type(k := keys[i]) is tuple else f" {k}" for i in few], add_special_tokens=False), strict=True):
                lists[i] = x.ids
        return lists


@cache
def encoder_of(path: str) -> UnitEncoder:
    """This process's encoder."""
    return UnitEncoder(path)


BLOCK = "part int, block int, before long, doc_ids array<{id}>, n_tokens array<long>, n_ids long, {body}"


def _token_blocks(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """Blocks of documents in ascending order with their ids as little-endian numbers of `width` bytes, and how many ids of the part lie before; each task's last row has how often each id occurs in the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, block, before = encoder_of(tokenizer), TaskContext.get().partitionId(), 0, 0
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        kept: list = []
        counts = np.zeros(0, dtype=np.int64)
        id_type = None

        def batch(counted: bytes | None) -> pa.RecordBatch:
            ids = np.concatenate([x[2] for x in kept]) if kept else np.zeros(0, dtype=np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([[i for x in kept for i in x[0]]], pa.list_(id_type)), pa.array([[n for x in kept for n in x[1].tolist()]], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([width], pa.int32()), pa.array([ids.astype(f"<u{width}").tobytes()], pa.binary()), pa.array([counted], pa.binary())],
                names=["part", "block", "before", "doc_ids", "n_tokens", "n_ids", "width", "ids", "counts"],
            )

        held = 0
        for b in batches:
            id_type = b.column("doc_id").type
            at = 0
            for ids, n in chain.from_iterable(encoder.encode(b.column("text").slice(k, TEXTS)) for k in range(0, b.num_rows, TEXTS)):
                ended = np.insert(ids, np.cumsum(n), end_id)
                own = np.bincount(ended)
                if len(own) > len(counts):
                    own, counts = counts, own.astype(np.int64)
                counts[: len(own)] += own
                kept.append((b.column("doc_id").slice(at, len(n)).to_pylist(), n + 1, ended))
                at += len(n)
                held += len(ended)
                if held >= BLOCK_IDS:
                    yield batch(None)
                    kept, held, block, before = [], 0, block + 1, before + held
        if len(counts):
            yield batch(counts.tobytes())
        kept = []
        tidy()

    return docs.mapInArrow(run, BLOCK.format(id=kind, body="width int, ids binary, counts binary"))


def id_counts(blocks: DataFrame) -> np.ndarray:
    """How often each id occurs in all blocks."""

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (np.frombuffer(x.as_py(), dtype=np.int64) for b in batches for x in b.column("counts"))

    return summed(blocks.select("counts").where("counts is not null"), counts)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes, with the length less one of four numbers in each, lowest bits first; and the numbers' own bytes, lowest first."""
    width = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = width - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.cumsum(width, dtype=np.int64) - width
    out = np.empty(int(width.sum(dtype=np.int64)), dtype=np.uint8)
    out[at] = ranks.astype(np.uint8)
    for k in range(1, 4):
        wide = np.flatnonzero(width > k)
        if not wide.size:
            break
        out[at[wide] + k] = ranks[wide] >> np.uint32(8 * k) & np.uint32(255)
    return control.tobytes(), out.tobytes()


#: For each control byte, the four lengths that it holds.
WIDTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], dtype=np.uint8)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers that pack() was given, by table lookup."""
    width = WIDTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    at = np.cumsum(width, dtype=np.int64) - width
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        wide = np.flatnonzero(width > k)
        if not wide.size:
            break
        out[wide] |= raw[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _in_ranges(docs: DataFrame) -> DataFrame:
    """Dealt out so that partitions hold ascending ranges of doc_id. For numbers the bounds come from a scan of that column alone."""
    if docs.schema["doc_id"].dataType.typeName() not in ("integer", "long", "short", "byte"):
        return docs.repartitionByRange("doc_id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    edges = sorted(set(bounds or ()))
    if len(edges) > MAX_EDGES:
        return docs.repartitionByRange("doc_id")

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") <= edges[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    return docs.repartitionById(len(edges) + 1, F.when(F.col("doc_id").isNull(), 0).otherwise(place(0, len(edges))))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, each followed by end_id, in ascending order of id_col.

    `path`/blocks: Parquet as the container, so that Spark's committer makes it whole on any store;
    a row is a block with its place (part, block), doc_ids, the number of ids of each, and the two
    byte strings of pack(). `path`/ranks: one row with the ids by falling frequency in all documents
    (equal ones by id). Null texts are empty; null ids come first; repeated ids lie together, by text.
    """
    spark = docs.sparkSession
    small_batches(spark, 4096)
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    ordered = _in_ranges(wanted).sortWithinPartitions("doc_id", "text")
    blocks = materialise(_token_blocks(ordered, tokenizer, end_id, kind), "tokens")
    del ordered
    counts = id_counts(blocks)
    by_rank = np.lexsort((np.arange(len(counts)), -counts)).astype(np.uint32)
    by_rank = by_rank[counts[by_rank] > 0]
    rank = np.zeros(len(counts), dtype=np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                control, data = pack(sent.value[np.frombuffer(b.column("ids")[i].as_py(), dtype=f"<u{b.column('width')[i].as_py()}")])
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns[:6], pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=[*row.schema.names[:6], "control", "data"])

    blocks.drop("counts").mapInArrow(run, BLOCK.format(id=kind, body="control binary, data binary")).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(by_rank.astype("<u4").tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    discard(blocks)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files of write_tokens(); start counts the ids of all documents before."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # a row a part, of which a session's shuffle partitions make a bounded number; within a part its task counted
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("start"))
    placed = blocks.join(F.broadcast(starts), F.col("part") == F.col("of")).withColumn("first", F.col("start") + F.col("before"))
    ranks = spark.read.parquet(f"{path}/ranks").first()
    sent = spark.sparkContext.broadcast(np.frombuffer(bytes(ranks.ids), dtype="<u4"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = b.column("n_ids")[i].as_py()
                ids = sent.value[unpack(b.column("control")[i].as_py(), b.column("data")[i].as_py(), n)]
                size = np.array(b.column("n_tokens")[i].as_py(), dtype=np.int64)
                ends = np.cumsum(size)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((ends - size).tolist(), ends.tolist(), strict=True)]
                columns = [b.column("doc_ids")[i].values, pa.array(b.column("first")[i].as_py() + ends - size), pa.array(size), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    body = placed.select("doc_ids", "n_tokens", "n_ids", "control", "data", "first")
    return body.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes docs to new files in the shared folder and returns what is read back from them."""
    path = new_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path)
