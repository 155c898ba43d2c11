import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wayfold.llm import token_bin, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "word", "word.", "word,!", "dogs'", "a².", "é\u0301?", "Über", "don't", "'s", "123", "...", " ", "\x1c", "é", "漢字", "<|endoftext|>", " ", "a b", "\0"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["", " ", "x " * 50000]


def test_units_give_the_library_s_ids(monkeypatch):
    ts = texts()
    for remembered in (800_000, 20):
        monkeypatch.setattr(words, "REMEMBERED", remembered)
        encoder = token_bin.UnitEncoder(PATH)
        for part in (ts[:700], ts[700:], ts[:100]):
            got = list(encoder.encode(pa.array(part), few=100))
            ids, n = (np.concatenate(x) for x in zip(*got, strict=True))
            ends = np.cumsum(n)
            for t, a, z, e in zip(part, ends - n, ends, reference().encode_batch(part, add_special_tokens=False), strict=True):
                assert ids[a:z].tolist() == e.ids, repr(t)


def test_files_of_another_kind_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_bin.UnitEncoder(path)
    assert not encoder.by_words
    ids, n = next(encoder.encode(pa.array(["Some words<|endoftext|> here", None, ""])))
    assert ids.tolist() == Tokenizer.from_file(path).encode("Some words<|endoftext|> here", add_special_tokens=False).ids and n.tolist() == [len(ids), 0, 0]


def test_pack_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 1 << 32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        assert np.array_equal(token_bin.unpack(*token_bin.pack(x), n), x)


@pytest.mark.parametrize("block", [1_000_000, 50])
def test_files(spark, monkeypatch, block):
    monkeypatch.setattr(token_bin, "BLOCK_IDS", block)
    rows = [(i, t) for i, t in enumerate(texts()[::10])] + [(10**6, None), (5, "again"), (-3, "first")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, ids string").repartition(3)
    got = [tuple(r) for r in token_bin.token_files(df, PATH).orderBy("start").collect()]
    want, at = [], 0
    for d, t in sorted(rows, key=lambda x: (x[0], x[1] or "")):
        ids = [*reference().encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_bin.token_files(df.limit(0), PATH).count() == 0
