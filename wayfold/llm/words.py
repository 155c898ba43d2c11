"""Ids of whole texts from the ids of their words, each of which a worker process works out once."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker process remembers the ids of, over all its tasks; then it keeps the more frequent half.
REMEMBERED = 700_000
#: Texts whose words are told apart at once.
TEXTS = 4096
#: A space before more white space (of any kind) or the end: such texts are cut with _BREAK.
_ODD_SPACE = r" (?:[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
_BREAK = re.compile(r"(?<=\S)(?= )")


def tidy() -> None:
    """Gives memory that this worker process no longer uses back to the machine; the process outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class WordIds:
    """Ids of texts whose ids are those of their words, cut before each space, one after another.

    A word is known by its text without the space before it; a text's first, which has none, is a
    tuple. learn() gives the ids of words not met before; share is of REMEMBERED.
    """

    odd, kind, share = _ODD_SPACE, np.uint32, 1.0

    def __init__(self) -> None:
        self.number: dict = {}
        self.ids = np.zeros(1 << 16, dtype=self.kind)
        self.used = 0
        self.at, self.length, self.hits = (np.zeros(1 << 16, dtype=np.int64) for _ in range(3))

    def learn(self, keys: list) -> list[list[int]]:
        raise NotImplementedError

    def head(self, word: str) -> str | tuple[str]:
        """The key of a text's first word."""
        return (word,)

    def cut(self, text: str) -> list:
        """The keys of a text that `odd` matches."""
        head, *rest = _BREAK.split(text)
        return [(head,), *(x[1:] for x in rest)]

    def _gather(self, n: np.ndarray) -> np.ndarray:
        """The ids of units n, one after another."""
        size = self.length[n]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.at[n] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def _add(self, keys: list, flat: np.ndarray, size: np.ndarray) -> None:
        n, m = len(self.number), len(keys)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.at):
            self.at, self.length, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length, self.hits))
        self.ids[self.used : self.used + len(flat)] = flat
        self.length[n : n + m] = size
        self.at[n : n + m] = self.used + np.cumsum(size) - size
        self.hits[n : n + m] = 0
        self.used += len(flat)
        self.number.update(zip(keys, range(n, n + m), strict=True))

    def _forget(self) -> None:
        """Keeps the half that was met most."""
        keys = list(self.number)
        kept = np.sort(np.argsort(-self.hits[: len(keys)], kind="stable")[: int(REMEMBERED * self.share) // 2])
        flat, size, hits = self._gather(kept), self.length[kept], self.hits[kept]
        self.number, self.used = {}, 0
        self._add([keys[i] for i in kept.tolist()], flat, size)
        self.hits[: len(kept)] = hits

    def _numbers(self, keys: list) -> np.ndarray:
        n = np.fromiter(map(self.number.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        if (missing := np.flatnonzero(n < 0)).size:
            new = [keys[i] for i in missing.tolist()]
            keys_new = list(dict.fromkeys(new))
            lists = self.learn(keys_new)
            self._add(keys_new, np.fromiter(chain.from_iterable(lists), dtype=self.kind), np.array([len(x) for x in lists], dtype=np.int64))
            n[missing] = np.fromiter(map(self.number.__getitem__, new), dtype=np.int64, count=len(new))
        return n

    def encode(self, texts: pa.Array, few: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each `few` texts: all ids one after another, and the number of ids of each; null texts are empty."""
        n, count = self._units(texts)
        reach = np.concatenate([[0], np.cumsum(count)])
        for at in range(0, len(texts), few):
            own = reach[at : at + few + 1]
            mine = n[own[0] : own[-1]]
            ends = np.concatenate([[0], np.cumsum(self.length[mine])])
            yield self._gather(mine), np.diff(ends[own - own[0]])

    def _units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units, and how many each text has."""
        if len(self.number) > REMEMBERED * self.share:
            self._forget()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = [(i, self.cut(texts[i].as_py())) for i in np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)).tolist()]
        if odd:
            texts = pc.if_else(pa.array(np.isin(np.arange(len(texts)), [i for i, _ in odd])), pa.scalar("", pa.large_string()), texts)
        cut = pc.split_pattern(texts, " ")
        units = cut.values.dictionary_encode()
        n = self._numbers(units.dictionary.to_pylist())[units.indices.to_numpy()]
        first = cut.offsets.to_numpy()[:-1]
        n[first] = self._numbers([self.head(x) for x in pc.take(cut.values, pa.array(first)).to_pylist()])
        count = np.diff(cut.offsets.to_numpy())
        if odd:
            pieces = np.split(n, cut.offsets.to_numpy()[1:-1])
            for i, keys in odd:
                pieces[i] = self._numbers(keys)
            n, count = np.concatenate(pieces), np.array([len(x) for x in pieces])
        self.hits[: len(self.number)] += np.bincount(n, minlength=len(self.number))
        return n, count
