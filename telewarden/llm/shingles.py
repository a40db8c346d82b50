"""Hashed word shingles of texts, and weighted similarity of their bags."""

from __future__ import annotations

import re

import numpy as np
from xxhash import xxh3_64_intdigest

#: Words of a shingle.
SHINGLE_WORDS = 5
#: Bytes of the words that a worker remembers, and of an entry besides its characters.
REMEMBERED, ENTRY_BYTES = 192 << 20, 150
_WORDS = re.compile(r"\w+")
_STEP, _FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    held = 0

    def __missing__(self, word: str) -> int:
        self.held += ENTRY_BYTES + 2 * len(word)
        value = self[word] = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Hashes()


def words_of(text: str) -> list[str]:
    """Words in lower case; of a text without letters and digits, what white space separates."""
    return _WORDS.findall(text.lower()) or text.split()


def shingles(text: str, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as ascending hashes, with their counts. A text of fewer words is a single shingle; one without words has none."""
    if _hashes.held > REMEMBERED:
        _hashes.clear()
        _hashes.held = 0
    found = words_of(text)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    each = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(each))
    rolled = np.zeros(len(each) - size + 1, np.uint64)
    for k in range(size):
        rolled = rolled * _STEP + each[k : len(each) - size + 1 + k]
    rolled ^= rolled >> np.uint64(32)
    rolled *= _FINISH
    rolled ^= rolled >> np.uint64(32)
    rolled.sort()
    first = np.flatnonzero(np.concatenate([[True], rolled[1:] != rolled[:-1]]))
    return rolled[first], np.diff(np.concatenate([first, [len(rolled)]]))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger weights of two bags, each ascending hashes with weights; 0 if both are empty."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    shared = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = float(np.minimum(a[1][at[shared]], b[1][shared]).sum())
    total = float(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0
