"""Hashes of words and word windows, as numpy arrays, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words kept with their hashes in one worker before the store is emptied.
KEPT_WORDS = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, a one-to-one scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WindowHasher:
    """Hashes of windows of ``size`` words; a shorter, nonempty text is one window by itself."""

    def __init__(self, size: int):
        self.size = size
        self.store: dict[bytes | str, int] = {}

    def words(self, words: list[bytes] | list[str]) -> np.ndarray:
        store = self.store
        if len(store) > KEPT_WORDS:
            store.clear()
        for word in words:
            if word not in store:
                store[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(store.__getitem__, words), np.uint64, len(words))

    def windows(self, words: list[bytes]) -> np.ndarray:
        return self.joined(self.words(words))

    def joined(self, words: np.ndarray) -> np.ndarray:
        """Window hashes from word hashes."""
        width = min(self.size, len(words))
        n = len(words) - width + 1 if width else 0
        found = np.full(n, width, np.uint64)
        for i in range(width):
            found = mix(found + np.uint64(0x9E3779B97F4A7C15)) + words[i : i + n]
        return mix(found)


def lowered_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` start and end, in bytes."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], (codes != 32) & ((codes < 9) | (codes > 13)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


class TextHasher:
    """Hashes of a text's words from prefix sums over its bytes, without a Python object per word.

    A word's hash is the sum of a number per byte times a power of ``BASE`` for its place in the word, scrambled.
    """

    #: Bytes hashed at once, up to the next end of a word.
    CHUNK = 1 << 20
    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.numbers = mix(np.arange(1, 257, dtype=np.uint64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            one, bases = np.ones(1, np.uint64), (self.BASE, pow(self.BASE, -1, 1 << 64))
            self.powers, self.inverses = [np.cumprod(np.concatenate([one, np.full(n - 1, base, np.uint64)])) for base in bases]

    def words(self, text: str | None) -> np.ndarray:
        """Hashes of the words between ASCII white space, with A-Z in lower case."""
        data, parts = (text or "").encode().lower(), [np.zeros(0, np.uint64)]
        starts, ends = word_places(data)
        codes = np.frombuffer(data, np.uint8)
        low = 0
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + self.CHUNK)))
            begin, end = int(starts[low]), int(ends[high - 1])
            self._reach(end - begin)
            sums = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(self.numbers[codes[begin:end]] * self.powers[: end - begin], out=sums[1:])
            first = starts[low:high] - begin
            parts.append(mix((sums[ends[low:high] - begin] - sums[first]) * self.inverses[first]))
            low = high
        return np.concatenate(parts)


class WordTable:
    """Words of several texts as arrays: hash, text, line (over all texts), first and last byte in the text."""

    def __init__(self, texts: list[str | None], hasher: WindowHasher):
        parts = [(text or "").encode().lower() for text in texts]
        data = b"\n".join(parts)
        begins = np.cumsum([0] + [len(p) + 1 for p in parts])
        starts, ends = word_places(data)
        self.hashes = hasher.words(data.split())
        self.text = np.searchsorted(begins, starts, side="right") - 1
        self.line = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), starts)
        self.at, self.upto = starts - begins[self.text], ends - begins[self.text]


def least_places(hashes: np.ndarray, reach: int) -> np.ndarray:
    """Place of the least hash (first of equal ones) among any ``reach`` neighbours."""
    low = np.uint64(28)
    least = (hashes >> low << low) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: width - reach], least[reach - width :])
    return (least & np.uint64((1 << 28) - 1)).astype(np.int64)
