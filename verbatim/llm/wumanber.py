"""Wu-Manber search for many word sequences of one length."""

from __future__ import annotations

from collections.abc import Sequence


class WuManber:
    """Patterns are tuples of words, all of `length`.

    The shift table says how far the window may move after its last block of words; a block that no
    pattern holds moves it past the block. At shift 0 the block's bucket gives the patterns that end
    with it, and those are compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = self._key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets.setdefault(self._key(pattern, length), []).append((pattern, owners))

    def _key(self, words: Sequence[bytes], end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def search(self, words: list[bytes]) -> list[tuple[int, list[int]]]:
        """(first word, owners) of every occurrence, overlapping ones too."""
        found, n, far = [], len(words), self.far
        shift, buckets, m = self.shift.get, self.buckets, self.length
        end = m
        if self.block == 1:
            for k, w in enumerate(words):
                if w in buckets:
                    found.append((k, buckets[w][0][1]))
            return found
        while end <= n:
            key = (words[end - 2], words[end - 1])
            step = shift(key, far)
            if step:
                end += step
                continue
            window = tuple(words[end - m : end])
            for pattern, owners in buckets[key]:
                if pattern == window:
                    found.append((end - m, owners))
            end += 1
        return found
