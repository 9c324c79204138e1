"""English tokens: punctuation and clitics apart, abbreviations and SGML tags whole."""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Marks peeled off a word's front and end, and the clitics.
OPENING = "[¿¡{'`\"‚„†‡‹‘’“”•–—›»«"
CLOSING = "]}'`\",;:!?؟%‚„…†‡‰‹‘’“”•–—›»«"
CLITIC = re.compile(r"(?:n['’´]t|['’´](?:s|re|ve|d|m|em|ll))\Z", re.IGNORECASE | re.ASCII)

_TAG = re.compile(r"<[^<>]*>")
_LETTERS = re.compile(r"(?:[A-Za-z-]\.)+\Z")


def chunks(text: str) -> list[tuple[bool, str]]:
    """(is a tag, text) in order; a "<" without its ">" is text."""
    out, at = [], 0
    for m in _TAG.finditer(text):
        if m.start() > at:
            out.append((False, text[at : m.start()]))
        out.append((True, m[0]))
        at = m.end()
    if at < len(text):
        out.append((False, text[at:]))
    return out


def pad(text: str) -> str:
    return re.sub(r"([;!?])(?=\S)", r"\1 ", text.replace("...", " ... "))


class EnglishTokenizer:
    """Remembers how words are cut; of more than `most` it starts anew, so its memory is bounded."""

    def __init__(self, abbreviations: Iterable[str] = (), most: int = 200_000):
        self.abbreviations, self.most = frozenset(abbreviations), most
        self.known: dict[str, list[str]] = {}

    def tokenize(self, text: str) -> list[str]:
        out: list[str] = []
        for is_tag, part in chunks(text):
            if is_tag:
                out.append(part)
            else:
                for word in pad(part).split():
                    cut = self.known.get(word)
                    if cut is None:
                        if len(self.known) >= self.most:
                            self.known.clear()
                        cut = self.known[word] = self.split_word(word)
                    out += cut
        return out

    def split_word(self, word: str) -> list[str]:
        """Marks off both ends one at a time, then abbreviations, the full stop, dashes and clitics."""
        front: list[str] = []
        back: list[str] = []  # innermost last
        while True:
            step = self._peel(word)
            if step is None:
                break
            before, word, behind = step
            front += before
            back += behind
        tail = back[::-1]
        if word in self.abbreviations or _LETTERS.match(word):
            return [*front, word, *tail]
        if len(word) >= 2 and word[-1] == "." and word != "...":
            word, tail = word[:-1], [".", *tail]
            if word in self.abbreviations:
                return [*front, word, *tail]
        while len(word) > 2 and word.startswith("--"):
            front, word = [*front, "--"], word[2:]
        while len(word) > 2 and word.endswith("--"):
            word, tail = word[:-2], ["--", *tail]
        while m := CLITIC.search(word):
            if m.start() == 0 and word[0] in "'’´":
                break  # an apostrophe form needs a word before it
            word, tail = word[: m.start()], [m[0], *tail]
        return [*front, *([word] if word else []), *tail]

    @staticmethod
    def _peel(word: str) -> tuple[list[str], str, list[str]] | None:
        if len(word) < 2:
            return None
        if word[0] == "(" and ")" not in word[1:-1]:
            return ["("], word[1:], []
        if word[-1] == ")" and "(" not in word[:-1]:
            return [], word[:-1], [")"]
        if word[0] in OPENING:
            return [word[0]], word[1:], []
        if word[-1] in CLOSING:
            return [], word[:-1], [word[-1]]
        if word[-1] == "." and (word[-2] in CLOSING or word[-2] == ")"):
            return [], word[:-1], ["."]
        return None


def align(tokens: Iterable[str], text: str) -> list[tuple[int, int]]:
    """UTF-8 byte spans by a forward search from the last one; a token that isn't found gets an empty span."""
    spans, at, byte = [], 0, 0
    plain = text.isascii()  # then bytes are characters
    for token in tokens:
        found = text.find(token, at)
        if found < 0 or not token:
            spans.append((byte, byte))
            continue
        start = found if plain else byte + len(text[at:found].encode())
        at = found + len(token)
        byte = at if plain else start + len(token.encode())
        spans.append((start, byte))
    return spans
