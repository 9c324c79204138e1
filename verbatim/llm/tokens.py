"""Encoding of whole texts with a public tokenizer file, each distinct unit of text once a batch or more seldom."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache
from struct import pack

import numpy as np
import public_tokenizers

#: Units whose ids a worker keeps; when there are more it starts anew, so its memory is bounded.
CACHE_UNITS = 1_200_000
#: Marks that may stand behind a word: the pre-tokenizers cut between a letter and these.
MARKS = ",.;:!?"
#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order.
BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


class UnitEncoder(dict):
    """tokenizers' ids of whole texts, from the ids of their units: unit -> ids as little-endian 32-bit bytes.

    A unit is what stands between two single spaces or line ends. Both tokenizer kinds cut every text
    there before they merge: the byte-level one puts the space at the head of the next piece and makes
    a piece of the line end, the word one drops both. A text with more white space beside such a place
    is encoded as a whole by the byte-level one. In the table a leading space marks the head of a text
    and a leading line end a unit after one. A text that holds a special token's string is encoded as a
    whole: the library gives the token's own id for it.
    """

    def __init__(self, file: str, most: int = CACHE_UNITS, literal: bool = False):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.tokenizer.encode_special_tokens = literal
        self.special = () if literal else tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model.tokenize
        self.spaces = file.startswith("byte_")
        self.lead = "\u0120" if self.spaces else ""
        self.most, self.odd = most, False
        self.tails: dict[str, list[int]] = {}

    def __missing__(self, unit: str) -> bytes:
        core = unit.rstrip(MARKS)
        if core.isalpha():  # a word and marks, by far the most
            if len(core) < len(unit):
                self[unit] = out = self[core] + self._tail_bytes(unit[len(core) :])
                return out
            piece = core if core.isascii() and self.spaces else self._piece(core)
            if piece is not None:
                self[unit] = out = array("I", [t.id for t in self.model(self.lead + piece)]).tobytes()
                return out
        if self.spaces:
            bare = unit[1:] if unit[:1] in (" ", "\n") else unit
            if not bare or bare[0].isspace() or bare[-1].isspace():
                self.odd = True  # the text must be encoded as a whole
                return b""
        self[unit] = out = array("I", self._unit(unit)).tobytes()
        return out

    def _tail_bytes(self, text: str) -> bytes:
        return array("I", self._tail(text)).tobytes()

    def _piece(self, core: str) -> str | None:
        """A run of letters as the library's pre-tokenizer would hand it to the model; None where that takes more than a byte table."""
        if core.isascii():
            return core if self.spaces else core.lower()
        if not self.spaces:
            try:
                core.encode("latin-1")  # below the first composed letters: NFC changes nothing
            except UnicodeEncodeError:
                return None
            core = core.lower()
        return core.encode().decode("latin-1").translate(BYTE_CHARS)

    def _unit(self, unit: str) -> list[int]:
        """Ids of a marked or uncommon unit: the library's model on letters and its whole pipeline on all else."""
        head = unit[:1] if self.spaces and unit[:1] in (" ", "\n") else ""
        body = unit[len(head) :]
        core = body.rstrip(MARKS)
        piece = self._piece(core) if core.isalpha() else None
        if piece is None:
            return self._whole(body if head == " " else f"\n{body}" if head else f" {body}" if self.spaces else body)
        if not head:
            piece = self.lead + piece
        ids = [t.id for t in self.model(piece)]
        if head == "\n":
            ids = self._tail("\n") + ids
        return ids + self._tail(body[len(core) :]) if len(core) < len(body) else ids

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _tail(self, text: str) -> list[int]:
        """Ids of line ends and of marks behind a word, of which there are few."""
        if text not in self.tails:
            if len(self.tails) > 1000:
                self.tails.clear()
            self.tails[text] = self._whole(text)
        return self.tails[text]

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """Each text's ids with `end_id` behind them, as little-endian 32-bit bytes."""
        get, end, out = self.__getitem__, pack("<I", end_id), []
        for text in texts:
            if not text:
                out.append(end)
                continue
            if any(x in text for x in self.special):
                out.append(np.array([*self._whole(text), end_id], "<u4").tobytes())
                continue
            if self.spaces:
                units = text.replace("\n", " \n").split(" ")
                units[0] = f" {units[0]}"
            else:
                units = text.replace("\n", " ").split(" ")
            self.odd = False
            units.append(None)
            self[None] = end
            ids = b"".join(map(get, units))
            if self.odd:
                ids = np.array([*self._whole(text), end_id], "<u4").tobytes()
            out.append(ids)
            if len(self) > self.most:
                self.clear()
        return out


@lru_cache(maxsize=2)
def encoder(file: str, literal: bool = False) -> UnitEncoder:
    """One for each file and worker process."""
    return UnitEncoder(file, literal=literal)


def drop_encoders() -> None:
    """For steps that encode nothing: a worker that is used again gives back the units its encoders keep."""
    encoder.cache_clear()
