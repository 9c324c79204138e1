"""Simple-8b: 64-bit words of a 4-bit selector and 60 bits that hold as many ids as fit, with escapes for wider ones.

An image holds the ids of whole documents:

    magic 8 bytes, then six unsigned 64-bit counts: documents, ids, blocks, words, escapes, block length
    documents x (long doc_id, unsigned 32-bit null flag, unsigned 32-bit number of ids)
    (blocks + 1) x unsigned 32-bit word offset
    escapes x unsigned 32-bit index of the escape's word
    words x unsigned 64-bit word

A word never spans two blocks, so each block can be decoded alone. Selector 0 is the escape: the next
word is the id itself. All numbers are little-endian.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"VBS8B\x01\x00\x00"
BLOCK = 4096
#: Fixed values of the coding: number of ids and bits of each by selector; 0 is taken for escapes here.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
DOC = np.dtype([("doc_id", "<i8"), ("null", "<u4"), ("n", "<u4")])


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    if len(ids) and ids.max() < 1 << 17:
        return _SHORT[ids]
    return _long_bit_lengths(ids)


def _long_bit_lengths(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.uint8)
    rest = ids.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << step)
        out += big.astype(np.uint8) * np.uint8(step)
        rest = np.where(big, rest >> np.uint64(step), rest)
    return out + (rest > 0)


_SHORT = _long_bit_lengths(np.arange(1 << 17))


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offsets of the blocks (one more than blocks) and the words that are escapes."""
    n, pad = len(ids), int(COUNTS.max())
    blocks, row = -(-n // block), block + pad
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint32)
    values = np.zeros((blocks, row), np.uint64)  # a block a row, zeros behind it
    full = n // block
    values[:full, :block] = ids[: full * block].reshape(full, block)
    if full < blocks:
        values[full, : n - full * block] = ids[full * block :]
    width = np.zeros((blocks, row), np.uint8)
    width[:full, :block] = (bits := _bit_lengths(ids))[: full * block].reshape(full, block)
    if full < blocks:
        width[full, : n - full * block] = bits[full * block :]
    most, reach = {1: width}, 1  # largest width among so many ids from each place, by doubling
    while reach * 2 <= pad and most[reach][: max(1, full), :block].min() * reach < 60:  # else no longer run fits
        a = most[reach].copy()
        np.maximum(a[:, :-reach], most[reach][:, reach:], out=a[:, :-reach])
        most[reach := reach * 2] = a
    selector = np.zeros((blocks, row), np.uint8)
    head = selector[:, :block]
    for s in range(15, 0, -1):  # ever more ids in a word; the last that fits wins
        count = int(COUNTS[s])
        p = 1 << (count.bit_length() - 1)
        if p not in most:
            break
        wide = most[p][:, :block]
        if count > p:
            wide = np.maximum(wide, most[p][:, count - p : count - p + block])
        np.copyto(head, np.uint8(s), where=wide <= WIDTHS[s])
    step = COUNTS.astype(np.uint8)[selector]
    reach = min(pad, block)
    edge = step[:, block - reach : block]
    np.minimum(edge, np.arange(reach, 0, -1, dtype=np.uint8), out=edge)  # a word ends with its block
    jump, starts, counts = step.tobytes(), [], []
    put = starts.append
    for k in range(blocks):
        at, end = k * row, k * row + min(block, n - k * block)
        counts.append(len(starts))
        while at < end:
            put(at)
            at += jump[at]
    start = np.array(starts)
    chosen = selector.ravel()[start]
    length = 1 + (chosen == 0)
    place = np.cumsum(length) - length
    total = int(place[-1] + length[-1])
    words = np.zeros(total, np.uint64)
    flat = values.ravel()
    for s in range(1, 16):
        own = np.flatnonzero(chosen == s)
        if not own.size:
            continue
        word = np.full(own.size, s << 60, np.uint64)
        if WIDTHS[s]:
            at = start[own]
            for k in range(int(COUNTS[s])):
                word |= flat[at + k] << np.uint64(k * int(WIDTHS[s]))
        words[place[own]] = word
    escape = np.flatnonzero(chosen == 0)
    words[place[escape] + 1] = flat[start[escape]]
    return words, np.append(place[np.array(counts)], total).astype(np.uint32), place[escape].astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids again; all words of one selector are decoded at once."""
    if not n:
        return np.zeros(0, np.uint64)
    pad = int(COUNTS.max())
    blocks, row = len(offsets) - 1, block + pad
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    raw = escapes.astype(np.int64) + 1
    counts = COUNTS[chosen]
    counts[raw] = 0
    chosen[raw] = 1  # passed over below
    chosen[raw - 1] = 1
    before = np.cumsum(counts) - counts
    first = offsets[:-1].astype(np.int64)
    at = before + np.repeat(np.arange(blocks) * row - before[first], np.diff(offsets.astype(np.int64)))
    wide = WIDTHS[chosen].max(initial=0) > 30
    out = np.zeros(blocks * row, np.uint64 if wide or len(raw) else np.uint32)
    for s in range(2, 16):  # selector 1 holds zeros only
        own = np.flatnonzero(chosen == s)
        if not own.size:
            continue
        width, mask = int(WIDTHS[s]), np.uint64((1 << int(WIDTHS[s])) - 1)
        where, word = at[own], words[own]
        for k in range(int(COUNTS[s])):  # what lies behind a block's end falls into its padding
            out[where + k] = (word & mask).astype(out.dtype)
            word >>= np.uint64(width)
    out[at[raw - 1]] = words[raw]
    return out.reshape(blocks, row)[:, :block].ravel()[:n]


def write_image(docs: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, offsets, escapes = pack(ids, block)
    head = np.array([len(docs), len(ids), len(offsets) - 1, len(words), len(escapes), block], "<u8")
    return b"".join([MAGIC, head.tobytes(), docs.astype(DOC).tobytes(), offsets.astype("<u4").tobytes(), escapes.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def _parts(image: bytes):
    if image[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token image")
    at = len(MAGIC)
    n_docs, n, blocks, n_words, n_escapes, block = (int(x) for x in np.frombuffer(image, "<u8", 6, at))
    at += 48
    out = []
    for kind, count in ((DOC, n_docs), (np.dtype("<u4"), blocks + 1), (np.dtype("<u4"), n_escapes), (np.dtype("<u8"), n_words)):
        out.append(np.frombuffer(image, kind, count, at))
        at += kind.itemsize * count
    return n, block, *out


def read_image(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The documents' table and all ids."""
    n, block, docs, offsets, escapes, words = _parts(image)
    return docs, unpack(words, offsets, escapes, n, block)


def read_block(image: bytes, k: int) -> np.ndarray:
    """The ids of block k alone, by its offset."""
    n, block, _, offsets, escapes, words = _parts(image)
    a, b = int(offsets[k]), int(offsets[k + 1])
    own = escapes[(escapes >= a) & (escapes < b)] - a
    return unpack(words[a:b], np.array([0, b - a], np.uint32), own, min(block, n - k * block), block)
