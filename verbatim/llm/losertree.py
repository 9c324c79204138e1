"""Merging of sorted runs of byte strings by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class Run:
    """A front-coded sorted run: each string is its common prefix with the one before and a tail."""

    __slots__ = ("at", "ends", "lcps", "now", "payload", "tails")

    def __init__(self, lcps: bytes, ends: Sequence[int], tails: bytes, payload):
        self.lcps, self.ends, self.tails, self.payload = lcps, ends, tails, payload
        self.at, self.now = -1, b""

    def next(self) -> int:
        """Steps on; the common prefix with the string before, or -1 at the end."""
        self.at += 1
        if self.at >= len(self.lcps):
            return -1
        known = self.lcps[self.at]
        begin = self.ends[self.at - 1] if self.at else 0
        self.now = self.now[:known] + self.tails[begin : self.ends[self.at]]
        return known


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, Run]]:
    """(common prefix with the string before, string, run) in order.

    Every waiting string knows its common prefix with the last winner. Of two, the one with the longer
    prefix comes first, unseen; only equally long ones are compared, from that prefix on, and the loser
    keeps what was found. So no byte of a known prefix is looked at again.
    """
    size = 1
    while size < len(runs):
        size *= 2
    players: list[Run | None] = [*runs, *[None] * (size - len(runs))]
    lcp = [0] * size
    for k, run in enumerate(runs):
        if run.next() < 0:
            players[k] = None
    tree = [0] * size  # losers; tree[0] is the winner

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = players[a], players[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        s, t, h = x.now, y.now, lcp[a]
        n = min(len(s), len(t))
        while h < n and s[h] == t[h]:
            h += 1
        if h == n:
            first = len(s) <= len(t)
        else:
            first = s[h] < t[h]
        if first:
            lcp[b] = h
            return a, b
        lcp[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, l = play(build(2 * node), build(2 * node + 1))
        tree[node] = l
        return w

    winner = build(1) if size > 1 else 0
    while (run := players[winner]) is not None:
        yield lcp[winner], run.now, run
        known = run.next()
        if known < 0:
            players[winner] = None
        lcp[winner] = known
        node = (winner + size) >> 1
        while node:
            winner, tree[node] = play(winner, tree[node])
            node >>= 1
