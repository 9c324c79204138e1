"""BK-trees over integers under Hamming distance."""

from __future__ import annotations


class BKTree:
    """Children are keyed by their integer distance to the parent."""

    __slots__ = ("items", "kids")

    def __init__(self):
        self.items: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, x: int) -> int:
        k = len(self.items)
        self.items.append(x)
        self.kids.append({})
        if k:
            at = 0
            while True:
                d = (self.items[at] ^ x).bit_count()
                if d not in self.kids[at]:
                    self.kids[at][d] = k
                    break
                at = self.kids[at][d]
        return k

    def near(self, x: int, radius: int) -> list[int]:
        """Places of all items within the radius; only edges from d - radius to d + radius are followed."""
        if not self.items:
            return []
        found, stack = [], [0]
        items, kids = self.items, self.kids
        while stack:
            at = stack.pop()
            d = (items[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in kids[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found


def forest_links(shard: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (place, place) that join all items of a shard that chains within the radius connect.

    Items go into the tree one by one and ask it first; a link is kept only if it joins two groups,
    so there are fewer links than items however dense the shard is.
    """
    tree, parent, out = BKTree(), list(range(len(shard))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, x in enumerate(shard):
        for j in tree.near(x, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
        tree.add(x)
    return out
