"""Part-of-speech tagging: a lexicon, rules for unknown words, a tag tree and a Viterbi decoder."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log

import numpy as np

SENT = "SENT"
NUMERIC = re.compile(r"[0-9,.\-/]+\Z")
ORDINAL = re.compile(r"[0-9]+(?:th|rd|st|nd)\Z", re.IGNORECASE)
ROMAN = re.compile(r"[IVXLCDM]+\Z")


@dataclass
class Node:
    """An inner node asks whether the context's `ctx`-th tag is `tag`; a leaf has a weight and probabilities."""

    ctx: int = 0
    tag: int = 0
    yes: int = -1
    no: int = -1
    weight: float = 0.0
    probs: np.ndarray | None = None


class Forest:
    """Binary trees over (tag at t-2, tag at t-1), kept as tables."""

    def __init__(self, trees: list[list[Node]], mix: float = 0.80):
        self.trees, self.mix = trees, mix
        self.known: dict[tuple[int, ...], np.ndarray] = {}
        self.logs: dict[tuple[int, ...], list[float | None]] = {}
        self.moves: dict[bytes, Moves] = {}
        self.mean: np.ndarray | None = None

    @staticmethod
    def from_preorder(records: list[tuple], start: int = 0) -> list[Node]:
        """Nodes from preorder records ("inner", ctx, tag) and ("leaf", weight, probs)."""
        nodes: list[Node] = []
        at = start

        def build() -> int:
            nonlocal at
            record, k = records[at], len(nodes)
            at += 1
            if record[0] == "leaf":
                nodes.append(Node(weight=record[1], probs=np.asarray(record[2], float)))
            else:
                nodes.append(Node(record[1], record[2]))
                nodes[k].yes = build()
                nodes[k].no = build()
            return k

        build()
        return nodes

    @staticmethod
    def leaf(tree: list[Node], context: tuple[int, ...]) -> Node:
        k = 0
        while tree[k].probs is None:
            node = tree[k]
            hit = node.ctx < len(context) and context[node.ctx] == node.tag
            k = node.yes if hit else node.no
        return tree[k]

    def predict(self, context: tuple[int, ...]) -> np.ndarray:
        """Fewer than three trees: the product of their leaves; else the third mixed with the first two's weighted mean."""
        if context not in self.known:
            leaves = [self.leaf(t, context) for t in self.trees]
            if len(leaves) < 3:
                p = np.prod([x.probs for x in leaves], axis=0)
                total = p.sum()
                p = p / total if total > 0 else p
            else:
                a, b, c = leaves[:3]
                weight = a.weight + b.weight
                mean = (a.weight * a.probs + b.weight * b.probs) / weight if weight > 0 else (a.probs + b.probs) / 2
                p = self.mix * c.probs + (1 - self.mix) * mean
            self.known[context] = p
        return self.known[context]

    def interpolated(self, context: tuple[int, ...], weight: float) -> np.ndarray:
        """A leaf of the first tree with the tree's mean, by a fixed weight."""
        return weight * self.leaf(self.trees[0], context).probs + (1 - weight) * self.marginal()

    def smoothed(self, context: tuple[int, ...], scheme: str = "lidstone", amount: float = 1.0) -> np.ndarray:
        """By the leaf's own weight: Lidstone or Witten-Bell against the mean."""
        leaf, mean = self.leaf(self.trees[0], context), self.marginal()
        if scheme == "lidstone":
            share = leaf.weight / (leaf.weight + amount * len(mean)) if leaf.weight + amount > 0 else 0.0
        elif scheme == "witten-bell":
            kinds = int((leaf.probs > 0).sum())
            share = leaf.weight / (leaf.weight + kinds) if leaf.weight + kinds > 0 else 0.0
        else:
            raise ValueError(f"unknown scheme {scheme!r}")
        return share * leaf.probs + (1 - share) * mean

    def marginal(self) -> np.ndarray:
        """P(tag): the leaves' mean by weight, computed once."""
        if self.mean is None:
            leaves = [n for t in self.trees for n in t if n.probs is not None]
            self.mean = normalize(sum(n.weight * n.probs for n in leaves))
        return self.mean


def normalize(x) -> np.ndarray:
    x = np.asarray(x, float)
    total = x.sum()
    return x / total if total > 0 else x


@dataclass
class AffixTrie:
    """Distributions by affix; an inner affix has the sum of those below it, renormalised."""

    leaves: dict[str, dict[int, float]]
    table: dict[str, list[tuple[int, float]]] = field(init=False)

    def __post_init__(self):
        sums: dict[str, dict[int, float]] = {}
        for affix, dist in self.leaves.items():
            for n in range(len(affix) + 1):
                into = sums.setdefault(affix[:n], {})
                for tag, p in dist.items():
                    into[tag] = into.get(tag, 0.0) + p
        self.table = {}
        for affix, dist in sums.items():
            own = self.leaves.get(affix, dist)
            total = sum(own.values()) if affix not in self.leaves else 1.0
            self.table[affix] = sorted(((t, p / total if total else p) for t, p in own.items()), key=lambda x: -x[1])

    def lookup(self, chars: str) -> list[tuple[int, float]] | None:
        """The deepest affix reached, at least the root's; None only for no letters at all."""
        if not chars or not self.table:
            return None
        n = 0
        while n < len(chars) and chars[: n + 1] in self.table:
            n += 1
        return self.table[chars[:n]]


@dataclass
class Model:
    """Everything a tagger needs, small enough to broadcast (its size is that of a printed dictionary)."""

    tags: list[str]
    lexicon: dict[str, list[tuple[int, float, str | None]]]
    suffixes: AffixTrie | None = None
    prefixes: AffixTrie | None = None
    forest: Forest | None = None
    default: np.ndarray | None = None
    np_boost: float = 0.95
    threshold: float = 0.001

    def __post_init__(self):
        self.ids = {t: i for i, t in enumerate(self.tags)}
        self.met: dict[str, tuple] = {}
        self.alike: dict[tuple, tuple] = {}

    def options(self, words: list[str], most: int = 200_000) -> list[tuple]:
        """Each word's prepared candidates; those of words met before are kept, in bounded number."""
        out = []
        for word in words:
            found = self.met.get(word)
            if found is None:
                if len(self.met) >= most:
                    self.met.clear()
                    self.alike.clear()
                found = self.met[word] = self._shared(tuple(self.candidates(word)))
            out.append(found)
        return out

    def _shared(self, cands: tuple) -> tuple:
        """Words of one ending have equal candidates; these are prepared and kept once."""
        found = self.alike.get(cands)
        if found is None:
            found = self.alike[cands] = prepared(cands, self.threshold)
        return found

    def candidates(self, word: str) -> list[tuple[int, float, str | None]]:
        """(tag, probability, lemma) of a word; the first rule that fits wins."""
        if word in self.lexicon:
            return self.lexicon[word]
        if re.search("[0-9]", word):
            if NUMERIC.match(word) and "CD" in self.ids:
                return [(self.ids["CD"], 1.0, None)]
            if ORDINAL.match(word) and "JJ" in self.ids:
                return [(self.ids["JJ"], 1.0, None)]
        if ROMAN.match(word) and "NP" in self.ids:
            return [(self.ids["NP"], 1.0, None)]
        upper = word[:1].isupper()
        if upper and word.lower() in self.lexicon:
            return self.lexicon[word.lower()]
        dist = self.suffixes.lookup(word[::-1]) if self.suffixes else None
        if dist is None and self.prefixes:
            dist = self.prefixes.lookup(word)
        found = {t: p for t, p in dist or []}
        if upper and "NP" in self.ids:
            found = {t: p * (1 - self.np_boost) for t, p in found.items()}
            found[self.ids["NP"]] = found.get(self.ids["NP"], 0.0) + self.np_boost
        if not found:
            guess = last_argmax(self.default) if self.default is not None else 0
            return [(guess, 1.0, None)]
        return [(t, p, None) for t, p in found.items()]

    def tag(self, words: list[str]) -> list[tuple[str | None, str | None]]:
        """(tag, lemma) of each word; one decoding over all of them."""
        options = self.options(words)
        if self.forest is None:
            chosen = [likeliest for _, likeliest in options]
        else:
            chosen = decode(options, self.forest, self.ids.get(SENT, 0), self.forest.marginal())
        return [(self.tags[t], lemma) for t, _, lemma in chosen]


def model_from_tables(tags, lexicon, affixes=None, tree=None, **more) -> Model:
    """A model from its tables, whose size is that of a dictionary and so fits the driver.

    tags(tag_id, tag); lexicon(word, tag_id, prob, lemma); affixes(kind "suffix" or "prefix", affix as
    the trie walks it, tag_id, prob); tree(tree, node, ctx, tag, yes, no, weight, probs), probs null for
    inner nodes.
    """
    names = [r["tag"] for r in sorted(tags.collect(), key=lambda r: r["tag_id"])]
    entries: dict[str, list[tuple[int, float, str | None]]] = {}
    for r in lexicon.orderBy("word", "tag_id").collect():
        entries.setdefault(r["word"], []).append((r["tag_id"], r["prob"], r["lemma"]))
    tries: dict[str, dict[str, dict[int, float]]] = {}
    for r in affixes.collect() if affixes is not None else ():
        tries.setdefault(r["kind"], {}).setdefault(r["affix"], {})[r["tag_id"]] = r["prob"]
    forest = None
    if tree is not None:
        trees: dict[int, list[Node]] = {}
        for r in tree.orderBy("tree", "node").collect():
            probs = None if r["probs"] is None else np.asarray(r["probs"], float)
            trees.setdefault(r["tree"], []).append(Node(r["ctx"] or 0, r["tag"] or 0, r["yes"] or 0, r["no"] or 0, r["weight"] or 0.0, probs))
        forest = Forest([trees[k] for k in sorted(trees)])
    load = lambda kind: AffixTrie(tries[kind]) if kind in tries else None
    default = forest.marginal() if forest else None
    return Model(names, entries, load("suffix"), load("prefix"), forest, default, **more)


def last_argmax(x) -> int:
    x = np.asarray(x)
    return int(len(x) - 1 - np.argmax(x[::-1]))


def best(options: list[tuple]) -> tuple:
    """The likeliest; of equals the last."""
    return max(enumerate(options), key=lambda x: (x[1][1], x[0]))[1]


def prepared(cands: list[tuple], threshold: float) -> tuple[list[tuple[int, float, tuple]], tuple]:
    """Candidates within `threshold` of the likeliest as (tag, ln P, candidate), and the likeliest itself."""
    floor = threshold * max(p for _, p, _ in cands)
    return [(c[0], log(c[1]), c) for c in cands if c[1] >= floor and c[1] > 0], best(cands)


def viterbi(options: list[list[tuple]], forest: Forest, sent: int, prior: np.ndarray, threshold: float = 0.001) -> list[tuple]:
    """The best path by sum of ln P(t|w) + ln P(t|context) - ln P(t), over states of the last two tags.

    Candidates below `threshold` of the word's best are dropped; where no step is possible the word's
    likeliest candidate follows the best state so far.
    """
    return decode([prepared(c, threshold) for c in options], forest, sent, prior)


class Moves:
    """What a step does to a set of states, which only scores are missing from; worked out once for equal sets and words."""

    def __init__(self, forest: Forest, prior: np.ndarray, most: int = 1 << 15):
        self.forest, self.less, self.most = forest, [log(x) if x > 0 else 0.0 for x in prior], most
        self.sets: dict[tuple, tuple[tuple, dict]] = {}
        self.made = 0

    def states(self, keys: tuple) -> tuple[tuple, dict]:
        """The states and the moves known from them, by the word's identity."""
        found = self.sets.get(keys)
        if found is None:
            found = self.sets[keys] = (keys, {})
        return found

    def step(self, at: tuple[tuple, dict], word: tuple) -> tuple:
        """(word, states behind it, for each of these the ways there): a way is (state before, ln P(t|w), ln P(t|context), ln P(t), candidate)."""
        if self.made >= self.most:
            self.sets.clear()
            self.made = 0
            at[1].clear()
        ways: dict[tuple[int, int], list[tuple]] = {}
        logs = self.forest.logs
        for i, state in enumerate(at[0]):
            given = logs.get(state)
            if given is None:
                given = logs[state] = [log(x) if x > 0 else None for x in self.forest.predict(state)]
            for tag, p, cand in word[0]:
                if given[tag] is not None:
                    ways.setdefault((state[1], tag), []).append((i, p, given[tag], self.less[tag], cand))
        self.made += 1
        move = at[1][id(word)] = (word, self.states(tuple(ways)), list(ways.values()))
        return move


def decode(words: list[tuple[list[tuple[int, float, tuple]], tuple]], forest: Forest, sent: int, prior: np.ndarray) -> list[tuple]:
    """viterbi over prepared candidates; equal steps are worked out once, whatever the number of words."""
    key = np.asarray(prior, float).tobytes()
    if key not in forest.moves:
        forest.moves.clear()
        forest.moves[key] = Moves(forest, prior)
    moves = forest.moves[key]
    at, scores = moves.states(((sent, sent),)), [0.0]
    steps: list[list[tuple]] = []
    for word in words:
        move = at[1].get(id(word))
        if move is None or move[0] is not word:
            move = moves.step(at, word)
        targets = move[2]
        if targets:
            after, came = [], []
            for ways in targets:
                way = ways[0]
                top = scores[way[0]] + way[1] + way[2] - way[3]
                if len(ways) > 1:
                    for other in ways:
                        s = scores[other[0]] + other[1] + other[2] - other[3]
                        if s > top:
                            top, way = s, other
                after.append(top)
                came.append(way)
            at, scores = move[1], after
        else:
            i = scores.index(max(scores))
            came = [(i, 0.0, 0.0, 0.0, word[1])]
            at, scores = moves.states(((at[0][i][1], word[1][0]),)), [scores[i]]
        steps.append(came)
    out: list[tuple] = []
    if steps:
        i = scores.index(max(scores))
        for came in reversed(steps):
            i, _, _, _, cand = came[i]
            out.append(cand)
    return out[::-1]
