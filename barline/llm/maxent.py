"""A hashed maximum-entropy model of the next word, in sparse numpy batches.

Words are the leaves of a tree; the model gives the class, the first branch, and then each branch
below it.  All come from sums of rows of weights that the context selects: a constant, the word
before, the word two before (a skip), and both.  Contexts are hashed from the words themselves,
rows of branches from context and node.  Each choice of a branch is a softmax.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import joined_hash


@dataclass(frozen=True)
class Shape:
    classes: int = 32
    members: int = 32  # branches of a class, and of each node below
    pair_rows: int = 1 << 13  # hashed rows of classes, for each kind of context
    word_rows: int = 1 << 15  # hashed rows of context and node, with a constant for each node
    levels: int = 2  # choices that lead to a word

    @property
    def words(self) -> int:
        return self.classes * self.members ** (self.levels - 1)

    @property
    def nodes(self) -> int:
        return self.classes * sum(self.members**k for k in range(self.levels - 1))

    @property
    def context_rows(self) -> int:
        return 1 + 3 * self.pair_rows


#: Leaves of the largest tree; further words share leaves.
MOST_WORDS = 1 << 20


def shape_of(frequent: int, tokens: int) -> Shape:
    """A tree with two leaves for each frequent word, and hashed rows that grow with the root of the tokens."""
    levels = 2
    while 32**levels < min(2 * frequent, MOST_WORDS):
        levels += 1
    rows = max(1 << 15, 1 << int(np.ceil(np.log2(4 * np.sqrt(max(tokens, 1))))))
    tree = Shape(levels=levels)
    return Shape(pair_rows=rows // 4, word_rows=rows + tree.nodes, levels=levels)


def contexts(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes of each token's contexts, tokens x 3; before a text stands one common word."""
    words = np.asarray(words).astype(np.int64).view(np.uint64)
    one, two = (np.full(len(words), 2**64 - 1, np.uint64) for _ in range(2))
    one[1:] = np.where(rows[1:] == rows[:-1], words[:-1], one[1:])
    two[2:] = np.where(rows[2:] == rows[:-2], words[:-2], two[2:])
    kind = [np.full(len(words), k, np.uint64) for k in range(2)]
    return np.stack([joined_hash(kind[0], one), joined_hash(kind[1], two), joined_hash(one, two, one)], 1)


def class_rows(context: np.ndarray, s: Shape) -> np.ndarray:
    """Rows of the classes' weights for a context, tokens x 4."""
    hashed = 1 + np.arange(3) * s.pair_rows + (context % np.uint64(s.pair_rows)).astype(np.int64)
    return np.hstack([np.zeros((len(context), 1), np.int64), hashed])


def branches(ids: np.ndarray, s: Shape):
    """Node and branch of each word at every level below the classes."""
    first = 0
    for level in range(1, s.levels):
        below = s.members ** (s.levels - 1 - level)
        yield first + ids // (below * s.members), ids // below % s.members
        first += s.classes * s.members ** (level - 1)


def word_rows(context: np.ndarray, node: np.ndarray, s: Shape) -> np.ndarray:
    """Rows of a node's weights for a context; the constants have rows of their own."""
    hashed = joined_hash(context.ravel(), np.repeat(node, 3).astype(np.uint64))
    rest = s.nodes + (hashed % np.uint64(s.word_rows - s.nodes)).astype(np.int64).reshape(-1, 3)
    return np.hstack([node[:, None], rest])


def start(counts: np.ndarray, s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Weights that give each word its share of the counts in every context; unused places nothing."""
    by_class, by_word = np.zeros((s.context_rows, s.classes), np.float32), np.zeros((s.word_rows, s.members), np.float32)
    share, last = np.log(np.maximum(counts, 1e-6)), s.nodes
    for _ in range(1, s.levels):
        share = share.reshape(-1, s.members)
        total = np.logaddexp.reduce(share, 1)
        by_word[last - len(share) : last] = share - total[:, None]
        last, share = last - len(share), total
    by_class[0] = share
    return by_class, by_word


def _summed(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of each token's rows of weights, less its largest value."""
    x = weights.take(rows[:, 0], 0)
    for k in range(1, rows.shape[1]):
        x += weights.take(rows[:, k], 0)
    x -= x.max(1, keepdims=True)
    return x


def log_chances(by_class: np.ndarray, by_word: np.ndarray, ids: np.ndarray, rows: np.ndarray, s: Shape, at_once: int = 1 << 15, words: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of each token's chance after the tokens before it in its row; words are the
    hashes that contexts are made of, the ids if not given."""
    out, context = np.empty(len(ids)), contexts(ids if words is None else words, rows)
    for a in range(0, len(ids), at_once):
        own, c = ids[a : a + at_once], context[a : a + at_once]
        at = np.arange(len(own))
        total = np.zeros(len(own))
        steps = [(by_class, class_rows(c, s), own // (s.words // s.classes))]
        for weights, r, place in (*steps, *((by_word, word_rows(c, node, s), place) for node, place in branches(own, s))):
            x = _summed(weights, r)
            picked = x[at, place]
            total += picked - np.log(np.exp(x, out=x).sum(1))
        out[a : a + at_once] = total
    return out


def _sums(x: np.ndarray, first: np.ndarray, long: int = 16) -> np.ndarray:
    """The sum of the rows of x from each place in first up to the next, added in their order."""
    sizes = np.diff(first, append=len(x))
    total = x.take(first, 0)
    left = np.flatnonzero((sizes > 1) & (sizes <= long))
    for k in range(1, long):
        left = left[sizes[left] > k]
        if not len(left):
            break
        total[left] += x.take(first[left] + k, 0)
    for i in np.flatnonzero(sizes > long):
        total[i] = x[first[i] : first[i] + sizes[i]].sum(0)
    return total


def _descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """One AdaGrad step; rows (tokens x features) share each token's gradient."""
    # each row's gradients one after the other, in the order of features and tokens
    bits = int(rows.size).bit_length()
    order = np.sort(rows.T.ravel() << bits | np.arange(rows.size))
    kinds, at = order >> bits, order & (1 << bits) - 1
    first = np.flatnonzero(np.diff(kinds, prepend=-1))
    used, share = kinds[first], grad.astype(float) / len(grad)
    total = _sums(share.take(at % len(grad), 0), first).astype(np.float32)
    sums = squares.take(used, 0)
    sums += total * total
    squares[used] = sums
    total *= np.float32(rate)
    total /= np.sqrt(sums, out=sums)
    new = weights.take(used, 0)
    new -= total
    weights[used] = new


def new_squares(by_class: np.ndarray, by_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squared gradients before the first step; train() adds to them over all its calls."""
    return np.full_like(by_class, 1e-6), np.full_like(by_word, 1e-6)


def train(by_class: np.ndarray, by_word: np.ndarray, ids: np.ndarray, rows: np.ndarray, s: Shape, rate: float = 0.2, batch: int = 4096, squares=None, words: np.ndarray | None = None) -> None:
    """One pass of gradient steps over the tokens, changing the weights in place."""
    squares = new_squares(by_class, by_word) if squares is None else squares
    context = contexts(ids if words is None else words, rows)

    def step(weights, sums, r, place):
        x = _summed(weights, r)
        x -= np.log(np.exp(x).sum(1, keepdims=True))
        np.exp(x, out=x)
        x[np.arange(len(x)), place] -= 1
        _descend(weights, sums, r, x, rate)

    for a in range(0, len(ids), batch):
        own, c = ids[a : a + batch], context[a : a + batch]
        step(by_class, squares[0], class_rows(c, s), own // (s.words // s.classes))
        for node, place in branches(own, s):
            step(by_word, squares[1], word_rows(c, node, s), place)
