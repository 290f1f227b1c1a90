"""A character convolutional network over candidates of any length, in numpy.

A window is the candidate with its context; a character inside the candidate and the same
character around it are different symbols.  Filters of several characters slide over the whole
window; their largest and mean values go into one logistic output for each kind of secret.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .words import places

WIDTH = 5
SYMBOLS = 513  # 256 outside, 256 inside, and the gap between windows


@dataclass
class Net:
    tables: np.ndarray  # WIDTH x SYMBOLS x filters
    shift: np.ndarray
    out: np.ndarray  # 2 * filters + 1 x kinds
    scale: np.ndarray  # calibration: slope and constant of each kind
    limits: np.ndarray  # least calibrated score of each kind


def new_net(filters: int, kinds: int) -> Net:
    random = np.random.default_rng(0)
    tables = random.normal(0, 0.3, (WIDTH, SYMBOLS, filters))
    return Net(tables, np.zeros(filters), random.normal(0, 0.1, (2 * filters + 1, kinds)), np.tile([[1.0], [0.0]], kinds), np.full(kinds, 0.5))


def joined(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows in one sequence with gaps between, and where each begins and ends."""
    gap = np.full(WIDTH - 1, SYMBOLS - 1)
    sizes = np.array([len(w) for w in windows])
    ends = np.cumsum(sizes + WIDTH - 1)
    return np.concatenate([x for w in windows for x in (w, gap)]), ends - sizes - WIDTH + 1, sizes


def forward(net: Net, windows: list[np.ndarray]):
    symbols, begin, sizes = joined(windows)
    count = len(symbols) - WIDTH + 1
    raw = sum(net.tables[k][symbols[k : k + count]] for k in range(WIDTH)) + net.shift
    active = np.maximum(raw, 0)
    edges = np.stack([begin, np.minimum(begin + sizes, count)], 1)
    at = edges.ravel()
    most = np.maximum.reduceat(np.vstack([active, np.zeros((1, active.shape[1]))]), at)[::2]
    mean = np.add.reduceat(np.vstack([active, np.zeros((1, active.shape[1]))]), at)[::2] / sizes[:, None]
    pooled = np.hstack([most, mean, np.ones((len(windows), 1))])
    return symbols, begin, sizes, raw, active, pooled, pooled @ net.out


def logits(net: Net, windows: list[np.ndarray], at_once: int = 1 << 17) -> np.ndarray:
    """Scores of all windows; windows are taken together up to so many characters."""
    out, part, size = [], [], 0
    for k, w in enumerate(windows):
        part.append(w)
        size += len(w) + WIDTH
        if size >= at_once or k == len(windows) - 1:
            out.append(forward(net, part)[-1])
            part, size = [], 0
    return np.concatenate(out) if out else np.zeros((0, net.out.shape[1]))


def _gradients(net: Net, windows: list[np.ndarray], y: np.ndarray, heavy: np.ndarray, at_once: int) -> dict[str, np.ndarray]:
    """Gradients of the mean loss; so many characters at a time, so a window may be of any length."""
    symbols, begin, sizes = joined(windows)
    symbols, filters = symbols.astype(np.int16), net.tables.shape[2]
    tables, shift = net.tables.astype(np.float32), net.shift.astype(np.float32)
    place, starts = places(begin, sizes), np.cumsum(sizes) - sizes
    most, total = (np.zeros((len(windows), filters), np.float32) for _ in range(2))

    def parts():
        for a in range(0, len(place), at_once):
            own = place[a : a + at_once]
            first, last = np.searchsorted(starts, [a, a + len(own) - 1], "right") - [1, 0]
            at = np.maximum(starts[first:last] - a, 0)
            raw = sum(tables[k].take(symbols[own + k], 0) for k in range(WIDTH)) + shift
            yield own, slice(first, last), at, raw, np.maximum(raw, 0)

    for held in parts():
        _, some, at, _, active = held
        most[some] = np.maximum(most[some], np.maximum.reduceat(active, at))
        total[some] += np.add.reduceat(active, at)
    pooled = np.hstack([most, total / sizes[:, None], np.ones((len(windows), 1))])
    z = pooled @ net.out
    error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, heavy, 1.0) / len(windows)
    back = (error @ net.out.T).astype(np.float32)
    even = back[:, filters : 2 * filters] / sizes[:, None].astype(np.float32)
    grad = {"tables": np.zeros_like(net.tables), "shift": np.zeros_like(net.shift), "out": pooled.T @ error}
    met = most <= 0  # the largest value has been found, or passes nothing on
    for own, some, at, raw, active in parts() if len(place) > at_once else [held]:
        owner = np.repeat(np.arange(some.start, some.stop), np.diff(at, append=len(own)))
        spread = even[owner]
        rows, columns = np.nonzero(active == most[owner])
        first = np.full(most.shape, -1)
        first[owner[rows[::-1]], columns[::-1]] = rows[::-1]
        now, column = np.nonzero((first >= 0) & ~met)
        spread[first[now, column], column] += back[now, column]
        met |= first >= 0
        spread *= raw > 0
        grad["shift"] += spread.sum(0)
        for k in range(WIDTH):
            kinds = symbols[own + k]
            order = np.argsort(kinds, kind="stable")
            kinds = kinds[order]
            edges = np.flatnonzero(np.diff(kinds, prepend=-1))
            grad["tables"][k][kinds[edges]] += np.add.reduceat(spread[order], edges)
    return grad


def heavier(positive: np.ndarray, count: int) -> np.ndarray:
    """How much more the findings of each kind weigh, of which there are so many among count windows."""
    return np.clip((count - positive) / np.maximum(positive, 1), 1, 20)


def train(
    windows: list[np.ndarray],
    labels: np.ndarray,
    filters: int = 16,
    epochs: int = 8,
    batch: int = 128,
    rate: float = 0.01,
    net: Net | None = None,
    heavy: np.ndarray | None = None,
    seed: int = 1,
    at_once: int = 1 << 16,
) -> Net:
    """A network fitted by Adam to labels (windows x kinds), from the given one on; rare kinds weigh more."""
    net = copy.deepcopy(net) if net else new_net(filters, labels.shape[1])
    if not len(windows):
        return net
    heavy = heavier(labels.sum(0), len(labels)) if heavy is None else heavy
    moments, step, order = {}, 0, np.random.default_rng(seed)
    for _ in range(epochs):
        mixed = order.permutation(len(windows))
        for first in range(0, len(mixed), batch):
            own = mixed[first : first + batch]
            step += 1
            for name, grad in _gradients(net, [windows[i] for i in own], labels[own], heavy, at_once).items():
                m, v = moments.get(name, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
                moments[name] = m, v
                value = getattr(net, name)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit_scale(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Slope and constant that make scores probabilities; sums(w) returns gradient and Hessian over all windows."""
    w = np.array([1.0, 0.0])
    for _ in range(30):
        gradient, hessian = sums(w)
        change = np.linalg.solve(hessian + np.eye(2) * 0.1, gradient + 0.1 * (w - [1.0, 0.0]))
        w = w - change
        if np.abs(change).max() < 1e-12:
            break
    return w


def chance(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z * w[0] + w[1], -30, 30)))


def calibrate(net: Net, windows: list[np.ndarray], labels: np.ndarray, recall: float) -> Net:
    """Scores made probabilities on windows not trained on, and the highest limit of each kind
    that keeps the wanted recall of the labelled findings."""
    z = logits(net, windows)
    for kind in range(labels.shape[1]):
        y = labels[:, kind] if len(windows) else np.zeros(0)
        if not 0 < y.sum() < len(y):
            continue
        x = np.stack([z[:, kind], np.ones(len(y))], 1)

        def sums(w, x=x, y=y):
            q = chance(x[:, 0], w)
            return x.T @ (q - y), (x * (q * (1 - q) + 1e-9)[:, None]).T @ x

        net.scale[:, kind] = w = fit_scale(sums)
        found = np.sort(chance(x[:, 0], w)[y > 0])
        net.limits[kind] = found[int(np.floor((1 - recall) * len(found)))]
    return net


def flagged(net: Net, windows: list[np.ndarray]) -> np.ndarray:
    """Whether any kind's calibrated score reaches its limit."""
    return (chance(logits(net, windows), net.scale) >= net.limits).any(1)
