"""Secrets in texts: plain rules, and a character network over every candidate."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import secret_net
from .graph import Scratch
from .tables import map_batches, row_blocks, text_bytes
from .words import find_words

#: The kinds in the order of the result, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
WORDS = ("passw", "secret", "token", "apikey", "api_key")

_HEX = np.isin(np.arange(256), list(b"0123456789abcdef")).astype(np.uint8)
_TOKEN = np.isin(np.arange(256), [*b"+/_=.-", *(b for b in range(128) if chr(b).isalnum())]).astype(np.uint8)


@dataclass(frozen=True)
class Scan:
    """A candidate is a run of least_chars or more token characters."""

    least_chars: int = 12
    context: int = 24  # bytes on either side
    rounds: int = 8  # networks of the learners are averaged after each
    learner_windows: int = 20_000  # of a learner in a round, about; more windows make more learners
    learner_bytes: int = 16 << 20  # likewise
    few: int = 1_000  # windows of a kind up to which exactly each fifth calibrates; of more, those that a hash picks
    recall: float = 0.98


def base_spans(text: str, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain rules, sorted; hexes are the runs of hex digits."""
    spans = [(a, 2, b) for a, b in hexes]
    low = text.lower()
    if any(word in low for word in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return sorted(spans)


def scan_rows(texts: list[str | None], raw: np.ndarray, offsets: np.ndarray, p: Scan):
    """Row by row: base spans, candidates as code points, and their windows."""
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    starts, ends, rows = find_words(raw, offsets, _HEX)
    long = ends - starts >= LEAST["hex"]
    hex_starts, hex_ends, hex_rows = starts[long], ends[long], rows[long]
    starts, ends, rows = find_words(raw, offsets, _TOKEN)
    picked = ends - starts >= p.least_chars
    starts, ends, rows = starts[picked], ends[picked], rows[picked]
    for row, text in enumerate(texts):
        zero = before[offsets[row]]
        h = slice(*np.searchsorted(hex_rows, [row, row + 1]))
        hexes = list(zip((before[hex_starts[h]] - zero).tolist(), (before[hex_ends[h]] - zero).tolist()))
        c = slice(*np.searchsorted(rows, [row, row + 1]))
        windows = []
        for a, b in zip(starts[c].tolist(), ends[c].tolist()):
            first, last = max(offsets[row], a - p.context), min(offsets[row + 1], b + p.context)
            window = raw[first:last].astype(np.int64)
            window[a - first : b - first] += 256
            windows.append(window)
        candidates = list(zip((before[starts[c]] - zero).tolist(), (before[ends[c]] - zero).tolist()))
        yield base_spans(text or "", hexes), candidates, windows


def kinds_of(candidates: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """Bits of the kinds of base spans that each candidate overlaps with; both lists are sorted by start."""
    out = []
    for a, b in candidates:
        out.append(sum(1 << k for k in {kind for start, kind, end in spans if start < b and end > a}))
    return out


def covered_whole(candidates: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[bool]:
    """Whether one base span holds the whole of each candidate; both lists are sorted by start."""
    out, k, reach = [], 0, -1
    for a, b in candidates:
        while k < len(spans) and spans[k][0] <= a:
            reach, k = max(reach, spans[k][2]), k + 1
        out.append(b <= reach)
    return out


def _rows(batch: pa.RecordBatch, p: Scan):
    raw, offsets = text_bytes(batch.column("text"))
    for a, b in row_blocks(offsets):
        yield from scan_rows(batch.column("text").slice(a, b - a).to_pylist(), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], p)


def hidden(window: np.ndarray, kinds: int, random: np.random.Generator) -> np.ndarray:
    """The window of a labelled finding without what its rule goes by: the keyword becomes other
    letters, AKIA goes, hex digits are written large."""
    window, raw = window.copy(), window.astype(np.uint8).tobytes()
    if kinds & 1:
        for m in ASSIGN.finditer(raw.decode("latin-1")):
            a, b = m.span(1)
            window[a:b] = (window[a:b] & 256) + random.integers(97, 123, b - a)
    if kinds & 4:
        for m in re.finditer(rb"[0-9a-f]{%d,}" % LEAST["hex"], raw):
            a, b = m.span()
            window[a:b] -= np.where((window[a:b] & 255) >= 97, 32, 0)
    if kinds & 2:
        for m in reversed(list(re.finditer(rb"AKIA(?=[A-Z0-9]{%d})" % (LEAST["access"] - 4), raw))):
            window = np.delete(window, np.s_[m.start() : m.end()])
    return window


def examples(part: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Windows and kinds (as 0 or 1 each) in an order of their own; every labelled one is followed by itself with
    its trigger hidden."""
    part, windows, bits = part.sort_by([("mix", "ascending"), ("window", "ascending"), ("kinds", "ascending")]), [], []
    for raw, kinds, mix in zip(*(part.column(c).to_pylist() for c in ("window", "kinds", "mix"))):
        windows.append(np.frombuffer(raw, np.int16).astype(np.int64))
        if kinds:
            windows.append(hidden(windows[-1], kinds, np.random.default_rng(mix & (1 << 64) - 1)))
        bits += [kinds] * (1 + (kinds > 0))
    return windows, (np.array(bits, np.int64)[:, None] >> np.arange(len(KINDS)) & 1).astype(float)


def train_rounds(rows: DataFrame, p: Scan) -> secret_net.Net:
    """A network learned from all rows(window, kinds, mix).

    Each round starts the learners from one network and averages what they return.  Up to
    learner_windows rows a round passes over all of them, with more over a part of them; eight rounds
    pass over every row at least once.  Learners and parts are dealt by hash, so the network doesn't
    depend on where the rows lie.
    """
    net = secret_net.new_net(16, len(KINDS))
    counts = {r.kinds: r for r in rows.groupBy("kinds").agg(F.count("*").alias("n"), F.sum(F.octet_length("window")).alias("size")).collect()}
    total, size = sum(r.n for r in counts.values()), sum(r["size"] for r in counts.values())
    if not total:
        return net
    found = np.array([sum(2 * r.n for k, r in counts.items() if k >> kind & 1) for kind in range(len(KINDS))])
    heavy = secret_net.heavier(found, sum(r.n * (1 + (k > 0)) for k, r in counts.items()))
    shares = max(1, total // p.learner_windows, size // p.learner_bytes)
    parts = min(p.rounds, shares)
    learners = max(1, shares // parts)
    rounds = 1 if shares == 1 else p.rounds
    rows = rows.withColumn("part", F.pmod(F.shiftright("mix", 8), F.lit(parts))).withColumn("learner", F.pmod(F.shiftright("mix", 24), F.lit(learners)))
    names = ("tables", "shift", "out")
    cuts = np.cumsum([0, *(getattr(net, name).size for name in names)])

    for k in range(rounds):

        def learn(part: pa.Table) -> pa.Table:  # is run before the round ends
            windows, labels = examples(part)
            own = secret_net.train(windows, labels, epochs=p.rounds // rounds, net=net, heavy=heavy, seed=k)
            flat = np.concatenate([getattr(own, name).ravel() for name in names])
            pieces = [x.astype(np.float32).tobytes() for x in np.split(flat, range(1 << 13, len(flat), 1 << 13))]
            some = [np.full(len(pieces), x, np.int64) for x in (part.column("learner")[0].as_py(), len(windows))]
            return pa.table([pa.array(np.arange(len(pieces))), *map(pa.array, some), pa.array(pieces, pa.binary())], ["piece", "learner", "n", "weights"])

        def average(part: pa.Table) -> pa.Table:
            part = part.sort_by("learner")
            n, total = part.column("n").to_numpy().astype(float), 0.0
            for share, raw in zip(n / n.sum(), part.column("weights")):
                total = total + share * np.frombuffer(raw.as_py(), np.float32)
            return pa.table([part.column("piece").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["piece", "weights"])

        learned = rows.where(F.col("part") == k % parts).groupBy("learner").applyInArrow(learn, "piece long, learner long, n long, weights binary")
        pieces = learned.groupBy("piece").applyInArrow(average, "piece long, weights binary").collect()  # one network
        if pieces:
            flat = np.concatenate([np.frombuffer(r.weights) for r in sorted(pieces)])
            net = replace(net, **{name: flat[a:b].reshape(getattr(net, name).shape) for name, a, b in zip(names, cuts, cuts[1:])})
    return net


def calibrated(net: secret_net.Net, rows: DataFrame, recall: float, scratch: Scratch) -> secret_net.Net:
    """What secret_net.calibrate does, over all rows and their copies with triggers hidden."""
    names = [f"{c}{kind}" for c in "zy" for kind in range(len(KINDS))]

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        windows, labels = examples(pa.table(batch))
        return pa.record_batch([pa.array(c) for c in np.hstack([secret_net.logits(net, windows), labels]).T], names)

    scores = scratch.write(map_batches(rows.select("window", "kinds", "mix"), score, ", ".join(f"{c} double" for c in names)))
    count, *positive = scores.agg(F.count("*"), *[F.coalesce(F.sum(f"y{kind}"), F.lit(0.0)) for kind in range(len(KINDS))]).first()
    scale, limits = net.scale.copy(), net.limits.copy()
    for kind, own in enumerate(positive):
        if not 0 < own < count:
            continue
        x, y = F.col(f"z{kind}"), F.col(f"y{kind}")

        def sums(w, x=x, y=y):
            at = F.least(F.greatest(x * float(w[0]) + float(w[1]), F.lit(-30.0)), F.lit(30.0))
            q = 1 / (1 + F.exp(-at))
            some = scores.select(x.alias("x"), (q - y).alias("g"), (q * (1 - q) + 1e-9).alias("h"))
            a, b, c, d, e = some.agg(*[F.sum(F.expr(t)) for t in ("x * g", "g", "x * x * h", "x * h", "h")]).first()
            return np.array([a, b]), np.array([[c, d], [d, e]])

        scale[:, kind] = w = secret_net.fit_scale(sums)
        least = scores.where(y > 0).orderBy(x if w[0] >= 0 else x.desc()).select(x.alias("x")).limit(1 + int(np.floor((1 - recall) * own)))
        limits[kind] = secret_net.chance(least.agg(F.max("x") if w[0] >= 0 else F.min("x")).first()[0], w)
    scratch.drop(scores)
    return replace(net, scale=scale, limits=limits)


def train_scan(docs: DataFrame, p: Scan = Scan()) -> secret_net.Net:
    """The network, learned from all candidates of all documents: those that the plain rules find, and others.

    It goes beyond the plain rules: every labelled finding is learned from as it is and once more
    with its trigger hidden.  Other candidates are unlabelled rather than negative: those that a
    first network takes for findings are left out when the final one learns.  Of each kind four
    windows of five teach, the others calibrate.  Equal windows are one; they stay in tables, and only
    networks and sums come to the driver.
    """
    scratch = Scratch(docs.sparkSession)

    def collect(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for spans, candidates, windows in _rows(batch, p):
            out += [(w.astype(np.int16).tobytes(), k) for w, k in zip(windows, kinds_of(candidates, spans))]
        return pa.record_batch([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32())], ["window", "kinds"])

    found = map_batches(docs.select("doc_id", "text"), collect, "window binary, kinds int").distinct()
    found = scratch.write(found.withColumn("mix", F.xxhash64("window", "kinds")))
    few = [r.kinds for r in found.groupBy("kinds").count().collect() if r["count"] <= p.few]
    held = (F.pmod(F.col("mix"), F.lit(5)) == 1) & ~F.col("kinds").isin(few)
    for kinds in few:
        own = sorted(r.mix for r in found.where(F.col("kinds") == kinds).select("mix").collect())  # few
        held = held | (F.col("kinds") == kinds) & F.col("mix").isin(own[1::5])

    first = train_rounds(found.where(~held), p)

    def unlike(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = batch.column("kinds").to_numpy()
        windows = [np.frombuffer(raw, np.int16).astype(np.int64) for raw in batch.filter(pa.array(kinds == 0)).column("window").to_pylist()]
        keep = np.ones(len(kinds), bool)
        keep[kinds == 0] = (secret_net.logits(first, windows) < 0).all(1)
        return batch.filter(pa.array(keep))

    kept = scratch.write(map_batches(found, unlike, found.schema))
    scratch.drop(found)
    net = calibrated(train_rounds(kept.where(~held), p), kept.where(held), p.recall, scratch)
    scratch.drop(kept)
    return net


def scan(docs: DataFrame, net: secret_net.Net, p: Scan = Scan()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every whole text.

    spans lists kind:start:end in code points, sorted by start and kind, comma-joined: all base
    spans, and as kind "learned" the candidates that the network flags and no base span covers whole.
    Null and empty texts have none; repeated rows are scanned each.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(_rows(batch, p))
        hot = iter(secret_net.flagged(net, [w for _, _, windows in rows for w in windows]).tolist())
        names, counts, digests, texts = [*KINDS, "learned"], [], [], []
        for spans, candidates, _ in rows:
            show = lambda x: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in x)
            counts.append([sum(k == kind for _, k, _ in spans) for kind in range(len(KINDS))])
            digests.append(hashlib.sha256(show(spans).encode()).hexdigest())
            flagged = [c for c in candidates if next(hot)]
            learned = [(a, 3, b) for (a, b), covered in zip(flagged, covered_whole(flagged, spans)) if not covered]
            texts.append(show(sorted(spans + learned)))
        counts = np.array(counts, np.int64).reshape(-1, len(KINDS))
        arrays = [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(3)), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
        return pa.record_batch(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def secrets(docs: DataFrame, p: Scan = Scan()) -> DataFrame:
    """Findings of every document by a network learned from the same table."""
    return scan(docs, train_scan(docs, p), p)
